"""Column helpers and task-side kernels shared by the operators."""
