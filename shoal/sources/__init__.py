"""Reading datasets and writing result tables."""
