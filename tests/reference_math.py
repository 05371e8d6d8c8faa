"""Plain numpy versions of the clustering operators, to test the distributed ones against."""

import numpy as np


def pairwise(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def silhouette(x, labels):
    d, out = pairwise(x), []
    for i, own in enumerate(labels):
        mine = (labels == own) & (np.arange(len(x)) != i)
        if not mine.any():
            out.append(0.0)
            continue
        a = d[i][mine].mean()
        b = min(d[i][labels == c].mean() for c in set(labels) - {own})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


def davies_bouldin(x, labels):
    ids = sorted(set(labels))
    c = np.array([x[labels == i].mean(0) for i in ids])
    s = np.array([np.linalg.norm(x[labels == i] - m, axis=1).mean() for i, m in zip(ids, c)])
    return np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(len(ids)) if j != i)
                    for i in range(len(ids))])


def calinski_harabasz(x, labels):
    ids, n = sorted(set(labels)), len(x)
    between = sum((labels == i).sum() * ((x[labels == i].mean(0) - x.mean(0)) ** 2).sum() for i in ids)
    within = sum(((x[labels == i] - x[labels == i].mean(0)) ** 2).sum() for i in ids)
    return between * (n - len(ids)) / (within * (len(ids) - 1))


def agglomerate(x, linkage):
    """Heights of all merges, and the partition (as smallest member per point) for every K."""
    n = len(x)
    h = pairwise(x)
    np.fill_diagonal(h, np.inf)
    size, label, heights, parts = np.ones(n), np.arange(n), [], {n: np.arange(n)}
    for step in range(n - 1):
        a, b = sorted(divmod(int(np.argmin(h)), n))
        heights.append(h[a, b])
        for c in range(n):
            if c in (a, b) or not np.isfinite(h[a, c]):
                continue
            new = {"single": lambda: min(h[a, c], h[b, c]), "complete": lambda: max(h[a, c], h[b, c]),
                   "average": lambda: (size[a] * h[a, c] + size[b] * h[b, c]) / (size[a] + size[b]),
                   "ward": lambda: np.sqrt(((size[a] + size[c]) * h[a, c] ** 2 + (size[b] + size[c]) * h[b, c] ** 2
                                            - size[c] * h[a, b] ** 2) / (size[a] + size[b] + size[c]))}[linkage]()
            h[a, c] = h[c, a] = new
        h[b, :] = h[:, b] = np.inf
        size[a] += size[b]
        label[label == b] = a
        parts[n - 1 - step] = label.copy()
    return np.array(heights), parts


def numbered(partition):
    """Clusters renumbered by their smallest member."""
    first = {}
    return [first.setdefault(int(c), len(first)) for c in partition]
