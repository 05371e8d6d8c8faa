"""How many clusters: sweep K, score every labeling, vote, and agree over trials."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.columns import col, require_columns
from shoal.operators.agglomerative import Dendrogram, agglomerative
from shoal.operators.choose_k import best_k, consensus, k_detail, voting_history, weighted_vote
from shoal.operators.kmeans import KMeansFit, assign_nearest, kmeans_many, summarise
from shoal.operators.quality import MAX_PAIRS, score
from shoal.session import materialise

K_RANGE = range(2, 11)
SEED = 42
CURVES = "trial int, model string, k int, metric string, value double"


@dataclass(frozen=True)
class Sweep:
    """Curves of every trial, and the fits behind them for reuse by training."""

    curves: DataFrame
    fits: Mapping[tuple[int, int], KMeansFit] = field(repr=False)
    tree: Dendrogram = field(repr=False)


@dataclass(frozen=True)
class KAnalysis:
    """``curves``, best K per index, ``votes``, ``history``, ``detail`` and the suggestion."""

    curves: DataFrame
    best: DataFrame
    votes: DataFrame
    history: DataFrame
    detail: DataFrame
    suggestion: DataFrame
    kmeans_k: int
    hierarchical_k: int
    sweep: Sweep = field(repr=False)


def k_sweep(df: DataFrame, ks: Sequence[int] = K_RANGE, n_trials: int = 1, seed: int = SEED,
            key: str = "row_id", features: str = "features", micro: int | None = None,
            max_pairs: int | None = MAX_PAIRS) -> Sweep:
    """Quality of K-Means and ward clustering for every K, per trial.

    All K-Means fits share their scans; the tree is built once and cut for every K, since it
    has no random part; and all labelings are scored together, so that pair distances are
    computed once. With ``micro`` the tree and the silhouette see that many weighted
    micro-clusters instead of the rows, which makes the whole sweep linear in the table.
    """
    ks = sorted(set(int(k) for k in ks))
    if n_trials < 1 or not ks or ks[0] < 2:
        raise ValueError("need at least one trial and K from 2 upwards")
    require_columns(df, [key, features])
    n = df.count()
    if n < ks[-1] + 1:
        raise ValueError(f"{n} rows are too few for K up to {ks[-1]}")
    seeds = [seed + t for t in range(n_trials)]
    tree = agglomerative(df, "ward", key, features, micro, max_pairs)  # refuses too many pairs before any fit
    fits = kmeans_many(df, ks, seeds, key, features)
    by_tree = {f"h_{k}": k for k in ks}
    by_fit = {f"m_{s}_{k}": (s, k) for s in seeds for k in ks}
    names = [*by_tree, *by_fit]
    labelled = assign_nearest(tree.cut(ks, list(by_tree)), [fits[m].centres for m in by_fit.values()],
                              list(by_fit), features)
    kept = [c for c in ("micro",) if micro is not None]
    labelled = materialise(labelled.select(col(features).alias("features"), *kept, *names), "labelled")
    # micro-clusters are split by the labels of their rows, so that a point has one label per model
    points = summarise(labelled, names) if micro is not None else None
    scores = {r["model"]: r for r in score(labelled, names, max_pairs=max_pairs, points=points).collect()}
    curves = []
    for t, s in enumerate(seeds, start=1):
        for k in ks:
            curves.append((t, "kmeans", k, "inertia", fits[s, k].inertia))
            for model, name in (("kmeans", f"m_{s}_{k}"), ("hierarchical", f"h_{k}")):
                for metric in ("silhouette", "davies_bouldin", "calinski_harabasz"):
                    curves.append((t, model, k, metric, scores[name][metric]))
    return Sweep(df.sparkSession.createDataFrame(curves, CURVES), fits, tree)


def analyze_k(df: DataFrame, n_trials: int = 1, weights: Mapping[str, int] | None = None,
              ks: Sequence[int] = K_RANGE, seed: int = SEED, key: str = "row_id",
              features: str = "features", micro: int | None = None,
              max_pairs: int | None = MAX_PAIRS) -> KAnalysis:
    """Suggest K for both models by weighted votes of the indices, agreed over the trials."""
    sweep = k_sweep(df, ks, n_trials, seed, key, features, micro, max_pairs)
    best = best_k(sweep.curves)
    votes = weighted_vote(best, weights)
    agreed = consensus(votes)
    found = {r["model"]: r["k"] for r in agreed.collect()}
    return KAnalysis(sweep.curves, best, votes, voting_history(votes), k_detail(best), agreed,
                     found["kmeans"], found["hierarchical"], sweep)
