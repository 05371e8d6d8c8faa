"""K-Means fits, their indices and principal components of many datasets at once: every scan serves them all."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.arrays import lists, matrix, nearest
from shoal.functions.columns import col, require_columns
from shoal.operators import quality
from shoal.operators.kmeans import KMeansFit, kmeans_groups, number_groups
from shoal.operators.pca import pca_groups
from shoal.plans.analyze_k import K_RANGE, SEED
from shoal.session import materialise


@dataclass(frozen=True)
class GroupFits:
    """``curves``: (group, trial, k, metric, value); ``components``: (group, component, variance, ratio, loading)."""

    curves: DataFrame
    components: DataFrame
    fits: Mapping[tuple[object, int, int], KMeansFit] = field(repr=False)
    group: str

    def assign(self, df: DataFrame, k: int, seed: int = SEED, label: str = "label", features: str = "features") -> DataFrame:
        """``df`` with the number of the nearest centre among those of the row's group; null where the group has no such fit."""
        names, rows = number_groups(df.withColumn("__group", col(self.group)), "__group")
        centres = {p: self.fits[n, seed, k].centres for p, n in enumerate(names) if (n, seed, k) in self.fits}

        @F.arrow_udf("int")
        def closest(part: pa.Array, x: pa.Array) -> pa.Array:
            return pa.array(_labels(part.to_numpy(), matrix(x), [centres])[:, 0], pa.int32())

        found = rows.withColumn("__label", closest("part", col(features).cast("array<double>")))
        return found.select(*[col(c) for c in df.columns], F.when(F.col("__label") >= 0, F.col("__label")).alias(label))


def _labels(part: np.ndarray, x: np.ndarray, models: list[dict[int, np.ndarray]]) -> np.ndarray:
    """Per row and model the nearest centre of the row's part, -1 without one."""
    out = np.full((len(part), len(models)), -1, np.int64)
    for p in np.unique(part).tolist():
        mine = np.flatnonzero(part == p)
        for m, centres in enumerate(models):
            if p in centres:
                out[mine, m] = nearest(x[mine], centres[p])
    return out


def fit_groups(df: DataFrame, group: str, ks: Sequence[int] = K_RANGE, n_trials: int = 1, seed: int = SEED, key: str = "row_id",
               features: str = "features", max_iter: int = 300) -> GroupFits:
    """Sweep K for every group of rows by itself, score all labelings, and find each group's components.

    State is kept by (group, trial, K), so that all groups share the scans and the number of jobs does not grow with
    them. ``curves`` has inertia, Davies-Bouldin, Calinski-Harabasz and the silhouette of squared distances, which is linear in
    the rows. A null group is a group; a K that a group has too few rows for has no rows in ``curves``. Centres of all
    models go to every task, and are refused beyond the limit of :func:`shoal.operators.quality.score`.
    """
    require_columns(df, [group, key, features])
    ks = sorted(set(int(k) for k in ks))
    if n_trials < 1 or not ks or ks[0] < 2:
        raise ValueError("need at least one trial and K from 2 upwards")
    seeds = [seed + t for t in range(n_trials)]
    source = df.select(col(group).alias("group"), col(key).alias("id"), col(features).cast("array<double>").alias("features"))
    fits = kmeans_groups(source, "group", ks, seeds, "id", "features", max_iter)
    names, parts = number_groups(source, "group")
    places = {n: p for p, n in enumerate(names)}
    models = [(s, k) for s in seeds for k in ks]
    centres = [{places[n]: fit.centres for (n, s, k), fit in fits.items() if (s, k) == m} for m in models]
    span = ks[-1]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0).to_numpy()
                given = _labels(part, matrix(batch.column(1)), centres)
                given = np.where(given < 0, -1, given + part[:, None].astype(np.int64) * span)
                yield pa.RecordBatch.from_arrays([batch.column(1), lists(given.astype(np.int32)), pa.array(np.ones(len(part)))], names=["features", "labels", "weight"])

    rows = materialise(parts.select("part", "features").mapInArrow(label, "features array<double>, labels array<int>, weight double"), "labelled")
    columns = [f"{s}_{k}" for s, k in models]
    clusters = quality._centres(rows, columns)
    spreads = quality._spreads(rows, columns, clusters)
    scored = quality.squared_scores(rows, columns, clusters, {n: spreads[n][1] for n in columns}, span)
    silhouettes = {(r["model"], r["cluster"] // span): r["s"] for r in scored.groupBy("model", F.floor(F.col("cluster") / span).alias("part")).agg(
        (F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).alias("s"), F.min("cluster").alias("cluster")).collect()}
    own, far, square = {}, {}, {}
    for (s, k), name in zip(models, columns):
        c = clusters[name]
        for p, n in enumerate(names):
            mine = c.labels // span == p
            if (n, s, k) in fits and 2 <= mine.sum() <= c.sizes[mine].sum() - 1:
                where = f"{p}|{name}"
                own[where] = quality.Clusters(c.labels[mine], c.sizes[mine], c.centres[mine])
                far[where], square[where] = spreads[name][0][mine], spreads[name][1][mine]
    worst = quality._davies_bouldin(df.sparkSession, own, far) if own else {}
    curves = [(n, s - seed + 1, k, "inertia", fit.inertia) for (n, s, k), fit in fits.items()]
    for where, c in own.items():
        p, name = where.split("|")
        s, k = models[columns.index(name)]
        for metric, value in (("silhouette_squared", silhouettes[name, int(p)]), ("davies_bouldin", worst[where]),
                              ("calinski_harabasz", quality._calinski_harabasz(c, square[where]))):
            curves.append((names[int(p)], s - seed + 1, k, metric, float(value)))
    kind = df.schema[group].dataType.simpleString()
    table = df.sparkSession.createDataFrame(curves, f"group {kind}, trial int, k int, metric string, value double")
    return GroupFits(table, pca_groups(source, "group", 3), fits, group)
