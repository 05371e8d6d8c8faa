"""K-Means: fits, Lloyd steps from given centres, and weighted points that stand for rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.arrays import distances, lists, matrix, nearest
from shoal.functions.columns import col, require_columns
from shoal.session import spread

#: Candidates compared for each centre of a start, whatever the number of clusters.
CANDIDATES = 4


@dataclass(frozen=True)
class KMeansFit:
    """Centres in lexicographic order, and the sum of squared distances to them."""

    centres: np.ndarray
    inertia: float

    def assign(self, df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
        """Add the number of the nearest centre to every row; nothing is moved."""
        return assign_nearest(df, [self.centres], [label], features)


def kmeans(df: DataFrame, k: int, seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
           features: str = "features") -> KMeansFit:
    """Fit ``k`` clusters of Euclidean distance, for a table without a key.

    Equal rows are merged into one with a weight first, so a value that a third of the rows hold costs
    one point; their values take the place of the key. Apart from that it is :func:`kmeans_many`.
    """
    points = (df.select(col(features).cast("array<double>").alias("features")).groupBy("features")
              .agg(F.count(F.lit(1)).cast("double").alias("weight")))
    points = points.select(F.lit(0).alias("part"), F.xxhash64("features").alias("id"), "features", "weight")
    fits = _fits(points, [k], [seed], max_iter, tol)
    if (0, seed, k) not in fits:
        raise ValueError(f"k = {k} clusters for fewer rows")
    return fits[0, seed, k]


# -- many fits at once ----------------------------------------------------------------------

def kmeans_many(df: DataFrame, ks: Sequence[int], seeds: Sequence[int], key: str = "row_id",
                features: str = "features", max_iter: int = 300,
                tol: float = 1e-4) -> dict[tuple[int, int], KMeansFit]:
    """Fit every ``k`` with every seed; the result is keyed by ``(seed, k)``.

    All fits share each scan of the table: a pass assigns the rows under every model still
    moving and returns one sum per task and cluster. A sweep of 9 values of K and 10 seeds
    then costs as many scans as its slowest fit, not the sum over 90 fits. Starts are greedy
    k-means++, one pass per centre for all seeds; the draws hash the row key, so they depend
    neither on how the table is partitioned nor on which other K are fitted. A fit stops when the
    squared movement of all centres falls below ``tol`` times the mean variance of the features.
    """
    rows = df.select(F.lit(0).alias("part"), col(key).cast("long").alias("id"), col(features).cast("array<double>").alias("features"), F.lit(1.0).alias("weight"))
    fits = _fits(rows, ks, seeds, max_iter, tol)
    if len(fits) < len(set(ks)) * len(set(seeds)) or not fits:
        raise ValueError(f"K from {sorted(set(ks))} for fewer rows")
    return {(seed, k): fit for (_, seed, k), fit in fits.items()}


def kmeans_groups(df: DataFrame, group: str, ks: Sequence[int], seeds: Sequence[int], key: str = "row_id", features: str = "features",
                  max_iter: int = 300, tol: float = 1e-4) -> dict[tuple[object, int, int], KMeansFit]:
    """The fits of :func:`kmeans_many` for every group of rows by itself, keyed by ``(group, seed, k)``.

    All groups share every scan: three groups take as many jobs as thirty. A K above the number of rows of a group has
    no fit. The centres of all models go to every task: as many values as groups x seeds x sum of K x features.
    """
    require_columns(df, [group, key, features])
    rows = df.select(col(group).alias("group"), col(key).cast("long").alias("id"), col(features).cast("array<double>").alias("features"))
    names, parts = number_groups(rows, "group")
    fits = _fits(parts.select("part", "id", "features", F.lit(1.0).alias("weight")), ks, seeds, max_iter, tol)
    return {(names[part], seed, k): fit for (part, seed, k), fit in fits.items()}


def number_groups(df: DataFrame, group: str) -> tuple[list, DataFrame]:
    """The groups in order, and ``df`` with ``part``, the place of the row's group among them; null is a group, the first."""
    names = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]  # one per dataset
    places = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], f"part int, `__name` {df.schema[group].dataType.simpleString()}")
    return names, df.join(F.broadcast(places), col(group).eqNullSafe(F.col("__name"))).drop("__name")


def _fits(rows: DataFrame, ks: Sequence[int], seeds: Sequence[int], max_iter: int, tol: float) -> dict[tuple[int, int, int], KMeansFit]:
    """Fits by (part, seed, k) of rows (part, id, features, weight), for every K that the part has rows for."""
    ks, seeds = sorted(set(ks)), list(dict.fromkeys(seeds))
    if not ks or ks[0] < 1 or not seeds:
        raise ValueError(f"K from {ks}")
    moments = Summarizer.metrics("mean", "variance").summary(array_to_vector("features"), F.col("weight")).alias("s")
    stats = rows.groupBy("part").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("rows"), moments).collect()  # one row per part
    middles = {r["part"]: r["s"]["mean"].toArray() for r in stats}
    limits = {r["part"]: tol * float(r["s"]["variance"].toArray().mean()) for r in stats}
    wanted = {r["part"]: [k for k in ks if k <= r["n"]] for r in stats}
    data = _packed(spread(rows, sum(r["rows"] for r in stats)), middles).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        starts = _starts(data, max((w[-1] for w in wanted.values() if w), default=0), seeds, middles)
        centres = {(p, seed, k): starts[p, seed][:k] for p in sorted(wanted) for seed in seeds for k in wanted[p]}
        moving = list(centres)
        for _ in range(max_iter):
            if not moving:
                break
            sums = _cluster_sums(data, {m: centres[m] for m in moving})
            still = []
            for m in moving:
                size, total, _ = sums[m]
                new = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], centres[m])
                if ((new - centres[m]) ** 2).sum() > limits[m[0]]:
                    still.append(m)
                centres[m] = new
            moving = still
        costs = _cluster_sums(data, centres) if centres else {}
        return {m: KMeansFit(np.array(sorted(tuple(c) for c in x + middles[m[0]])), costs[m][2]) for m, x in centres.items()}
    finally:
        data.unpersist()


def _uniform(ids: np.ndarray, seed: int, step: int, draw: int) -> np.ndarray:
    """A number in (0, 1) per row and draw, from mixing the bits of the key (splitmix64)."""
    salt = ((seed * 1_000_003 + step) * 1_000_003 + draw) * 0x9E3779B97F4A7C15 % 2 ** 64
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64(salt)
        for _ in range(2):
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def _packed(rows: DataFrame, middles: dict[int, np.ndarray]) -> DataFrame:
    """The rows of each part in each batch as one row of bytes (keys, features less the part's mean, weights): every pass reads
    them again, and bytes cross to a task as they are, where numbers in lists are taken one by one."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, ids, x, w = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2)), batch.column(3).to_numpy()
            for p in np.unique(part).tolist():
                mine = part == p
                columns = (ids, x - middles[p], w) if mine.all() else (ids[mine], x[mine] - middles[p], w[mine])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
                                                 names=["part", "ids", "x", "weights"])
    return rows.select(F.col("part").cast("int").alias("part"), "id", "features", "weight").mapInArrow(pack, "part int, ids binary, x binary, weights binary")


def _by_part(batches: Iterator[pa.RecordBatch]):
    """(part, ids, features less the part's mean, weights) of packed rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, x, w = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((1, np.int64), (2, np.float64), (3, np.float64)))
            yield batch.column(0)[i].as_py(), ids, x.reshape(len(ids), -1), w


def _starts(data: DataFrame, k: int, seeds: list[int], middles: dict[int, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Greedy k-means++ by (part, seed): of a few candidates drawn in proportion to the squared distance, keep
    the one that lowers the total most. The candidates after each possible choice are drawn in
    the pass that compares them, so that a centre costs one pass."""
    draws = CANDIDATES
    chosen = {(p, s): np.empty((0, len(middle))) for p, middle in middles.items() for s in seeds}
    offered: dict[tuple[int, int], np.ndarray] = {}
    for step in range(k + 1):  # a pass compares what the one before drew, the last centre's too
        before, options = dict(chosen), dict(offered)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int, int, int], tuple[float, np.ndarray]] = {}
            total: dict[tuple[int, int, int], float] = {}
            for p, ids, x, w in _by_part(batches):
                for s in seeds:
                    near = distances(x, before[p, s]).min(1) ** 2 if len(before[p, s]) else None
                    drawn = [-np.log(_uniform(ids, s, step, draw)) / w for draw in range(draws if step else 1)]
                    for j, option in enumerate(options[p, s] if step else [None]):
                        d = None
                        if option is not None:
                            d = ((x - option) ** 2).sum(1)
                            d = d if near is None else np.minimum(d, near)
                            total[p, s, j] = total.get((p, s, j), 0.0) + float((w * d).sum())
                        for draw, u in enumerate(drawn):
                            if d is not None:
                                u = np.divide(u, d, out=np.full(len(u), np.inf), where=d > 0)
                            i = int(np.argmin(u))
                            if (p, s, j, draw) not in best or u[i] < best[p, s, j, draw][0]:
                                best[p, s, j, draw] = (float(u[i]), x[i])
            if best:
                keys = list(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[i] for c in keys], pa.int64()) for i in range(4)]
                    + [pa.array([best[c][0] for c in keys], pa.float64()),
                       pa.array([total.get(c[:3], 0.0) for c in keys], pa.float64()),
                       lists(np.array([best[c][1] for c in keys]))],
                    names=["part", "seed", "option", "draw", "rank", "total", "point"])

        found = (data.mapInArrow(partial, "part bigint, seed bigint, option bigint, draw bigint, rank double, "
                                          "total double, point array<double>")
                 .groupBy("part", "seed", "option", "draw")
                 .agg(F.min("rank").alias("rank"), F.sum("total").alias("total"),
                      F.min_by("point", "rank").alias("point")).collect())
        rows: dict[tuple[int, int], list] = {m: [] for m in chosen}
        for r in sorted(found, key=lambda r: (r["option"], r["draw"])):
            rows[r["part"], r["seed"]].append(r)
        for m, mine in rows.items():
            if step:
                pick = min(mine, key=lambda r: (r["total"], r["option"]))["option"]
                chosen[m] = np.vstack([chosen[m], options[m][pick]])
                mine = [r for r in mine if r["option"] == pick and np.isfinite(r["rank"])]
            # no finite draw: every row already is a centre
            offered[m] = np.array([r["point"] for r in mine]) if mine else chosen[m][-1:]
    return {m: _distinct(c) for m, c in chosen.items()}


def _distinct(centres: np.ndarray) -> np.ndarray:
    _, first = np.unique(centres, axis=0, return_index=True)
    return centres[np.sort(first)]


def _cluster_sums(data: DataFrame, models: dict[tuple[int, int, int], np.ndarray]) -> dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, float]]:
    """Size and sum of every cluster, and the cost, of every model by (part, ...), from one scan."""
    names = sorted(models)  # the models of a part follow each other
    ends = np.cumsum([len(models[m]) for m in names])
    spans = {m: (int(e) - len(models[m]), int(e)) for m, e in zip(names, ends)}
    stacked = np.vstack([models[m] for m in names])
    half = np.einsum("ij,ij->i", stacked, stacked) / 2
    mine = {p: [spans[m] for m in names if m[0] == p] for p in {m[0] for m in names}}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total, cost = np.zeros(len(stacked)), np.zeros_like(stacked), np.zeros(len(stacked))
        for p, _, x, w in _by_part(batches):
            if p not in mine:
                continue
            first, last = mine[p][0][0], mine[p][-1][1]
            score = half[None, first:last] - x @ stacked[first:last].T
            hot = np.zeros_like(score)
            at = np.arange(len(x))
            for a, b in mine[p]:
                label = score[:, a - first:b - first].argmin(1)
                hot[at, a - first + label] = w
                gap = x - stacked[a + label]
                cost[a] += float(w @ np.einsum("ij,ij->i", gap, gap))
            size[first:last] += hot.sum(0)
            total[first:last] += hot.T @ x
        met = np.flatnonzero((size > 0) | (cost > 0))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(size[met]), lists(total[met]), pa.array(cost[met])],
                                         names=["cluster", "n", "total", "cost"])

    total = Summarizer.metrics("sum").summary(array_to_vector("total"))
    found = (data.mapInArrow(partial, "cluster int, n double, total array<double>, cost double")
             .groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"),
                                     vector_to_array(total["sum"]).alias("total")).collect())
    sizes, sums, costs = np.zeros(len(stacked)), np.zeros_like(stacked), np.zeros(len(stacked))
    for r in found:
        sizes[r["cluster"]], sums[r["cluster"]], costs[r["cluster"]] = r["n"], r["total"], r["cost"]
    return {m: (sizes[a:b], sums[a:b], float(costs[a:b].sum())) for m, (a, b) in spans.items()}


# -- given centres ------------------------------------------------------------------------------

def lloyd(df: DataFrame, centres: Sequence[Sequence[float]], steps: int,
          features: str = "features") -> np.ndarray:
    """Centres after ``steps`` rounds of assign-and-average; an empty cluster stays put.

    Each round is one scan: tasks reduce their rows to a sum per cluster.
    """
    current = np.array(centres, dtype=float)
    data = df.select(col(features).cast("array<double>").alias("features"))
    for _ in range(steps):
        here = current

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(here)), np.zeros_like(here)
            for batch in batches:
                x = matrix(batch.column(0))
                if len(x):
                    label = nearest(x, here)
                    n += np.bincount(label, minlength=len(here))
                    for c in np.unique(label):
                        total[c] += x[label == c].sum(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(here)), pa.int32()), pa.array(n), lists(total)],
                names=["cluster", "n", "total"])

        total = Summarizer.metrics("sum").summary(array_to_vector("total"))
        sums = (data.mapInArrow(partial, "cluster int, n double, total array<double>").groupBy("cluster")
                .agg(F.sum("n").alias("n"), vector_to_array(total["sum"]).alias("total")).collect())
        current = here.copy()
        for r in sums:
            if r["n"] > 0:
                current[r["cluster"]] = np.array(r["total"]) / r["n"]
    return current


def assign_nearest(df: DataFrame, models: Sequence[np.ndarray], labels: Sequence[str],
                   features: str = "features") -> DataFrame:
    """Add a label column per model: the index of the nearest of its centres, in one pass."""
    models = [np.asarray(m) for m in models]

    @F.arrow_udf("array<int>")
    def closest(x: pa.Array) -> pa.Array:
        points = matrix(x)
        if not len(points):
            return pa.array([], pa.list_(pa.int32()))
        return lists(np.column_stack([nearest(points, m) for m in models]).astype(np.int32))

    columns = df.columns
    found = df.withColumn("__labels", closest(col(features).cast("array<double>")))
    return found.select(*[col(c) for c in columns],
                        *[F.col("__labels")[i].alias(name) for i, name in enumerate(labels)])


def summarise(rows: DataFrame, by: Sequence[str] = (), features: str = "features") -> DataFrame:
    """Weighted points that stand for the rows: mean vector and weight per ``micro`` and ``by``.

    Every row is counted; partial sums are taken before the shuffle.
    """
    mean = Summarizer.metrics("mean").summary(array_to_vector(col(features)))
    return (rows.groupBy("micro", *[col(b) for b in by])
            .agg(vector_to_array(mean["mean"]).alias("features"),
                 F.count(F.lit(1)).cast("double").alias("weight")))
