"""Micro-clusters of a table from one scan, by clustering features that merge.

A clustering feature is the size, mean and inertia of some rows; two of them add up to that of all
their rows. A task keeps a bounded list of features: a row joins the nearest one if it lies within a
radius, else it opens its own, and when the list is full the features that cost least are merged and
the radius grows. The lists of all tasks are merged the same way, some at a time, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.functions.arrays import CELLS, lists, matrix, nearest
from shoal.functions.columns import col, require_columns
from shoal.operators.kmeans import assign_nearest
from shoal.session import materialise

CHUNK_ROWS = 2048
TILE_ROWS = 512
#: Features a task keeps per micro-cluster asked for, and features that meet in one merge.
KEEP = 2
MERGE_ROWS = 16_000
_SCHEMA = "part bigint, n double, mean array<double>, inertia double, radius double"


class Features:
    """A bounded list of clustering features; distances are taken from ``origin``, so that small numbers keep their digits."""

    def __init__(self, size: int, origin: np.ndarray):
        self.keep = max(2, KEEP * size)
        self.origin = origin
        self.n, self.mean, self.inertia = np.zeros(0), np.zeros((0, len(origin))), np.zeros(0)
        self.radius = 0.0  #: squared

    def add_rows(self, x: np.ndarray) -> None:
        for start in range(0, len(x), CHUNK_ROWS):
            rows, weight = np.unique(x[start:start + CHUNK_ROWS], axis=0, return_counts=True)
            self._add(rows, weight.astype(float))

    def _add(self, rows: np.ndarray, weight: np.ndarray) -> None:
        fresh = np.ones(len(rows), bool)
        if len(self.n):
            means = self.mean - self.origin
            near = nearest(rows - self.origin, means)
            gap = rows - self.mean[near]
            square = np.einsum("ij,ij->i", gap, gap)
            fresh = square > self.radius
            self._join(near[~fresh], weight[~fresh], gap[~fresh], square[~fresh])
        self.append(weight[fresh], rows[fresh], np.zeros(int(fresh.sum())))
        if len(self.n) > 2 * self.keep:
            self.condense(self.keep)

    def _join(self, at: np.ndarray, weight: np.ndarray, gap: np.ndarray, square: np.ndarray) -> None:
        """Add rows, given by their differences from the means of the features they join."""
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        ids, first = np.unique(at[order], return_index=True)
        n = np.add.reduceat(weight[order], first)
        moved = np.add.reduceat(gap[order] * weight[order, None], first) / (self.n[ids] + n)[:, None]
        self.n[ids] += n
        self.mean[ids] += moved
        self.inertia[ids] += np.add.reduceat(weight[order] * square[order], first) - self.n[ids] * np.einsum("ij,ij->i", moved, moved)

    def append(self, n: np.ndarray, mean: np.ndarray, inertia: np.ndarray) -> None:
        self.n, self.inertia = np.concatenate((self.n, n)), np.concatenate((self.inertia, inertia))
        self.mean = np.concatenate((self.mean, mean))

    def condense(self, goal: int) -> None:
        """Merge features that are each other's cheapest partner, cheapest first, until ``goal`` are left.

        The cost is the inertia a merge adds; the radius becomes the largest distance that was merged.
        """
        while len(self.n) > goal:
            partner, cost = self._partners()
            at = np.arange(len(partner))
            left = np.flatnonzero((partner[partner] == at) & (at < partner))
            if not len(left):  # rounding told the two sides of the cheapest pair apart
                left = np.array([int(cost.argmin())])
            left = left[np.argsort(cost[left], kind="stable")][:len(self.n) - goal]
            right = partner[left]
            gap = self.mean[right] - self.mean[left]
            square = np.einsum("ij,ij->i", gap, gap)
            total = self.n[left] + self.n[right]
            self.inertia[left] += self.inertia[right] + square * self.n[left] * self.n[right] / total
            self.mean[left] += gap * (self.n[right] / total)[:, None]
            self.n[left] = total
            kept = np.ones(len(self.n), bool)
            kept[right] = False
            self.n, self.mean, self.inertia = self.n[kept], self.mean[kept], self.inertia[kept]
            self.radius = max(self.radius, float(square.max()))

    def _partners(self) -> tuple[np.ndarray, np.ndarray]:
        """The cheapest partner of every feature, the first of equals, and its cost; tile by tile."""
        means = self.mean - self.origin
        square = np.einsum("ij,ij->i", means, means)
        partner, cost = np.empty(len(self.n), np.int64), np.empty(len(self.n))
        height = max(1, min(TILE_ROWS, CELLS // max(1, len(self.n))))
        for a in range(0, len(self.n), height):
            tile = slice(a, a + height)
            d = square[tile, None] + square[None, :] - 2.0 * (means[tile] @ means.T)
            np.maximum(d, 0.0, out=d)
            d *= self.n[tile, None] * self.n[None, :] / (self.n[tile, None] + self.n[None, :])
            rows = np.arange(len(d))
            d[rows, a + rows] = np.inf
            partner[tile] = d.argmin(1)
            cost[tile] = d[rows, partner[tile]]
        return partner, cost

    def batch(self, part: int) -> pa.RecordBatch:
        n = len(self.n)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part), pa.int64()), pa.array(self.n), lists(self.mean), pa.array(self.inertia),
             pa.array(np.full(n, self.radius))], names=["part", "n", "mean", "inertia", "radius"])


@dataclass(frozen=True)
class MicroClusters:
    """Sizes, means and inertias of the parts of a table, by the means in lexicographic order."""

    sizes: np.ndarray
    centres: np.ndarray
    inertias: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """``(micro, weight, features, inertia)``; at most as many rows as micro-clusters were asked for."""
        rows = [(i, float(n), [float(v) for v in c], float(s)) for i, (n, c, s) in enumerate(zip(self.sizes, self.centres, self.inertias))]
        return spark.createDataFrame(rows, "micro int, weight double, features array<double>, inertia double")

    def assign(self, df: DataFrame, label: str = "micro", features: str = "features") -> DataFrame:
        """Add the number of the nearest mean to every row; nothing is moved."""
        return assign_nearest(df, [self.centres], [label], features)


def micro_clusters(df: DataFrame, size: int, features: str = "features") -> MicroClusters:
    """At most ``size`` parts of the table, every row in one of them, from one scan.

    Sizes and means are those of the rows themselves, and inertias add up exactly: inside the parts and
    between their means to that of the table. With no more than ``size`` distinct rows each is a part of its
    own. Which rows share a part depends on the order in which tasks meet them, as the radius grows on the way.
    Memory per task: a few times ``size`` features and one chunk of rows; per merge: ``MERGE_ROWS`` features, or two lists.
    """
    require_columns(df, [features])
    if size < 1:
        raise ValueError(f"{size} micro-clusters")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                held = held or Features(size, x[:CHUNK_ROWS].mean(0))
                held.add_rows(x)
        if held:
            yield held.batch(TaskContext.get().partitionId())

    def merging(goal: int):
        def merge(table: pa.Table) -> pa.Table:
            n, mean = table.column("n").to_numpy(), matrix(table.column("mean"))
            held = Features(size, mean.mean(0))
            held.radius = float(table.column("radius").to_numpy().max())
            mean, same = np.unique(mean, axis=0, return_inverse=True)  # equal means of several tasks are one
            held.append(np.bincount(same.ravel(), n), mean, np.bincount(same.ravel(), table.column("inertia").to_numpy()))
            held.condense(goal)
            return pa.Table.from_batches([held.batch(table.column("part")[0].as_py())])
        return merge

    found = materialise(df.select(col(features).cast("array<double>")).mapInArrow(scan, _SCHEMA), "features")
    last = found.agg(F.max("part")).first()[0]
    if last is None:
        raise ValueError("no rows to cluster")
    fan_in = max(2, MERGE_ROWS // (2 * KEEP * size))
    levels = 1
    while fan_in ** levels < last + 1:
        levels += 1
    for level in range(1, levels + 1):
        goal = size if level == levels else max(2, KEEP * size)
        part = F.lit(0).cast("long") if level == levels else F.floor(F.col("part") / fan_in)
        found = found.withColumn("part", part).groupBy("part").applyInArrow(merging(goal), _SCHEMA)
    rows = sorted(found.collect(), key=lambda r: list(r["mean"]))  # at most ``size``
    return MicroClusters(np.array([r["n"] for r in rows]), np.array([r["mean"] for r in rows]), np.array([r["inertia"] for r in rows]))


def compress(df: DataFrame, size: int, features: str = "features") -> DataFrame:
    """Add ``micro``, the number of the row's micro-cluster out of at most ``size``: that of the nearest mean."""
    return micro_clusters(df, size, features).assign(df, "micro", features)
