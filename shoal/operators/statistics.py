"""Column statistics, Pearson correlation and cluster profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import as_double, col, numeric_columns, require_columns

# Up to this many rows a single exact-median aggregate holds a column's values in one task.
MEDIAN_ROWS = 1_000_000
_SKETCH = 10_000


@dataclass(frozen=True)
class ColumnStats:
    """Moments of one numeric column over all rows of a table."""

    rows: int
    count: int
    mean: float | None
    var_samp: float | None
    minimum: float | None
    maximum: float | None

    def after_fill(self, fill: float | None) -> "ColumnStats":
        """The same moments once every missing cell holds ``fill`` (closed form, no rescan)."""
        gaps = self.rows - self.count
        if gaps == 0 or fill is None:
            return self
        if self.count == 0:
            return ColumnStats(self.rows, self.rows, fill, 0.0 if self.rows > 1 else None, fill, fill)
        mean = (self.count * self.mean + gaps * fill) / self.rows
        squares = ((self.var_samp or 0.0) * (self.count - 1)
                   + self.count * (self.mean - mean) ** 2 + gaps * (fill - mean) ** 2)
        return ColumnStats(self.rows, self.rows, mean, squares / (self.rows - 1),
                           min(self.minimum, fill), max(self.maximum, fill))

    @property
    def std_samp(self) -> float:
        return math.sqrt(self.var_samp) if self.var_samp is not None else math.nan

    @property
    def std_pop(self) -> float:
        if self.var_samp is None:
            return 0.0
        return math.sqrt(self.var_samp * (self.count - 1) / self.count)


def column_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, ColumnStats]:
    """Moments of every column in one aggregate: a partial per task, one small shuffle."""
    if not cols:
        return {}
    return _read_moments(df.agg(*_moments(df, cols)).first(), cols)


def _moments(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    wanted: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(cols):
        x = as_double(df, name)
        wanted += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_samp(x).alias(f"v{i}"),
                   F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    return wanted


def _read_moments(row: Row, cols: Sequence[str]) -> dict[str, ColumnStats]:
    return {name: ColumnStats(row["rows"], row[f"n{i}"], row[f"m{i}"], row[f"v{i}"],
                              row[f"lo{i}"], row[f"hi{i}"])
            for i, name in enumerate(cols)}


def exact_medians(df: DataFrame, counts: dict[str, int],
                  small: int = MEDIAN_ROWS) -> dict[str, float | None]:
    """Exact median per column (the mean of the two middle values for an even count).

    ``counts`` holds the non-missing cells per column. Small columns take one built-in
    median. For larger ones a mergeable quantile sketch brackets each middle rank, one scan
    counts the rows below, at and between the bracket's ends, and the next sketch looks only
    between them. That leaves about a thousandth of the rows per round, for all columns at
    once, and no task ever holds a column.
    """
    found: dict[str, float | None] = {n: None for n, c in counts.items() if c == 0}
    whole = [n for n, c in counts.items() if 0 < c <= small]
    if whole:
        row = df.agg(*[F.median(as_double(df, n)).alias(f"m{i}") for i, n in enumerate(whole)]).first()
        found.update({n: row[f"m{i}"] for i, n in enumerate(whole)})
    # per (column, rank): open interval still holding the rank, rows below it, rows inside it
    search = {(n, r): (None, None, 0, c) for n, c in counts.items() if n not in found
              for r in {(c - 1) // 2, c // 2}}
    values: dict[tuple[str, int], float] = {}
    while search:
        items = list(search.items())
        wanted = []
        for i, ((n, rank), (lo, hi, below, size)) in enumerate(items):
            share = (rank - below + 0.5) / size
            if size <= small:
                position = (rank - below) / (size - 1) if size > 1 else 0.0
                wanted.append(F.percentile(_between(df, n, lo, hi), F.lit(position)).alias(f"q{i}"))
            else:
                ends = [max(0.0, share - 2 / _SKETCH), min(1.0, share + 2 / _SKETCH)]
                wanted.append(F.percentile_approx(_between(df, n, lo, hi), ends, _SKETCH).alias(f"q{i}"))
        row = df.agg(*wanted).first()
        brackets = {}
        for i, (item, (_, _, _, size)) in enumerate(items):
            if size <= small:
                values[item] = row[f"q{i}"]
                del search[item]
            else:
                brackets[item] = row[f"q{i}"]
        if not brackets:
            break
        wanted = []
        for i, ((n, _), (lo, hi)) in enumerate(brackets.items()):
            x = as_double(df, n)
            wanted += [F.count_if(x < lo).alias(f"b{i}"), F.count_if(x == lo).alias(f"l{i}"),
                       F.count_if((x > lo) & (x < hi)).alias(f"s{i}"), F.count_if(x == hi).alias(f"h{i}")]
        row = df.agg(*wanted).first()
        for i, ((n, rank), (lo, hi)) in enumerate(brackets.items()):
            below, at_lo, size, at_hi = (row[f"{p}{i}"] for p in "blsh")
            if below <= rank < below + at_lo:
                values[n, rank] = lo
                del search[n, rank]
            elif below + at_lo <= rank < below + at_lo + size:
                search[n, rank] = (lo, hi, below + at_lo, size)
            elif below + at_lo + size <= rank < below + at_lo + size + at_hi:
                values[n, rank] = hi
                del search[n, rank]
            else:
                raise RuntimeError(f"quantile sketch missed rank {rank} of {n!r}")
    for n, c in counts.items():
        if n not in found:
            found[n] = (values[n, (c - 1) // 2] + values[n, c // 2]) / 2
    return found


def _between(df: DataFrame, name: str, lo: float | None, hi: float | None) -> Column:
    x = as_double(df, name)
    return x if lo is None else F.when((x > lo) & (x < hi), x)


# -- correlation ----------------------------------------------------------------------

def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of every ordered column pair over the rows where both cells are present.

    Returns ``(col_a, col_b, r)``; r is NULL for fewer than two shared rows or a side that is
    constant over them. One formula for any width: tasks reduce their rows to count, means,
    squares, product and range of each pair about the means of the rows that pair shares, and
    these parts are merged about the common mean, so no large cell elsewhere costs digits.
    """
    names = require_columns(df, cols) if cols is not None else numeric_columns(df)
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "col_a string, col_b string, r double")
    data = df.select(*[as_double(df, n).alias(f"x{i}") for i, n in enumerate(names)])
    found = _merged_r(_pair_moments(data))
    both = found.union(found.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    width, named = len(names), F.array(*[F.lit(n) for n in names])
    grid = spark.range(width * width).select(F.expr(f"CAST(id DIV {width} AS INT)").alias("i"),
                                             F.expr(f"CAST(id % {width} AS INT)").alias("j"))
    return grid.join(both, ["i", "j"], "left").select(
        F.get(named, F.col("i")).alias("col_a"), F.get(named, F.col("j")).alias("col_b"), "r")


_MOMENTS = ("n", "mean", "square", "product", "lo", "hi")


def _batch_moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Matrices over column pairs: of the first column over the rows the pair shares, and the shared product."""
    seen = ~np.isnan(x)
    width = x.shape[1]
    out = {name: np.zeros((width, width)) for name in _MOMENTS}
    out["n"] = seen.T.astype(float) @ seen
    full = np.flatnonzero(seen.all(0))
    if len(full):  # these pairs share all rows: one matrix product
        means, z = x[:, full].mean(0), x[:, full] - x[:, full].mean(0)
        at = np.ix_(full, full)
        out["product"][at] = z.T @ z
        out["mean"][at], out["square"][at] = means[:, None], (z * z).sum(0)[:, None]
        out["lo"][at], out["hi"][at] = x[:, full].min(0)[:, None], x[:, full].max(0)[:, None]
    for g in np.flatnonzero(~seen.all(0)):
        rows, there = x[seen[:, g]], seen[seen[:, g]]
        n = np.maximum(there.sum(0), 1)
        for own, other in ((np.broadcast_to(rows[:, g:g + 1], rows.shape), False), (rows, True)):
            at = (slice(None), g) if other else (g, slice(None))
            mean = np.where(there, own, 0.0).sum(0) / n
            gap = np.where(there, own - mean, 0.0)
            out["mean"][at], out["square"][at] = mean, (gap * gap).sum(0)
            out["lo"][at] = np.where(there, own, np.inf).min(0, initial=np.inf)
            out["hi"][at] = np.where(there, own, -np.inf).max(0, initial=-np.inf)
            if other:
                out["product"][:, g] = out["product"][g, :] = (first * gap).sum(0)
            else:
                first = gap
    return out


def _merge_moments(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n = a["n"] + b["n"]
    step = np.where(b["n"] > 0, np.where(a["n"] > 0, b["mean"] - a["mean"], 0.0), 0.0)
    weight = np.divide(a["n"] * b["n"], n, out=np.zeros_like(n), where=n > 0)
    mean = np.where(a["n"] > 0, a["mean"] + step * np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0), b["mean"])
    empty_a, empty_b = a["n"] == 0, b["n"] == 0
    return {"n": n, "mean": mean, "square": a["square"] + b["square"] + step * step * weight,
            "product": a["product"] + b["product"] + step * step.T * weight,
            "lo": np.minimum(np.where(empty_a, np.inf, a["lo"]), np.where(empty_b, np.inf, b["lo"])),
            "hi": np.maximum(np.where(empty_a, -np.inf, a["hi"]), np.where(empty_b, -np.inf, b["hi"]))}


def _pair_moments(data: DataFrame) -> DataFrame:
    """Per task and column pair (i <= j): shared rows, and means, squares, product and ranges over them."""
    width = len(data.columns)
    ii, jj = np.triu_indices(width)
    names = ["i", "j", "n", "mean_i", "mean_j", "square_i", "square_j", "product", "lo_i", "hi_i", "lo_j", "hi_j"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _batch_moments(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float))
                total = part if total is None else _merge_moments(total, part)
        if total is not None:
            values = [total["n"][ii, jj], total["mean"][ii, jj], total["mean"][jj, ii], total["square"][ii, jj],
                      total["square"][jj, ii], total["product"][ii, jj], total["lo"][ii, jj], total["hi"][ii, jj],
                      total["lo"][jj, ii], total["hi"][jj, ii]]
            yield pa.RecordBatch.from_arrays([pa.array(ii, pa.int32()), pa.array(jj, pa.int32())] + [pa.array(v) for v in values], names)

    return data.mapInArrow(partial, "i int, j int, " + ", ".join(f"{n} double" for n in names[2:]))


def _merged_r(parts: DataFrame) -> DataFrame:
    """(i, j, r) from the tasks' parts, merged about the mean of all shared rows of each pair."""
    pair = Window.partitionBy("i", "j")  # one row per task
    n = F.sum("n").over(pair)
    centred = parts.where("n > 0").select(
        "*", (F.sum(F.col("n") * F.col("mean_i")).over(pair) / n).alias("all_i"),
        (F.sum(F.col("n") * F.col("mean_j")).over(pair) / n).alias("all_j"))
    di, dj = F.col("mean_i") - F.col("all_i"), F.col("mean_j") - F.col("all_j")
    sums = centred.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("square_i") + F.col("n") * di * di).alias("sii"),
        F.sum(F.col("square_j") + F.col("n") * dj * dj).alias("sjj"), F.sum(F.col("product") + F.col("n") * di * dj).alias("sij"),
        (F.min("lo_i") < F.max("hi_i")).alias("varies_i"), (F.min("lo_j") < F.max("hi_j")).alias("varies_j"))
    r = F.try_divide(F.col("sij"), F.sqrt("sii") * F.sqrt("sjj"))
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return sums.select("i", "j", F.when((F.col("n") > 1) & F.col("varies_i") & F.col("varies_j"), r).alias("r"))


# -- profiles ------------------------------------------------------------------------

def cluster_profile(profile: DataFrame, labels: DataFrame | None = None, key: str = "row_id",
                    label: str = "label", digits: int = 2, drop: Sequence[str] = ("Cluster",),
                    unlabelled: str = "error") -> DataFrame:
    """Mean of every numeric column per cluster, rounded half-even, ordered by cluster.

    With ``labels`` the two tables are joined on ``key``; without it ``profile`` carries the
    ``label`` column itself and no join is needed. Only the columns named in ``drop`` are left
    out, and the key of a join. A key with two labels is an error, and so is a row without
    label unless ``unlabelled`` is "skip".
    """
    if unlabelled not in ("error", "skip"):
        raise ValueError(f"unlabelled is 'error' or 'skip', not {unlabelled!r}")
    left_out = [label, *drop]
    if labels is not None:
        found = labels.groupBy(col(key).alias("__key")).agg(F.min(col(label)).alias("__label"), F.count(F.lit(1)).alias("__n"))
        joined = profile.join(found, col(key) == F.col("__key"), "left" if unlabelled == "error" else "inner")
        problem = F.when(F.col("__n") > 1, F.concat(F.lit("more than one label for key "), F.col("__key").cast("string"))).when(
            F.col("__n").isNull(), F.concat(F.lit("no label for key "), F.coalesce(col(key).cast("string"), F.lit("NULL"))))
        own = F.when(problem.isNull(), F.col("__label")).otherwise(F.raise_error(problem).cast("int"))
        profile = joined.withColumn("__own", own).drop(label, "__key", "__label", "__n").withColumnRenamed("__own", label)
        left_out.append(key)
    names = numeric_columns(profile, exclude=[n for n in profile.columns if n in left_out])
    means = [F.bround(F.avg(as_double(profile, n)), digits).alias(n if n != "cluster" else "__cluster") for n in names]
    grouped = profile.groupBy(col(label).cast("int").alias("__by"))
    table = grouped.agg(*means) if means else grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    return table.orderBy("__by").select(F.col("__by").alias("cluster"), *[
        F.col("__cluster").alias("cluster_mean") if n == "cluster" else col(n) for n in names])
