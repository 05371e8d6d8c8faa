"""Outlier filter, missing values, label codes and scaling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.columns import (as_double, categorical_columns, col, numeric_columns,
                                     require_columns)
from shoal.operators.statistics import MEDIAN_ROWS, ColumnStats, column_stats, exact_medians
from shoal.session import materialise

IMPUTERS = ("mean", "median", "drop")
SCALERS = ("standard", "minmax")
#: Fixed value: what fills a text column without any value.
MISSING = "Missing"

# A vocabulary within both bounds is small enough to send to every executor.
BROADCAST_VALUES = 200_000
BROADCAST_BYTES = 32 << 20
# A vocabulary up to this size is numbered by one window per column.
WINDOW_VALUES = 1_000_000
# A value holding more than 1/HOT_SHARE of the rows is joined apart: at most HOT_SHARE of them.
HOT_SHARE = 1_000
HOT_BYTES = 8 << 10


# -- outliers ------------------------------------------------------------------------

def zscore_condition(df: DataFrame, stats: Mapping[str, ColumnStats], threshold: float = 3.0) -> Column:
    """Predicate that keeps the rows whose every numeric cell lies within ``threshold`` sigmas.

    Mean and deviation are those of the column after its gaps are filled with the mean, so a
    missing cell always passes; a column without a positive finite deviation is ignored.
    """
    keep = F.lit(True)
    for name, s in stats.items():
        filled = s.after_fill(s.mean)
        std = filled.std_samp
        if not (std > 0 and math.isfinite(std)) or s.minimum == s.maximum and s.count == s.rows:
            continue
        x = as_double(df, name)
        keep = keep & F.coalesce(F.abs((x - F.lit(filled.mean)) / F.lit(std)) < threshold, F.lit(True))
    return keep


def zscore_filter(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Drop outlier rows. All columns are judged on the unfiltered table: one aggregate, one filter."""
    names = require_columns(df, cols) if cols is not None else numeric_columns(df)
    return df.filter(zscore_condition(df, column_stats(df, names), threshold))


# -- missing values ---------------------------------------------------------------------

def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep the rows without any missing cell (NaN counts as missing)."""
    keep = F.lit(True)
    numeric = set(numeric_columns(df))
    for name in require_columns(df, cols) if cols is not None else df.columns:
        keep = keep & (as_double(df, name) if name in numeric else col(name)).isNotNull()
    return df.filter(keep)


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per ``(column, value)`` as text, for all columns in one scan and one shuffle.

    Counts are combined in each task first, so a value held by a third of the rows costs no
    more than any other.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("value"))
                      for n in cols])
    return (df.select(F.explode(cells).alias("cell")).select("cell.*")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def modes(counts: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties; ``Missing`` where there is none."""
    best = (counts.filter(F.col("value").isNotNull()).groupBy("column")
            .agg(F.min(F.struct((-F.col("n")).alias("rank"), F.col("value"))).alias("best"))
            .select("column", "best.value"))
    found = {r["column"]: r["value"] for r in best.collect()}
    return {n: found.get(n, MISSING) for n in cols}


def numeric_fills(df: DataFrame, stats: Mapping[str, ColumnStats], method: str,
                  median_rows: int = MEDIAN_ROWS) -> dict[str, float | None]:
    """Fill value of each numeric column that has a missing cell."""
    gaps = {n: s for n, s in stats.items() if s.count < s.rows}
    if method == "mean":
        return {n: s.mean for n, s in gaps.items()}
    return exact_medians(df, {n: s.count for n, s in gaps.items()}, median_rows)


def fill_expression(df: DataFrame, name: str, fills: Mapping[str, object], numeric: bool) -> Column:
    """Column ``name`` with its gaps filled; columns without a fill keep their type."""
    if fills.get(name) is None:
        return col(name)
    if numeric:
        return F.coalesce(as_double(df, name), F.lit(float(fills[name])))
    return F.coalesce(col(name).cast("string"), F.lit(fills[name]))


def impute(df: DataFrame, method: str = "mean", cols: Sequence[str] | None = None,
           median_rows: int = MEDIAN_ROWS) -> DataFrame:
    """Fill numeric gaps with the column's mean or exact median and the others with the mode.

    A numeric column without any value stays empty; any other one becomes ``Missing``. Beyond
    ``median_rows`` values the median is narrowed down instead of sorted out; it is the same one.
    """
    if method not in ("mean", "median"):
        raise ValueError(f"impute method must be 'mean' or 'median', not {method!r}")
    names = require_columns(df, cols) if cols is not None else df.columns
    numeric = [n for n in numeric_columns(df) if n in names]
    other = [n for n in categorical_columns(df.select(*[col(n) for n in names]))]
    fills: dict[str, object] = dict(numeric_fills(df, column_stats(df, numeric), method, median_rows))
    if other:
        fills.update(modes(value_counts(df, other), other))
    return df.select(*[fill_expression(df, n, fills, n in numeric).alias(n) for n in df.columns])


# -- label codes -----------------------------------------------------------------------

def build_vocabulary(counts: DataFrame, window_values: int = WINDOW_VALUES) -> DataFrame:
    """Number the values of every column from 0 in code-point order.

    ``counts`` is ``(column, value, n)`` without NULL values; the result adds ``code``. Beyond
    ``window_values`` the values are sorted across the cluster: range partitions get their
    local positions, and an offset per partition, taken from their row counts, makes them
    global. No task then sorts more than one range.
    """
    counts = materialise(counts, "values")
    total = counts.count()
    spark = counts.sparkSession
    if total <= window_values:
        return materialise(counts.selectExpr(
            "*", "cast(row_number() over (partition by column order by value) - 1 as bigint) as code"), "vocabulary")
    ranges = max(2, math.ceil(total / window_values) * 2,
                 spark.sparkContext.defaultParallelism)
    ranged = materialise(
        counts.repartitionByRange(ranges, "column", "value").withColumn("range", F.spark_partition_id()),
        "ranges")
    sizes = ranged.groupBy("column", "range").agg(F.count(F.lit(1)).alias("size"))
    # one row per range and column: as many as there are partitions, whatever the table's size
    offsets = sizes.selectExpr(
        "column", "range",
        "coalesce(sum(size) over (partition by column order by range "
        "rows between unbounded preceding and 1 preceding), 0) as offset")
    local = ranged.selectExpr(
        "*", "row_number() over (partition by column, range order by value) - 1 as position")
    coded = (local.join(F.broadcast(offsets), ["column", "range"])
             .selectExpr("column", "value", "n", "cast(position + offset as bigint) as code"))
    return materialise(coded, "vocabulary")


def apply_vocabulary(df: DataFrame, vocab: DataFrame, values: Mapping[str, Column],
                     sizes: Mapping[str, tuple[int, int]], rows: int,
                     max_values: int = BROADCAST_VALUES) -> tuple[DataFrame, dict[str, Column]]:
    """Look up the code of ``values[name]`` for every column; returns the frame and the code columns.

    A small vocabulary is broadcast, so the rows are not moved. A large one is joined on the
    value; its hot values are broadcast instead and their rows spread at random, so that no
    join task receives more than its share.
    """
    codes = {}
    large = {n for n in values if sizes[n][0] > max_values or sizes[n][1] > BROADCAST_BYTES}
    if large:
        # taken before any join, so that a recomputed task draws the same numbers
        df = df.withColumn("__spread", F.xxhash64(F.monotonically_increasing_id()))
    for i, (name, value) in enumerate(values.items()):
        text, code = f"__value{i}", f"__code{i}"
        words = vocab.filter(F.col("column") == name)
        df = df.withColumn(text, value)
        if name not in large:
            lookup = words.select(F.col("value").alias(text), F.col("code").alias(code))
            df = df.join(F.broadcast(lookup), text, "left")
            found = F.col(code)
        else:
            is_hot = (F.col("n") * HOT_SHARE > rows) & (F.octet_length("value") <= HOT_BYTES)
            hot = words.filter(is_hot).select(F.col("value").alias(text), F.col("code").alias(f"{code}h"))
            df = df.join(F.broadcast(hot), text, "left")
            done = F.col(f"{code}h").isNotNull()
            df = (df.withColumn(f"{text}c", F.when(~done, F.col(text)))
                  .withColumn(f"__salt{i}", F.when(done, F.col("__spread")).otherwise(F.lit(0).cast("long"))))
            cold = words.select(F.col("value").alias(f"{text}c"), F.col("code").alias(code),
                                F.lit(0).cast("long").alias(f"__salt{i}"))
            df = df.join(cold, [f"{text}c", f"__salt{i}"], "left")
            found = F.coalesce(F.col(f"{code}h"), F.col(code))
        unseen = F.concat(F.lit(f"value not seen when fitting column {name!r}: "), F.col(text))
        codes[name] = F.when(F.col(text).isNull(), F.lit(None).cast("long")).otherwise(
            F.coalesce(found, F.raise_error(unseen).cast("long")))
    return df, codes


@dataclass(frozen=True)
class Vocabulary:
    """Numbered values ``(column, value, n, code)``, their extent, and the moments of the codes."""

    table: DataFrame
    sizes: Mapping[str, tuple[int, int]]
    stats: Mapping[str, ColumnStats]


def fit_vocabulary(counts: DataFrame, cols: Sequence[str], fill_gaps: bool,
                   max_values: int = BROADCAST_VALUES,
                   window_values: int = WINDOW_VALUES) -> tuple[Vocabulary, dict[str, str]]:
    """Number the counted values; with ``fill_gaps`` missing cells count as the column's mode.

    Returns the vocabulary and the fills. Few values come to the driver once and are numbered
    there; beyond ``max_values`` or ``BROADCAST_BYTES`` every step stays on the cluster.
    """
    counts = materialise(counts, "counts")
    extent = counts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("size")).first()
    if extent["n"] > max_values or (extent["size"] or 0) > BROADCAST_BYTES:
        fills = modes(counts, cols) if fill_gaps else {}
        if fill_gaps:
            names = F.create_map(*[F.lit(v) for pair in fills.items() for v in pair])
            filled = F.coalesce(F.col("value"), F.element_at(names, F.col("column")))
            counts = (counts.select("column", filled.alias("value"), "n")
                      .groupBy("column", "value").agg(F.sum("n").alias("n")))
        table = build_vocabulary(counts, window_values)
        return Vocabulary(table, vocabulary_sizes(table), code_stats(table)), fills
    head = counts.toArrow()
    seen: dict[str, dict[str | None, int]] = {n: {} for n in cols}
    for name, value, n in zip(*(head.column(c).to_pylist() for c in ("column", "value", "n"))):
        seen[name][value] = n
    fills, rows, sizes, stats = {}, [], {}, {}
    for name, found in seen.items():
        if fill_gaps:
            present = [(-n, v) for v, n in found.items() if v is not None]
            fills[name] = min(present)[1] if present else MISSING
            gaps = found.pop(None, 0)
            if gaps:
                found[fills[name]] = found.get(fills[name], 0) + gaps
        words = sorted(found)
        rows += [(name, w, found[w], code) for code, w in enumerate(words)]
        sizes[name] = (len(words), sum(len(w.encode()) for w in words))
        total = sum(found.values())
        if total:
            mean = sum(found[w] * code for code, w in enumerate(words)) / total
            squares = sum(found[w] * (code - mean) ** 2 for code, w in enumerate(words))
            stats[name] = ColumnStats(total, total, mean, squares / (total - 1) if total > 1 else None,
                                      0.0, float(len(words) - 1))
    table = pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(
        (("column", pa.string()), ("value", pa.string()), ("n", pa.int64()), ("code", pa.int64())))})
    return Vocabulary(counts.sparkSession.createDataFrame(table), sizes, stats), fills


def vocabulary_sizes(vocab: DataFrame) -> dict[str, tuple[int, int]]:
    """Values and text bytes per column."""
    found = vocab.groupBy("column").agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(F.octet_length("value")).alias("size"))
    return {r["column"]: (r["n"], r["size"]) for r in found.collect()}


def code_stats(vocab: DataFrame) -> dict[str, ColumnStats]:
    """Moments of every encoded column, from the value counts instead of the rows."""
    n, code = F.col("n"), F.col("code").cast("double")
    sums = vocab.groupBy("column").agg(
        F.sum(n).alias("rows"), F.sum(n * code).alias("s1"), F.max("code").alias("top"))
    out = {}
    means = {r["column"]: (r["rows"], r["s1"] / r["rows"], r["top"]) for r in sums.collect()}
    if not means:
        return out
    centre = F.create_map(*[F.lit(v) for c, (_, m, _) in means.items() for v in (c, m)])
    spread = vocab.groupBy("column").agg(
        F.sum(n * F.pow(code - F.element_at(centre, F.col("column")), F.lit(2.0))).alias("ss"))
    for r in spread.collect():
        rows, mean, top = means[r["column"]]
        out[r["column"]] = ColumnStats(rows, rows, mean, r["ss"] / (rows - 1) if rows > 1 else None,
                                       0.0, float(top))
    return out


def label_encode(df: DataFrame, cols: Sequence[str] | None = None, max_values: int = BROADCAST_VALUES,
                 window_values: int = WINDOW_VALUES) -> tuple[DataFrame, DataFrame]:
    """Replace the values of each column by their rank among the sorted distinct texts.

    Returns the encoded table and the vocabulary ``(column, value, n, code)``. A missing cell
    counts as the text ``nan``. The same codes come out whether a vocabulary is broadcast (up to
    ``max_values``) or joined, and numbered by one window (up to ``window_values``) or by ranges.
    """
    names = require_columns(df, cols) if cols is not None else categorical_columns(df)
    if not names:
        return df, df.sparkSession.createDataFrame([], "column string, value string, n long, code long")
    texts = {n: F.coalesce(col(n).cast("string"), F.lit("nan")) for n in names}
    counts = value_counts(df.select(*[texts[n].alias(n) for n in names]), names)
    vocab, _ = fit_vocabulary(counts, names, False, max_values, window_values)
    rows = next(iter(vocab.stats.values())).rows if vocab.stats else 0
    columns = df.columns
    joined, codes = apply_vocabulary(df, vocab.table, texts, vocab.sizes, rows, max_values)
    return joined.select(*[codes.get(n, col(n)).alias(n) for n in columns]), vocab.table


# -- scaling -----------------------------------------------------------------------------

def scale_expression(x: Column, stats: ColumnStats, method: str) -> Column:
    """One scaled column. A column without spread becomes 0."""
    if method not in SCALERS:
        raise ValueError(f"scaler must be one of {SCALERS}, not {method!r}")
    if stats.minimum == stats.maximum:
        return F.when(x.isNotNull(), F.lit(0.0))
    if method == "standard":
        return (x - F.lit(stats.mean)) / F.lit(stats.std_pop)
    return (x - F.lit(stats.minimum)) / F.lit(stats.maximum - stats.minimum)


def scale(df: DataFrame, method: str = "standard", cols: Sequence[str] | None = None) -> DataFrame:
    """Scale numeric columns to mean 0 and population deviation 1, or to [0, 1]."""
    if method not in SCALERS:
        raise ValueError(f"scaler must be one of {SCALERS}, not {method!r}")
    names = require_columns(df, cols) if cols is not None else numeric_columns(df)
    stats = column_stats(df, names)
    return df.select(*[
        scale_expression(as_double(df, n), stats[n], method).alias(n) if n in stats else col(n)
        for n in df.columns])
