"""Preprocessing of many datasets at once: the statistics of each are those of its group of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.columns import as_double, categorical_columns, col, numeric_columns, require_columns
from shoal.operators import cleaning

IMPUTERS = ("mean", "drop")


def _per_group(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Join statistics (one row per group) to the rows; a null group is a group of its own."""
    return df.join(stats.withColumnRenamed("__group", "__of"), F.col("__group").eqNullSafe(F.col("__of"))).drop("__of")


def _moments(df: DataFrame, names: Sequence[str], tag: str) -> DataFrame:
    """Per group and column: values, mean, squares, and extent; ``rows`` counts missing cells too."""
    wanted: list[Column] = [F.count(F.lit(1)).alias(f"{tag}_rows")]
    for i, name in enumerate(names):
        x = as_double(df, name)
        wanted += [F.count(x).alias(f"{tag}_n{i}"), F.avg(x).alias(f"{tag}_m{i}"), F.min(x).alias(f"{tag}_lo{i}"),
                   F.max(x).alias(f"{tag}_hi{i}"), (F.var_pop(x) * F.count(x)).alias(f"{tag}_ss{i}")]
    return df.groupBy("__group").agg(*wanted)


def preprocess_groups(df: DataFrame, group: str, drop_cols: Sequence[str] = (), imputer: str = "mean", scaler: str = "standard",
                      remove_outliers: bool = True, key: Sequence[str] | str = ()) -> DataFrame:
    """Clean, encode and scale every group of ``df`` by itself, in the same passes for any number of groups.

    Returns the group, the key columns and the scaled columns under their names: what
    :func:`shoal.plans.preprocess.preprocess` gives for each group alone, with mean imputation or
    without incomplete rows. Text columns become the rank of their value inside the group.
    """
    if imputer not in IMPUTERS:
        raise ValueError(f"imputer must be one of {IMPUTERS}, not {imputer!r}")
    if scaler not in cleaning.SCALERS:
        raise ValueError(f"scaler must be one of {cleaning.SCALERS}, not {scaler!r}")
    key = [key] if isinstance(key, str) else list(key)
    require_columns(df, [group, *key])
    outside = [group, *key, *drop_cols]
    numeric, other = numeric_columns(df, exclude=outside), categorical_columns(df, exclude=outside)
    columns = [n for n in df.columns if n in numeric or n in other]
    if not columns:
        raise ValueError("no columns left to preprocess")
    rows = df.select(col(group).alias("__group"), *[col(k) for k in key], *[
        as_double(df, n).alias(n) if n in numeric else col(n).cast("string").alias(n) for n in columns])
    if remove_outliers and numeric:
        judged = _per_group(rows, _moments(rows, numeric, "a"))
        for i, name in enumerate(numeric):
            # the deviation once gaps hold the mean
            std = F.sqrt(F.try_divide(F.col(f"a_ss{i}"), F.col("a_rows") - 1))
            flat = (F.col(f"a_lo{i}") == F.col(f"a_hi{i}")) & (F.col(f"a_n{i}") == F.col("a_rows"))
            near = F.abs(F.try_divide(col(name) - F.col(f"a_m{i}"), std)) < 3.0
            judged = judged.where(F.coalesce(flat | ~(std > 0) | near, F.lit(True)))
        rows = judged.select(*[col(c) for c in rows.columns])
    if imputer == "drop":
        rows = cleaning.drop_missing(rows, columns)
    for name in other:
        rows = _encoded(rows, name)
    if imputer == "mean":
        means = _per_group(rows, _moments(rows, numeric, "b")) if numeric else rows
        rows = means.select("__group", *[col(k) for k in key], *[
            F.coalesce(col(n), F.col(f"b_m{numeric.index(n)}")).alias(n) if n in numeric else col(n) for n in columns])
    scaled = _per_group(rows, _moments(rows, columns, "c"))
    out = []
    for i, name in enumerate(columns):
        x, lo, hi = col(name).cast("double"), F.col(f"c_lo{i}"), F.col(f"c_hi{i}")
        std = F.sqrt(F.col(f"c_ss{i}") / F.col(f"c_n{i}"))
        value = F.try_divide(x - F.col(f"c_m{i}"), std) if scaler == "standard" else F.try_divide(x - lo, hi - lo)
        out.append(F.when(lo == hi, F.when(x.isNotNull(), F.lit(0.0))).otherwise(value).alias(name))
    return scaled.select(F.col("__group").alias(group), *[col(k) for k in key], *out)


def _encoded(rows: DataFrame, name: str) -> DataFrame:
    """Codes of one text column: missing cells take the group's most frequent value, the smallest on ties."""
    counts = rows.groupBy("__group", col(name).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    present = counts.where(F.col("__value").isNotNull())
    codes = present.withColumn("__code", F.row_number().over(Window.partitionBy("__group").orderBy("__value")) - 1)
    best = codes.groupBy("__group").agg(F.min_by("__code", F.struct(-F.col("__n"), "__value")).alias("__fill"))
    coded = rows.join(codes.select(F.col("__group").alias("__of"), F.col("__value").alias("__text"), "__code"),
                      F.col("__group").eqNullSafe(F.col("__of")) & (col(name) == F.col("__text")), "left").drop("__of", "__text")
    filled = coded.join(best.withColumnRenamed("__group", "__of"), F.col("__group").eqNullSafe(F.col("__of")), "left")
    # a group without any value has a single code
    return filled.withColumn(name, F.coalesce("__code", "__fill", F.lit(0)).cast("double")).select(*[col(c) for c in rows.columns])
