"""Drop, preview, shape and feature assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions.columns import col, nan_to_null, numeric_columns, require_columns


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; unlike ``DataFrame.drop`` an unknown name is an error."""
    return df.drop(*require_columns(df, cols))


def preview(df: DataFrame, n: int = 10, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows with NaN shown as NULL, ordered by ``order_by`` when given."""
    shown = nan_to_null(df)
    if order_by:
        shown = shown.orderBy(*[col(c) for c in require_columns(df, order_by)])
    return shown.limit(n)


def shape_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each named table."""
    if not tables:
        raise ValueError("shape_summary needs at least one table")
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))
        for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def assemble(df: DataFrame, cols: Sequence[str] | None = None, out: str = "features") -> DataFrame:
    """Gather numeric columns into one ``ARRAY<DOUBLE>``.

    A numeric array column may be named too and is spliced in. A NULL or NaN cell fails the
    job with the name of its column.
    """
    names = require_columns(df, cols) if cols is not None else numeric_columns(df)
    if not names:
        raise ValueError("no columns to assemble")
    parts = []
    for name in names:
        kind = df.schema[name].dataType
        problem = F.raise_error(F.lit(f"missing value in feature column {name!r}"))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            cells = col(name).cast("array<double>")
            bad = cells.isNull() | F.exists(cells, lambda v: v.isNull() | F.isnan(v))
            parts.append(F.when(bad, problem.cast("array<double>")).otherwise(cells))
        elif isinstance(kind, T.NumericType):
            cell = col(name).cast("double")
            bad = cell.isNull() | F.isnan(cell)
            parts.append(F.array(F.when(bad, problem.cast("double")).otherwise(cell)))
        else:
            raise ValueError(f"column {name!r} is not numeric")
    return df.withColumn(out, F.concat(*parts) if len(parts) > 1 else parts[0])
