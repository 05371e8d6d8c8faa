"""Query registration and the rounding both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when the result can be stated in SQL, its oracle."""
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Round to ``digits``; what rounds to zero is plain zero, whatever its sign."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.abs(x) < 0.5 * 10 ** -digits, F.lit(0.0)).otherwise(F.round(x, digits))


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"CASE WHEN abs({x}) < {0.5 * 10 ** -digits!r} THEN 0.0 ELSE round({x}, {digits}) END"


def round_columns(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column of a result."""
    return df.select(*[rounded(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])
