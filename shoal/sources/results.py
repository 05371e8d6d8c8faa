"""The tables of a run, written under one folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_results(tables: Mapping[str, DataFrame], folder: str, format: str = "csv") -> dict[str, str]:
    """Write each table to ``folder/<name>`` as CSV with a header, or Parquet; never overwrites."""
    if format not in ("csv", "parquet"):
        raise ValueError(f"format must be 'csv' or 'parquet', not {format!r}")
    paths = {}
    for name, table in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        writer = table.write.mode("error")
        if format == "csv":
            # doubled quotes, and no trimming: a cell reads back as it was
            (writer.option("header", True).option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
        else:
            writer.parquet(path)
        paths[name] = path
    return paths


def read_results(spark: SparkSession, folder: str, names: list[str], format: str = "csv") -> dict[str, DataFrame]:
    """Read tables written by :func:`write_results`."""
    from shoal.sources.csv import load_csv

    read = {"csv": lambda p: load_csv(spark, p), "parquet": spark.read.parquet}[format]
    return {n: read(f"{folder.rstrip('/')}/{n}") for n in names}
