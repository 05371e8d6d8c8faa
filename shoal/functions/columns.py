"""Column selection and the small expressions most operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NO_SUPPORT = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def col(name: str) -> Column:
    """Reference a column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Return ``names`` as a list; raise if one of them is not a column of ``df``."""
    names = list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; have {df.columns}")
    return names


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns of any numeric type, in table order. Booleans are not numeric."""
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Every non-numeric column, in table order; nested and binary types are refused."""
    names = []
    for f in df.schema:
        if f.name in exclude or isinstance(f.dataType, T.NumericType):
            continue
        if isinstance(f.dataType, _NO_SUPPORT):
            raise ValueError(f"column {f.name!r} has unsupported type {f.dataType.simpleString()}")
        names.append(f.name)
    return names


def select_numeric(df: DataFrame) -> DataFrame:
    """Keep only the numeric columns."""
    return df.select(*[col(n) for n in numeric_columns(df)])


def as_double(df: DataFrame, name: str) -> Column:
    """A numeric column as DOUBLE with NaN read as missing."""
    value = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        value = F.nanvl(value, F.lit(None).cast(df.schema[name].dataType))
    return value.cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.nanvl(col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if f.name in floats else col(f.name)
        for f in df.schema])
