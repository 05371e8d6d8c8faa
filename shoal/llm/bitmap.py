"""A filter of fixed size for keys: one bit per hash value, whatever the number of keys.

Only a prefilter before an exact join: a full bitmap lets everything pass and loses nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23


def bitmap(df: DataFrame, key: Column, bits: int = BITS) -> np.ndarray:
    """The bits of all non-null long ``key`` values: at most ``2**bits / 64`` rows reach the driver."""
    place = F.shiftrightunsigned(key, 64 - bits)
    rows = (df.where(key.isNotNull())
            .groupBy(F.shiftright(place, 6).alias("w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"),
                                          place.bitwiseAND(63).cast("int"))).alias("m")))
    words = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    got = rows.toArrow()
    if got.num_rows:
        words[got.column("w").to_numpy()] = got.column("m").to_numpy().view(np.uint64)
    return words


def holds(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which ``uint64`` keys may be among those of the bitmap."""
    bits = int(len(words)).bit_length() - 1 + 6
    place = keys >> np.uint64(64 - bits)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
