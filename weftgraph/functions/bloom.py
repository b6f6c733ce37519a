"""Bloom filter over 64-bit hashes, built by bit_or in the JVM and tested in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bits of one filter (32 MB). More keys than fit make more filters, each for a slice of the hashes.
MOST_BITS = 1 << 28
BITS_A_KEY = 12
HASHES = 5
#: Bits of a hash that are used; sums of them stay within 64 bits.
LOW = (1 << 40) - 1


def _positions(h1: Column, h2: Column, bits: int) -> Column:
    a, b = h1.bitwiseAND(F.lit(LOW)), h2.bitwiseAND(F.lit(LOW))
    return F.array(*[(a + F.lit(i) * b).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)])


def hashes(c: Column) -> tuple[Column, Column]:
    """The two hashes of a value that filters take."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def slices(rows: int) -> int:
    """Filters that ``rows`` keys need."""
    return max(1, -(-rows * BITS_A_KEY // MOST_BITS))


def build(keys: DataFrame, h1: str, h2: str, rows: int) -> np.ndarray:
    """Words of the filter of the keys with hashes ``h1`` and ``h2``, of which there are about ``rows``. Partial words are
    combined before the shuffle, and only words, of bounded size, go to the driver."""
    bits = 1 << 10
    while bits < min(MOST_BITS, rows * BITS_A_KEY):
        bits *= 2
    at = keys.select(F.explode(_positions(F.col(h1), F.col(h2), bits)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
    table = words.toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[table.column("word").to_numpy()] = table.column("set").to_numpy()
    return out


def might_contain(filter_: Broadcast, h1: Column, h2: Column) -> Column:
    """Whether the filter may hold the value of these hashes; false is certain."""

    @F.pandas_udf("boolean")
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        words = filter_.value
        bits, a, b = len(words) * 64, h1.to_numpy() & LOW, h2.to_numpy() & LOW
        hit = np.ones(len(a), dtype=bool)
        for i in range(HASHES):
            at = (a + i * b) & (bits - 1)
            hit &= (words[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(hit)

    return test(h1, h2)
