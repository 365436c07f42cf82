"""A Bloom filter of bounded size: what it drops is certainly absent, an exact join follows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and log2 of the least and the most bits: 128 MB at most.  Beyond 10**8 keys it drops less, no more.
PER_KEY, LEAST, MOST = 10, 16, 30
SEEDS = (1, 2, 3)


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def build(keys: DataFrame, key: str) -> np.ndarray:
    """The filter as uint64 words.  ``keys`` is read twice: it should be a written table."""
    bits = min(MOST, max(LEAST, (keys.count() * PER_KEY).bit_length()))
    at = keys.select(F.explode(F.array(*(F.shiftrightunsigned(_hash(F.col(key), s), 64 - bits) for s in SEEDS))).alias("at"))
    word = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[word.column("w").to_numpy()] = word.column("bits").to_numpy()
    return out.view(np.uint64)


def places(key: Column) -> Column:
    return F.array(*(_hash(key, s) for s in SEEDS))


def may_hold(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For int64 [n, len(SEEDS)] of ``places``."""
    at = at.view(np.uint64) >> np.uint64(64 - (len(words) << 6).bit_length() + 1)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)
