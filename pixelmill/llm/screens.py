"""A bitmap of fixed size that lets through every wanted key, and some others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the screen; its size does not depend on the data.
SCREEN_WORDS = 1 << 20


def screen(keys: DataFrame) -> np.ndarray:
    """The screen of the column ``k1`` of ``keys``."""
    word = F.col("k1").bitwiseAND(F.lit(SCREEN_WORDS - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("k1", 20).bitwiseAND(F.lit(63)).cast("int"))
    got = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(SCREEN_WORDS, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def passes(bitmap: np.ndarray, k1: np.ndarray) -> np.ndarray:
    """Whether the screen lets each key pass."""
    k = k1.view(np.uint64)
    return (bitmap[(k & np.uint64(SCREEN_WORDS - 1)).astype(np.int64)] >> ((k >> np.uint64(20)) & np.uint64(63))) & np.uint64(1) == 1
