"""Bit maps of constant size that let tasks skip rows no join can want."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP_BITS = 23


def place(key: Column, bits: int = MAP_BITS, hashed: bool = False) -> Column:
    """Bit of a key; ``hashed`` keys are even as they are."""
    return F.pmod(key if hashed else F.xxhash64(key), F.lit(1 << bits))


def bit_map(rows: DataFrame, key: str, size: int = MAP_BITS, hashed: bool = False) -> Broadcast:
    """The bits of all keys of ``rows``, for ``marked``.

    2 ** (size - 3) bytes, one megabyte by default, however many rows there are.
    """
    words = (
        rows.select(place(F.col(key), size, hashed).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(1 << (size - 6), dtype=np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bits)


def marked(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bit of each place is set: true for every key of the map and few others."""
    return (bits[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
