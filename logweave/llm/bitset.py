"""A bit set of fixed size that keeps keys which cannot match out of a shuffle.

It may let other keys through and never holds a wanted one back, so what reads
it joins with the wanted keys afterwards; results do not depend on its size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def has_bits(have, mask, anchor):
    """Whether both bits of every anchor are set."""
    found = np.ones(len(anchor), bool)
    for at in (anchor & mask, (anchor >> np.uint64(32)) & mask):
        found &= (have[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def bit_set(anchors: DataFrame, bits: int):
    """64-bit words of the bit set of ``anchor`` (two bits each), as a broadcast numpy array."""
    mask = (1 << bits) - 1
    at = F.explode(F.array(F.col("anchor").bitwiseAND(F.lit(mask)),
                           F.shiftrightunsigned("anchor", 32).bitwiseAND(F.lit(mask))))
    # at most 2 ** bits / 64 rows, whatever the size of the input
    rows = (anchors.select(at.alias("bit"))
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("value")).toArrow())
    have = np.zeros(1 << (bits - 6), np.uint64)
    have[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
    return anchors.sparkSession.sparkContext.broadcast(have), np.uint64(mask)
