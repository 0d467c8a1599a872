"""All of one side against all of the other, in groups of a bounded size; and samples that reach the driver once."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of vectors that a group holds of each side.
STORED, ASKED = 16 << 20, 16 << 20


def sample(df: DataFrame, h: Column, n: int, total: int, *ties: str) -> pa.Table:
    """The n rows of the lowest hash (a uniform long); total: rows of df. A limit alone would send n rows of every partition to the driver."""
    share = (n + 8 * math.sqrt(n) + 8) / max(total, 1)
    while True:
        kept = df.withColumn("_h", h)
        if share < 1:
            kept = kept.where(F.col("_h") <= int(share * 2**64) - 2**63)
        out = kept.orderBy("_h", *ties).limit(n).drop("_h").toArrow()
        if len(out) == n or share >= 1:
            return out
        share *= 4  # copies share a hash, so that few rows may lie below it


def parts(counts: Sequence[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """First part of each cell and how many parts it has: neighbouring cells share a part of at most `most` rows, larger cells have several."""
    first, splits, number, held = [], [], 0, 0
    for n in counts:
        if held and held + n > most:
            number, held = number + 1, 0
        first.append(number)
        splits.append(max(1, -(-int(n) // most)))
        held += int(n)
        if held >= most:
            number, held = number + splits[-1], 0
    return np.array(first, np.int64), np.array(splits, np.int64)


def rows_of_part(total: int, width: int, partitions: int, least: int = 8192) -> int:
    """Few enough for a group's bound, and for some groups a partition."""
    return max(1, min(STORED // max(1, 8 * width), max(least, -(-total // (4 * partitions)))))


def meet(asked: DataFrame, stored: DataFrame, of: str, tiles: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(asked, stored) for every part: asked has part (which it visits) and `of`, by which it is dealt to tiles; stored has part.

    What is asked goes to each part that it visits, what is stored to each tile, so that a group's size is bounded on both sides.
    """
    left = asked.withColumn("tile", F.pmod(F.xxhash64(of), F.lit(tiles)).cast("int"))
    right = stored.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))) if tiles > 1 else stored.withColumn("tile", F.lit(0))
    return left.groupBy("part", "tile").cogroup(right.groupBy("part", "tile")).applyInArrow(run, schema)
