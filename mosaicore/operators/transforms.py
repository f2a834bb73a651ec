"""The fifteen block transforms as gather tables: eight isometries, four repetitions, three shears."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The isometry that each id stands for; 12 to 14 are shears by these factors.
ISOMETRY = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 4, 10: 5, 11: 6}
SHEAR = {12: -0.25, 13: 0.0, 14: 0.25}


def _isometry(grid: np.ndarray, k: int) -> np.ndarray:
    """k quarter turns clockwise; from 4 on, of the mirror image."""
    return np.rot90(grid, -k) if k < 4 else np.rot90(np.fliplr(grid), 4 - k)


@lru_cache(256)
def gather(block: int, tf: int) -> tuple[int | None, ...]:
    """For each place of the result, the place it takes its value from; None is zero."""
    grid = np.arange(block * block).reshape(block, block)
    if tf in ISOMETRY:
        return tuple(_isometry(grid, ISOMETRY[tf]).ravel().tolist())
    if tf not in SHEAR:
        raise ValueError(f"invalid transform id: {tf}")
    out: list[int | None] = []
    for y in range(block):
        shift = round(SHEAR[tf] * y)  # half to even
        out += [y * block + x - shift if 0 <= x - shift < block else None for x in range(block)]
    return tuple(out)


def apply(block: np.ndarray, tf: int) -> np.ndarray:
    """The transform of an array whose last two axes are a square block."""
    b = block.shape[-1]
    source = np.array([-1 if s is None else s for s in gather(b, tf)])
    flat = block.reshape(*block.shape[:-2], b * b)
    return np.where(source >= 0, flat[..., source], 0).astype(block.dtype).reshape(block.shape)


def expanded(blocks: DataFrame, block: int, tfs: list[int], *arrays: str, nested: tuple[str, ...] = ()) -> DataFrame:
    """Each row once per transform (tf, and tf_pos, its place in the list), with the arrays transformed.

    nested: columns that are arrays of such arrays. The gather table is part of the plan, so
    nothing is joined or shuffled.
    """
    nulls = lambda s: F.lit(-1 if s is None else s)
    table = F.array(*(F.struct(F.lit(t).alias("tf"), F.lit(k).alias("tf_pos"), F.array(*map(nulls, gather(block, t))).alias("source")) for k, t in enumerate(tfs)))
    rows = blocks.withColumn("_t", F.explode(table))

    def moved(a: Column) -> Column:
        return F.transform(F.col("_t.source"), lambda i: F.when(i >= 0, a[i]).otherwise(F.lit(0.0)))

    columns = {a: moved(F.col(a)) for a in arrays} | {a: F.transform(F.col(a), moved) for a in nested}
    return rows.withColumns({**columns, "tf": F.col("_t.tf"), "tf_pos": F.col("_t.tf_pos")}).drop("_t")
