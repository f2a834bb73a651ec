"""Pixel tables without image files: mosaics of embeddings, and patterns in closed form.

A pixel table has image_id long, ch int, y int, x int, v double (0 to 1).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicore.functions.pixels import clip


def mosaic(embeddings: DataFrame) -> DataFrame:
    """Grey images of 64 x 64 pixels: 64 embeddings, each a tile of 8 x 8; only complete images."""
    tiles = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("vec_id div 64").alias("image_id"), "embedding")
    whole = tiles.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).where("n = 64").select("image_id")
    cells = tiles.join(whole, "image_id", "left_semi").select("image_id", (F.col("vec_id") % 64).cast("int").alias("t"), F.posexplode("embedding").alias("p", "e"))
    return cells.selectExpr("image_id", "0 AS ch", "cast((t div 8) * 8 + p div 8 AS int) AS y", "cast((t % 8) * 8 + p % 8 AS int) AS x", "least(1D, greatest(0D, cast(e AS double) + 0.5D)) AS v")


def mosaic_rgb(embeddings: DataFrame) -> DataFrame:
    """Colour images: three consecutive grey ones as channels; only complete ones."""
    rows = mosaic(embeddings).selectExpr("image_id div 3 AS image_id", "cast(image_id % 3 AS int) AS ch", "y", "x", "v")
    whole = rows.groupBy("image_id").agg(F.countDistinct("ch").alias("n")).where("n = 3").select("image_id")
    return rows.join(whole, "image_id", "left_semi")


def _grid(spark: SparkSession, size: int, image_id: int) -> DataFrame:
    return spark.range(size * size).selectExpr(f"{image_id}L AS image_id", f"cast(id div {size} AS int) AS y", f"cast(id % {size} AS int) AS x")


def smooth(spark: SparkSession, size: int, channels: int = 1, image_id: int = 0) -> DataFrame:
    """A ramp, steeper downwards; in colour also scaled and shifted."""
    base = 0.6 * F.col("y") / (size - 1) + 0.4 * F.col("x") / (size - 1)
    planes = [base, clip(0.9 * base + 0.05, 0, 1), clip(0.8 * base + 0.1, 0, 1)][:channels]
    return _grid(spark, size, image_id).select("image_id", F.posexplode(F.array(*planes)).alias("ch", "v"), "y", "x").select("image_id", "ch", "y", "x", "v")


def edges(spark: SparkSession, size: int, channels: int = 1, image_id: int = 0) -> DataFrame:
    """Vertical stripes; in colour the second and third channel are rolled."""
    step = max(4, size // 16)
    width = max(1, step // 2)
    stripe = lambda x: F.when(x % step < width, 1.0).otherwise(0.0)
    x = F.col("x")
    planes = [stripe(x), stripe(x), stripe(F.pmod(x - step // 2, F.lit(size)))][:channels]  # a roll along y changes nothing
    return _grid(spark, size, image_id).select("image_id", F.posexplode(F.array(*planes)).alias("ch", "v"), "y", "x").select("image_id", "ch", "y", "x", "v")


def random_image(size: int, channels: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).random((size, size) if channels == 1 else (size, size, channels), dtype=np.float32)


def from_array(spark: SparkSession, image: np.ndarray, image_id: int = 0) -> DataFrame:
    """The pixels of one small image that the driver holds."""
    planes = image[:, :, None] if image.ndim == 2 else image
    y, x, c = np.indices(planes.shape)
    rows = zip(c.ravel().tolist(), y.ravel().tolist(), x.ravel().tolist(), planes.ravel().astype(float).tolist(), strict=True)
    return spark.createDataFrame([(image_id, *r) for r in rows], "image_id long, ch int, y int, x int, v double")
