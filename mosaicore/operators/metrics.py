"""Quality of reconstructions, and sizes of codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["image_id", "ch", "y", "x"]


def quality(original: DataFrame, other: DataFrame) -> DataFrame:
    """image_id, mse and psnr (99 for no error) of two pixel tables."""
    both = original.join(other.withColumnRenamed("v", "w"), CELL)
    error = both.groupBy("image_id").agg(F.avg((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))).alias("mse"))
    return error.withColumn("psnr", F.when(F.col("mse") <= 0, 99.0).otherwise(-10 * F.log10("mse")))


def code_sizes(images: DataFrame, leaves: DataFrame, domains: DataFrame, quantized: bool) -> DataFrame:
    """image_id, n_bytes and ratio (bytes of the image over those of its code), from counts alone.

    domains: image_id, block and n, the domains of each pool, used or not.
    """
    pools = domains.groupBy("image_id").agg(F.count(F.lit(1)).alias("pools"), F.sum("n").alias("domains"))
    counts = leaves.groupBy("image_id").agg(F.count(F.lit(1)).alias("leaves"))
    size = 48 + 8 * F.col("pools") + 4 * F.col("domains") + F.col("leaves") * (10 + 2 * F.col("channels") * (1 if quantized else 4))
    rows = images.join(pools, "image_id").join(counts, "image_id").withColumn("n_bytes", size.cast("long"))
    return rows.select("image_id", "n_bytes", (F.col("orig_height") * F.col("orig_width") * F.col("channels") / F.greatest("n_bytes", F.lit(1))).alias("ratio"))
