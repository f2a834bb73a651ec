"""Features of blocks: entropy, variance, bucket, sums; and filters on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicore.functions.pixels import bucket_id, dot, entropy, total, variance


def described(blocks: DataFrame, buckets: int = 1) -> DataFrame:
    """Blocks (a) with ent, var and bucket (0 where there is one bucket)."""
    rows = blocks.withColumns({"ent": entropy(F.col("a")), "var": variance(F.col("a"))})  # left out of the plan where nothing uses them
    return rows.withColumn("bucket", bucket_id(F.col("ent"), F.col("var"), buckets) if buckets > 1 else F.lit(0))


def kept_domains(domains: DataFrame, entropy_thresh: float = 0.0, max_domains: int | None = None, seed: int = 0) -> DataFrame:
    """Domains (ent, dom) that pass the threshold, at most max_domains of each image, numbered anew in their order.

    The sample is the first by the MD5 of seed and number, so it needs no list on the driver.
    """
    rows = domains.where(F.col("ent") >= entropy_thresh) if entropy_thresh > 0 else domains
    if max_domains is not None:
        order = W.partitionBy("image_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "dom")), "dom")
        rows = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= max_domains).drop("_k")
    if entropy_thresh > 0 or max_domains is not None:
        rows = rows.withColumn("dom", (F.row_number().over(W.partitionBy("image_id").orderBy("dom")) - 1).cast("long"))
    return rows


def sums(blocks: DataFrame) -> DataFrame:
    """Blocks (a) with sum_d and sum_dd."""
    return blocks.withColumns({"sum_d": total(F.col("a")), "sum_dd": dot(F.col("a"), F.col("a"))})


def histogram(blocks: DataFrame) -> DataFrame:
    """How many blocks each bucket has: image_id, bucket, n."""
    return blocks.groupBy("image_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
