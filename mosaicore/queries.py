"""Queries of the image engine over the driver's tables: images are mosaics of embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaicore.functions import pixels as px
from mosaicore.operators import batch, blocks, codec, features, metrics, overlay, regress, search
from mosaicore.operators.transforms import expanded
from mosaicore.params import PRESETS, EncodeParams
from mosaicore.plans import sweep
from mosaicore.sources import codefile, synthetic

Query = Callable[[SparkSession, str], DataFrame]
#: Block size and stride of most queries: 49 domains and 64 ranges for each image.
B, STRIDE = 8, 8
IDENTITY = EncodeParams(block=B, stride=STRIDE, transform_ids=(0,), topk=4096)
QUANTIZED = EncodeParams(block=B, stride=STRIDE, transform_ids=(0,), topk=4096, quantized=True)
SEARCHED = EncodeParams(block=B, stride=STRIDE, topk=16)
BUCKETED = EncodeParams(block=B, stride=STRIDE, topk=16, use_buckets=True, bucket_count=8)
SNAPPED = EncodeParams(block=B, stride=STRIDE, topk=16, use_buckets=True, bucket_count=8, use_s_sets=True)
QUADTREE = EncodeParams(min_block=8, max_block=16, stride=STRIDE, use_quadtree=True, max_mse=0.0153, transform_ids=(0,), topk=4096)


def r6(c: str | F.Column, name: str) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.mosaic(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.mosaic_rgb(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.image_table(gray(spark, sf_dir), 16)


def domain_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.domains(gray(spark, sf_dir), B, STRIDE)


def range_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.ranges(gray(spark, sf_dir), B)


def mosaic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray(spark, sf_dir).select("image_id", "y", "x", r6("v", "v"))


def luma_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.luma(colour(spark, sf_dir)).select("image_id", "y", "x", r6("v", "luma"))


def gray_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.gray_u8(colour(spark, sf_dir).withColumn("v", px.clamp_u8(F.col("v")).cast("double")))


def clamp_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return gray(spark, sf_dir).select("image_id", "y", "x", px.clamp_u8(v).alias("clamped"), px.img_u8(v).alias("rounded"), px.save_u8(v * 2 - 0.5).alias("saved"))


def pad_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.pad_to_multiple(gray(spark, sf_dir), 48).select("image_id", "y", "x", r6("v", "v"))


def range_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.range_grid(images(spark, sf_dir), B)


def domain_grid_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.domain_grid(images(spark, sf_dir), B, STRIDE)


def domain_grid_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.domain_grid(images(spark, sf_dir), B, 5)


def downsample2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.downsample(gray(spark, sf_dir)).select("image_id", "y", "x", r6("v", "v"))


#: A weighted sum that tells arrays apart: the value at place p counts p + 1 times.
def ramp(a: str) -> F.Column:
    return F.aggregate(F.transform(F.col(a), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)


def domains_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.domains(gray(spark, sf_dir), B, 5).select("image_id", "dom", "y", "x", r6(ramp("a"), "ramp"))


def _transformed(tfs: list[int]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return expanded(range_blocks(spark, sf_dir), B, tfs, "a").select("image_id", "y", "x", "tf", r6(ramp("a"), "ramp"))

    return query


def entropy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.described(range_blocks(spark, sf_dir)).select("image_id", "y", "x", r6("ent", "ent"))


def variance_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.described(domain_blocks(spark, sf_dir)).select("image_id", "dom", r6("var", "var"))


def bucket_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.described(range_blocks(spark, sf_dir), 8).select("image_id", "y", "x", "bucket")


def bucket_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.histogram(features.described(domain_blocks(spark, sf_dir), 16))


def entropy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.kept_domains(features.described(domain_blocks(spark, sf_dir)), entropy_thresh=0.64).select("image_id", "dom", "y", "x", r6("ent", "ent"))


def max_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.kept_domains(features.described(domain_blocks(spark, sf_dir)), max_domains=20, seed=B).select("image_id", "dom", "y", "x")


def normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain_blocks(spark, sf_dir).withColumn("a", px.normalised(F.col("a")))
    return rows.select("image_id", "dom", r6(ramp("a"), "ramp"), r6(px.dot(F.col("a"), F.col("a")), "norm2"))


def query_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = range_blocks(spark, sf_dir).withColumn("a", px.unit(F.col("a")))
    return rows.select("image_id", "y", "x", r6(ramp("a"), "ramp"), r6(px.dot(F.col("a"), F.col("a")), "norm2"))


def linreg_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = range_blocks(spark, sf_dir).selectExpr("image_id", "cast((y div 8) * 8 + x div 8 AS long) AS rng", "a AS r").withColumn("dom", F.expr("rng % 49"))
    pairs = ranges.join(domain_blocks(spark, sf_dir).select("image_id", "dom", F.col("a").alias("d")), ["image_id", "dom"])
    sums = regress.sums_of(F.col("d"), F.col("r"))
    s, o = regress.solved(sums)
    return pairs.select("image_id", "rng", "dom", r6(s, "s"), r6(o, "o"), r6(regress.sse(sums, s, o), "err"))


def tf_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.sums(expanded(domain_blocks(spark, sf_dir), B, list(range(15)), "a"))
    return rows.select("image_id", "dom", "tf", r6("sum_d", "sum_d"), r6("sum_dd", "sum_dd"))


def _topk(p: EncodeParams) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pixels = gray(spark, sf_dir)
        q, pool = codec.range_queries(pixels, p, B), codec.build_pool(pixels, p, B)
        return search.topk_dot(q, pool, 4, p.use_buckets).select("image_id", "y", "x", "rank", "entry", r6("score", "score"))

    return query


def _leaves(p: EncodeParams, source: Query = gray) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = codec.leaf_order(codec.encode(source(spark, sf_dir), p), p.checked().max_block)
        mse = F.when(F.col("mse") == float("inf"), F.lit(None)).otherwise(F.round("mse", 6)).alias("mse")
        rows = rows.select("image_id", "leaf_id", "y", "x", "block", "dom", "tf", F.posexplode("codes").alias("ch", "code"), mse)
        return rows.select("image_id", "leaf_id", "y", "x", "block", "dom", "tf", "ch", r6("code.s", "s"), r6("code.o", "o"), "mse")

    return query


def quant_dequant(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o = F.col("v") * 3 - 1.5, F.col("v") * 4 - 1.5
    rows = gray(spark, sf_dir).select("image_id", "y", "x", px.quant_s(s, 0.99).alias("qs"), px.quant_o(o, -0.5, 1.5).alias("qo"))
    return rows.select("*", r6(px.dequant_s(F.col("qs"), 0.99), "s"), r6(px.dequant_o(F.col("qo"), -0.5, 1.5), "o"))


def s_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(b, k, v) for b, own in enumerate(px.s_sets(8, 0.99)) for k, v in enumerate(own)]
    return spark.createDataFrame(rows, "bucket int, ord int, v double").withColumn("v", F.round("v", 6))


def s_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = F.array(*(F.array(*map(F.lit, own)) for own in px.s_sets(8, 0.99)))
    rows = gray(spark, sf_dir).selectExpr("image_id", "y", "x", "v * 3 - 1.5 AS s0", "cast((y + x) % 8 AS int) AS bucket")
    return rows.select("image_id", "y", "x", "bucket", r6(px.snap(F.col("s0"), sets[F.col("bucket")]), "s"))


def lsh_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    normals = np.array([[((i * 31 + j * 17 + (i * j) % 7) % 2) * 2.0 - 1 for j in range(B * B)] for i in range(10)])
    pixels = gray(spark, sf_dir)
    q = codec.range_queries(pixels, IDENTITY, B).withColumn("sig", search.signature(F.col("q"), normals))
    pool = codec.build_pool(pixels, IDENTITY, B).withColumn("sig", search.signature(F.col("proxy"), normals))
    return search.lsh_candidates(q, pool, 10, 5).select("image_id", "y", "x", "entry", "probe", F.col("at").alias("place"))


def lsh_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(EncodeParams(block=B, stride=STRIDE, backend="lsh", lsh_planes=12, lsh_budget=256, topk=16))(spark, sf_dir)


def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of the domains of each image on four directions of its own."""
    import numpy as np
    import pandas as pd

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["a"])
        mean, basis = search.fit_pca(x, 4, 0)
        z = (x - mean) @ basis.T
        return pd.DataFrame({"image_id": frame["image_id"], "dom": frame["dom"], **{f"z{k}": z[:, k] for k in range(4)}})

    rows = domain_blocks(spark, sf_dir).withColumn("a", px.normalised(F.col("a"))).select("image_id", "dom", "a")
    return rows.groupBy("image_id").applyInPandas(each, "image_id long, dom long, z0 double, z1 double, z2 double, z3 double")


def _decoded(iterations: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        leaves = codec.encode(gray(spark, sf_dir), IDENTITY)
        return codec.decode(leaves, images(spark, sf_dir), STRIDE, iterations).select("image_id", "y", "x", r6("v", "v"))

    return query


def mse_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = gray(spark, sf_dir)
    other = codec.decode(codec.encode(pixels, IDENTITY), images(spark, sf_dir), STRIDE, 2)
    return metrics.quality(pixels, other).select("image_id", r6("mse", "mse"), r6("psnr", "psnr"))


def _quadtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode(gray(spark, sf_dir), QUADTREE)


def code_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = images(spark, sf_dir)
    pools = blocks.domain_grid(pictures, 16, STRIDE).withColumn("block", F.lit(16)).unionByName(blocks.domain_grid(pictures, 8, STRIDE).withColumn("block", F.lit(8)))
    counts = pools.groupBy("image_id", "block").agg(F.count(F.lit(1)).alias("n"))
    return metrics.code_sizes(pictures, _quadtree(spark, sf_dir), counts, quantized=True).select("image_id", "n_bytes", r6("ratio", "ratio"))


def _mask(thickness: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return overlay.edge_mask(_quadtree(spark, sf_dir), images(spark, sf_dir), thickness)

    return query


def overlay_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.outlined(gray(spark, sf_dir), _quadtree(spark, sf_dir), images(spark, sf_dir), line_value=200, alpha=0.75)


def overlay_upscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.outlined(None, _quadtree(spark, sf_dir), images(spark, sf_dir), background="black", upscale=2)


def _pattern(make: Callable[..., DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(spark, 128, 3).select("image_id", "ch", "y", "x", r6("v", "v"))

    return query


def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.grid(spark, {"stride": {"start": 4, "stop": 8, "step": 2}, "topk": [16, 64], "backend": "dot"}, max_items=5)


def _coded(p: EncodeParams) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return batch.encode(batch.to_planes(gray(spark, sf_dir)), p).select("image_id", "n_leaves", "n_bytes", r6("mse", "mse"))

    return query


def ffc2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves read back from the bytes of code files; the same rows as best_match_quantized."""
    codes = batch.encode(batch.to_planes(gray(spark, sf_dir)), QUANTIZED)
    rows = batch.leaves(codes).select("image_id", "leaf_id", "y", "x", "block", "dom", "tf", F.posexplode("codes").alias("ch", "code"))
    return rows.select("image_id", "leaf_id", "y", "x", "block", "dom", "tf", "ch", "code.qs", "code.qo")


def encode_decode_e2e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images through code bytes and back, with size and quality."""
    pixels = colour(spark, sf_dir)
    planes = batch.to_planes(pixels)
    codes = batch.encode(planes, EncodeParams(min_block=4, max_block=16, use_quadtree=True, quantized=True, max_mse=0.005))
    quality = metrics.quality(pixels, batch.to_pixels(batch.decode(codes)))
    return codes.select("image_id", "n_leaves", "n_bytes").join(quality, "image_id").select("image_id", "n_leaves", "n_bytes", r6("psnr", "psnr"))


def size_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every code file and what its counts say it is."""
    codes = batch.encode(batch.to_planes(gray(spark, sf_dir)), QUADTREE)
    size = codefile.size_of(2, 49 + 25, 0, 1, False)
    return codes.select("image_id", "n_bytes", (F.lit(size) + F.col("n_leaves") * 18).cast("long").alias("expected"))


QUERIES: dict[str, Query] = {
    "mosaic_pixels": mosaic_pixels, "luma_rgb": luma_rgb, "gray_u8": gray_u8, "clamp_u8": clamp_u8, "pad_edge": pad_edge,
    "range_grid": range_grid, "domain_grid_even": domain_grid_even, "domain_grid_odd": domain_grid_odd, "downsample2x2": downsample2x2, "domains_odd": domains_odd,
    "transform_d4": _transformed(list(range(8))), "transform_shear": _transformed([12, 13, 14]), "transform_all15": _transformed(list(range(15))),
    "entropy_blocks": entropy_blocks, "variance_blocks": variance_blocks, "bucket_ids": bucket_ids, "bucket_hist": bucket_hist, "entropy_filter": entropy_filter, "max_domains": max_domains,
    "normalize_rows": normalize_rows, "query_l2": query_l2, "linreg_pairs": linreg_pairs, "tf_sums": tf_sums,
    "topk_dot": _topk(SEARCHED), "topk_dot_bucketed": _topk(BUCKETED),
    "best_match_identity": _leaves(IDENTITY), "best_match_quantized": _leaves(QUANTIZED), "best_match_rgb": _leaves(IDENTITY, colour), "best_match_topk": _leaves(SEARCHED), "best_match_bucketed": _leaves(BUCKETED), "best_match_snapped": _leaves(SNAPPED),
    "quant_dequant": quant_dequant, "s_sets": s_sets, "s_snap": s_snap, "lsh_probe": lsh_probe, "lsh_encode": lsh_encode, "pca_project": pca_project,
    "quadtree_leaves": _leaves(QUADTREE), "decode_iter1": _decoded(1), "decode_iter2": _decoded(2), "mse_psnr": mse_psnr, "code_size": code_size, "size_identity": size_identity,
    "edge_mask": _mask(1), "edge_mask_thick2": _mask(2), "overlay_blend": overlay_blend, "overlay_upscaled": overlay_upscaled,
    "synthetic_smooth": _pattern(synthetic.smooth), "synthetic_edges": _pattern(synthetic.edges), "param_grid": param_grid,
    "encode_arrow": _coded(IDENTITY), "ffc2_roundtrip": ffc2_roundtrip, "pca_lsh_encode": _coded(PRESETS["speed"]), "encode_decode_e2e": encode_decode_e2e,
}
