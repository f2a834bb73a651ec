"""Encoding and decoding as declarative plans over pixel tables (the engine "sql").

Every step is a join, an aggregate or a window partitioned by image; search and least squares are one step in Arrow
(`operators.match`). It is the plan to read and to test against; `operators.batch` runs whole images through dense kernels instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicore.functions.pixels import clip, normalised, unit
from mosaicore.operators.blocks import dims, domain_planes, downsample, pad_to_multiple, range_planes
from mosaicore.operators.features import described, kept_domains
from mosaicore.operators.match import best_match
from mosaicore.operators.search import RANGE
from mosaicore.operators.transforms import expanded
from mosaicore.params import EncodeParams
from mosaicore.plans.scratch import cut

#: dy and dx are the corner of the leaf's domain, which its number alone gives only where no domain is left out.
LEAF = "image_id, y, x, block, dom, tf, dy, dx, codes, mse"


def kept_pool(pixels: DataFrame, p: EncodeParams, block: int, size: DataFrame | None = None) -> DataFrame:
    """image_id, dom, bucket, y, x, a (luma) and chans of the domains of a block size, before transforms."""
    return kept_domains(described(domain_planes(pixels, block, p.stride, size), p.bucket_count), p.entropy_thresh, p.max_domains, p.seed + block)


def build_pool(pixels: DataFrame, p: EncodeParams, block: int, size: DataFrame | None = None) -> DataFrame:
    """image_id, entry, dom, tf, bucket, y, x, proxy and chans (transformed) of a block size."""
    rows = expanded(kept_pool(pixels, p, block, size), block, p.transforms, "a", nested=("chans",))
    entry = (F.col("dom") * len(p.transforms) + F.col("tf_pos")).cast("long")
    return rows.select("image_id", entry.alias("entry"), "dom", "tf", "bucket", "y", "x", normalised(F.col("a")).alias("proxy"), "chans")


def range_queries(pixels: DataFrame, p: EncodeParams, block: int) -> DataFrame:
    """image_id, y, x, bucket, q and chans of every range block."""
    return described(range_planes(pixels, block), p.bucket_count).select(*RANGE, "bucket", unit(F.col("a")).alias("q"), "chans")


def encode(pixels: DataFrame, p: EncodeParams) -> DataFrame:
    """The leaves of all images: LEAF. A quadtree goes level by level, all images together."""
    p = p.checked()
    size = image_table(pixels, p.max_block)
    padded = pad_to_multiple(pixels, p.max_block, size.select("image_id", F.col("orig_height").alias("height"), F.col("orig_width").alias("width")))
    if len(p.levels) > 1:  # every level reads the pixels again, and the leaves of the one before
        padded, size = cut(padded), cut(size)
    out, open_ = None, None
    for block in p.levels:
        queries = described(range_planes(padded, block), p.bucket_count)
        if open_ is not None:
            queries = queries.join(open_, RANGE, "left_semi")
        leaves = best_match(queries, kept_pool(padded, p, block, size), p, block)
        if block == p.levels[-1]:
            done = leaves
        else:
            leaves = cut(leaves)
            done = leaves.where(F.col("mse") <= p.max_mse)
            half = block // 2
            split = leaves.where(F.col("mse") > p.max_mse).select("image_id", F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (0, half) for dx in (0, half)))).alias("k"))
            open_ = split.select("image_id", "k.y", "k.x")
        out = done if out is None else out.unionByName(done)
    return out


def leaf_order(leaves: DataFrame, max_block: int) -> DataFrame:
    """Leaves with leaf_id: tiles row by row, within one depth first (upper left, upper right, lower left, lower right)."""
    bits = F.lit(0).cast("long")
    for k in range(max_block.bit_length() - 1):
        for column, place in (("x", 2 * k), ("y", 2 * k + 1)):
            bits = bits + F.shiftleft(F.shiftright(F.col(column), k).bitwiseAND(F.lit(1)), place).cast("long")
    order = W.partitionBy("image_id").orderBy(F.expr(f"y div {max_block}"), F.expr(f"x div {max_block}"), bits)
    return leaves.withColumn("leaf_id", (F.row_number().over(order) - 1).cast("long"))


def means(pixels: DataFrame) -> DataFrame:
    """Means of the 2 x 2 pixels from each place on (image_id, ch, y, x, v)."""
    near = F.explode(F.array(*(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x")) for dy in (0, 1) for dx in (0, 1))))
    cells = pixels.select("image_id", "ch", near.alias("k"), "v").where("k.y >= 0 AND k.x >= 0").select("image_id", "ch", "k.y", "k.x", "v")
    return cells.groupBy("image_id", "ch", "y", "x").agg((F.sum("v") * 0.25).alias("v"))


def decode_step(pixels: DataFrame, sources: DataFrame, stride: int = 2) -> DataFrame:
    """One application of the map: pixels (image_id, ch, y, x, v) by sources (image_id, ch, y, x, sy, sx, s, o)."""
    small = (means(pixels) if stride % 2 else downsample(pixels)).withColumnsRenamed({"y": "sy", "x": "sx"})
    rows = sources.join(small, ["image_id", "ch", "sy", "sx"], "left")
    return rows.select("image_id", "ch", "y", "x", clip(F.col("s") * F.coalesce("v", F.lit(0.0)) + F.col("o"), 0, 1).alias("v"))


def pixel_sources(leaves: DataFrame, stride: int) -> DataFrame:
    """Where each pixel of the leaves takes its value from, by the corner of the leaf's domain; null for zero fill.

    For even strides a place in the image of half size, for odd ones the first of four pixels in the image itself.
    """
    from mosaicore.operators.transforms import gather

    sizes = [r[0] for r in leaves.select("block").distinct().collect()]  # a few block sizes
    step = "2 * " if stride % 2 else ""
    corner = lambda c: c if stride % 2 else f"{c} div 2"
    out = None
    for block in sorted(sizes):
        tables = F.array(*(F.array(*(F.lit(-1 if s is None else s) for s in gather(block, t))) for t in range(15)))
        rows = leaves.where(F.col("block") == block).select("image_id", "y", "x", "dy", "dx", "codes", F.posexplode(tables[F.col("tf")]).alias("p", "src"))
        rows = rows.selectExpr(
            "image_id", "posexplode(codes) AS (ch, code)", f"cast(y + p div {block} AS int) AS y", f"cast(x + p % {block} AS int) AS x",
            f"if(src < 0, null, cast({corner('dy')} + {step}(src div {block}) AS int)) AS sy", f"if(src < 0, null, cast({corner('dx')} + {step}(src % {block}) AS int)) AS sx",
        )
        rows = rows.select("image_id", "ch", "y", "x", "sy", "sx", "code.s", "code.o")
        out = rows if out is None else out.unionByName(rows)
    return out


def decode(leaves: DataFrame, images: DataFrame, stride: int, iterations: int = 8) -> DataFrame:
    """Pixels after so many steps from black, cropped to orig_height and orig_width of images.

    A few steps are one plan; from three on each step is checkpointed, so plans stay small. Leaves are
    checkpointed, as every step reads them: the encoder behind them runs once.
    """
    sources = pixel_sources(cut(leaves), stride)
    state = sources.select("image_id", "ch", "y", "x", F.lit(0.0).alias("v"))
    for k in range(iterations):
        state = decode_step(state, sources, stride)
        if iterations > 2 and k < iterations - 1:
            state = cut(state)
    crop = images.select("image_id", "orig_height", "orig_width")
    return state.join(crop, "image_id").where("y < orig_height AND x < orig_width").select("image_id", "ch", "y", "x", "v")


def image_table(pixels: DataFrame, block: int) -> DataFrame:
    """image_id, height and width after padding, orig_height, orig_width, channels."""
    return dims(pixels).selectExpr("image_id", f"cast(ceil(height / {block}) * {block} AS int) AS height", f"cast(ceil(width / {block}) * {block} AS int) AS width", "height AS orig_height", "width AS orig_width", "channels")
