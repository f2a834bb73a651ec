"""Grids of range and domain blocks over pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicore.functions.pixels import GRAY, LUMA, weighted


def dims(pixels: DataFrame) -> DataFrame:
    """image_id, height, width, channels."""
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), (F.max("ch") + 1).alias("channels"))


def luma(pixels: DataFrame) -> DataFrame:
    """One channel: grey as it is, colour by weights. Images of one channel and of three may be mixed."""
    grouped = pixels.groupBy("image_id", "y", "x").agg(F.count(F.lit(1)).alias("n"), F.sum(weighted(F.col("ch"), F.col("v"), LUMA)).alias("w"), F.max("v").alias("g"))
    return grouped.select("image_id", F.lit(0).alias("ch"), "y", "x", F.when(F.col("n") == 1, F.col("g")).otherwise(F.col("w")).alias("v"))


def gray_u8(pixels: DataFrame) -> DataFrame:
    """Bytes of grey (image_id, y, x, g) from bytes-like values (v in 0..255)."""
    summed = pixels.groupBy("image_id", "y", "x").agg(F.count(F.lit(1)).alias("n"), F.sum(weighted(F.col("ch"), F.col("v"), GRAY)).alias("w"), F.max("v").alias("v"))
    return summed.select("image_id", "y", "x", F.floor(F.least(F.greatest(F.when(F.col("n") == 1, F.col("v")).otherwise(F.round("w", 9)), F.lit(0.0)), F.lit(255.0))).cast("int").alias("g"))


def pad_to_multiple(pixels: DataFrame, block: int, size: DataFrame | None = None) -> DataFrame:
    """Edges repeated to the right and below until both sides are multiples of block (size: `dims`, if known)."""
    size = (dims(pixels) if size is None else size).selectExpr("image_id", "height AS _h", "width AS _w")
    # only border pixels are copied: the last row and column give rise to the new ones
    up = lambda side: f"cast(ceil({side} / {block}) * {block} AS int)"
    rows = pixels.join(size, "image_id").select("image_id", "ch", F.explode(F.expr(f"if(y = _h - 1, sequence(y, {up('_h')} - 1), array(y))")).alias("y"), "x", "v", "_w")
    return rows.select("image_id", "ch", "y", F.explode(F.expr(f"if(x = _w - 1, sequence(x, {up('_w')} - 1), array(x))")).alias("x"), "v")


def range_grid(images: DataFrame, block: int) -> DataFrame:
    """image_id, idx, y, x of the tiles of images (image_id, height, width), row by row."""
    grid = images.where(f"height >= {block} AND width >= {block}").select("image_id", "width", F.explode(F.expr(f"sequence(0, height - {block}, {block})")).alias("y"), F.lit(0).alias("z"))
    grid = grid.select("image_id", "width", "y", F.explode(F.expr(f"sequence(0, width - {block}, {block})")).alias("x"))
    return grid.selectExpr("image_id", f"cast((y div {block}) * (width div {block}) + x div {block} AS long) AS idx", "y", "x")


def domain_grid(images: DataFrame, block: int, stride: int) -> DataFrame:
    """image_id, idx, y, x of the windows of twice the block, every stride pixels, row by row."""
    two = 2 * block
    grid = images.where(f"height >= {two} AND width >= {two}").select("image_id", "width", F.explode(F.expr(f"sequence(0, height - {two}, {stride})")).alias("y"))
    grid = grid.select("image_id", "width", "y", F.explode(F.expr(f"sequence(0, width - {two}, {stride})")).alias("x"))
    return grid.selectExpr("image_id", f"cast((y div {stride}) * ((width - {two}) div {stride} + 1) + x div {stride} AS long) AS idx", "y", "x")


def _arrays(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, p, v) to blocks: an array a of v in the order of p."""
    return cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("c")).select(*keys, F.col("c.v").alias("a"))


def _planes(cells: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Cells (keys, ch, p, v) to blocks of all channels: chans, an array for each, and a, their luma. One shuffle."""
    n = block * block
    rows = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ch", "p", "v"))).alias("c")).select(*keys, F.col("c.v").alias("v"))
    rows = rows.select(*keys, F.transform(F.sequence(F.lit(1), F.size("v"), F.lit(n)), lambda i: F.slice("v", i, n)).alias("chans"))
    mixed = F.zip_with(F.zip_with(F.col("chans")[0], F.col("chans")[1], lambda r, g: r * LUMA[0] + g * LUMA[1]), F.col("chans")[2], lambda m, b: m + b * LUMA[2])
    return rows.withColumn("a", F.when(F.size("chans") == 1, F.col("chans")[0]).otherwise(mixed))


def _range_cells(pixels: DataFrame, b: int) -> DataFrame:
    return pixels.selectExpr("image_id", "ch", f"cast(y div {b} * {b} AS int) AS y", f"cast(x div {b} * {b} AS int) AS x", f"(y % {b}) * {b} + x % {b} AS p", "v")


def ranges(pixels: DataFrame, block: int) -> DataFrame:
    """image_id, ch, y, x, a: the tiles of every channel."""
    return _arrays(_range_cells(pixels, block), ["image_id", "ch", "y", "x"])


def range_planes(pixels: DataFrame, block: int) -> DataFrame:
    """image_id, y, x, chans, a (luma): the tiles of every image."""
    return _planes(_range_cells(pixels, block), ["image_id", "y", "x"], block)


def downsample(pixels: DataFrame) -> DataFrame:
    """Means of 2 x 2 pixels; sides must be even."""
    cells = pixels.selectExpr("image_id", "ch", "cast(y div 2 AS int) AS y", "cast(x div 2 AS int) AS x", "v")
    return cells.groupBy("image_id", "ch", "y", "x").agg((F.sum("v") * 0.25).alias("v"))


def _domain_cells(pixels: DataFrame, block: int, stride: int, size: DataFrame | None) -> DataFrame:
    """image_id, ch, dom, oy, ox, p, v.

    For even strides the image is downsampled once and windows slide over the half; for odd ones
    each window takes the means of its own pixels.
    """
    size = (dims(pixels) if size is None else size).selectExpr("image_id", "height", "width")
    two = 2 * block
    if stride % 2 == 0:
        source, reach, step, per = downsample(pixels), block, stride // 2, 1
    else:
        source, reach, step, per = pixels, two, stride, 2
    # the windows k that hold a coordinate c: k * step <= c < k * step + reach
    first = lambda c: f"greatest(0, cast(ceil(({c} - {reach} + 1) / {step}) AS int))"
    last = lambda c, side: f"least({c} div {step}, ({side} - {two}) div {stride})"
    cells = source.join(size, "image_id").where(f"height >= {two} AND width >= {two}")
    for c, side in (("y", "height"), ("x", "width")):
        cells = cells.where(f"{first(c)} <= {last(c, side)}").selectExpr("*", f"explode(sequence({first(c)}, {last(c, side)})) AS w{c}")
    cells = cells.selectExpr("image_id", "ch", f"cast(wy * ((width - {two}) div {stride} + 1) + wx AS long) AS dom", f"cast(wy * {stride} AS int) AS oy", f"cast(wx * {stride} AS int) AS ox", f"((y - wy * {step}) div {per}) * {block} + (x - wx * {step}) div {per} AS p", "v")
    return cells if per == 1 else cells.groupBy("image_id", "ch", "dom", "oy", "ox", "p").agg((F.sum("v") * 0.25).alias("v"))


def domains(pixels: DataFrame, block: int, stride: int, size: DataFrame | None = None) -> DataFrame:
    """image_id, ch, dom, y, x, a: the downsampled windows of every channel (size: `dims`, if known)."""
    return _arrays(_domain_cells(pixels, block, stride, size), ["image_id", "ch", "dom", "oy", "ox"]).withColumnsRenamed({"oy": "y", "ox": "x"})


def domain_planes(pixels: DataFrame, block: int, stride: int, size: DataFrame | None = None) -> DataFrame:
    """image_id, dom, y, x, chans, a (luma): the downsampled windows of every image."""
    return _planes(_domain_cells(pixels, block, stride, size), ["image_id", "dom", "oy", "ox"], block).withColumnsRenamed({"oy": "y", "ox": "x"})
