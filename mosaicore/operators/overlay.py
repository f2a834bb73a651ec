"""Outlines of leaves drawn over images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_mask(leaves: DataFrame, images: DataFrame, thickness: int = 1) -> DataFrame:
    """image_id, y, x of the pixels on edges of leaves (image_id, y, x, block).

    A leaf's edges are its first row and column and the row and column after its last; those
    at the image's own lower and right end fall away. Thickness t widens them by t - 1 in four directions.
    """
    run = lambda start: F.sequence(F.col(start), F.col(start) + F.col("block") - 1)
    rows = leaves.select("image_id", F.explode(F.array("y", F.col("y") + F.col("block"))).alias("ey"), "x", "block").select("image_id", "ey", F.explode(run("x")).alias("ex"))
    columns = leaves.select("image_id", F.explode(F.array("x", F.col("x") + F.col("block"))).alias("ex"), "y", "block").select("image_id", F.explode(run("y")).alias("ey"), "ex")
    size = images.select("image_id", "height", "width")
    mask = rows.unionByName(columns).distinct().join(size, "image_id").where("ey < height AND ex < width")
    if thickness > 1:
        steps = [(0, 0)] + [(s * k, 0) for k in range(1, thickness) for s in (1, -1)] + [(0, s * k) for k in range(1, thickness) for s in (1, -1)]
        moved = F.explode(F.array(*(F.struct((F.col("ey") + dy).alias("ey"), (F.col("ex") + dx).alias("ex")) for dy, dx in steps)))
        mask = mask.select("image_id", "height", "width", moved.alias("m")).select("image_id", "height", "width", "m.ey", "m.ex").where("ey >= 0 AND ex >= 0 AND ey < height AND ex < width")
    return mask.select("image_id", F.col("ey").cast("int").alias("y"), F.col("ex").cast("int").alias("x")).distinct()


def blended(gray: DataFrame, mask: DataFrame, line_value: int = 255, alpha: float = 1.0) -> DataFrame:
    """Bytes of grey (image_id, y, x, g) with the mask's pixels drawn in line_value at opacity alpha."""
    line, alpha = min(255, max(0, int(line_value))), min(1.0, max(0.0, alpha))
    drawn = F.floor(F.round(F.col("g") * (1.0 - alpha) + line * alpha, 9)).cast("int")
    rows = gray.join(mask.withColumn("on", F.lit(True)), ["image_id", "y", "x"], "left")
    return rows.select("image_id", "y", "x", F.when(F.col("on"), drawn).otherwise(F.col("g")).alias("g"))


def upscaled(gray: DataFrame, factor: int) -> DataFrame:
    """Every pixel as a square of factor x factor."""
    cells = gray.withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return cells.selectExpr("image_id", f"y * {factor} + dy AS y", f"x * {factor} + dx AS x", "g")


def outlined(pixels: DataFrame | None, leaves: DataFrame, images: DataFrame, *, background: str = "decode", thickness: int = 1, line_value: int = 255, alpha: float = 1.0, upscale: int = 1) -> DataFrame:
    """The grey overlay (image_id, y, x, g) of images (height, width, orig_height, orig_width) over decoded pixels or black."""
    from mosaicore.functions.pixels import clamp_u8
    from mosaicore.operators.blocks import gray_u8

    if background not in ("decode", "black"):
        raise ValueError("background must be decode or black")
    if background == "black":
        grid = images.select("image_id", "orig_width", F.explode(F.expr("sequence(0, orig_height - 1)")).alias("y"))
        gray = grid.select("image_id", "y", F.explode(F.expr("sequence(0, orig_width - 1)")).alias("x"), F.lit(0).alias("g"))
    else:
        gray = gray_u8(pixels.withColumn("v", clamp_u8(F.col("v")).cast("double")))
    mask = edge_mask(leaves, images, thickness)
    out = blended(gray, mask, line_value, alpha)
    return upscaled(out, upscale) if upscale > 1 else out
