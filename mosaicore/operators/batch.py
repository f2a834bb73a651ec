"""Whole images through the dense kernels (the engine "arrow"): no shuffle, one image in memory at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicore.operators import kernels
from mosaicore.params import EncodeParams
from mosaicore.sources.codefile import dump, load
from mosaicore.sources.imagefile import PLANES


def to_planes(pixels: DataFrame) -> DataFrame:
    """A pixel table to one row per image (PLANES)."""
    cells = pixels.groupBy("image_id").agg((F.max("ch") + 1).alias("channels"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.sort_array(F.collect_list(F.struct("ch", "y", "x", "v"))).alias("c"))
    return cells.select("image_id", F.col("image_id").cast("string").alias("name"), F.col("channels").cast("int"), F.col("height").cast("int"), F.col("width").cast("int"), F.col("c.v").alias("data"))


def to_pixels(planes: DataFrame) -> DataFrame:
    """PLANES to a pixel table."""
    rows = planes.select("image_id", "height", "width", F.posexplode("data").alias("k", "v"))
    return rows.selectExpr("image_id", "cast(k div (height * width) AS int) AS ch", "cast((k div width) % height AS int) AS y", "cast(k % width AS int) AS x", "v")


def images_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    """(the other columns, channels x height x width) of each row of PLANES, from Arrow's own buffer."""
    at = batch.schema.names.index("data")
    names = [n for n in batch.schema.names if n != "data"]
    others = [batch.column(n).to_pylist() for n in names]
    data = batch.column(at)
    offsets, values = data.offsets.to_numpy(), data.values.to_numpy(zero_copy_only=False)
    for k, own in enumerate(zip(*others, strict=True)):
        row = dict(zip(names, own, strict=True))
        yield row, values[offsets[k] : offsets[k + 1]].reshape(row["channels"], row["height"], row["width"])


def encode(planes: DataFrame, p: EncodeParams) -> DataFrame:
    """image_id, name, code (the bytes of a code file), n_leaves, n_bytes and mse (mean error of the leaves) of every image."""
    p.checked()  # bad parameters fail here, not in a task

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, image in images_of(batch):
                code = kernels.encode(image, p)
                data = dump(code)
                weight = code.pool_blocks[code.leaf_pool].astype(float) ** 2
                error = float((code.leaf_mse * weight).sum() / weight.sum())
                yield pa.RecordBatch.from_pydict({"image_id": [row["image_id"]], "name": [row["name"]], "code": [data], "n_leaves": [len(code.leaf_yx)], "n_bytes": [len(data)], "mse": [error]})

    return planes.mapInArrow(each, "image_id long, name string, code binary, n_leaves long, n_bytes long, mse double")


def decode(codes: DataFrame, iterations: int | None = 8) -> DataFrame:
    """PLANES of codes (image_id, name, code); None takes each file's own hint for the iterations."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, name, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = load(data)
                image = kernels.decode(own, own.iterations_hint if iterations is None else iterations)
                c, h, w = image.shape
                yield pa.RecordBatch.from_pydict({"image_id": [image_id], "name": [name], "channels": pa.array([c], pa.int32()), "height": pa.array([h], pa.int32()), "width": pa.array([w], pa.int32()), "data": [image.ravel()]})

    return codes.select("image_id", "name", "code").mapInArrow(each, PLANES)


def leaves(codes: DataFrame) -> DataFrame:
    """image_id, leaf_id, y, x, block, dom, tf, codes (s, o, qs, qo by channel) of codes."""
    pair = pa.list_(pa.struct([("s", pa.float64()), ("o", pa.float64()), ("qs", pa.int32()), ("qo", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, data in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                c = load(data)
                n, values = len(c.leaf_yx), c.values()
                rows = [[{"s": float(s), "o": float(o), "qs": int(q[0]) if c.quantized else None, "qo": int(q[1]) if c.quantized else None} for (s, o), q in zip(v, raw, strict=True)] for v, raw in zip(values, c.codes, strict=True)]
                columns = [pa.array([image_id] * n, pa.int64()), pa.array(np.arange(n)), *(pa.array(x, t) for x, t in ((c.leaf_yx[:, 0], pa.int32()), (c.leaf_yx[:, 1], pa.int32()), (c.pool_blocks[c.leaf_pool], pa.int32()), (c.leaf_dom, pa.int64()), (c.leaf_tf, pa.int32()))), pa.array(rows, pair)]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "leaf_id", "y", "x", "block", "dom", "tf", "codes"])

    return codes.select("image_id", "code").mapInArrow(each, "image_id long, leaf_id long, y int, x int, block int, dom long, tf int, codes array<struct<s: double, o: double, qs: int, qo: int>>")
