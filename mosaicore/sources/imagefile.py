"""Image files: Spark's image source to planes, resizing, and PNG as a sink."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, orig. One row per image; data: doubles in the order channel, y, x.
PLANES = "image_id long, name string, channels int, height int, width int, data array<double>"


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with the kernel widened when shrinking; channels x height x width."""
    for axis, size in ((1, height), (2, width)):
        old = image.shape[axis]
        if old == size:
            continue
        scale = old / size
        reach = max(scale, 1.0)
        centre = (np.arange(size) + 0.5) * scale
        weight = np.maximum(0, 1 - np.abs((np.arange(old)[None, :] + 0.5 - centre[:, None]) / reach))
        weight /= weight.sum(axis=1, keepdims=True)
        image = np.moveaxis(np.tensordot(weight, image, axes=(1, axis)), 0, axis)
    return image


def fitted(height: int, width: int, max_side: int | None) -> tuple[int, int]:
    """The sides after shrinking the longer one to max_side, if it is longer."""
    if max_side is None or max(height, width) <= max_side:
        return height, width
    scale = max_side / max(height, width)
    return (max_side, max(1, round(width * scale))) if height >= width else (max(1, round(height * scale)), max_side)


def relative(name: Column, root: str) -> Column:
    """A file's path below the root, without its suffix; the name alone if the root is the file."""
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    top = re.sub("^[a-z]+:/+", "/", root).rstrip("/") + "/"
    own = F.when(F.startswith(plain(name), F.lit(top)), F.substr(plain(name), F.lit(len(top) + 1))).otherwise(F.regexp_extract(name, "([^/]*)$", 1))
    return F.regexp_replace(own, r"\.[^./]*$", "")


def read_images(spark: SparkSession, path: str, mode: str | None = None, max_side: int | None = 2048, invalid: str = "raise") -> DataFrame:
    """PLANES of all images below a path. mode: "L", "RGB", or None: colour for three bands or more, else grey.

    A file that cannot be read as an image raises an error that names it; invalid="drop" leaves such files out.
    """
    if invalid not in ("raise", "drop"):
        raise ValueError("invalid must be raise or drop")
    if mode not in (None, "L", "RGB"):
        raise ValueError("mode must be L or RGB")
    files = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", str(invalid == "drop").lower()).load(path)
    files = files.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if (row["height"] or 0) <= 0:
                    raise ValueError(f"cannot read {row['origin']} as an image")
                raw = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
                planes = np.moveaxis(raw[:, :, 2::-1] if row["nChannels"] >= 3 else raw[:, :, :1], 2, 0) / 255.0  # Spark has blue first
                if mode == "L" and len(planes) == 3:
                    planes = np.round(np.tensordot((0.299, 0.587, 0.114), planes, axes=1)[None] * 255) / 255
                if mode == "RGB" and len(planes) == 1:
                    planes = np.repeat(planes, 3, axis=0)
                planes = resize(planes, *fitted(*planes.shape[1:], max_side))
                yield pa.RecordBatch.from_pydict({"name": [row["origin"]], "channels": pa.array([len(planes)], pa.int32()), "height": pa.array([planes.shape[1]], pa.int32()), "width": pa.array([planes.shape[2]], pa.int32()), "data": [planes.ravel()]})

    planes = files.mapInArrow(each, "name string, channels int, height int, width int, data array<double>")
    return planes.select(F.xxhash64("name").alias("image_id"), *planes.columns)


def resized(planes: DataFrame, height: int, width: int) -> DataFrame:
    """PLANES with every image brought to the given sides."""

    from mosaicore.operators.batch import images_of

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, image in images_of(batch):
                image = resize(image, height, width)
                yield pa.RecordBatch.from_pydict({"image_id": [row["image_id"]], "name": [row["name"]], "channels": pa.array([row["channels"]], pa.int32()), "height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32()), "data": [image.ravel()]})

    return planes.select("image_id", "name", "channels", "height", "width", "data").mapInArrow(each, PLANES)


def png(image: np.ndarray) -> bytes:
    """A PNG file of bytes (channels x height x width, one channel or three)."""
    if image.ndim != 3 or len(image) not in (1, 3):
        raise ValueError("an image has one channel or three")
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.moveaxis(image.astype(np.uint8), 0, 2).reshape(image.shape[1], -1)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", image.shape[2], image.shape[1], 8, 0 if len(image) == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def save_bytes(image: np.ndarray) -> np.ndarray:
    """0..1 to bytes, cut off."""
    return np.clip(image * 255, 0, 255).astype(np.uint8)


def to_png(planes: DataFrame) -> DataFrame:
    """PLANES to (name, code): PNG files for the "ffc2" writer with the option suffix=".png"."""

    from mosaicore.operators.batch import images_of

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, image in images_of(batch):
                yield pa.RecordBatch.from_pydict({"name": [row["name"]], "code": [png(save_bytes(image))]})

    return planes.mapInArrow(each, "name string, code binary")
