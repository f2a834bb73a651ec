"""The binary code file: packing, unpacking, and a data source (format "ffc2") to read and write it.

Little-endian throughout. Header of 44 bytes: magic, height, width, original height and width,
channels, pools, leaves, iterations hint, flags (bit 0: quantised); s_clip, o_min, o_max. Then the
arrays of pools, domains and leaves, and the codes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from mosaicore.operators.kernels import Code
from mosaicore.sources.imagefile import relative

# Fixed values of the format.
MAGIC = b"FFC2"
HEADER, QUANTISER = struct.Struct("<4sIIIIBHIIB"), struct.Struct("<fff")


def arrays(pools: int, domains: int, leaves: int, channels: int, quantized: bool) -> list[tuple[str, str, tuple[int, ...]]]:
    """Name, type and shape of each array in the order of the file."""
    return [
        ("pool_blocks", "<u2", (pools,)), ("pool_strides", "<u2", (pools,)), ("pool_offsets", "<u4", (pools + 1,)), ("domain_yx", "<u2", (domains, 2)),
        ("leaf_yx", "<u2", (leaves, 2)), ("leaf_pool", "u1", (leaves,)), ("leaf_dom", "<u4", (leaves,)), ("leaf_tf", "u1", (leaves,)), ("codes", "u1" if quantized else "<f4", (leaves, channels, 2)),
    ]


def dump(code: Code) -> bytes:
    leaves, pools = len(code.leaf_yx), len(code.pool_blocks)
    if code.codes is None or len(code.codes) != leaves:
        raise ValueError("a code for every leaf is needed")
    head = HEADER.pack(MAGIC, code.height, code.width, code.orig_height, code.orig_width, code.channels, pools, leaves, code.iterations_hint, int(code.quantized))
    out = [head, QUANTISER.pack(code.s_clip, code.o_min, code.o_max)]
    for name, kind, shape in arrays(pools, len(code.domain_yx), leaves, code.channels, code.quantized):
        value = np.asarray(getattr(code, name))
        if kind[-2] == "u" and value.size and (value.min() < 0 or value.max() > np.iinfo(kind).max):
            raise OverflowError(f"{name} does not fit the file")
        out.append(value.astype(kind).reshape(shape).tobytes())
    return b"".join(out)


def load(data: bytes) -> Code:
    """The code in some bytes; what follows it is ignored."""
    if len(data) < HEADER.size + QUANTISER.size:
        raise ValueError("truncated")
    magic, h, w, oh, ow, channels, pools, leaves, hint, flags = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("bad magic")
    s_clip, o_min, o_max = QUANTISER.unpack_from(data, HEADER.size)
    at, found, domains = HEADER.size + QUANTISER.size, {}, 0
    for name, kind, shape in arrays(pools, 0, leaves, channels, bool(flags & 1)):
        shape = (domains, 2) if name == "domain_yx" else shape
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        if at + size > len(data):
            raise ValueError("truncated")
        found[name] = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)
        at += size
        if name == "pool_offsets":
            domains = int(found[name][-1])
    wide = {k: v.astype(np.int64) for k, v in found.items() if k != "codes"}
    return Code(h, w, oh, ow, channels, **wide, codes=found["codes"], quantized=bool(flags & 1), s_clip=s_clip, o_min=o_min, o_max=o_max, iterations_hint=hint)


def size_of(pools: int, domains: int, leaves: int, channels: int, quantized: bool) -> int:
    """Bytes of a file, from its counts."""
    return 48 + 8 * pools + 4 * domains + leaves * (10 + 2 * channels * (1 if quantized else 4))


SCHEMA = "name string, code binary"


class _Files(InputPartition):
    """Files by path and name: the path below the folder, without the suffix."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Files]:
        root = Path(self.path)
        if root.is_dir():
            found = [(str(p), str(p.relative_to(root).with_suffix(""))) for p in sorted(root.rglob("*.ffc"))]
        else:
            found = [(str(root), root.stem)]
        return [_Files(found[k : k + 64]) for k in range(0, len(found), 64)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple[str, bytes]]:
        for path, name in partition.files:
            data = Path(path).read_bytes()
            load(data)  # a file that cannot be read fails here, with its reason
            yield name, data


class _Message(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def write(self, rows: Iterator) -> _Message:
        """Files get their names only when complete; a task that runs again writes the same ones."""
        root = Path(self.path)
        root.mkdir(parents=True, exist_ok=True)
        done = []
        for row in rows:
            target = root / f"{row['name']}{self.suffix}"
            target.parent.mkdir(parents=True, exist_ok=True)
            half = target.with_suffix(target.suffix + ".part")
            half.write_bytes(bytes(row["code"]))
            half.replace(target)
            done.append(str(target))
        return _Message(done)

    def abort(self, messages: list) -> None:
        for m in messages:
            for path in m.paths if m else []:
                Path(path).unlink(missing_ok=True)


class CodeFiles(DataSource):
    """spark.read.format("ffc2").load(path) and df.write.format("ffc2").mode("append").save(path); rows are (name, code).

    For paths that all executors mount; stores that only Spark reads go through binaryFile (`read_codes`).
    """

    @classmethod
    def name(cls) -> str:
        return "ffc2"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("suffix", ".ffc"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark's readers give those of files."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(own).toString()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CodeFiles)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """name (the path below the folder, without the suffix) and code of all .ffc files below a path, by Spark's own reader."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ffc").option("recursiveFileLookup", "true").load(path)
    return files.select(relative(F.col("path"), qualified(spark, path)).alias("name"), F.col("content").alias("code"))
