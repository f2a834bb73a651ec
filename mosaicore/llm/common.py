"""Shared folders, tables that cut lineage, and small helpers of the operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of this machine if Spark runs on it alone, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="mosaicore-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that this process wrote and has not discarded.
_written: list[str] = []


def written(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """df, written as a table in the shared folder and read again: later reads survive a lost executor.

    tasks: the most files, for a table whose rows are few and small. On a local disk, where Hadoop has no native library,
    an executor starts about three processes (chmod) for each file.
    """
    path = scratch(df.sparkSession, name)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(spark: SparkSession, *paths: str | None) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in filter(None, paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        if path in _written:
            _written.remove(path)


def tables_since(count: int = 0) -> list[str]:
    """The paths of written tables, without the first `count`."""
    return _written[count:]


def place_of(df: DataFrame) -> str | None:
    """Where a table that `written` returned lies."""
    return getattr(df, "_written_at", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows and bytes of an Arrow batch between Spark and its Python workers; texts may be long.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df; batches of its session become smaller where they may have more than BATCH_ROWS rows or BATCH_BYTES bytes.

    Spark reads both settings when a plan runs, so they stay in the session; they bound memory on both sides and change no result.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        size = re.fullmatch("([0-9]+)b?", now or "")
        if now is not None and not (size and 0 < int(size[1]) <= most):
            conf.set(key, str(most))
    return df


def tidied(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """each, after which the worker gives memory that it no longer uses back to the machine."""

    @wraps(each)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """doc_id="doc_id", text="text" and the like: only these columns, under these names.

    Names are matched exactly; other columns, also ones whose names the operators use, are left out.
    """
    return bounded(df).select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def first_by_hash(rows: DataFrame, most: int, total: int) -> list[Row]:
    """The first `most` rows by a hash of doc_id (then doc_id and the other columns), collected; total: their number, or more.

    Every task sends the driver up to `most` rows, so on a large table only those with small hashes are looked at: about four
    times `most` in all.  Should they be too few, all are.
    """
    hashed = rows.withColumn("_hash", F.xxhash64("doc_id"))
    first = lambda own: own.orderBy("_hash", *rows.columns).limit(most).drop("_hash").collect()
    if total > 16 * most:
        found = first(hashed.where(F.col("_hash") < F.lit(-(1 << 63) + (1 << 64) * 4 * most // total)))
        if len(found) == most:
            return found
    return first(hashed)


def code_points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def as_strings(column: pa.Array) -> list[str]:
    """The texts of a column, nulls as empty ones."""
    return ["" if x is None else x for x in column.to_pylist()]
