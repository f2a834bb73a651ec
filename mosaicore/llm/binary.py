"""Token ids in Arrow IPC files of fixed-size-list batches.

Documents are dealt by ranges of doc_id and sorted, so that the files, one after the other, hold
the ids of all documents in ascending doc_id order.  A file is a table of equal-length sequences
(`ids`: fixed-size list of unsigned integers; `mask`: fixed-size list of booleans, false only in
the padding of a file's last sequence), written in batches of equal size: sequence k of a file
lies at a place that follows from k alone, and a memory-mapped file gives it without a copy.  A
second Arrow file beside it lists where each document starts.

Ids take 16 bits if the vocabulary allows, else 32.  A file gets its name only when it is
complete, so a task that is run again replaces nothing that others may be reading.

Edge cases: null texts are empty and have the end id alone; very long texts are encoded whole; null doc_ids
come first; equal doc_ids are ordered by the first 16 characters of the text, further ties by their place in
the table; an empty table gives no files and an empty result; other columns are ignored.  A task that fails deletes its unfinished
files (named .*); those of an executor that is lost stay behind unread.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicore.llm.common import pick, scratch, tidied, written
from mosaicore.llm.tokens import encoder

SEQUENCE, BATCH = 2048, 128
#: Ranges that equal rows may be dealt to.
SPREAD = 256


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder given as a URI or a local path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class SequenceWriter:
    """One Arrow file of sequences and its index of documents."""

    def __init__(self, folder: str, dtype: np.dtype, length: int, batch: int):
        self.fs, self.path = place(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.name, self.length, self.batch, self.dtype = uuid.uuid4().hex, length, batch, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(f"{self.path}/.{self.name}.{kind}") for kind in ("ids", "docs")]
        self.ids, self.docs = (pa.ipc.new_file(sink, schema) for sink, schema in zip(self.sinks, (self.schema, self.index_schema), strict=True))
        self.held, self.n_held, self.n_ids, self.n_docs = [], 0, 0, 0

    def abort(self) -> None:
        """Deletes what is half written."""
        for sink, kind in zip(self.sinks, ("ids", "docs"), strict=True):
            sink.close()
            self.fs.delete_file(f"{self.path}/.{self.name}.{kind}")

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their ids, end ids included."""
        starts = self.n_ids + np.cumsum(counts) - counts
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts)], schema=self.index_schema))
        self.n_docs += len(doc_ids)
        self.n_ids += len(ids)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= self.length * self.batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        size = self.length * self.batch
        full = len(ids) if last else len(ids) // size * size
        for at in range(0, full, size):
            part = ids[at : min(at + size, full)]
            padded = -(-len(part) // self.length) * self.length
            mask = np.arange(padded) < len(part)
            part = np.concatenate([part, np.zeros(padded - len(part), self.dtype)])
            self.ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)], schema=self.schema))
        self.held = [ids[full:]]
        self.n_held = len(ids) - full

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        for writer, sink in zip((self.ids, self.docs), self.sinks, strict=True):
            writer.close()
            sink.close()
        for kind in ("docs", "ids"):
            self.fs.move(f"{self.path}/.{self.name}.{kind}", f"{self.path}/{self.name}.{kind}.arrow")
        return self.name, self.n_docs, self.n_ids


class SequenceReader:
    """Random access to the sequences and documents of one file."""

    def __init__(self, folder: str, name: str):
        system, path = place(folder)
        open_file = (lambda p: pa.memory_map(p)) if isinstance(system, fs.LocalFileSystem) else system.open_input_file
        self.ids = pa.ipc.open_file(open_file(f"{path}/{name}.ids.arrow"))
        self.docs = pa.ipc.open_file(open_file(f"{path}/{name}.docs.arrow"))
        self.length = self.ids.schema.field("ids").type.list_size
        self.batch = self.ids.get_batch(0).num_rows if self.ids.num_record_batches else 1

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence k: its ids, without a copy, and its mask."""
        batch = self.ids.get_batch(k // self.batch)
        row = k % self.batch
        return batch.column(0).values.to_numpy()[row * self.length : (row + 1) * self.length], batch.column(1)[row].values

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from start on; only the batches that hold them are touched."""
        size, parts = self.length * self.batch, []
        while n:
            k, at = divmod(start, size)
            part = self.ids.get_batch(k).column(0).values.to_numpy()[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, length: int = SEQUENCE, batch: int = BATCH) -> DataFrame:
    """Writes the files; the manifest: file, first_doc, n_docs, n_ids and base, the ids before the file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, first = encoder(tokenizer), None, None
        top = max(end_id, encode.tokenizer.get_vocab_size() - 1)
        try:
            for part in batches:
                doc_ids = part.column(0)
                for row, ids, counts in encode.texts(part.column(1)):
                    if writer is None:
                        first = doc_ids[row].as_py()
                        writer = SequenceWriter(folder, np.dtype(np.uint16 if top < 1 << 16 else np.uint32), length, batch)
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    writer.add(doc_ids[row : row + len(counts)].to_pylist(), counts + 1, ids)
        except BaseException:
            if writer is not None:
                writer.abort()
            raise
        if writer is not None:
            name, n_docs, n_ids = writer.close()
            part = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_pydict({"file": [name], "part": part, "first_doc": pa.array([first], pa.int64()), "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    # ranges of doc_id, then of how the text begins, then of the row's place: rows that share an id, or have none, are dealt, too
    ordered = rows.withColumn("_place", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 16).asc_nulls_first(), "_place")
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 16).asc_nulls_first(), "_place").select("doc_id", "text")
    files = written(ordered.mapInArrow(tidied(write), "file string, part int, first_doc long, n_docs long, n_ids long"), "token-files").collect()  # a row per file
    base, rows = 0, []
    for f in sorted(files, key=lambda f: f.part):  # ranges are in order
        rows.append((f.file, f.first_doc, f.n_docs, f.n_ids, base))
        base += f.n_ids
    return docs.sparkSession.createDataFrame(rows, "file string, first_doc long, n_docs long, n_ids long, base long")


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = SequenceReader(folder, name)
                for k in range(reader.docs.num_record_batches):
                    index = reader.docs.get_batch(k)
                    starts, counts = (index.column(c).to_numpy().tolist() for c in (1, 2))
                    sums = [zlib.crc32(reader.span(a, n).astype("<u4")) for a, n in zip(starts, counts, strict=True)]
                    yield pa.RecordBatch.from_arrays([index.column(0), pa.array(np.array(starts, np.int64) + base), index.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.select("file", "base").repartition(files).mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """All documents written to files in the shared folder and read back."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_documents(write_tokens(docs, tokenizer, end_id, folder), folder)
