"""MinHash fingerprints of texts.

A text's signature has, for each of 128 hash functions of a universal family (x -> the upper 32 bits of
a x + b modulo 2**64, a and b of 64 bits from a fixed seed), the least image of its 5-word shingles'
32-bit hashes.  The fingerprint writes the lower 16 bits of each as hexadecimal; the share of places where two fingerprints agree
estimates the Jaccard similarity of the shingle sets.

`near_duplicates` bands the signatures, joins the bands in Spark and verifies the pairs on the
full sets (see `neardup.classes`).  `with_edits` compares every text with an edited one.

Edge cases: null and empty texts, and those without words, have a fingerprint of f's, which is
like itself and nothing else; texts of fewer words have their whole sequence as the one shingle; null
doc_ids come first in document order, equal ones are ordered by text (rows of one id are one task's, read one
after the other); very long texts are read whole; a single document is its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicore.llm.bytestext import WHITE, Words, shingle_runs, text_arrays
from mosaicore.llm.common import pick, tidied, written
from mosaicore.llm.neardup import band_keys, classes, signature_table

PERMUTATIONS, SHINGLE = 128, 5
_rng = np.random.default_rng(1997)
A, B = _rng.integers(0, 1 << 64, (2, PERMUTATIONS), dtype=np.uint64)
NONE = np.uint32(0xFFFFFFFF)
#: Characters of texts that are worked on at a time in `with_edits`.
CHUNK = 1 << 19


def minima(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures (texts x permutations) of runs of 64-bit hashes; runs without any get NONE."""
    out = np.full((len(bounds) - 1, PERMUTATIONS), NONE)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        x = flat >> np.uint64(32)
        y, starts = np.empty_like(x), bounds[:-1][some]
        own = np.empty((PERMUTATIONS, len(starts)), np.uint32)
        for k in range(PERMUTATIONS):
            np.multiply(x, A[k], out=y)
            np.add(y, B[k], out=y)
            own[k] = np.minimum.reduceat(y, starts) >> np.uint64(32)  # the least product has the least upper bits
        out[some] = own.T
    return out


def signatures(texts: list[str] | pa.Array, n: int = SHINGLE) -> np.ndarray:
    """The signatures of some texts."""
    column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
    out = [minima(*shingle_runs(Words(data, offsets, WHITE), n)) for _, data, offsets in text_arrays(column)]
    return np.concatenate(out) if out else np.zeros((0, PERMUTATIONS), np.uint32)


def fingerprints(signature: np.ndarray) -> list[str]:
    """16 bits of each place, as hexadecimal."""
    raw = (signature & np.uint32(0xFFFF)).astype(">u2")
    return [row.tobytes().hex() for row in raw]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of places where the fingerprints of two arrays of signatures agree; a text without words is like such alone."""
    same = ((a ^ b) & np.uint32(0xFFFF) == 0).mean(axis=1)
    none_a, none_b = (a == NONE).all(axis=1), (b == NONE).all(axis=1)
    return np.where(none_a == none_b, same, 0.0)


def near_duplicates(docs: DataFrame, n: int = SHINGLE, share: int = 80, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles and component_id: classes of texts with a verified similarity of share per cent."""

    def keys(sets: list[np.ndarray]) -> np.ndarray:
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
        return band_keys(minima(np.concatenate(sets) if sets else np.zeros(0, np.uint64), bounds).astype(np.uint64), rows)

    return classes(written(signature_table(docs, n, keys), "signatures"), docs, n, share)


def ordered(docs: DataFrame) -> DataFrame:
    """bucket, tail, doc_id and text: documents dealt by ranges of doc_id, each range followed by the document after it (tail)."""
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = docs.select(F.col("doc_id").cast("double").alias("x"))
    cuts = sorted(set(ids.where("x is not null").approxQuantile("x", [k / parts for k in range(1, parts)], 0.1 / parts)))
    if not cuts:  # at most one id apart from nulls: one range
        cuts = [0.0]
    inner = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="x", outputCol="b", handleInvalid="keep")
    with_x = docs.withColumn("x", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
    dealt = inner.transform(with_x).select(F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("b") + 1).cast("int").alias("bucket"), "doc_id", "text")
    firsts = sorted((r.bucket, r.first) for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())  # a row per range
    after = [(b, firsts[(k + 1) % len(firsts)][1]) for k, (b, _) in enumerate(firsts)]
    last = spark.createDataFrame(after, "bucket int, after long")
    tail = docs.join(F.broadcast(last), F.col("doc_id").eqNullSafe(F.col("after"))).select("bucket", F.lit(1).alias("tail"), "doc_id", "text")
    rows = dealt.select("bucket", F.lit(0).alias("tail"), "doc_id", "text").unionByName(tail)
    return rows.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def with_edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its text with the last quarter replaced by the start of the next document's, and likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def digest(ids: list, texts: list[str], pairs: list[int]) -> pa.RecordBatch:
        """pairs: the rows whose next document is the row after them."""
        edited = []
        for i in pairs:
            cut = len(texts[i]) // 4
            edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
        sig = signatures(texts + edited)
        own, new, after = sig[pairs], sig[len(texts) :], sig[[i + 1 for i in pairs]]
        columns = ([ids[i] for i in pairs], [len(texts[i]) for i in pairs], [hashlib.sha256(e.encode()).hexdigest() for e in edited], fingerprints(own), fingerprints(new), likeness(own, new), likeness(own, after))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        pairs: list[int] = []
        size, last = 0, None  # last: (bucket, tail) of the row before
        for batch in batches:
            for bucket, tail, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if tail and last == (bucket, 1):
                    continue  # the next document's id occurs more than once; its first text counts
                if last == (bucket, 0):
                    pairs.append(len(ids) - 1)
                ids.append(doc)
                texts.append(text or "")
                size, last = size + len(texts[-1]), (bucket, tail)
                if size >= CHUNK:
                    if pairs:
                        yield digest(ids, texts, pairs)
                    ids, texts, pairs, size = ids[-1:], texts[-1:], [], 0
        if pairs:
            yield digest(ids, texts, pairs)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered(docs).mapInArrow(tidied(each), schema)
