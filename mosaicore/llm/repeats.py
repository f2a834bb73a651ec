"""Removal of long byte strings that occur more than once, by a run-length index.

A string of `least` bytes that starts at two places of the corpus, in one document or in two, is
removed at both.  Sorting all suffixes of a corpus is no distributed job, so the corpus is
first cut where equal strings meet again:

1. Of the 40-byte grams in every string of 200 bytes, the one with the least hash is the string's
   anchor (winnowing).  Equal strings have equal anchors at equal places, and the consecutive
   starts that share an anchor form a segment.  Segments, not strings, are dealt by anchor.
2. Anchors that occur once are done.  Equal segments collapse into one, with their count.
3. The distinct segments of the other anchors are indexed in blocks (`runindex.RunIndex`): a
   run-length Burrows-Wheeler transform with samples at run ends, in which the copies of a segment
   are one string whose rows count so many times; its matching statistics mark what occurs
   elsewhere.  All segments of an anchor are in one block.  Where an anchor has more than HOT
   distinct segments, each is cut, first by the 191 bytes round the anchor that some of its strings
   share, then, where that is not enough, by whole strings, and indexed by these: no task needs more than
   about HOT segments at a time, however frequent a passage is.
4. Marks go back to all places where a segment occurs, and to the documents.

Documents are read once: a table holds their compressed texts and their segments.  A text is
known by 128 bits of a hash of its bytes and doc_id; rows with equal ones lose the same.

Edge cases: null texts are empty; texts of fewer than `least` bytes lose nothing; rows that
repeat text and doc_id, or text without doc_id, count as separate places and lose all; a text of any length is
worked on in pieces that overlap; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicore.llm.bytestext import mix, prefix_hash, slice_hash, text_arrays
from mosaicore.llm.common import discard, pick, place_of, tidied, written
from mosaicore.llm.runindex import RunIndex

LEAST, GRAM = 200, 40
#: Bytes of segments that are indexed at a time; a single anchor's may be more.
BLOCK = 1 << 20
#: Starts of a long text that are worked on at a time.
PIECE = 1 << 22
#: Distinct segments of an anchor from which on they are cut, and the numbers of neighbouring strings that then stay together.
HOT, STEPS = 2000, (10, 1)
U64 = np.uint64
PLACE = 28  # bits of a place in a piece
KEY = ["ka", "kb"]
SEGMENT = pa.struct([("anchor", pa.int64()), ("segment", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("off", pa.int32())])


def text_keys(ids: list, raw: list[bytes]) -> np.ndarray:
    """128 bits, as two numbers, of each text with its doc_id."""
    found = [hashlib.blake2b(text, digest_size=16, salt=struct.pack("<q?", own or 0, own is None)).digest() for own, text in zip(ids, raw, strict=True)]
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of `width` places (two running minima over blocks of that size)."""
    n = len(x)
    size = -(-n // width) * width
    padded = np.concatenate([x, np.full(size - n, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, segment hash, first and end byte in the text, place of the anchor in the segment) of every segment of a slice."""
    starts = offsets[1:] - offsets[:-1] - least + 1  # possible starts of each text
    some = np.flatnonzero(starts > 0)
    none = np.zeros(0, np.int64)
    if not len(some):
        return none, none, none, none, none, none
    prefix = prefix_hash(data)
    place = np.arange(len(data) - GRAM + 1)
    gram = slice_hash(prefix, place, place + GRAM)
    key = (gram >> U64(PLACE) << U64(PLACE)) | place.astype(U64)
    anchor = (window_least(key, least - GRAM + 1) & U64((1 << PLACE) - 1)).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int8)
    np.add.at(valid, offsets[:-1][some], 1)
    np.add.at(valid, offsets[:-1][some] + starts[some], -1)
    start = np.flatnonzero(np.cumsum(valid)[:-1])
    own = anchor[start]
    cut = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(start, prepend=-9) != 1))
    first = start[cut]
    end = start[np.append(cut[1:], len(start)) - 1] + least
    at = own[cut]
    text = np.searchsorted(offsets, first, side="right") - 1
    # searchsorted finds the last of several texts that begin at one byte: the one that is not empty
    whole = mix(slice_hash(prefix, first, end) + (at - first).astype(U64))
    return text, gram[at].view(np.int64), whole.view(np.int64), first - offsets[text], end - offsets[text], at - first


def all_segments(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """As `segments`; a long text goes in pieces, each start in one of them."""
    if len(data) < PIECE + least:
        return segments(data, offsets, least)
    parts = []
    for n, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, b, PIECE):
            piece = data[at : min(b, at + PIECE + least - 1)]
            text, anchor, whole, lo, hi, off = segments(piece, np.array([0, len(piece)]), least)
            parts.append((text + n, anchor, whole, lo + at - a, hi + at - a, off))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def text_table(docs: DataFrame, least: int) -> DataFrame:
    """ka, kb, doc_id, n_bytes, the compressed bytes and the segments of every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for batch in batches:
            for row, data, offsets in text_arrays(batch.column(1)):
                n = len(offsets) - 1
                whole = data.tobytes()
                raw = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                ids = batch.column(0).slice(row, n)
                keys = text_keys(ids.to_pylist(), raw)
                packed = [codec.compress(x, asbytes=True) for x in raw]
                text, anchor, segment, lo, hi, off = all_segments(data, offsets, least)
                bounds = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
                found = pa.StructArray.from_arrays([pa.array(anchor), pa.array(segment), *(pa.array(x.astype(np.int32)) for x in (lo, hi, off))], fields=list(SEGMENT))
                columns = [pa.array(keys[:, 0]), pa.array(keys[:, 1]), ids, pa.array(np.diff(offsets)), pa.array(packed, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), found)]
                yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "doc_id", "n_bytes", "packed", "segments"])

    return docs.mapInArrow(tidied(each), "ka long, kb long, doc_id long, n_bytes long, packed binary, segments array<struct<anchor: long, segment: long, lo: int, hi: int, off: int>>")


def unpack(packed: bytes, n: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, n, asbytes=True) if n else b""


def indexed(rows: DataFrame, least: int) -> DataFrame:
    """anchor, segment and marks (first and end byte of what repeats, one after the other) of distinct segments.

    rows: anchor, segment, count, bytes; an anchor's rows are brought together and indexed in blocks.
    """

    def block(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        lengths = np.array([len(r[3]) for r in rows], np.int64)
        index = RunIndex(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), lengths, np.array([r[2] for r in rows], np.int64))
        marks = [[x for a, b in runs for x in (a, b + least)] for runs in index.long_matches(least)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(marks, pa.list_(pa.int32()))], names=["anchor", "segment", "marks"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield block(held)

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "segment")
    found = dealt.select("anchor", "segment", "count", "bytes").mapInArrow(tidied(each), "anchor long, segment long, marks array<int>")
    return found.where("size(marks) > 0")


def cut_segments(rows: DataFrame, step: int, least: int) -> DataFrame:
    """Parts of segments, `step` neighbouring strings each: part_anchor (of the bytes that these share), part, count, off, bytes; anchor, segment and at: whose, and where."""
    names = ["part_anchor", "part", "count", "off", "bytes", "anchor", "segment", "at"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
    number = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, segment, count, off, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                last = len(raw) - least  # starts run from 0 to last; a start's string has off - start bytes before the anchor
                for j in range(max(0, off - last) // step, off // step + 1):
                    first, end = max(0, off - (j + 1) * step + 1), min(last, off - j * step)
                    if first > end:
                        continue
                    shared = raw[off - j * step : off - (j + 1) * step + 1 + least]
                    own = raw[first : end + least]
                    out.append((number(struct.pack("<i", j) + shared), number(struct.pack("<i", off - first) + own), count, off - first, own, anchor, segment, first))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=names)

    return rows.select("anchor", "segment", "count", "off", "bytes").mapInArrow(tidied(each), "part_anchor long, part long, count long, off int, bytes binary, anchor long, segment long, at int")


def marked(rows: DataFrame, least: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """anchor, segment and marks of distinct segments (anchor, segment, count, off, bytes, a written table); a segment may have several rows."""
    if not steps:
        return indexed(rows, least)
    hot = written(rows.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot-anchors")
    if hot.isEmpty():
        return indexed(rows, least)
    parts = written(cut_segments(rows.join(hot, "anchor", "left_semi"), steps[0], least), "parts")
    distinct = parts.groupBy(F.col("part_anchor").alias("anchor"), F.col("part").alias("segment")).agg(F.sum("count").alias("count"), F.first("off").alias("off"), F.first("bytes").alias("bytes"))
    found = written(marked(written(distinct, "distinct-parts"), least, steps[1:]).withColumnsRenamed({"anchor": "part_anchor", "segment": "part"}), "part-marks")
    back = parts.join(found, ["part_anchor", "part"]).select("anchor", "segment", F.transform("marks", lambda x: x + F.col("at")).alias("marks"))
    return indexed(rows.join(hot, "anchor", "left_anti"), least).unionByName(back)


def segment_bytes(places: DataFrame, texts: DataFrame) -> DataFrame:
    """places (anchor, segment, count, off, ka, kb, lo, hi) with their bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "segment", "count", "off"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for packed, n, wanted in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = unpack(packed, n)
                for w in wanted:
                    for column, value in zip(rows, (*(w[x] for x in names), raw[w["lo"] : w["hi"]]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=[*names, "bytes"])

    by_text = places.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "segment", "count", "off", "lo", "hi")).alias("wanted"))
    # rows that repeat a key have one text: any of them serves
    own = texts.join(by_text, KEY).select(*KEY, "packed", "n_bytes", "wanted").dropDuplicates(KEY)
    return own.select("packed", "n_bytes", "wanted").mapInArrow(tidied(each), "anchor long, segment long, count long, off int, bytes binary")


def repeated_spans(texts: DataFrame, least: int) -> DataFrame:
    """ka, kb and spans (start * 2**32 + end, unordered, they may overlap) of each text that repeats something; texts: a written `text_table`."""
    found = texts.select(*KEY, F.explode("segments").alias("s")).select(*KEY, "s.*")
    per_anchor = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    per_anchor = written(per_anchor, "anchors")  # so that the join below is of two shuffles that Spark can split where an anchor is very frequent
    again = written(found.join(per_anchor, "anchor"), "repeated")
    discard(texts.sparkSession, place_of(per_anchor))
    distinct = again.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*KEY, "lo", "hi", "off")).alias("at")).select("anchor", "segment", "count", "at.*")
    rows = written(segment_bytes(distinct, texts.select(*KEY, "n_bytes", "packed")), "distinct")
    marks = written(marked(rows, least), "marks")
    discard(texts.sparkSession, place_of(rows))
    place = lambda k: (F.col("lo") + F.col("marks")[k]).cast("long") * F.lit(1 << 32) + (F.col("lo") + F.col("marks")[k + 1]).cast("long")
    spans = again.select("anchor", "segment", *KEY, "lo").join(marks, ["anchor", "segment"]).select(*KEY, F.explode(F.transform(F.sequence(F.lit(0), F.size("marks") - 2, F.lit(2)), place)).alias("span"))
    return spans.groupBy(*KEY).agg(F.collect_set("span").alias("spans"))


def merged(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[tuple[int, int]] = []
    for x in sorted(spans):
        a, b = x >> 32, x & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs) and kept (the remaining bytes) of every document."""
    docs = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = written(text_table(docs, least), "texts")
    spans = repeated_spans(texts, least)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                gone, kept = [], []
                for n, packed, found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    raw, runs, left, done = unpack(packed, n), merged(found or []), [], 0
                    for a, b in runs:
                        left.append(raw[done:a])
                        done = b
                    gone.append([{"start": a, "end": b} for a, b in runs])
                    kept.append(b"".join([*left, raw[done:]]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    rows = texts.select(*KEY, "doc_id", "n_bytes", "packed").join(spans, KEY, "left").select("doc_id", "n_bytes", "packed", "spans")
    return rows.mapInArrow(tidied(each), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digests(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs, least).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], least: int) -> list[tuple[int, int, str]]:
    """(removed, spans, checksum) of each text, by looking at every string; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - least + 1):
            seen[t[i : i + least]] = seen.get(t[i : i + least], 0) + 1
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                mark[i : i + least] = True
        gone = mark[:-1]
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], mark.astype(np.int8)])) == 1))
        out.append((int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out
