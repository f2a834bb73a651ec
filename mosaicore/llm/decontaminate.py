"""Benchmark decontamination by Wu-Manber search for many word strings at once.

The strings are the windows of 13 consecutive words of every benchmark item (a shorter item is
one window); the letters of the search are words.  For the strings of one length, a block of up
to three words is looked up in a shift table: how far the search can go on without missing a
string.  A shift of zero leads to the bucket of strings that end in this block, and comparison
of their words, byte by byte, confirms an occurrence.  The texts of a batch are cut into runs of
windows and searched in step, one table look-up for all runs at a time.

Benchmark items go out in blocks of BLOCK_WINDOWS strings (about 600 bytes each on an executor), one
after the other: each is searched for in all texts, and an executor has only one in memory at a time.

Edge cases: null texts have no words; items without words or item_id are left out; an item that
occurs twice counts once, also where two strings overlap; item_ids are of any type; repeated documents
are searched each; a very long text is searched whole, in memory that is a few times its size; empty
tables give an empty result or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mosaicore.llm.bytestext import NOT_ALNUM, Words, mix, ragged, text_arrays
from mosaicore.llm.common import bounded, discard, pick, place_of, tidied, written

WINDOW, BLOCK, RUN = 13, 3, 256
#: Windows that are sent to the executors at a time.
BLOCK_WINDOWS = 200_000
#: A word, for that bound.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.A)


def block_hash(h: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words that end at each place (inclusive)."""
    x = h[end - size + 1].copy()
    for k in range(size - 2, -1, -1):
        x = mix(x) + h[end - k]
    return mix(x)


@dataclass
class Strings:
    """The strings of one length: words' hashes, bytes, items, and Wu-Manber's tables."""

    size: int
    hashes: np.ndarray  # strings x size
    raw: list[bytes]  # words joined by single spaces
    items: list[list[str]]

    def __post_init__(self) -> None:
        self.block = min(BLOCK, self.size)
        flat, n = self.hashes.ravel(), len(self.hashes)
        bits = max(16, int(np.ceil(np.log2(4 * n * self.size + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, self.size - self.block + 1, np.int32)
        base = np.arange(n) * self.size
        for end in range(self.block - 1, self.size):
            np.minimum.at(self.shift, block_hash(flat, base + end, self.block) & self.mask, self.size - 1 - end)
        last = block_hash(flat, base + self.size - 1, self.block)
        self.order = np.argsort(last, kind="stable")
        self.suffix = last[self.order]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, string) of each occurrence within one text of the slice."""
        lo, hi = words.bounds[:-1], words.bounds[1:]
        windows = np.maximum(hi - lo - self.size + 1, 0)
        runs = -(-windows // RUN)
        first = ragged(np.zeros(len(runs), np.int64), runs) * RUN + np.repeat(lo, runs)
        at = first + self.size - 1
        end = np.minimum(first + RUN, np.repeat(lo + windows, runs)) + self.size - 1
        places, strings = [], []
        while len(at):
            hashed = block_hash(words.hash, at, self.block)
            step = self.shift[hashed & self.mask]
            if (zero := step == 0).any():
                here, own = at[zero], hashed[zero]
                a, b = np.searchsorted(self.suffix, own), np.searchsorted(self.suffix, own, side="right")
                which = self.order[ragged(a, b - a)]
                start = np.repeat(here, b - a) - self.size + 1
                for k in range(self.size - self.block):  # the first words must agree too
                    same = words.hash[start + k] == self.hashes[which, k]
                    start, which = start[same], which[same]
                places.append(start)
                strings.append(which)
            at = at + np.maximum(step, 1)
            going = at < end
            at, end = at[going], end[going]
        start, which = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, strings))
        if len(start):
            data = words.data.tobytes()
            good = np.fromiter((b" ".join([data[words.start[k] : words.end[k]] for k in range(i, i + self.size)]) == self.raw[j] for i, j in zip(start.tolist(), which.tolist(), strict=True)), bool, len(start))
            start, which = start[good], which[good]
        return start, which


def compile_strings(items: list[tuple[str, str]], window: int) -> list[Strings]:
    """The strings of some items by their length."""
    by: dict[int, dict[bytes, tuple[np.ndarray, list[str]]]] = {}
    for row, data, offsets in text_arrays(pa.array([text for _, text in items], pa.string())):
        words = Words(data, offsets, NOT_ALNUM)
        raw = words.data.tobytes()
        for k in range(words.n_docs):
            a, b = int(words.bounds[k]), int(words.bounds[k + 1])
            size = min(window, b - a)
            for i in range(a, b - size + 1) if size else ():
                key = b" ".join([raw[words.start[j] : words.end[j]] for j in range(i, i + size)])
                own = by.setdefault(size, {}).setdefault(key, (words.hash[i : i + size], []))[1]
                if not own or own[-1] != items[row + k][0]:
                    own.append(items[row + k][0])
    return [Strings(size, np.stack([h for h, _ in x.values()]), list(x), [own for _, own in x.values()]) for size, x in sorted(by.items())]


def blocks(benchmark: DataFrame, window: int) -> Iterator[list[Strings]]:
    """The benchmark's strings, at most about BLOCK_WINDOWS at a time; the next block is built when it is asked for."""
    held: list[tuple[str, str]] = []
    n = 0
    rows = pick(benchmark, item_id="item_id", text="text").where("item_id is not null and text is not null")
    for item, text in rows.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        held.append((item, text))
        n += max(1, len(WORD.findall(text)) - window + 1)
        if n >= BLOCK_WINDOWS:
            yield compile_strings(held, window)
            held, n = [], 0
    if held:
        yield compile_strings(held, window)


def hits(column: pa.Array, tables: list[Strings], window: int = WINDOW) -> Iterator[tuple[int, Words, np.ndarray, list[set[str]], np.ndarray]]:
    """(first row, words, which words are hit, items of each text, which texts hold a whole window) for slices of a column."""
    for row, data, offsets in text_arrays(column):
        words = Words(data, offsets, NOT_ALNUM)
        edge = np.zeros(len(words.start) + 1, np.int32)
        found: list[set[str]] = [set() for _ in range(words.n_docs)]
        whole = np.zeros(words.n_docs, bool)
        for t in tables:
            start, which = t.find(words)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + t.size, -1)
            docs = np.searchsorted(words.bounds, start, side="right") - 1
            whole[docs] |= t.size == window
            for doc, j in set(zip(docs.tolist(), which.tolist(), strict=True)):
                found[doc].update(t.items[j])
        yield row, words, np.cumsum(edge[:-1]) > 0, found, whole


def free_name(columns: list[str], name: str) -> str:
    while name in columns:
        name += "_"
    return name


def searched(rows: DataFrame, text: str, benchmark: DataFrame, window: int, name: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, final: StructType | None = None) -> tuple[DataFrame, bool]:
    """rows with a struct `name` beside its columns (n_words, hit, items and whole), and whether any item is shorter than a window.

    finish, if given, turns batches of such rows into batches of the schema `final`, in the pass that finds the last hits.

    hit has start and end of each run of hit words, one after the other; whole says that a full window occurs.
    One block of the benchmark is in memory at a time: the rows are written between one block and the next.
    """
    kind = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("whole", pa.bool_())])
    spark_kind = "struct<n_words: long, hit: array<long>, items: array<string>, whole: boolean>"
    out = bounded(rows).withColumn(name, F.lit(None).cast(spark_kind))
    at, schema = rows.columns.index(text), out.schema
    source = blocks(benchmark, window)
    tables, short = next(source, []), False
    while True:
        short |= any(t.size < window for t in tables)
        sent = rows.sparkSession.sparkContext.broadcast(tables)
        tables = next(source, None)
        last = finish if tables is None else None

        def each(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, words, hit, found, whole in hits(batch.column(at), sent.value, window):
                    own = []
                    any_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.bounds]) > 0
                    before = batch.column(batch.num_columns - 1).slice(row, words.n_docs).to_pylist()
                    for k, old in enumerate(before):
                        a, b = int(words.bounds[k]), int(words.bounds[k + 1])
                        runs = old["hit"] if old else []
                        if any_hit[k]:
                            mark = hit[a:b].copy()
                            for s, e in zip(runs[::2], runs[1::2], strict=True):
                                mark[s:e] = True
                            runs = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))).tolist()
                        own.append({"n_words": b - a, "hit": runs, "items": sorted({*(old["items"] if old else ()), *found[k]}), "whole": bool(whole[k]) or bool(old and old["whole"])})
                    part = batch.slice(row, words.n_docs)
                    part = pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(own, kind)], names=batch.schema.names)
                    yield last(part) if last else part

        out = out.mapInArrow(tidied(each), schema if last is None else final)
        if tables is None:
            return out, short
        out, before = written(out, "searched"), out
        discard(rows.sparkSession, place_of(before))
        sent.destroy()


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hit (start and end of each run of hit words, one after the other), items and whole per document."""
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found, _ = searched(rows, "text", benchmark, window, "found")
    return found.select("doc_id", "found.*")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated per document."""
    found = search(docs, benchmark, window)
    odd = F.filter("hit", lambda _, i: i % 2 == 1)
    even = F.filter("hit", lambda _, i: i % 2 == 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    n_hit = total(odd) - total(even)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def without_words(text: str, runs: list[int]) -> str:
    """text without the runs of its words: the start and end of each, one after the other."""
    ((_, data, offsets),) = text_arrays(pa.array([text], pa.string()))
    words = Words(data, offsets, NOT_ALNUM)
    raw, done, out = text.encode(), 0, []
    for first, end in zip(runs[::2], runs[1::2], strict=True):
        out.append(raw[done : words.start[first]])
        done = int(words.end[end - 1])
    return b"".join([*out, raw[done:]]).decode()


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, whole_windows: bool = False) -> DataFrame:
    """The documents of which less than a twentieth of the words is hit, without these words, with all their columns.

    whole_windows: a document goes, too, as soon as one full window occurs in it, however long it is; only occurrences
    of items shorter than a window are then judged by the twentieth and cut out below it.
    Where words go, what is left is searched again, until nothing is hit; n_chars, if there is one, is counted anew.
    """
    columns = docs.columns
    text_at, count_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    name, more = free_name(columns, "found"), free_name(columns, "again")
    final = docs.withColumn(more, F.lit(False)).schema

    def decided(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = list(batch.columns[:-1])
        seen = batch.column(batch.num_columns - 1).to_pylist()
        n_hit = [sum(x["hit"][1::2]) - sum(x["hit"][::2]) for x in seen]
        bad = [n > 0 and (20 * n >= x["n_words"] or whole_windows and x["whole"]) for n, x in zip(n_hit, seen, strict=True)]
        cut = [n > 0 and not b for n, b in zip(n_hit, bad, strict=True)]
        if any(cut):
            texts = own[text_at].to_pylist()
            counts = own[count_at].to_pylist() if count_at is not None else None
            for k in np.flatnonzero(cut).tolist():
                texts[k] = without_words(texts[k], seen[k]["hit"])
                if counts is not None:
                    counts[k] = len(texts[k])
            own[text_at] = pa.array(texts, own[text_at].type)
            if counts is not None:
                own[count_at] = pa.array(counts, own[count_at].type)
        return pa.RecordBatch.from_arrays([*own, pa.array(cut, pa.bool_())], names=final.names).filter(pc.invert(pa.array(bad, pa.bool_())))

    done: list[DataFrame] = []
    while True:
        out, short = searched(docs, "text", benchmark, window, name, decided, final)
        if whole_windows and not short:  # nothing is cut, so nothing is left to search again
            done.append(out.drop(more))
            break
        out = written(out, "decontaminated")
        rest = out.where(F.col(more))
        if rest.isEmpty():
            done.append(out.drop(more))
            break
        done.append(out.where(~F.col(more)).drop(more))
        docs = rest.drop(more)
    kept = done[0]
    for part in done[1:]:
        kept = kept.unionByName(part)
    return kept


def items_digest(items: set) -> str:
    """The checksum of item ids as `contamination` gives it."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
