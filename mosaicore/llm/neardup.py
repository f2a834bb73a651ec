"""Near-duplicate classes: banded signatures, star-shaped candidate links, confirmed on full sets.

`one_permutation` makes a text's signature: its shingle hashes fall into bins, each bin keeps its
least, and an empty bin copies from a full one that a universal hash of bin and attempt points
to (optimal densification).  Bands of the signature are the buckets' keys.

`classes` works on any such table of keys:

1. Texts with equal shingle sets become one class at once, by a 128-bit fingerprint of the set.
2. In each bucket the smallest id is the hub, and only the star of links from it is a candidate;
   a bucket of m classes gives m - 1 pairs, not m squared.
3. A pair is confirmed by the Jaccard similarity of the full sets, after a test of their sizes.
4. Components of confirmed links are found by alternating stars.
5. A hub need not be like two members that are like each other.  So each bucket whose members are in
   several components is searched once more: the members outside its largest component against all,
   block against block, inside tasks that give out links only.  Only members of one bucket meet, and
   those of the largest component are not copied.

Hot buckets are joined by sort-merge joins that Spark can split.  Texts to be compared meet under
(hub, salt), so that a hub of any number of links is spread over tasks, and stream through with
one hub's set in memory.  Pairs with a similarity of exactly 0.8 share a bucket with a probability of
1 - 3e-6; from there on nothing is lost.

Edge cases: null and empty texts have no set and are linked with nothing; a text of fewer words
than a shingle has its whole sequence as one; very long texts are read whole; rows without doc_id are left
out of `classes`; rows that repeat a doc_id are documents of their own, but share that id's links where it
stands for a class; of equal ids and sets any row may stand for the others; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicore.llm.bytestext import WHITE, Words, mix, shingle_hashes, text_arrays
from mosaicore.llm.common import pick, tidied, written
from mosaicore.llm.components import components

BANDS, ROWS, SALTS = 32, 5, 64
#: Texts of a block of a bucket, and columns of an incidence matrix.
BLOCK, COLUMNS = 250, 8192
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
PRIME = 2_147_483_647
#: Documents whose keys make a file of a table that has a row for each key or fewer.
FILE_DOCS = 8_000


def one_permutation(sets: list[np.ndarray], bins: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (texts x bins) of sorted distinct hashes; a text without any has EMPTY throughout."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = doc * bins + ((flat >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))  # hashes are sorted, so a cell's first is its least
    own = np.full(len(sets) * bins, EMPTY)
    own[cell[first]] = flat[first]
    full = (own != EMPTY).reshape(len(sets), bins)
    own = own.reshape(len(sets), bins)
    out = own.copy()
    rows, cols = np.nonzero(~full & full.any(axis=1, keepdims=True))
    rng = np.random.default_rng(20_170_806)
    while len(rows):
        a, b = int(rng.integers(1, PRIME)), int(rng.integers(0, PRIME))
        source = (a * (cols + 1) + b) % PRIME % bins
        hit = full[rows, source]
        out[rows[hit], cols[hit]] = own[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bands = signatures.shape[1] // rows
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    for k in range(rows):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + signatures[:, k : bands * rows : rows])
    return x


def set_prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart: two sums of mixed hashes."""
    with np.errstate(over="ignore"):
        return tuple(np.array([mix(s ^ salt).sum(dtype=np.uint64) for s in sets], np.uint64) for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)))


def texts_sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets) for slices of a column of texts."""
    for row, data, offsets in text_arrays(column):
        yield row, shingle_hashes(Words(data, offsets, WHITE), n)


def signature_table(docs: DataFrame, n: int, keys_of: Callable[[list[np.ndarray]], np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b and keys (an array; empty for empty sets) of every document."""
    keys_of = keys_of or (lambda sets: band_keys(one_permutation(sets)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in texts_sets(batch.column(1), n):
                sizes = np.array([len(s) for s in sets], np.int64)
                keys = keys_of(sets).astype(np.uint64).view(np.int64)
                width = keys.shape[1]
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, width, 0))]).astype(np.int32)
                a, b = set_prints(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[row : row + len(sets)], pa.array(sizes), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[sizes > 0].ravel()))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "keys"],
                )

    rows = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(tidied(each), "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, share: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets have 100 * intersection >= share * union."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_sets = None, []
        for batch in batches:
            ids, others = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good: tuple[list, list] = ([], [])
            for row, sets in texts_sets(batch.column(2), n):
                for a, b, own in zip(ids[row : row + len(sets)], others[row : row + len(sets)], sets, strict=True):
                    if b is None:  # the hub's own text comes before what it is compared with
                        if a != hub:
                            hub, hub_sets = a, []
                        hub_sets.append(own)
                    elif a == hub and len(own):
                        for s in hub_sets:
                            both = len(np.intersect1d(s, own, assume_unique=True))
                            if 100 * both >= share * (len(s) + len(own) - both):
                                good[0].append(a)
                                good[1].append(b)
                                break
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in good], names=["a", "b"])

    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    hubs = pairs.select("a", "salt").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = hubs.unionByName(pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "text"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(tidied(each), "a long, b long").distinct()


def block_links(ids: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], share: int) -> list[tuple[int, int]]:
    """One confirmed link for each pair of components that a link joins.

    Pairs are those between the two sides, or all if there is one side. Intersections are counted by
    products of incidence matrices over the shingles that occur more than once, some columns at a time.
    """
    words, counts = np.unique(np.concatenate(sets), return_counts=True)
    words = words[counts > 1]
    sizes = np.array([len(s) for s in sets])
    row, column = [], []
    for i, own in enumerate(sets):
        at = np.searchsorted(words, own)
        at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == own)] if len(words) else at[:0]
        row.append(np.full(len(at), i))
        column.append(at)
    row, column = np.concatenate(row), np.concatenate(column)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left = np.flatnonzero(sides == sides.min())
    right = np.flatnonzero(sides == sides.max())
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(words), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, len(words) - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part[left] @ part[right].T
    both = both.astype(np.int64)
    link = (100 * both >= share * (sizes[left][:, None] + sizes[right][None, :] - both)) & (labels[left][:, None] != labels[right][None, :])
    x, y = np.nonzero(link)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(left[x].tolist(), right[y].tolist(), strict=True):
        out.setdefault((min(labels[i], labels[j]), max(labels[i], labels[j])), (int(ids[i]), int(ids[j])))
    return list(out.values())


def files(documents: DataFrame) -> int:
    """How many files the tables of so many documents' keys are given at most."""
    return max(1, -(-documents.count() // FILE_DOCS))


def bucket_links(members: DataFrame, texts: DataFrame, n: int, share: int, tasks: int | None = None) -> DataFrame:
    """Links (a, b) between components within each bucket (members: key, rep, component), every pair that may be one looked at.

    Left are the members outside the bucket's largest component, right are all; a task has a block of each (or all of a
    bucket that is no larger than a block) and gives links alone, so pairs are never rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (rep, component, side, set) of the group at hand
        group = None

        def found() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            ids, labels, sides = (np.array([h[k] for h in held]) for k in range(3))
            return block_links(ids, labels, sides, [h[3] for h in held], share)

        for batch in batches:
            out: list[tuple[int, int]] = []
            groups = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3, 6)), strict=True))
            for row, sets in texts_sets(batch.column(6), n):
                for k, own in enumerate(sets, row):
                    if groups[k] != group:
                        out += found()
                        held.clear()
                        group = groups[k]
                    held.append((*rows[k], own))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = found()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("key")
    sizes = sizes.agg(F.count(F.lit(1)).alias("c"), F.sum("k").alias("m"), F.max(F.struct("k", "component")).alias("top")).where("c > 1")
    blocks = lambda x: F.ceil(x / BLOCK).cast("int")
    sizes = written(sizes.select("key", F.col("top.component").alias("top"), blocks(F.col("m")).alias("rights"), blocks(F.col("m") - F.col("top.k")).alias("lefts")), "open-buckets", tasks)
    own = members.join(sizes, "key").withColumn("hash", F.xxhash64("rep", "key"))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    part = lambda count: F.pmod("hash", F.col(count)).cast("int")
    columns = ["rep", "component"]
    small = own.where("rights = 1").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), *columns, F.lit(0).alias("side"))
    left = own.where("rights > 1 and component != top").select("key", part("lefts").alias("i"), every("rights").alias("j"), *columns, F.lit(0).alias("side"))
    right = own.where("rights > 1").select("key", every("lefts").alias("i"), part("rights").alias("j"), *columns, F.lit(1).alias("side"))
    rows = small.unionByName(left).unionByName(right).join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.select("key", "i", "j", *columns, "side", "text").mapInArrow(tidied(each), "a long, b long").distinct()


def classes(signatures: DataFrame, docs: DataFrame, n: int, share: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document with a doc_id.

    `signatures` is a written `signature_table`, as it is read several times.
    """
    tasks = files(signatures)  # of what is grouped; joins on hot keys keep their tasks
    signatures = signatures.where("doc_id is not null")
    sets = signatures.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("rep"))
    sets = written(sets.select("set_a", "set_b", F.col("rep.doc_id").alias("rep"), F.col("rep.n_shingles").alias("n"), F.col("rep.keys").alias("keys")), "sets", tasks)
    member = sets.select("rep", "n", F.explode("keys").alias("key"))
    hub = member.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "hub")
    hub = written(hub, "hubs", tasks)  # so that the join is of two shuffles that Spark can split where a bucket is hot
    stars = written(member.join(hub, "key").select("key", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "stars")
    alike = lambda x, y: 100 * F.least(x, y) >= share * F.greatest(x, y)  # noqa: E731  else the sets' sizes rule the pair out
    candidates = stars.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"), alike(F.col("n"), F.col("hub_n")).alias("alike")).distinct()
    candidates = written(candidates, "candidates", tasks)
    pairs = candidates.where("alike").select("a", "b")
    texts = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    wanted = stars.select(F.col("rep").alias("doc_id")).distinct()
    near = written(texts.join(wanted, "doc_id", "left_semi"), "near-texts")
    component = components(confirmed(pairs, near, n, share), tasks).select(F.col("node").alias("rep"), "component")
    # a hub need not be like two members that are like each other: buckets of several components are searched again
    label = stars.select("rep").distinct().join(component, "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
    label = written(label, "labels", tasks)
    more = bucket_links(stars.select("key", "rep").join(label, "rep"), near, n, share, tasks)
    # what these links join are components: a graph of its own, with few nodes
    ends = more.join(label.select(F.col("rep").alias("a"), F.col("component").alias("x")), "a").join(label.select(F.col("rep").alias("b"), F.col("component").alias("y")), "b")
    wider = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), tasks).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    found = label.join(wider, "component", "left").select(F.col("rep").alias("node"), F.coalesce("wider", "component").alias("component"))
    of_rep = sets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("c"))
    out = signatures.select("doc_id", "n_shingles", "set_a", "set_b").join(of_rep, ["set_a", "set_b"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, n: int = 5, share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest id of its component) of every document."""
    out = classes(written(signature_table(docs, n), "signatures"), docs, n, share)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, n: int = 5, share: int = 80) -> DataFrame:
    """The documents without those that a smaller doc_id stands for, with all their columns.

    A doc_id that occurs more than once goes only if none of its rows is kept.  Rows without doc_id, and those of one
    doc_id, have an identity of their own among such rows: of each class of theirs one row stays.
    """
    signatures = written(signature_table(docs, n), "signatures")
    gone = classes(signatures, docs, n, share).groupBy(F.col("doc_id").alias("_gone")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept")).where("not kept").select("_gone")
    gone = written(gone, "gone", files(signatures))  # read several times
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    shared = written(left.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_shared")).count().where("count > 1").select("_shared"), "shared-ids")
    row = "_row"
    while row in docs.columns:
        row += "_"
    odd = left.where(F.col("doc_id").isNull()).unionByName(left.join(shared, left["doc_id"] == shared["_shared"], "left_semi"))
    odd = written(odd.withColumn(row, F.monotonically_increasing_id()), "odd-rows")
    if odd.isEmpty():
        return left
    found = near_duplicates(pick(odd, doc_id=row, text="text"), n, share).select(F.col("doc_id").alias("_kept"), "component_id")
    first = found.join(pick(odd, _own=row, _id="doc_id"), F.col("_kept") == F.col("_own")).groupBy("_id", "component_id").agg(F.min("_own").alias("_first"))
    rest = left.where(F.col("doc_id").isNotNull()).join(shared, left["doc_id"] == shared["_shared"], "left_anti")
    return rest.unionByName(odd.join(first, odd[row] == first["_first"], "left_semi").drop(row))
