"""Best-fit packing with swap-based local search.

Documents are cut into pieces of at most `capacity` tokens and the pieces laid into as few
sequences of that capacity as can be found.  Pieces are dealt by hash to groups of bounded size;
rows that are equal are dealt like others, by their place in the table of pieces.
Each group starts from best fit as the pieces come, which leaves bins underfull.  Then documents move, or
change places one for one or two for one, between underfull bins so that the sum of squared
fills rises, until the fewest possible bins are left or no exchange helps; where that leaves more bins
than best fit in descending length does, the search starts again from that.  Further exchanges gather
the room that is left in the emptiest bin.  The groups' emptiest bins meet in fewer groups, whose search
starts from these bins as they are, so that a group's last bin costs nothing overall.

Edge cases: very long texts are cut, as any that are longer than a sequence; a null text is an empty one and has the end id alone; an empty table gives an empty
result; equal lengths are ordered by key and place; repeated rows are packed as often as they occur;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicore.llm.common import pick, tidied, written
from mosaicore.llm.tokens import encoder

#: Tokens and pieces that a group holds on average.
GROUP_TOKENS, GROUP_PIECES = 1 << 20, 1 << 15
#: The emptiest bins, to which an exchange looks first.
WIDE = 48
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the checksum of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for row, ids, counts in encode.texts(batch.column(1)):
                at = 0
                rows: list[list[int]] = [[], [], [], [], []]
                for doc, n in zip(batch.column(0)[row : row + len(counts)].to_pylist(), counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        part = own[start : start + capacity]
                        for column, value in zip(rows, (doc, k, start, len(part), zlib.crc32(part)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidied(cut), PIECES)


def best_fit(lengths: np.ndarray, capacity: int, descending: bool = True) -> np.ndarray:
    """The bin of each piece; pieces go, in descending length or as they come, where they leave least room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    has, bins = 0, 0  # has: bit r is set if some bin has room r
    out = np.empty(len(lengths), np.int64)
    for i in (np.argsort(-lengths, kind="stable") if descending else np.arange(len(lengths))).tolist():
        size = int(lengths[i])
        if fits := has >> size:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                has &= ~(1 << r)
        else:
            r, b = capacity, bins
            bins += 1
        out[i] = b
        if left := r - size:
            room[left].append(b)
            has |= 1 << left
    return out


def exchange(lengths: np.ndarray, bins: np.ndarray, capacity: int, moves: list[tuple[int, int]] | None = None) -> np.ndarray:
    """Local search from the given bins; stops at the fewest possible bins or at a local optimum, then gathers room in the emptiest bin.

    A step takes out of the donor one or two pieces and out of the receiver none, one or two (not
    two for two), so that the receiver gains d > 0 tokens, has room for them and the sum of
    squared fills rises, by 2 d (receiver - donor + d).  It takes the step that gains most with one of the WIDE
    emptiest bins, or, if there is none, with any other.  moves, if given, gets the numbers of pieces of each step.
    """
    bins = np.unique(bins, return_inverse=True)[1]
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    fewest = -(-int(lengths.sum()) // capacity)
    held: dict[int, list[int]] = {}
    for i in np.flatnonzero(fill[bins] < capacity).tolist():
        held.setdefault(int(bins[i]), []).append(i)
    count = int(np.count_nonzero(fill))

    def offers(b: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
        """What the bin can give: total lengths, numbers of pieces and pieces, the first nothing; one choice for each length."""
        by = {int(lengths[i]): i for i in held[b]}
        single = [(n, (i,)) for n, i in by.items()]
        pairs = {n + m: (i, j) for a, (n, (i,)) in enumerate(single) for m, (j,) in single[:a]}
        twice: dict[int, int] = {}
        for i in held[b]:
            n = int(lengths[i])
            if n in twice:
                pairs.setdefault(2 * n, (twice[n], i))
            twice[n] = i
        own = [(0, ()), *single, *pairs.items()]
        return np.array([n for n, _ in own], np.int64), np.array([len(p) for _, p in own]), [p for _, p in own]

    cache: dict[int, tuple] = {}

    def priced(b: int) -> tuple:
        if b not in cache:
            cache[b] = offers(b)
        return cache[b]

    def step(donor: int) -> bool:
        """The best exchange out of the donor, if any gains."""
        nonlocal count
        give, give_k, give_p = (x[1:] for x in priced(donor))
        others = sorted((b for b in held if b != donor), key=lambda b: (fill[b], b))
        best: tuple = (0, None)
        for part in (others[:WIDE], others[WIDE:]):
            for other in part:
                take, take_k, take_p = priced(other)
                d = give[:, None] - take[None, :]
                gain = np.where((d > 0) & (d <= capacity - fill[other]) & (give_k[:, None] + take_k[None, :] < 4), 2 * d * (int(fill[other]) - int(fill[donor]) + d), 0)
                at = int(gain.argmax())
                if gain.flat[at] > best[0]:
                    x, y = divmod(at, gain.shape[1])
                    best = (int(gain.flat[at]), (other, give_p[x], take_p[y], int(d[x, y])))
            if best[1] is not None:
                break
        if best[1] is None:
            return False
        other, out, back, moved = best[1]
        for pieces, source, target in ((out, donor, other), (back, other, donor)):
            for i in pieces:
                held[source].remove(i)
                held[target].append(i)
                bins[i] = target
        fill[donor] -= moved
        fill[other] += moved
        if moves is not None:
            moves.append((len(out), len(back)))
        for b in (donor, other):
            cache.pop(b, None)
            if not held[b] or fill[b] == capacity:  # full bins are done with
                count -= not held[b]
                held.pop(b)
        return True

    better = True
    while better and count > fewest:
        better = False
        for donor in sorted(held, key=lambda b: (fill[b], b)):
            while count > fewest and donor in held and step(donor):
                better = True
    if held:
        donor = min(held, key=lambda b: (fill[b], b))
        while donor in held and step(donor):
            pass
    return bins


def pack_lengths(lengths: np.ndarray, capacity: int, start: np.ndarray | None = None, moves: list[tuple[int, int]] | None = None) -> np.ndarray:
    """The bin of each piece, numbered from 0; the search starts from `start`, if that is given; never more bins than best fit in descending length has."""
    bins = exchange(lengths, best_fit(lengths, capacity, False) if start is None else start, capacity, moves)
    count = len(np.unique(bins))
    if count > -(-int(lengths.sum()) // capacity):
        other = best_fit(lengths, capacity)
        if len(np.unique(other)) < count:
            bins = exchange(lengths, other, capacity, moves)
    return np.unique(bins, return_inverse=True)[1]


def pack(pieces: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """pieces (with a column length) and sequence_id, offset: where each one lies.

    `keys` order pieces of one length.  The pieces are a written table, as they are read twice.
    """
    total, rows = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-total // GROUP_TOKENS), -(-rows // GROUP_PIECES))
    fields = pieces.schema

    def packed(source: DataFrame, n: int, base: int, again: bool) -> DataFrame:
        def each(frame: pd.DataFrame) -> pd.DataFrame:
            # as they come: in an order that the hash gives
            frame = frame.sort_values(["_dealt", "length", *keys], kind="stable", ignore_index=True)
            lengths = frame["length"].to_numpy(np.int64)
            bins = pack_lengths(lengths, capacity, np.unique(frame["sequence_id"], return_inverse=True)[1] if again else None)
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(lengths[order]) - lengths[order]
            opened = np.searchsorted(bins[order], np.arange(bins.max() + 1))
            offset = np.empty(len(frame), np.int64)
            offset[order] = before - before[opened][bins[order]]
            fill = np.bincount(bins, weights=lengths).astype(np.int64)
            open_ = (bins == fill.argmin()) & (fill.min() < capacity)
            return frame.assign(sequence_id=((base + frame["_group"].to_numpy(np.int64)) << 24) + bins, offset=offset, _open=open_)

        out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "sequence_id long", "offset long", "_open boolean", "_group int", "_dealt long"])
        dealt = source.withColumn("_dealt", F.xxhash64(F.col("sequence_id") if again else F.monotonically_increasing_id()))
        return dealt.withColumn("_group", F.pmod("_dealt", F.lit(n)).cast("int")).groupBy("_group").applyInPandas(each, out)

    names = [*fields.names, "sequence_id", "offset"]
    first = packed(pieces, groups, 0, False)
    if groups == 1:
        return first.select(names)
    first = written(first, "packed")
    open_tokens, open_rows = first.where("_open").agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    fewer = max(1, -(-open_tokens // GROUP_TOKENS), -(-open_rows // GROUP_PIECES))
    second = packed(first.where("_open"), fewer, groups, True)
    return first.where("not _open").select(names).unionByName(second.select(names))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return pack(written(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), ["doc_id", "piece", "ids_crc32"], capacity)
