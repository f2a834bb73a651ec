"""Token ids of whole texts from a tokenizer file, each distinct piece encoded once.

Texts are cut before a white-space byte that stands alone between two other characters, and
between a letter and a mark other than the apostrophe.  Both kinds of tokenizer used here split
there in any case (their patterns never carry a piece over such a place, and what they
normalise does not look across it), so the ids of a text are those of its pieces, one after the
other.  A worker remembers the pieces it has seen, up to a bound.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from mosaicore.llm.bytestext import WHITE, byte_class, prefix_hash, ragged, slice_hash, text_arrays

#: Pieces and ids that a worker remembers before it starts afresh.
MEMO_PIECES, MEMO_IDS = 1_000_000, 5_000_000
#: Pieces that the tokenizer is given at a time.
AT_ONCE = 1 << 13
#: ASCII letters, and ASCII that is neither letter, digit, white space nor apostrophe.
LETTER = byte_class((65, 90), (97, 122))
MARK = byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def load(path: str):
    """The tokenizers library's tokenizer of a file; special tokens' strings in texts are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of a slice of texts."""
    at = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 2:
        white, high, letter, mark = WHITE[data], data >= 0x80, LETTER[data], MARK[data]
        at[1:-2] = white[1:-1] & ~white[:-2] & ~white[2:] & ~(high[:-2] & high[2:])
        latin = letter.copy()  # also the second byte of a letter of U+00C0 to U+00FF
        latin[1:] |= (data[:-1] == 0xC3) & high[1:] & (data[1:] != 0x97) & (data[1:] != 0xB7)
        at[1:-1] |= latin[:-1] & mark[1:] | mark[:-1] & letter[1:]
    at[offsets] = True
    return np.flatnonzero(at[:-1])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """A worker's encoder of a file: what it remembers serves all tasks that the worker runs."""
    return Encoder(path)


class Encoder:
    """Encodes slices of texts; keeps distinct pieces by hash, with their ids in one flat array."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.forget()

    def forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.at = np.zeros((2, 0), np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.n_ids = 0

    def _learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw = data.tobytes()
        parts, lengths = [self.flat], np.zeros(len(start), np.int64)
        for k in range(0, len(start), AT_ONCE):
            pieces = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[k : k + AT_ONCE].tolist(), end[k : k + AT_ONCE].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            own = np.fromiter(map(len, ids), np.int64, len(ids))
            lengths[k : k + AT_ONCE] = own
            parts.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(own.sum())))
        first = self.n_ids + np.cumsum(lengths) - lengths
        self.flat = np.concatenate(parts)
        self.n_ids += int(lengths.sum())
        where = np.searchsorted(self.seen, hashes)  # both are sorted: no need to sort them again
        self.seen = np.insert(self.seen, where, hashes)
        self.at = np.insert(self.at, where, [first, lengths], axis=1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each text)."""
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        start = cuts(data, offsets)
        end = np.append(start[1:], len(data))
        uniq, first, inverse = np.unique(slice_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
        if len(self.seen) > MEMO_PIECES or self.n_ids > MEMO_IDS:
            self.forget()
        at = np.searchsorted(self.seen, uniq)
        new = np.ones(len(uniq), bool)
        ok = at < len(self.seen)
        new[ok] = self.seen[at[ok]] != uniq[ok]
        if new.any():
            self._learn(uniq[new], data, start[first[new]], end[first[new]])
            at = np.searchsorted(self.seen, uniq)
        lengths = self.at[1][at][inverse]
        ids = self.flat[ragged(self.at[0][at][inverse], lengths)]
        totals = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.searchsorted(start, offsets)
        return ids, np.diff(totals[bounds])

    def texts(self, column):
        """(first row, ids of the slice, ids of each of its texts) for a string column."""
        for row, data, offsets in text_arrays(column):
            yield (row, *self.encode(data, offsets))
