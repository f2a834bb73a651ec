"""The vectorised text kernel against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaicore.llm.bytestext import NOT_ALNUM, WHITE, Words, ragged, shingle_hashes, text_arrays

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n.'é€😀0\x00", max_size=30)), max_size=8)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words(texts):
    for apart, pattern in ((WHITE, r"[^\x20\x09-\x0D]+"), (NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = 0
        for row, data, offsets in text_arrays(pa.array(texts, pa.string())):
            words = Words(data, offsets, apart)
            raw = words.data.tobytes()
            for k in range(words.n_docs):
                own = [raw[words.start[j] : words.end[j]].decode() for j in range(words.bounds[k], words.bounds[k + 1])]
                assert own == re.findall(pattern, lower(texts[row + k]))
                seen += 1
        assert seen == len(texts)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingle_sets(texts, n):
    strings, found = [], []
    for _, data, offsets in text_arrays(pa.array(texts, pa.string())):
        found += shingle_hashes(Words(data, offsets, WHITE), n)
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        strings.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    assert [len(s) for s in found] == [len(s) for s in strings]
    for a, x in zip(found, strings):
        for b, y in zip(found, strings):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_ragged():
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
