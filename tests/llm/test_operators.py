"""Each operator against brute force on small tables, and on odd ones."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaicore.llm import binary, chat, common, decontaminate, html_text, minhash, neardup, packing, pii, repeats, toxicity
from mosaicore.llm.queries import tokenizer_file
from mosaicore.llm.tokens import Encoder, load

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
WORDS = [a + b for a in "ba co du el fi go hu in ju ka".split() for b in "ren dol mis tor van pel sig".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------ tokens


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_the_library(path):
    rng = random.Random(1)
    pieces = ["Hello,", " world", "  two", "\n", "\n\n", " 's", "don't", "É!", "ñ,x", " ", "　 a", "  b", "😀", "x́", "1234", "%%%", " ", "\t", "ß.", "a×b", "Σ Σ", "\r\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(400)] + ["", "a" * 3000]
    encoder, tokenizer = Encoder(path), load(path)
    import pyarrow as pa

    for _ in range(2):  # the second time from memory
        got = [ids[a:b].tolist() for _, ids, n in encoder.texts(pa.array(texts)) for a, b in zip(np.cumsum(n) - n, np.cumsum(n))]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_first_by_hash(spark):
    from mosaicore.llm.common import first_by_hash

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    want = [tuple(r) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()]
    for total in (5000, 100, 10**12):  # the last: far fewer rows than was said
        assert [tuple(r) for r in first_by_hash(rows, 20, total)] == want
    assert first_by_hash(rows.limit(0), 20, 0) == []


def test_token_files(spark, odd_docs, no_docs):
    tokenizer = load(BYTE)
    rows = sorted(binary.token_files(odd_docs, BYTE).collect(), key=lambda r: r.start)
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in odd_docs.collect()))
    start = 0
    assert len(rows) == len(texts)
    for r, (known, doc, _, text) in zip(rows, texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert binary.token_files(no_docs, BYTE).collect() == []


def test_rows_without_an_id_are_dealt_to_files(spark):
    texts = [f"t{k % 50:02d} " + "word " * 200 for k in range(3000)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = binary.scratch(spark, "tokens")
        manifest = binary.write_tokens(docs, BYTE, 0, folder)
        files = manifest.collect()
        rows = binary.read_documents(manifest, folder).orderBy("start").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 1 and max(f.n_docs for f in files) < 2000
    tokenizer = load(BYTE)
    want = [zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for t in sorted(texts)]
    assert [r.ids_crc32 for r in rows] == want and rows[0].start == 0


def test_a_failed_writer_leaves_nothing(tmp_path):
    writer = binary.SequenceWriter(str(tmp_path), np.dtype(np.uint16), 8, 4)
    writer.add([1], np.array([40]), np.arange(40, dtype=np.uint32))
    writer.abort()
    assert not list(tmp_path.iterdir())


def test_sequence_access(tmp_path):
    writer = binary.SequenceWriter(str(tmp_path), np.dtype(np.uint16), 8, 4)
    ids = np.arange(101, dtype=np.uint32)
    writer.add([5, 6], np.array([40, 61]), ids)
    name, n_docs, n_ids = writer.close()
    reader = binary.SequenceReader(str(tmp_path), name)
    assert (n_docs, n_ids) == (2, 101)
    values, mask = reader.sequence(12)
    assert values[:5].tolist() == [96, 97, 98, 99, 100] and mask.to_pylist() == [True] * 5 + [False] * 3
    assert reader.span(30, 40).tolist() == list(range(30, 70))


# ------------------------------------------------------------ packing


def test_pack_lengths():
    rng = np.random.default_rng(3)
    for lengths, best in ((np.full(20, 2100), 20), (np.array([4096] * 3 + [1] * 5), 4), (np.array([1500, 1500, 1096] * 7), 7), (np.array([6, 5, 5, 4, 4, 3, 3, 2] * 1), 4)):
        cap = 8 if lengths.max() < 10 else 4096
        bins = packing.pack_lengths(lengths, cap)
        assert np.bincount(bins, weights=lengths).max() <= cap and bins.max() + 1 == best
    for _ in range(10):
        lengths = rng.integers(1, 4097, 60)
        bins = packing.pack_lengths(lengths, 4096)
        fill = np.bincount(bins, weights=lengths)
        assert fill.max() <= 4096 and len(fill) <= len(np.unique(packing.best_fit(lengths, 4096))) and fill.min() > 0


def test_exchanges_do_the_packing():
    """From pieces as they come to the fewest bins that there can be, by moves, swaps and two for one."""
    rng = np.random.default_rng(4)
    kinds, emptied = Counter(), 0
    for _ in range(6):
        lengths = np.minimum(4096, rng.lognormal(6.6, 0.9, 900).astype(np.int64) + 1)
        start = packing.best_fit(lengths, 4096, False)
        moves = []
        bins = packing.pack_lengths(lengths, 4096, None, moves)
        fill, fewest = np.bincount(bins, weights=lengths), -(-int(lengths.sum()) // 4096)
        assert fewest <= len(fill) <= len(np.unique(packing.best_fit(lengths, 4096))) and fill.max() <= 4096 and moves
        kinds.update(moves)
        emptied += len(np.unique(start)) - len(fill)
    assert emptied >= 4 and kinds[1, 0] and kinds[1, 1] and kinds[2, 1] + kinds[1, 2] and max(map(sum, kinds)) == 3


def test_many_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 20_000)
    rows = packing.pack(packing.written(spark.createDataFrame([(7, 0, 300)] * 600, "doc_id long, piece int, length long"), "equal"), ["doc_id", "piece"], 1000).collect()
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert len(rows) == 600 and max(fill.values()) <= 1000 and len(fill) == 200 and len({s >> 24 for s in fill}) > 3
    assert sorted(r.offset for r in rows) == [0] * 200 + [300] * 200 + [600] * 200


def test_exchange_empties_a_bin():
    lengths = np.array([6, 4, 5, 5, 3, 3, 4])  # 30 in bins of 10
    assert len(np.unique(packing.exchange(lengths, np.array([0, 1, 0 + 2, 1, 3, 3, 2]), 10))) == 3


def test_packing(spark, odd_docs, no_docs):
    tokenizer = load(WORD)
    rows = packing.pack_documents(odd_docs, WORD, 1, 64).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            want[(r.doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack_documents(no_docs, WORD).collect() == []


def test_packing_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 30_000)
    rng = np.random.default_rng(0)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 1000, 200))], "doc_id long, length long")
    rows = packing.pack(pieces, ["doc_id"], 1000).collect()
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert len(rows) == 200 and max(fill.values()) <= 1000 and len(fill) <= -(-sum(fill.values()) // 1000) * 1.1 + 1


# ------------------------------------------------------------ near duplicates


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(texts, n, share=80):
    sets = [shingles(t, n) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and label[i] != label[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return sets, label


def edited_family(rng):
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    for _ in range(60):  # copies of copies, so that chains lead away from the first
        w = rng.choice(texts).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts + ["", None, "x", "x", "X", "x y"]


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    texts = edited_family(random.Random(n))
    sets, label = brute_components(texts, n)
    rows = sorted(neardup.near_duplicates(docs_of(spark, texts), n).collect())
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows] == [(i, len(s), c, i == c) for i, (s, c) in enumerate(zip(sets, label))]


def test_links_that_no_hub_shares(spark, monkeypatch):
    """Families in which many members are unlike the hub of their bucket, in blocks of a few texts; short sets at exactly 0.8."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(18)
    texts = []
    for _ in range(4):  # each copy changes a word of the one before, so that the ends are unlike
        w = prose(rng, 40).split()
        for k in range(24):
            w[(7 * k) % 40] = rng.choice(WORDS) + str(k)
            texts.append(" ".join(w))
    for k in range(60):  # 8 of 10 and 4 of 5 shingles in common
        w = [f"w{k}x{i}" for i in range(11)]
        texts += [" ".join(w), " ".join(w[:-2])] if k % 2 else [" ".join(w[:6]), " ".join(w[:5])]
    rng.shuffle(texts)
    _, label = brute_components(texts, 2)
    rows = sorted(neardup.near_duplicates(docs_of(spark, texts), 2).collect())
    assert [r.component_id for r in rows] == label and len(set(label)) <= 80


def test_one_very_large_family(spark):
    rng = random.Random(19)
    base = prose(rng, 120).split()
    texts = [" ".join(base)]
    for k in range(1500):
        w = base.copy()
        for _ in range(3):
            w[rng.randrange(120)] = f"z{k}"
        texts.append(" ".join(w))
    texts += [prose(rng, 60) for _ in range(30)]
    rows = neardup.near_duplicates(docs_of(spark, texts), 2).collect()
    assert Counter(r.component_id for r in rows)[0] == 1501 and sum(r.kept for r in rows) == 31


@pytest.mark.parametrize("operator", ["near_duplicates", "keep_one"])
def test_few_documents_make_few_files(spark, operator):
    """However many partitions a shuffle has, a small table of keys is one file: each costs an executor some processes on a local disk."""
    texts = edited_family(random.Random(23))
    _, label = brute_components(texts, 2)
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old, before = {k: spark.conf.get(k) for k in conf}, len(common.tables_since())
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        kept = {r.doc_id for r in getattr(neardup, operator)(docs_of(spark, texts), 2).collect() if operator == "keep_one" or r.kept}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert kept == {i for i, c in enumerate(label) if i == c}
    files = {path.rsplit("/", 1)[1].rsplit("-", 1)[0]: len(spark.read.parquet(path).inputFiles()) for path in common.tables_since(before)}
    assert all(files[name] == 1 for name in ["sets", "hubs", "candidates", "labels", *["gone"] * (operator == "keep_one")])
    assert not {"confirmed", "components", "bucket-rows", "bucket-links"} & set(files)  # read once, so not written


def test_minhash_near_duplicates(spark):
    texts = edited_family(random.Random(9))
    _, label = brute_components(texts, 5)
    rows = sorted(minhash.near_duplicates(docs_of(spark, texts)).collect())
    assert [r.component_id for r in rows] == label


def test_block_links():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    labels = np.arange(30)
    want = {(j, i) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 40 * len(np.union1d(sets[i], sets[j]))}
    got = {tuple(sorted(p)) for p in neardup.block_links(np.arange(30), labels, np.zeros(30, int), sets, 40)}
    assert got == want and want


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs, 2).collect()
    assert len(rows) == 12 and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 9, 10]
    assert kept.where("doc_id is null").count() == 2
    assert neardup.near_duplicates(no_docs).collect() == []


def test_copies_without_an_id_of_their_own_go(spark):
    rng = random.Random(12)
    one, two, three, four = (prose(rng, 40) for _ in range(4))
    rows = [(None, one, "a"), (None, one, "b"), (None, one + " end", "c"), (None, two, "d"), (None, None, "e"), (5, three, "f"), (5, three, "f"), (5, four, "g"), (6, two + " " + three, "h"), (7, three, "i")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _row string")).collect()
    assert sorted((r.doc_id or 0, r._row) for r in kept if r.text not in (one, one + " end")) == [(0, "d"), (0, "e"), (5, "f"), (5, "g"), (6, "h")]
    assert sum(r.text in (one, one + " end") for r in kept) == 1


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2))
    for keep in (400, 300, 200):
        other = np.unique(np.concatenate([base[:keep], rng.integers(0, 1 << 63, 400 - keep).astype(np.uint64)]))
        s = neardup.one_permutation([base, other, base[:3]], 512)
        true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        assert abs((s[0] == s[1]).mean() - true) < 0.1 and (s != neardup.EMPTY).all()
    assert (neardup.one_permutation([base[:0]]) == neardup.EMPTY).all()


# ------------------------------------------------------------ fingerprints


def test_fingerprints(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(0, 200)) for _ in range(30)] + ["", None, "é" * 9, "same text here"]
    ids = rng.sample(range(-50, 1000), len(texts))
    rows = {r.doc_id: r for r in minhash.with_edits(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    order = sorted(zip(ids, [t or "" for t in texts]))
    assert len(rows) == len(texts)
    for k, (doc, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        r = rows[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.edited_fingerprint == minhash.fingerprints(minhash.signatures([new]))[0]
        for other, near in ((new, r.near_edited), (after, r.near_next)):
            a, b = shingles(text, 5), shingles(other, 5)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
    empty = [r.fingerprint for d, r in rows.items() if r.n_chars == 0]
    assert set(empty) == {"f" * 512}


def test_signatures_against_plain_python():
    """The least image of every shingle's hash under every permutation, in Python's own integers."""
    from mosaicore.llm.bytestext import WHITE, Words, shingle_hashes, text_arrays

    rng = random.Random(22)
    texts = [prose(rng, n) for n in (1, 4, 5, 6, 40, 300)] + [""]
    import pyarrow as pa

    ((_, data, offsets),) = text_arrays(pa.array(texts))
    sets = shingle_hashes(Words(data, offsets, WHITE), minhash.SHINGLE)
    for text, own, signature in zip(texts, sets, minhash.signatures(texts).tolist()):
        assert len(own) == len(shingles(text, 5))
        for k in range(minhash.PERMUTATIONS):
            a, b = int(minhash.A[k]), int(minhash.B[k])
            images = [((a * (int(h) >> 32) + b) % 2**64) >> 32 for h in own]
            assert signature[k] == min(images, default=2**32 - 1)


def test_fingerprints_of_odd_rows(spark, odd_docs, no_docs):
    rows = minhash.with_edits(odd_docs).collect()
    assert len(rows) == 14 and len({r.fingerprint for r in rows if r.n_chars == 89}) <= 2
    assert minhash.with_edits(no_docs).collect() == []
    one = minhash.with_edits(odd_docs.where("doc_id = 8")).first()
    assert one.edited_sha256 == hashlib.sha256(b"one").hexdigest() and one.near_next == 1.0


# ------------------------------------------------------------ decontamination


def brute_hits(texts, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    strings = {}
    for item, text in items:
        w = re.findall(pattern, lower(text))
        for i in range(len(w) - min(window, len(w)) + 1) if w else ():
            strings.setdefault(tuple(w[i : i + min(window, len(w))]), set()).add(item)
    out = []
    for t in texts:
        w = re.findall(pattern, lower(t))
        mark, found = [False] * len(w), set()
        for s, own in strings.items():
            for i in range(len(w) - len(s) + 1):
                if tuple(w[i : i + len(s)]) == s:
                    found |= own
                    mark[i : i + len(s)] = [True] * len(s)
        out.append((len(w), sum(mark), found))
    return out


@pytest.mark.parametrize("limit", [200_000, 20])
def test_decontamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", limit)
    rng = random.Random(7)
    items = [(k, prose(rng, n)) for k, n in enumerate([1, 2, 3, 4, 12, 13, 14, 20, 30, 13])] + [(50, ""), (51, None), (52, "!!")]
    texts = [prose(rng, 300) for _ in range(20)] + ["", None, "..."]
    for k in range(15):
        w = items[rng.randrange(10)][1].split()
        a = rng.randrange(max(1, len(w) - 12))
        texts.append(prose(rng, rng.randrange(0, 60)) + "  " + "... ".join(w[a : a + 15]).upper() + " " + prose(rng, rng.randrange(0, 20)))
    rows = sorted(decontaminate.contamination(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect())
    for r, (n, hit, found) in zip(rows, brute_hits(texts, items)):
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(found), decontaminate.items_digest(found))
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    kept = {r.doc_id for r in decontaminate.keep_uncontaminated(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {r.doc_id for r in rows if not r.contaminated} and 0 < len(kept) < len(rows)


def test_passages_in_long_documents_go(spark):
    rng = random.Random(13)
    item, left, right = prose(rng, 20), prose(rng, 400) + " é", prose(rng, 400)
    w = item.split()
    nested = " ".join(w[:10]) + " [" + item.upper() + "] " + " ".join(w[10:])  # what is left when the inner one goes is one, too
    rows = [(1, f"{left} {item}, {right}", 9), (2, f"{left} {nested} {right}", 9), (3, f"{left} {right}", 9), (4, item, 9), (5, None, 9)]
    kept = {r.doc_id: r for r in decontaminate.keep_uncontaminated(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(kept) == {1, 2, 3, 5}
    assert kept[1].text == f"{left} , {right}" and kept[1].n_chars == len(kept[1].text)
    assert re.findall(r"[^\W_]+", kept[2].text) == re.findall(r"[^\W_]+", f"{left} {right}") and kept[2].n_chars == len(kept[2].text)
    assert (kept[3].text, kept[3].n_chars, kept[5].text) == (f"{left} {right}", 9, None)


@pytest.mark.parametrize("limit", [200_000, 20])
def test_documents_with_a_whole_window_go(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", limit)
    rng = random.Random(14)
    items = [(f"q{k}", prose(rng, 30)) for k in range(6)] + [("short", "kapel huvan zyx")]
    long = [prose(rng, 5000) for _ in range(8)]
    w = items[3][1].split()
    rows = [(1, f"{long[0]} {' '.join(w[5:18])} {long[1]}"), (2, f"{long[2]} {' '.join(w[5:17])} xx {long[3]}"), (3, long[4]), (4, f"{long[5]} Kapel, huvan zyx! {long[6]}"), (5, "kapel huvan zyx"), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").withColumn("found", F.lit("x"))
    own = spark.createDataFrame(items, "item_id string, text string")
    kept = {r.doc_id: r for r in decontaminate.keep_uncontaminated(docs, own, whole_windows=True).collect()}
    assert set(kept) == {2, 3, 4, 6, 7} and all(r.found == "x" for r in kept.values())
    assert kept[2].text == rows[1][1] and kept[4].text == f"{long[5]} ! {long[6]}" and kept[4].n_chars == len(kept[4].text)
    assert {r.doc_id for r in decontaminate.keep_uncontaminated(docs, own.where("item_id != 'short'"), whole_windows=True).collect()} == {2, 3, 4, 5, 6, 7}
    hit = {r.doc_id: r for r in decontaminate.search(docs, own).collect()}
    assert hit[1].items == ["q3"] and hit[1].whole and hit[5].items == ["short"] and not hit[5].whole


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (None, "lazy dog")], "item_id long, text string")
    rows = decontaminate.contamination(odd_docs, items).collect()
    assert len(rows) == 14 and sum(r.n_hit == 3 for r in rows) == 5
    assert decontaminate.contamination(no_docs, items).collect() == []
    assert all(not r.contaminated for r in decontaminate.contamination(odd_docs, items.limit(0)).collect())
    assert decontaminate.keep_uncontaminated(odd_docs, items).columns == odd_docs.columns


# ------------------------------------------------------------ repeats


def test_repeats(spark):
    rng = random.Random(5)
    shared = [prose(rng, 60) for _ in range(5)]
    texts = [prose(rng, rng.randrange(0, 150)) for _ in range(15)] + ["ab" * 300, "x" * 199, "x" * 200, "x" * 201, "", None, "é" * 250]
    for k in range(25):
        texts.append(prose(rng, rng.randrange(0, 40)) + rng.choice(shared)[rng.randrange(30) :] + prose(rng, rng.randrange(0, 30)) + rng.choice(shared)[: 150 + rng.randrange(150)])
    texts += texts[:4] + [shared[0][:200] + "!" + shared[0][:200]]
    want = repeats.brute_force([(t or "").encode() for t in texts], 200)
    rows = sorted(repeats.digests(docs_of(spark, texts)).collect())
    assert [(r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == want
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]
    assert sum(0 < r.n_removed < r.n_bytes for r in rows) > 10


@pytest.mark.parametrize("name, value", [("HOT", 3), ("PIECE", 512), ("BLOCK", 1)])
def test_repeats_with_small_limits(spark, monkeypatch, name, value):
    """A passage with ever other neighbours, long texts and blocks, each beyond a patched limit."""
    monkeypatch.setattr(repeats, name, value)
    rng = random.Random(16)
    shared, almost = prose(rng, 60)[:260], prose(rng, 60)[:195]
    texts = [prose(rng, 20) + shared + prose(rng, 20) for _ in range(12)] + [prose(rng, 20) + almost + prose(rng, 20) for _ in range(12)]
    texts += [prose(rng, 400) + shared + prose(rng, 300), prose(rng, 10) + almost + "same end of it" + prose(rng, 9), almost + "same end of it", "é" * 2000, prose(rng, 30)]
    texts += texts[:2]
    want = repeats.brute_force([t.encode() for t in texts], 200)
    rows = sorted(repeats.digests(docs_of(spark, texts)).collect())
    assert [(r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == want and 0 < want[0][0]


def test_repeats_of_many_equal_rows(spark):
    rng = random.Random(17)
    text, other = prose(rng, 200), prose(rng, 50)
    texts = [(7, text)] * 600 + [(None, text)] * 500 + [(None, other)] + [(k, prose(rng, 60)) for k in range(100, 130)] + [(200, text[100:400] + other)]
    want = repeats.brute_force([text.encode()] * 2 + [other.encode()] * 2 + [(text[100:400] + other).encode()] * 2, 200)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = repeats.digests(docs).collect()
    assert len(rows) == len(texts)
    assert {(r.n_removed, r.n_spans, r.kept_sha256) for r in rows if r.n_bytes == len(text)} == {want[0]}
    own = next(r for r in rows if r.doc_id == 200)
    assert (own.n_removed, own.n_spans, own.kept_sha256) == want[4]
    spans = repeats.repeated_spans(repeats.written(repeats.text_table(docs, 200), "t"), 200).collect()
    assert len(spans) <= 4 and max(len(r.spans) for r in spans) < 200  # a list for each text, not for each row


def test_repeats_of_odd_rows(spark, odd_docs, no_docs):
    rows = repeats.digests(odd_docs).collect()
    assert len(rows) == 14 and [r.n_removed for r in rows if r.doc_id == 6] == [150_000]
    assert repeats.digests(no_docs).collect() == []


def test_run_index():
    from mosaicore.llm.runindex import RunIndex

    rng = np.random.default_rng(2)
    strings = ["".join("ab"[k] for k in rng.integers(0, 2, rng.integers(1, 40))).encode() for _ in range(30)]
    index = RunIndex(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]))
    got = index.matching_statistics()
    for k, s in enumerate(strings):
        for i in range(len(s)):
            best = 0
            for m, t in enumerate(strings):
                for j in range(len(t)):
                    if (m, j) != (k, i):
                        n = 0
                        while i + n < len(s) and j + n < len(t) and s[i + n] == t[j + n]:
                            n += 1
                        best = max(best, n)
            assert got[index.starts[k] + i] == best


# ------------------------------------------------------------ chat


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice([*chat.CONTROLS, chat.ESCAPE, "e", "c", "<", "s>", "x"]) for _ in range(rng.randrange(8)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)


def test_chat(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(12):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", prose(rng, 5), "</s>[INST] ok [/INST]", "<|end|>\x1b<|turn|>assistant", "é😀\n\n"])))
    rows.append((None, None, None, None))
    out = {r.conv_id: r for r in chat.read_back(chat.assemble(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)), BYTE), BYTE).collect()}
    for conv in {r[0] for r in rows}:
        own = [((r or ""), (t or "")) for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        got = out[conv]
        assert got.n_turns == len(own) and got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got.formatted_chars == sum(len(chat.TURN + chat.escape(r) + chat.TEXT + chat.escape(t) + chat.END) for r, t in own)
    assert chat.read_back(chat.assemble(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), BYTE), BYTE).collect() == []


def test_masks_and_reserved_ids():
    own = chat.Assembler(BYTE)
    turns = [("user", "a <|end|> b"), ("assistant", "</s>"), ("assistant", ""), ("system", "x")]
    ids = np.concatenate(own.ids(turns))
    mask = own.mask(ids, [r for r, _ in turns])
    assert (np.flatnonzero(ids == own.end).size, np.flatnonzero(ids >= own.turn).size) == (4, 12)
    assert [(r, t) for r, t, _, _ in own.read(ids, mask)] == turns and [m for _, _, m, _ in own.read(ids, mask)] == ["", "</s>", "", ""]


# ------------------------------------------------------------ toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    bad = ["gronk", "slarv", "fnord"]
    rows, labels = [], []
    for i in range(1200):
        words = prose(rng, rng.randrange(20, 120)).split()
        toxic = rng.random() < 0.2
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    truth = {i: any(b in t for b in bad) for i, t in rows}
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, marks).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([bool(r.predicted) == truth[r.doc_id] for r in held]) > 0.98
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.score_documents(docs, flipped).collect()) == sorted(out)  # held-out labels are never learnt


def test_one_text_of_a_repeated_doc_id_is_learnt_from(spark, monkeypatch):
    rows = [(1, "gronk slarv")] * 500 + [(k, "calm words here") for k in range(2, 40)] + [(3, "another text of three")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    sizes = []
    real = toxicity.select_features
    monkeypatch.setattr(toxicity, "select_features", lambda p, u, *rest: (sizes.append((len(p), len(u))), real(p, u, *rest))[1])
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    ids = [k for k in range(1, 40) if zlib.crc32(str(k).encode()) % 5]
    assert sizes == [(len({1, 4} & set(ids)), len(ids))]


def test_non_negative_risk():
    rng = np.random.default_rng(0)
    p = (rng.random((200, 6)) < [0.8, 0.6, 0.1, 0.1, 0.1, 0.1]).astype(np.float32)
    clean = (rng.random((600, 6)) < 0.1).astype(np.float32)
    u = np.concatenate([clean, (rng.random((200, 6)) < [0.8, 0.6, 0.1, 0.1, 0.1, 0.1]).astype(np.float32)])
    w, b = toxicity.nn_pu(p, u, 0.25)
    assert ((p @ w + b) > 0).mean() > 0.45 and ((clean @ w + b) > 0).mean() < 0.05
    assert (p @ w + b).mean() > (clean @ w + b).mean() + 2 and np.isfinite(w).all()


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (4, 1), (77, 1)], "doc_id long, toxic int")
    rows = toxicity.score_documents(odd_docs, labels).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score < 1e-9 for r in toxicity.score_documents(odd_docs, labels.limit(0)).collect())
    assert toxicity.score_documents(no_docs, labels).collect() == []
    assert toxicity.keep_clean(odd_docs, toxicity.fit(odd_docs, labels.limit(0))).columns == odd_docs.columns


# ------------------------------------------------------------ personal data

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    out += [("ip", *m.span()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(CARD, text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(PHONE, text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(6)
    pieces = ["a", ".", "@", "b.c", "-", "+", "1", "23", "256", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "x@y.z", " ", "é", "%", "(", "999.1.2.3", "@@", "a@b", "..", "4111-1111-1111-1111-1"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.fixture(scope="module")
def tagger():
    rng = random.Random(8)
    return pii.trained((prose(rng, 400),))


def test_tagger_learns_other_forms(tagger):
    rng = random.Random(10)
    samples = pii.labelled([prose(rng, 300)], 400, seed=99)
    tags, _ = pii.decode(tagger, np.stack([s for s, _ in samples]))
    assert (tags == np.stack([t for _, t in samples])).mean() > 0.97
    text = prose(rng, 30) + " call (743) 555-3824 or write to karen.dol [at] mistor [dot] org " + prose(rng, 30)
    ((base, every),) = pii.tag([text], tagger)
    assert base == [] and ("phone", text.index("(743)"), text.index("(743)") + 14) in every


def test_spans_of_any_length_at_every_offset(monkeypatch):
    def decode(_, windows):  # all but white space is one address
        own = (windows != 0) & (windows != pii.PAD)
        tags = np.where(own, 2, 0)
        tags[own & ~np.pad(own, ((0, 0), (1, 0)))[:, :-1]] = 1
        return tags, own * 0.9

    monkeypatch.setattr(pii, "decode", decode)
    for n in (8, 31, 32, 33, 48, 64, 65, 80, 127, 128, 129, 200, 300):
        core = ("q" * (n // 2) + "(at)" + "h" * n)[: n - 4] + ".com" if n > 12 else "q(at)h.c"
        texts = [" " * k + core + " " * 200 for k in range(150)]
        assert [every for _, every in pii.tag(texts, None)] == [[("email", k, k + len(core))] for k in range(150)], n


@pytest.mark.parametrize("core", ["jane [at] cs [dot] stanford [dot] edu", "jane.doe (at) physics (dot) example (dot) org", "maria.gonzalez [at] research [dot] example [dot] com", "bartholomew.featherstonehaugh (at) departmentofmathematics.example.org", "maria.gonzalez.fernandez [at] computing [dot] research [dot] example [dot] com"])
def test_tagger_finds_long_addresses(tagger, core):
    rng = random.Random(4)
    texts = [prose(rng, 60)[: 90 + k] + " " + core + " " + prose(rng, 30) for k in range(64)]
    found = [("email", t.index(" " + core + " ") + 1, t.index(" " + core + " ") + 1 + len(core)) in every for t, (_, every) in zip(texts, pii.tag(texts, tagger))]
    assert sum(found) >= 0.7 * len(found)


def test_recall_of_every_form(tagger):
    """Whole spans, laid into words that the training has not seen, of a language unlike its text."""
    rng = np.random.default_rng(123)
    letters = random.Random(20)
    words = ["".join(letters.choice("abcdeghilmnoprstuw") for _ in range(letters.randrange(2, 9))) for _ in range(300)]
    piece = lambda n: " ".join(words[k] for k in rng.integers(0, len(words), n))
    share = {}
    for kind, own in pii.TEMPLATES.items():
        for form in own:
            texts, spans = [], []
            for _ in range(60):
                core, left = pii.fill(form, rng, words), piece(rng.integers(5, 40)) + " "
                texts.append(f"{left}{core} {piece(rng.integers(0, 30))}")
                spans.append((kind, len(left), len(left) + len(core)))
            share[form] = np.mean([s in every for s, (_, every) in zip(spans, pii.tag(texts, tagger))])
    assert np.mean(list(share.values())) >= 0.95 and min(share.values()) >= 0.8, share
    texts = [f"{piece(9)} {pii.fill(form, rng, words)} {piece(9)}" for form in pii.LOOKALIKES for _ in range(20)]
    assert sum(len(every) > len(base) for base, every in pii.tag(texts, tagger)) <= 0.02 * len(texts)


def test_no_span_without_a_trigger():
    """What `holds` accepts has a trigger in it, so windows without one need no tagger."""
    rng = random.Random(21)
    pieces = ["a", "b c", " at ", "AT", "(at)", "[ at ]", "@", " dot ", "dot", ".", "1", "12", "255", "४", "9", "-", " ", "<at", "cat", "dots"]
    seen = Counter()
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        for kind in pii.KINDS:
            if pii.holds(kind, text):
                seen[kind] += 1
                assert pii.TRIGGER.search(text), (kind, text)
    assert all(pii.TRIGGER.search(pii.fill(form, np.random.default_rng(k), WORDS)) for own in pii.TEMPLATES.values() for form in own for k in range(20))
    assert seen["email"] and seen["phone"] and seen["ip"]


def test_digits_of_any_length(tagger):
    zeros = "0" * 5000 + ".1.1.1"
    assert pii.base_spans(zeros) == [("ip", 0, len(zeros))]
    for text in ("7" * 20_000, "1" * 5000 + ".1.1.1", zeros + " " + "9" * 6000, "+" + "1 " * 9000 + "1", "٣" * 6000):
        base, every = pii.tag([text], tagger)[0]
        assert set(base) <= set(every)


def test_a_bounded_sample_trains_the_tagger(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "trained", lambda texts: seen.append(texts))
    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.expr("repeat('word ', 50000 + id % 2)").alias("text"))
    pii.fit(docs, max_texts=5, max_chars=100)
    assert len(seen[0]) == 5 and max(map(len, seen[0])) == 100


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    x, gold = rng.integers(0, 50, (6, 3)), rng.integers(0, 3, (6, 3))
    mask = np.ones((6, 3), bool)
    mask[4:, 1] = False
    model = pii.Tagger([rng.standard_normal((pii.SYMBOLS, 8)) * 0.3 for _ in range(2)], [rng.standard_normal((2, 8)) * 0.3 for _ in range(2)], rng.standard_normal((4, pii.TAGS)) * 0.3, np.zeros(pii.TAGS), rng.standard_normal((pii.TAGS, pii.TAGS)) * 0.3)

    def loss():
        e, _ = pii.emissions(model, x)
        return pii.crf_gradient(e.astype(float), model.trans, gold, mask)[0]

    e, (h, ta, tb) = pii.emissions(model, x, keep=True)
    _, de, dt = pii.crf_gradient(e.astype(float), model.trans, gold, mask)
    dh = de @ model.out.T
    dwa, dua = pii.lstm_back(x, dh[:, :, :2], model.u[0], ta, pii.SYMBOLS)
    dwb, dub = pii.lstm_back(x[::-1], dh[::-1, :, 2:], model.u[1], tb, pii.SYMBOLS)
    for array, grad, at in ((model.trans, dt, (1, 2)), (model.u[0], dua, (1, 3)), (model.u[1], dub, (0, 5)), (model.w[0], dwa, (int(x[2, 0]), 4)), (model.w[1], dwb, (int(x[2, 0]), 1))):
        old = array[at]
        array[at] = old + 1e-2
        up = loss()
        array[at] = old - 1e-2
        down = loss()
        array[at] = old
        assert abs((up - down) / 2e-2 - grad[at]) < 2e-3


def test_spans_end_with_the_text(tagger):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(0, 12)) + " " + pii.fill(t, rng_np, WORDS) for rng_np in [np.random.default_rng(1)] for own in pii.TEMPLATES.values() for t in own for _ in range(20)]
    for text, (base, every) in zip(texts, pii.tag(texts, tagger)):
        assert set(base) <= set(every) and all(0 <= a < b <= len(text) for _, a, b in every)


def test_reconcile():
    assert pii.reconcile([(5.0, 0, 0, 10), (4.0, 1, 8, 12), (4.0, 1, 12, 20), (6.0, 2, 9, 14)]) == [(0, 0, 10), (1, 12, 20)]
    assert pii.reconcile([]) == []


def test_personal_data(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in pii.counts(odd_docs).collect() if r.doc_id not in (2, 9, None)}
    assert (rows[10].n_email, rows[10].n_ip, rows[10].n_card, rows[10].n_phone) == (1, 1, 1, 1)
    text = odd_docs.where("doc_id = 10").first().text
    assert rows[10].base_sha256 == pii.digest(plain_spans(text)) and set(pii.joined(plain_spans(text)).split(",")) <= set(rows[10].spans.split(","))
    assert rows[3].spans == "" and rows[4].n_email == 0
    assert pii.counts(no_docs).collect() == []


def test_redaction(spark, odd_docs, tagger):
    out = pii.redact(odd_docs, tagger)
    row = out.where("doc_id = 10").first()
    assert row.text.startswith("mail me at [EMAIL] or [PHONE], [IP], [CARD]") and row.n_chars == len(row.text)
    assert out.columns == odd_docs.columns and out.count() == 14
    assert pii.redacted("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[IP]f"


# ------------------------------------------------------------ pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><p>site head</p></header><nav><ul><li><a href="/">menu</a></li></ul></nav><div class="ad">buy &amp; sell many things today in our shop of things</div>
<div id=main><article><header><h1>The&nbsp;Title</h1></header><p><b>Bold start<br>of text &lt;here&gt; and   more of
it <p>Second &#233;t&eacute; <i>part</i>, which <a href=x>links</a> somewhere.<!-- <p>gone</p> --><ul><li>one<li>two</ul>
<aside>notice</aside><section class="comments"><p>I liked it a lot, thanks for this long and thoughtful comment</p></section></article></div>
<form><p>your mail</p></form><footer>&copy; all rights</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n\n") == ["The Title", "Bold start of text <here> and more of it", "Second été part, which links somewhere.", "one", "two"]


def test_headers_of_articles_stay():
    page = "<body><div class='page-header'>site</div><article><div class='article-header'><h1>Title</h1></div><p>Some text of the article.</p><div class='comment-list'><p>Nice!</p></div></article></body>"
    assert html_text.main_text(page) == "Title\n\nSome text of the article."


ARTICLE = "<h1>Title</h1><p>" + "Some text of the article, and more of it. " * 5 + "</p>"
OF_ARTICLE = ["Title", ("Some text of the article, and more of it. " * 5).strip()]


@pytest.mark.parametrize("names", ["class='content-sidebar-wrap'", "class='page has-sidebar'", "class='no-comments'", "class='sidebar-left'", "id=comments-open", "aria-hidden='false'", "data-hidden='1'", "data-id='nav'", "title='id=nav'"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main><div class='has-nav sidebar-page'>{}</div></main>", "<div>{}</div>"])
def test_wrappers_named_as_noise_keep_the_article(names, inner):
    page = f"<body><nav><a href=1>menu</a></nav><div {names}>{inner.format(ARTICLE)}<div class='sidebar'><p>Short aside.</p></div></div><div class='related'><article><p>Teaser.</p></article></div></body>"
    if inner.startswith("<div") and "comments" in names:
        page = page.replace("<article>", "<div>").replace("</article>", "</div>")
    got = html_text.main_text(page).split("\n\n")
    assert got == OF_ARTICLE


def test_sections_and_headings_of_articles_stay():
    page = f"<body><article>{ARTICLE}<section id='discussion'><h2 id='related-work'>Related work</h2><p>What others found.</p><h2 id='legal-history'>Legal history</h2><p>What courts said.</p></section>"
    page += "<section id='related'><a href=1>Another article</a> <a href=2>One more</a></section><section id=comments><p>Nice!</p></section><div class='newsletter'>Subscribe now to all our news</div></article></body>"
    assert html_text.main_text(page).split("\n\n") == OF_ARTICLE + ["Related work", "What others found.", "Legal history", "What courts said."]


def test_deep_pages_named_as_noise():
    assert html_text.main_text("<div class=ad><p>" * 3000 + "text") == "text"


def test_comments_longer_than_the_article_go():
    comments = "".join(f"<article class='comment-body'><p>{prose(random.Random(k), 40)}</p></article>" for k in range(8))
    for tag in ("article", "main"):
        assert html_text.main_text(f"<body><{tag}>{ARTICLE}</{tag}><div id='comments'>{comments}</div></body>").split("\n\n") == OF_ARTICLE


def test_main_text_without_article():
    body = "".join(f"<p>{prose(random.Random(k), 30)}</p>" for k in range(4))
    page = f"<body><div class=menu><a href=1>a</a></div><div><a href=1>x y z</a> <a href=2>w</a></div><div><h2>Head line</h2>{body}</div></body>"
    got = html_text.main_text(page).split("\n\n")
    assert got[0] == "Head line" and got[1:] == [prose(random.Random(k), 30) for k in range(4)]


LONG = "Words of an article that goes on for a while, " * 6


def test_bare_text_and_further_articles_stay():
    text = LONG.strip()
    assert html_text.main_text(f"<body><ul class=menu><li><a href=1>a</a></ul>{text}<p>{text} 2</p><p>{text} 3</p><div><a href=1>x</a></div>{text} <b>4</b> &amp; on<footer>f</footer></body>").split("\n\n") == [text, f"{text} 2", f"{text} 3", f"{text} 4 & on"]
    page = f"<body><nav><a href=1>menu</a></nav><div><article><h2>One</h2><p>{text}</p></article></div><div><article><h2>Two</h2><p>{text}</p><p>{text}</p></article></div><div class=x><p>About this site</p></div><article><a href=2>Only a link to more</a></article></body>"
    assert html_text.main_text(page).split("\n\n") == ["One", text, "Two", text, text]
    for names in ("title='a hidden gem'", "href='/hidden/valley?class=nav'", "data-x='sidebar'"):
        assert html_text.main_text(f"<body><article><p {names}>{text}</p><p>See <a {names}>this</a> too.</p></article></body>").split("\n\n") == [text, "See this too."]


def test_nesting_of_any_depth():
    for tag in ("div", "b", "article"):
        assert html_text.main_text(f"<{tag}>" * 5000 + "text" + f"</{tag}>" * 5000) == "text"


def test_density_against_its_definition():
    """Nested lists stand for nodes: [tag, part, ...]; the formula is written out anew."""
    rng = random.Random(15)

    def make(depth):
        parts = [rng.choice(["div", "p", "a", "b"])]
        for _ in range(rng.randrange(1, 5)):
            parts.append(make(depth - 1) if depth and rng.random() < 0.5 else "x" * rng.randrange(1, 60))
        return parts

    def node_of(tree, parent):
        node = html_text.Node(tree[0], parent)
        node.parts = [p if isinstance(p, str) else node_of(p, node) for p in tree[1:]]
        return node

    def chars(t):
        return sum(len(p) if isinstance(p, str) else chars(p) for p in t[1:])

    def tags(t):
        return sum(1 + tags(p) for p in t[1:] if not isinstance(p, str))

    def in_links(t):
        return chars(t) if t[0] == "a" else sum(in_links(p) for p in t[1:] if not isinstance(p, str))

    def links(t):
        return sum((p[0] == "a") + links(p) for p in t[1:] if not isinstance(p, str))

    def value(t, page):
        c, n, lc, ln = chars(t), max(1, tags(t)), in_links(t), max(1, links(t))
        e = np.e
        return c / n * np.log(max(1, c / max(1, lc) * n / ln) + 1) / np.log(np.log(c / max(1, c - lc) * lc + in_links(page) / chars(page) * c + e) + e - 1)

    def check(node, t, page):
        assert node.density == pytest.approx(value(t, page))
        below = [p for p in t[1:] if not isinstance(p, str)]
        assert node.total == pytest.approx(sum(value(p, page) for p in below))
        for child, p in zip([p for p in node.parts if not isinstance(p, str)], below):
            check(child, p, page)

    for _ in range(60):
        page = ["body", *make(4)[1:]]
        root = node_of(page, None)
        html_text.measure(root)
        check(root, page, page)


@pytest.mark.parametrize("page", ["", "   ", "plain text", "<", "<p", "<p>a", "</p></div>", "<!--", "<script>x", "<a href='", "<p>a<p>b</div></body>", "<table><tr><td>1<td>2</table>", "<b><i>x</b>y</i>", "<p a=\"b>c</p>", "\x00<p>é</p>"])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)
    if "<p>a<p>b" in page:
        assert html_text.main_text(page) == "a\n\nb"


def test_extract(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "v", "", 5), (None, None, "<p>x</p>" * 20_000, 5), (1, "u", PAGE, 5)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert len(out) == 5 and [r.text for r in out if r.page_id in (2, 3)] == ["", ""]
    assert [r.text.count("x") for r in out if r.page_id is None] == [20_000]
