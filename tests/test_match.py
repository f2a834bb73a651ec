"""The best match of an image's ranges in one task: the same results as columns and loops, and nothing but leaves leaves it."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaicore.functions import pixels as px
from mosaicore.operators import codec, kernels, match, regress, search
from mosaicore.params import EncodeParams
from mosaicore.queries import QUERIES
from tests.conftest import SF


def test_index_blocks_against_loops():
    """The index's candidates in order of probes within the budget, the bucket's if there are any, all of the bucket where there are none."""
    rng = np.random.default_rng(5)
    q, pool = rng.integers(0, 3, (40, 6)).astype(float), rng.integers(0, 3, (150, 6)).astype(float)  # many equal scores
    q_sig, sig = rng.integers(0, 64, 40), rng.integers(0, 64, 150)
    sig[sig == 9] = 10
    q_sig[:3] = 1 << 20  # far from every entry
    qb, pb = rng.integers(0, 4, 40), rng.integers(0, 3, 150)
    for budget, buckets in ((5, False), (5, True), (1000, False), (1000, True)):
        blocks_ = list(search.index_blocks(q, pool, 4, q_sig, sig, 6, budget, *((qb, pb) if buckets else (None, None))))
        got = [tuple(int(x) for x in pair) for row, at, _, rank in blocks_ for pair in zip(row, rank, at, strict=True)]
        want = []
        for i in range(len(q)):
            found = [e for flip in [0, *(1 << b for b in range(6))] for e in range(150) if sig[e] == q_sig[i] ^ flip][:budget]
            if buckets and any(pb[e] == qb[i] for e in found):
                found = [e for e in found if pb[e] == qb[i]]
            found = found or [e for e in range(150) if not buckets or pb[e] == qb[i]]
            want += [(i, k + 1, e) for k, e in enumerate(sorted(found, key=lambda e: (-float(q[i] @ pool[e]), e))[:4])]
        assert sorted(got) == want


def test_lsh_encode_shuffles_no_pairs(spark):
    """The index's candidates were rows that carried both blocks through joins and windows."""
    plan = QUERIES["lsh_encode"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "probe" not in plan and "proxy" not in plan


def test_normalised_column_is_linear(spark):
    """One sum for each row, not one for each value (a row of 20,000 took minutes)."""
    a = np.random.default_rng(0).random(20_000)
    began = time.time()
    got = spark.createDataFrame([(a.tolist(),)], "a array<double>").select(px.normalised(F.col("a")).alias("a")).first().a
    assert time.time() - began < 30
    assert np.allclose(got, kernels.normalise_rows(a[None])[0], atol=1e-12)


SOLVED = {"plain": EncodeParams(block=4), "quantized": EncodeParams(block=4, quantized=True), "sets": EncodeParams(block=4, use_buckets=True, bucket_count=8, use_s_sets=True)}


@pytest.mark.parametrize("name", sorted(SOLVED))
def test_solver_gives_the_bits_of_the_columns(spark, name):
    """Codes and errors as `regress` has them, flat blocks and whole eighths (ties, halves) included."""
    p, rng = SOLVED[name].checked(), np.random.default_rng(3)
    d, r = rng.random((60, 3, 16)), rng.random((60, 3, 16))
    d[:5], r[3:8], d[8:30], r[8:30] = 0.5, 0.25, np.round(d[8:30] * 8) / 8, np.round(r[8:30] * 8) / 8
    bucket = rng.integers(0, 8, 60).astype(np.int32)
    code, mse = match.Solver(r, d, bucket, p).solved(np.arange(60), np.arange(60))
    rows = spark.createDataFrame([(k, c, d[k, c].tolist(), r[k, c].tolist(), int(bucket[k])) for k in range(60) for c in range(3)], "k int, c int, d array<double>, r array<double>, bucket int")
    sets = F.array(*(F.array(*map(F.lit, own)) for own in px.s_sets(8, p.s_clip)))[F.col("bucket")] if p.use_s_sets else None
    x = regress.sums_of(F.col("d"), F.col("r"))
    rows = rows.withColumn("code", regress.coded(*regress.solved(x), p.s_clip, p.o_min, p.o_max, p.quantized, sets))
    got = {(r.k, r.c): r for r in rows.select("k", "c", "code", (regress.sse(x, F.col("code.s"), F.col("code.o")) / x.n).alias("e")).collect()}
    for k in range(60):
        own = [got[k, c] for c in range(3)]
        assert [(g.code.s, g.code.o) for g in own] == list(zip(code[0, k], code[1, k], strict=True))
        if p.quantized:
            assert [(g.code.qs, g.code.qo) for g in own] == list(zip(code[2, k], code[3, k], strict=True))
        assert (own[0].e + own[1].e + own[2].e) / 3 == mse[k]  # sum() compensates


def cogroups(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "FlatMapCoGroupsInArrow" in line]


@pytest.mark.parametrize("name", ["code_size", "best_match_rgb", "best_match_snapped", "best_match_identity", "overlay_upscaled", "overlay_blend", "edge_mask_thick2", "best_match_topk", "quadtree_leaves", "best_match_quantized", "edge_mask"])
def test_pairs_of_blocks_are_no_rows(spark, name):
    """What leaves the search is a leaf with its codes, not a ranked pair that carries both blocks."""
    found = cogroups(QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString())
    assert found and all("codes#" in line and "rank#" not in line and "proxy#" not in line for line in found)


@pytest.mark.parametrize("steps", [1, 2])
def test_decoding_encodes_once(spark, steps):
    """Each step and the list of block sizes read the leaves, and the whole encoder ran again for each."""
    seen = spark.sparkContext.accumulator(0)

    def counted(y):
        seen.add(1)
        return y

    leaves = spark.createDataFrame([(0, y, x, 4, 0, 0, 0, 0, [(0.5, 0.25, None, None)], 0.0) for y in (0, 4) for x in (0, 4)], match.LEAVES)
    leaves = leaves.withColumn("y", F.udf(counted, "int").asNondeterministic()("y"))
    pictures = spark.createDataFrame([(0, 8, 8, 8, 8, 1)], "image_id long, height int, width int, orig_height int, orig_width int, channels int")
    rows = codec.decode(leaves, pictures, 4, steps).collect()
    assert len(rows) == 64 and {r.v for r in rows} == {0.25 if steps == 1 else 0.375}
    assert seen.value == 4
