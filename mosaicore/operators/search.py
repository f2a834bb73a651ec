"""Similarity search of range blocks among pool entries.

A pool entry has image_id, entry, dom, tf, bucket, proxy (a normalised block) and chans; a query
has image_id, y, x, bucket, q (a block of unit length) and chans. Ties are ordered by entry. The exact search
multiplies matrices, an image's queries by its pool, in Arrow; only the k best pairs of a range become rows.
`operators.match` takes the pairs as arrays and makes one row of each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaicore.functions.pixels import dot

RANGE = ["image_id", "y", "x"]
EMPTY_POOL = "domain pool empty: the image is smaller than a domain, or no domain passes the entropy threshold"
#: What an entry brings to a pair.
ENTRY = ["entry", "dom", "tf", "y AS dy", "x AS dx", "proxy", "chans AS d"]
FOUND = "image_id long, y int, x int, entry long, dom long, tf int, bucket int, dy int, dx int, d array<array<double>>, r array<array<double>>, score double, rank int"
#: Products that are held at a time, and what sums in another order may differ by.
PRODUCTS, SLACK = 1 << 21, 1e-9


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays (or arrays of these), as an array of its own shape."""
    values, shape = column.combine_chunks(), [len(column)]
    while pa.types.is_list(values.type):
        inner = values.flatten()
        shape.append(len(inner) // max(1, len(values)))
        values = inner
    return values.to_numpy(zero_copy_only=False).reshape(shape)


def _nested(a: np.ndarray) -> pa.Array:
    """The rows of an array as arrays of arrays."""
    rows, c, n = a.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * c + 1, dtype=np.int32) * n), pa.array(a.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows + 1, dtype=np.int32) * c), inner)


#: Query, entry, score and rank (from 1) of pairs.
PairBlock = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def summed(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis from the first place to the last, as the declarative plan adds."""
    return np.cumsum(a, axis=-1)[..., -1] + 0.0


def _ranked(q: np.ndarray, proxy: np.ndarray, k: int, row: np.ndarray, entry: np.ndarray) -> PairBlock:
    """The k best of each query among pairs of a query and an entry; equal scores go by entry."""
    score = np.concatenate([np.zeros(0), *(summed(q[row[i : i + 4096]] * proxy[entry[i : i + 4096]]) for i in range(0, len(row), 4096))])
    order = np.lexsort((entry, -score, row))
    row, entry, score = row[order], entry[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    return tuple(x[rank <= k] for x in (row, entry, score, rank))


def exact_blocks(q: np.ndarray, proxy: np.ndarray, k: int, q_bucket: np.ndarray | None, bucket: np.ndarray | None) -> Iterator[PairBlock]:
    """The k best entries of each query, some queries at a time; with buckets, of those of its bucket.

    A product of matrices finds the candidates; their scores are then summed from the first place to the last, as the
    declarative plan does, so that equal scores are equal and go by entry.
    """
    size = len(proxy)
    step = max(1, PRODUCTS // (size * max(1, min(q.shape[1], k))))
    for a in range(0, len(q), step):
        own = q[a : a + step]
        score = own @ proxy.T
        if bucket is not None:
            score = np.where(q_bucket[a : a + len(own), None] == bucket[None, :], score, -np.inf)
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k] - SLACK if k < size else -np.inf
        row, *rest = _ranked(own, proxy, k, *np.nonzero((score >= least) & (score > -np.inf)))
        yield row + a, *rest


def index_blocks(q: np.ndarray, proxy: np.ndarray, k: int, q_sig: np.ndarray, sig: np.ndarray, n_planes: int, budget: int, q_bucket: np.ndarray | None, bucket: np.ndarray | None) -> Iterator[PairBlock]:
    """As exact_blocks, among the index's candidates only: entries of the query's signature, then of each with one bit flipped, in order, at most `budget`.

    Of these, the ones of the query's bucket if there are any, else all; a query without
    candidates is searched in its bucket.
    """
    step = max(1, PRODUCTS // len(proxy))
    flips = np.concatenate([[0], 1 << np.arange(n_planes)])
    order = np.argsort(sig, kind="stable")
    ordered = sig[order]
    for a in range(0, len(q), step):
        own = q[a : a + step]
        probes = q_sig[a : a + step, None] ^ flips
        lo, hi = (np.searchsorted(ordered, probes, side=side) for side in ("left", "right"))
        hi = np.minimum(hi, lo + np.maximum(0, budget - (np.cumsum(hi - lo, axis=1) - (hi - lo))))  # what the probes before have left
        count = (hi - lo).ravel()
        row = np.repeat(np.repeat(np.arange(len(own)), len(flips)), count)
        entry = order[np.repeat(lo.ravel() - np.cumsum(count) + count, count) + np.arange(count.sum())]
        if bucket is not None:
            same = q_bucket[a : a + step][row] == bucket[entry]
            any_same = np.bincount(row[same], minlength=len(own)) > 0
            row, entry = row[same | ~any_same[row]], entry[same | ~any_same[row]]
        alone = np.setdiff1d(np.arange(len(own)), row)
        if len(alone):
            more = np.ones((len(alone), len(proxy)), bool) if bucket is None else q_bucket[a : a + step][alone, None] == bucket[None, :]
            one, other = np.nonzero(more)
            row, entry = np.concatenate([row, alone[one]]), np.concatenate([entry, other])
        row, *rest = _ranked(own, proxy, k, row, entry)
        yield row + a, *rest


def best_pairs(q: np.ndarray, proxy: np.ndarray, k: int, q_bucket: np.ndarray | None, bucket: np.ndarray | None) -> PairBlock:
    """(query, entry, score, rank) of all of exact_blocks."""
    return tuple(np.concatenate(x) for x in zip(*exact_blocks(q, proxy, k, q_bucket, bucket), strict=True))


def topk_dot(queries: DataFrame, pool: DataFrame, k: int, by_bucket: bool = False) -> DataFrame:
    """image_id, y, x, entry, score, rank and more: exact search within an image, or within an image's bucket.

    An image's queries and pool meet in one task; scores are worked on some at a time.
    """

    def each(own: pa.Table, entries: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        if not entries.num_rows:
            raise ValueError(EMPTY_POOL)
        entries = entries.sort_by("entry")
        buckets = [t.column("bucket").to_numpy() if by_bucket else None for t in (own, entries)]
        row, at, score, rank = best_pairs(matrix(own.column("q")), matrix(entries.column("proxy")), k, *buckets)
        left, right = own.take(pa.array(row)), entries.take(pa.array(at))
        columns = [*(left.column(c) for c in RANGE), *(right.column(c) for c in ("entry", "dom", "tf")), left.column("bucket"), right.column("dy"), right.column("dx")]
        columns += [_nested(matrix(entries.column("d"))[at]), _nested(matrix(own.column("chans"))[row]), pa.array(score), pa.array(rank.astype(np.int32))]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    nested = pa.list_(pa.list_(pa.float64()))
    schema = pa.schema([("image_id", pa.int64()), ("y", pa.int32()), ("x", pa.int32()), ("entry", pa.int64()), ("dom", pa.int64()), ("tf", pa.int32()), ("bucket", pa.int32()), ("dy", pa.int32()), ("dx", pa.int32()), ("d", nested), ("r", nested), ("score", pa.float64()), ("rank", pa.int32())])
    left = queries.select(*RANGE, "bucket", "q", "chans").groupBy("image_id")
    right = pool.selectExpr("image_id AS pool_of", "bucket", *ENTRY).groupBy("pool_of")
    return left.cogroup(right).applyInArrow(each, FOUND)


def planes(count: int, size: int, seed: int) -> np.ndarray:
    """Hyperplanes of an index, drawn as NumPy does."""
    return np.random.default_rng(seed).standard_normal((count, size), dtype=np.float32).astype(float)


def signature(a: Column, normals: np.ndarray) -> Column:
    """A bit for each plane that the vector lies above."""
    bits = [F.when(dot(a, F.array(*map(F.lit, row.tolist()))) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, row in enumerate(normals)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def lsh_candidates(queries: DataFrame, pool: DataFrame, n_planes: int, budget: int) -> DataFrame:
    """image_id, y, x, entry, probe, at: entries of the query's signature (sig), then of each with one bit flipped, in order, at most `budget`."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(n_planes)))
    probes = queries.select(*RANGE, "sig", F.posexplode(flips).alias("probe", "flip")).select(*RANGE, "probe", F.col("sig").bitwiseXOR(F.col("flip")).alias("sig"))
    found = probes.join(pool.select("image_id", "sig", "entry"), ["image_id", "sig"])
    order = W.partitionBy(*RANGE).orderBy("probe", "entry")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= budget).select(*RANGE, "entry", "probe", "at")


def fit_pca(x: np.ndarray, dim: int, seed: int, sample: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """(mean, basis) of rows: the leading directions of a bounded sample; all axes if dim is not below their number."""
    if dim >= x.shape[1]:
        return x.mean(axis=0), np.eye(x.shape[1])
    if len(x) > sample:
        x = x[np.random.default_rng(seed).choice(len(x), sample, replace=False)]
    mean = x.mean(axis=0)
    return mean, np.linalg.svd(x - mean, full_matrices=False)[2][:dim]
