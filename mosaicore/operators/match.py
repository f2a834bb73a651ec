"""The best match of every range block, an image's ranges and domains in one task.

A range has image_id, y, x, bucket and chans (its block, an array for each channel); a domain has image_id, dom, bucket,
y, x and chans. Transforms, proxies, search and least squares are worked out in Arrow, some ranges at a time: neither a
transformed domain nor a pair of blocks becomes a row. Sums run from the first place to the last, and terms are added in the
order of `functions.pixels` and `operators.regress`, so that the results are those of the declarative columns, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mosaicore.functions.pixels import LUMA, s_sets
from mosaicore.operators.search import EMPTY_POOL, RANGE, PairBlock, exact_blocks, fit_pca, index_blocks, matrix, planes, summed
from mosaicore.operators.transforms import gather
from mosaicore.params import EncodeParams

LEAVES = "image_id long, y int, x int, block int, dom long, tf int, dy int, dx int, codes array<struct<s: double, o: double, qs: int, qo: int>>, mse double"
#: Values of a pair of blocks that are held at a time.
VALUES = 1 << 19


def luma(chans: np.ndarray) -> np.ndarray:
    """Blocks x channels x places to blocks x places."""
    return chans[:, 0] if chans.shape[1] == 1 else chans[:, 0] * LUMA[0] + chans[:, 1] * LUMA[1] + chans[:, 2] * LUMA[2]


def normalised(a: np.ndarray) -> np.ndarray:
    """As `functions.pixels.normalised`, of every row."""
    n = a.shape[1]
    c = a - (summed(a) / n)[:, None]
    c = c / np.sqrt(summed(c * c) / n + 1e-12)[:, None]
    return c / np.sqrt(summed(c * c) + 1e-12)[:, None]


def unit(a: np.ndarray) -> np.ndarray:
    """As `functions.pixels.unit`, of every row."""
    n = summed(a * a)
    return np.where((n > 1e-24)[:, None], a / np.sqrt(np.where(n > 1e-24, n, 1.0))[:, None], a)


def moved(a: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Blocks (places last) to blocks x transforms, in this order along the first axis."""
    out = np.where(sources >= 0, a[..., sources], 0.0)
    return np.moveaxis(out, -2, 1).reshape(-1, *a.shape[1:])


def quantised(x: np.ndarray, lo: float, width: float) -> np.ndarray:
    """0..255, rounded half away from zero."""
    q = (x - lo) * 255.0 / width
    low = np.floor(q)
    return np.clip(low + (q - low >= 0.5), 0, 255)


def pairs(q: np.ndarray, proxy: np.ndarray, p: EncodeParams, block: int, q_bucket: np.ndarray | None, bucket: np.ndarray | None) -> Iterator[PairBlock]:
    """Ranked candidates by the parameters' backend."""
    if p.backend == "dot":
        return exact_blocks(q, proxy, p.topk, q_bucket, bucket)
    low = [q, proxy]
    if p.backend == "pca_lsh":
        mean, basis = fit_pca(proxy, p.pca_dim, p.seed + block)
        low = [np.stack([summed((a - mean) * row) for row in basis], axis=1) for a in low]
    normals = planes(p.lsh_planes, low[0].shape[1], p.seed + block)
    signed = [sum((summed(a * row) > 0).astype(np.int64) << i for i, row in enumerate(normals)) for a in low]
    return index_blocks(q, proxy, p.topk, *signed, p.lsh_planes, p.lsh_budget, q_bucket, bucket)


class Solver:
    """Least squares of one image's ranges on its pool."""

    def __init__(self, r: np.ndarray, d: np.ndarray, bucket: np.ndarray, p: EncodeParams):
        self.r, self.d, self.bucket, self.p, self.n = r, d, bucket, p, float(r.shape[2])
        self.sums = summed(d), summed(d * d), summed(r), summed(r * r)
        self.sets = [np.array(own) for own in s_sets(p.bucket_count, p.s_clip)]

    def solved(self, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(s, o, qs, qo: 4 x pairs x channels; the pair's error)."""
        p, n = self.p, self.n
        d, dd, r, rr = self.sums[0][at], self.sums[1][at], self.sums[2][row], self.sums[3][row]
        rd = summed(self.r[row] * self.d[at])
        denom = n * dd - d * d
        flat = np.abs(denom) < 1e-18
        s = np.where(flat, 0.0, (n * rd - d * r) / np.where(flat, 1.0, denom))
        o = (r - s * d) / n
        if p.use_s_sets:
            for b in np.unique(self.bucket[row]):
                own = self.bucket[row] == b
                s[own] = self.sets[b][np.abs(self.sets[b] - s[own][..., None]).argmin(axis=-1)]
        s, o = np.clip(s, -p.s_clip, p.s_clip), np.clip(o, p.o_min, p.o_max)
        qs = qo = np.zeros_like(s)
        if p.quantized:
            qs, qo = quantised(s, -p.s_clip, 2.0 * p.s_clip), quantised(o, p.o_min, p.o_max - p.o_min)
            s, o = qs * (2.0 * p.s_clip) / 255.0 - p.s_clip, p.o_min + qo * (p.o_max - p.o_min) / 255.0
        error = (rr + s * s * dd + n * o * o - 2.0 * s * rd - 2.0 * o * r + 2.0 * s * o * d) / n
        return np.stack([s, o, qs, qo]), summed(error) / error.shape[1]

    def best(self, found: Iterator[PairBlock]) -> tuple[np.ndarray, ...]:
        """(entry, -1 where there is none; s, o, qs, qo: 4 x ranges x channels; error) of every range, the better rank of equals."""
        size, chans = self.r.shape[:2]
        entry, error = np.full(size, -1), np.full(size, np.inf)
        codes = np.zeros((4, size, chans))
        if self.p.quantized:
            codes[0], codes[1] = -self.p.s_clip, self.p.o_min
        step = max(1, VALUES // self.r[0].size)
        for row, at, _, rank in found:
            tried = [self.solved(row[i : i + step], at[i : i + step]) for i in range(0, len(row), step)]
            if not tried:
                continue
            code, mse = np.concatenate([x[0] for x in tried], axis=1), np.concatenate([x[1] for x in tried])
            order = np.lexsort((rank, mse, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            entry[row[first]], error[row[first]], codes[:, row[first]] = at[first], mse[first], code[:, first]
        return entry, codes, error


def best_match(queries: DataFrame, domains: DataFrame, p: EncodeParams, block: int) -> DataFrame:
    """The candidate of least error of every range (LEAVES), the first of equals; a range without any has zero codes and an infinite error.

    An image that has ranges and no domain is an error.
    """
    tfs = p.transforms
    pair = pa.struct([("s", pa.float64()), ("o", pa.float64()), ("qs", pa.int32()), ("qo", pa.int32())])
    schema = pa.schema([("image_id", pa.int64()), *((c, pa.int32()) for c in ("y", "x", "block")), ("dom", pa.int64()), *((c, pa.int32()) for c in ("tf", "dy", "dx")), ("codes", pa.list_(pair)), ("mse", pa.float64())])

    def each(own: pa.Table, pool: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        if not pool.num_rows:
            raise ValueError(EMPTY_POOL)
        pool = pool.sort_by("dom")
        sources = np.array([[-1 if s is None else s for s in gather(block, t)] for t in tfs])
        r, chans = matrix(own.column("chans")), matrix(pool.column("chans"))
        q_bucket, bucket = own.column("bucket").to_numpy(), np.repeat(pool.column("bucket").to_numpy(), len(tfs))
        found = pairs(unit(luma(r)), normalised(moved(luma(chans), sources)), p, block, *((q_bucket, bucket) if p.use_buckets else (None, None)))
        entry, codes, error = Solver(r, moved(chans, sources), q_bucket, p).best(found)
        some = entry >= 0
        k = np.maximum(entry, 0)
        domain = pool.take(pa.array(k // len(tfs)))
        left = [np.where(some, domain.column(c).to_numpy(), 0) for c in ("dom", "dy", "dx")]
        null = None if p.quantized else np.repeat(some, r.shape[1])
        fields = [pa.array(codes[0].ravel()), pa.array(codes[1].ravel()), *(pa.array(codes[i].ravel().astype(np.int32), mask=null) for i in (2, 3))]
        struct = pa.ListArray.from_arrays(pa.array(np.arange(0, codes[0].size + 1, r.shape[1], dtype=np.int32)), pa.StructArray.from_arrays(fields, fields=list(pair)))
        columns = [*(own.column(c) for c in RANGE), np.full(len(r), block), left[0], np.where(some, np.array(tfs)[k % len(tfs)], 0), *left[1:], struct, error]
        return pa.table([(pa.array(c) if isinstance(c, np.ndarray) else c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    left = queries.select(*RANGE, "bucket", "chans").groupBy("image_id")
    right = domains.selectExpr("image_id AS pool_of", "dom", "bucket", "y AS dy", "x AS dx", "chans").groupBy("pool_of")
    return left.cogroup(right).applyInArrow(each, LEAVES)
