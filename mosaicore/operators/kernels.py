"""Dense kernels for one image: the work of `operators.batch`, in NumPy.

An image is an array of channels x height x width of doubles. The steps are those of
`operators.codec`; scores and products come from matrix multiplication.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from mosaicore.functions.pixels import LUMA, s_sets
from mosaicore.operators.search import fit_pca, planes
from mosaicore.operators.transforms import gather
from mosaicore.params import EncodeParams

#: Ranges that are scored at a time.
CHUNK = 256


@dataclass
class Code:
    """An encoded image; pools by block size, leaves in tile order."""

    height: int
    width: int
    orig_height: int
    orig_width: int
    channels: int
    pool_blocks: np.ndarray
    pool_strides: np.ndarray
    pool_offsets: np.ndarray
    domain_yx: np.ndarray
    leaf_yx: np.ndarray
    leaf_pool: np.ndarray
    leaf_dom: np.ndarray
    leaf_tf: np.ndarray
    codes: np.ndarray  # leaves x channels x 2; bytes if quantized, else single floats
    quantized: bool
    s_clip: float
    o_min: float
    o_max: float
    iterations_hint: int = 8
    leaf_mse: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def values(self) -> np.ndarray:
        """s and o of every leaf and channel."""
        if not self.quantized:
            return self.codes.astype(float)
        q = self.codes.astype(float)
        return np.stack([q[..., 0] * (2 * self.s_clip) / 255 - self.s_clip, self.o_min + q[..., 1] * (self.o_max - self.o_min) / 255], axis=-1)


def luma(image: np.ndarray) -> np.ndarray:
    return image[0] if len(image) == 1 else np.tensordot(LUMA, image, axes=1)


def entropy(blocks: np.ndarray) -> np.ndarray:
    """Of each row of values."""
    bins = (np.clip(blocks, 0, 1) * 255).astype(np.int64)
    flat = np.bincount((np.arange(len(bins))[:, None] * 256 + bins).ravel(), minlength=256 * len(bins)).reshape(-1, 256)
    p = flat / blocks.shape[1]
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1) / 8


def variance(blocks: np.ndarray) -> np.ndarray:
    return np.maximum((blocks * blocks).mean(axis=1) - blocks.mean(axis=1) ** 2, 0)


def bucket_ids(blocks: np.ndarray, n: int) -> np.ndarray:
    s = 0.5 * np.clip(entropy(blocks), 0, 1) + 0.5 * np.clip(variance(blocks) / 0.25, 0, 1)
    return np.clip((s * n).astype(np.int64), 0, n - 1)


def normalise_rows(a: np.ndarray) -> np.ndarray:
    a = a - a.mean(axis=1, keepdims=True)
    a = a / np.sqrt((a * a).mean(axis=1, keepdims=True) + 1e-12)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True) + 1e-12)


def windows(planes_: np.ndarray, block: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(downsampled windows: channels x windows x pixels; their y, x), row by row."""
    view = np.lib.stride_tricks.sliding_window_view(planes_, (2 * block, 2 * block), axis=(1, 2))[:, ::stride, ::stride]
    c, ny, nx = view.shape[:3]
    small = view.reshape(c, ny * nx, block, 2, block, 2).sum(axis=(3, 5)) * 0.25
    yx = np.stack(np.meshgrid(np.arange(ny) * stride, np.arange(nx) * stride, indexing="ij"), axis=-1).reshape(-1, 2)
    return small.reshape(c, ny * nx, block * block), yx


def tiles(planes_: np.ndarray, yx: np.ndarray, block: int) -> np.ndarray:
    """channels x tiles x pixels at the given corners."""
    dy, dx = np.divmod(np.arange(block * block), block)
    return planes_[:, yx[:, :1] + dy, yx[:, 1:] + dx]


def signatures(a: np.ndarray, normals: np.ndarray) -> np.ndarray:
    return ((a @ normals.T > 0).astype(np.int64) << np.arange(len(normals))).sum(axis=1)


class Pool:
    """The dictionary of one block size."""

    def __init__(self, image: np.ndarray, p: EncodeParams, block: int):
        self.p, self.block = p, block
        plane = luma(image)[None]
        if min(plane.shape[1:]) < 2 * block:
            raise ValueError("domain pool empty: the image is smaller than a domain")
        proxy, self.yx = windows(plane, block, p.stride)
        chans, _ = windows(image, block, p.stride)
        proxy = proxy[0]
        keep = np.arange(len(proxy))
        if p.entropy_thresh > 0:
            keep = keep[entropy(proxy) >= p.entropy_thresh]
        if p.max_domains is not None and len(keep) > p.max_domains:
            keep = keep[np.sort(np.random.default_rng(p.seed + block).choice(len(keep), p.max_domains, replace=False))]
        if not len(keep):
            raise ValueError("domain pool empty: no domain passes the entropy threshold")
        proxy, chans, self.yx = proxy[keep], chans[:, keep], self.yx[keep]
        tfs = p.transforms
        source = np.array([[-1 if s is None else s for s in gather(block, t)] for t in tfs])
        moved = lambda a: np.where(source >= 0, a[..., source], 0).reshape(*a.shape[:-2], -1, block * block)
        self.chans, self.proxy = moved(chans), normalise_rows(moved(proxy))
        self.dom, self.tf = np.repeat(np.arange(len(keep)), len(tfs)), np.tile(tfs, len(keep))
        self.bucket = np.repeat(bucket_ids(proxy, p.bucket_count), len(tfs)) if p.use_buckets else np.zeros(len(self.dom), np.int64)
        self.d, self.dd = self.chans.sum(axis=2), (self.chans * self.chans).sum(axis=2)
        if p.backend != "dot":
            rows = self.proxy
            if p.backend == "pca_lsh":
                self.mean, self.basis = fit_pca(rows, p.pca_dim, p.seed + block)
                rows = (rows - self.mean) @ self.basis.T
            self.normals = planes(p.lsh_planes, rows.shape[1], p.seed + block)
            sig = signatures(rows, self.normals)
            self.by_sig = np.argsort(sig, kind="stable")
            self.sig = sig[self.by_sig]

    def probe(self, q: np.ndarray) -> list[np.ndarray]:
        """Candidates of each query from the index, in order of probes."""
        rows = (q - self.mean) @ self.basis.T if self.p.backend == "pca_lsh" else q
        sig = signatures(rows, self.normals)
        probes = sig[:, None] ^ np.concatenate([[0], 1 << np.arange(self.p.lsh_planes)])
        lo, hi = np.searchsorted(self.sig, probes), np.searchsorted(self.sig, probes, side="right")
        out = []
        for a, b in zip(lo, hi, strict=True):
            some = np.flatnonzero(b > a)
            found = [self.by_sig[a[k] : b[k]] for k in some]
            out.append(np.concatenate(found)[: self.p.lsh_budget] if found else np.zeros(0, np.int64))
        return out

    def ranked(self, q: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Entries of each query by score, then number: queries x topk, -1 where there are fewer."""
        k = min(self.p.topk, len(self.dom))
        out = np.full((len(q), k), -1)
        allowed = self.bucket[None, :] == bucket[:, None] if self.p.use_buckets else None
        score = q @ self.proxy.T
        if self.p.backend == "dot":
            if allowed is not None:
                score = np.where(allowed, score, -np.inf)
        else:
            mask = np.zeros(score.shape, bool)
            for i, found in enumerate(self.probe(q)):
                if len(found) and allowed is not None and (same := found[allowed[i, found]]).size:
                    found = same
                mask[i, found] = True
                if not len(found):
                    mask[i] = True if allowed is None else allowed[i]
            score = np.where(mask, score, -np.inf)
        if k < score.shape[1]:
            cut = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        else:
            cut = score.min(axis=1, keepdims=True)
        for i, row in enumerate(score):
            own = np.flatnonzero((row >= cut[i]) & (row > -np.inf))
            own = own[np.argsort(-row[own], kind="stable")][:k]
            out[i, : len(own)] = own
        return out


def quantise(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """0..255, half away from zero."""
    return np.clip(np.floor((np.clip(x, lo, hi) - lo) * 255 / (hi - lo) + 0.5), 0, 255)


def match(image: np.ndarray, pool: Pool, yx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(domain, transform, stored codes: tiles x channels x 2, error) of every tile."""
    p, block = pool.p, pool.block
    n = block * block
    doms, tfs = np.zeros(len(yx), np.int64), np.zeros(len(yx), np.int64)
    codes, errors = np.zeros((len(yx), len(image), 2)), np.full(len(yx), np.inf)
    sets = [np.array(s) for s in s_sets(p.bucket_count, p.s_clip)]
    plane = luma(image)[None]
    for at in range(0, len(yx), CHUNK):
        own = yx[at : at + CHUNK]
        q = tiles(plane, own, block)[0]
        bucket = bucket_ids(q, p.bucket_count) if p.use_buckets else np.zeros(len(q), np.int64)
        norm2 = (q * q).sum(axis=1, keepdims=True)
        unit = np.where(norm2 > 1e-24, q / np.sqrt(np.where(norm2 > 1e-24, norm2, 1)), q)
        cand = pool.ranked(unit, bucket)
        some = np.maximum(cand, 0)
        r = tiles(image, own, block)
        mse, stored = np.zeros(cand.shape), []
        for c in range(len(image)):
            rd = np.take_along_axis(r[c] @ pool.chans[c].T, some, axis=1)
            d, dd = pool.d[c][some], pool.dd[c][some]
            sr, rr = r[c].sum(axis=1)[:, None], (r[c] * r[c]).sum(axis=1)[:, None]
            denom = n * dd - d * d
            flat = np.abs(denom) < 1e-18
            s = np.where(flat, 0, (n * rd - d * sr) / np.where(flat, 1, denom))
            o = (sr - s * d) / n
            if p.use_s_sets:
                for i, b in enumerate(bucket):
                    s[i] = sets[b][np.abs(sets[b][None, :] - s[i][:, None]).argmin(axis=1)]
            s, o = np.clip(s, -p.s_clip, p.s_clip), np.clip(o, p.o_min, p.o_max)
            code = np.stack([s, o], axis=-1)
            if p.quantized:
                code = np.stack([quantise(s, -p.s_clip, p.s_clip), quantise(o, p.o_min, p.o_max)], axis=-1)
                s, o = code[..., 0] * (2 * p.s_clip) / 255 - p.s_clip, p.o_min + code[..., 1] * (p.o_max - p.o_min) / 255
            mse += (rr + s * s * dd + n * o * o - 2 * s * rd - 2 * o * sr + 2 * s * o * d) / n
            stored.append(code)
        mse = np.where(cand >= 0, mse / len(image), np.inf)
        best = mse.argmin(axis=1)
        rows = np.arange(len(own))
        found = cand[rows, best] >= 0
        entry = some[rows, best]
        here = np.arange(at, at + len(own))[found]
        doms[here], tfs[here], errors[here] = pool.dom[entry[found]], pool.tf[entry[found]], mse[rows, best][found]
        codes[here] = np.stack([code[rows, best] for code in stored], axis=1)[found]
    return doms, tfs, codes, errors


def pad(image: np.ndarray, block: int) -> np.ndarray:
    h, w = image.shape[1:]
    return np.pad(image, ((0, 0), (0, -h % block), (0, -w % block)), mode="edge")


def encode(image: np.ndarray, p: EncodeParams) -> Code:
    p = p.checked()
    if image.ndim != 3 or len(image) not in (1, 3):
        raise ValueError("an image has one channel or three")
    h, w = image.shape[1:]
    image = pad(image.astype(float), p.max_block)
    ny, nx = image.shape[1] // p.max_block, image.shape[2] // p.max_block
    yx = np.stack(np.meshgrid(np.arange(ny), np.arange(nx), indexing="ij"), axis=-1).reshape(-1, 2) * p.max_block
    pools, parts = [], []
    for level, block in enumerate(p.levels):
        pools.append(Pool(image, p, block))
        if not len(yx):
            continue
        doms, tfs, codes, errors = match(image, pools[-1], yx)
        done = np.ones(len(yx), bool) if block == p.levels[-1] else errors <= p.max_mse
        parts.append((yx[done], np.full(done.sum(), level), doms[done], tfs[done], codes[done], errors[done]))
        half = block // 2
        yx = (yx[~done][:, None] + np.array([[0, 0], [0, half], [half, 0], [half, half]])).reshape(-1, 2)
    yx, level, doms, tfs, codes, errors = (np.concatenate(x) for x in zip(*parts, strict=True))
    path = np.zeros(len(yx), np.int64)
    for k in range(p.max_block.bit_length() - 1):
        path |= (yx[:, 1] >> k & 1) << 2 * k | (yx[:, 0] >> k & 1) << 2 * k + 1
    order = np.lexsort((path, yx[:, 1] // p.max_block, yx[:, 0] // p.max_block))
    return Code(
        image.shape[1], image.shape[2], h, w, len(image), np.array(p.levels), np.full(len(pools), p.stride), np.cumsum([0] + [len(x.yx) for x in pools]), np.concatenate([x.yx for x in pools]),
        yx[order], level[order], doms[order], tfs[order], codes[order].astype(np.uint8 if p.quantized else np.float32), p.quantized, p.s_clip, p.o_min, p.o_max, p.iterations_hint, errors[order],
    )


def decode(code: Code, iterations: int = 8) -> np.ndarray:
    """channels x height x width, cropped. A step is one gather, as places do not change between steps."""
    h, w = code.height, code.width
    source, zero = np.zeros(h * w, np.int64), np.ones(h * w, bool)
    s, o = (np.zeros((code.channels, h * w)) for _ in range(2))
    blocks = code.pool_blocks[code.leaf_pool]
    corner = code.domain_yx[code.pool_offsets[code.leaf_pool] + code.leaf_dom].astype(np.int64)
    values = code.values()
    for block in np.unique(blocks).tolist():
        for tf in np.unique(code.leaf_tf[blocks == block]).tolist():
            own = np.flatnonzero((blocks == block) & (code.leaf_tf == tf))
            table = np.array([-1 if x is None else x for x in gather(block, tf)])
            dy, dx = np.divmod(np.arange(block * block), block)
            place = (code.leaf_yx[own, :1].astype(np.int64) + dy) * w + code.leaf_yx[own, 1:].astype(np.int64) + dx
            py, px = np.divmod(np.maximum(table, 0), block)
            source[place] = (corner[own, :1] + 2 * py) * w + corner[own, 1:] + 2 * px
            zero[place] = table < 0
            for c in range(code.channels):
                s[c][place], o[c][place] = values[own, c, :1], values[own, c, 1:]
    now = np.zeros((code.channels, h * w))
    for _ in range(iterations):
        small = (now[:, source] + now[:, source + 1] + now[:, source + w] + now[:, source + w + 1]) * 0.25
        now = np.clip(s * np.where(zero, 0, small) + o, 0, 1)
    return now.reshape(code.channels, h, w)[:, : code.orig_height, : code.orig_width]


def mse(a: np.ndarray, b: np.ndarray) -> float:
    return float(((a.astype(float) - b.astype(float)) ** 2).mean())


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    e = mse(a, b)
    return 99.0 if e <= 0 else float(-10 * np.log10(e))
