"""Columns over pixel values, blocks (arrays of doubles) and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue in luma, and in the grey of overlays.
LUMA = (0.2989, 0.5870, 0.1140)
GRAY = (0.299, 0.587, 0.114)


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.least(F.greatest(x, lo), hi)


def weighted(ch: Column, v: Column, weights: tuple[float, float, float]) -> Column:
    """v times its channel's weight; to be summed over channels."""
    return v * F.when(ch == 0, weights[0]).when(ch == 1, weights[1]).otherwise(weights[2])


def clamp_u8(v: Column) -> Column:
    """To 0..255, cut off."""
    return F.floor(clip(v, 0, 1) * 255).cast("int")


def save_u8(v: Column) -> Column:
    """As an image is saved: clipped after scaling, cut off."""
    return F.floor(clip(v * 255, 0, 255)).cast("int")


def img_u8(v: Column) -> Column:
    """To 0..255, rounded half to even."""
    return clip(F.bround(v * 255).cast("double"), 0, 255).cast("int")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """Centred, then scaled by standard deviation and by length; a constant row gives zeros."""
    centred = lambda c: _let(total(c) / F.size(c), lambda m: F.transform(c, lambda x: x - m))
    scaled = lambda c: _let(F.sqrt(dot(c, c) / F.size(c) + 1e-12), lambda s: F.transform(c, lambda x: x / s))
    unit = lambda c: _let(F.sqrt(dot(c, c) + 1e-12), lambda s: F.transform(c, lambda x: x / s))
    return _let(_let(_let(a, centred), scaled), unit)


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def unit(a: Column) -> Column:
    """Scaled to length 1, not centred; rows that are nearly zero stay."""
    return _let(F.struct(a.alias("a"), dot(a, a).alias("n")), lambda t: F.when(t["n"] > 1e-24, F.transform(t["a"], lambda x: x / F.sqrt(t["n"]))).otherwise(t["a"]))


def variance(a: Column) -> Column:
    mean = total(a) / F.size(a)
    return F.greatest(dot(a, a) / F.size(a) - mean * mean, F.lit(0.0))


def entropy(a: Column) -> Column:
    """Shannon entropy of the 256-bin histogram, in bits, over 8: sums over each value's share, from its run in the sorted bins."""
    bins = F.transform(a, lambda x: F.floor(clip(x, 0, 1) * 255).cast("int"))
    counts = lambda b: F.transform(F.array_distinct(b), lambda k: F.size(F.filter(b, lambda x: x == k)) / F.size(b))
    return _let(bins, lambda b: -F.aggregate(counts(b), F.lit(0.0), lambda s, p: s + p * F.log2(p)) / 8)


def bucket_id(ent: Column, var: Column, n: int) -> Column:
    s = 0.5 * clip(ent, 0, 1) + 0.5 * clip(var / 0.25, 0, 1)
    return clip(F.floor(s * n).cast("double"), 0, n - 1).cast("int")


def quant_s(s: Column, s_clip: float) -> Column:
    """0..255, rounded half away from zero."""
    return clip(F.round((clip(s, -s_clip, s_clip) + s_clip) * 255.0 / (2.0 * s_clip)), 0, 255).cast("int")


def dequant_s(q: Column, s_clip: float) -> Column:
    return q * (2.0 * s_clip) / 255.0 - s_clip


def quant_o(o: Column, o_min: float, o_max: float) -> Column:
    return clip(F.round((clip(o, o_min, o_max) - o_min) * 255.0 / (o_max - o_min)), 0, 255).cast("int")


def dequant_o(q: Column, o_min: float, o_max: float) -> Column:
    return o_min + q * (o_max - o_min) / 255.0


def s_sets(n: int, s_clip: float) -> list[list[float]]:
    """The values that s may take in each of n buckets; higher buckets also have negative ones."""
    out = []
    for i in range(n):
        top = min(max(0.2 + 0.79 * (i / (n - 1) if n > 1 else 0.0), 0.05), s_clip)
        steps = [top * k / 4 for k in range(5)]
        out.append([-v for v in steps[1:3]] * (i >= n // 2) + steps)
    return out


def snap(s: Column, choices: Column) -> Column:
    """The nearest of an array of values, the first of equals; s itself if there is none."""
    near = F.array_min(F.transform(choices, lambda v, i: F.struct(F.abs(v - s).alias("d"), i.alias("i"), v.alias("v"))))
    return F.coalesce(near["v"], s)
