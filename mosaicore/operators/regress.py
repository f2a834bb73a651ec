"""Least squares of range blocks on domain blocks, from sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mosaicore.functions.pixels import clip, dequant_o, dequant_s, dot, quant_o, quant_s, snap, total


@dataclass(frozen=True)
class Sums:
    """n, sums of both sides, of squares and of products."""

    n: Column
    d: Column
    r: Column
    dd: Column
    rr: Column
    rd: Column


def sums_of(d: Column, r: Column) -> Sums:
    return Sums(F.size(r).cast("double"), total(d), total(r), dot(d, d), dot(r, r), dot(r, d))


def solved(x: Sums) -> tuple[Column, Column]:
    """Slope and intercept; a flat domain gives 0 and the mean."""
    denom = x.n * x.dd - x.d * x.d
    flat = F.abs(denom) < 1e-18
    s = F.when(flat, 0.0).otherwise((x.n * x.rd - x.d * x.r) / F.when(flat, 1.0).otherwise(denom))
    return s, (x.r - s * x.d) / x.n


def sse(x: Sums, s: Column, o: Column) -> Column:
    """Squared error of s d + o, from the sums."""
    return x.rr + s * s * x.dd + x.n * o * o - 2.0 * s * x.rd - 2.0 * o * x.r + 2.0 * s * o * x.d


def coded(s: Column, o: Column, s_clip: float, o_min: float, o_max: float, quantized: bool, choices: Column | None = None) -> Column:
    """struct(s, o, qs, qo) as it is stored: snapped, clipped and, if asked for, quantised."""
    s = clip(snap(s, choices) if choices is not None else s, -s_clip, s_clip)
    o = clip(o, o_min, o_max)
    if not quantized:
        null = F.lit(None).cast("int")
        return F.struct(s.alias("s"), o.alias("o"), null.alias("qs"), null.alias("qo"))
    qs, qo = quant_s(s, s_clip), quant_o(o, o_min, o_max)
    return F.struct(dequant_s(qs, s_clip).alias("s"), dequant_o(qo, o_min, o_max).alias("o"), qs.alias("qs"), qo.alias("qo"))
