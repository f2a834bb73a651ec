"""Parameter sweeps: grids of settings as rows, and the cases of a benchmark."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from itertools import islice, product
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from mosaicore.params import EncodeParams, encode_params, get_section, pick_int, pick_opt_int, pick_str


def range_values(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... up to stop, inclusive but for rounding."""
    if step == 0:
        raise ValueError("step must not be zero")
    slack = abs(step) * 1e-12 + 1e-12
    count = int((stop - start) / step + slack / abs(step)) + 1
    return [start + k * step for k in range(max(0, count))]


def values(spec: Any) -> list[Any]:
    """A list as it is; start, stop and step as a range, of whole numbers if all are; anything else as one value."""
    if isinstance(spec, list):
        return spec
    if isinstance(spec, Mapping) and {"start", "stop", "step"} <= spec.keys():
        found = range_values(*(float(spec[k]) for k in ("start", "stop", "step")))
        return [int(v) for v in found] if all(v == int(v) for v in found) else found
    return [spec]


def settings(overrides: Mapping[str, Any]) -> Iterable[dict[str, Any]]:
    """Every combination, keys in order, the last key fastest."""
    keys = sorted(overrides)
    return (dict(zip(keys, combination, strict=True)) for combination in product(*(values(overrides[k]) for k in keys)))


def grid(spark: SparkSession, overrides: Mapping[str, Any], max_items: int = 512) -> DataFrame:
    """point long, name and a column per key, one row per combination; the grid is expanded by Spark."""
    out = None
    for key in sorted(overrides):
        own = spark.createDataFrame([(k, v) for k, v in enumerate(values(overrides[key]))], [f"_{key}", key])
        out = own if out is None else out.crossJoin(own)  # a few values for each parameter
    keys = sorted(overrides)
    ordered = out.orderBy(*(f"_{k}" for k in keys)).limit(max_items)
    place, size = "0", 1
    for key in reversed(keys):
        place = f"{place} + `_{key}` * {size}"
        size *= len(values(overrides[key]))
    name = "concat_ws('__', " + ", ".join(f"concat('{k}=', cast(`{k}` AS string))" for k in keys) + ")"
    return ordered.selectExpr(f"cast({place} AS long) AS point", f"{name} AS name", *(f"`{k}`" for k in keys))


def cases(base: Mapping[str, Any], overrides: Mapping[str, Any], max_items: int = 512) -> list[tuple[str, EncodeParams]]:
    """(name, parameters) of each combination over a base section."""
    return [("__".join(f"{k}={v}" for k, v in own.items()) or "default", encode_params({**base, **own})) for own in islice(settings(overrides), max_items)]


@dataclass(frozen=True)
class Picture:
    """An image of a case: a file (path) or a pattern; channels 0 are those of the file, no size is its own."""

    name: str
    path: Path | None = None
    pattern: str = ""
    channels: int = 0
    size: int | None = None
    seed: int = 0


def pictures(case: Mapping[str, Any], folder: str | Path = ".") -> list[Picture]:
    """The images of a case: those listed under "images", the one of "image" or "path", or else a pattern. Paths are below the folder."""
    folder = Path(folder)
    listed = case.get("images")
    if listed is not None and (isinstance(listed, (str, Mapping)) or not all(isinstance(x, Mapping) for x in listed)):
        raise ValueError("images must be a list of mappings")
    found = []
    for k, own in enumerate([case] if listed is None else listed):
        path = own.get("path") or own.get("image") if listed is not None else own.get("image") or own.get("path")
        if path is None and listed is not None:
            raise ValueError("an image has no path")
        channels, size = pick_int(own, "channels", 0 if path else 3), pick_opt_int(own, "size")
        if channels not in ((0, 1, 3) if path else (1, 3)):
            raise ValueError("channels must be 1 or 3")
        if path is None:
            pattern = pick_str(own, "pattern", "random")
            found.append(Picture(f"syn_{pattern}_{channels}c", None, pattern, channels, size, pick_int(own, "seed", 0)))
        else:
            name = own.get("name") or f"img{k}" if listed is not None else own.get("image_name") or Path(path).stem
            found.append(Picture(str(name), (folder / path).resolve(), channels=channels, size=size))
    return found


def decode_arguments(config: Mapping[str, Any]) -> dict[str, int]:
    """What the section "decode" of a configuration gives to the decoder."""
    return {"iterations": pick_int(get_section(config, "decode"), "iterations", 8, "iters")}


def selected(names: list[str], case: str | None = None, prefix: str | None = None, span: str | None = None) -> list[str]:
    """Cases by exact name, by prefix, or by a slice a:b."""
    out = [n for n in names if (case is None or n == case) and (prefix is None or n.startswith(prefix))]
    if span is not None:
        a, _, b = span.partition(":")
        out = out[int(a) if a else None : int(b) if b else None]
    return out
