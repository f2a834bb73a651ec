"""python -m mosaicore encode|decode|overlay|process IN OUT: folders of images to code files and back, or converted and resized."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from pyspark.sql import functions as F

from mosaicore.operators import batch
from mosaicore.operators.overlay import outlined
from mosaicore.params import PRESETS, EncodeParams, encode_params, get_section, load_yaml, pick_opt_int
from mosaicore.session import session, ship
from mosaicore.sources.codefile import qualified, read_codes, register
from mosaicore.sources.imagefile import read_images, relative, resized, to_png


log = logging.getLogger("mosaicore")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mosaicore", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("encode", "decode", "overlay", "process"):
        own = commands.add_parser(name)
        own.add_argument("input")
        own.add_argument("output")
        own.add_argument("--config")
        if name in ("encode", "process"):
            own.add_argument("--mode", choices=["L", "RGB"])
        if name == "process":
            own.add_argument("--width", type=int)
            own.add_argument("--height", type=int)
        elif name == "encode":
            own.add_argument("--preset", choices=sorted(PRESETS))
            own.add_argument("--max-side", type=int, default=2048)
            for f in fields(EncodeParams):
                kind = {"bool": lambda s: s.lower() in ("1", "true", "yes"), "int": int, "float": float, "str": str}.get(str(f.type).split(" ")[0], None)
                if f.name != "transform_ids" and kind is not None:
                    own.add_argument("--" + f.name.replace("_", "-"), type=kind)
        else:
            own.add_argument("--iters", type=int)
            if name == "overlay":
                own.add_argument("--upscale", type=int, default=1)
                own.add_argument("--thickness", type=int, default=1)
                own.add_argument("--line-value", type=int, default=255)
                own.add_argument("--alpha", type=float, default=1.0)
                own.add_argument("--background", choices=["decode", "black"], default="decode")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = load_yaml(args.config) if args.config else {}
    spark = session("mosaicore")
    register(spark)
    ship(spark)
    log.info("%s: %s to %s", args.command, args.input, args.output)
    stem = relative(F.col("name"), qualified(spark, args.input))  # folders below the input stay folders
    if args.command == "process":
        planes = read_images(spark, args.input, args.mode, None)
        if args.width and args.height:  # both are needed
            planes = resized(planes, args.height, args.width)
        to_png(planes.withColumn("name", stem)).write.format("ffc2").option("suffix", ".png").mode("append").save(args.output)
        return 0
    if args.command == "encode":
        flags = {f.name: getattr(args, f.name, None) for f in fields(EncodeParams)}
        section = get_section(config, "encode")
        if args.preset:
            p = PRESETS[args.preset]
            flags = {f.name: getattr(p, f.name) for f in fields(EncodeParams)} | {k: v for k, v in flags.items() if v is not None}
        codes = batch.encode(read_images(spark, args.input, args.mode, args.max_side), encode_params(section, **flags))
        codes.select(stem.alias("name"), "code").write.format("ffc2").mode("append").save(args.output)
        return 0
    iterations = args.iters if args.iters is not None else pick_opt_int(get_section(config, "decode"), "iterations", None, "iters")  # else as the file says
    codes = read_codes(spark, args.input).withColumn("image_id", F.xxhash64("name"))
    planes = batch.decode(codes, iterations)
    if args.command == "overlay":
        images = planes.selectExpr("image_id", "height", "width", "height AS orig_height", "width AS orig_width")
        gray = outlined(batch.to_pixels(planes), batch.leaves(codes), images, background=args.background, thickness=args.thickness, line_value=args.line_value, alpha=args.alpha, upscale=args.upscale).selectExpr("image_id", "0 AS ch", "y", "x", "g / 255D AS v")
        planes = batch.to_planes(gray).drop("name").join(codes.selectExpr("image_id", "concat(name, '.blocks') AS name"), "image_id")
    to_png(planes).write.format("ffc2").option("suffix", ".png").mode("append").save(args.output)
    return 0


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    raise SystemExit(main())
