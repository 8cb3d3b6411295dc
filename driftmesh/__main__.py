"""Command line: ``python -m driftmesh --feature cp --synthetic woven --output curves.json`` tracks features of one source."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from .sources.config import SYNTHETIC
from .tracker import FEATURES, summary, track


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftmesh", description="Extract and track features of time-varying fields.")
    p.add_argument("-f", "--feature", required=True, choices=sorted(FEATURES))
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--synthetic", choices=sorted(SYNTHETIC))
    source.add_argument("-i", "--input", help="file name or glob")
    p.add_argument("--input-format", default="")
    p.add_argument("-m", "--mesh", default="", help="VTK unstructured grid of a mesh field")
    p.add_argument("--var", default="", help="variables, separated by commas")
    p.add_argument("--dimensions", default="", help="width, height[, depth], separated by commas")
    p.add_argument("-n", "--timesteps", type=int, default=0)
    p.add_argument("--perturbation", type=float, default=0.0)
    p.add_argument("--clamp", default="", help="two numbers, separated by a comma")
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--smoothing-kernel-size", type=float, default=0.0)
    p.add_argument("--type-filter", default="", help="types of critical points, separated by |")
    p.add_argument("--post-process", default="", help="curve operators, separated by commas")
    p.add_argument("--duration-pruning", type=float, default=0.0)
    p.add_argument("--archived-intersections", default="")
    p.add_argument("--archived-traced", default="")
    p.add_argument("-o", "--output", default="")
    p.add_argument("--output-type", default="traced", choices=("discrete", "traced", "sliced", "intercepted"))
    p.add_argument("--output-format", default="auto")
    p.add_argument("--timing", action="store_true")
    p.add_argument("--master", default="")
    return p


def config(args: argparse.Namespace) -> dict:
    """The tracker's configuration that command line options stand for."""
    split = lambda x, kind: [kind(v) for v in x.split(",") if v]
    source = {"name": args.synthetic or "", "filenames": args.input or "", "format": args.input_format, "mesh_filename": args.mesh, "n_timesteps": args.timesteps, "perturbation": args.perturbation}
    source |= {"variables": split(args.var, str), "dimensions": split(args.dimensions, int), "clamp": split(args.clamp, float)}
    archive = {k: v for k, v in (("discrete", args.archived_intersections), ("traced", args.archived_traced)) if v}
    output = {"pattern": args.output, "type": args.output_type, "format": args.output_format} if args.output else {}
    return {
        "feature": args.feature, "input": {k: v for k, v in source.items() if v}, "output": output, "archive": archive, "threshold": args.threshold, "type_filter": args.type_filter,
        "post_processing_options": args.post_process, "duration_pruning_threshold": args.duration_pruning, "smoothing_kernel_size": args.smoothing_kernel_size,
    }


def main(argv: list[str] | None = None) -> dict[str, int]:
    args = parser().parse_args(argv)
    build = SparkSession.builder.appName("driftmesh")
    spark = (build.master(args.master) if args.master else build).getOrCreate()
    began = time.time()
    got = summary(track(spark, config(args)))
    if args.timing:
        got["seconds"] = round(time.time() - began, 3)
    print(json.dumps(got))
    return got


if __name__ == "__main__":
    main()
