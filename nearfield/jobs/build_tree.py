"""Build the partition tree from a sample of the training points.

    spark-submit build_tree.py --training points.tsv --tree out --samplerate 1 --capacity 200
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from nearfield.jobs.session import job_session
from nearfield.operators.leaves import build_leaves, tree_stats, write_leaves
from nearfield.sources.points import read_points, sample_points

# Numbers of the splitting policies.
TYPES = {1: "capacity", 2: "all_children", 3: "avg_width"}


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--training", required=True, help="training points, id x y [z] per line")
    args.add_argument("--tree", required=True, help="folder for the leaf table")
    args.add_argument("--samplerate", type=float, default=1.0, help="percent of points to use")
    args.add_argument("--capacity", type=int, default=200, help="sample points per leaf")
    args.add_argument("--type", type=int, choices=sorted(TYPES), default=1, help=str(TYPES))
    args.add_argument("--avg-width", type=float, help="width for type 3 instead of the mean")
    args.add_argument("--dims", type=int, choices=(2, 3), default=2)
    args.add_argument("--max-depth", type=int, help="as deep as needed if left out")
    args.add_argument("--sep", default="\t")
    args.add_argument("--seed", type=int)
    args.add_argument("--partitions", type=int)
    return args


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = job_session("nearfield tree", args.partitions)
    points = read_points(spark, args.training, args.dims, args.sep)
    leaves = build_leaves(
        sample_points(points, args.samplerate, args.seed),
        capacity=args.capacity,
        dims=args.dims,
        policy=TYPES[args.type],
        max_depth=args.max_depth,
        avg_width=args.avg_width,
    )
    write_leaves(leaves, args.tree, mode="overwrite")
    print(tree_stats(spark.read.parquet(args.tree)).first().asDict())


if __name__ == "__main__":
    main()
