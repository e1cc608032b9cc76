"""Find the k nearest training points of every query point.

    spark-submit aknn.py --query q.tsv --training t.tsv --output out --k 10 --n 500
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import Observation
from pyspark.sql import functions as F

from nearfield.jobs.session import job_session
from nearfield.operators.leaves import read_leaves
from nearfield.plans.aknn import METHODS, PARTITIONINGS, aknn_join
from nearfield.plans.staging import Stage
from nearfield.sources.points import read_points
from nearfield.sources.writers import run_report, write_neighbors


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--partitioning", choices=PARTITIONINGS, default="gd")
    args.add_argument("--method", choices=METHODS, default="ps")
    args.add_argument("--k", type=int, default=10)
    args.add_argument("--n", type=int, help="grid cells per axis; by density if left out")
    args.add_argument("--query", required=True, help="query points, id x y [z] per line")
    args.add_argument("--training", required=True, help="training points, the same form")
    args.add_argument("--tree", help="leaf table of build_tree, for partitioning qt")
    args.add_argument("--output", required=True)
    args.add_argument("--form", choices=("long", "wide"), default="long")
    args.add_argument("--report", help="folder to append the run report to")
    args.add_argument("--dims", type=int, choices=(2, 3), default=2)
    args.add_argument("--sep", default="\t")
    args.add_argument("--exclude-self", action="store_true")
    args.add_argument("--unique-ids", action="store_true", help="training ids are known unique")
    args.add_argument("--partitions", type=int)
    return args


def main(argv: Sequence[str] | None = None) -> None:
    options = parser()
    args = options.parse_args(argv)
    if args.partitioning == "qt" and not args.tree:
        options.error("partitioning qt needs --tree")
    spark = job_session("nearfield join", args.partitions)
    started = time.monotonic()
    # Both sides are scanned several times: parse the text once, into columns.
    stage, n_rows = Stage(spark), F.count(F.lit(1)).alias("n")
    query, q_facts = stage.save_with(
        read_points(spark, args.query, args.dims, args.sep), "query-points", n_rows
    )
    training, t_facts = stage.save_with(
        read_points(spark, args.training, args.dims, args.sep), "training-points", n_rows
    )
    loaded = time.monotonic()
    seen = Observation("join")
    neighbors = aknn_join(
        query,
        training,
        args.k,
        dims=args.dims,
        partitioning=args.partitioning,
        method=args.method,
        n=args.n,
        leaves=read_leaves(spark, args.tree) if args.tree else None,
        exclude_self=args.exclude_self,
        unique_ids=True if args.unique_ids else None,
    )
    prepared = time.monotonic()
    joined = neighbors.observe(seen, n_rows)
    write_neighbors(joined, args.output, args.form, mode="overwrite")
    finished = time.monotonic()
    phases = {
        "read": (q_facts["n"] + t_facts["n"], loaded - started),
        # The cell tables are no part of the result and count no rows.
        "prepare": (0, prepared - loaded),
        "join": (seen.get["n"], finished - prepared),
    }
    report = run_report(spark, vars(args), phases)
    report.show(truncate=False)
    if args.report:
        report.write.mode("append").parquet(args.report)


if __name__ == "__main__":
    main()
