"""Neighbour lists as text or Parquet, and the run report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: one neighbour in the wide text form, tab after each field.
PAIR_FORMAT = "%d\t%11.10f\t"


def format_wide(neighbors: DataFrame) -> DataFrame:
    """One line per query, ``(qid, line)``: the query id, then id and distance per neighbour.

    A list has at most k entries, so gathering it in one row is bounded.
    """
    lists = neighbors.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "tid", "dist"))).alias("list")
    )
    pairs = F.transform("list", lambda p: F.format_string(PAIR_FORMAT, p["tid"], p["dist"]))
    line = F.concat(F.col("qid").cast("string"), F.lit("\t"), F.array_join(pairs, ""))
    return lists.select("qid", line.alias("line"))


def write_neighbors(
    neighbors: DataFrame, path: str, form: str = "long", mode: str = "errorifexists"
) -> None:
    """Write the whole result: ``long`` as Parquet rows, ``wide`` as text lines."""
    if form == "long":
        neighbors.write.mode(mode).parquet(path)
    elif form == "wide":
        format_wide(neighbors).select("line").write.mode(mode).text(path)
    else:
        raise ValueError(f"form must be 'long' or 'wide', not {form!r}")


def run_report(
    spark: SparkSession, parameters: Mapping[str, object], phases: Mapping[str, tuple[int, float]]
) -> DataFrame:
    """One row per phase: its row count and seconds, with the run's parameters."""
    options = {name: str(value) for name, value in parameters.items()}
    rows = [
        (order, phase, int(count), float(seconds), options)
        for order, (phase, (count, seconds)) in enumerate(phases.items(), start=1)
    ]
    schema = (
        "step int, phase string, n_rows bigint, seconds double, parameters map<string, string>"
    )
    return spark.createDataFrame(rows, schema)
