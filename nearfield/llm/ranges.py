"""Positions of rows within their key, in a total order, without gathering a key anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from nearfield.plans.staging import Stage


def _numbered(key: str):
    """Rows of a sorted range with its number and each row's place among the range's rows of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            changed = np.ones(len(keys), dtype=bool)
            if len(keys) > 1:
                changed[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            first = keys[0].as_py()
            begin = np.where(changed, np.arange(len(keys)), 0)
            place = np.arange(len(keys)) - np.maximum.accumulate(begin)
            if first == last:
                ends = np.flatnonzero(changed[1:])
                place[: ends[0] + 1 if len(ends) else len(keys)] += seen
            last, seen = keys[-1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), part)), pa.array(place)],
                names=[*batch.schema.names, "part", "place"],
            )

    return run


def positions(stage: Stage, name: str, rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``pos``, each row's number from 0 within its ``key``, and the key's size ``n``.

    Also the largest size. ``rows`` must be a table that is read again alike (staged or a file), ``key``
    not null; rows that agree in all of ``order`` are numbered in any order. Rows are sorted into ranges
    by key and order, so a key with most rows is spread over many ranges; only counts per key and
    range are added up.
    """
    schema = StructType(list(rows.schema.fields)).add("part", LongType()).add("place", LongType())
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ranged = stage.save(ranged.mapInArrow(_numbered(key), schema), f"{name}-ranges")
    whole = Window.partitionBy(key)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(key, "part").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.select(
        key,
        "part",
        F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"),
        F.sum("m").over(whole).alias("n"),
    )
    counts, facts = stage.save_with(counts, f"{name}-counts", F.max("n").alias("most"))
    placed = ranged.join(counts, [key, "part"]).withColumn("pos", F.col("base") + F.col("place"))
    return placed.select(*rows.columns, "pos", "n"), facts["most"] or 0
