"""Staged tables of operators with many steps, what Python workers keep, and session options for whole texts."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from nearfield.plans.staging import Stage


# What a task hands to Python at once. Whole texts are some kilobytes each, so that the default of 10,000
# rows, held by the executor and by Python, in and out, is most of a small executor's memory beyond its heap.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def bounded_batches(spark: SparkSession) -> None:
    """Set the options above; results do not depend on them."""
    for name, value in BATCHES.items():
        spark.conf.set(name, value)


_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]):
    """What this Python worker keeps under ``key`` from one task to the next, and nothing else beside it."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Drop what other operators' tasks have kept in this worker, and give memory that is free back to the system.

    Spark gives all queries of a session the same workers, each of which would else stay as large as it ever was.
    """
    if _kept:
        _kept.clear()
        gc.collect()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


class Steps(Stage):
    """A stage that lets go of what finished steps have left behind.

    Spark deletes the shuffle files and broadcasts of a finished job only once the driver has collected
    the objects that stand for them. A step's table is written by then, so nothing reads them again.
    """

    def save_with(self, df: DataFrame, name: str, *facts: Column) -> tuple[DataFrame, dict]:
        out = super().save_with(df, name, *facts)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return out
