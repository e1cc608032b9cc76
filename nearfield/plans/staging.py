"""Shared-folder tables that cut the lineage of multi-step joins, and skew-proof lookups."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A counted table of at most this many narrow rows (some 150 bytes each) is broadcast.
BROADCAST_ROWS = 200_000
# Keys that hold at least 1/HEAVY_KEYS of all rows: there can be no more than HEAVY_KEYS.
HEAVY_KEYS = 50_000

# Where a session without a checkpoint folder keeps staged tables; never a default.
FOLDER_SETTING = "spark.nearfield.staging.dir"


def staging_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else by ``FOLDER_SETTING``."""
    for setting in ("spark.checkpoint.dir", FOLDER_SETTING):
        configured = spark.conf.get(setting, None)
        if configured:
            return configured.rstrip("/")
    raise ValueError(f"set spark.checkpoint.dir or {FOLDER_SETTING} to a folder all executors share")


def drop_staged(spark: SparkSession) -> None:
    """Delete all staged tables below the session's folder; results not yet computed need them."""
    _delete(spark, f"{staging_folder(spark)}/nearfield")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Stage:
    """One run's folder of Parquet tables. A lost executor re-reads them, it re-runs nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{staging_folder(spark)}/nearfield/{uuid.uuid4().hex}"

    def drop(self) -> None:
        """Delete this run's tables."""
        _delete(self.spark, self.folder)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self.save_with(df, name, F.count(F.lit(1)).alias("rows"))[0]

    def save_with(self, df: DataFrame, name: str, *facts: Column) -> tuple[DataFrame, dict]:
        """Write a table and return it with aggregates over it, taken during the write."""
        path = f"{self.folder}/{name}"
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        df.observe(seen, *facts).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get


def merged_if_big(table: DataFrame, *rows: int) -> DataFrame:
    """``table``, for a merge join if one side of the join, of which there are ``rows``, is too large to broadcast.

    Spark would else judge a side by its files, which are compressed, and send it to the driver.
    """
    return table.hint("merge") if max(rows) > BROADCAST_ROWS else table


def level_mask(level: Column, base: int) -> Column:
    """Aggregate that notes which levels occur, one bit for each level from ``base`` up."""
    return F.bit_or(F.pow(F.lit(2.0), level - base).cast("bigint"))


def masked_levels(mask: int | None, base: int) -> list[int]:
    return [base + bit for bit in range((mask or 0).bit_length()) if (mask or 0) >> bit & 1]


def lookup(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, total: int, size: int
) -> DataFrame:
    """Join ``rows`` to their entry in ``table``, whose ``weight`` counts the rows per key.

    A small table is broadcast. Otherwise only its heavy entries are (``HEAVY_KEYS`` at most,
    since weights add up to ``total``) and their rows never move; what is left to shuffle has
    no key above 1/HEAVY_KEYS of the rows.
    """
    keys = list(keys)
    if size <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys)
    limit = max(1.0, total / HEAVY_KEYS)
    heavy = table.filter(F.col(weight) >= limit)
    light = table.filter(F.col(weight) < limit)
    moved = rows.join(F.broadcast(heavy.select(keys)), keys, "left_anti")
    moved = moved.join(light.hint("merge"), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(moved)
