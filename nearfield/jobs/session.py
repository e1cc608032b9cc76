"""Session of the command-line jobs; master and resources come from spark-submit."""

from __future__ import annotations

from pyspark.sql import SparkSession

from nearfield.session import configure


def job_session(name: str, partitions: int | None) -> SparkSession:
    spark = configure(SparkSession.builder.appName(name).getOrCreate())
    if partitions is not None:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return spark
