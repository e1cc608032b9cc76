"""Session options the plans are laid out for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The join partitions queries, candidate leaves and training points by tile and joins them on
# tile plus cell. Spark re-shuffles for the longer key unless told that the tile is enough.
OPTIONS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Lists of more than 1,000 neighbours, too, are cut to k before they are shuffled.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the options above; results do not depend on them, the number of shuffles does."""
    for name, value in OPTIONS.items():
        spark.conf.set(name, value)
    return spark
