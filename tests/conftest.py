from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("nearfield-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def cells_for_queries(monkeypatch):
    """Let small query tables, too, go through cells of their own; tests of the short way undo it."""
    from nearfield.plans import aknn

    monkeypatch.setattr(aknn, "SMALL_QUERIES", 0)


@pytest.fixture
def tiny_limits(monkeypatch):
    """Limits so low that the shuffle, salting and splitting branches run on small tables."""
    from nearfield.operators import cells
    from nearfield.plans import aknn, descent, meet, overlaps, pyramid, staging

    monkeypatch.setattr(staging, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(pyramid, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(cells, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(overlaps, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(staging, "HEAVY_KEYS", 20)
    monkeypatch.setattr(pyramid, "HEAVY_KEYS", 20)
    monkeypatch.setattr(meet, "HEAVY_KEYS", 20)
    monkeypatch.setattr(meet, "TILE_ROWS", 10)
    monkeypatch.setattr(meet, "LEAF_TILES", 2)
    monkeypatch.setattr(aknn, "QUERY_CAPACITY", 4)
    monkeypatch.setattr(descent, "WIDE_FRONTIER", {2: 5, 3: 5})
