from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from nearfield.functions.geometry import (
    box_gap,
    box_max_dist,
    box_min_dist,
    box_span,
    distance,
    estimate_radius,
    sq_distance,
    x_distance,
)
from nearfield.functions.grid import grid_bounds, grid_cell, grid_decode, grid_index
from nearfield.functions.tree import MAX_DEPTH, axis_index, path_bounds, tree_cell, tree_path


def lits(*values):
    return [F.lit(float(v)) for v in values]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_distances(spark):
    assert value(spark, distance(lits(0, 0), lits(3, 4))) == 5.0
    assert value(spark, distance(lits(1, 2, 2), lits(0, 0, 0))) == 3.0
    assert value(spark, sq_distance(lits(0, 0), lits(3, 4))) == 25.0
    assert value(spark, x_distance(lits(0.25, 0), lits(0.75, 9))) == 0.5


def test_box_distances(spark):
    lo, hi = lits(0.75, 0.5), lits(1, 0.75)
    assert value(spark, box_min_dist(lits(0.5, 0.5), lo, hi)) == 0.25
    assert round(value(spark, box_max_dist(lits(0.5, 0.5), lo, hi)), 10) == 0.5590169944
    assert value(spark, box_min_dist(lits(0.8, 0.6), lo, hi)) == 0.0
    assert value(spark, box_gap(lits(0, 0), lits(1, 1), lits(4, 5), lits(6, 7))) == 5.0
    assert value(spark, box_span(lits(0, 0), lits(1, 1), lits(2, 2), lits(3, 4))) == 5.0


def test_estimated_radius(spark):
    assert value(spark, estimate_radius(F.lit(1), 4, F.lit(0.5), 2)) == 1.0
    assert value(spark, estimate_radius(F.lit(1), 8, F.lit(0.5), 3)) == pytest.approx(1.0)
    assert value(spark, estimate_radius(F.lit(0), 4, F.lit(0.5), 2)) == pytest.approx(1.2)


def test_grid_cells(spark):
    assert value(spark, grid_cell(lits(0.25, 0.75), 4)) == 13
    assert value(spark, grid_cell(lits(0.25, 0.75, 0.5), 4)) == 45
    assert [value(spark, grid_index(F.lit(x), 10)) for x in (0.3, 0.6, 0.7)] == [2, 5, 6]
    assert [value(spark, c) for c in grid_decode(F.lit(45), 4, 3)] == [1, 3, 2]
    assert [value(spark, c) for c in grid_decode(F.lit(13), 4, 2)] == [1, 3]
    # Ids beyond 32 bits.
    assert value(spark, grid_cell(lits(0.9999, 0.9999, 0.9999), 2000)) == 1999 * (1 + 2000 + 2000**2)


def test_grid_bounds(spark):
    lo, hi, mid = grid_bounds(F.lit(13), 4, 2)
    assert [value(spark, c) for c in lo + hi + mid] == [0.25, 0.75, 0.5, 1.0, 0.375, 0.875]


@pytest.mark.parametrize(
    ("coords", "path"),
    [
        ((0.25, 0.75), "012"),
        ((0.5, 0.5), "122"),
        ((0.5, 0.49), "300"),
        ((0, 0), "222"),
        ((0.25, 0.75, 0.5), "412"),
        ((0.75, 0.25, 0.75), "752"),
    ],
)
def test_tree_paths(spark, coords, path):
    assert value(spark, tree_path(lits(*coords), 3)) == path
    assert value(spark, tree_path(lits(*coords), 0)) == ""
    index = [axis_index(F.lit(path), a) for a in "xyz"[: len(coords)]]
    assert value(spark, tree_cell(index, F.lit(3))) == path


def test_path_bounds(spark):
    lo, hi = path_bounds(F.lit("21"), 2)
    assert [value(spark, c) for c in lo + hi] == [0.25, 0.25, 0.5, 0.5]
    lo, hi = path_bounds(F.lit(""), 3)
    assert [value(spark, c) for c in lo + hi] == [0, 0, 0, 1, 1, 1]
    deep = "1" * 24
    lo, hi = path_bounds(F.lit(deep), 2)
    assert value(spark, hi[0]) == 1.0 and value(spark, lo[0]) == 1.0 - 2.0**-24


def test_bad_arguments():
    with pytest.raises(ValueError, match="dims"):
        grid_decode(F.lit(1), 4, 4)
    with pytest.raises(ValueError, match="n must"):
        grid_index(F.lit(0.5), 0)
    with pytest.raises(ValueError, match="depth"):
        tree_path(lits(0, 0), MAX_DEPTH + 1)
