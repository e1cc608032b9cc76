"""Uniform grid of ``n`` cells per axis over the unit square or cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions.geometry import axes_of


def check_n(n: int) -> int:
    if int(n) != n or n < 1:
        raise ValueError(f"n must be a whole number of at least 1, not {n!r}")
    return int(n)


def grid_index(coord: Column, n: int) -> Column:
    """Cell number along one axis.

    The quotient by the cell width decides, not ``coord * n``: the two differ at borders
    such as 0.3 with n = 10.
    """
    return F.floor(coord / F.lit(1.0 / check_n(n))).cast("bigint")


def grid_cell(coords: Sequence[Column], n: int) -> Column:
    """Cell id ``i + j*n (+ k*n*n)``, a BIGINT."""
    n = check_n(n)
    cell = grid_index(coords[0], n)
    for power, coord in enumerate(coords[1:], start=1):
        cell = cell + grid_index(coord, n) * F.lit(n**power).cast("bigint")
    return cell


def grid_decode(cell: Column, n: int, dims: int) -> list[Column]:
    """Per-axis cell numbers ``[i, j(, k)]`` of a cell id."""
    n = check_n(n)
    size = F.lit(n).cast("bigint")
    indices = []
    for power in range(len(axes_of(dims))):
        rest = F.call_function("div", cell, F.lit(n**power).cast("bigint"))
        indices.append(F.pmod(rest, size) if power < dims - 1 else rest)
    return indices


def grid_bounds(
    cell: Column, n: int, dims: int
) -> tuple[list[Column], list[Column], list[Column]]:
    """Lower corner, upper corner and centre of a cell, one Column per axis."""
    width = F.lit(1.0 / check_n(n))
    indices = grid_decode(cell, n, dims)
    lo = [i * width for i in indices]
    hi = [(i + 1) * width for i in indices]
    centre = [i * width + width / 2 for i in indices]
    return lo, hi, centre
