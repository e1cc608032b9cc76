"""Distance expressions between points and axis-aligned boxes.

Every function takes one Column per axis, so the number of axes (2 or 3) is settled
when the plan is built. Products are written ``d * d``: unlike ``pow`` this rounds
the same way in every engine, and it keeps the bounds below exact. Rounding never
turns a smaller value into a larger one, so for any point inside a box
``box_min_dist <= distance <= box_max_dist`` holds on the computed doubles too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def axes_of(dims: int) -> tuple[str, ...]:
    if dims not in (2, 3):
        raise ValueError(f"dims must be 2 or 3, not {dims!r}")
    return AXES[:dims]


def point(prefix: str, dims: int) -> list[Column]:
    """Columns ``<prefix>x``, ``<prefix>y`` and, in 3D, ``<prefix>z``."""
    return [F.col(f"{prefix}{a}") for a in axes_of(dims)]


def _norm_sq(deltas: Sequence[Column]) -> Column:
    return reduce(add, [d * d for d in deltas])


def sq_distance(p: Sequence[Column], q: Sequence[Column]) -> Column:
    return _norm_sq([a - b for a, b in zip(p, q, strict=True)])


def distance(p: Sequence[Column], q: Sequence[Column]) -> Column:
    return F.sqrt(sq_distance(p, q))


def x_distance(p: Sequence[Column], q: Sequence[Column]) -> Column:
    return F.abs(p[0] - q[0])


def box_min_dist(p: Sequence[Column], lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    """Distance from a point to the nearest place of a box, 0 inside it."""
    return box_gap(p, p, lo, hi)


def box_max_dist(p: Sequence[Column], lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    """Distance from a point to the farthest corner of a box."""
    return F.sqrt(
        _norm_sq([F.greatest(F.abs(c - a), F.abs(c - b)) for c, a, b in zip(p, lo, hi, strict=True)])
    )


def box_gap(
    lo: Sequence[Column], hi: Sequence[Column], lo2: Sequence[Column], hi2: Sequence[Column]
) -> Column:
    """Smallest distance between any two points of two boxes."""
    return F.sqrt(
        _norm_sq(
            [
                F.greatest(c - b, a - d, F.lit(0.0))
                for a, b, c, d in zip(lo, hi, lo2, hi2, strict=True)
            ]
        )
    )


def box_span(
    lo: Sequence[Column], hi: Sequence[Column], lo2: Sequence[Column], hi2: Sequence[Column]
) -> Column:
    """Largest distance between any two points of two boxes."""
    return F.sqrt(
        _norm_sq(
            [F.greatest(d - a, b - c) for a, b, c, d in zip(lo, hi, lo2, hi2, strict=True)]
        )
    )


def longest_side(lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    return F.greatest(*[b - a for a, b in zip(lo, hi, strict=True)])


def estimate_radius(found: Column, k: int, radius: Column, dims: int) -> Column:
    """Radius expected to hold ``k`` points when ``radius`` holds ``found`` of them.

    Assumes even density; with nothing found, one point is assumed and a fifth is added.
    A hint for sizing a search only: no result depends on it.
    """
    root = F.sqrt if len(axes_of(dims)) == 2 else F.cbrt
    some = root(F.lit(float(k)) / found) * radius
    return F.when(found > 0, some).otherwise(F.lit(1.2) * root(F.lit(float(k))) * radius)
