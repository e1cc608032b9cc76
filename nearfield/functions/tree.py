"""Quadtree and octree paths.

A node is named by the digits that lead to it from the root. Halving the unit box ``d``
times gives a dyadic cell whose index along an axis is ``floor(x * 2^d)``, so digits are
bits of that number and no recursion is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions.geometry import AXES, axes_of

# Cells of the unit box can be halved so often before coordinates run out of bits.
MAX_DEPTH = 50
_HALF = 25  # digits that fit a decimal number with room for carries

# Child digits. 0 = NW, 1 = NE, 2 = SW, 3 = SE on the floor (or in 2D);
# 4 to 7 are the same four on the ceiling. Each string holds, for digits 0 to 7 in order,
# the half of the axis that the child covers (0 lower, 1 upper).
DIGITS = "01234567"
UPPER_HALF = {"x": "01010101", "y": "11001100", "z": "00001111"}


def check_depth(depth: int) -> int:
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be between 0 and {MAX_DEPTH}, not {depth!r}")
    return int(depth)


def tree_path(coords: Sequence[Column], depth: int) -> Column:
    """Digits of the node at ``depth`` that holds the point."""
    depth = check_depth(depth)
    if depth == 0:
        return F.lit("")
    index = [F.floor(c * F.lit(float(2**depth))).cast("bigint") for c in coords]
    digits = []
    for shift in range(depth - 1, -1, -1):
        bit = [F.shiftright(i, shift).bitwiseAND(F.lit(1)) for i in index]
        digit = bit[0] + (F.lit(1) - bit[1]) * 2
        if len(bit) == 3:
            digit = digit + bit[2] * 4
        digits.append(digit.cast("string"))
    return F.concat(*digits)


def axis_index(path: Column, axis: str) -> Column:
    """Index of the node along one axis, among ``2^length(path)`` cells."""
    bits = F.translate(path, DIGITS, UPPER_HALF[axis])
    return F.coalesce(F.conv(bits, 2, 10).cast("bigint"), F.lit(0).cast("bigint"))


def path_width(path: Column) -> Column:
    return F.pow(F.lit(2.0), -F.length(path))


def path_bounds(path: Column, dims: int) -> tuple[list[Column], list[Column]]:
    """Lower and upper corner of a node, exact because both are dyadic."""
    width = path_width(path)
    index = [axis_index(path, a) for a in axes_of(dims)]
    return [i * width for i in index], [(i + 1) * width for i in index]


def bound_columns(path: Column, dims: int) -> list[Column]:
    """``xmin, xmax, ymin, ymax, zmin, zmax``; the z pair is null in 2D."""
    lo, hi = path_bounds(path, dims)
    out = []
    for i, axis in enumerate(AXES):
        low, high = (lo[i], hi[i]) if i < dims else (F.lit(None), F.lit(None))
        out += [low.cast("double").alias(f"{axis}min"), high.cast("double").alias(f"{axis}max")]
    return out


def tree_cell(index: Sequence[Column], depth: Column) -> Column:
    """Path of the node at ``depth`` with the given index per axis.

    Written as decimal numbers, the bit strings of the axes add up digit by digit without a
    carry, because a child digit is at most 7.
    """

    def digits(bits: Column) -> Column:
        return F.bin(bits).cast("decimal(30,0)")

    ones = F.lit("1" * _HALF).cast("decimal(30,0)")

    def half(part: Sequence[Column]) -> Column:
        code = digits(part[0]) + 2 * (ones - digits(part[1]))
        if len(part) == 3:
            code = code + 4 * digits(part[2])
        return F.lpad(code.cast("string"), _HALF, "0")

    # Digits above the depth are those of cells around the unit box; they are cut off.
    high = half([F.shiftright(i, _HALF) for i in index])
    low = half([i.bitwiseAND(F.lit((1 << _HALF) - 1)) for i in index])
    return F.when(depth > 0, F.right(F.concat(high, low), depth)).otherwise(F.lit(""))
