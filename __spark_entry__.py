"""Registered queries and the SQL that gives the same rows.

``queries()`` holds one entry per operator, ``oracle_sql()`` plain SQL over the same tables.
Points are derived from table keys (``POINTS``), alike in both.
"""

from __future__ import annotations

import importlib
import importlib.util
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import nearfield as nf
from nearfield.functions.geometry import (
    axes_of,
    box_max_dist,
    box_min_dist,
    distance,
    estimate_radius,
    point,
    sq_distance,
    x_distance,
)
from nearfield.functions.grid import grid_bounds, grid_decode
from nearfield.functions.tree import path_bounds
from nearfield.plans.staging import FOLDER_SETTING, staging_folder

K = 10
OWN_RADIUS = "cast(0.002 as double) + cast(0.04 as double)*x*x"
SMALL_SF = os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001")


def _h(key: str, factor: int) -> str:
    return f"(cast(({key}*{factor}) % 1000003 as double)/cast(1000003 as double))"


def _hashed(table: str, key: str, factors: tuple[int, int, int]) -> tuple[str, str, list[str]]:
    return table, key, [_h(key, f) for f in factors]


_T = _hashed("part", "p_partkey", (15485863, 32452843, 49979687))
_ORDER_FACTORS = (7919, 104729, 1299709)
# Name -> (table, id, x, y, z), the same text in Spark SQL and in the oracle's dialect.
POINTS = {
    "q": _hashed("customer", "c_custkey", _ORDER_FACTORS),
    "t": _T,
    "t_skewed": ("part", "p_partkey", [f"({c}*{c})" for c in _T[2]]),
    "o": _hashed("orders", "o_orderkey", _ORDER_FACTORS),
    "piled": (
        "orders",
        "o_orderkey",
        [
            f"(cast(o_orderkey % {m} as double)/cast({m} as double))"
            for m in (25, 22, 3)
        ],
    ),
    "few": _hashed("nation", "n_nationkey", _ORDER_FACTORS),
    "repeated": (
        "lineitem",
        "l_partkey",
        [_h("(l_orderkey*7+l_linenumber)", f) for f in _ORDER_FACTORS],
    ),
    # One point far away from all others.
    "outlier": (
        "part",
        "p_partkey",
        [f"(case when p_partkey = 1 then cast(1e13 as double) else {c} end)" for c in _T[2]],
    ),
    # All points in a box of 2^-20.
    "tight": (
        "part",
        "p_partkey",
        [f"(cast(0.3 as double) + {c}/cast({2**20} as double))" for c in _T[2]],
    ),
    "money": (
        "customer",
        "c_custkey",
        [
            "(c_acctbal/cast(10000 as double))",
            "(cast(c_nationkey as double)/cast(20 as double))",
            "(c_acctbal/cast(20000 as double))",
        ],
    ),
}


def _select(name: str, dims: int) -> tuple[str, str]:
    table, key, coords = POINTS[name]
    columns = [f"{key} as id"] + [f"{c} as {a}" for c, a in zip(coords, axes_of(dims), strict=False)]
    return table, ", ".join(columns)


VECTOR_LENGTH = 64


def _projection(axis: int, component: Callable[[int], str]) -> str:
    """A coordinate from all components, added up in one order by either engine."""
    terms = [
        f"cast({component(i)} as double)*cast({((i * 37 + axis * 61) % 101 - 50) / 400!r} as double)"
        for i in range(VECTOR_LENGTH)
    ]
    total = terms[0]
    for term in terms[1:]:
        total = f"({total} + {term})"
    return f"({total} + cast(0.5 as double))"


def _points(spark: SparkSession, sf: str, name: str, dims: int = 2) -> DataFrame:
    nf.configure(spark)
    if name == "vectors":
        vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
        coords = [
            f"{_projection(i, 'embedding[{}]'.format)} as {a}" for i, a in enumerate(axes_of(dims))
        ]
        return vectors.selectExpr("vec_id as id", *coords)
    table, columns = _select(name, dims)
    return spark.read.parquet(f"{sf}/{table}.parquet").selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    return [c.strip() for c in columns.split(", ")]


def _sql_points(name: str, dims: int = 2) -> str:
    if name == "vectors":
        coords = ", ".join(
            f"{_projection(i, lambda n: f'embedding[{n + 1}]')} as {a}"
            for i, a in enumerate(axes_of(dims))
        )
        return f"(select vec_id as id, {coords} from embeddings)"
    table, columns = _select(name, dims)
    return f"(select {columns} from {table})"


def _sql_sq(a: str, b: str, dims: int) -> str:
    return " + ".join(f"({a}.{c}-{b}.{c})*({a}.{c}-{b}.{c})" for c in axes_of(dims))


def _sql_aknn(
    q: str, t: str, dims: int = 2, k: int = K, exclude_self: bool = False, more: str | None = None
) -> str:
    skip = "where q.id <> t.id" if exclude_self else ""
    training = _sql_points(t, dims)
    if more:
        training = f"(select * from {training} union all select * from {_sql_points(more, dims)})"
    return f"""
    with q as {_sql_points(q, dims)}, t as {training},
    d as (select q.id qid, t.id tid, min(sqrt({_sql_sq("q", "t", dims)})) dist
          from q cross join t {skip} group by q.id, t.id),
    r as (select *, row_number() over (partition by qid order by dist, tid) rn from d)
    select qid, cast(rn as int) as rank, tid, dist from r where rn <= {k}"""


def _sql_own_radius(dims: int) -> str:
    return f"""with q as (select *, {OWN_RADIUS} as far from {_sql_points("q", dims)}),
        t as {_sql_points("t", dims)},
        d as (select q.id as qid, t.id as tid, sqrt({_sql_sq("q", "t", dims)}) as dist, far from q cross join t)
        select qid, tid, dist from d where dist <= far"""


# --- grid -----------------------------------------------------------------------------


def _sql_index(coord: str, n: int) -> str:
    return f"cast(floor({coord}/(cast(1 as double)/cast({n} as double))) as bigint)"


def _sql_cell(n: int, dims: int = 2, prefix: str = "") -> str:
    parts = [
        f"{_sql_index(prefix + a, n)}*{n**power}" for power, a in enumerate(axes_of(dims))
    ]
    return "(" + " + ".join(parts) + ")"


def _sql_gap(q: str, c: str, dims: int = 2) -> str:
    parts = [f"greatest({c}.{a}min-{q}.{a}, {q}.{a}-{c}.{a}max, 0)" for a in axes_of(dims)]
    return "sqrt(" + " + ".join(f"{p}*{p}" for p in parts) + ")"


def _sql_far(q: str, c: str, dims: int = 2) -> str:
    parts = [
        f"greatest(abs({q}.{a}-{c}.{a}min), abs({q}.{a}-{c}.{a}max))" for a in axes_of(dims)
    ]
    return "sqrt(" + " + ".join(f"{p}*{p}" for p in parts) + ")"


def _sql_boxes(n: int, dims: int = 2) -> str:
    """Occupied cells of ``t`` with count and box, from a CTE ``tc(id, ..., cell)``."""
    index = ["cell % {0}", "(cell // {0}) % {0}", "cell // ({0}*{0})"]
    if dims == 2:
        index = ["cell % {0}", "cell // {0}"]
    width = f"(cast(1 as double)/cast({n} as double))"
    box = ", ".join(
        f"({i.format(n)})*{width} as {a}min, (({i.format(n)})+1)*{width} as {a}max"
        for i, a in zip(index, axes_of(dims), strict=True)
    )
    return f"(select cell, count(*) as n, {box} from tc group by cell)"


def _sql_cells(q: str, t: str, n: int, dims: int = 2) -> str:
    return f"""q as {_sql_points(q, dims)}, t as {_sql_points(t, dims)},
    qc as (select *, {_sql_cell(n, dims)} as cell from q),
    tc as (select *, {_sql_cell(n, dims)} as cell from t)"""


def _sql_local(dims: int = 2, k: int = K) -> str:
    """CTEs ``local(qid, tid, dist, rank)`` from ``qc`` and ``tc``."""
    return f"""
    near as (select qc.id qid, tc.id tid, sqrt({_sql_sq("qc", "tc", dims)}) dist
             from qc join tc on qc.cell = tc.cell),
    ranked as (select *, cast(row_number() over (partition by qid order by dist, tid) as int)
               as rank from near),
    local as (select * from ranked where rank <= {k})"""


def _sql_overlaps(width: float, dims: int = 2, k: int = K) -> str:
    """CTE ``overlap`` from ``qc``, ``boxes`` and ``local``."""
    return f"""
    radius as (select qid, dist as r from local where rank = {k}),
    pairs as (select qc.id qid, qc.cell own, b.cell, b.n, {_sql_gap("qc", "b", dims)} gap,
                     {_sql_far("qc", "b", dims)} far from qc cross join boxes b),
    run as (select *, sum(n) over (partition by qid order by far, cell
                                   rows between unbounded preceding and current row) held
            from pairs),
    bound as (select qid, coalesce(min(case when held >= {k} then far end),
                                   cast('inf' as double)) ub from run group by qid),
    reach as (select bound.qid, least(ub, coalesce(r, ub))*(1.0 + 1e-12)::double
                     + cast({1e-9 * width!r} as double) reach
              from bound left join radius on bound.qid = radius.qid),
    others as (select pairs.qid, pairs.cell, false as complete from pairs
               join reach on pairs.qid = reach.qid where gap <= reach and cell <> own),
    overlap as (select * from others union all
                 select qc.id, qc.cell, true from qc join radius on qc.id = radius.qid
                 where qc.id not in (select qid from others))"""


# --- tree -----------------------------------------------------------------------------

DEPTH = 16
CAPACITY = 50


def _sql_path(dims: int, depth: int = DEPTH) -> str:
    digits = []
    for shift in range(depth - 1, -1, -1):
        bit = [
            f"((cast(floor({a}*{2**depth}) as bigint) >> {shift}) & 1)" for a in axes_of(dims)
        ]
        digit = f"{bit[0]} + 2*(1-{bit[1]})" + (f" + 4*{bit[2]}" if dims == 3 else "")
        digits.append(f"cast({digit} as varchar)")
    return " || ".join(digits)


def _sql_half(upper: str, axis: str, depth: int) -> str:
    steps = [
        f"case when substr(path, {i}, 1) in ({upper}) then {2.0**-i!r}::double else 0.0::double end"
        for i in range(1, depth + 1)
    ]
    low = "(" + " + ".join(steps) + ")"
    return f"{low} as {axis}min, {low} + pow(2.0::double, -length(path)) as {axis}max"


def _sql_bounds(dims: int, depth: int = DEPTH) -> str:
    halves = {"x": "'1','3','5','7'", "y": "'0','1','4','5'", "z": "'4','5','6','7'"}
    parts = [_sql_half(halves[a], a, depth) for a in axes_of(dims)]
    if dims == 2:
        parts.append("cast(null as double) as zmin, cast(null as double) as zmax")
    return ", ".join(parts)


def _sql_leaves(t: str, dims: int = 2, policy: str = "capacity", depth: int = DEPTH) -> str:
    """CTEs up to ``leaves``, without bounds."""
    digits = ", ".join(f"('{d}')" for d in range(2**dims))
    first = "select path from pre where n_sample > %d and length(path) < %d" % (CAPACITY, depth)
    extra = ""
    inner = "select path from crowded"
    if policy == "all_children":
        inner = """select path from crowded union
            select left(path, length(path)-1) || d from crowded, digits where length(path) > 0"""
    if policy == "avg_width":
        extra = """
        leaves1 as (select path from (select '' as path union select path || d from crowded, digits)
                    where path not in (select path from crowded)),
        width as (select avg(w) as w from (select distinct pow(2.0::double, -length(path)) as w
                                           from leaves1)),
        wide as (with recursive g(path) as (select '' union all
                   select path || d from g, digits, width where pow(2.0::double, -length(path)-1) > w)
                 select path from g, width where pow(2.0::double, -length(path)) > w),"""
        inner = "select path from crowded union select path from wide"
    return f"""tp as (select *, {_sql_path(dims, depth)} as full_path from {_sql_points(t, dims)}),
    digits(d) as (values {digits}),
    pre as (select substr(full_path, 1, cast(s.depth as int)) as path, count(*) as n_sample
            from tp, range(0, {depth + 1}) s(depth) group by 1),
    crowded as ({first}),{extra}
    inner_nodes as ({inner}),
    leaves as (select n.path, length(n.path) as depth, coalesce(pre.n_sample, 0) as n_sample
               from (select '' as path union select path || d from inner_nodes, digits) n
               left join pre on n.path = pre.path
               where n.path not in (select path from inner_nodes))"""


def _sql_assign(name: str, alias: str, dims: int) -> str:
    return f"""{alias}0 as (select *, {_sql_path(dims)} as full_path from {_sql_points(name, dims)}),
    {alias} as (select {alias}0.*, leaves.path as cell from {alias}0, range(0, {DEPTH + 1}) s(depth)
                join leaves on leaves.path = substr(full_path, 1, cast(s.depth as int)))"""


def _leaves(spark: SparkSession, sf: str, dims: int = 2, policy: str = "capacity") -> DataFrame:
    t = _points(spark, sf, "t_skewed", dims)
    return nf.build_leaves(t, capacity=CAPACITY, dims=dims, policy=policy, max_depth=DEPTH)


def _sampled_leaves(spark: SparkSession, sf: str, t: str, dims: int) -> DataFrame:
    sample = nf.sample_points(_points(spark, sf, t, dims), 20, seed=7)
    return nf.build_leaves(sample, capacity=20, dims=dims)


# --- queries --------------------------------------------------------------------------

N = 10
RADIUS = {2: 0.02, 3: 0.06}


def _aknn(
    q: str,
    t: str,
    dims: int = 2,
    partitioning: str = "gd",
    method: str = "bf",
    n: int | None = None,
    k: int = K,
    exclude_self: bool = False,
) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        leaves = _sampled_leaves(spark, sf, t, dims) if partitioning == "qt" else None
        training = _points(spark, sf, t, dims)
        return nf.aknn_join(
            training if q == t else _points(spark, sf, q, dims),
            training,
            k,
            dims=dims,
            partitioning=partitioning,
            method=method,
            n=n,
            leaves=leaves,
            exclude_self=exclude_self,
        )

    return run


def _order_and_customer(spark: SparkSession, sf: str, dims: int) -> DataFrame:
    """Each order's point next to its customer's point."""
    owner = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("oid"), F.col("o_custkey").alias("cid")
    )
    o = _points(spark, sf, "o", dims)
    c = _points(spark, sf, "q", dims)
    o = o.withColumnsRenamed({"id": "oid", **{a: f"o{a}" for a in axes_of(dims)}})
    c = c.withColumnsRenamed({"id": "cid", **{a: f"c{a}" for a in axes_of(dims)}})
    return owner.join(o, "oid").join(c, "cid")


def _sql_order_and_customer(dims: int) -> str:
    return f"""o as {_sql_points("o", dims)}, c as {_sql_points("q", dims)},
    w as (select o_orderkey, o_custkey from orders),
    oc as (select w.o_orderkey as oid, w.o_custkey as cid, o.*, c.* from w
           join o on o.id = w.o_orderkey join c on c.id = w.o_custkey)"""


def _pair_measure(measure, name: str, dims: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        pairs = _order_and_customer(spark, sf, dims)
        return pairs.select("oid", "cid", measure(point("o", dims), point("c", dims)).alias(name))

    return run


def _sql_pair_measure(expression: str, name: str, dims: int) -> str:
    return f"""with o as {_sql_points("o", dims)}, c as {_sql_points("q", dims)}
    select o.id as oid, c.id as cid, {expression} as {name}
    from orders join o on o.id = o_orderkey join c on c.id = o_custkey"""


def _box_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Order point against the grid cell of its customer."""
    pairs = _order_and_customer(spark, sf, 2)
    c = pairs.select("oid", "ox", "oy", F.col("cx").alias("x"), F.col("cy").alias("y"))
    c = nf.assign_grid(c, N)
    lo, hi, _ = grid_bounds(F.col("cell"), N, 2)
    p = point("o", 2)
    return c.select(
        "oid",
        "cell",
        box_min_dist(p, lo, hi).alias("min_dist"),
        box_max_dist(p, lo, hi).alias("max_dist"),
    )


def _grid_assign(dims: int, n: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return nf.assign_grid(_points(spark, sf, "q", dims), n, dims).select("id", "cell")

    return run


def _grid_decode(spark: SparkSession, sf: str) -> DataFrame:
    cells = nf.assign_grid(_points(spark, sf, "q", 3), 20, 3)
    i, j, k = grid_decode(F.col("cell"), 20, 3)
    return cells.select("id", "cell", i.alias("i"), j.alias("j"), k.alias("k"))


def _grid_bounds(spark: SparkSession, sf: str) -> DataFrame:
    cells = nf.cell_histogram(nf.assign_grid(_points(spark, sf, "t"), 50))
    lo, hi, mid = grid_bounds(F.col("cell"), 50, 2)
    names = ["xmin", "ymin", "xmax", "ymax", "xmid", "ymid"]
    return cells.select(
        "cell", *[c.alias(n) for c, n in zip(lo + hi + mid, names, strict=True)]
    )


def _cell_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return nf.cell_histogram(nf.assign_grid(_points(spark, sf, "t"), 50))


def _tree_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return nf.cell_histogram(nf.assign_tree(_points(spark, sf, "t"), _leaves(spark, sf)))


def _cells_with_queries(spark: SparkSession, sf: str) -> DataFrame:
    q = nf.assign_grid(_points(spark, sf, "q"), 50)
    t = nf.assign_grid(_points(spark, sf, "t"), 50)
    return nf.cells_with_queries(t, q).select("id", "cell")


def _occupied(spark: SparkSession, sf: str, n: int = N, dims: int = 2) -> DataFrame:
    t = nf.assign_grid(_points(spark, sf, "t", dims), n, dims)
    return nf.occupied_cells(nf.cell_histogram(t), n=n, dims=dims)


def _range_cells(dims: int, n: int, r: float):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        q = _points(spark, sf, "q", dims).withColumn("r", F.lit(r))
        return nf.range_cells(q, _occupied(spark, sf, n, dims), n=n, dims=dims)

    return run


def _range_cells_tree(spark: SparkSession, sf: str) -> DataFrame:
    leaves = _leaves(spark, sf)
    t = nf.cell_histogram(nf.assign_tree(_points(spark, sf, "t_skewed"), leaves))
    q = _points(spark, sf, "q").withColumn("r", F.lit(0.05))
    return nf.range_cells(q, nf.occupied_cells(t, leaves=leaves))


def _range_cells_local(spark: SparkSession, sf: str) -> DataFrame:
    q = _points(spark, sf, "q")
    local = nf.local_knn(q, _points(spark, sf, "t"), K, n=N)
    r = nf.local_radius(local, K).withColumnRenamed("qid", "id")
    cells = nf.range_cells(q.join(r, "id"), _occupied(spark, sf), n=N)
    own = nf.assign_grid(q, N).select(F.col("id").alias("qid"), F.col("cell").alias("own"))
    return cells.join(own, "qid").filter("cell <> own").select("qid", "cell")


def _radius_join(dims: int, method: str = "bf"):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        q, t = _points(spark, sf, "q", dims), _points(spark, sf, "t", dims)
        return nf.radius_join(q, t, RADIUS[dims], dims=dims, method=method)

    return run


def _local(method: str, dims: int = 2, tree: bool = False, n: int = N):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = "t_skewed" if tree else "t"
        where = {"leaves": _leaves(spark, sf, dims)} if tree else {"n": n}
        return nf.local_knn(
            _points(spark, sf, "q", dims),
            _points(spark, sf, t, dims),
            K,
            dims=dims,
            method=method,
            **where,
        )

    return run


def _estimate(spark: SparkSession, sf: str) -> DataFrame:
    lists = _local("bf", n=30)(spark, sf).groupBy("qid").agg(
        F.count(F.lit(1)).alias("found"), F.max("dist").alias("r")
    )
    return lists.select(
        "qid", "found", estimate_radius(F.col("found"), K, F.col("r"), 2).alias("guess")
    )


def _overlaps(spark: SparkSession, sf: str, n: int = N) -> DataFrame:
    return nf.overlaps_grid(_points(spark, sf, "q"), _points(spark, sf, "t"), K, n)


def _completeness(spark: SparkSession, sf: str) -> DataFrame:
    return nf.completeness(_points(spark, sf, "q"), _overlaps(spark, sf))


def _overlaps_tree(spark: SparkSession, sf: str) -> DataFrame:
    q, t = _points(spark, sf, "q"), _points(spark, sf, "t_skewed")
    return nf.overlaps_tree(q, t, K, _leaves(spark, sf))


def _merge(spark: SparkSession, sf: str) -> DataFrame:
    return nf.merge_topk(_local("bf")(spark, sf), _local("bf", n=7)(spark, sf), K)


def _validate(spark: SparkSession, sf: str) -> DataFrame:
    return nf.validate_points(_points(spark, sf, "money")).bad.select("id", "reason")


def _duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return nf.validate_points(_points(spark, sf, "repeated")).duplicate_ids


def _tree_assign(dims: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        q = _points(spark, sf, "q", dims)
        return nf.assign_tree(q, _leaves(spark, sf, dims), dims).select("id", "cell")

    return run


def _path_bounds(spark: SparkSession, sf: str) -> DataFrame:
    nodes = nf.internal_nodes(_leaves(spark, sf, 3))
    lo, hi = path_bounds(F.col("path"), 3)
    names = ["xmin", "ymin", "zmin", "xmax", "ymax", "zmax"]
    return nodes.select("path", *[c.alias(n) for c, n in zip(lo + hi, names, strict=True)])


def _format_wide(spark: SparkSession, sf: str) -> DataFrame:
    return nf.format_wide(_aknn("q", "t")(spark, sf))


def _run_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report's phases with the rows each has made."""
    q, t = _points(spark, sf, "q"), _points(spark, sf, "t")
    cells = nf.cell_histogram(nf.assign_grid(t, N))
    phases = {"points": t, "cells": cells, "own cell": nf.local_knn(q, t, K, n=N)}
    counted = {name: (rows.count(), 0.0) for name, rows in phases.items()}
    return nf.run_report(spark, {"k": K, "n": N}, counted).select("step", "phase", "n_rows")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{staging_folder(spark)}/nearfield/queries/{uuid.uuid4().hex}/{name}"


def _as_text(points: DataFrame, dims: int) -> DataFrame:
    columns = [F.col(c).cast("string") for c in ("id", *axes_of(dims))]
    return points.select(F.concat_ws("\t", *columns).alias("value"))


def _read_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points written as text lines and read again."""
    path = _scratch(spark, "points")
    _as_text(_points(spark, sf, "t", 3), 3).write.text(path)
    return nf.read_points(spark, path, 3, partitions=3)


def _malformed(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth line loses its last field or holds a word; these and no others are reported."""
    path = _scratch(spark, "lines")
    points = _points(spark, sf, "t")
    line = F.when(F.col("id") % 10 == 0, F.concat_ws("\t", F.col("id"), F.col("x")))
    line = line.when(F.col("id") % 10 == 5, F.concat_ws("\t", F.col("id"), F.lit("x"), F.col("y")))
    whole = F.concat_ws("\t", F.col("id"), F.col("x"), F.col("y"))
    points.select(line.otherwise(whole).alias("value")).write.text(path)
    bad = nf.validate_points(nf.read_points(spark, path, on_error="keep").cache()).bad
    return bad.select(F.split("bad_line", "\t")[0].cast("bigint").alias("id"), "reason")


def _written_leaves(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark, "leaves")
    nf.write_leaves(_leaves(spark, sf), path)
    return nf.read_leaves(spark, path)


def _sample_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a sample of the orders is a part of them, of about the share asked for."""
    points = _points(spark, sf, "o")
    sample = nf.sample_points(points, 10, seed=1)
    facts = points.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(1).alias("one"))
    strange = sample.join(points, ["id", "x", "y"], "left_anti")
    seen = sample.agg(F.count(F.lit(1)).alias("m")).select("m", F.lit(1).alias("one"))
    odd = strange.agg(F.count(F.lit(1)).alias("s")).select("s", F.lit(1).alias("one"))
    both = facts.join(seen, "one").join(odd, "one")
    # Five standard deviations of a binomial count.
    near = F.abs(F.col("m") - 0.1 * F.col("n")) <= 5 * F.sqrt(0.09 * F.col("n"))
    return both.select((F.col("s") == 0).alias("all_known"), near.alias("about_a_tenth"))


def _indexed(q: str, t: str, dims: int = 2, method: str = "bf"):
    """A join that starts from an index written before."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        folder = f"{staging_folder(spark)}/nearfield/index-{uuid.uuid4().hex}"
        nf.index_points(_points(spark, sf, t, dims), folder)
        index = nf.read_index(spark, folder)
        return nf.aknn_join(_points(spark, sf, q, dims), index, K, method=method)

    return run


def _own_radius(dims: int):
    """Each query looks as far as its own radius, here one that grows along x."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        q = _points(spark, sf, "q", dims).withColumn("far", F.expr(OWN_RADIUS))
        return nf.radius_join(q, _points(spark, sf, "t", dims), "far")

    return run


def _bounded(spark: SparkSession, sf: str) -> DataFrame:
    q = _points(spark, sf, "q").withColumn("far", F.expr(OWN_RADIUS))
    return nf.aknn_join(q, _points(spark, sf, "t"), K, bound="far", method="ps")


def _extended(spark: SparkSession, sf: str) -> DataFrame:
    """Lists over the parts, brought up to date with the orders."""
    q = _points(spark, sf, "q")
    lists = nf.aknn_join(q, _points(spark, sf, "t"), K)
    return nf.extend_neighbors(lists, q, _points(spark, sf, "o"), K)


def _two_phase(tree: bool, t: str | None = None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        q, t_name = _points(spark, sf, "q"), t or ("t_skewed" if tree else "t")
        t_points = _points(spark, sf, t_name)
        where = {"leaves": _leaves(spark, sf)} if tree else {"n": N}
        return nf.two_phase_join(q, t_points, K, **where)

    return run


def _inferred_3d(spark: SparkSession, sf: str) -> DataFrame:
    return nf.aknn_join(_points(spark, sf, "q", 3), _points(spark, sf, "t", 3), K)


def _estimate_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Radius guesses also of queries whose own cell is empty, from half a cell's width."""
    q = _points(spark, sf, "q").select(F.col("id").alias("qid"))
    lists = _local("bf", n=60)(spark, sf).groupBy("qid").agg(
        F.count(F.lit(1)).alias("found"), F.max("dist").alias("r")
    )
    every = q.join(lists, "qid", "left").select(
        "qid", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("r", F.lit(1 / 120)).alias("r")
    )
    guess = estimate_radius(F.col("found"), K, F.col("r"), 2)
    return every.select("qid", "found", guess.alias("guess"))


def _tight_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return nf.build_leaves(_points(spark, sf, "tight"), capacity=CAPACITY)


def ready(spark: SparkSession) -> None:
    """On a local master without a checkpoint folder, stage tables in a scratch folder."""
    local = re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", ""))
    if local and not any(spark.conf.get(s, None) for s in ("spark.checkpoint.dir", FOLDER_SETTING)):
        spark.conf.set(FOLDER_SETTING, tempfile.mkdtemp(prefix="nearfield-"))


def _prepared(query: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ready(spark)
        return query(spark, sf)

    return run


def _optional() -> list:
    """Modules with queries and SQL of their own that may have been taken out of the repository."""
    names = ("nearfield.llm.registry", "corpus_pipeline")
    if importlib.util.find_spec("nearfield.llm") is None:
        return []
    return [importlib.import_module(n) for n in names if importlib.util.find_spec(n) is not None]


def entry(spark: SparkSession) -> DataFrame:
    """The 10 parts nearest to every customer."""
    ready(spark)
    return _aknn("q", "t")(spark, SMALL_SF)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "points_2d": lambda s, sf: _points(s, sf, "q"),
        "points_3d": lambda s, sf: _points(s, sf, "t", 3),
        "count_points": lambda s, sf: nf.count_points(_points(s, sf, "repeated", 3), 3),
        "validate_bad_rows": _validate,
        "validate_duplicate_ids": _duplicates,
        "normalize_points": lambda s, sf: nf.normalize_points(_points(s, sf, "money")),
        "sample_points": _sample_facts,
        "read_points": _read_points,
        "read_points_malformed": _malformed,
        "distance_2d": _pair_measure(distance, "dist", 2),
        "distance_3d": _pair_measure(distance, "dist", 3),
        "sq_distance": _pair_measure(sq_distance, "sq_dist", 2),
        "sq_distance_3d": _pair_measure(sq_distance, "sq_dist", 3),
        "x_distance": _pair_measure(x_distance, "x_dist", 2),
        "box_distances": _box_distances,
        "estimate_radius": _estimate,
        "estimate_radius_empty": _estimate_empty,
        "grid_assign_2d": _grid_assign(2, 50),
        "grid_assign_3d": _grid_assign(3, 20),
        "grid_decode": _grid_decode,
        "grid_bounds": _grid_bounds,
        "cell_histogram": _cell_histogram,
        "occupied_count": lambda s, sf: _cell_histogram(s, sf).agg(
            F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_points")
        ),
        "tree_histogram": _tree_histogram,
        "cells_with_queries": _cells_with_queries,
        "range_cells_grid": _range_cells(2, 20, 0.08),
        "range_cells_grid_3d": _range_cells(3, 6, 0.2),
        "range_cells_tree": _range_cells_tree,
        "range_cells_local_radius": _range_cells_local,
        "radius_join_2d": _radius_join(2),
        "radius_join_3d": _radius_join(3, "ps"),
        "local_knn_bf": _local("bf"),
        "local_knn_ps": _local("ps"),
        "local_knn_3d": _local("bf", dims=3, n=5),
        "local_knn_tree": _local("ps", tree=True),
        "overlaps_grid": _overlaps,
        "overlaps_grid_fine": lambda s, sf: _overlaps(s, sf, 40),
        "overlaps_grid_3d": lambda s, sf: nf.overlaps_grid(
            _points(s, sf, "q", 3), _points(s, sf, "t", 3), K, 4
        ),
        "overlaps_tree": _overlaps_tree,
        "aknn_two_phase": _two_phase(False),
        "aknn_two_phase_tree": _two_phase(True),
        "aknn_two_phase_repeated": _two_phase(False, "repeated"),
        "overlaps_repeated_ids": lambda s, sf: nf.overlaps_grid(
            _points(s, sf, "q"), _points(s, sf, "repeated"), K, N
        ),
        "aknn_indexed": _indexed("q", "t"),
        "aknn_indexed_3d": _indexed("q", "o", 3, "ps"),
        "aknn_bounded": _bounded,
        "radius_join_own": _own_radius(2),
        "radius_join_own_3d": _own_radius(3),
        "extend_neighbors": _extended,
        "range_cells_wide": _range_cells(2, N, 50.0),
        "completeness": _completeness,
        "merge_topk": _merge,
        "aknn_default_n": _aknn("q", "t"),
        "aknn_fine_grid": _aknn("q", "t", n=500, method="ps"),
        "aknn_self": _aknn("t", "t", n=20),
        "aknn_exclude_self": _aknn("t", "t", n=20, exclude_self=True),
        "aknn_k_gt_t": _aknn("q", "few", k=30, n=500),
        "aknn_skewed": _aknn("q", "t_skewed", partitioning="qt", method="ps"),
        "aknn_piled": _aknn("q", "piled", n=50),
        "aknn_repeated_ids": _aknn("q", "repeated"),
        "aknn_repeated_queries": _aknn("repeated", "few", k=5),
        "aknn_outlier": _aknn("q", "outlier"),
        "aknn_inferred_3d": _inferred_3d,
        "aknn_vectors": _aknn("vectors", "vectors", dims=3, partitioning="qt"),
        "leaves_capacity": _leaves,
        "leaves_capacity_3d": lambda s, sf: _leaves(s, sf, 3),
        "leaves_all_children": lambda s, sf: _leaves(s, sf, policy="all_children"),
        "leaves_avg_width": lambda s, sf: _leaves(s, sf, policy="avg_width"),
        "leaves_all_children_3d": lambda s, sf: _leaves(s, sf, 3, "all_children"),
        "leaves_avg_width_3d": lambda s, sf: _leaves(s, sf, 3, "avg_width"),
        "leaves_tight_cluster": _tight_leaves,
        "leaves_written": _written_leaves,
        "mean_leaf_width": lambda s, sf: nf.mean_leaf_width(_leaves(s, sf)),
        "tree_assign_2d": _tree_assign(2),
        "tree_assign_3d": _tree_assign(3),
        "path_bounds": _path_bounds,
        "tree_nodes": lambda s, sf: nf.tree_nodes(_leaves(s, sf)),
        "tree_stats": lambda s, sf: nf.tree_stats(_leaves(s, sf)),
        "tree_string": lambda s, sf: nf.tree_string(_leaves(s, sf)),
        "format_wide": _format_wide,
        "preview": lambda s, sf: nf.preview(_aknn("q", "t")(s, sf), 1000),
        "run_report": _run_report,
    }
    for dims in (2, 3):
        for partitioning in ("gd", "qt"):
            for method in ("bf", "ps"):
                n = (25 if dims == 2 else 8) if partitioning == "gd" else None
                out[f"aknn_{partitioning}_{method}_{dims}d"] = _aknn(
                    "q", "t", dims, partitioning, method, n
                )
    for module in _optional():
        out.update(module.queries())
    return {name: _prepared(query) for name, query in out.items()}


def oracle_sql() -> dict[str, str]:
    cells = _sql_cells("q", "t", N)
    overlaps = f"boxes as {_sql_boxes(N)}, {_sql_overlaps(1 / N)}"
    fine = f"boxes as {_sql_boxes(40)}, {_sql_overlaps(1 / 40)}"
    leaves = _sql_leaves("t_skewed")
    leaves_3d = _sql_leaves("t_skewed", 3)
    leaf_row = "path, depth, {}, n_sample"
    tree_cells = f"""{leaves}, {_sql_assign("q", "qc", 2)}, {_sql_assign("t_skewed", "tc", 2)}"""
    tree_boxes = f"""boxes as (select b.cell, b.n, l.* from
        (select cell, count(*) as n from tc group by cell) b
        join (select path, {_sql_bounds(2)} from leaves) l on l.path = b.cell)"""
    pair_box = f"""with oc as (select o.id as oid, o.x, o.y, {_sql_cell(N, 2, "c.")} as cell
        from orders join {_sql_points("o")} o on o.id = o_orderkey
        join {_sql_points("q")} c on c.id = o_custkey),
        tc as (select * from oc), b as {_sql_boxes(N)}"""
    marks = """marks as (select path, '0' as mark from leaves union all
        select path, '1' from inner_nodes)"""
    out = {
        "points_2d": f"select * from {_sql_points('q')}",
        "points_3d": f"select * from {_sql_points('t', 3)}",
        "count_points": f"""select count(*) as n_rows, count(distinct id) as n_ids,
            count(z) as n_complete from {_sql_points("repeated", 3)}""",
        "validate_bad_rows": f"""select id, 'outside domain' as reason from {_sql_points("money")}
            where x < 0 or x >= 1 or y < 0 or y >= 1""",
        "validate_duplicate_ids": f"""select id, count(*) as n from {_sql_points("repeated")}
            where x >= 0 and x < 1 and y >= 0 and y < 1 group by id having count(*) > 1""",
        "normalize_points": f"""with p as {_sql_points("money")}, b as (select min(x) x0, min(y) y0,
            greatest(max(x)-min(x), max(y)-min(y))
                * (cast(1 as double) + cast(1e-9 as double)) s from p)
            select id, (x-x0)/s as x, (y-y0)/s as y from p, b""",
        "distance_2d": _sql_pair_measure(f"sqrt({_sql_sq('o', 'c', 2)})", "dist", 2),
        "distance_3d": _sql_pair_measure(f"sqrt({_sql_sq('o', 'c', 3)})", "dist", 3),
        "sq_distance": _sql_pair_measure(_sql_sq("o", "c", 2), "sq_dist", 2),
        "sq_distance_3d": _sql_pair_measure(_sql_sq("o", "c", 3), "sq_dist", 3),
        "x_distance": _sql_pair_measure("abs(o.x-c.x)", "x_dist", 2),
        "box_distances": f"""{pair_box} select oid, oc.cell, {_sql_gap("oc", "b")} as min_dist,
            {_sql_far("oc", "b")} as max_dist from oc join b on oc.cell = b.cell""",
        "estimate_radius": f"""with {_sql_cells("q", "t", 30)}, {_sql_local()}
            select qid, count(*) as found,
            sqrt(cast({K} as double)/count(*))*max(dist) as guess from local group by qid""",
        "grid_assign_2d": f"select id, {_sql_cell(50)} as cell from {_sql_points('q')}",
        "grid_assign_3d": f"select id, {_sql_cell(20, 3)} as cell from {_sql_points('q', 3)}",
        "grid_decode": f"""select id, {_sql_cell(20, 3)} as cell, {_sql_index("x", 20)} as i,
            {_sql_index("y", 20)} as j, {_sql_index("z", 20)} as k from {_sql_points("q", 3)}""",
        "grid_bounds": f"""with {_sql_cells("q", "t", 50)}, b as {_sql_boxes(50)}
            select cell, xmin, ymin, xmax, ymax,
            xmin + (cast(1 as double)/cast(50 as double))/2 as xmid,
            ymin + (cast(1 as double)/cast(50 as double))/2 as ymid from b""",
        "cell_histogram": f"""with {_sql_cells("q", "t", 50)}
            select cell, count(*) as n from tc group by cell""",
        "tree_histogram": f"""with {leaves}, {_sql_assign("t", "tc", 2)}
            select cell, count(*) as n from tc group by cell""",
        "cells_with_queries": f"""with {_sql_cells("q", "t", 50)}
            select id, cell from tc where cell in (select cell from qc)""",
        "range_cells_grid": f"""with {_sql_cells("q", "t", 20)}, b as {_sql_boxes(20)}
            select q.id as qid, b.cell from q cross join b
            where {_sql_gap("q", "b")} <= cast(0.08 as double)""",
        "range_cells_grid_3d": f"""with {_sql_cells("q", "t", 6, 3)}, b as {_sql_boxes(6, 3)}
            select q.id as qid, b.cell from q cross join b
            where {_sql_gap("q", "b", 3)} <= cast(0.2 as double)""",
        "range_cells_tree": f"""with {tree_cells}, {tree_boxes}, q as {_sql_points("q")}
            select q.id as qid, b.cell from q cross join boxes b
            where {_sql_gap("q", "b")} <= cast(0.05 as double)""",
        "range_cells_local_radius": f"""with {cells}, {_sql_local()}, b as {_sql_boxes(N)}
            select qc.id as qid, b.cell from qc
            join (select qid, dist as r from local where rank = {K}) l on l.qid = qc.id
            cross join b where {_sql_gap("qc", "b")} <= r and b.cell <> qc.cell""",
        "local_knn_3d": f"""with {_sql_cells("q", "t", 5, 3)}, {_sql_local(3)}
            select qid, rank, tid, dist from local""",
        "local_knn_tree": f"""with {tree_cells}, {_sql_local()}
            select qid, rank, tid, dist from local""",
        "overlaps_grid": f"""with {cells}, {_sql_local()}, {overlaps}
            select qid, cell, complete from overlap""",
        "overlaps_grid_fine": f"""with {_sql_cells("q", "t", 40)}, {_sql_local()}, {fine}
            select qid, cell, complete from overlap""",
        "overlaps_tree": f"""with {tree_cells}, {_sql_local()}, {tree_boxes},
            {_sql_overlaps(1.0)} select qid, cell, complete from overlap""",
        "completeness": f"""with {cells}, {_sql_local()}, {overlaps}
            select q.id as qid, coalesce(o.complete, false) as complete from q
            left join (select qid, complete from overlap where complete) o on o.qid = q.id""",
        "aknn_default_n": _sql_aknn("q", "t"),
        "aknn_fine_grid": _sql_aknn("q", "t"),
        "aknn_self": _sql_aknn("t", "t"),
        "aknn_exclude_self": _sql_aknn("t", "t", exclude_self=True),
        "aknn_k_gt_t": _sql_aknn("q", "few", k=30),
        "aknn_skewed": _sql_aknn("q", "t_skewed"),
        "aknn_piled": _sql_aknn("q", "piled"),
        "aknn_repeated_ids": _sql_aknn("q", "repeated"),
        "aknn_repeated_queries": _sql_aknn("repeated", "few", k=5),
        "aknn_outlier": _sql_aknn("q", "outlier"),
        "aknn_inferred_3d": _sql_aknn("q", "t", 3),
        "aknn_two_phase": _sql_aknn("q", "t"),
        "aknn_two_phase_tree": _sql_aknn("q", "t_skewed"),
        "aknn_two_phase_repeated": _sql_aknn("q", "repeated"),
        "overlaps_repeated_ids": f"""with {_sql_cells("q", "repeated", N).replace("as cell from t)",
                "as cell, row_number() over (partition by id order by x, y) = 1 as first from t)")},
            {_sql_local().replace("sqrt(", "min(sqrt(").replace(") dist", ")) dist").replace(
                "on qc.cell = tc.cell", "on qc.cell = tc.cell group by qc.id, tc.id")},
            boxes as {_sql_boxes(N).replace("count(*)", "count(*) filter (where first)")},
            {_sql_overlaps(1 / N)} select qid, cell, complete from overlap""",
        "aknn_indexed": _sql_aknn("q", "t"),
        "aknn_indexed_3d": _sql_aknn("q", "o", 3),
        "aknn_bounded": f"""with q as (select *, {OWN_RADIUS} as far from {_sql_points("q")}),
            t as {_sql_points("t")},
            d as (select q.id as qid, t.id as tid, sqrt({_sql_sq("q", "t", 2)}) as dist, far from q cross join t),
            r as (select *, row_number() over (partition by qid order by dist, tid) as rn from d where dist <= far)
            select qid, cast(rn as int) as rank, tid, dist from r where rn <= {K}""",
        "radius_join_own": _sql_own_radius(2),
        "radius_join_own_3d": _sql_own_radius(3),
        "extend_neighbors": _sql_aknn("q", "t", more="o"),
        "aknn_vectors": _sql_aknn("vectors", "vectors", 3),
        "sample_points": "select true as all_known, true as about_a_tenth",
        "read_points": f"select * from {_sql_points('t', 3)}",
        "read_points_malformed": f"""select id, 'malformed line' as reason from {_sql_points("t")}
            where id % 10 in (0, 5)""",
        "estimate_radius_empty": f"""with {_sql_cells("q", "t", 60)}, {_sql_local()},
            f as (select qid, count(*) as found, max(dist) as r from local group by qid),
            e as (select q.id as qid, coalesce(found, 0) as found,
                  coalesce(r, cast({1 / 120!r} as double)) as r from q left join f on f.qid = q.id)
            select qid, found, case when found > 0 then sqrt(cast({K} as double)/found)*r
                else cast(1.2 as double)*sqrt(cast({K} as double))*r end as guess from e""",
        "occupied_count": f"""with {_sql_cells("q", "t", 50)}
            select count(distinct cell) as n_cells, count(*) as n_points from tc""",
        "range_cells_wide": f"""with {cells}, b as {_sql_boxes(N)}
            select q.id as qid, b.cell from q cross join b""",
        "overlaps_grid_3d": f"""with {_sql_cells("q", "t", 4, 3)}, {_sql_local(3)},
            boxes as {_sql_boxes(4, 3)}, {_sql_overlaps(1 / 4, 3)}
            select qid, cell, complete from overlap""",
        "leaves_tight_cluster": f"""with {_sql_leaves("tight", depth=32)}
            select {leaf_row.format(_sql_bounds(2, 32))} from leaves""",
        "leaves_written": f"with {leaves} select {leaf_row.format(_sql_bounds(2))} from leaves",
        "run_report": f"""with {cells}, {_sql_local()}
            select 1 as step, 'points' as phase, (select count(*) from t) as n_rows union all
            select 2, 'cells', (select count(distinct cell) from tc) union all
            select 3, 'own cell', (select count(*) from local)""",
        "leaves_capacity": f"with {leaves} select {leaf_row.format(_sql_bounds(2))} from leaves",
        "leaves_capacity_3d": f"""with {leaves_3d}
            select {leaf_row.format(_sql_bounds(3))} from leaves""",
        "mean_leaf_width": f"""with {leaves} select avg(w) as avg_width, count(*) as n_widths
            from (select distinct pow(2.0::double, -depth) as w from leaves)""",
        "path_bounds": f"""with {leaves_3d} select path, {_sql_bounds(3)} from inner_nodes""",
        "tree_nodes": f"with {leaves}, {marks} select path, mark from marks",
        "tree_stats": f"""with {leaves} select count(*) as n_leaves,
            cast(min(depth) as int) as min_depth, cast(max(depth) as int) as max_depth,
            cast(sum(n_sample) as bigint) as n_sample,
            (select count(*) from inner_nodes) as n_internal from leaves""",
        "tree_string": f"""with {leaves}, {marks}
            select string_agg(mark, '' order by path) as tree from marks""",
        "format_wide": f"""select qid, cast(qid as varchar) || chr(9) || string_agg(
            cast(tid as varchar) || chr(9) || printf('%.10f', dist) || chr(9), '' order by rank)
            as line from ({_sql_aknn("q", "t")}) group by qid""",
        "preview": f"select * from ({_sql_aknn('q', 't')}) order by qid, rank limit 1000",
        "merge_topk": f"""with {cells}, c7 as (select *, {_sql_cell(7)} as cell7 from qc),
            t7 as (select *, {_sql_cell(7)} as cell7 from tc), {_sql_local()},
            near7 as (select c7.id qid, t7.id tid, sqrt({_sql_sq("c7", "t7", 2)}) dist
                      from c7 join t7 on c7.cell7 = t7.cell7),
            local7 as (select * from (select *, row_number() over
                (partition by qid order by dist, tid) as rank from near7) where rank <= {K}),
            d as (select qid, tid, min(dist) dist from (select qid, tid, dist from local
                  union all select qid, tid, dist from local7) group by qid, tid),
            m as (select *, row_number() over (partition by qid order by dist, tid) rn from d)
            select qid, cast(rn as int) as rank, tid, dist from m where rn <= {K}""",
    }
    for dims, name in ((2, "tree_assign_2d"), (3, "tree_assign_3d")):
        out[name] = f"""with {_sql_leaves("t_skewed", dims)}, {_sql_assign("q", "qc", dims)}
            select id, cell from qc"""
    for policy in ("all_children", "avg_width"):
        for dims, name in ((2, f"leaves_{policy}"), (3, f"leaves_{policy}_3d")):
            out[name] = f"""with {_sql_leaves("t_skewed", dims, policy)}
                select {leaf_row.format(_sql_bounds(dims))} from leaves"""
    for method in ("bf", "ps"):
        out[f"local_knn_{method}"] = f"""with {cells}, {_sql_local()}
            select qid, rank, tid, dist from local"""
    for dims in (2, 3):
        out[f"radius_join_{dims}d"] = f"""with q as {_sql_points("q", dims)},
            t as {_sql_points("t", dims)}
            select q.id as qid, t.id as tid, sqrt({_sql_sq("q", "t", dims)}) as dist
            from q cross join t
            where sqrt({_sql_sq("q", "t", dims)}) <= cast({RADIUS[dims]} as double)"""
        for partitioning in ("gd", "qt"):
            for method in ("bf", "ps"):
                out[f"aknn_{partitioning}_{method}_{dims}d"] = _sql_aknn("q", "t", dims)
    for module in _optional():
        out.update(module.oracle_sql())
    return out
