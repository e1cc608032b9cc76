"""Quadtree and octree partitions as a table of leaves.

A tree is ``(path, depth, xmin, xmax, ymin, ymax, zmin, zmax, n_sample)``, one row per leaf.
It is built from counts per path prefix, so no node object and no recursion is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.geometry import axes_of
from nearfield.functions.tree import MAX_DEPTH, bound_columns, check_depth, tree_path

# Depth that is counted first; if nodes there are still crowded, counting goes on further down.
FIRST_DEPTH = 16
# Nodes that avg_width may ask for, and nodes of a tree that may become one string.
WIDEST = 1 << 24
LONGEST_STRING = 10_000_000
POLICIES = ("capacity", "all_children", "avg_width")


def build_leaves(
    sample: DataFrame,
    *,
    capacity: int,
    dims: int = 2,
    policy: str = "capacity",
    max_depth: int | None = None,
    avg_width: float | None = None,
) -> DataFrame:
    """Leaves of the tree that splits nodes with more than ``capacity`` sample points.

    ``all_children`` also splits the siblings of a split node. ``avg_width`` also splits nodes
    wider than ``avg_width``, by default the mean of the distinct leaf widths of the
    ``capacity`` tree. Nodes are split until they hold no more than ``capacity`` points or all
    theirs share one position; ``max_depth`` ends that sooner. Points outside the unit box are not
    counted.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy!r}")
    if capacity < 1:
        raise ValueError(f"capacity must be at least 1, not {capacity!r}")
    if max_depth is None:
        max_depth = needed_depth(sample, dims, capacity)
    counts = prefix_counts(sample, dims, max_depth)
    inner = _crowded(counts, capacity, max_depth)
    if policy == "all_children":
        inner = _with_siblings(inner, dims)
    elif policy == "avg_width":
        if avg_width is None:
            # Mean over at most max_depth + 1 distinct widths.
            avg_width = mean_leaf_width(_leaves_under(inner, counts, dims)).first().avg_width
        inner = inner.unionByName(
            wide_nodes(sample.sparkSession, avg_width, dims, max_depth)
        ).distinct()
    return _leaves_under(inner, counts, dims)


def needed_depth(sample: DataFrame, dims: int, capacity: int) -> int:
    """``FIRST_DEPTH`` or the multiple of it at which only piles are still crowded."""
    axes, depth = axes_of(dims), FIRST_DEPTH
    apart = None
    for a in axes:
        here = F.max(a) > F.min(a)
        apart = here if apart is None else apart | here
    inside = _in_unit_box(dims)
    while depth < MAX_DEPTH:
        node = tree_path([F.col(a) for a in axes], depth).alias("node")
        nodes = sample.filter(inside).groupBy(node).agg(
            F.count(F.lit(1)).alias("n"), apart.alias("apart")
        )
        if nodes.filter(F.col("apart") & (F.col("n") > capacity)).isEmpty():
            break
        depth = min(MAX_DEPTH, depth + FIRST_DEPTH)
    return depth


def _in_unit_box(dims: int):
    inside = F.lit(True)
    for a in axes_of(dims):
        inside = inside & (F.col(a) >= 0) & (F.col(a) < 1)
    return inside


def prefix_counts(sample: DataFrame, dims: int, max_depth: int) -> DataFrame:
    """Sample points per path prefix: ``(path, n_sample)`` for every occupied node."""
    axes = axes_of(dims)
    inside = _in_unit_box(dims)
    full = tree_path([F.col(a) for a in axes], check_depth(max_depth))
    deepest = sample.filter(inside).groupBy(full.alias("full")).agg(F.count(F.lit(1)).alias("n"))
    depth = F.explode(F.sequence(F.lit(0), F.lit(max_depth)))
    return (
        deepest.withColumn("depth", depth)
        .groupBy(F.expr("substring(full, 1, depth)").alias("path"))
        .agg(F.sum("n").alias("n_sample"))
    )


def _crowded(counts: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    return counts.filter(
        (F.col("n_sample") > capacity) & (F.length("path") < max_depth)
    ).select("path")


def _parent(path: str = "path"):
    return F.expr(f"substring({path}, 1, length({path}) - 1)")


def _children(nodes: DataFrame, dims: int) -> DataFrame:
    digits = F.array(*[F.lit(str(d)) for d in range(2**dims)])
    return nodes.select(F.explode(digits).alias("digit"), "path").select(
        F.concat("path", "digit").alias("path")
    )


def _with_siblings(inner: DataFrame, dims: int) -> DataFrame:
    parents = inner.filter(F.length("path") > 0).select(_parent().alias("path")).distinct()
    return inner.unionByName(_children(parents, dims)).distinct()


def wide_nodes(spark: SparkSession, avg_width: float, dims: int, max_depth: int) -> DataFrame:
    """Paths of all nodes wider than ``avg_width`` and above ``max_depth``."""
    depths = [d for d in range(max_depth) if 2.0**-d > avg_width]
    if sum(2 ** (dims * d) for d in depths) > WIDEST:
        raise ValueError(f"avg_width={avg_width!r} asks for more than {WIDEST} nodes")
    if not depths:
        return spark.createDataFrame([], "path string")
    levels = None
    for d in depths:
        # The number of a node, written in base 2^dims with one digit per level.
        numbers = spark.range(2 ** (dims * d))
        if d == 0:
            level = numbers.select(F.lit("").alias("path"))
        else:
            base = 2**dims
            digit = [
                F.expr(f"(id div {base**i}) % {base}").cast("string") for i in range(d - 1, -1, -1)
            ]
            level = numbers.select(F.concat(*digit).alias("path"))
        levels = level if levels is None else levels.unionByName(level)
    return levels


def _leaves_under(inner: DataFrame, counts: DataFrame, dims: int) -> DataFrame:
    root = inner.sparkSession.range(1).select(F.lit("").alias("path"))
    nodes = root.unionByName(_children(inner, dims))
    # Counts are far more rows than the points they come from, by which Spark would judge their size.
    leaves = nodes.join(inner.hint("merge"), "path", "left_anti")
    leaves = leaves.join(counts.hint("merge"), "path", "left")
    return leaves.select(
        "path",
        F.length("path").alias("depth"),
        *bound_columns(F.col("path"), dims),
        F.coalesce("n_sample", F.lit(0).cast("bigint")).alias("n_sample"),
    )


def mean_leaf_width(leaves: DataFrame) -> DataFrame:
    """One row: the mean of the distinct leaf widths, and how many there are."""
    widths = leaves.select((F.col("xmax") - F.col("xmin")).alias("width")).distinct()
    return widths.agg(F.avg("width").alias("avg_width"), F.count("width").alias("n_widths"))


def internal_nodes(leaves: DataFrame) -> DataFrame:
    """Paths of all split nodes: the proper prefixes of the leaf paths."""
    deep = leaves.filter(F.col("depth") > 0)
    depth = F.explode(F.sequence(F.lit(0), F.col("depth") - 1))
    return (
        deep.select("path", depth.alias("cut"))
        .select(F.expr("substring(path, 1, cut)").alias("path"))
        .distinct()
    )


def tree_stats(leaves: DataFrame) -> DataFrame:
    """One row: leaves, internal nodes, depths and the sample points held."""
    inner = internal_nodes(leaves).agg(F.count(F.lit(1)).alias("n_internal"))
    facts = leaves.agg(
        F.count(F.lit(1)).alias("n_leaves"),
        F.min("depth").alias("min_depth"),
        F.max("depth").alias("max_depth"),
        F.sum("n_sample").alias("n_sample"),
    )
    # Both sides are one row; the key makes the join an equality join.
    one = F.lit(1).alias("one")
    return facts.select("*", one).join(inner.select("*", one), "one").drop("one")


def tree_nodes(leaves: DataFrame) -> DataFrame:
    """All nodes in depth-first order: ``(path, mark)``, mark 1 for split nodes, 0 for leaves.

    Paths hold digits only, so their plain order is the depth-first order.
    """
    inner = internal_nodes(leaves).select("path", F.lit("1").alias("mark"))
    return inner.unionByName(leaves.select("path", F.lit("0").alias("mark"))).orderBy("path")


def tree_string(leaves: DataFrame) -> DataFrame:
    """The depth-first string of marks, one value; ``tree_nodes`` has the same marks as rows.

    A tree of more than ``LONGEST_STRING`` nodes is an error.
    """
    facts = tree_stats(leaves).first()
    if facts.n_leaves + facts.n_internal > LONGEST_STRING:
        raise ValueError(f"the tree has more than {LONGEST_STRING} nodes; use tree_nodes")
    nodes = tree_nodes(leaves).agg(F.sort_array(F.collect_list(F.struct("path", "mark"))).alias("a"))
    return nodes.select(
        F.array_join(F.transform("a", lambda node: node["mark"]), "").alias("tree")
    )


def write_leaves(leaves: DataFrame, path: str, mode: str = "errorifexists") -> None:
    leaves.write.mode(mode).parquet(path)


def read_leaves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
