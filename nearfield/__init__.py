"""Exact nearest-neighbour joins and space partitioning for 2D and 3D points on Spark DataFrames."""

from nearfield.operators.cells import (
    assign_grid,
    assign_tree,
    cell_histogram,
    cells_with_queries,
)
from nearfield.operators.leaves import (
    build_leaves,
    internal_nodes,
    mean_leaf_width,
    read_leaves,
    tree_nodes,
    tree_stats,
    tree_string,
    write_leaves,
)
from nearfield.operators.neighbors import local_radius, merge_topk, preview, topk
from nearfield.plans.aknn import aknn_join
from nearfield.plans.grow import extend_neighbors
from nearfield.plans.index import PointIndex, index_points, read_index
from nearfield.plans.local import local_knn
from nearfield.plans.meet import PairCount
from nearfield.plans.overlaps import (
    completeness,
    occupied_cells,
    overlaps_grid,
    overlaps_tree,
    probe_overlaps,
    range_cells,
    two_phase_join,
)
from nearfield.plans.staging import drop_staged
from nearfield.plans.within import radius_join
from nearfield.session import configure
from nearfield.sources.points import (
    count_points,
    infer_dims,
    normalize_points,
    read_points,
    sample_points,
    validate_points,
)
from nearfield.sources.writers import format_wide, run_report, write_neighbors

__all__ = [
    "PairCount",
    "PointIndex",
    "aknn_join",
    "assign_grid",
    "assign_tree",
    "build_leaves",
    "cell_histogram",
    "cells_with_queries",
    "completeness",
    "configure",
    "count_points",
    "drop_staged",
    "extend_neighbors",
    "format_wide",
    "index_points",
    "infer_dims",
    "internal_nodes",
    "local_knn",
    "local_radius",
    "mean_leaf_width",
    "merge_topk",
    "normalize_points",
    "occupied_cells",
    "overlaps_grid",
    "overlaps_tree",
    "preview",
    "probe_overlaps",
    "radius_join",
    "range_cells",
    "read_index",
    "read_leaves",
    "read_points",
    "run_report",
    "sample_points",
    "topk",
    "two_phase_join",
    "tree_nodes",
    "tree_stats",
    "tree_string",
    "validate_points",
    "write_leaves",
    "write_neighbors",
]
