"""Merkle manifest of a dataset: a SHA midstate tree over its rows.

A row's leaf is the SHA-256 of its fields. The leaves of one group, by id, are the bottom of the group's
tree; runs of ``fanout`` digests become the digest of their hex texts until one is left, the subroot. The
subroots, by group, are the bottom of another tree, whose end is the root. Every parent keeps a
copy of its hash state from before each child slot. A changed leaf is folded to the root by resuming
the state of its slot with the new digest and the siblings to the right only.

Trees are cut into blocks of ``fanout ** BLOCK_HEIGHT`` digests: a block is hashed in one task, its top is a
row of the next round. On the way down each block gets the retained states and right siblings above
it as one value, so a leaf's fold ends at the root without any other row.

Rows with a null group come first, within a group those with a null id. Rows that agree in group and id
are ordered by their leaf, so results do not depend on the input's order; equal rows have equal leaves but
places of their own. Null fields count as ``-``, empty texts as ``0:``. An empty table has no rows and
no root. Columns beyond those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import sha_states as sha
from nearfield.llm.ranges import positions
from nearfield.plans.staging import Stage

FANOUT = 2
BLOCK_HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --- one block, in numpy --------------------------------------------------------------


@dataclass
class Block:
    """The tree over some digests: those of every level, and for each parent level the states (slot, 8,
    parent) from before each child slot and the parents' numbers of children."""

    fanout: int
    digests: list[np.ndarray]
    states: list[np.ndarray]
    counts: list[np.ndarray]

    @property
    def top(self) -> np.ndarray:
        return self.digests[-1]


def build_block(leaves: np.ndarray, fanout: int, height: int) -> Block:
    block = Block(fanout, [leaves], [], [])
    for _ in range(height):
        below = block.digests[-1]
        n = below.shape[1]
        parents = -(-n // fanout)
        count = np.minimum(fanout, n - np.arange(parents) * fanout)
        state, states = sha.start(parents), []
        for slot in range(fanout):
            states.append(state)
            has = np.flatnonzero(count > slot)
            state = state.copy()
            state[:, has] = sha.append(state[:, has], below[:, has * fanout + slot])
        block.states.append(np.stack(states))
        block.counts.append(count)
        block.digests.append(sha.finish(state, count))
    return block


def _alike(node: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of each kind of (node, digest), and the kind of every entry."""
    rows = np.ascontiguousarray(np.concatenate([node.astype(np.uint32)[None, :], digest]).T)
    kinds = rows.view(np.dtype((np.void, rows.shape[1] * 4))).ravel()
    _, first, kind = np.unique(kinds, return_index=True, return_inverse=True)
    return first, kind


def fold_block(block: Block, node: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """What the top becomes if leaf ``node[i]`` is replaced by column i, for each i by itself.

    Replacements that meet in the same node with the same digest go on as one.
    """
    back = np.arange(len(node))
    for level, (states, count) in enumerate(zip(block.states, block.counts, strict=True)):
        first, kind = _alike(node, digest)
        node, digest, back = node[first], digest[:, first], kind[back]
        parent, slot = np.divmod(node, block.fanout)
        state = sha.append(np.ascontiguousarray(states[slot, :, parent].T), digest)
        for step in range(1, block.fanout):
            more = np.flatnonzero(slot + step < count[parent])
            state[:, more] = sha.append(state[:, more], block.digests[level][:, node[more] + step])
        node, digest = parent, sha.finish(state, count[parent])
    return digest[:, back]


def fold_path(path: bytes, digest: np.ndarray) -> np.ndarray:
    """The same along a stored path, as ``paths_of`` writes it."""
    first, kind = _alike(np.zeros(digest.shape[1]), digest)
    digest, at = digest[:, first], 0
    while at < len(path):
        count, right = path[at], path[at + 1]
        state = sha.words_of(path[at + 2 : at + 34])
        state = sha.append(np.repeat(state, digest.shape[1], axis=1), digest)
        at += 34
        for _ in range(right):
            sibling = sha.words_of(path[at : at + 32])
            state = sha.append(state, np.repeat(sibling, digest.shape[1], axis=1))
            at += 32
        digest = sha.finish(state, np.full(digest.shape[1], count))
    return digest[:, kind]


def proofs_of(block: Block) -> list[bytes]:
    """For every leaf of the block the hex digests of its siblings, level by level, left to right."""
    n = block.digests[0].shape[1]
    node = np.arange(n)
    parts, used = [], []
    for digests, count in zip(block.digests, block.counts, strict=False):
        parent, slot = np.divmod(node, block.fanout)
        raw = np.frombuffer(sha.bytes_of(digests).hex().encode(), dtype="S64")
        for other in range(block.fanout):
            here = (other != slot) & (other < count[parent])
            parts.append(raw[np.where(here, parent * block.fanout + other, 0)])
            used.append(here)
        node = parent
    if not parts:
        return [b""] * n
    parts, used = np.stack(parts, axis=1), np.stack(used, axis=1)
    return [parts[i][used[i]].tobytes() for i in range(n)]


def paths_of(block: Block) -> list[bytes]:
    """For every leaf of the block and each level above it: the number of the parent's children, that of
    right siblings, the retained state of the leaf's slot and the right siblings' digests."""
    f = block.fanout
    levels = [
        (sha.bytes_of(d), [sha.bytes_of(s) for s in states], count)
        for d, states, count in zip(block.digests, block.states, block.counts, strict=False)
    ]
    paths = []
    for leaf in range(block.digests[0].shape[1]):
        node, path = leaf, b""
        for digests, states, count in levels:
            parent, slot = divmod(node, f)
            children = int(count[parent])
            path += bytes([children, children - slot - 1]) + states[slot][parent * 32 : parent * 32 + 32]
            path += digests[(node + 1) * 32 : (parent * f + children) * 32]
            node = parent
        paths.append(path)
    return paths


# --- trees on Spark -------------------------------------------------------------------


def _height(n: int, fanout: int, most: int) -> int:
    """Levels until one digest is left of ``n``, at most ``most``."""
    height = 0
    while n > 1 and height < most:
        n, height = -(-n // fanout), height + 1
    return height


def _pack(columns: list[tuple[str, pa.DataType]], fanout: int, block_height: int) -> Callable:
    """A group of one block's rows as one row: its digests, the given columns and the block's top."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        leaves = sha.words_of(b"".join(group.column("digest").to_pylist()))
        n = group.column("n")[0].as_py()
        height = _height(n, fanout, block_height)
        top = build_block(leaves, fanout, height).top
        out = {
            "tree": pa.array([group.column("tree")[0].as_py()], pa.string()),
            "block": pa.array([group.column("block")[0].as_py()], pa.int64()),
            "n": pa.array([n], pa.int64()),
            "leaves": pa.array([sha.bytes_of(leaves)], pa.binary()),
            "top": pa.array([sha.bytes_of(top)], pa.binary()),
        }
        for name, kind in columns:
            out[name] = pa.array([group.column(name).to_pylist()], pa.list_(kind))
        return pa.table(out)

    return run


def _rounds(
    stage: Stage, name: str, nodes: DataFrame, most: int, fanout: int, height: int, carried: str = ""
) -> tuple[list[DataFrame], DataFrame]:
    """Tables of packed blocks, from the bottom up, and the tops (tree, digest) of all trees.

    ``nodes`` are (tree, pos, n, digest) and, for the bottom, ``carried`` columns given as a schema.
    """
    size, rounds = fanout**height, []
    while True:
        extra = nodes.drop("tree", "pos", "n", "digest").schema if not rounds else []
        schema = "tree string, block bigint, n bigint, leaves binary, top binary" + (
            carried if not rounds else ""
        )
        columns = [(f.name, _arrow(f.dataType)) for f in extra]
        blocks = nodes.withColumn("block", F.expr(f"pos div {size}"))
        blocks = blocks.groupBy("tree", "block").applyInArrow(_pack(columns, fanout, height), schema)
        rounds.append(stage.save(blocks, f"{name}-{len(rounds)}"))
        most = -(-most // size)
        left = F.expr(f"(n + {size - 1}) div {size}")
        nodes = rounds[-1].select("tree", F.col("block").alias("pos"), left.alias("n"), F.col("top").alias("digest"))
        if most <= 1:
            return rounds, nodes.select("tree", "digest")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


_PATHS = "tree string, pos bigint, path binary, proof binary, subroot binary, root binary"


def _children(fanout: int, height: int) -> Callable:
    """Rows of packed blocks with what is above them, as what is above each of their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = build_block(sha.words_of(row["leaves"]), fanout, _height(row["n"], fanout, height))
                paths, proofs = paths_of(block), proofs_of(block)
                k, first = len(paths), row["block"] * fanout**height
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array([row["tree"]] * k, pa.string()),
                        "pos": pa.array(range(first, first + k), pa.int64()),
                        "path": pa.array([p + row["path"] for p in paths], pa.binary()),
                        "proof": pa.array([p + row["proof"] for p in proofs], pa.binary()),
                        "subroot": pa.array([row["subroot"]] * k, pa.binary()),
                        "root": pa.array([row["root"]] * k, pa.binary()),
                    }
                )

    return run


def _descend(stage: Stage, name: str, rounds: list[DataFrame], above: DataFrame, fanout: int, height: int) -> DataFrame:
    """From paths above the last round's blocks to paths above the first round's."""
    for i, blocks in reversed(list(enumerate(rounds))):
        if i == 0:
            break
        met = blocks.join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
        above = stage.save(met.mapInArrow(_children(fanout, height), _PATHS), f"{name}-above-{i}")
    return above


def _verified(id_kind: pa.DataType, fanout: int, height: int) -> Callable:
    hexes = lambda digest: [h.decode() for h in np.frombuffer(sha.bytes_of(digest).hex().encode(), dtype="S64")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves = sha.words_of(row["leaves"])
                k = leaves.shape[1]
                block = build_block(leaves, fanout, _height(row["n"], fanout, height))
                raw = row["leaves"]
                now = b"".join(t or raw[i * 32 : i * 32 + 32] for i, t in enumerate(row["tampered"]))
                folded = fold_path(row["path"], fold_block(block, np.arange(k), sha.words_of(now)))
                root = row["root"].hex()
                folded = hexes(folded)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(row["id"], id_kind),
                        "leaf": pa.array(hexes(leaves)),
                        "subroot": pa.array([row["subroot"].hex()] * k),
                        "root": pa.array([root] * k),
                        "proof_sha256": pa.array(
                            [hashlib.sha256(p + row["proof"]).hexdigest() for p in proofs_of(block)]
                        ),
                        "folded_root": pa.array(folded),
                        "verified": pa.array([f == root for f in folded]),
                    }
                )

    return run


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields: ``-`` if null, else UTF-8 byte count, ``:`` and the value."""
    parts = [c.cast("string") for c in fields]
    coded = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts]
    return F.unhex(F.sha2(F.concat(*coded).cast("binary"), 256))


def verify_manifest(
    docs: DataFrame,
    tampering: dict[str, Column] | None = None,
    tampered_rows: Column | None = None,
    *,
    id_column: str = "doc_id",
    group_column: str = "lang",
    fields: Sequence[str] = FIELDS,
    fanout: int = FANOUT,
    block_height: int = BLOCK_HEIGHT,
) -> DataFrame:
    """Each row's place in the manifest and whether it still folds to the root.

    Columns: the id, leaf, subroot, root, proof_sha256 (SHA-256 over the hex digests of all siblings on
    the way up), folded_root and verified. ``tampering`` gives new values of fields for the rows
    ``tampered_rows``; their fold starts from the leaf of the new values, that of others from their own.
    """
    if not 2 <= fanout <= 255:
        raise ValueError(f"fanout must be from 2 to 255, not {fanout!r}")
    stage = Stage(docs.sparkSession)
    own = [F.col(f"`{c}`") for c in fields]
    changed = [(tampering or {}).get(c, F.col(f"`{c}`")) for c in fields]
    tampered_rows = F.lit(False) if tampered_rows is None else tampered_rows
    # "=" before a value keeps the order of groups and leaves the empty text to null.
    group = F.col(f"`{group_column}`").cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),
        F.col(f"`{id_column}`").alias("id"),
        leaf_digest(own).alias("digest"),
        F.when(tampered_rows, leaf_digest(changed)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage.save(rows, "leaves")
    id_type = rows.schema["id"].dataType
    placed, most = positions(stage, "leaves", rows, "tree", ["id", "digest", "row"])
    carried = f", id array<{id_type.simpleString()}>, tampered array<binary>"
    bottom = placed.select("tree", "pos", "n", "digest", "id", "tampered")
    blocks, tops = _rounds(stage, "group", bottom, most, fanout, block_height, carried)
    tops = stage.save(tops, "subroots")
    upper, groups = positions(stage, "subroots", tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"])
    named = stage.save(upper, "named-subroots")
    forest, root = _rounds(stage, "root", named.select("tree", "pos", "n", "digest"), groups, fanout, block_height)
    start = root.select(
        "tree", F.lit(0).cast("bigint").alias("pos"), F.lit(b"").alias("path"), F.lit(b"").alias("proof"),
        F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"),
    )
    above = _descend(stage, "root", forest, start, fanout, block_height)
    met = forest[0].join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
    above = met.mapInArrow(_children(fanout, block_height), _PATHS).drop("subroot", "tree")
    above = named.select("pos", F.col("name").alias("tree"), F.col("digest").alias("subroot")).join(above, "pos")
    above = above.withColumn("pos", F.lit(0).cast("bigint"))
    above = stage.save(above.select("tree", "pos", "path", "proof", "subroot", "root"), "above-groups")
    above = _descend(stage, "group", blocks, above, fanout, block_height)
    met = blocks[0].join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
    out = met.mapInArrow(
        _verified(_arrow(id_type), fanout, block_height),
        f"id {id_type.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean",
    )
    return out.withColumnRenamed("id", id_column)
