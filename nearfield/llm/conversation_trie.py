"""Prefix trie of conversations, from padded matrices of turn ids.

A conversation is a sequence of turns; each distinct sequence of its first d turns is a node at depth d.
Sequences are cut into windows of ``WINDOW`` turns, and the rows (window, digest of all before it, turn
ids) are sorted into range shards. In a shard the turn ids form a matrix, padded behind the end. It is
put in order by ``numpy.lexsort``; the OR of the columns' changes from row to row, column by column, marks
where nodes of each depth start, and ``reduceat`` over these starts sums up every depth.

A node that reaches a shard's first or last row may go on next door. Shards first report just these
boundary nodes, two for each depth, whose parts are added up; then every shard is gone through again with
its boundary nodes' totals at hand, and a boundary node is returned by the first shard that has it.
A node's members are never gathered: of a hot prefix each shard holds a part, and the ids of the many
conversations that end in one boundary node are hashed in order as a stream.

Conversations longer than one window take a second pass: what lies in later windows is summed for each
window's beginning and handed to the node in front of it through one member.

Turns are compared by 120 bits of a SHA-256 of role and text. Turns of a conversation go by number, null
first, equal numbers by that hash; repeated rows are turns of their own. A null role or text is
empty. Rows with a null conversation id are left out; ids are whole numbers. An empty table has no
nodes. Columns beyond those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.ranges import positions
from nearfield.plans.staging import Stage, lookup

WINDOW = 16
SHARD_ROWS = 10_000
# Ids of ending conversations that travel as one value.
CHUNK_IDS = 500
# A conversation's donor is the one whose id is the next lower multiple of this.
DONOR_STEP = 20

NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
_START = ["w", "s_hi", "s_lo"]
_KEY = ["k_hi", "k_lo"]
_PAD = -1


# --- sequences ------------------------------------------------------------------------


def number_turns(
    stage: Stage,
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """Rows (conv, pos, n, hi, lo, words): turn ``pos`` of ``n``, its id and its text's words."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_column, text_column))
    turn_id = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.select(
        F.col(f"`{id_column}`").cast("bigint").alias("conv"),
        F.col(f"`{turn_column}`").alias("turn"),
        turn_id.alias("hash"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    ).filter(F.col("conv").isNotNull())
    digits = lambda a: F.conv(F.substring("hash", a, 15), 16, 10).cast("bigint")
    rows = rows.select("conv", "turn", digits(1).alias("hi"), digits(16).alias("lo"), "words", "row")
    rows = stage.save(rows, "turns")
    placed, _ = positions(stage, "turns", rows, "conv", ["turn", "hi", "lo", "row"])
    return stage.save(placed.select("conv", "pos", "n", "hi", "lo", "words"), "numbered")


def plain_sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as they are, (conv, p, size, hi, lo, words), and conversations without turns: none."""
    rows = turns.select("conv", F.col("pos").alias("p"), F.col("n").alias("size"), "hi", "lo", "words")
    return rows, turns.filter(F.lit(False)).select("conv")


def grafted_sequences(stage: Stage, turns: DataFrame, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first ``taken`` turns (at most 3) of their donor, followed by
    their own turns after as many; also the ids of conversations that are left without turns.

    ``taken`` is an expression of the id ``conv``. A donor that is absent gives nothing, a short one all it has.
    """
    convs = turns.filter("pos = 0").select("conv", "n", taken.cast("bigint").alias("h"))
    convs = convs.withColumn("donor", F.expr(f"conv - conv % {DONOR_STEP}"))
    donors = convs.filter("donor = conv").select("donor", F.col("n").alias("donor_n"))
    base = F.least("h", F.coalesce("donor_n", F.lit(0)))
    own = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = convs.join(donors, "donor", "left").withColumn("base", base).withColumn("size", base + own)
    convs, facts = stage.save_with(
        convs.select("conv", "n", "h", "donor", "base", "size"), "conversations",
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("turns"),
    )
    columns = ["hi", "lo", "words"]
    # A conversation may hold most turns, so its row goes to them and not the other way round.
    table = convs.select("conv", "n", "h", "base", "size")
    found = lookup(turns.drop("n"), table, ["conv"], "n", facts["turns"] or 0, facts["rows"])
    kept = found.filter("pos >= h").select("conv", F.expr("base + pos - h").alias("p"), "size", *columns)
    heads = turns.filter(f"pos < 3 and conv % {DONOR_STEP} = 0").select(
        F.col("conv").alias("donor"), F.col("pos").alias("p"), *columns
    )
    given = convs.filter("h > 0").select("conv", "h", "donor", "size").join(heads, "donor").filter("p < h")
    return kept.unionByName(given.select(*kept.columns)), convs.filter("size = 0").select("conv")


def _next_start(hi: int, lo: int, ids: np.ndarray) -> tuple[int, int]:
    """The digest of everything before the next window, from this window's and its turn ids."""
    raw = hashlib.sha256(np.array([hi, lo], dtype="<i8").tobytes() + ids.astype("<i8").tobytes()).digest()
    a, b = np.frombuffer(raw[:16], dtype="<u8") >> np.uint64(4)
    return int(a), int(b)


def _flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Turn ids (2, all) of a list column, and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    first = column.offsets.to_numpy()
    flat = column.values.slice(first[0], first[-1] - first[0])
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo")]), first - first[0]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of conversation and number, with the digest of all before them."""
    conv, start = None, (0, 0)
    for batch in batches:
        ids, first = _flat_ids(batch.column("ids"))
        found = []
        for i, c in enumerate(batch.column("conv").to_pylist()):
            if c != conv:
                conv, start = c, (0, 0)
            found.append(start)
            start = _next_start(*start, ids[:, first[i] : first[i + 1]])
        hi, lo = np.array(found, dtype=np.int64).reshape(-1, 2).T
        columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"s_hi": pa.array(hi), "s_lo": pa.array(lo)}
        yield pa.RecordBatch.from_pydict(columns)


def _windows(stage: Stage, rows: DataFrame, without: DataFrame, window: int) -> tuple[DataFrame, dict]:
    """A row for each conversation and window: (w, s_hi, s_lo, ids, words, conv, size)."""
    turn = F.struct("p", "hi", "lo", "words")
    rows = rows.withColumn("w", F.expr(f"p div {window}")).groupBy("conv", "w")
    rows = rows.agg(F.array_sort(F.collect_list(turn)).alias("t"), F.max("size").alias("size"))
    zero = F.lit(0).cast("bigint")
    rows = rows.select(
        "w", zero.alias("s_hi"), zero.alias("s_lo"),
        F.transform("t", lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"))).alias("ids"),
        F.transform("t", lambda t: t["words"]).alias("words"), "conv", "size",
    )
    bare = without.select(
        zero.alias("w"), zero.alias("s_hi"), zero.alias("s_lo"),
        F.array().cast(rows.schema["ids"].dataType).alias("ids"),
        F.array().cast("array<bigint>").alias("words"), "conv", zero.alias("size"),
    )
    count, most = F.count(F.lit(1)).alias("rows"), F.max("size").alias("most")
    rows, facts = stage.save_with(rows.unionByName(bare), "windows", count, most)
    if (facts["most"] or 0) <= window:
        return rows, facts
    long = rows.filter(F.col("size") > window).repartition("conv").sortWithinPartitions("conv", "w")
    long = long.mapInArrow(_chained, rows.schema)
    return stage.save(rows.filter(F.col("size") <= window).unionByName(long), "chained"), facts


# --- one shard, in numpy --------------------------------------------------------------


class Shard:
    """A shard's rows in order, with the starts of the nodes of every depth of its windows."""

    def __init__(self, table: pa.Table, window: int):
        column = lambda c: table.column(c).to_numpy()
        ids, first = _flat_ids(table.column("ids"))
        counts = np.diff(first)
        n, width = len(counts), int(counts.max(initial=0))
        row = np.repeat(np.arange(n), counts)
        at = np.arange(first[-1]) - first[row]
        matrix = np.full((3, width, n), _PAD, dtype=np.int64)
        words = table.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        matrix[0][at, row], matrix[1][at, row], matrix[2][at, row] = ids[0], ids[1], words
        lead = [column(c) for c in _START]
        keys = [column("conv")]
        for d in range(width - 1, -1, -1):
            keys += [matrix[1][d], matrix[0][d]]
        order = np.lexsort([*keys, *lead[::-1]])
        self.n, self.width, self.window = n, width, window
        self.hi, self.lo, self.words = matrix[0][:, order], matrix[1][:, order], matrix[2][:, order]
        self.w, self.s_hi, self.s_lo = (c[order] for c in lead)
        self.conv, self.size, self.counts = column("conv")[order], column("size")[order], counts[order]
        self.leaves, self.saved = column("more_leaves")[order].copy(), column("more_saved")[order].copy()
        self.above = None
        if "above" in table.column_names:
            self.above = pc.fill_null(table.column("above"), 0).to_numpy()[order]
        self._mark(lead=(self.w, self.s_hi, self.s_lo))
        self._sum()

    def _mark(self, lead) -> None:
        change = np.ones(self.n, dtype=bool)
        differs = lambda c: c[1:] != c[:-1]
        change[1:] = np.logical_or.reduce([differs(c) for c in lead])
        masks = [change]
        for d in range(self.width):
            change = change.copy()
            change[1:] |= differs(self.hi[d]) | differs(self.lo[d])
            masks.append(change)
        # Rows that end before a depth are segments too, but no nodes of it.
        self.starts = [np.flatnonzero(m) for m in masks]
        self.is_node = [self.counts[s] >= d for d, s in enumerate(self.starts)]

    def _sum(self) -> None:
        """Aggregates by depth and segment; boundary nodes count nothing of their own."""
        self.depths = [{} for _ in self.starts]
        below = np.zeros(self.n, dtype=np.int64)  # starts of inner nodes one level deeper
        for d in range(self.width, -1, -1):
            s, node, out = self.starts[d], self.is_node[d], self.depths[d]
            depth = self.w[s] * self.window + d
            out["n"] = np.diff(np.append(s, self.n))
            out["least"] = np.minimum.reduceat(self.conv, s)
            out["longer"] = np.maximum.reduceat(self.size, s) > depth
            out["ends"] = np.add.reduceat(self.size == np.repeat(depth, out["n"]), s, dtype=np.int64)
            out["words"] = self.words[d - 1][s] if d else np.zeros(len(s), dtype=np.int64)
            out["depth"] = depth
            out["children"] = np.add.reduceat(below, s)
            edge = np.zeros(len(s), dtype=bool)
            edge[[0, -1]] = True
            out["edge"] = edge & node
            # Beginnings of later windows are the same node as the last window's end.
            inner = node & ~edge & ~((depth > 0) & (d == 0))
            out["leaf"], out["own"] = inner & ~out["longer"], np.where(inner, (out["n"] - 1) * out["words"], 0)
            self.leaves[s] += out["leaf"]
            self.saved[s] += out["own"]
            out["leaves"], out["saved"] = np.add.reduceat(self.leaves, s), np.add.reduceat(self.saved, s)
            below = np.zeros(self.n, dtype=np.int64)
            below[s[node & ~edge]] = 1

    def segment(self, d: int, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts[d], row, side="right") - 1

    def path(self, row: int, depth: int) -> list[tuple[int, int]]:
        """Keys of the node at ``depth`` and those above it in its window, from depth 0 on."""
        start = np.array([self.w[row], self.s_hi[row], self.s_lo[row]])
        keys = []
        for d in range(depth + 1):
            raw = start.astype("<i8").tobytes() + np.stack([self.hi[:d, row], self.lo[:d, row]]).astype("<i8").tobytes()
            digest = hashlib.sha256(raw).digest()
            keys.append(tuple(int(x) >> 4 for x in np.frombuffer(digest[:16], dtype="<u8")))
        return keys

    def ids_ending(self, d: int, i: int) -> np.ndarray:
        """The ids of members that end in segment ``i``, ascending."""
        found = self.depths[d]
        if not found["ends"][i]:
            return self.conv[:0]
        rows = slice(self.starts[d][i], self.starts[d][i] + found["n"][i])
        return self.conv[rows][self.size[rows] == found["depth"][i]]

    def next_start(self, d: int, i: int) -> tuple[int, int]:
        row = self.starts[d][i]
        return _next_start(self.s_hi[row], self.s_lo[row], np.stack([self.hi[:d, row], self.lo[:d, row]]))


_BOUNDARY = (
    "shard int, side int, k_hi bigint, k_lo bigint, p_hi bigint, p_lo bigint, w bigint, d bigint, n bigint, "
    "least bigint, longer boolean, words bigint, children bigint, leaves bigint, saved bigint, "
    "path array<struct<hi:bigint,lo:bigint>>, ends array<binary>"
)


def _boundary(window: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        shard, rows = Shard(table, window), []
        number = table.column("shard")[0].as_py()
        for d, found in enumerate(shard.depths):
            for i in np.flatnonzero(found["edge"]):
                start = shard.starts[d][i]
                path = shard.path(start, d)
                ids = shard.ids_ending(d, i).tolist()
                rows.append(
                    {
                        "shard": number,
                        "side": 0 if i == 0 else 1,
                        "k_hi": path[-1][0],
                        "k_lo": path[-1][1],
                        "p_hi": path[-2][0] if d else None,
                        "p_lo": path[-2][1] if d else None,
                        "w": int(shard.w[start]),
                        "d": d,
                        **{c: found[c][i].item() for c in ("n", "least", "longer", "words", "children", "leaves", "saved")},
                        "path": [{"hi": a, "lo": b} for a, b in path],
                        "ends": [_joined(ids[j : j + CHUNK_IDS]) for j in range(0, len(ids), CHUNK_IDS)],
                    }
                )
        return pa.Table.from_pylist(rows, schema=_boundary_schema())

    return run


def _boundary_schema() -> pa.Schema:
    pair = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])
    kinds = {"shard": pa.int32(), "side": pa.int32(), "longer": pa.bool_(), "path": pa.list_(pair), "ends": pa.list_(pa.binary())}
    names = [part.split()[0] for part in _BOUNDARY.split(", ")]
    return pa.schema([(n, kinds.get(n, pa.int64())) for n in names])


def _joined(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def _streamed_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of key and place to one hash for each key."""
    key, state = None, None

    def result(key, state):
        return pa.RecordBatch.from_pylist([{"k_hi": key[0], "k_lo": key[1], "hash": state.hexdigest()}])

    for batch in batches:
        for row in batch.to_pylist():
            now = (row["k_hi"], row["k_lo"])
            if now != key:
                if key is not None:
                    yield result(key, state)
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(row["chunk"])
    if key is not None:
        yield result(key, state)


_RESULT = NODES + ", w bigint, d bigint, s_hi bigint, s_lo bigint, t_hi bigint, t_lo bigint, own_leaf bigint, own_saved bigint"


def _nodes(window: int) -> Callable:
    """All nodes that end in the shard, and boundary nodes that are the shard's to return."""

    def run(table: pa.Table, totals: pa.Table) -> pa.Table:
        shard, rows = Shard(table, window), []
        known = {(t["d"], t["side"]): t for t in totals.to_pylist()}
        least = []
        for d, found in enumerate(shard.depths):
            for i in np.flatnonzero(found["edge"]):
                found["least"][i] = known[d, 0 if i == 0 else 1]["least"]
            least.append(found["least"])
            nodes = np.flatnonzero(shard.is_node[d] & ~((found["depth"] > 0) & (d == 0)))
            parents = shard.segment(d - 1, shard.starts[d][nodes]) if d else None
            for j, i in enumerate(nodes.tolist()):
                total = known[d, 0 if i == 0 else 1] if found["edge"][i] else None
                if total is not None and not total["first"]:
                    continue
                start = shard.starts[d][i]
                get = lambda c, total=total, found=found, i=i: total[c] if total else found[c][i].item()
                longer = get("longer")
                parent = None
                if d == 1 and shard.w[start] > 0:
                    parent = int(shard.above[start]) if shard.above is not None else None
                elif d:
                    parent = int(least[d - 1][parents[j]])
                last = d == window and longer
                after = shard.next_start(d, i) if last else (None, None)
                ends = total["hash"] if total else hashlib.sha256(_joined(shard.ids_ending(d, i).tolist())).hexdigest()
                rows.append(
                    {
                        "conv_id": int(least[d][i]),
                        "depth": int(found["depth"][i]),
                        "parent_conv_id": parent,
                        "n_convs": get("n"),
                        "n_children": get("children"),
                        "n_leaves": get("leaves"),
                        "saved_tokens": get("saved"),
                        "ends_sha256": ends,
                        "w": int(shard.w[start]),
                        "d": d,
                        "s_hi": int(shard.s_hi[start]),
                        "s_lo": int(shard.s_lo[start]),
                        "t_hi": after[0],
                        "t_lo": after[1],
                        "own_leaf": int(not longer),
                        "own_saved": (get("n") - 1) * get("words"),
                    }
                )
        names = [part.split()[0] for part in _RESULT.split(", ")]
        schema = pa.schema([(n, pa.string() if n == "ends_sha256" else pa.int64()) for n in names])
        return pa.Table.from_pylist(rows, schema=schema)

    return run


# --- the trie on Spark ----------------------------------------------------------------


def _pass(stage: Stage, name: str, rows: DataFrame, count: int, window: int, shard_rows: int) -> DataFrame:
    """All nodes of windows (w, s_hi, s_lo, ids, words, conv, size, more_leaves, more_saved[, above])."""
    shards = max(1, -(-count // shard_rows))
    rows = rows.repartitionByRange(shards, *_START, "ids", "conv").withColumn("shard", F.spark_partition_id())
    rows = stage.save(rows, f"{name}-shards")
    parts = stage.save(rows.groupBy("shard").applyInArrow(_boundary(window), _BOUNDARY), f"{name}-parts")
    whole = parts.groupBy(*_KEY).agg(
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        F.min("least").alias("least"),
        F.max("longer").alias("longer"),
        *[F.max(c).alias(c) for c in ("words", "w", "d", "p_hi", "p_lo")],
        F.min("shard").alias("owner"),
        F.min("path").alias("path"),
    )
    whole = stage.save(whole, f"{name}-whole")
    # The beginning of a later window is the node at the end of the one before, which counts itself.
    real = (F.col("w") == 0) | (F.col("d") > 0)
    below = whole.filter(real).select(
        F.explode("path").alias("up"),
        F.when(F.col("longer"), 0).otherwise(1).alias("own_leaf"),
        ((F.col("n") - 1) * F.col("words")).alias("own_saved"),
    )
    below = below.groupBy(F.col("up.hi").alias("k_hi"), F.col("up.lo").alias("k_lo")).agg(
        F.sum("own_leaf").alias("more_l"), F.sum("own_saved").alias("more_s")
    )
    kids = whole.filter("d > 0").groupBy(F.col("p_hi").alias("k_hi"), F.col("p_lo").alias("k_lo"))
    kids = kids.agg(F.count(F.lit(1)).alias("more_c"))
    chunks = parts.select(*_KEY, "shard", F.posexplode("ends").alias("i", "chunk"))
    chunks = chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "shard", "i")
    hashes = chunks.mapInArrow(_streamed_hash, "k_hi bigint, k_lo bigint, hash string")
    whole = whole.join(below, _KEY, "left").join(kids, _KEY, "left").join(hashes, _KEY, "left")
    add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    whole = whole.select(
        *_KEY, "n", "least", "longer", "words", "owner", add("children", "more_c"), add("leaves", "more_l"),
        add("saved", "more_s"), F.coalesce("hash", F.lit(hashlib.sha256().hexdigest())).alias("hash"),
    )
    totals = parts.select("shard", "side", "d", *_KEY).join(whole, _KEY)
    totals = totals.withColumn("first", F.col("shard") == F.col("owner")).drop("owner", *_KEY)
    totals = stage.save(totals, f"{name}-totals")
    met = rows.groupBy("shard").cogroup(totals.groupBy("shard"))
    return met.applyInArrow(_nodes(window), _RESULT)


def prefix_trie(
    stage: Stage, sequences: DataFrame, without: DataFrame, *, window: int | None = None, shard_rows: int | None = None
) -> DataFrame:
    """All nodes of the trie over ``sequences`` (conv, p, size, hi, lo, words) and the ids ``without`` turns.

    Columns: conv_id (the smallest member), depth, parent_conv_id (the parent's), n_convs (members),
    n_children, n_leaves and saved_tokens (over the subtree: words of a node's last text, times its members but
    one), ends_sha256 (over the ids of the members that end here, ascending, a comma between).
    """
    window, shard_rows = window or WINDOW, shard_rows or SHARD_ROWS
    rows, facts = _windows(stage, sequences, without, window)
    zero = F.lit(0).cast("bigint")
    count, names = facts["rows"], [part.split()[0] for part in NODES.split(", ")]
    plain = rows.withColumns({"more_leaves": zero, "more_saved": zero})
    if (facts["most"] or 0) <= window:
        return _pass(stage, "trie", plain, count, window, shard_rows).select(names)

    first = stage.save(_pass(stage, "first", plain, count, window, shard_rows), "first-nodes")
    later = rows.filter("w > 0")
    # What each later window's beginning has below it inside the window, noted at its smallest member.
    sums = first.filter("w > 0").groupBy(*_START).agg(F.sum("own_leaf").alias("l"), F.sum("own_saved").alias("v"))
    least = later.groupBy(*_START).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("rows"))
    noted = least.join(sums, _START).select("conv", "w", "l", "v")
    long = rows.filter(F.col("size") > window).join(noted, ["conv", "w"], "left")
    after = Window.partitionBy("conv").orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    carried = long.withColumns(
        {"more_leaves": F.coalesce(F.sum("l").over(after), zero), "more_saved": F.coalesce(F.sum("v").over(after), zero)}
    ).drop("l", "v")
    carried = stage.save(plain.filter(F.col("size") <= window).unionByName(carried), "carried")
    # The node at the end of the window before, by the digest of all before: its smallest member.
    ends = first.filter(F.col("t_hi").isNotNull()).select(
        (F.col("w") + 1).alias("w"), F.col("t_hi").alias("s_hi"), F.col("t_lo").alias("s_lo"), F.col("conv_id").alias("above")
    )
    ends, known = stage.save_with(ends.join(least.drop("conv"), _START), "ends", F.count(F.lit(1)).alias("n"))
    placed = lookup(carried.filter("w > 0"), ends, _START, "rows", count, known["n"]).drop("rows")
    none = F.lit(None).cast("bigint").alias("above")
    ready = carried.filter("w = 0").select("*", none).unionByName(placed)
    nodes = stage.save(_pass(stage, "second", ready, count, window, shard_rows), "second-nodes")
    kids = nodes.filter("w > 0 and d = 1").groupBy(*_START).agg(F.count(F.lit(1)).alias("kids"))
    kids = kids.select((F.col("w") - 1).alias("w"), F.col("s_hi").alias("t_hi"), F.col("s_lo").alias("t_lo"), "kids")
    ending = nodes.filter(F.col("t_hi").isNotNull()).join(kids, ["w", "t_hi", "t_lo"])
    ending = ending.withColumn("n_children", F.col("kids")).select(names)
    return nodes.filter(F.col("t_hi").isNull()).select(names).unionByName(ending)


def conversation_trie(
    conversations: DataFrame, taken: Column | None = None, *, window: int | None = None, shard_rows: int | None = None
) -> DataFrame:
    """The trie of all conversations; with ``taken``, an expression of ``conv``, of grafted ones."""
    stage = Stage(conversations.sparkSession)
    turns = number_turns(stage, conversations)
    rows, without = plain_sequences(turns) if taken is None else grafted_sequences(stage, turns, taken)
    return prefix_trie(stage, rows, without, window=window, shard_rows=shard_rows)
