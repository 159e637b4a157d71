"""Merkle manifest of a dataset by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.session import cut_lineage

ARITY = 16
# A sweep settles this many levels of the trees in one task per block.
LEVELS = 2
BLOCK = ARITY**LEVELS
NODES = "tree string, level int, idx long, n long, top boolean, kids binary, digest binary"
PATHS = "tree string, idx long, shape binary, siblings binary, subroot binary, root binary"


def framed(columns: list[Column]) -> Column:
    """The columns as one text that no other values give: ``-`` if null, else byte count, ``:``, value."""
    text = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in text])


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of a row, as 32 bytes."""
    return F.unhex(F.sha2(framed(columns), 256))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and the siblings on its path lead to, as hex."""
    return F.aggregate(path, leaf, lambda acc, step: F.sha2(F.concat(step["before"], acc, step["after"]), 256))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with idx (from 0, dense, by ``order`` within the tree) and n, the tree's number of rows.

    The whole table is range-sorted by tree and order, so a tree may span any number of tasks. Only
    the sizes per task and tree are added up.
    """
    by = [tree, *order]
    in_order = cut_lineage(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    )
    in_order = in_order.withColumn("_part", F.shiftright("_at", 33))
    sizes = in_order.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    parts = Window.partitionBy(tree)
    sizes = sizes.select(
        tree,
        "_part",
        (F.sum("_size").over(parts.orderBy("_part")) - F.col("_size") - F.col("_first")).alias("_shift"),
        F.sum("_size").over(parts).alias("n"),
    )
    placed = in_order.join(sizes, [tree, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift"))
    return placed.drop("_at", "_part", "_shift")


def _digest(kids: list[bytes]) -> bytes:
    return hashlib.sha256("".join(k.hex() for k in kids).encode()).digest()


def _width(n: int, level: int) -> int:
    """How many nodes a tree of ``n`` leaves has on a level."""
    return -(-n // ARITY**level)


def _end(idx: int, level: int, n: int) -> int:
    """The last leaf under a node. (end, level) is the node's label: children come before parents."""
    return min((idx + 1) * ARITY**level, n) - 1


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner nodes of blocks whose leaves come in the order of their labels.

    Each node sends its digest to its parent: a message under the parent's label in the queue. A node is
    due once all messages with a smaller label are; it then finds those of its children on top.
    """
    out: list[tuple] = []
    queue: list[tuple] = []
    now: tuple | None = None

    def send(tree: str, idx: int, level: int, n: int, digest: bytes) -> None:
        up = idx // ARITY
        heapq.heappush(queue, (_end(up, level + 1, n), level + 1, up, idx % ARITY, digest, n, tree))

    def settle(till: int | None) -> None:
        while queue and (till is None or queue[0][0] < till):
            end, level, idx, _, _, n, tree = queue[0]
            kids = []
            while queue and queue[0][:2] == (end, level):
                kids.append(heapq.heappop(queue)[4])
            digest = _digest(kids)
            top = level == LEVELS or _width(n, level) == 1
            out.append((tree, level, idx, n, top, b"".join(kids), digest))
            if not top:
                send(tree, idx, level, n, digest)

    def ready() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), _NODE_TYPES)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, _NODE_NAMES)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("tree", "idx", "n", "digest")]
        for tree, idx, n, digest in zip(*columns):
            block = (tree, idx // BLOCK)
            if block != now:
                settle(None)
                now = block
            settle(idx)
            send(tree, idx, 0, n, digest)
        if out:
            yield ready()
    settle(None)
    if out:
        yield ready()


_NODE_NAMES = [c.split()[0] for c in NODES.split(", ")]
_NODE_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]


def _in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """Whole blocks to a task; the shuffle and its sort are the external part of the queue."""
    dealt = rows.withColumn("block", F.expr(f"{'`end`' if 'end' in rows.columns else 'idx'} div {BLOCK}"))
    return dealt.repartition("tree", "block").sortWithinPartitions("tree", *order)


def grow(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(inner nodes per sweep, roots) of the trees over ``leaves`` (tree, idx, n, digest).

    A sweep takes LEVELS levels; its blocks' top nodes are the leaves of the next one, until each tree
    has one node left.
    """
    sweeps = []
    roots = leaves.filter("n = 1").select("tree", "digest")
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        dealt = _in_order(leaves.filter("n > 1").select("tree", "idx", "n", "digest"), F.col("idx"))
        nodes = cut_lineage(dealt.mapInArrow(_up, NODES))
        sweeps.append(nodes)
        width = F.ceil(F.col("n") / F.pow(F.lit(float(ARITY)), F.col("level"))).cast("long")
        leaves = nodes.filter("top").select("tree", "idx", width.alias("n"), "digest")
        roots = roots.unionByName(leaves.filter("n = 1").select("tree", "digest"))
        most = _width(most, LEVELS)
    return sweeps, roots


def _below(kids: bytes, slot: int, shape: bytes, siblings: bytes) -> tuple[bytes, bytes]:
    """The path of a child: its place and number of siblings, then those of its parent."""
    at = 32 * slot
    return bytes([slot, len(kids) // 32 - 1]) + shape, kids[:at] + kids[at + 32 :] + siblings


def _down(batches: Iterator[pa.RecordBatch], leaves: bool) -> Iterator[pa.RecordBatch]:
    """The sweep of _up in reverse: every node passes its path to its children, parents come first.

    With ``leaves`` the paths are handed to leaf rows, else they are the result.
    """
    queue: list[tuple] = []

    def receive(end: int, level: int) -> tuple:
        label, *_, path = heapq.heappop(queue)
        if label != (-end, -level):
            raise RuntimeError("a node without its message")
        return path

    names = ["tree", "end", "level", "kind", "idx", "n", "kids", "shape", "siblings", "subroot", "root"]
    for batch in batches:
        given, paths, below = [], [], []
        for row, (tree, end, level, kind, idx, n, kids, shape, siblings, subroot, root) in enumerate(
            zip(*[batch.column(c).to_pylist() for c in names])
        ):
            if kind == 0:
                heapq.heappush(queue, ((-end, -level), (shape, siblings, subroot, root)))
            elif kind == 2:
                given.append(row)
                paths.append(receive(end, 0))
            else:
                shape, siblings, subroot, root = receive(end, level)
                for slot in range(len(kids) // 32):
                    child = idx * ARITY + slot
                    path = (*_below(kids, slot, shape, siblings), subroot, root)
                    if level > 1 or leaves:
                        heapq.heappush(queue, ((-_end(child, level - 1, n), 1 - level), path))
                    else:
                        below.append((tree, child, *path))
        if given:
            yield _proofs(batch.take(pa.array(given)).select(["carry", "leaf"]), paths)
        if below:
            types = [pa.string(), pa.int64(), *[pa.binary()] * 4]
            columns = [pa.array(c, t) for c, t in zip(zip(*below), types)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PATHS.split(", ")])


def _proofs(rows: pa.RecordBatch, paths: list[tuple]) -> pa.RecordBatch:
    """Leaf rows with the digests above them and the siblings on their paths, as hex."""
    before, after, ends = [], [], [0]
    for shape, siblings, _, _ in paths:
        text, at = siblings.hex(), 0
        for slot, more in zip(shape[::2], shape[1::2]):
            before.append(text[at : at + 64 * slot])
            after.append(text[at + 64 * slot : at + 64 * more])
            at += 64 * more
        ends.append(len(before))
    steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
    tops = [pa.array([p[i].hex() for p in paths], pa.string()) for i in (2, 3)]
    leaf = pa.array([d.hex() for d in rows.column("leaf").to_pylist()], pa.string())
    path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
    return pa.RecordBatch.from_arrays([rows.column("carry"), leaf, *tops, path], ["carry", "leaf", "subroot", "root", "path"])


EMPTY = ["kids binary", "shape binary", "siblings binary", "subroot binary", "root binary"]


def _rows(df: DataFrame, kind: int, level: Column) -> DataFrame:
    """Rows for a sweep down: kind 0 brings a path from above, 1 is an inner node, 2 a leaf."""
    last = F.least((F.col("idx") + 1) * F.pow(F.lit(ARITY), level).cast("long"), F.col("n")) - 1
    out = df.withColumns({"level": level.cast("int"), "kind": F.lit(kind), "end": last})
    for name, type_ in (c.split() for c in EMPTY):
        if name not in df.columns:
            out = out.withColumn(name, F.lit(None).cast(type_))
    keep = [c for c in ("carry", "leaf") if c in df.columns]
    return out.select("tree", "end", "level", "kind", "idx", "n", *[c.split()[0] for c in EMPTY], *keep)


def deliver(sweeps: list[DataFrame], tops: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Paths from the root down to all leaves of the trees that ``sweeps`` built.

    ``tops`` (PATHS without idx) has the path above each tree's root. The result is PATHS for the leaves
    of the first sweep, or if ``leaves`` (tree, idx, n, leaf, carry) are given, these with their proofs. Trees
    of one leaf are not in it.
    """
    inner = None
    for i in reversed(range(len(sweeps))):
        nodes = sweeps[i]
        highest = nodes.filter("top").select("tree", "idx", "n", "level")
        single = F.col("n") <= F.pow(F.lit(ARITY), F.col("level"))
        incoming = highest.filter(single).join(tops, "tree")
        if inner is not None:
            incoming = incoming.unionByName(highest.filter(~single).join(inner, ["tree", "idx"]))
        rows = _rows(incoming, 0, F.col("level")).unionByName(_rows(nodes, 1, F.col("level")))
        order = (F.desc("end"), F.desc("level"), F.asc("kind"))
        if i == 0 and leaves is not None:
            rows = rows.unionByName(_rows(leaves.filter("n > 1"), 2, F.lit(0)), allowMissingColumns=True)
            carry = leaves.schema["carry"].dataType.simpleString()
            return _in_order(rows, *order).mapInArrow(lambda b: _down(b, True), _proof_schema(carry))
        inner = _in_order(rows, *order).mapInArrow(lambda b: _down(b, False), PATHS)
        inner = cut_lineage(inner)
    return inner


def _proof_schema(carry: str) -> str:
    return f"carry {carry}, leaf string, subroot string, root string, path array<struct<before: string, after: string>>"


def merkle_proofs(rows: DataFrame, tree: Column, leaf: Column, order: list[Column], keep: dict[str, Column]) -> DataFrame:
    """``keep`` columns, leaf, subroot, root (hex) and path, for every row.

    Rows with the same ``tree`` (text or null) form a tree over their ``leaf`` digests, in the given order,
    nulls first, equal ones by digest; runs of 16 nodes become one until one is left. The trees' roots, by
    ``tree`` (null first, bytewise), form the tree that gives root. path: for each level from the leaf up,
    the siblings before and after it, as hex; fold() leads from leaf and path to root.

    Only digests are sorted and exchanged, never texts. A path has 15 siblings a level at most, and a task
    holds the paths of the nodes that are still to be met in one block. Repeated rows are leaves of their own.
    An empty table gives an empty result.
    """
    names = [f"_o{i}" for i in range(len(order))]
    base = rows.select(
        # The letter in front keeps the order and tells a null source, which comes first, from an empty one.
        F.coalesce(F.concat(F.lit("s"), tree.cast("string")), F.lit("")).alias("tree"),
        leaf.alias("leaf"),
        F.struct(*[c.alias(n) for n, c in keep.items()]).alias("carry"),
        *[c.alias(n) for n, c in zip(names, order)],
    )
    leaves = cut_lineage(numbered(cut_lineage(base), "tree", [*names, "leaf"]).drop(*names))
    sweeps, roots = grow(leaves.withColumnRenamed("leaf", "digest"))

    # The roots, in order, are the leaves of one more tree.
    subroots = numbered(cut_lineage(roots).withColumnsRenamed({"tree": "name"}).withColumn("tree", F.lit("")), "tree", ["name"])
    subroots = cut_lineage(subroots)
    upper, whole = grow(subroots)
    top = whole.first()
    nothing = F.lit(b"")
    root = F.lit(bytes(top["digest"]) if top else b"")
    above = subroots.filter("n = 1").select("name", nothing.alias("shape"), nothing.alias("siblings"), F.col("digest").alias("subroot"))
    if upper:
        start = whole.select("tree", nothing.alias("shape"), nothing.alias("siblings"), nothing.alias("subroot"), nothing.alias("root"))
        reached = deliver(upper, start).drop("subroot", "root", "tree").join(subroots.select("idx", "name", "digest"), "idx")
        above = above.unionByName(reached.select("name", "shape", "siblings", F.col("digest").alias("subroot")))
    above = cut_lineage(above.withColumnRenamed("name", "tree").withColumn("root", root))

    # Trees of one leaf are their own root.
    alone = _rows(leaves.filter("n = 1").join(above, "tree"), 2, F.lit(0))

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = list(zip(*[batch.column(c).to_pylist() for c in ("shape", "siblings", "subroot", "root")]))
            yield _proofs(batch.select(["carry", "leaf"]), paths)

    found = alone.mapInArrow(lone, _proof_schema(leaves.schema["carry"].dataType.simpleString()))
    if sweeps:
        found = found.unionByName(deliver(sweeps, above, leaves))
    return found.select("carry.*", "leaf", "subroot", "root", "path")
