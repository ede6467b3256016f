"""Merkle manifest of a table: a tree of sixteen children over each source, one over the sources, and every row's witness."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import Scratch

ARITY = 16
#: Levels that one task builds: a block is 16^3 consecutive nodes, aligned, so its root is a node of the whole tree.
DEPTH = 3
BLOCK = ARITY**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<left: string, right: string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


class Witness:
    """What lies left and right of one node on its way up, level by level."""

    __slots__ = ("levels",)

    def __init__(self) -> None:
        self.levels: list[tuple[str, str]] = []

    def extend(self, left: str, right: str) -> None:
        self.levels.append((left, right))


class Proof:
    """A witness of which only the hash of its siblings is kept, and the node that a presented leaf leads to."""

    __slots__ = ("node", "siblings")

    def __init__(self, presented: str) -> None:
        self.siblings, self.node = hashlib.sha256(), presented

    def extend(self, left: str, right: str) -> None:
        self.siblings.update((left + right).encode("ascii"))
        self.node = digest(left, self.node, right)


class Appender:
    """A tree that grows by appending: open subtrees hold the partial witnesses of what is below them.

    A node joins the open run of its level. When the sixteenth sibling is
    there, the run completes: each member's witnesses are extended by the
    members beside it, and the parent is appended one level up. ``finish``
    completes what is still open, up to ``levels``.
    """

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[str, list]]] = [[] for _ in range(levels + 1)]

    def append(self, node: str, witnesses: list, level: int = 0) -> None:
        run = self.open[level]
        run.append((node, witnesses))
        if level < self.levels and len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run = self.open[level]
        self.open[level] = []
        nodes = [node for node, _ in run]
        below = []
        for i, (_, witnesses) in enumerate(run):
            left, right = "".join(nodes[:i]), "".join(nodes[i + 1 :])
            for w in witnesses:
                w.extend(left, right)
            below += witnesses
        self.append(digest(*nodes), below, level + 1)

    def finish(self) -> str:
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        ((root, _),) = self.open[self.levels]
        return root


def leaf_of(fields: Sequence[Column]) -> Column:
    """H of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    plain = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in plain]), 256)


def height(count: Column) -> Column:
    """How often runs of sixteen become one node until a single one is left."""
    return sum(((count > F.lit(ARITY**k)).cast("int") for k in range(15)), F.lit(0))


def placed(rows: DataFrame, scratch: Scratch, order: Sequence[str]) -> DataFrame:
    """Adds ``pos`` (0, 1, ... by ``order`` inside ``key``) and ``levels``, the height of the key's tree; written.

    Rows are dealt by ranges of key and order, so a key of any size is spread;
    a row's place is its place in its range and how many the ranges before it hold.
    """
    ranged = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    held = scratch.table(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")))
    parts = held.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("key", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy("key")).alias("total"))
    pos = (F.col("seq") - F.col("first") + F.col("ahead")).alias("pos")
    return held.join(offsets, ["key", "part"]).select(*rows.columns, pos, height(F.col("total")).alias("levels"))


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def grow(nodes: DataFrame) -> DataFrame:
    """The roots of the blocks of ``nodes`` (key, pos, node, levels), as nodes of the level where they are."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("node", T.StringType()), T.StructField("levels", T.IntegerType())])
    arrow = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("node", pa.string()), ("levels", pa.int32())])

    def root(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        levels = table["levels"][0].as_py()
        tree = Appender(min(DEPTH, levels))
        for node in table["node"].to_pylist():
            tree.append(node, [])
        row = {"key": table["key"][0].as_py(), "pos": table["pos"][0].as_py() // BLOCK, "node": tree.finish(), "levels": levels - DEPTH}
        return pa.Table.from_pylist([row], arrow)

    block = F.floor(F.col("pos") / BLOCK).alias("block")
    return nodes.filter("levels > 0").select("key", "pos", "node", "levels", block).groupBy("key", "block").applyInArrow(root, schema)


def stages(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """``nodes`` and the tables of block roots above them, until every key has one node. Each is a 4096th of the one below."""
    out = [nodes]
    while not out[-1].filter("levels > 0").isEmpty():
        out.append(scratch.table(grow(out[-1])))
    return out


def attach(nodes: DataFrame, above: DataFrame, make: Callable, emit: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """Witnesses of nodes inside their blocks, extended by their block's own witness from ``above`` (key, pos, subroot, siblings)."""

    def work(table: pa.Table, upper: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], arrow)
        rows = _ordered(table).to_pylist()
        tree, witnesses = Appender(min(DEPTH, rows[0]["levels"])), [make(r) for r in rows]
        for row, witness in zip(rows, witnesses, strict=True):
            tree.append(row["node"], [witness])
        tree.finish()
        parent = upper.to_pylist()[0]
        for level in parent["siblings"]:
            for witness in witnesses:
                witness.extend(level["left"], level["right"])
        return pa.Table.from_pylist([emit(r, w, parent["subroot"]) for r, w in zip(rows, witnesses, strict=True)], arrow)

    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("key", "block")
    return blocks.cogroup(above.withColumnRenamed("pos", "block").groupBy("key", "block")).applyInArrow(work, schema)


LEVEL = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
UPPER = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("siblings", LEVEL)])


def descend(tables: list[DataFrame], tops: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, pos, subroot, siblings`` of every block root of the first table (of the nodes themselves where they are the root).

    ``tops`` has the witness of each key's root. Going down, a table's nodes
    are those that are roots and those whose block is known from the table above.
    """

    def emit(row: dict, witness: Witness, subroot: str) -> dict:
        return {"key": row["key"], "pos": row["pos"], "subroot": subroot, "siblings": [{"left": a, "right": b} for a, b in witness.levels]}

    known = None
    for nodes in reversed(tables):
        roots = nodes.filter("levels <= 0").select("key", "pos").join(tops, "key").select("key", "pos", "subroot", "siblings")
        if known is not None:
            inner = attach(nodes.filter("levels > 0").select("key", "pos", "node", "levels"), known, lambda _: Witness(), emit, f"key string, pos long, subroot string, siblings {SIBLINGS}", UPPER)
            roots = roots.unionByName(inner)
        known = scratch.table(roots)
    return known


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "source", order_col: str = "doc_id", presented: Sequence[Column] | None = None, siblings: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``order_col, leaf, subroot, root, proof_sha256, folded_root, verified``, and ``siblings`` if asked for.

    The leaf is H (lowercase hex SHA-256, digests concatenated as hex text) of
    ``fields``. Leaves of one ``group_col`` value ascend by ``order_col``
    (nulls first; ties by leaf, so repeated rows are neighbours), and every
    sixteen consecutive nodes become one until a single one, the subroot, is
    left; subroots in the order of their values (null first, else UTF-8
    bytewise) likewise give the root. ``proof_sha256`` is H of all siblings on
    the way up. ``folded_root`` is what the leaf of ``presented`` (values
    offered for ``fields`` by someone to be checked; the row itself if not
    given) and these siblings lead to, ``verified`` whether that is the root.

    Blocks of 4096 leaves are built side by side by streaming appends, their
    roots are appended in turn by the next stage, and witnesses come down the
    same way; a group that holds most rows is many blocks. Nulls are a value
    of their own in every field; texts of any length are hashed whole in the
    JVM and never shuffled; other columns don't matter; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    kind = docs.schema[order_col].dataType.simpleString()
    own = [F.col(f) for f in fields]
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaf = leaf_of(own)
    leaves = placed(docs.select(group.alias("key"), F.col(order_col).alias("id"), leaf.alias("node"), (leaf_of(presented) if presented else leaf).alias("offered")), scratch, ["id", "node"])
    leaves = scratch.table(leaves)
    inner = stages(leaves, scratch)
    subroots = [t.filter("levels <= 0").select("key", "node") for t in inner]
    named = subroots[0]
    for more in subroots[1:]:
        named = named.unionByName(more)
    above = scratch.table(placed(named.select(F.lit("").alias("key"), F.col("key").alias("name"), "node"), scratch, ["name"]))
    outer = stages(above, scratch)
    root = next((r[0] for t in outer for r in t.filter("levels <= 0").select("node").take(1)), None)
    ends = spark.createDataFrame([("", root, [])], f"key string, subroot string, siblings {SIBLINGS}")
    tops = descend(outer, ends, scratch).select("pos", "siblings").join(above.select("pos", "name", "node"), "pos")
    tops = scratch.table(tops.select(F.col("name").alias("key"), F.col("node").alias("subroot"), "siblings"))

    # Leaves are roots themselves where a group has one row; the others hang below the blocks of the next table.
    known = descend(inner[1:], tops, scratch) if len(inner) > 1 else None
    arrow_id = pa.schema([("id", _arrow(docs.schema[order_col].dataType))])
    with_siblings = [("siblings", LEVEL)] if siblings else []
    arrow = pa.schema([*arrow_id, ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), *[pa.field(*f) for f in with_siblings]])
    schema = f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string" + (f", siblings {SIBLINGS}" if siblings else "")

    class Both(Proof):
        __slots__ = ("seen",)

        def __init__(self, offered: str) -> None:
            super().__init__(offered)
            self.seen: list[dict[str, str]] = []

        def extend(self, left: str, right: str) -> None:
            super().extend(left, right)
            if siblings:
                self.seen.append({"left": left, "right": right})

    def emit(row: dict, proof: Both, subroot: str) -> dict:
        out = {"id": row["id"], "leaf": row["node"], "subroot": subroot, "proof_sha256": proof.siblings.hexdigest(), "folded_root": proof.node}
        return out | ({"siblings": proof.seen} if siblings else {})

    def single(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                proof = Both(r["offered"])
                for level in r["siblings"]:
                    proof.extend(level["left"], level["right"])
                rows.append(emit(r, proof, r["subroot"]))
            yield from pa.Table.from_pylist(rows, arrow).to_batches()

    out = leaves.filter("levels <= 0").join(tops, "key").select("id", "node", "offered", "subroot", "siblings").mapInArrow(single, schema)
    if known is not None:
        out = out.unionByName(attach(leaves.filter("levels > 0"), known, lambda r: Both(r["offered"]), emit, schema, arrow))
    root_of = F.lit(root).cast("string")
    return out.select(F.col("id").alias(order_col), "leaf", "subroot", root_of.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root_of).alias("verified"), *(["siblings"] if siblings else []))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
