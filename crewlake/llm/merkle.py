"""Merkle manifest of a dataset as a persistent, path-copying tree.

Rows become leaves; the leaves of a group (a language, say) form one binary tree in the order of their ids, and the groups'
roots, ordered by group, form the tree on top.  A changed leaf makes a version of the tree: only the nodes above it are
copied, every other node is shared with the original.

The tree is cut into aligned blocks of ``2 ** bits`` nodes.  A block is built in one task from its own leaves alone; the
block roots are the leaves of the next level of blocks, and so on, so no task, group or driver ever holds a tree.  Versions
begin in their block (copied ancestors up to the block's root) and go on where they are through the siblings that the upper
blocks hand down, one short row per block; changed leaves never meet in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlake.llm.shared import stored

#: A block holds 2 ** bits nodes of one level.
BITS = 10


def digest(parts: list[bytes]) -> bytes:
    """SHA-256 of digests joined as lowercase hex text, as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length()


class Block:
    """Some neighbouring nodes of a level that has ``n`` in all, and the levels above them in the block.

    They never change: versions refer to them as siblings and copy only what lies above a changed leaf.
    """

    def __init__(self, n: int, leaves: list[bytes], bits: int):
        self.levels = [leaves]
        for _ in range(min(bits, height(n))):
            below = self.levels[-1]
            self.levels.append([digest(below[i:i + 2]) for i in range(0, len(below), 2)])

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[bytes]:
        """What a path from leaf ``at`` (counted in the block) meets in the block, from below."""
        out = []
        for level in self.levels[:-1]:
            if (at ^ 1) < len(level):
                out.append(level[at ^ 1])
            at >>= 1
        return out


def has_sibling(at: int, n: int) -> bool:
    return (at ^ 1) < n


def copied(at: int, n: int, node: bytes, siblings: Iterator[bytes]) -> list[bytes]:
    """Copies of all ancestors of node ``at`` of ``n``, from below, once it has become ``node``; siblings are shared."""
    out = []
    while n > 1:
        if has_sibling(at, n):
            other = next(siblings)
            node = digest([other, node] if at & 1 else [node, other])
        else:
            node = digest([node])
        out.append(node)
        at, n = at >> 1, (n + 1) >> 1
    return out


def folded(leaf: bytes, proof: list[bytes], at: int, n: int, top_at: int, top_n: int) -> list[bytes]:
    """The leaf and all nodes above it that its proof leads to, up to the root: its group's tree, then the tree of groups."""
    siblings = iter(proof)
    nodes = [leaf, *copied(at, n, leaf, siblings)]
    return nodes + copied(top_at, top_n, nodes[-1], siblings)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at`` and ``n``: a row's place in its ``grp`` by ``order``, and the rows of that group.

    A range sort deals the rows out; equal rows are told apart by their place in the stored input, so a repeated row fills no
    partition.  Only one row per partition and group takes part in the running sums.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["grp", *order, "_tie"]
    dealt = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("seq")))
    runs = dealt.groupBy("grp", "part").agg(F.min("seq").alias("low"), F.count("*").alias("rows"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("grp", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("low")).alias("shift"),
                       F.sum("rows").over(Window.partitionBy("grp")).alias("n"))
    return dealt.join(runs, ["grp", "part"]).withColumn("at", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def _blocks(nodes: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """One row (grp, block, n, rows) per aligned block; at most 2 ** bits rows each."""
    return nodes.groupBy("grp", F.shiftright("at", bits).alias("block")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", *columns))).alias("rows"))


def _paths(nodes: DataFrame, bits: int) -> DataFrame:
    """Rows (grp, at, path, root) for nodes (grp, at, n, node): siblings above every node, from below, and its group's root.

    Blocks of blocks, level by level; there are as many levels as log(n) / bits.
    """
    kind = nodes.schema["grp"].dataType.simpleString()

    def rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "up", "n", "at", "path", "root"]
        for batch in batches:
            for grp, block, n, rows in ([x.as_py() for x in row] for row in zip(*batch.columns)):
                tree = Block(n, [r["node"].encode() for r in rows], bits)
                m = len(rows)
                columns = [[grp] * m, [block] * m, [(n + (1 << bits) - 1) >> bits] * m, [r["at"] for r in rows],
                           [b"".join(tree.siblings(k)).decode() for k in range(m)], [tree.root.decode()] * m]
                types = [batch.schema.field("grp").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    level = stored(_blocks(nodes, ["node"], bits).select("grp", "block", "n", "rows").mapInArrow(
        rise, f"grp {kind}, up long, n long, at long, path string, root string"))
    if not level.filter("n > 1").limit(1).count():
        return level.select("grp", "at", "path", "root")
    upper = _paths(level.filter(F.col("at") % (1 << bits) == 0).select("grp", F.col("up").alias("at"), "n", F.col("root").alias("node")), bits)
    upper = upper.select("grp", F.col("at").alias("up"), F.col("path").alias("above"), "root")
    return level.drop("root").join(upper, ["grp", "up"]).select("grp", "at", F.concat("path", "above").alias("path"), "root")


def manifest(docs: DataFrame, columns: list[str], group_column: str, id_column: str, changed: Column | None = None,
             changed_values: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """Rows (id, leaf, subroot, root, proof, version, folded): every row's leaf, its trees' roots, its proof and its changed version.

    A leaf is the hash of ``columns`` in that order (:func:`field`).  Within a group leaves ascend by id (NULL first), then by
    leaf; repeated rows are leaves of their own.  Groups ascend bytewise, NULL first; NULL and the empty text are two groups.
    Two neighbours become one node, a last one without a neighbour is hashed alone, until one is left; a lone leaf is its
    group's root as it is, and a lone group's root is the root.  ``proof`` has the siblings from the leaf up to the root.

    ``changed`` marks rows that are tampered with (NULL: not), ``changed_values`` says which columns become what; such a row's
    ``version`` has the changed leaf and the copies of all its ancestors, the last one the version's root.  Other rows have an
    empty one.  ``folded`` is what every row's leaf, the changed one if there is one, and its proof lead to, computed from these
    alone.  Other columns of ``docs`` and their names play no part.  An empty table gives no rows.
    """
    spark_docs = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)], F.col(group_column).cast("string").alias("g"),
                             F.col(id_column).alias("id"), (F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(False)).alias("t"),
                             *[v.alias(f"v_{columns.index(c)}") for c, v in (changed_values or {}).items()])
    own = [F.col(f"c{k}") for k in range(len(columns))]
    new = [F.col(f"v_{k}") if c in (changed_values or {}) else own[k] for k, c in enumerate(columns)]
    leaves = stored(spark_docs.select(F.coalesce(F.concat(F.lit("="), "g"), F.lit("")).alias("grp"), "id", leaf(*own).alias("leaf"),
                                      F.when(F.col("t"), leaf(*new)).alias("changed")))
    placed = _numbered(leaves, ["id", "leaf"])
    kind = docs.schema[id_column].dataType.simpleString()
    blocks = stored(_blocks(placed, ["id", "leaf", "changed"], bits))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [Block(n.as_py(), [x.encode() for x in leaves.as_py()], bits).root.decode() for n, leaves in zip(batch.column(2), batch.column(3))]
            count = [(n + (1 << bits) - 1) >> bits for n in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(tops, pa.string())],
                                             ["grp", "at", "n", "node"])

    nodes = stored(blocks.select("grp", "block", "n", F.col("rows.leaf").alias("leaves")).mapInArrow(roots, "grp string, at long, n long, node string"))
    paths = _paths(nodes, bits)
    subroots = stored(paths.filter("at = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("key"), F.col("root").alias("node")))
    tops = _numbered(subroots, ["key"])
    above = _paths(tops.select("grp", "at", "n", "node"), bits).select("at", F.col("path").alias("top_path"), F.col("root").alias("top"))
    tops = tops.select(F.col("key").alias("grp"), F.col("at").alias("top_at"), F.col("n").alias("top_n")).join(above, F.col("top_at") == F.col("at")).drop("at")
    paths = paths.select("grp", F.col("at").alias("block"), "path", F.col("root").alias("subroot")).join(tops, "grp")

    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "leaf", "subroot", "root", "proof", "version", "folded"]
        for batch in batches:
            own = batch.schema.field("rows").type.value_type.field("id").type
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                tree = Block(row["n"], [r["leaf"].encode() for r in row["rows"]], bits)
                path, top_path = ([p[k:k + 64].encode() for k in range(0, len(p), 64)] for p in (row["path"], row["top_path"]))
                proofs, news, ends = [], [], []
                for k, r in enumerate(row["rows"]):
                    proof = tree.siblings(k) + path + top_path
                    changed = r["changed"] is not None
                    nodes = folded((r["changed"] if changed else r["leaf"]).encode(), proof, r["at"], row["n"], row["top_at"], row["top_n"])
                    proofs.append(proof)
                    news.append(nodes if changed else [])
                    ends.append(nodes[-1].decode())
                m, texts = len(proofs), pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["id"] for r in row["rows"]], own), pa.array([r["leaf"] for r in row["rows"]]), pa.array([row["subroot"]] * m),
                     pa.array([row["top"]] * m), *[pa.array([[x.decode() for x in p] for p in c], texts) for c in (proofs, news)], pa.array(ends, pa.string())], names)

    return blocks.join(paths, ["grp", "block"]).select("n", "rows", "path", "subroot", "top_at", "top_n", "top_path", "top").mapInArrow(
        versions, f"id {kind}, leaf string, subroot string, root string, proof array<string>, version array<string>, folded string").withColumnRenamed("id", id_column)
