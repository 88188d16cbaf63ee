"""Where two copies of a large table differ, by stored digests of key ranges (Q9)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlake.session import kept, new_folder

#: Children of a node, as a power of two.
FAN = 6
#: Up to so many ranges are handed to the scans as bounds; more are told by a join on the range.
BOUNDS = 200


def _digest(columns: Sequence[str]) -> list[Column]:
    """Sums over rows that do not depend on their order: how many, and two hashes of all values (NULL is a value)."""
    values = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)]]


def _sums() -> list[Column]:
    return [F.sum(c).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in ("n", "h1", "h2")]


class HashTree:
    """Digests of a table's rows by ranges of a whole-number key, in levels of 64 times wider ranges.

    Level 0 holds ranges of ``width`` keys; rows with a NULL key are a range of their own.  Adding rows only adds to
    sums, so trees of appended batches are merged by adding digests (:meth:`merge`).  Folders under ``root``: one per level with
    (node, n, h1, h2), sorted by node.
    """

    def __init__(self, spark: SparkSession, root: str, levels: int, width: int, columns: Sequence[str], key: str):
        self.spark, self.root, self.levels, self.width, self.columns, self.key = spark, root, levels, width, list(columns), key

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema("node long, n long, h1 decimal(38,0), h2 decimal(38,0)").parquet(f"{self.root}/{k}")

    @classmethod
    def build(cls, table: DataFrame, key: str, width: int = 1024, root: str | None = None) -> HashTree:
        """One aggregation over the table, summed in its tasks; the levels above read the level below."""
        node = F.floor(F.col(f"`{key}`") / F.lit(width)).cast("long")
        return cls._grow(table.groupBy(node.alias("node")).agg(*_digest(sorted(table.columns))), table.sparkSession, root, width, table.columns, key)

    @classmethod
    def _grow(cls, leaves: DataFrame, spark, root, width, columns, key) -> HashTree:
        root, k = root or new_folder(spark, "tree"), 0
        while True:
            kept(leaves.repartitionByRange("node").sortWithinPartitions("node"), f"{root}/{k}")
            tree = cls(spark, root, k + 1, width, sorted(columns), key)
            ends = tree.level(k).agg(F.min("node"), F.max("node")).first()
            if ends[0] is None or ends[1] - ends[0] < 1 << FAN:
                return tree
            leaves = tree.level(k).groupBy(F.floor(F.col("node") / (1 << FAN)).cast("long").alias("node")).agg(*_sums())
            k += 1

    def merge(self, other: HashTree, root: str | None = None) -> HashTree:
        """The tree of both tables' rows together."""
        if (self.width, self.columns, self.key) != (other.width, other.columns, other.key):
            raise ValueError("the trees describe different tables")
        both = self.level(0).unionByName(other.level(0)).groupBy("node").agg(*_sums())
        return self._grow(both, self.spark, root, self.width, self.columns, self.key)

    def differing(self, other: HashTree) -> DataFrame:
        """(node, rows_a, rows_b): ranges whose rows differ; only children of differing nodes are compared.

        The trees may differ in height: comparison starts at the highest level that both have.  Columns of one tree only
        make every range differ.
        """
        if (self.width, self.key) != (other.width, other.key):
            raise ValueError("the trees use different ranges")
        found = None
        for k in reversed(range(min(self.levels, other.levels))):
            sides = []
            for tree, name in ((self, "a"), (other, "b")):
                rows = tree.level(k)
                if found is not None:
                    parent = F.floor(F.col("node") / (1 << FAN)).cast("long")
                    rows = rows.withColumn("up", parent).join(found.select(F.col("node").alias("up_of")), F.col("up").eqNullSafe(F.col("up_of")), "left_semi").drop("up")
                sides.append(rows.select(F.col("node").alias(f"node_{name}"), F.col("n").alias(f"rows_{name}"), F.struct("n", "h1", "h2").alias(name)))
            met = sides[0].join(sides[1], F.col("node_a").eqNullSafe(F.col("node_b")), "full_outer")
            found = kept(met.filter(~F.col("a").eqNullSafe(F.col("b"))).select(
                F.coalesce("node_a", "node_b").alias("node"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rows_a", "rows_b")]))
        return found

    def inside(self, table: DataFrame, ranges: DataFrame) -> DataFrame:
        """Rows of ``table`` in the ranges: by bounds that reach the scan where the ranges are few, else by a join."""
        some = [r.node for r in ranges.select("node").limit(BOUNDS + 1).collect()]
        key = F.col(f"`{self.key}`")
        if len(some) <= BOUNDS:
            near = [key.isNull() if n is None else (key >= n * self.width) & (key < (n + 1) * self.width) for n in some]
            return table.filter(reduce(lambda x, y: x | y, near, F.lit(False)))
        node = F.floor(key / F.lit(self.width)).cast("long")
        return table.withColumn("_at", node).join(ranges.select(F.col("node").alias("_node")), F.col("_at").eqNullSafe(F.col("_node")), "left_semi").drop("_at")


def differing_keys(a: DataFrame, b: DataFrame, tree_a: HashTree, tree_b: HashTree) -> DataFrame:
    """(key, rows_a, rows_b, state): every key whose rows differ, ``changed``, ``only_a`` or ``only_b``.

    Only rows in differing ranges are read.  A key may have several rows; their order does not count.
    """
    ranges, key = tree_a.differing(tree_b), tree_a.key
    sides = []
    for table, name in ((a, "a"), (b, "b")):
        rows = tree_a.inside(table, ranges).groupBy(F.col(f"`{key}`").alias(f"key_{name}")).agg(*_digest(sorted(table.columns)))
        sides.append(rows.select(f"key_{name}", F.col("n").alias(f"rows_{name}"), F.struct("n", "h1", "h2").alias(name)))
    met = sides[0].join(sides[1], F.col("key_a").eqNullSafe(F.col("key_b")), "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    state = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("changed")
    return met.select(F.coalesce("key_a", "key_b").alias("key"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rows_a", "rows_b")], state.alias("state"))
