"""Small helpers of the corpus operators: lineage cuts, connected components, fixed-size hash filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from the session's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="crewlake-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that lost executors cost no rerun."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a compressed table: smaller than a checkpoint for long results, but kept until it is deleted."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, spark: SparkSession | None = None, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the smallest node of each component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until nothing changes.  Every step is a
    minimum per node, pre-aggregated before the shuffle, and a join that Spark splits where a node is hot; the edge
    list never grows.  NULL ends are ignored; nodes without an edge are not in the result.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(now: DataFrame, both: bool) -> DataFrame:
        near = now.select("a", "b")
        if both:
            near = near.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = near.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        met = near.join(low, "a")
        if both:  # larger neighbours move to the smallest neighbour
            return tidy(met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        # smaller neighbours and the node itself move to the smallest one
        return tidy(met.select(F.col("b").alias("a"), F.col("low").alias("b"))
                    .unionByName(low.select("a", F.col("low").alias("b"))))

    now, last = cut(tidy(edges)), None
    for _ in range(max_rounds):
        now = cut(star(star(now, True), False))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = tuple(mark)
    raise RuntimeError("components did not settle")


def with_columns(docs: DataFrame, carry: list[str], more: str) -> StructType:
    """Schema of the carried columns of ``docs`` followed by those of a DDL text."""
    return StructType([*(docs.schema[c] for c in carry), *StructType.fromDDL(more).fields])


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores put in front until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class HashFilter:
    """Fixed-size filter of 64-bit hashes: no false negatives, false positives only cost work in the exact step after it.

    Its size is a parameter and does not follow the data, which makes it safe to broadcast.
    """

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @staticmethod
    def slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        h = h.astype(np.uint64, copy=False)
        mask = np.uint64((1 << bits) - 1)
        return h & mask, (h >> np.uint64(64 - bits)) & mask

    def has(self, h: np.ndarray) -> np.ndarray:
        one, two = self.slots(h, self.bits)
        seven = np.uint64(7)
        hit = (self.table[one >> np.uint64(3)] >> (one & seven).astype(np.uint8)) & 1
        return (hit & (self.table[two >> np.uint64(3)] >> (two & seven).astype(np.uint8))).astype(bool)

    @classmethod
    def of(cls, hashes: DataFrame, column: str, bits: int) -> HashFilter:
        """Built in the tasks: each sets the bits of its own rows; equal words are merged by OR before the driver."""
        words = 1 << (bits - 6)

        def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(1 << (bits - 3), dtype=np.uint8)
            for batch in batches:
                for slot in cls.slots(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits):
                    np.bitwise_or.at(table, slot >> np.uint64(3), (1 << (slot & np.uint64(7))).astype(np.uint8))
            full = table.view(np.int64)
            at = np.flatnonzero(full)
            for i in range(0, len(at), 1 << 16):
                part = at[i: i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(full[part])], ["at", "bits"])

        rows = (hashes.select(column).mapInArrow(set_bits, "at long, bits long")
                .groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")))
        table = np.zeros(words, dtype=np.int64)
        got = rows.toArrow()  # at most 2 ** (bits - 6) rows, whatever the input
        table[got.column("at").to_numpy()] = got.column("bits").to_numpy()
        return cls(bits, table.view(np.uint8))


def is_test_fold(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder
