"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Fingerprints that differ in at most ``radius`` bits agree on all but ``radius`` of ``BLOCKS`` bit blocks, so equal
values on some choice of the other blocks bring every linked pair into a common shard.  A shard holds distinct
fingerprints only.  A shard over ``SHARD`` fingerprints is split again by the same argument on its free bits, twice if need
be; after that at most 2 ** 8 different fingerprints can share it, so a tree's size is bounded by construction.  Each shard
builds one BK-tree, whose children are keyed by their integer distance to the parent, and a look-up follows only edges
within the radius.  Shard trees meet their look-ups through the shuffle, not a broadcast: all trees together grow with the
corpus and have no size bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.llm.shared import components, cut, free_name
from crewlake.llm.textbytes import chunks

BLOCKS = 4
SHARD = 256
SEED = 42


def _fingerprints(column: pa.Array, width: int) -> np.ndarray:
    """SimHash of every text: a bit is set where over half of the shingles' XXH64 values (repeats included) set it."""
    out = np.zeros(len(column), dtype=np.uint64)
    hash_of = xxhash.xxh64_intdigest
    for chunk in chunks(column):
        text, starts, ends = chunk.joined()
        if not len(starts):
            continue
        at = chunk.word_offsets
        for row in range(chunk.rows):
            a, b = int(at[row]), int(at[row + 1])
            if a == b:
                continue
            last = max(b - width + 1, a + 1)
            s = starts[a:last].tolist()
            e = ends[min(a + width, b) - 1: b].tolist()
            h = np.fromiter((hash_of(text[i:j], SEED) for i, j in zip(s, e)), dtype=np.uint64, count=last - a)
            ones = np.zeros(64, dtype=np.int64)
            for k in range(0, len(h), 1 << 16):
                part = np.unpackbits(h[k: k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += part.sum(axis=0, dtype=np.int64)
            out[chunk.first + row] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """Rows (id, text_key, fp): A-Z lower-cased, words cut at ASCII white space, shingles of ``width`` words.

    Fewer words make one shingle of all of them; a text without words (NULL, empty) has fingerprint 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(_fingerprints(batch.column(2), width).view(np.int64))], ["id", "text_key", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    text = F.col(text_column).cast("string")
    return docs.select(id_column, F.xxhash64(text), text).mapInArrow(run, f"id {kind}, text_key long, fp long")


class BKTree:
    """Hamming-distance tree of 64-bit integers."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def near(self, x: int, radius: int) -> list[int]:
        """Indices of all stored values within ``radius``: a child at distance e can hold some only if |e - d| <= radius."""
        found, stack, nodes = [], [0] if self.nodes else [], self.nodes
        while stack:
            i = stack.pop()
            value, children = nodes[i]
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(i)
            for e in range(max(1, d - radius), d + radius + 1):
                if e in children:
                    stack.append(children[e])
        return found

    def add(self, x: int) -> int:
        i = 0
        if self.nodes:
            while (d := (self.nodes[i][0] ^ x).bit_count()):
                children = self.nodes[i][1]
                if d not in children:
                    children[d] = len(self.nodes)
                    break
                i = children[d]
            else:
                return i
        self.nodes.append((x, {}))
        return len(self.nodes) - 1


def _shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """One link from every fingerprint to the root of its group within the shard (groups of one give none)."""
    tree, root = BKTree(), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x in sorted(values):
        close = tree.near(x, radius)
        i = tree.add(x)
        root.append(i)
        for j in close:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    kept = [v for v, _ in tree.nodes]
    return [(kept[i], kept[find(i)]) for i in range(len(kept)) if find(i) != i]


def _masks(free: list[int], radius: int, blocks: int) -> list[int]:
    """Bit masks of all choices of ``blocks - radius`` of ``blocks`` equal stretches of the free bit positions."""
    parts = [free[len(free) * k // blocks: len(free) * (k + 1) // blocks] for k in range(blocks)]
    return [sum(1 << bit for part in some for bit in part) for some in combinations(parts, blocks - radius)]


def _shards(distinct: DataFrame, radius: int, blocks: int, shard: int) -> DataFrame:
    """Rows (mask, key, fp) of all shards with two or more members, none of them over ``shard`` unless bits ran out."""
    bits = list(range(64))

    def signed(m: int) -> int:
        return m - (1 << 64) if m >> 63 else m

    def keyed(df: DataFrame, masks: list[int]) -> DataFrame:
        return df.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).select(
            "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")

    def counted(df: DataFrame) -> DataFrame:
        many = df.groupBy("mask", "key").count().filter("count > 1")
        return cut(df.join(many, ["mask", "key"]))

    first = [signed(m) for m in _masks(bits, radius, blocks)]
    now = counted(keyed(distinct, first))
    ready = now.filter(F.col("count") <= shard).select("mask", "key", "fp")
    left = {m: [b for b in bits if not m >> b & 1] for m in first}
    while True:
        over = now.filter(F.col("count") > shard)
        wide = [r[0] for r in over.select("mask").distinct().collect()]  # masks are a fixed list, a few hundred at most
        if not wide:
            return ready
        if all(len(left[m]) < 2 * blocks for m in wide):
            return ready.unionByName(over.select("mask", "key", "fp"))
        table = {m: [(signed((m & (1 << 64) - 1) | x), [b for b in left[m] if not x >> b & 1]) for x in _masks(left[m], radius, blocks)]
                 for m in wide}
        again = None
        for m, finer in table.items():
            part = keyed(over.filter(F.col("mask") == m).select("fp"), [x for x, _ in finer])
            again = part if again is None else again.unionByName(part)
        left = {x: free for finer in table.values() for x, free in finer}
        now = counted(again.distinct())
        ready = ready.unionByName(now.filter(F.col("count") <= shard).select("mask", "key", "fp"))


def links(distinct: DataFrame, radius: int = 2, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect all of ``distinct`` (fp) whose fingerprints differ in at most ``radius`` bits.

    Within a shard a group is given as a star around its smallest fingerprint, not as all its pairs.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, values = None, []
        found: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            a = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for batch in batches:
            masks, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            fps = batch.column(2).to_numpy().view(np.uint64).tolist()
            for m, k, x in zip(masks, keys, fps):
                if (m, k) != now:
                    found += _shard_links(values, radius)
                    now, values = (m, k), []
                    if len(found) > 1 << 15:
                        yield flush()
                values.append(x)
        found += _shard_links(values, radius)
        yield flush()

    shards = _shards(distinct, radius, blocks, shard)
    return (shards.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
            .mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3,
                    radius: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable through links).

    NULL ids keep their row; a component of NULL ids alone has a NULL component_id.  Repeated rows, texts without words and
    exact copies share a fingerprint and hence a component.  Other columns are ignored.
    """
    classed = _classed(docs, id_column, text_column, width, radius)
    return classed.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classed(docs: DataFrame, id_column: str, text_column: str, width: int, radius: int) -> DataFrame:
    """Rows (fp, id, text_key, root, component_id), one per document; ``root`` tells components of equal ids apart."""
    marked = cut(fingerprints(docs, id_column, text_column, width))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(distinct.select("fp"), radius))
    classed = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = classed.join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(by_print, "fp")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3,
                         radius: int = 2) -> DataFrame:
    """The documents whose id is the smallest of their component; of several that share it the one of lowest text hash stays, once.

    An id with several texts is judged text by text.  Rows with a NULL id all stay: without an id none can be preferred.
    """
    classes = _classed(docs, id_column, text_column, width, radius)
    own, key = free_name(docs, "_keep_id"), free_name(docs, "_keep_key")
    keep = classes.filter(F.col("id") == F.col("component_id")).groupBy("root", F.col("id").alias(own)).agg(F.min("text_key").alias(key)).drop("root")
    named = docs.join(keep, (F.col(id_column) == F.col(own)) & (F.xxhash64(F.col(text_column).cast("string")) == F.col(key)), "left_semi").dropDuplicates([id_column, text_column])
    return named.select(*docs.columns).unionByName(docs.filter(F.col(id_column).isNull()))
