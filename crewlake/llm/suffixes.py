"""Exact substring deduplication on sorted suffixes, byte for byte.

A byte goes if some ``length``-byte string over it starts anywhere else as well.  Sorting the suffixes of all bytes of a
corpus would move every byte hundreds of times, so suffixes are sorted the induced way: a sample is sorted, the rest follows.

1. *Sample.*  In every ``length``-byte string the ``GRAM``-byte run with the lowest hash is its anchor; equal strings have equal
   anchors at equal places.  Anchors that occur once in the corpus prove every string over them unique and go no further.
2. *External sort.*  The other anchors' suffixes, cut where no string over them can end, are dealt out by anchor and sorted by
   content.  Spark's spilling shuffle sort is the disk-backed priority queue here: a shard is streamed in suffix order and may
   be far larger than memory.  Equal suffixes with equal left sides of a task are one tuple with a count.
3. *Induction.*  From the order of the suffixes at distance d before the anchors and their common-prefix lengths follow order
   and common prefixes at distance d + 1: tuples are stably re-ordered by the byte in front; where that byte is equal the
   common prefix is one more than the minimum over the stretch in between, else zero.  After each step a string is repeated if
   its common prefix with a neighbour reaches ``length``.

An anchor with more than ``HOT`` occurrences would make one group grow without bound, so the distinct surroundings of such
anchors are judged by hash instead: each gives the hashes of its strings, which are counted like any other key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.llm.shared import HashFilter, cut, with_columns
from crewlake.llm.textbytes import CHUNK, LETTER, Chunk, chunks, lowest_from, mix

LENGTH, GRAM = 200, 64
HOT = 50_000
FILTER_BITS, HOT_BITS = 27, 20
HELD = 1 << 20
BLOCK_ROWS = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


class _Sums:
    """Hashes of any stretch of a chunk's bytes, from running sums of a polynomial modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        size = CHUNK if n <= CHUNK else n
        self.down = _powers(_BACK, size)
        values = LETTER[data]
        values *= _powers(_BASE, size)[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def runs(self, width: int) -> np.ndarray:
        """Hashes of all stretches of ``width`` bytes, by their first byte."""
        h = self.sums[width:] - self.sums[:-width]
        h *= self.down[: len(h)]
        return mix(h + np.uint64(width))


def _anchors(chunk: Chunk, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, _Sums]:
    """(hash, position in the chunk) of the anchors of all rows, which have at least ``length`` bytes each."""
    sums = _Sums(chunk.data)
    h = sums.runs(gram)
    fits = np.zeros(len(h), bool)  # a whole string begins here within its row
    for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist()):
        fits[a: b - length + 1] = True
    at = lowest_from(h, fits, length - gram + 1)
    return h[at], at, sums


def _long_texts(docs: DataFrame, text_column: str, length: int) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(*_keys(text), text.alias("_text")).filter(F.octet_length("_text") >= length)


def _keys(text) -> list:
    """Two hashes that stand for a text: results depend on the bytes alone, so equal texts share them."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def _count(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int32))], ["anchor", "n"])

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                held.append(_anchors(chunk, length, gram)[0])
                n += len(held[-1])
                if n > HELD:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return texts.select("_text").mapInArrow(run, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n"))


def _binary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    lens = end - start
    offsets = np.concatenate(([0], np.cumsum(lens)))
    flat = data[np.arange(int(offsets[-1])) + np.repeat(start - offsets[:-1], lens)]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.tobytes())])


def _surroundings(texts: DataFrame, known, length: int, gram: int, content: bool) -> DataFrame:
    """Anchors that may occur twice, with a hash of everything a string over them can hold.

    With ``content``: rows (anchor, around, hot, left, right, n), equal ones of a chunk counted once.  Without: rows
    (h1, h2, anchor, around, pos) of all of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, hot = known.value
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                h, at, sums = _anchors(chunk, length, gram)
                hit = again.has(h)
                h, at = h[hit], at[hit]
                if not len(h):
                    continue
                row = np.searchsorted(chunk.offsets, at, side="right") - 1
                low = np.maximum(at - (length - gram), chunk.offsets[row])
                high = np.minimum(at + length, chunk.offsets[row + 1])
                around = mix(sums.of(low, at) * np.uint64(3) + sums.of(at, high))
                if content:
                    _, first, n = np.unique(mix(h + around), return_index=True, return_counts=True)
                    h, at, low, high, around = (x[first] for x in (h, at, low, high, around))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(hot.has(h)), _binary(chunk.data, low, at),
                         _binary(chunk.data, at, high), pa.array(n.astype(np.int64))], ["anchor", "around", "hot", "left", "right", "n"])
                else:
                    which = pa.array(chunk.first + row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(which), batch.column(1).take(which), pa.array(h.view(np.int64)), pa.array(around.view(np.int64)),
                         pa.array(at - chunk.offsets[row])], ["h1", "h2", "anchor", "around", "pos"])

    return texts.mapInArrow(run, "anchor long, around long, hot boolean, left binary, right binary, n long" if content
                            else "h1 long, h2 long, anchor long, around long, pos long")


def _padded(values: list[bytes], width: int, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes at equal width (right-aligned and reversed if asked) and their lengths."""
    lens = np.fromiter(map(len, values), np.int64, len(values))
    out = np.zeros((len(values), width), np.uint8)
    flat = np.frombuffer(b"".join(values), np.uint8)
    row = np.repeat(np.arange(len(values)), lens)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[row, np.repeat(lens, lens) - 1 - pos if reverse else pos] = flat
    return out, lens


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high] for each pair, low < high, by doubling."""
    out = np.empty(len(low), values.dtype)
    size = high - low
    level, table = 0, values
    top = np.int64(np.floor(np.log2(np.maximum(size, 1))))
    for level in range(int(top.max()) + 1 if len(low) else 0):
        if level:
            half = 1 << (level - 1)
            table = np.minimum(table[: len(table) - half], table[half:])
        mine = top == level
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << level)])
    return out


def induce(group: np.ndarray, left: list[bytes], right: list[bytes], copies: np.ndarray, length: int, reach: int) -> np.ndarray:
    """Which strings are repeated: entry [i, d] is for the one that starts d bytes before tuple i's anchor.

    Tuples come in suffix order (by group, then by right side).  Equal tuples may follow each other or carry copies > 1.
    """
    m = len(group)
    found = np.zeros((m, reach + 1), bool)
    ahead, n_left = _padded(left, reach, True)
    after, n_right = _padded(right, length, False)
    # common prefixes of neighbours in the sorted sample; 0 where a group begins
    same = after[1:] == after[:-1]
    lcp = np.zeros(m, np.int64)
    if m > 1:
        run = np.where(same.all(axis=1), length, same.argmin(axis=1))
        lcp[1:] = np.where(group[1:] == group[:-1], np.minimum(run, np.minimum(n_right[1:], n_right[:-1])), 0)
    order = np.arange(m)
    for d in range(reach + 1):
        if d:
            inner = n_left[order] >= d
            byte = ahead[order, d - 1].astype(np.int64)
            at = np.flatnonzero(inner)  # places in the order that go on
            if not len(at):
                break
            by_byte = at[np.argsort(group[order[at]] * 256 + byte[at], kind="stable")]
            joined = np.zeros(len(at), bool)
            a, b = by_byte[:-1], by_byte[1:]
            joined[1:] = (group[order[a]] == group[order[b]]) & (byte[a] == byte[b])
            step = np.zeros(len(at), np.int64)
            some = np.flatnonzero(joined)
            if len(some):
                step[some] = 1 + _range_minimum(lcp, a[some - 1] + 1, b[some - 1] + 1)
            order, lcp = order[by_byte], step
        fits = n_right[order] + d >= length
        with_next = np.append(lcp[1:], 0)
        hit = fits & ((lcp >= length) | (with_next >= length) | (copies[order] > 1))
        found[order[hit], d] = True
    return found


def _ranges(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of True in each row."""
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


_RANGE = "anchor long, around long, near long, far long"


def _range_batch(anchor, around, found) -> pa.RecordBatch:
    row, near, far = _ranges(found)
    return pa.RecordBatch.from_arrays([pa.array(anchor[row]), pa.array(around[row]), pa.array(near), pa.array(far)],
                                      ["anchor", "around", "near", "far"])


def _by_suffixes(dealt: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows (anchor, around, near, far): strings that start ``near`` to ``far`` bytes before the anchor are repeated."""
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close(rows: list[tuple]) -> pa.RecordBatch:
            # equal tuples of several tasks are neighbours and become one
            merged: list[list] = []
            for row in rows:
                if merged and merged[-1][:2] == [row[0], row[1]]:
                    merged[-1][4] += row[4]
                else:
                    merged.append(list(row))
            anchor, around, left, right, n = zip(*merged)
            anchor = np.array(anchor, np.int64)
            group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
            found = induce(group, left, right, np.array(n, np.int64), length, reach)
            return _range_batch(anchor, np.array(around, np.int64), found)

        for batch in batches:
            batch = batch.filter(pc.invert(batch.column("hot")))
            held.extend(zip(*(batch.column(c).to_pylist() for c in ("anchor", "around", "left", "right", "n"))))
            if len(held) >= BLOCK_ROWS:
                last = held[-1][0]
                cut = next((i for i in range(len(held) - 1, 0, -1) if held[i - 1][0] != last), 0)
                if cut:
                    yield close(held[:cut])
                    held = held[cut:]
        if held:
            yield close(held)

    return dealt.sortWithinPartitions("anchor", "right", "around").mapInArrow(run, _RANGE)


def _by_hash(dealt: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors with very many surroundings: distinct surroundings give the hashes of their strings."""
    reach = length - gram
    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (batch.filter(batch.column("hot")) for batch in batches)

    one = dealt.mapInArrow(hot, dealt.schema).groupBy("anchor", "around").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.sum("n").alias("n"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in range(0, len(left), 256):
                texts = [a + b for a, b in zip(left[i: i + 256], right[i: i + 256])]
                lens = np.fromiter(map(len, texts), np.int64, len(texts))
                ahead = np.fromiter(map(len, left[i: i + 256]), np.int64, len(texts))
                base = np.cumsum(lens) - lens
                sums = _Sums(np.frombuffer(b"".join(texts), np.uint8))
                count = np.maximum(np.minimum(ahead + 1, lens - length + 1), 0)
                row = np.repeat(np.arange(len(texts)), count)
                start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                h = sums.of(base[row] + start, base[row] + start + length)
                which = pa.array(i + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(1).take(which), pa.array(ahead[row] - start), pa.array(h.view(np.int64)),
                     batch.column(4).take(which)], ["anchor", "around", "near", "string", "n"])

    each = one.select("anchor", "around", "left", "right", "n").mapInArrow(strings, "anchor long, around long, near long, string long, n long")
    # at one distance from the anchor: a run of one letter holds its anchor at several places
    many = each.groupBy("anchor", "near", "string").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).drop("all")
    found = (each.join(many, ["anchor", "near", "string"]).filter(F.col("near") <= reach)
             .groupBy("anchor", "around").agg(F.collect_set("near").alias("at")))  # at most reach + 1 distances
    # runs of neighbouring distances become one range each
    near = F.sort_array(F.filter("at", lambda x: ~F.array_contains("at", x - 1)))
    far = F.sort_array(F.filter("at", lambda x: ~F.array_contains("at", x + 1)))
    return found.select("anchor", "around", F.explode(F.arrays_zip(near.alias("near"), far.alias("far"))).alias("r")).select(
        "anchor", "around", "r.near", "r.far")


def repeated_spans(docs: DataFrame, text_column: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT,
                   filter_bits: int = FILTER_BITS) -> DataFrame:
    """Rows (h1, h2, spans): byte spans (start, end) of each distinct text that repeated strings cover; they may overlap."""
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    texts = _long_texts(docs, text_column, length)
    counts = cut(_count(texts, length, gram).filter("n > 1"))
    known = (HashFilter.of(counts, "anchor", filter_bits), HashFilter.of(counts.filter(F.col("n") > hot), "anchor", HOT_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    tuples = _surroundings(texts, shared, length, gram, True)
    # one shuffle for both ways (each picks its rows after it, so that Spark reads the texts once): a hot anchor's tuples are
    # spread by their surroundings, all others lie together
    dealt = tuples.repartition("anchor", F.when(F.col("hot"), F.col("around")))
    ranges = _by_suffixes(dealt, length, gram)
    if known[1].table.any():
        ranges = ranges.unionByName(_by_hash(dealt, length, gram))
    places = _surroundings(texts, shared, length, gram, False)
    return (places.join(ranges, ["anchor", "around"])
            .select("h1", "h2", F.struct((F.col("pos") - F.col("far")).alias("start"), (F.col("pos") - F.col("near") + length).alias("end")).alias("s"))
            .groupBy("h1", "h2").agg(F.collect_set("s").alias("spans")))  # of one text: bounded by its length


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes removed, maximal removed runs)."""
    out, at, runs, removed = [], 0, 0, 0
    for start, end in sorted(spans):
        if start > at or not runs:
            out.append(text[at:start])
            runs += 1
            removed += end - start
            at = end
        elif end > at:
            removed += end - at
            at = end
    out.append(text[at:])
    return b"".join(out), removed, runs


def remove_repeats(docs: DataFrame, carry: list[str], text_column: str = "text", **options) -> DataFrame:
    """Carried columns, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 of every document.

    NULL texts are empty.  Texts under ``length`` bytes stay whole.  All copies of a repeated string go, the first one as
    well; repeated rows count as copies.  What remains need not be valid UTF-8, so it is binary.
    """
    spans = repeated_spans(docs, text_column, **options)
    text = F.coalesce(F.col(text_column), F.lit(""))
    h1, h2 = _keys(text)
    marked = (docs.select(*carry, text.cast("binary").alias("_text"), h1.alias("_h1"), h2.alias("_h2"))
              .join(spans.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("spans").alias("_spans")), ["_h1", "_h2"], "left")
              .select(*carry, "_text", "_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()
            rows = [_kept(t.as_py(), [(x["start"], x["end"]) for x in s or ()]) for t, s in zip(texts, found)]
            kept = [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array([len(t.as_py()) for t in texts], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array(kept, pa.binary()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                [*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return marked.mapInArrow(run, with_columns(
        docs, carry, "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"))
