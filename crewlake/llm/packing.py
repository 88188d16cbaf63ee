"""Mixture-controlled packing of whole documents into fixed windows of tokens.

Every source is a queue of its documents' tokens.  Deficit round-robin serves the queues: each round adds a source's quantum
(its share of a window) to its deficit, as many tokens as the deficit holds whole are served, and the rest is carried on.
The served tokens form one stream, which fills window after window without a gap, so every window holds the sources in their
shares and each source's error stays within a token or two however long the stream is.

A packet is one token, so after r rounds a queue has been served floor(r * quantum) tokens and its deficit is the fraction:
any task can say, from a token's place in its queue alone, which window it falls into.  Deficits thus pass from window to
window and from partition to partition without a task waiting for another one.  Places in a queue are running sums: a task
counts the tokens of its own rows, and only the counts of tasks and sources meet.  Documents are tokenised once; ids never
go through a shuffle unless there are so many sources that their counts no longer fit a broadcast.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewlake.llm.shared import stored

WINDOW = 4096
#: A source that would get fewer tokens a window shares one queue with the others like it; so there are at most WINDOW / LEAST + 1 queues.
LEAST = 16
#: Quanta are whole multiples of 2 ** -_FRACTION tokens.
_FRACTION = 28
#: Bytes of words and ids that a worker remembers, bytes of text or ids handled at a time, words tokenised at a time.
_HELD, _SLICE, _ENCODE = 1 << 26, 1 << 23, 1 << 12
#: ASCII punctuation between a Latin letter and white space or the end; other letters, and U+0130, may become a letter and a mark.
_TAIL = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([!-/:-@\[-`{-~]+)(\s|$)"

#: Letters below this code point have no combining marks among them, so nothing composes.
_LATIN_END = "\u0250"
#: Byte-level vocabularies write a byte as a visible letter: itself where it is one in Latin-1, else the next free one from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_LETTERS = {b: 256 + k for k, b in enumerate(_HIDDEN)}


class Words:
    """Ids of texts whose tokens never cross ASCII white space: each distinct word is tokenised once and looked up afterwards.

    The tokenizer folds case and takes letters and punctuation apart, so A-Z are folded and punctuation at the end of a word
    is cut off before words are told apart; a text with special tokens is left as it is.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.folds = self._same("Ab cD?! e.g. Éa, x9;y (z)", "ab cd ?! e.g . Éa , x9;y (z )")
        sample = ["the", "straße", "éàüñœ", "ƀžıſ", "x", "supercalifragilistic", "großzügigkeiten"]
        self.direct = self.folds and all([t.id for t in self.tokenizer.model.tokenize(w.encode().decode("latin-1").translate(_BYTE_LETTERS))]
                                         == self.tokenizer.encode(w, add_special_tokens=False).ids for w in sample)
        #: the narrowest numbers that hold every id
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _same(self, one: str, other: str) -> bool:
        a, b = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in (one, other))
        return a == b

    def _forget(self) -> None:
        self.words, self.table = pa.array([], pa.string()), np.zeros(0, self.kind)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def _learn(self, new: pa.Array) -> None:
        words = new.to_pylist()
        found: list[list[int]] = [[]] * len(words)
        rest = []
        tokenize = self.tokenizer.model.tokenize
        for k, word in enumerate(words):
            low = word.lower()
            if self.direct and low.isalpha() and max(low) < _LATIN_END:
                # letters that compose with nothing: one piece, whose bytes go straight to the merges
                found[k] = [t.id for t in tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_LETTERS))]
            else:
                rest.append(k)
        for first in range(0, len(rest), _ENCODE):
            some = rest[first:first + _ENCODE]
            for k, e in zip(some, self.tokenizer.encode_batch([words[k] for k in some], add_special_tokens=False)):
                found[k] = e.ids
        self.words = pa.concat_arrays([self.words, new])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, found), np.int64)])
        self.table = np.concatenate([self.table, np.fromiter(chain.from_iterable(found), self.kind)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if self.folds:
            plain = pc.replace_substring_regex(pc.ascii_lower(texts), _TAIL, r"\1 \2\3")
            texts = pc.if_else(pc.match_substring(texts, "<|"), texts, plain)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        if self.words.nbytes + self.table.nbytes > _HELD:
            self._forget()
        place = pc.index_in(coded.dictionary, value_set=self.words)
        new = pc.is_null(place).to_numpy(zero_copy_only=False)
        known = len(self.words)
        place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if new.any():
            place[new] = known + np.arange(int(new.sum()))
            self._learn(coded.dictionary.filter(pa.array(new)))
        code = place[coded.indices.to_numpy(zero_copy_only=False)]
        lens = self.sizes[code]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        out = self.table[np.arange(total) + np.repeat(self.starts[code] - (ends - lens), lens)]
        bounds = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return out, np.diff(bounds)


@lru_cache(maxsize=1)
def _words(tokenizer_path: str) -> Words:
    """What a worker has looked up stays for its next task."""
    return Words(tokenizer_path)


def _tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Rows (id, source, part, before, n, ids): ids as packed numbers, and the tokens of the same source before in the task."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _words(tokenizer_path), TaskContext.get().partitionId()
        so_far: dict[str | None, int] = {}
        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:  # about _SLICE bytes of text at a time, whole rows
                base = int(lengths[first - 1]) if first else 0
                last = min(batch.num_rows, max(first + 1, int(np.searchsorted(lengths, base + _SLICE, side="right"))))
                some = batch.slice(first, last - first)
                ids, n = words.ids(pc.fill_null(some.column(2), ""))
                ends = np.cumsum(n)
                n = n + 1
                full = np.insert(ids, ends, end_id)
                at = np.concatenate(([0], np.cumsum(n)))
                before = []
                for source, size in zip(some.column(1).to_pylist(), n.tolist()):
                    before.append(so_far.get(source, 0))
                    so_far[source] = before[-1] + size
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([part] * some.num_rows, pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()),
                     pa.array([full[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())],
                    ["id", "source", "part", "before", "n", "ids"])
                first = last

    return docs.mapInArrow(run, f"id {kind}, source string, part int, before long, n long, ids binary")


class Schedule:
    """Deficit round-robin over queues of known sizes, as closed forms: who is served when, and into which window."""

    def __init__(self, sizes: list[int], weights: list[float], window: int):
        self.sizes, self.window = np.array(sizes, np.int64), window
        share = np.array(weights) / sum(weights)
        self.quantum = np.maximum(1, np.round(share * window * (1 << _FRACTION)).astype(np.int64))
        self.total = int(self.sizes.sum())
        self.full = self.total // window
        left, at, cuts = self.total % window, self.full * window, []
        while left:  # a rest is cut at powers of two, which need no padding
            size = 1 << (left.bit_length() - 1)
            cuts.append(at)
            at, left = at + size, left - size
        self.cuts = np.array(cuts + [at], np.int64)
        self._held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of every queue (columns) served before each of ``rounds`` (rows)."""
        whole, part = self.quantum >> _FRACTION, self.quantum & ((1 << _FRACTION) - 1)
        r = rounds[:, None]
        return np.minimum(self.sizes, r * whole + ((r * part) >> _FRACTION))

    def round_of(self, queue: int, place: int) -> int:
        """The round that serves the token at ``place`` of a queue."""
        return (((place + 1) << _FRACTION) - 1) // int(self.quantum[queue])

    _STRETCH = 256

    def _stretch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(served before, place in the stream of what each queue gets) for rounds k * _STRETCH and on."""
        if k not in self._held:
            if len(self._held) >= 8:
                self._held.pop(next(iter(self._held)))
            done = self.served(np.arange(k * self._STRETCH, (k + 1) * self._STRETCH + 1, dtype=np.int64))
            given = np.diff(done, axis=0)
            self._held[k] = done, done[:-1].sum(axis=1)[:, None] + np.cumsum(given, axis=1) - given
        return self._held[k]

    def pieces(self, queue: int, place: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(start, length, place in the stream) of the parts in which tokens ``place`` to ``place + n`` of a queue are served,
        cut at the bounds of windows."""
        at, end, r = place, place + n, self.round_of(queue, place)
        held: list[int] = []
        while at < end:
            done, stream = self._stretch(r // self._STRETCH)
            k = r % self._STRETCH
            until = min(end, int(done[k + 1, queue]))
            x = int(stream[k, queue]) + at - int(done[k, queue])
            if held and held[2] + held[1] == x:
                held[1] += until - at
            else:
                if held:
                    yield from self._cut(*held)
                held = [at - place, until - at, x]
            at, r = until, self.round_of(queue, until)
        yield from self._cut(*held)

    def window_of(self, x: int) -> tuple[int, int, int]:
        """(number, first, end) of the window that holds place ``x`` of the stream."""
        if x < self.full * self.window:
            k = x // self.window
            return k, k * self.window, (k + 1) * self.window
        k = int(np.searchsorted(self.cuts, x, side="right")) - 1
        end = int(self.cuts[k + 1]) if k + 1 < len(self.cuts) else int(self.cuts[-1])
        return self.full + k, int(self.cuts[k]), end

    def _cut(self, start: int, length: int, x: int) -> Iterator[tuple[int, int, int]]:
        while length > 0:
            size = min(length, self.window_of(x)[2] - x)
            yield start, size, x
            start, x, length = start + size, x + size, length - size


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
         end_id: int = 2, window: int = WINDOW, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Rows (id, source, start, length, ids, doc_tokens, sequence_id, offset): every document cut into pieces of windows.

    A document's ids are those of its text (NULL: empty) and ``end_id``; each lies in exactly one piece, whose ``ids`` are
    little-endian 32-bit numbers.  Windows hold
    ``window`` ids, every source in its share: its part of all ids, or ``weights`` (relative; sources that are not named keep
    their own share), as long as its documents last.  Sources of fewer than ``LEAST`` ids a window share one queue; NULL is a
    source of its own.  The rest that fills no window is cut into windows of descending powers of two, so nothing is padded.
    Within a source documents follow the input's order.  Repeated rows and ids are documents of their own.  An empty table
    gives no rows.  The tokenizer must never join ids over ASCII white space.
    """
    spark = docs.sparkSession
    mine = docs.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).alias("text"))
    tokens = stored(_tokenised(mine, tokenizer_path, end_id))
    counted = tokens.groupBy("part", "source").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    by_source = counted.groupBy("source").agg(F.sum("n").alias("n"))
    # at most window / LEAST rows by their own definition
    large = by_source.filter(F.col("n") >= LEAST * total / window).orderBy(F.col("source").asc_nulls_last()).collect()
    rest = total - sum(r.n for r in large)
    sizes = [r.n for r in large] + [rest]
    share = [(weights or {}).get(r.source) for r in large] + [None]
    given = sum(w for w in share if w is not None)
    own = sum(n for n, w in zip(sizes, share) if w is None)
    # unnamed sources keep their part of all ids; the named ones divide what is left by weight
    plan = Schedule(sizes, [n / total if w is None else (1 - own / total) * w / given for n, w in zip(sizes, share)] if total else [1.0] * len(sizes), window)
    numbers = spark.createDataFrame([(r.source, k) for k, r in enumerate(large)], "name string, queue int")
    queued = counted.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name")), "left").select(
        "part", "source", "n", F.coalesce("queue", F.lit(len(large))).alias("queue"))
    in_part = Window.partitionBy("queue", "part").orderBy(F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    parts = queued.groupBy("queue", "part").agg(F.sum("n").alias("m"))
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("queue", "part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("base"))
    bases = stored(queued.withColumn("inner", F.coalesce(F.sum("n").over(in_part), F.lit(0))).join(parts, ["queue", "part"]).select(
        F.col("part").alias("_part"), F.col("source").alias("_source"), "queue", (F.col("base") + F.col("inner")).alias("base")))  # a stored table's size is known before the join is planned
    placed = tokens.join(bases, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source"))).select(
        "id", "source", "queue", (F.col("base") + F.col("before")).alias("place"), "n", "ids")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            queue, place, n = (batch.column(k).to_numpy() for k in (2, 3, 4))
            row, out, held = [], [], 0

            def flush() -> pa.RecordBatch:
                columns = list(zip(*out))
                which = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(1).take(which), *[pa.array(c, t) for c, t in zip(
                        columns, [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])]], names)

            for k in range(batch.num_rows):
                packed = batch.column(5)[k].as_buffer()
                ids = np.frombuffer(packed, "<u2" if len(packed) == 2 * n[k] else "<u4").astype("<u4")
                for start, length, x in plan.pieces(int(queue[k]), int(place[k]), int(n[k])):
                    number, first, _ = plan.window_of(x)
                    row.append(k)
                    out.append((start, length, ids[start: start + length].tobytes(), int(n[k]), number, x - first))
                    held += length
                if held > _SLICE:
                    yield flush()
                    row, out, held = [], [], 0
            if out:
                yield flush()

    pieces = placed.mapInArrow(run, f"id {kind}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("id", id_column)
