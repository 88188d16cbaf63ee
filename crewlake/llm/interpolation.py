"""Language-model scoring by deleted interpolation.

Maximum-likelihood bigram estimates are mixed with the additive unigram model.  The mixture weight depends on how frequent
the context is (buckets of powers of two of its count); weights are learned by expectation-maximisation in
which every training bigram is deleted from its own estimate (counts less one), so that it acts as held-out evidence.
Bigrams are kept for every context seen ``CONTEXT`` times or more; a context seen less has no evidence once its bigram is
deleted, and backs off to the unigram model.

Counts are asked for where they are needed.  Documents are packed into blocks of about ``BLOCK`` tokens.  A block sends its
distinct words, and later its distinct bigrams, to the parts that count them; a part sums what all blocks send and answers
each block.  So nothing is sent per document, a hot word or bigram is one entry per block, and no table of n-grams is broadcast.
Words are numbered by descending count: a number then tells its word's count from a table of the distinct counts (at most the
square root of twice the number of tokens), and sorted bigrams of small numbers take two to three bytes.  Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from crewlake.llm.shared import stored, with_columns
from crewlake.llm.textbytes import Chunk, chunks, mix

CONTEXT = 2
#: Tokens of a block (a longer document is a block of its own), and tokens of the corpus per part of the counts.
BLOCK, PART = 1 << 20, 1 << 21
ADD = 0.1
BUCKETS = 40
END = mix(np.array([1], np.uint64))[0]
_STEPS = 16  # bins of the likelihood ratio per unit of its logarithm


def _tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows with the end token after each row, and the row bounds in them."""
    words, at = chunk.hashes(), chunk.word_offsets
    return np.insert(words, at[1:], END), at + np.arange(len(at))


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: planes that are zero throughout are left out."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8).T[:width].tobytes()
    return struct.pack("<QB", len(values), width) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def _unpacked(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", data)
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(pa.decompress(data[9:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _steps(values: np.ndarray) -> bytes:
    """Ascending numbers, packed as their differences."""
    return _packed(np.diff(values, prepend=np.uint64(0)))


def _climb(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def blocks(docs: DataFrame, carry: list[str], text: Column, learned: Column, scored: Column) -> DataFrame:
    """Rows (block, n, tokens, words, counts, taught, docs): the documents in blocks, in no order.

    ``words`` are the distinct hashes of a block, ascending; ``counts`` and ``taught`` their tokens in all and in the training
    documents; ``tokens`` places in the list of words by descending count.  ``docs`` holds the carried columns of every document,
    whether it is learned from and scored, and its number of tokens.
    """
    kinds = StructType([*(StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(carry)),
                        StructField("learned", BooleanType()), StructField("scored", BooleanType()), StructField("n", LongType())])
    schema = StructType([*StructType.fromDDL("block long, n long, tokens binary, words binary, counts binary, taught binary").fields,
                         StructField("docs", ArrayType(kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        rows: list[list[pa.Array]] = []

        def flush() -> pa.RecordBatch:
            tokens, n = np.concatenate(held), np.concatenate(lens)
            columns = [pa.concat_arrays(list(c)) for c in zip(*rows, strict=True)]
            words, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            learned = np.repeat(columns[-2].to_numpy(zero_copy_only=False).astype(bool), n)
            taught = np.bincount(place[learned], minlength=len(words))
            rank = np.empty(len(words), np.int64)
            rank[_by_count(counts)] = np.arange(len(words))
            each = pa.StructArray.from_arrays([*columns, pa.array(n)], kinds.names)
            for part in (held, lens, rows):
                part.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(tokens)]), _blobs([_packed(rank[place])]), _blobs([_steps(words)]),
                 _blobs([_packed(counts)]), _blobs([_packed(taught)]),
                 pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), each)], schema.names)

        size = 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                tokens, bounds = _tokens(chunk)
                held.append(tokens)
                lens.append(np.diff(bounds))
                rows.append([c.slice(chunk.first, chunk.rows) for c in batch.columns[1:]])
                size += len(tokens)
                if size >= BLOCK:
                    yield flush()
                    number, size = number + 1, 0
        if size:
            yield flush()

    return docs.select(F.coalesce(text, F.lit("")), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)],
                       F.coalesce(learned, F.lit(False)), scored).mapInArrow(run, schema)


def _by_count(counts: np.ndarray) -> np.ndarray:
    """A block's words by descending count, equal ones by hash."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of a word: ranges of its hash, so that ascending words are ascending parts."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cuts(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Every part of an ascending list of them, and its slice."""
    for p in np.unique(part):
        yield int(p), slice(int(np.searchsorted(part, p)), int(np.searchsorted(part, p, side="right")))


def count_words(packed: DataFrame, parts: int) -> DataFrame:
    """Answers (block, part, counts, ranks, classes): training count of every word that a block sent to a part.

    A rank numbers the words of the part that have equal counts; ``classes``, in one row of each part, says how many those are.
    """
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, taught in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, n = _climb(words), _unpacked(taught)
                sent = [(p, _steps(h[at]), _packed(n[at])) for p, at in _cuts(_part(h, parts))]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, *_ in sent], pa.int32()), pa.array([block] * len(sent), pa.int64()),
                                                  _blobs([w for _, w, _ in sent]), _blobs([c for *_, c in sent])], ["part", "block", "words", "taught"])

    out = StructType.fromDDL("block long, part int, counts binary, ranks binary, classes array<struct<c:long,m:long>>")

    def answer(asked: pa.Table) -> pa.Table:
        h = [_climb(w) for w in asked.column("words").to_pylist()]
        n = np.concatenate([_unpacked(c) for c in asked.column("taught").to_pylist()])
        _, place = np.unique(np.concatenate(h), return_inverse=True)
        counts = np.bincount(place, n).astype(np.int64)
        order = np.argsort(counts, kind="stable")
        kinds, first, m = np.unique(counts[order], return_index=True, return_counts=True)
        ranks = np.empty(len(counts), np.int64)
        ranks[order] = np.arange(len(counts)) - np.repeat(first, m)
        classes = [{"c": int(c), "m": int(k)} for c, k in zip(kinds, m, strict=True) if c]
        ends = np.cumsum([len(x) for x in h])[:-1]
        return pa.Table.from_arrays(
            [asked.column("block"), asked.column("part"), _blobs([_packed(x) for x in np.split(counts[place], ends)]),
             _blobs([_packed(x) for x in np.split(ranks[place], ends)]),
             pa.array([classes] + [[]] * (len(h) - 1), pa.list_(pa.struct([("c", pa.int64()), ("m", pa.int64())])))], names=out.names)

    return packed.select("block", "words", "taught").mapInArrow(ask, "part int, block long, words binary, taught binary").groupBy(
        "part").applyInArrow(answer, out)


@dataclass
class Numbers:
    """Counts of words by their numbers: words from ``first[k]`` on have ``counts[k]`` training tokens."""

    counts: np.ndarray
    first: np.ndarray
    n: int
    v: int

    @property
    def total(self) -> float:
        return self.n + ADD * (self.v + 1)

    def count(self, number: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.first, number, side="right") - 1] if len(self.counts) else np.zeros(len(number), np.int64)


def number_words(answers: DataFrame) -> tuple[DataFrame, Numbers]:
    """Rows (block, ids): numbers of a block's words in their order, plus one (0: no training token); and what the numbers mean."""
    classes = answers.select("part", F.inline("classes"))
    each = classes.groupBy("c").agg(F.sum("m").alias("m")).toArrow()  # distinct counts: at most sqrt(2 * tokens) rows
    c, m = (each.column(k).to_numpy().astype(np.int64) for k in ("c", "m"))
    order = np.argsort(-c)
    c, m = c[order], m[order]
    numbers = Numbers(c, np.cumsum(m) - m, int((c * m).sum()), int(m.sum()))
    shared = answers.sparkSession.sparkContext.broadcast(numbers)
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = classes.withColumn("ahead", F.coalesce(F.sum("m").over(before), F.lit(0))).groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("c", "ahead"))).alias("s"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids = []
            for counts, ranks, c, ahead in zip(*(batch.column(k).to_pylist() for k in ("counts", "ranks", "c", "ahead")), strict=True):
                n, rank = _unpacked(counts).astype(np.int64), _unpacked(ranks).astype(np.int64)
                out = np.zeros(len(n), np.int64)
                has = n > 0
                if has.any():
                    base = known.first[len(known.counts) - 1 - np.searchsorted(known.counts[::-1], n[has])]
                    out[has] = base + np.array(ahead, np.int64)[np.searchsorted(np.array(c, np.int64), n[has])] + rank[has] + 1
                ids.append(_packed(out))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), _blobs(ids)], ["block", "part", "ids"])

    met = answers.join(starts, "part", "left").select("block", "part", "counts", "ranks", F.col("s.c").alias("c"), F.col("s.ahead").alias("ahead"))
    named = met.mapInArrow(name, "block long, part int, ids binary")
    return named.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("ids")).select(
        "block", F.col("ids.ids").alias("ids")), numbers


class _Block:
    """A block's tokens by number, and its bigrams."""

    def __init__(self, tokens: bytes, counts: bytes, ids: list[bytes], lens: np.ndarray, known: Numbers, parts: int):
        numbers = np.concatenate([_unpacked(x) for x in ids]).astype(np.int64) - 1
        self.tokens = numbers[_by_count(_unpacked(counts))][_unpacked(tokens).astype(np.int64)]
        self.counts = np.where(self.tokens >= 0, known.count(np.maximum(self.tokens, 0)), 0)
        self.row = np.repeat(np.arange(len(lens)), lens)
        inner = np.ones(len(self.tokens), bool)
        inner[np.cumsum(lens) - lens] = False
        cur = np.flatnonzero(inner)
        #: Tokens after a kept context, and those of them whose bigram can have been seen.
        self.after = cur[self.counts[cur - 1] >= CONTEXT]
        self.seen = self.after[self.tokens[self.after] >= 0]
        a, b = self.tokens[self.seen - 1].astype(np.uint64), self.tokens[self.seen].astype(np.uint64)
        wide = np.uint64(known.v // parts + 1)
        part, inside = (a + b) % np.uint64(parts), a * wide + b // np.uint64(parts)
        # by part, and by the two words in it
        span = known.v * int(wide)
        if span * parts < 1 << 64:
            pairs, self.place = np.unique(part * np.uint64(span) + inside, return_inverse=True)
            self.part, self.inside = (pairs // np.uint64(span or 1)).astype(np.int64), pairs % np.uint64(span or 1)
        else:
            order = np.lexsort((inside, part))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(part[order]) != 0) | (np.diff(inside[order]) != 0)
            self.place = np.empty(len(order), np.int64)
            self.place[order] = np.cumsum(new) - 1
            self.part, self.inside = part[order][new].astype(np.int64), inside[order][new]


def _each(batch: pa.RecordBatch, known: Numbers, parts: int) -> Iterator[tuple[int, _Block, pa.StructArray]]:
    for k in range(batch.num_rows):
        docs = batch.column("docs").slice(k, 1).flatten()
        tokens, counts, ids = (batch.column(c)[k].as_py() for c in ("tokens", "counts", "ids"))
        yield k, _Block(tokens, counts, ids, docs.field("n").to_numpy(), known, parts), docs


def bucket(count: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: its power of two."""
    return np.clip(np.frexp(count.astype(float))[1] - 1, 0, BUCKETS - 1).astype(np.int64)


def count_pairs(named: DataFrame, shared, parts: int) -> DataFrame:
    """Answers (block, part, counts, bins): training count of every bigram that a block sent to a part.

    ``bins``, in one row of each part, holds the tokens of its bigrams by bucket and deleted likelihood ratio.
    """
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_pylist()
            for k, b, docs in _each(batch, shared.value, parts):
                learned = docs.field("learned").to_numpy(zero_copy_only=False).astype(bool)[b.row[b.seen]]
                taught = np.bincount(b.place[learned], minlength=len(b.part))
                sent = [(p, _steps(b.inside[at]), _packed(taught[at])) for p, at in _cuts(b.part)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, *_ in sent], pa.int32()), pa.array([blocks[k]] * len(sent), pa.int64()),
                                                  _blobs([w for _, w, _ in sent]), _blobs([c for *_, c in sent])], ["part", "block", "pairs", "taught"])

    out = StructType.fromDDL("block long, part int, counts binary, bins array<struct<bucket:int,bin:int,n:long>>")

    def answer(asked: pa.Table) -> pa.Table:
        known, part = shared.value, asked.column("part")[0].as_py()
        sent = [_climb(x) for x in asked.column("pairs").to_pylist()]
        n = np.concatenate([_unpacked(c) for c in asked.column("taught").to_pylist()])
        pairs, place = np.unique(np.concatenate(sent), return_inverse=True)
        c12 = np.bincount(place, n).astype(np.int64)
        met = c12 > 0
        wide = known.v // parts + 1
        a = (pairs[met] // np.uint64(wide)).astype(np.int64)
        b = (pairs[met] % np.uint64(wide)).astype(np.int64) * parts + (part - a) % parts
        seen, c1, p1 = c12[met], known.count(a), (known.count(b) + ADD) / known.total
        again = seen > 1
        ratio = np.full(len(seen), np.iinfo(np.int32).min, np.int64)
        ratio[again] = np.round(np.log((seen[again] - 1) / (c1[again] - 1) / p1[again]) * _STEPS)
        kinds, at = np.unique(np.stack((bucket(c1), ratio)), axis=1, return_inverse=True)
        sums = np.bincount(at.reshape(-1), seen, kinds.shape[1]).astype(np.int64)
        bins = [{"bucket": int(x), "bin": None if y == np.iinfo(np.int32).min else int(y), "n": int(z)} for x, y, z in zip(*kinds, sums, strict=True)]
        ends = np.cumsum([len(x) for x in sent])[:-1]
        return pa.Table.from_arrays(
            [asked.column("block"), asked.column("part"), _blobs([_packed(x) for x in np.split(c12[place], ends)]),
             pa.array([bins] + [[]] * (len(sent) - 1), pa.list_(pa.struct([("bucket", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])))],
            names=out.names)

    return named.mapInArrow(ask, "part int, block long, pairs binary, taught binary").groupBy("part").applyInArrow(answer, out)


def learn_weights(bins: list[tuple[int, int | None, float]], rounds: int = 50) -> np.ndarray:
    """Weight of the bigram estimate per bucket, by expectation-maximisation.

    ``bins``: (bucket, binned log ratio of the deleted bigram estimate to the unigram one or NULL where it is 0, tokens).
    """
    weights = np.zeros(BUCKETS)
    for b in range(BUCKETS):
        rows = [(0.0 if k is None else float(np.exp(k / _STEPS)), n) for bucket, k, n in bins if bucket == b]
        if not rows:
            continue
        r, n = np.array([x for x, _ in rows]), np.array([y for _, y in rows], dtype=float)
        w = 0.5
        for _ in range(rounds):
            w = float((n * w * r / (w * r + 1 - w)).sum() / n.sum())
            w = min(max(w, 1e-6), 1 - 1e-6)
        weights[b] = w
    return weights


def learn_and_score(docs: DataFrame, learned: Column, carry: list[str], text_column: str = "text", scored: Column | None = None) -> DataFrame:
    """Learn from the rows of ``docs`` that fulfil ``learned`` and score those that fulfil ``scored`` (all).

    Rows (carried columns, n_tokens, n_known, train_tokens, base_score, score), one per scored row, repeated ones included.  NULL
    texts are empty: one end token.  With nothing learned every token is unknown.
    """
    spark = docs.sparkSession
    packed = stored(blocks(docs, carry, F.col(text_column), learned, F.lit(True) if scored is None else scored))
    parts = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // PART + 1
    ids, numbers = number_words(stored(count_words(packed, parts)))
    shared = spark.sparkContext.broadcast(numbers)
    named = packed.select("block", "tokens", "counts", "docs").join(stored(ids), "block")
    answers = stored(count_pairs(named, shared, parts))
    bins = answers.select(F.inline("bins")).groupBy("bucket", "bin").agg(F.sum("n")).collect()  # buckets times bins: a few thousand at most
    weights = learn_weights([(r[0], r[1], float(r[2])) for r in bins])
    pairs = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", F.col("counts").alias("c")))).alias("found")).select(
        "block", F.col("found.c").alias("found"))
    schema = with_columns(docs, carry, "n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for k, b, docs in _each(batch, known, parts):
                p1 = (b.counts + ADD) / known.total
                base = np.log10(p1)
                c12 = np.zeros(len(b.tokens))
                found = batch.column("found")[k].as_py()
                if found:
                    c12[b.seen] = np.concatenate([_unpacked(x) for x in found])[b.place]
                c1 = b.counts[b.after - 1]
                w = weights[bucket(c1)]
                mixed = base.copy()
                mixed[b.after] = np.log10(w * c12[b.after] / c1 + (1 - w) * p1[b.after])
                rows = len(docs)
                sums = [pa.array(docs.field("n")), pa.array(np.bincount(b.row[b.counts > 0], minlength=rows).astype(np.int64)),
                        pa.array(np.full(rows, known.n, np.int64)), pa.array(np.bincount(b.row, base, rows)), pa.array(np.bincount(b.row, mixed, rows))]
                out = pa.RecordBatch.from_arrays([*(docs.field(f"c{i}") for i in range(len(carry))), *sums], schema.names)
                yield out.filter(docs.field("scored"))

    return named.join(pairs, "block", "left").mapInArrow(run, schema)


@dataclass
class Model:
    """The documents to learn from; they are counted together with those that are scored."""

    docs: DataFrame
    text_column: str


def train(docs: DataFrame, text_column: str = "text") -> Model:
    return Model(docs, text_column)


def score(docs: DataFrame, model: Model, carry: list[str], text_column: str = "text") -> DataFrame:
    """Like :func:`learn_and_score` where the documents to learn from are another table."""
    own = docs.select(F.struct(*carry).alias("kept"), F.col(text_column).alias("text"), F.lit(False).alias("learned"))
    others = model.docs.select(F.lit(None).cast(own.schema["kept"].dataType).alias("kept"), F.col(model.text_column).alias("text"), F.lit(True).alias("learned"))
    out = learn_and_score(own.unionByName(others), F.col("learned"), ["kept"], "text", ~F.col("learned"))
    return out.select("kept.*", *[c for c in out.columns if c != "kept"])
