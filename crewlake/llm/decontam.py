"""Benchmark decontamination by template canonicalisation.

Every word is mapped to its template form: numbers (in digits or words), numbers with a unit, units and capitalised words
(names, and the first words of sentences) become typed placeholders, a run of numbers or of names one of them; all others stay
as lower-cased words without outer punctuation.  Windows of ``WIDTH`` template words of the documents are hash-joined with
those of the benchmark, so a question asked again with other numbers or names still meets its original.  A match must then be a
re-parameterisation: along one alignment of document and item, equal slot values of the item must stand for equal values of
the document and the other way round.

Next to the templates, windows of the words themselves, lower-cased, are joined: they find copies whose case alone differs and
those of items that are mostly numbers and names, for which a template would say too little.

A document is contaminated by an item if alignments of either form cover at least ``COVERAGE`` of the item's windows of that
form, or if it holds ``LONG`` words of the item in a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.llm.shared import HashFilter, cut, free_name
from crewlake.llm.textbytes import KEEP, Chunk, chunks, gram_hashes, mix, windows

WIDTH = 8
COVERAGE = 0.5
LONG = 40
CONFLICTS = 0.1
FILTER_BITS = 24
UNITS = frozenset(
    "mg g kg t mm cm m km ml cl l inch inches foot feet yard yards mile miles gram grams kilogram kilograms ton tons tonne tonnes "
    "litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar "
    "dollars euro euros pound pounds percent degree degrees watt watts volt volts".split())
SPELLED = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_NUMBER = re.compile(r"\d[\d.,:/]*")
_MEASURE = re.compile(r"\d[\d.,]*[^\W\d_]+")
LITERAL, NUMBER, MEASURE, UNIT, NAME = range(5)
_PLACEHOLDER = mix(np.arange(5, dtype=np.uint64) + np.uint64(77))


def canonical(word: str) -> tuple[int, str]:
    """Type of a word and its value: the word itself for literals, what fills the slot for placeholders."""
    core = word.strip(_OUTER)
    if not core:
        return LITERAL, word
    low = core.lower()
    if _NUMBER.fullmatch(core) or all(x in SPELLED for x in low.split("-")):
        return NUMBER, low
    if _MEASURE.fullmatch(core):
        return MEASURE, low
    if low in UNITS:
        return UNIT, low
    return (NAME if core[0].isupper() else LITERAL), low


TEMPLATE, WORDS = range(2)


def _forms(chunk: Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per form: token hashes, slot value hashes (0 for literals, and for all words as they are), and row bounds in them."""
    starts, ends = chunk.bounds
    _, first, back = np.unique(chunk.hashes(KEEP), return_index=True, return_inverse=True)
    raw = chunk.data.tobytes()
    kinds = np.zeros(len(first), np.int64)
    values = np.zeros(len(first), np.uint64)
    for k, (a, b) in enumerate(zip(starts[first].tolist(), ends[first].tolist())):
        kinds[k], value = canonical(raw[a:b].decode("utf-8", "replace"))
        values[k] = xxhash.xxh64_intdigest(value)
    at, kind, value = chunk.word_offsets, kinds[back], values[back]
    yield WORDS, mix(value + np.uint64(1)), np.zeros(len(value), np.uint64), at
    if not len(kind):
        return
    again = np.concatenate(([False], (kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME))))
    again[at[:-1][at[:-1] < len(kind)]] = False
    head = np.flatnonzero(~again)
    run = np.arange(len(kind)) - np.repeat(head, np.diff(np.append(head, len(kind))))
    slot = np.add.reduceat(np.where(run > 0, mix(value + run.astype(np.uint64)), value), head)
    kind, value = kind[head], value[head]
    yield (TEMPLATE, np.where(kind == LITERAL, value, _PLACEHOLDER[kind]), np.where(kind == LITERAL, np.uint64(0), slot | np.uint64(1)),
           np.searchsorted(head, at))


def template_windows(texts: DataFrame, id_column: str, text_column: str, widths: list[tuple[int, int]] | int,
                     known: HashFilter | None = None) -> DataFrame:
    """Rows (id, text_key, form, width, pos, window, slots) of windows; in templates at least half must be literals.

    ``widths``: pairs (form, width) to look at everywhere, or the one width of an item, which shorter items have as a whole.
    With ``known`` only windows that may be in it are given.
    """
    shared = texts.sparkSession.sparkContext.broadcast((widths, known))
    kind = texts.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, known = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(2), 1 << 22):
                for form, token, slot, offsets in _forms(chunk):
                    sizes = np.diff(offsets)
                    rows = np.repeat(np.arange(chunk.rows), sizes)
                    literal = np.concatenate(([0], np.cumsum(slot == 0)))
                    for width in range(1, widths + 1) if isinstance(widths, int) else [w for f, w in widths if f == form]:
                        h = gram_hashes(token, width)
                        if not len(h):
                            continue
                        ok = windows(token, offsets, width)[: len(h)]
                        if form == TEMPLATE:
                            ok &= 2 * (literal[width:] - literal[:-width]) >= width
                        if isinstance(widths, int) and width < widths:
                            ok &= sizes[rows[: len(h)]] == width
                        at = np.flatnonzero(ok)
                        if known is not None:
                            at = at[known.has(h[at])]
                        if not len(at):
                            continue
                        row = rows[at]
                        slots = slot[at[:, None] + np.arange(width)].view(np.int64)
                        which = pa.array(chunk.first + row)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(which), batch.column(1).take(which), pa.array(np.full(len(at), form, np.int32)),
                             pa.array(np.full(len(at), width, np.int32)), pa.array((at - offsets[row]).astype(np.int32)), pa.array(h[at].view(np.int64)),
                             pa.ListArray.from_arrays(pa.array(np.arange(0, slots.size + 1, width, dtype=np.int32)), pa.array(slots.ravel()))],
                            ["id", "text_key", "form", "width", "pos", "window", "slots"])

    text = F.coalesce(F.col(text_column), F.lit(""))
    return texts.select(id_column, F.xxhash64(text).alias("_key"), text.alias("_text")).mapInArrow(
        run, f"id {kind}, text_key long, form int, width int, pos int, window long, slots array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                 width: int = WIDTH, coverage: float = COVERAGE, conflicts: float = CONFLICTS, filter_bits: int = FILTER_BITS, long: int = LONG) -> DataFrame:
    """Rows (id, text_key, item, windows, item_windows, coverage, changed_slots) of every contaminated document and item.

    Items of fewer than ``width`` words are matched as one window; NULL and empty texts match nothing.  Windows and coverage are
    those of the form that covers more.  Repeated documents and items give equal rows once.  A NULL id keeps its rows; text_key
    (hash of the text) tells which text is meant.
    """
    items = benchmark.filter(F.col(text_column).isNotNull())
    given = cut(template_windows(items, item_column, text_column, width).dropDuplicates(["id", "text_key", "form", "pos"]))
    widths = sorted(tuple(r) for r in given.select("form", "width").distinct().collect())  # at most 2 * ``width`` pairs
    totals = given.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("form").alias("_form")).agg(
        F.count("*").alias("item_windows"))
    known = HashFilter.of(given, "window", filter_bits)
    side = (given.join(totals, (F.col("text_key") == F.col("_key")) & (F.col("form") == F.col("_form")) & F.col("id").eqNullSafe(F.col("_id"))).select(
        F.col("id").alias("item"), F.col("text_key").alias("item_key"), F.col("pos").alias("item_pos"), "form", "width", "window",
        F.col("slots").alias("item_slots"), "item_windows"))
    hits = template_windows(docs, id_column, text_column, widths, known)
    line = ["id", "text_key", "item", "item_key", "form", "width", "shift", "item_windows"]
    met = (hits.join(side, ["form", "width", "window"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
           .withColumn("pair", F.filter(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda x: x["a"] != 0)))
    # one alignment has at most as many slots as the item
    aligned = met.groupBy(*line).agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("pair"))).alias("pairs"))
    clash = 2 * F.size("pairs") - F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"]))) - F.size(
        F.array_distinct(F.transform("pairs", lambda x: x["b"])))
    good = aligned.filter(clash <= conflicts * F.size("pairs")).withColumn(
        "changed", F.size(F.filter("pairs", lambda x: x["a"] != x["b"]))).withColumn("row", F.expr(
            "aggregate(array_sort(at), named_struct('p', -2, 'n', 0, 'm', 0), (s, x) -> named_struct('p', x, 'n', if(x = s.p + 1, s.n + 1, 1),"
            " 'm', greatest(s.m, if(x = s.p + 1, s.n + 1, 1)))).m") + F.col("width") - 1)
    found = good.groupBy("id", "text_key", "item", "item_key", "form", "item_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("windows"), F.max("changed").alias("changed_slots"),
        F.max(F.when(F.col("form") == WORDS, F.col("row"))).alias("row")).withColumn("coverage", F.col("windows") / F.col("item_windows"))
    found = found.filter((F.col("coverage") >= coverage) | (F.col("row") >= long)).groupBy("id", "text_key", "item", "item_key").agg(
        F.max(F.struct("coverage", "windows", "item_windows")).alias("best"), F.max("changed_slots").alias("changed_slots"))
    return found.select(F.col("id").alias(id_column), "text_key", F.col("item").alias(item_column), "best.windows", "best.item_windows",
                        "best.coverage", "changed_slots")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The documents whose text no benchmark item contaminates, all columns and repeated rows kept."""
    name = free_name(docs, "_text_key")
    keys = contaminated(docs, benchmark, text_column=text_column, **options).select(F.col("text_key").alias(name)).distinct()
    return docs.join(keys, F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))) == F.col(name), "left_anti")
