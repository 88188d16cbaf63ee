"""Host-level quality rules: a host whose documents fail a rule too often loses all of them.

Every document is judged by two rules on its own text.  Per host the failures of each rule are counted; the raw rate is
shrunk towards the corpus by a beta prior fitted to all hosts (method of moments), so that hosts with few documents are not
judged on chance.  A host whose shrunk rate exceeds ``HOST_LIMIT`` for any rule is rejected and the verdict is joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.llm.shared import cut
from crewlake.llm.textbytes import KEEP, LETTER, Chunk, chunks, gram_hashes, mix, power_of, windows

MIN_WORDS = 50
REPEAT_PERCENT = 50
HOST_LIMIT = 0.5
SYMBOLS = b"#*$%&|<>"
RULES = ("short", "repeats")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_HEAD = np.ones(256, np.int64)
_HEAD[0x80:0xC0] = 0  # continuation bytes belong to the code point before them


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_lines(chunk: Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if n == 0:
        return np.zeros(chunk.rows, np.int64)
    newline = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((offsets[:-1], newline + 1)))
    starts = starts[starts < n]
    ends = np.append(starts[1:], n)
    ends = ends - (data[ends - 1] == 10)  # a line does not hold its \\n
    row = np.searchsorted(offsets, starts, side="right") - 1
    word_at = chunk.bounds[0]
    has_word = np.searchsorted(word_at, starts) < np.searchsorted(word_at, ends)
    starts, ends, row = starts[has_word], ends[has_word], row[has_word]
    if not len(starts):
        return np.zeros(chunk.rows, np.int64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
    values = LETTER[data[pos + np.repeat(starts, lens)]] * power_of(pos)
    h = mix(np.add.reduceat(values, at) + lens.astype(np.uint64)) + row.astype(np.uint64) * LETTER[7]
    _, first = np.unique(h, return_index=True)
    again = np.ones(len(h), bool)
    again[first] = False
    return np.bincount(row[again], minlength=chunk.rows).astype(np.int64)


def _repeated_words(chunk: Chunk) -> np.ndarray:
    """Words inside 3-word windows that occur twice or more in their row."""
    words, at = chunk.hashes(KEEP), chunk.word_offsets
    ok = windows(words, at, 3)
    starts = np.flatnonzero(ok)
    if not len(starts):
        return np.zeros(chunk.rows, np.int64)
    row = chunk.word_rows
    h = mix(gram_hashes(words, 3)[starts] + row[starts].astype(np.uint64) * LETTER[7])
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    many = starts[n[back] > 1]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[many + k] = True
    return np.bincount(row[covered], minlength=chunk.rows).astype(np.int64)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, carry: list[str], text_column: str = "text") -> DataFrame:
    """Carried columns and the counts of every whole text (NULL: all 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                parts.append(np.stack([
                    np.diff(chunk.word_offsets), _per_row(_HEAD[chunk.data] * chunk._solid, chunk.offsets),
                    _per_row(_SYMBOL[chunk.data], chunk.offsets), _repeated_lines(chunk), _repeated_words(chunk)]))
            table = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, table.astype(np.int64))],
                                             [*batch.schema.names[:-1], *COUNTS])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), *(f"{c} long" for c in COUNTS)])
    return docs.select(*carry, F.coalesce(F.col(text_column), F.lit("")).alias("_text")).mapInArrow(run, schema)


def host_verdicts(failures: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Rows (host, rule, n, failed, rate, host_ok) from (host, rule, n, failed).

    Prior per rule: mean and variance of the hosts' raw rates give a beta distribution; where the variance is 0 or too
    large for one (or there is a single host), the prior is the mean with the weight of one document.
    """
    rate = F.col("failed") / F.col("n")
    prior = failures.groupBy("rule").agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    weight = F.when((F.col("v") > 0) & (F.col("v") < F.col("m") * (1 - F.col("m"))),
                    F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(1.0)
    shrunk = (F.col("failed") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w"))
    return (failures.join(F.broadcast(prior.withColumn("w", weight).drop("v")), "rule")  # one row per rule
            .withColumn("rate", shrunk).withColumn("host_ok", F.col("rate") <= limit)
            .select("host", "rule", "n", "failed", "rate", "host_ok"))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
          limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: id, counts, base_failed, host_rate (highest shrunk rate of the host's rules), kept.

    base_failed: fewer than ``MIN_WORDS`` words, or over ``REPEAT_PERCENT`` of the words in repeated windows.  kept is false
    where base_failed, else true unless the host is rejected.  A NULL host has no host verdict (host_rate is NULL).  Repeated
    rows count as often as they occur.
    """
    counted = measure(docs.select(F.col(id_column).alias("_id"), F.col(host_column).alias("_host"), F.col(text_column).alias("_text")),
                      ["_id", "_host"], "_text")
    counted = cut(counted)
    short, repeats = F.col("n_words") < MIN_WORDS, 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    per_host = (counted.filter("_host is not null").groupBy(F.col("_host").alias("host"))
                .agg(F.count("*").alias("n"), F.sum(short.cast("int")).alias("short"), F.sum(repeats.cast("int")).alias("repeats"))
                .selectExpr("host", "n", "stack(2, 'short', short, 'repeats', repeats) as (rule, failed)"))
    hosts = host_verdicts(per_host, limit).groupBy("host").agg(F.max("rate").alias("host_rate"), F.min("host_ok").alias("host_ok"))
    return (counted.withColumn("base_failed", short | repeats).join(hosts, F.col("_host") == F.col("host"), "left")
            .select(F.col("_id").alias(id_column), *COUNTS, "base_failed", "host_rate",
                    (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept")))
