"""Many fixed patterns in whole texts (T5, T11): Aho-Corasick automata over shards of a dictionary of any size.

A text is read once per shard, whatever the number of patterns in it.  A shard's patterns are sent to the tasks, and its size
is counted before: ``SHARD`` bounds what is broadcast, a larger dictionary makes more passes.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlake.session import kept

#: Characters of patterns in one automaton.
SHARD = 4_000_000
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, patterns: list[str]) -> ahocorasick.Automaton:
    """The automaton of a shard; a worker builds it once."""
    if name not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        for k, pattern in enumerate(patterns):
            found.add_word(pattern, k)
        found.make_automaton()
        _built[name] = found
    return _built[name]


def find_patterns(texts: DataFrame, patterns: DataFrame, text_column: str = "text", shard: int = SHARD) -> DataFrame:
    """Rows of ``texts`` without their text, plus (pattern, hits): every pattern that a text contains, and how often.

    ``patterns`` has a column ``pattern``; places may overlap.  Both sides are compared as they are.  NULL and empty texts and
    patterns match nothing; a repeated row is searched on its own.
    """
    spark = texts.sparkSession
    words = kept(patterns.select("pattern").filter("pattern <> ''").distinct())
    size = words.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard))
    carried = [c for c in texts.columns if c != text_column]
    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in carried)
    parts = []
    for number in range(shards):
        some = words.filter(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == number).toArrow().column(0).to_pylist()  # about ``shard`` characters
        if some or not parts:
            parts.append(texts.select(*carried, text_column).mapInArrow(_search(spark.sparkContext.broadcast(some), len(carried)),
                                                                        f"{schema}, pattern string, hits long"))
    return reduce(DataFrame.unionByName, parts)


def _search(shared, carried: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        found = _automaton(name, names) if names else None
        for batch in batches:
            row, which, hits = [], [], []
            for k, text in enumerate(batch.column(carried)):
                if found is not None and text.is_valid:
                    for pattern, n in Counter(p for _, p in found.iter(text.as_py())).items():
                        row.append(k)
                        which.append(names[pattern])
                        hits.append(n)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(carried)], pa.array(which, pa.string()), pa.array(hits, pa.int64())],
                                             [*batch.schema.names[:carried], "pattern", "hits"])
    return run


def spoken(c: Column | str) -> Column:
    """A text as its words: runs of ASCII letters and digits in lower case, a space before and after each."""
    words = F.regexp_extract_all(F.lower(F.col(c) if isinstance(c, str) else c), F.lit("[a-z0-9]+"), 0)
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def named_in(texts: DataFrame, vocab: DataFrame, text_column: str = "text", shard: int = SHARD) -> DataFrame:
    """T5 over whole texts: rows of ``texts`` without their text, plus (type, value, hits) for every name said in them.

    A name of the dictionary (type, value) is said where its words stand next to each other, whatever stands between words.
    """
    names = vocab.select("type", "value", spoken("value").alias("pattern")).filter("pattern <> '  '").distinct()
    found = find_patterns(texts.withColumn(text_column, spoken(text_column)), names, text_column, shard)
    return found.join(names, "pattern").drop("pattern")
