"""Language identification by cross-parsing entropy.

A suffix automaton is built per language over a bounded sample of labelled text.  A text is parsed against each: the next
phrase is the longest match of what follows with any place of that language's text (one symbol where nothing matches).  The
fewer phrases a language needs, the better its text predicts the given one; phrase counts are normalised by the size of
the language's text (log2 of its length, the cost of pointing into it) and by the length of the given text.

Automata are dense tables over the bytes that occur in the samples, with the restart after a mismatch folded in, so that
all blocks of all texts and all languages take one step together.  Texts are parsed whole, in blocks of ``BLOCK`` bytes; a
phrase ends with its block, for every language alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.llm.textbytes import FOLD, chunks

#: Bounds of the learning sample: texts per language, bytes of each text, bytes per language.
SAMPLE_TEXTS, TEXT_BYTES, LANGUAGE_BYTES = 16, 2048, 24_000
BLOCK = 1024
LANES = 4096
UNDETERMINED = "und"

#: Bytes that are no letters count as one blank: digits, punctuation and layout say little about a language.
_PLAIN = FOLD.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32


class SuffixAutomaton:
    """Smallest automaton that accepts every substring of the added symbols."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, c: int) -> None:
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[self.last] + 1)
        self.link.append(0)
        p = self.last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            if self.length[p] + 1 == self.length[q]:
                self.link[cur] = q
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p != -1 and self.next[p].get(c) == q:
                    self.next[p][c] = copy
                    p = self.link[p]
                self.link[q] = self.link[cur] = copy
        self.last = cur


class CrossParser:
    """Automata of all languages in one table: entry = 4 * (row of the next state) + phrases that end here."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        texts = {lang: _PLAIN[np.frombuffer(b"\n".join(samples[lang]), dtype=np.uint8)] for lang in self.languages}
        seen = np.unique(np.concatenate([*texts.values(), np.array([32], np.uint8)])) if texts else np.array([32], np.uint8)
        self.symbol = np.zeros(256, dtype=np.uint8)  # 0: a byte that no sample has
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.symbol = self.symbol[_PLAIN]
        width = self.width = len(seen) + 1
        tables, self.starts, self.cost, base = [], [], [], 0
        for lang in self.languages:
            sam = SuffixAutomaton()
            for c in self.symbol[texts[lang]].tolist():
                sam.add(c)
            root = np.zeros(width, dtype=np.int64)  # a symbol that the language lacks is a phrase of its own
            for c, to in sam.next[0].items():
                root[c] = to
            restart = (root + base) * width * 4 + (root == 0)
            table = np.broadcast_to(restart + 1, (len(sam.next), width)).copy()
            table[0] = restart  # no phrase is cut off here
            for state, edges in enumerate(sam.next):
                for c, to in edges.items():
                    table[state, c] = (to + base) * width * 4
            tables.append(table)
            self.starts.append(base * width)
            self.cost.append(np.log2(max(2, len(texts[lang]))))
            base += len(sam.next)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
        if len(self.table) and self.table.max() < 2 ** 31:
            self.table = self.table.astype(np.int32)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases that each language (column) needs for each row of bytes."""
        counts = np.zeros((len(offsets) - 1, len(self.languages)), dtype=np.int64)
        symbols = self.symbol[data]
        lens = np.diff(offsets)
        pieces = -(-lens // BLOCK)
        row = np.repeat(np.arange(len(lens)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[row] + nth * BLOCK
        size = np.minimum(BLOCK, offsets[row + 1] - start)
        order = np.argsort(-size, kind="stable")
        first = np.array(self.starts, dtype=self.table.dtype)
        for i in range(0, len(order), LANES):
            some = order[i: i + LANES]
            n = size[some]
            at = np.minimum(start[some][None, :] + np.arange(int(n[0]))[:, None], len(symbols) - 1)
            grid = symbols[at]
            state = np.repeat(first, len(some)).reshape(len(first), -1)
            ended = np.ones(state.shape, dtype=np.int32)  # the last phrase of a block ends with it
            active = np.searchsorted(-n, -np.arange(int(n[0])), side="left")  # blocks longer than each step
            for t in range(int(n[0])):
                k = int(active[t])
                v = self.table[state[:, :k] + grid[t, :k]]
                ended[:, :k] += v & 3
                state[:, :k] = v >> 2
            np.add.at(counts, row[some], ended.T)
        return counts


def learn(docs: DataFrame, lang_column: str = "lang", id_column: str = "doc_id", text_column: str = "text",
          texts: int = SAMPLE_TEXTS, text_bytes: int = TEXT_BYTES, language_bytes: int = LANGUAGE_BYTES) -> CrossParser:
    """Automata from labelled rows: per language the lowest id hash of each of ``texts`` hash buckets, cut to the bounds.

    Rows without label or text are left out.  The sample is picked on ids and labels alone, before texts are read.
    """
    key = F.xxhash64(F.col(id_column).cast("string"))
    labelled = docs.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & (F.length(text_column) > 0))
    keyed = labelled.select(F.col(lang_column).alias("lang"), key.alias("key"), F.pmod(key, F.lit(texts)).alias("slot"))
    picked = keyed.groupBy("lang", "slot").agg(F.min("key").alias("key")).select("lang", "key")
    rows = (labelled.select(F.col(lang_column).alias("lang"), key.alias("key"),
                            F.substring(text_column, 1, text_bytes).alias("text"))
            .join(picked, ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"]).orderBy("lang", "key"))
    samples: dict[str, list[bytes]] = {}
    for lang, text in rows.select("lang", "text").toLocalIterator():  # at most ``texts`` short texts per language
        kept = samples.setdefault(lang, [])
        room = language_bytes - sum(map(len, kept))
        if room > 0:
            kept.append(text.encode()[: min(text_bytes, room)])
    return CrossParser(samples)


def predict(docs: DataFrame, parser: CrossParser, id_column: str = "doc_id", text_column: str = "text",
            carry: list[str] | None = None) -> DataFrame:
    """Rows (carried columns, lang_pred, score) for every document.

    ``und`` and score 0 where the text is NULL or has no letter, or no language was learned.  The score is the lead of the
    winner over the second language, as a share of the second's entropy.  Equal entropies go to the first name.
    """
    carry = [id_column] if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    names = pa.array([*parser.languages, UNDETERMINED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cost = np.array(model.cost)
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            best = np.full(batch.num_rows, len(model.languages))
            score = np.zeros(batch.num_rows)
            if model.languages:
                for chunk in chunks(batch.column(batch.num_columns - 2), LANES * BLOCK):
                    bits = model.phrases(chunk.data, chunk.offsets) * cost
                    order = np.argsort(bits, axis=1, kind="stable")
                    low = np.take_along_axis(bits, order[:, :1], 1)[:, 0]
                    second = np.take_along_axis(bits, order[:, 1:2], 1)[:, 0] if bits.shape[1] > 1 else low * 2
                    best[chunk.first: chunk.last] = order[:, 0]
                    score[chunk.first: chunk.last] = 1 - low / np.maximum(second, 1)
            best[~letters] = len(model.languages)
            score[~letters] = 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], names.take(pa.array(best)), pa.array(np.clip(score, 0, 1))],
                [*batch.schema.names[:-2], "lang_pred", "score"])

    text = F.coalesce(F.col(text_column), F.lit(""))
    inner = docs.select(*carry, text.alias("_text"), text.rlike(r"\p{L}").alias("_letters"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "lang_pred string", "score double"])
    return inner.mapInArrow(run, schema)
