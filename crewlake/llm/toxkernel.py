"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel compares two words by all subsequences of ``ORDER`` letters they share; an occurrence that spans l characters
weighs ``DECAY`` ** l, so an insult still matches with characters inserted, dropped or replaced.  Words get a begin and an
end mark, characters that are no letters only widen gaps, and three or more single characters in a row (letters spaced out)
are read as one more word.

Fitting takes a bounded sample of labelled texts to the driver: words that tell toxic texts from clean ones witness the
positive class, words of clean texts the negative one.  Nystroem features against the landmark words feed a squared-hinge
SVM; since the kernel is a scalar product of subsequence weights, landmarks and SVM fold into one table of subsequence
weights, and scoring a word needs no landmark at all.  A text is scored on its whole vocabulary: a logistic curve over
its best two margins and its number of positive words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.llm.shared import is_test_fold, with_columns
from crewlake.llm.textbytes import KEEP, chunks, mix

ORDER, DECAY = 3, 0.6
#: Bounds of the learning sample: labelled texts per class, and characters of a text that may be in it.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
LANDMARKS, CLEAN_WORDS, HARD_WORDS = 160, 6000, 3000
#: Classes of letters, and how many of them rarer letters share where a sample has more letters than classes.
LETTERS, SHARED_LETTERS = 60, 16
RIDGE = 1e-2
MINING = 3  # rounds of adding hard clean words
SHORT = 24  # words up to this length go through index tables, longer ones through the recurrence
THRESHOLD = 0.3
_BEGIN, _FINISH = 1, 2
SCORE_CHUNK, FIT_CHUNK = 1 << 21, 1 << 19


@dataclass
class Words:
    """Distinct words as rows of letter classes: ``codes`` joined, ``ends`` their bounds (marks included)."""

    codes: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], classes: np.ndarray) -> Words:
        text = b"\n".join(words).decode("utf-8", "replace").lower() + "\n"
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        stops = np.flatnonzero(points == 10)
        codes = classes[points]
        starts = np.concatenate(([0], stops[:-1] + 1))
        letters = np.flatnonzero(codes)
        # drop what is no letter at either end
        first = np.searchsorted(letters, starts)
        last = np.searchsorted(letters, stops) - 1
        some = last >= first
        padded = np.append(letters, 0)
        a = np.where(some, padded[np.minimum(first, len(letters))], starts)
        b = np.where(some, padded[np.maximum(np.minimum(last, len(letters)), 0)] + 1, starts)
        lens = np.where(some, b - a + 2, 0)
        bounds = np.concatenate(([0], np.cumsum(lens)))
        out = np.zeros(int(bounds[-1]), dtype=np.uint8)
        inner = np.maximum(lens - 2, 0)
        pos = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner)
        out[np.repeat(bounds[:-1] + 1, inner) + pos] = codes[np.repeat(a, inner) + pos]
        out[bounds[:-1][some]] = _BEGIN
        out[bounds[1:][some] - 1] = _FINISH
        return cls(out, bounds)

    def groups(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, indices, matrix of codes) of all words of each length up to ``SHORT``."""
        lens = np.diff(self.bounds)
        for n in range(3, SHORT + 1):
            at = np.flatnonzero(lens == n)
            step = max(1, (1 << 20) // (n * n * n))
            for i in range(0, len(at), step):
                some = at[i: i + step]
                yield n, some, self.codes[self.bounds[some][:, None] + np.arange(n)]

    def long(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in np.flatnonzero(np.diff(self.bounds) > SHORT):
            yield int(i), self.codes[self.bounds[i]: self.bounds[i + 1]]


SIDE = LETTERS + 4
_TRIPLES = {n: np.array(list(combinations(range(n), 3))) for n in range(3, SHORT + 1)}


def _self_kernel(codes: np.ndarray) -> np.ndarray:
    """K(x, x) of words of one length: sums over matching position pairs, discounted by what lies between."""
    n = codes.shape[1]
    gap = np.tril(DECAY ** np.subtract.outer(np.arange(n), np.arange(n)).clip(0), -1).astype(np.float32)
    same = ((codes[:, :, None] == codes[:, None, :]) & (codes[:, :, None] > 0)).astype(np.float32)
    b = same * np.float32(DECAY * DECAY)
    for _ in range(ORDER - 1):
        b = same * (gap @ b @ gap.T)
    return b.sum(axis=(1, 2), dtype=np.float64)


def _features(codes: np.ndarray) -> np.ndarray:
    """Weights of all subsequences of one word, by the recurrence over its characters."""
    one, two = np.zeros(SIDE), np.zeros((SIDE, SIDE))
    three = np.zeros((SIDE, SIDE, SIDE))
    for c in codes.tolist():
        if c:
            three[:, :, c] += two * DECAY
            two *= DECAY
            two[:, c] += one * DECAY
            one *= DECAY
            one[c] += DECAY
        else:
            two *= DECAY
            one *= DECAY
    return three.ravel()


def margins(words: Words, table: np.ndarray, bias: float) -> np.ndarray:
    """SVM margin of every word; words without a letter get -inf."""
    out = np.full(len(words.bounds) - 1, -np.inf)
    flat = table.astype(np.float32)
    for n, at, codes in words.groups():
        t = _TRIPLES[n]
        c = codes.astype(np.int32)
        value = np.zeros(len(at), np.float32)
        for k in range(0, len(t), 256):
            i, j, m = t[k: k + 256].T
            value += flat[(c[:, i] * SIDE + c[:, j]) * SIDE + c[:, m]] @ (DECAY ** (m - i + 1)).astype(np.float32)
        norm = np.sqrt(_self_kernel(codes))
        out[at] = np.where(norm > 0, value / np.maximum(norm, 1e-12), 0) + bias
    for i, codes in words.long():
        phi = _features(codes)
        norm = np.sqrt((phi * phi).sum())
        out[i] = (phi @ table / norm if norm > 0 else 0) + bias
    return out


def landmark_kernel(words: Words, phi: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Normalised kernel of every word (row) with every landmark, given as a column of subsequence weights.

    ``row_of`` has the row of each subsequence in ``phi``, 0 for those no landmark has.
    """
    out = np.zeros((len(words.bounds) - 1, phi.shape[1]), np.float32)
    for n, at, codes in words.groups():
        t = _TRIPLES[n]
        c = codes.astype(np.int32)
        value = np.zeros((len(at), phi.shape[1]), np.float32)
        for i, j, m in t:
            value += phi[row_of[(c[:, i] * SIDE + c[:, j]) * SIDE + c[:, m]]] * np.float32(DECAY ** (m - i + 1))
        out[at] = value / np.maximum(np.sqrt(_self_kernel(codes)), 1e-12)[:, None]
    for i, codes in words.long():
        own = _features(codes)
        some = np.flatnonzero(own)
        out[i] = own[some] @ phi[row_of[some]] / max(np.sqrt((own * own).sum()), 1e-12)
    return out


def _vocabulary(texts: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """All distinct words, and for each text the numbers of its own."""
    number: dict[bytes, int] = {}
    own = [np.unique(np.array([number.setdefault(w, len(number)) for w in t.lower().split()], dtype=np.int64)) for t in texts]
    return list(number), own


@dataclass
class ToxicModel:
    classes: np.ndarray
    table: np.ndarray
    bias: float
    curve: np.ndarray

    def probability(self, shape: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.column_stack((np.ones(len(shape)), shape)) @ self.curve, -35, 35)))

    def text_shape(self, column: pa.Array, size: int = SCORE_CHUNK) -> np.ndarray:
        """Per text: best margin, second best margin (both clipped to -2..2), log of 1 + number of positive words."""
        out = np.tile(np.array([-2.0, -2.0, 0.0]), (len(column), 1))
        for chunk in chunks(column, size):
            starts, ends = chunk.bounds
            if not len(starts):
                continue
            raw = chunk.data.tobytes()
            h, rows = chunk.hashes(KEEP), chunk.word_rows
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            m = np.clip(margins(Words.of([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], self.classes),
                                self.table, self.bias), -2, 2)[back]
            spaced, owner = _spaced_out(raw, starts, ends, rows)
            if spaced:
                m = np.concatenate((m, np.clip(margins(Words.of(spaced, self.classes), self.table, self.bias), -2, 2)))
                rows = np.concatenate((rows, owner))
                order = np.argsort(rows, kind="stable")
                m, rows = m[order], rows[order]
            cut = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            who = chunk.first + rows[cut]
            best = np.maximum.reduceat(m, cut)
            out[who, 0] = best
            top = m == np.repeat(best, np.diff(np.append(cut, len(m))))
            several = np.add.reduceat(top.astype(np.int64), cut) > 1
            rest = np.maximum.reduceat(np.where(top, -2.0, m), cut)
            out[who, 1] = np.where(several, best, rest)
            out[who, 2] = np.log1p(np.add.reduceat((m > 0).astype(np.int64), cut))
        return out


def _spaced_out(raw: bytes, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Runs of three or more words of one code point, joined, and their rows."""
    heads = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    one = heads[ends] - heads[starts] == 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], one.view(np.int8), [0]))))
    words, owner = [], []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        while b - a >= 3:
            last = a + int(np.searchsorted(rows[a:b], rows[a], side="right"))
            if last - a >= 3:
                words.append(b"".join(raw[s:e] for s, e in zip(starts[a:last].tolist(), ends[a:last].tolist())))
                owner.append(int(rows[a]))
            a = last
    return words, np.array(owner, dtype=np.int64)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Squared-hinge linear SVM with bias (last entry), by Newton steps on the rows inside the margin."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    damp = np.full(x.shape[1], ridge)
    for _ in range(50):
        on = y * (x @ w) < 1
        a = x[on] * weight[on][:, None]
        new = np.linalg.solve(a.T @ x[on] + np.diag(damp), a.T @ y[on])
        if np.allclose(new, w, atol=1e-10):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def _word_svm(insults: list[bytes], clean: list[bytes], marks: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, float]:
    """Subsequence weights and bias of the SVM of insults against clean words, on Nystroem features of the landmarks."""
    units = Words.of(marks, classes)
    units_at = [units.codes[units.bounds[i]: units.bounds[i + 1]] for i in range(len(marks))]
    units_at = [c for c in units_at if len(c)]
    # subsequences that some landmark has, one row each; row 0 stands for all others
    held = []
    for c in units_at:
        own = _features(c)
        some = np.flatnonzero(own)
        held.append((some, own[some] / max(np.sqrt((own * own).sum()), 1e-12)))
    codes = np.unique(np.concatenate([some for some, _ in held]))
    row_of = np.zeros(SIDE ** 3, np.int32)
    row_of[codes] = np.arange(1, len(codes) + 1)
    phi = np.zeros((len(codes) + 1, len(held)), np.float32)  # one column per landmark
    for k, (some, own) in enumerate(held):
        phi[row_of[some], k] = own
    value, vector = np.linalg.eigh((phi.T @ phi).astype(float) + RIDGE * np.eye(phi.shape[1]))
    whiten = vector / np.sqrt(value)  # K(L, L) ** -1/2
    kernel = landmark_kernel(Words.of(insults + clean, classes), phi, row_of).astype(float)
    y = np.concatenate((np.ones(len(insults)), -np.ones(len(clean))))
    balance = np.where(y > 0, len(y) / (2 * len(insults)), len(y) / (2 * len(clean)))
    w = _svm(kernel @ whiten, y, balance, 1.0)
    table = np.zeros(SIDE ** 3)
    table[codes] = (phi @ (whiten @ w[:-1]).astype(np.float32))[1:]
    return table, float(w[-1])


def fit(texts: list[bytes], toxic: list[int], base_rate: float) -> ToxicModel:
    """Model from a sample of texts and labels; one class alone gives the constant ``base_rate``."""
    classes = np.zeros(0x110000, dtype=np.uint8)
    distinct = dict(zip(texts, toxic))
    texts, labels = list(distinct), np.array(list(distinct.values()), dtype=float)
    letters = Counter(c for t in texts for c in t.decode("utf-8", "replace").lower() if c.isalpha())
    own = len(letters) if len(letters) < LETTERS else LETTERS - SHARED_LETTERS
    # letters without a class of their own, those the sample has not included, share the others by hash
    points = np.array([c for c in range(len(classes)) if chr(c).isalpha()], dtype=np.uint64)
    classes[points] = 3 + own + mix(points) % np.uint64(LETTERS - own)
    for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:own]):
        classes[ord(c)] = 3 + i
    table, bias = np.zeros(SIDE ** 3), -1.0
    curve = np.array([np.log(max(base_rate, 1e-6) / max(1 - base_rate, 1e-6)), 0.0, 0.0, 0.0])
    model = ToxicModel(classes, table, bias, curve)
    if not 0 < labels.sum() < len(labels):
        return model
    words, vocab = _vocabulary(texts)
    # texts of each class that hold each word
    counts = [np.bincount(np.concatenate([v for v, y in zip(vocab, labels) if y == side]), minlength=len(words)) for side in (0, 1)]
    good, bad = counts
    odds = np.where(bad >= 2, np.log((bad + 0.5) / (labels.sum() + 1)) - np.log((good + 0.5) / (len(labels) - labels.sum() + 1)), 0.0)
    weight = np.where(odds > 1, odds * np.log(np.maximum(bad, 1)), 0.0)
    # the most telling words of every toxic text are its witnesses
    witness = np.zeros(len(words), np.int64)
    for v, y in zip(vocab, labels):
        if y and len(v) and (top := weight[v].max()) > 0:
            witness[v[weight[v] >= 0.7 * top]] += 1
    shortest = min(2, int(witness.max(initial=0)))
    ranked = [(-int(witness[k]), words[k]) for k in np.flatnonzero(witness >= max(shortest, 1))]
    insults = [w for _, w in sorted(ranked)]
    rest = [w for _, w in sorted((-int(good[k]), words[k]) for k in np.flatnonzero((good > 0) & (odds <= 0)))]
    if not insults or not rest:
        return model
    clean = rest[:CLEAN_WORDS]
    pool = Words.of(rest, classes)
    for _ in range(MINING):
        step = max(1, len(clean) // (LANDMARKS // 2))
        model.table, model.bias = _word_svm(insults, clean, list(dict.fromkeys(insults[: LANDMARKS // 2] + clean[::step])), classes)
        # clean words that come closest to the insults join the negative class (and, as landmarks, describe it)
        hard = np.argsort(-margins(pool, model.table, model.bias), kind="stable")[:HARD_WORDS]
        clean = list(dict.fromkeys([rest[i] for i in hard] + clean))
    n_bad = labels.sum()
    n_good = len(labels) - n_bad
    del vocab, pool
    shape = model.text_shape(pa.array(texts, pa.binary()), FIT_CHUNK)
    model.curve = _logistic(shape, labels, np.where(labels > 0, base_rate / max(n_bad, 1), (1 - base_rate) / max(n_good, 1)) * len(labels))
    return model


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
          rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, fold: tuple[int, int] = (4, 2)) -> ToxicModel:
    """Model from labelled rows outside the test fold.

    Sample: per class the ``rows`` labelled ids with the lowest hashes, of texts up to ``chars`` characters; of an id with
    several rows the lowest text.  NULL labels and ids are left out; an id with both labels counts as toxic.  With no labels every score is the same low one.
    """
    known = (labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).filter(~is_test_fold(id_column, *fold))
             .groupBy(id_column).agg(F.max(F.col(label_column).cast("int")).alias("_toxic")))
    n, bad = known.agg(F.count("*"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    key = F.xxhash64(F.col(id_column).cast("string"))
    some = [known.filter(F.col("_toxic") == y).orderBy(key, id_column).limit(rows) for y in (0, 1)]
    ids = some[0].unionByName(some[1])  # at most 2 * rows small rows
    got = (docs.filter(F.col(text_column).isNotNull() & (F.length(text_column) <= chars)).select(id_column, F.col(text_column).alias("_text"))
           .join(F.broadcast(ids), id_column).groupBy(id_column).agg(F.min(F.col("_text").cast("binary")).alias("_text"), F.first("_toxic").alias("_toxic"))
           .toArrow().sort_by([(id_column, "ascending")]))  # one row per sampled id
    return fit([bytes(t) for t in got.column("_text").to_pylist()], got.column("_toxic").to_pylist(), bad / n if n else 0.01)


def score(docs: DataFrame, model: ToxicModel, carry: list[str], text_column: str = "text",
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Carried columns, score (0 to 1) and predicted (1 if score >= ``THRESHOLD``) of every whole text; NULL is empty.

    ``names`` are those of the two new columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = list(carry) if text_column in carry else [*carry, text_column]
    place, kept = given.index(text_column), len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probability(shared.value.text_shape(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))],
                                             [*batch.schema.names[:kept], *names])

    return docs.select(*given).mapInArrow(run, with_columns(docs, carry, f"`{names[0]}` double, `{names[1]}` int"))
