"""Registered queries on whole small tables against plain versions."""

import re

import pytest
from conftest import SMALL
from plain import WORD, base_scores, classes, exact_repeats, fold, in_fold, quality, simhash, without_repeats

from crewlake.llm.queries import QUERIES


@pytest.fixture(scope="module")
def rows(small):
    return [(r.doc_id, r.text) for r in small.orderBy("doc_id").collect()]


def run(spark, name):
    return QUERIES[name](spark, SMALL).collect()


def test_language(spark, small):
    known = {r.doc_id: r.lang for r in small.collect()}
    got = run(spark, "op1_language_id")
    assert len(got) == len(known) and all(r.held_out == in_fold(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.97 * len(held)


def test_decontamination(spark, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = {}
    for i, t in items:
        w = t.split()
        grams[i] = {tuple(w[k:k + 8]) for k in range(len(w) - 7)}
    want = {(d, i) for d, t in rows for i, g in grams.items() if g
            and len(g & {tuple(t.split()[k:k + 8]) for k in range(len(t.split()) - 7)}) >= 0.5 * len(g)}
    assert {(r.doc_id, r.item_id) for r in run(spark, "op2_template_decontamination")} >= want


def test_urls(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = run(spark, "op3_url_trees")
    assert len(got) == len(urls)
    for r in got:
        host = path = ""
        if "://" in urls[r.page_id]:
            rest = urls[r.page_id].split("://", 1)[1]
            raw = re.match(r"[^/?#]*", rest)[0]
            host, path = fold(raw), re.match(r"[^?#]*", rest[len(raw):])[0]
        fits = [(len(x), x, v) for v, x in rules for o, _, q in [x.partition("/")] if (host == o or host.endswith("." + o)) and path.startswith("/" + q)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "block" if r.block_score >= 0.5 else "allow")


def test_quality(spark, rows):
    text = dict(rows)
    for r in run(spark, "op4_host_rules"):
        n, chars, symbols, lines, repeats = quality(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and (not r.kept or not r.base_failed)


def test_toxicity(spark, rows):
    got = run(spark, "op5_toxicity_kernel")
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == in_fold(r.doc_id, 4, 2) for r in got)


def test_mixing(spark, rows):
    text = dict(rows)
    got = run(spark, "op6_systematic_mixing")
    assert sorted(got) == sorted(run(spark, "op6_systematic_mixing"))
    assert all(r.size == len(WORD.findall(text[r.doc_id])) and 0 <= r.taken <= 2 * r.size for r in got)
    total, sources = sum(r.size for r in got), {r.target: r.source_size for r in got}
    assert all(t <= 2 * s + 1e-6 for t, s in sources.items()) and total
    assert abs(sum(r.taken for r in got) - 1.5 * total) < 0.1 * total


def test_suffixes(spark, rows):
    want = dict(zip([i for i, _ in rows], without_repeats([t for _, t in rows], 200)))
    for r in run(spark, "op7_suffix_dedup"):
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_passages(spark, rows):
    got, words = {}, {i: WORD.findall(fold(t)) for i, t in rows}
    for r in run(spark, "op8_chained_passages"):
        assert r.other_doc_id < r.doc_id and r.end_word - r.start_word >= 50 and r.similarity >= 0.8
        assert len(set(words[r.doc_id][r.start_word:r.end_word]) & set(words[r.other_doc_id][r.other_start:r.other_end])) > 5
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for i, places in exact_repeats(rows).items():
        assert places <= got[i]


def test_simhash(spark, rows):
    prints = [simhash(t) for _, t in rows]
    want = {rows[i][0]: (f"{p:016x}", rows[c][0]) for i, (p, c) in enumerate(zip(prints, classes(prints, 2)))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op9_simhash_components")} == want


def test_language_model(spark, rows):
    want, got = base_scores(rows), run(spark, "op10_interpolated_lm")
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
