"""Conversation repair, packing and the Merkle manifest: registered queries on whole tables, and edge cases, against plain versions."""

import random
import struct
import zlib

import public_tokenizers
import pytest
from conftest import SMALL
from plain_new import manifest, repaired
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crewlake.llm import merkle, packing, repair
from crewlake.llm.queries import QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id long, turn long, role string, text string, conv string, fault int, name int"


def repairs(rows):
    return {r.conv: tuple(r)[1:] for r in rows.collect()}


def test_repair_of_a_whole_table(spark):
    given = spark.read.parquet(f"{SMALL}/conversations.parquet")
    got = QUERIES["op11_conversation_repair"](spark, SMALL)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == repaired([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])


@pytest.fixture(scope="module")
def odd_turns():
    rnd = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Hi.", "Hi", " ", "", None, "So?\n", "a. b", "Hi."]
    rows = [(conv if conv else None, rnd.choice([None, 0, 1, 2, 3, 7, 7]), rnd.choice(roles), rnd.choice(texts))
            for conv in range(300) for _ in range(rnd.randint(1, 7))]
    return rows + rows[:40]


@pytest.mark.parametrize("block", [1, 3, repair.BLOCK])
def test_repair_of_odd_rows_with_and_without_spilled_blocks(spark, odd_turns, block):
    rows = spark.createDataFrame([(*r, "x", 1, 2) for r in odd_turns], TURNS)
    assert repairs(repair.repair(repair.damage(rows), block)) == repaired(odd_turns)


def test_conversations_cross_batches(spark, odd_turns):
    rows = spark.createDataFrame([(*r, "x", 1, 2) for r in odd_turns], TURNS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert repairs(repair.repair(repair.damage(rows), 4)) == repaired(odd_turns)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repair_of_nothing_and_of_a_long_conversation(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repair(repair.damage(none)).count() == 0
    rows = spark.range(30_000).select(F.lit(7).alias("conv"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                      F.concat(F.col("id").cast("string"), F.lit(" ok.")).alias("text"), (F.col("id") % 10 == 9).alias("gone"))
    got = repair.repair(rows, 1000).first()
    assert got.audit.replace("I", "").count("K") == 27_000 and got.audit.count("I") == 3_000 and (got.cost, got.illegal) == (6_000, 2_999)
    assert got.gaps == 2_999


def test_moves_keep_the_grammar():
    for (initial, gone, cut), into in repair.MOVES.items():
        for moves in into:
            assert all(edit == "D" or not gone for _, _, edit, _, _ in moves)
            assert all(cost == {"D": 3, "K": 0, "R": 2, "IK": 2, "IR": 4}[edit] + (cut and edit != "D") for _, cost, edit, _, _ in moves)


def check_packing(pieces, docs, window):
    """Every id in one piece, windows without gaps, full or a power of two."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in docs]
    by_doc, by_window = {}, {}
    for i, start, length, crc, doc_tokens, sequence, offset in pieces:
        by_doc.setdefault(i, []).append((start, length, crc, doc_tokens))
        by_window.setdefault(sequence, []).append((offset, length))
    for (i, _), ids in zip(docs, want):
        at = 0
        for start, length, crc, doc_tokens in sorted(by_doc[i]):
            own = ids[start:start + length]
            assert (start, doc_tokens) == (at, len(ids)) and length > 0 and zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == crc
            at += length
        assert at == len(ids)
    assert sorted(by_window) == list(range(len(by_window)))
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
    total = sum(map(len, want))
    assert sum(sum(n for _, n in p) == window for p in by_window.values()) == total // window
    return by_window


def test_packing_of_a_whole_table(spark, small):
    docs = [(r.doc_id, r.text) for r in small.collect()]
    check_packing([tuple(r) for r in QUERIES["op12_mixture_packing"](spark, SMALL).collect()], docs, 4096)


def shares(pieces, window):
    """Tokens per source in every full window."""
    found = {}
    for r in pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect():
        found.setdefault(r.sequence_id, {})[r.source] = r.n
    return {k: v for k, v in found.items() if sum(v.values()) == window}


def test_every_window_holds_the_sources_in_their_shares(spark, small):
    docs = small.repartition(7)
    pieces = packing.pack(docs, TOKENIZER, window=1024).cache()
    sizes = {r.source: r.n for r in pieces.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    total = sum(sizes.values())
    large = {s: 1024 * n / total for s, n in sizes.items() if 1024 * n >= packing.LEAST * total}
    assert len(large) > 1
    windows = shares(pieces, 1024)
    assert len(windows) == total // 1024
    for found in windows.values():
        assert all(abs(found.get(s, 0) - q) <= 2 + len(large) for s, q in large.items())
    weights = {s: 1.0 for s in large}
    even = shares(packing.pack(docs, TOKENIZER, window=1024, weights=weights), 1024)
    smallest = int(min(sizes[s] for s in large) / (1024 / len(large))) - 1  # until the smallest queue is empty
    assert smallest > 2
    for k in range(smallest):
        assert all(abs(even[k].get(s, 0) - (1024 / len(large))) <= 40 for s in large)


def test_packing_of_odd_documents(spark):
    words = "café naïve <|endoftext|>x it's 1234 日本語 Straße ΣΑΣ é ́a ​z ﬁ".split(" ")
    rnd = random.Random(1)
    texts = [None, "", " \t\n", "a", "\x0b".join(words), " ".join(rnd.choice(words) for _ in range(20_000)), "x" * 30_000, "same", "same"]
    rows = [(k, t, ["s", None, "", "s"][k % 4], 0, 1) for k, t in enumerate(texts)] + [(k, "tiny", f"host{k}", 0, 1) for k in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, id int, part int")
    for window in (64, 4096):
        got = packing.pack(docs.repartition(3), TOKENIZER, window=window)
        pieces = got.select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset")
        check_packing([tuple(r) for r in pieces.collect()], [(r[0], r[1]) for r in rows], window)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_looked_up_words_are_the_tokenizer_s(small):
    import pyarrow as pa
    rnd = random.Random(4)
    letters = [chr(c) for c in range(33, 0x250)] + list("αβΣς日本語ｱ한글İıſﬁ́̈ \u200d\u00ad\u0085\u2028🙂")
    texts = ["".join(rnd.choice(letters if rnd.random() < 0.5 else "abcdeXYZ,.' \n") for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["<|ENDOFTEXT|> <|endoftext|>", "It's, they'LL 'd.", "A\u030a. ﬃ", "e\u0301. E\u0301,"] + [r.text or "" for r in small.collect()]
    tokenizer, words = Tokenizer.from_file(TOKENIZER), packing.Words(TOKENIZER)
    assert words.folds and words.direct
    ids, sizes = words.ids(pa.array(texts))
    at = 0
    for text, n in zip(texts, sizes):
        assert ids[at:at + n].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        at += n


def test_repeated_and_null_ids_are_packed_as_documents(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string").withColumn("source", F.lit("s"))
    got = packing.pack(docs, TOKENIZER).collect()
    assert sum(r.length for r in got) == 10 and sorted(r.doc_tokens for r in got if r.start == 0) == [2, 2, 3, 3]


def test_schedule_is_deficit_round_robin():
    sizes, weights, window = [5000, 700, 300, 41], [0.5, 0.3, 0.15, 0.05], 100
    plan = packing.Schedule(sizes, weights, window)
    deficit, left, stream, at = [0] * 4, list(sizes), [], [0] * 4
    while any(left):
        for q in range(4):
            deficit[q] += int(plan.quantum[q])
            n = min(left[q], deficit[q] >> 28)
            deficit[q] -= n << 28
            left[q] -= n
            stream += [(q, at[q] + k) for k in range(n)]
            at[q] += n
    place = {x: k for k, x in enumerate(stream)}
    for q, size in enumerate(sizes):
        for first in range(0, size, 37):
            n = min(37, size - first)
            got = [(s + k, x + k) for s, m, x in plan.pieces(q, first, n) for k in range(m)]
            assert got == [(k, place[q, first + k]) for k in range(n)]


def test_manifest_of_a_whole_table(spark, small):
    rows = [tuple(r) for r in small.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = QUERIES["op13_merkle_manifest"](spark, SMALL)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect())) == sorted(manifest(rows))


@pytest.mark.parametrize("bits", [2, 3, 10])
def test_manifest_of_odd_rows_over_several_levels(spark, bits):
    rnd = random.Random(2)
    langs = [None, "", "en", "en", "en", "é", "Z", "z"] + [f"l{k}" for k in range(6)]
    rows = [(rnd.choice([None, *range(200)]), rnd.choice(["s", None, ""]), rnd.choice(langs), rnd.choice([None, 5, -1]), rnd.choice(["x" * 50, None, "ü", ""])) for _ in range(150)]
    rows += rows[:30] + [(7, "s", "lone", 3, "t")] + [(14, "s", "en", 1, "t")] * 20
    docs = spark.createDataFrame([(*r, 0, 0, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, id int, grp int, leaf string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tree = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", tampered, {"n_chars": F.col("n_chars") + 1}, bits)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, merkle.hashlib.sha256("".join(r.proof).encode()).hexdigest(),
            r.version[-1] if r.version else r.root) for r in tree.collect()]
    assert sorted(got, key=repr) == sorted([r[:6] for r in manifest(rows)], key=repr)


def test_manifest_of_nothing_and_of_one_row(spark, small):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    assert merkle.manifest(small.limit(0), columns, "lang", "doc_id").count() == 0
    one = merkle.manifest(small.limit(1), columns, "lang", "doc_id").first()
    assert one.leaf == one.subroot == one.root and one.proof == [] and one.version == []


def test_a_version_copies_only_ancestors(spark, small):
    tree = merkle.manifest(small, ["doc_id", "text"], "lang", "doc_id", F.col("doc_id") % 5 == 0, {"text": F.lit("changed")}).collect()
    nodes = {r.leaf for r in tree} | {x for r in tree for x in r.proof} | {r.root for r in tree}
    for r in tree:
        if r.doc_id % 5 == 0:
            assert not set(r.version) & nodes and len(r.proof) <= len(r.version) - 1 <= 8 + 3
        else:
            assert r.version == []


def test_every_row_is_folded_from_its_own_leaf_and_proof(spark, small):
    for docs in (small, small.limit(1)):
        tree = merkle.manifest(docs, ["doc_id", "text"], "lang", "doc_id", F.col("doc_id") % 5 == 0, {"text": F.lit("changed")}, 3).collect()
        assert all(r.folded == (r.version[-1] if r.version else r.root) for r in tree)
    leaves = [str(k).encode() for k in range(5)]
    tree = merkle.Block(5, leaves, 3)
    top = merkle.Block(2, [b"other", tree.root], 3)
    for k in range(5):
        proof = tree.siblings(k) + top.siblings(1)
        assert merkle.folded(leaves[k], proof, k, 5, 1, 2)[-1] == top.root
        for j in range(len(proof)):  # a proof with one wrong node does not lead to the root
            assert merkle.folded(leaves[k], [*proof[:j], b"wrong", *proof[j + 1:]], k, 5, 1, 2)[-1] != top.root
