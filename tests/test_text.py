import random

import pytest
from pyspark.sql import functions as F

from crewlake.operators import logs as L
from crewlake.operators import patterns as P
from crewlake.operators import resolve as T
from crewlake.operators import retrieve as RT

NAMES = [("site", "Acorn Group"), ("supplier", "Transport & Hire"), ("client", "Marloo Group"), ("project", "Northern Shutdown")]


@pytest.fixture(scope="module")
def vocab(spark):
    names = spark.createDataFrame([(t, v, 0) for t, v in NAMES], "type string, value string, source_rank int")
    people = spark.createDataFrame([("Shaun", "Carter")], "first_name string, last_name string")
    return T.vocabulary(names, people)


@pytest.mark.parametrize("mention,status,value", [
    ("Acorngroup", "exact", "Acorn Group"), ("AG", "alias", "Acorn Group"), ("Acorn Grup", "fuzzy", "Acorn Group"), ("Carter", "exact", "Shaun Carter"),
    ("Transport and Hire", "exact", "Transport & Hire"), ("zzzzqqqq", "none", None), ("x", "none", None)])
def test_resolve(spark, vocab, mention, status, value):
    r = T.resolve_mentions(spark.createDataFrame([(mention,)], "mention string"), vocab, T.alias_table(spark, {"AG": "Acorn Group"})).first()
    assert (r.status, r.value) == (status, value)


def test_weak_match_is_only_offered(spark, vocab):
    r = T.resolve_mentions(spark.createDataFrame([("Marloogroop",)], "mention string"), vocab.filter("value <> 'Acorn Group'"), T.alias_table(spark, {"q": "q"})).first()
    assert r.value is None or r.score >= 90


def test_unknown_stated_site_is_kept(spark, vocab):
    q = spark.createDataFrame([(1, "hours for site=Qwertyville"), (2, "hours for Acorn Grup last week")], "question_id int, text string")
    got = {r.question_id: (r.type, r.value, r.score) for r in T.detect_mentions(q, vocab, T.alias_table(spark, {"AG": "Acorn Group"})).collect()}
    assert got[1] == ("site", "Qwertyville", 0.0) and got[2][1] == "Acorn Group" and got[2][2] >= 90


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [55.0, 70.0, 90.0])
def test_similarity_join_misses_nothing(spark, threshold):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcde1") for _ in range(rnd.randint(2, 9)))
    terms, names = sorted({word() for _ in range(60)}), sorted({w for w in (word() for _ in range(80)) if len(w) >= 3})
    want = {(a, b) for a in terms for b in names if 200 * lcs(a, b) / (len(a) + len(b)) >= threshold - 1e-9}
    v = spark.createDataFrame([("site", n, n) for n in names], "type string, norm string, value string")
    got = T.near_names(spark.createDataFrame([(t,) for t in terms], "norm string"), v, threshold).collect()
    assert {(r.norm, r.value) for r in got} == want


def entries(spark, rows):
    names = spark.createDataFrame([(t, v, 0) for t, v in rows], "type string, value string, source_rank int")
    return T.vocabulary(names)


def test_one_name_in_four_spellings_hides_no_other(spark):
    v = entries(spark, [("site", "Red-Widget"), ("client", "Red Widget"), ("supplier", "RED WIDGET"), ("project", "RedWidget"), ("site", "Red Gidgets")])
    r = T.resolve_mentions(spark.createDataFrame([("redwidgetz",)], "mention string"), v, T.alias_table(spark, {"q": "q"})).first()
    assert (r.status, r.type, r.value, r.candidates) == ("fuzzy", "site", "Red-Widget", "Red Gidgets (site)")


def test_types_limit_the_search(spark, vocab):
    m, none = spark.createDataFrame([("Acorn Grup",), ("Transport and Hire",), ("AG",)], "mention string"), T.alias_table(spark, {"AG": "Acorn Group"})
    got = {r.mention: (r.status, r.value) for r in T.resolve_mentions(m, vocab, none, ["supplier"]).collect()}
    assert got == {"Acorn Grup": ("none", None), "Transport and Hire": ("exact", "Transport & Hire"), "AG": ("none", None)}
    assert {r.type for r in T.suggest(m, vocab, types=["client", "supplier"]).collect()} <= {"client", "supplier"}


def test_an_alias_stands_for_what_its_target_resolves_to(spark, vocab):
    aliases = T.alias_table(spark, {"AG": "Acorn Grup", "A2": "AG", "A3": "A2", "gone": "qqqqzzzz"})
    m = spark.createDataFrame([("AG",), ("A2",), ("A3",), ("gone",)], "mention string")
    got = {r.mention: (r.status, r.value) for r in T.resolve_mentions(m, vocab, aliases).collect()}
    assert got == {"AG": ("alias", "Acorn Group"), "A2": ("alias", "Acorn Group"), "A3": ("alias", "Acorn Group"), "gone": ("none", None)}


def test_index_grows_by_merging(spark, tmp_path):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdexyz12") for _ in range(rnd.randint(3, 11)))
    words = sorted({word() for _ in range(120)} | {"a" * 70 + "b" * 9, "a" * 66 + "b" * 12})
    first, more = words[::2], words[1::2] + words[::2][:5]
    frame = lambda ws: spark.createDataFrame([("site", w, w.upper()) for w in ws], "type string, norm string, value string")
    index = T.NameIndex.build(frame(first), f"{tmp_path}/names", 55.0).merge(frame(more)).merge(frame(more))
    terms = sorted({word() for _ in range(40)} | {"a" * 69 + "c"})
    for threshold in (55.0, 90.0):
        got = sorted((r.norm, r.value) for r in index.near(spark.createDataFrame([(t,) for t in terms], "norm string"), threshold).collect())
        assert got == sorted((a, b.upper()) for a in terms for b in words if 200 * lcs(a, b) / (len(a) + len(b)) >= threshold - 1e-9)
    assert T.NameIndex(spark, f"{tmp_path}/names").entries.count() == len(words)


def test_best_names_in_stages_are_exact(spark):
    rnd = random.Random(9)
    words = sorted({"worker" + "".join(rnd.choice("0123456789") for _ in range(4)) for _ in range(200)} | {"wrker", "workers", "wooker12"})
    v = spark.createDataFrame([("site", w, w) for w in words], "type string, norm string, value string")
    terms = ["worker12", "worker0000", "wrkers", "zzz"]
    near = T.near_names(spark.createDataFrame([(t,) for t in terms], "norm string"), v, 55.0, best=4).collect()
    for t in terms:
        scores = sorted((round(200 * lcs(t, w) / (len(t) + len(w)), 6) for w in words), reverse=True)[:4]
        got = sorted((round(r.raw_score, 6) for r in near if r.norm == t), reverse=True)[:4]
        assert got == [x for x in scores if x >= 55]


def test_patterns_are_found_whatever_the_shards(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("ab c") for _ in range(rnd.randint(1, n)))
    texts, patterns = [None, "", *[word(60) for _ in range(60)]], sorted({word(5) for _ in range(40)})
    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id int, text string, hits_before int")
    names = spark.createDataFrame([(p,) for p in [*patterns, "", patterns[0]]], "pattern string")
    want = sorted((k, p, sum(t.startswith(p, i) for i in range(len(t)))) for k, t in enumerate(texts) if t for p in patterns if p in t)
    for shard in (1 << 20, 16):
        assert sorted((r.id, r.pattern, r.hits) for r in P.find_patterns(frame, names, shard=shard).collect()) == want
    assert P.find_patterns(frame, names.limit(0)).count() == 0 and P.find_patterns(frame.limit(0), names).count() == 0


def test_names_are_said_word_by_word(spark):
    texts = spark.createDataFrame([(1, "Red-Widget, red widget! redwidget"), (2, "a Tired widget"), (3, "T&H hires; T H")], "id int, text string")
    vocab = spark.createDataFrame([("site", "Red Widget"), ("client", "T & H"), ("client", "--")], "type string, value string")
    assert sorted((r.id, r.value, r.hits) for r in P.named_in(texts, vocab).collect()) == [(1, "Red Widget", 2), (3, "T & H", 2)]


def test_chunks_merge_and_cut(spark):
    text = "intro\n## A\nshort\n## B\n" + "x" * 8000
    rows = RT.chunks(spark.createDataFrame([(1, "stem", text)], "doc_id int, title string, text string")).collect()
    assert [(r.title, len(r.text)) for r in rows] == [("stem", len("intro\n\n## A\nshort")), ("B", 3600), ("B", 3600), ("B", 5 + 8000 - 7200)]


def test_zero_vector_is_similar_to_nothing(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])], "id int, v array<double>")
    assert [(r.id, r.score) for r in RT.vector_search(df, {"q": [1.0, 0.0]}, "id", "v").collect()] == [(2, 0.7071)]


def test_retro_signals_across_buckets(spark):
    rows = [(1, "u", "a", "show"), (2, "u", "a", "that's not right"), (301, "u", "b", "next"), (302, "u", "b", "more")]
    df = spark.createDataFrame(rows, "n int, user string, tool string, question string")
    got = {r.n: (r.corrected, r.followed_up) for r in L.retro_signals(df, ["user"], ["n"], F.floor(F.col("n") / 100)).collect()}
    assert got == {1: (True, False), 2: (False, False), 301: (False, True), 302: (False, False)}


def test_action_status_and_streak(spark):
    ev = spark.createDataFrame([("i", 1, 1, "dry_run", None), ("i", 2, 2, "approved", None), ("i", 3, 3, "executed", "partial"), ("i", 4, 4, "dry_run", None), ("j", 5, 1, "dry_run", None)],
                               "issue_id string, event_id int, ts int, status string, result string")
    assert {r.issue_id: r.status for r in L.action_status(ev).collect()} == {"i": "partial", "j": "previewed"}
    runs = spark.createDataFrame([("a", 1, "Failed"), ("a", 2, "Succeeded"), ("a", 3, "Failed"), ("a", 4, "Failed"), ("b", 1, "Failed"), ("c", 1, "Succeeded")], "job string, started int, status string")
    assert {r.job: r.streak for r in L.failure_streaks(runs).collect()} == {"a": 2, "b": 1, "c": 0}


@pytest.mark.parametrize("text,kind", [("ok, 谁过期了?", "question"), ("hi 谁在现场?", "question"), ("宏达劳务经常出问题", "supplier_flag"),
                                       ("合规的定义是 每个人都有有效证书", "definition"), ("Thanks!", "chitchat"), ("hello", "chitchat")])
def test_utterances_in_any_script(spark, text, kind):
    k = T.classify_utterance("t")["kind"]
    assert spark.createDataFrame([(text,)], "t string").select(k.alias("k")).first().k == kind


def test_followups_need_a_sign_and_swap_entities(spark):
    args = {"worker_name": "Jane", "site": "A"}
    rows = [("c", 1, "hours at A", "timesheet", "get_weekly_timesheet", args), ("c", 2, "what about Yard Nine", None, None, None),
            ("c", 3, "I spoke with Carter about something else yesterday", None, None, None), ("c", 4, "and for Carter", None, None, None)]
    turns = spark.createDataFrame(rows, "conversation_id string, turn int, text string, tool string, function string, args map<string,string>")
    named = spark.createDataFrame([("c", 2, "site", "Yard Nine"), ("c", 4, "supplier", "X")], "conversation_id string, turn int, type string, value string")
    got = {r.turn: r for r in T.followups(turns, "2026-06-01", entities=named).collect()}
    assert set(got) == {2, 4}
    assert got[2].args["site"] == "Yard Nine" and got[2].entity_changed
    assert got[4].args == {"worker_name": "Carter", "site": "A"} and not got[4].entity_changed
