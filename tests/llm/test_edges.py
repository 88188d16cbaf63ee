"""NULLs, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from plain import classes, exact_repeats, quality, simhash, without_repeats

from crewlake.llm import chaining, decontam, hostrules, interpolation, langid, mixing, shared, simhash as sh, suffixes, toxkernel, urltrees

_rnd = random.Random(5)
WORDS = ["".join(_rnd.choice("abcdefghijklm") for _ in range(_rnd.randint(2, 8))) for _ in range(400)]


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(40_000, 1) + " " + "x" * 200_000 + "\n" + "é" * 3
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab"), (5, "5 5 5"), (6, LONG), (7, prose(120, 2)), (7, prose(120, 2)), (8, prose(120, 2)),
       (None, prose(60, 3)), (None, None), (9, "日本語 テキスト")]


def odd(docs_of):
    return docs_of(*ODD)


def empty(docs_of):
    return docs_of(*ODD).limit(0)


def texts_of(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows)


def test_language_id(docs_of):
    docs = odd(docs_of)
    got = langid.predict(docs, langid.learn(docs)).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3, 5)} == dict.fromkeys((1, 2, 3, 5), "und")
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    none = langid.predict(docs, langid.learn(empty(docs_of))).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(ODD)
    assert langid.predict(empty(docs_of), langid.learn(docs)).count() == 0


def test_phrases_are_longest_matches():
    train = {"a": [b"abracadabra abracadabra"], "b": [b"bobo coco"]}
    parser = langid.CrossParser(train)
    text = b"abra zz dabra coco"
    for k, lang in enumerate(parser.languages):
        known, n, i = train[lang][0], 0, 0
        while i < len(text):
            size = 1
            while i + size < len(text) and text[i:i + size + 1] in known:
                size += 1
            n, i = n + 1, i + size
        assert parser.phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0, k] in (n, n + 1)


def test_decontamination_finds_new_numbers_and_names(spark, docs_of):
    item = "Anna has 12 red apples and gives 5 of them to her friend Boris who eats 2 apples after 3 hours of play outside"
    changed = item.replace("Anna", "Maria").replace("Boris", "Ivan").replace("12", "40").replace("5", "7")
    broken = item.replace("5 of them", "12 of them").replace("Boris", "Anna").replace("2 apples", "9 apples").replace("12 red", "3 red").replace("3 hours", "12 hours")
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "only four words here"), (1, item)], "item_id long, text string")
    docs = docs_of((1, prose(30, 7) + " " + changed + " " + prose(30, 8)), (2, prose(80, 9)), (3, None), (4, "so only four words here stay"), (5, broken), (6, changed), (6, changed))
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, benchmark).collect()}
    assert {(1, 1), (4, 4), (6, 1)} <= set(got) and (2, 1) not in got and (5, 1) not in got
    assert got[1, 1].changed_slots >= 3
    left = decontam.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5]
    assert decontam.contaminated(odd(docs_of), benchmark.limit(0)).count() == 0 and decontam.contaminated(empty(docs_of), benchmark).count() == 0
    assert texts_of(decontam.drop_contaminated(odd(docs_of), benchmark).collect()) == texts_of(odd(docs_of).collect())


def test_decontamination_finds_items_of_few_literals(spark, docs_of):
    items = [(1, "2, 4, 8, 16, 32, 64, 128, 256, 512?"), (2, "Convert 5 km 300 m 20 cm to mm: A 5300200 B 530020 C 53002"),
             (3, "Who Wrote The Long Winter Of Anna Petrowna Kusmin")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(*[(i, prose(20, 70 + i) + " " + t + " " + prose(20, 80 + i)) for i, t in items], (9, "2, 4, 8, 16, 33, 65, 129, 257, 513?"), (10, prose(90, 91)))
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_decontamination_finds_other_case_names_and_parts(spark, docs_of):
    item = "Anna Smith has 12 red apples and gives five of them to Boris. He eats 2 apples after Three hours of play. Then Maria comes home"
    renamed = item.replace("Anna Smith", "Joe").replace("Boris", "Mary Ann Lee").replace("five", "7").replace("12", "twenty six")
    long = prose(200, 60)
    benchmark = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    docs = docs_of((1, item.lower()), (2, item.upper()), (3, renamed), (4, prose(20, 61) + " " + " ".join(long.split()[30:120])),
                   (5, " ".join(long.split()[30:60]) + " " + prose(30, 62)))
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()} == {(1, 1), (2, 1), (3, 1), (4, 2)}


def test_urls(spark):
    urls = [None, "", "no scheme/net/", "http://", "HTTP://WWW.Example.NET/en/x?q=1", "http://a.net", "http://a.net/", "http://xnet/", "http://a.org/fr/?a#b",
            "http://example.com/de/1", "http://example.com/de/1", "ftp://" + "h" * 3000 + ".com/" + "p/" * 3000, "x://e.com?://y.net/"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, f0 int")
    got = {r.page_id: r for r in urltrees.judge(pages).collect()}
    assert len(got) == len(urls)
    assert [got[i].rule for i in range(11)] == [None, None, None, None, "example.net/en/", None, "net/", None, "org/fr/", "example.com/de/", "example.com/de/"]
    assert (got[4].host, got[4].path) == ("www.example.net", "/en/x") and (got[12].host, got[12].path) == ("e.com", "")
    assert all(r.verdict in ("allow", "block") and 0 < r.block_score < 1 for r in got.values())
    assert urltrees.judge(pages.limit(0)).count() == 0


def test_trees_separate_what_features_tell_apart(spark):
    rows = [(f"http://h{i}.com/" + ("a/" * (i % 7)), "block" if i % 7 > 3 else "allow") for i in range(200)]
    pages = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(rows)], "page_id long, url string, want string")
    known = urltrees.features(pages)
    names = [f"f{i}" for i in range(urltrees.N_FEATURES)]
    vectors = known.groupBy(*names).agg(F.count("*").alias("n"), F.sum((F.col("want") == "block").cast("int")).alias("blocked"))
    model = urltrees.train(vectors)
    wrong = known.filter((model.margin() > 0) != (F.col("want") == "block")).count()
    assert wrong == 0 and model.trees


def test_host_rules(spark, docs_of):
    got = hostrules.judge(odd(docs_of)).collect()
    assert len(got) == len(ODD)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words)), sorted(ODD, key=lambda x: (x[0] is None, x[0] or 0, quality(x[1])[0]))):
        assert r.doc_id == i and (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality(t)
    assert hostrules.judge(empty(docs_of)).count() == 0
    bad = docs_of(*[(i, "too short") for i in range(30)], (30, prose(80, 4)), source="bad")
    good = docs_of(*[(i, prose(80, i)) for i in range(40, 80)], source="good")
    none = docs_of((90, prose(80, 90)), source=None)
    kept = {r.doc_id: (r.kept, r.host_rate) for r in hostrules.judge(bad.union(good).union(none)).collect()}
    assert not kept[30][0] and kept[30][1] > 0.5 and all(kept[i][0] for i in range(40, 80)) and kept[90] == (True, None)


def insulting(n, insults, seed):
    r = random.Random(seed)
    out = prose(n, seed).split()
    for _ in range(3):
        out.insert(r.randrange(len(out)), r.choice(insults))
    return " ".join(out)


def test_toxicity_tolerates_gaps(spark, docs_of):
    insults = ["zorgwump", "quixnarp", "vexplod"]
    toxic = [(i, insulting(60, insults, i)) for i in range(60)]
    clean = [(i, prose(60, i)) for i in range(60, 180)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(180)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxkernel.learn(docs_of(*toxic, *clean), labels)
    new = docs_of((1, prose(50, 901) + " zo*rg-wump " + prose(50, 902)), (2, prose(100, 903)), (3, prose(20, 904) + " z o r g w u m p " + prose(9, 905)),
                  (4, prose(30, 906) + " QuixxNarp"), *[(i or 99, t) for i, t in ODD if i in (1, 2, 3)])
    got = [tuple(r)[1:] for r in toxkernel.score(new, model, ["doc_id"]).collect()]
    assert [p for _, p in got] == [1, 0, 1, 1, 0, 0, 0] and all(0 <= s <= 1 for s, _ in got)
    assert toxkernel.score(odd(docs_of), model, ["doc_id"]).count() == len(ODD) and toxkernel.score(empty(docs_of), model, ["doc_id"]).count() == 0
    nothing = toxkernel.learn(empty(docs_of), labels.limit(0))
    assert {r.predicted for r in toxkernel.score(odd(docs_of), nothing, ["doc_id"]).collect()} == {0}


def test_toxicity_in_rare_scripts(spark, docs_of):
    r = random.Random(15)

    def words(first, n, many):
        return ["".join(chr(first + r.randrange(n)) for _ in range(r.randint(3, 8))) for _ in range(many)]

    cyrillic, greek, armenian = words(0x430, 32, 200), words(0x3C3, 7, 200) + words(0x3B1, 17, 100), words(0x561, 38, 40)
    insults = words(0x561, 38, 3)

    def text(k, bad):
        own = prose(30, 2000 + k).split() + r.choices(cyrillic, k=20) + r.choices(greek, k=20) + r.choices(armenian, k=4) + [r.choice(insults) for _ in range(bad)]
        return " ".join(r.sample(own, len(own)))

    rows = [(k, text(k, 3 * (k < 60))) for k in range(180)]
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(180)], "doc_id long, toxic int")
    model = toxkernel.learn(docs_of(*rows), labels)
    new = docs_of((1, text(901, 0) + " " + insults[0]), (2, text(902, 0)), (3, text(903, 0) + " " + " ".join(insults[1])), (4, text(904, 0)))
    assert [x.predicted for x in sorted(toxkernel.score(new, model, ["doc_id"]).collect(), key=lambda x: x.doc_id)] == [1, 0, 1, 0]


def test_kernel_equals_sum_over_subsequences():
    classes_of = np.zeros(0x110000, np.uint8)
    classes_of[97:123] = np.arange(3, 29)
    words = toxkernel.Words.of([b"banana", b"b-an.na", b"x" * 30, b"??", b"ab"], classes_of)
    cube = np.random.default_rng(1).normal(size=(toxkernel.SIDE,) * 3)
    cube[0] = cube[:, 0] = cube[:, :, 0] = 0  # what is no letter is in no subsequence
    table = cube.ravel()
    got = toxkernel.margins(words, table, 0.0)
    for i in (0, 1, 2, 4):
        phi = toxkernel._features(words.codes[words.bounds[i]:words.bounds[i + 1]])
        assert abs(got[i] - phi @ table / np.sqrt(phi @ phi)) < 1e-4
    assert got[3] == -np.inf


def test_mixing(spark, docs_of):
    rows = odd(docs_of).union(docs_of(*[(i, prose(10 + i % 30, i)) for i in range(100, 400)], source="s0")).union(docs_of((500, prose(9)), source=None))
    got = mixing.mix(rows, ["doc_id"]).collect()
    assert len(got) == rows.count() and all(0 <= r.copies <= 2 for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(rows.repartition(7), ["doc_id"]).collect()), key=str)
    total = sum(r.size for r in got)
    goals = {r.source_size: r.target for r in got}
    assert abs(sum(goals.values()) - 1.5 * total) < 1e-6 * total and all(t <= 2 * s for s, t in goals.items())
    s0 = [r for r in got if (r.doc_id or 0) in range(100, 400)]
    assert abs(sum(r.copies * r.size for r in s0) - s0[0].target) <= 2 * 40
    assert mixing.mix(empty(docs_of), ["doc_id"]).count() == 0


def test_targets_share_the_excess_again(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 50, 1), (None, 0, 2)], "source string, source_size long, n long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got["c"] == 100 and got[None] == 0 and abs(got["b"] - (1.5 * 1060 - 120)) < 1e-9


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffixes(docs_of, hot):
    shared_part, other = prose(60, 20), prose(70, 21)
    rows = [*ODD, (20, shared_part), (21, prose(9, 22) + shared_part + prose(5, 23)), (22, prose(4, 24) + shared_part[3:]), (23, other + "\n" + other), (24, prose(3, 25) + shared_part[:-1] + "!"),
            *[(30 + i, f"{i} " + prose(50, 77) + f" {i * 7} " + prose(40, 78)) for i in range(12)], (60, "a" * 700)]
    short = [(i, t if t is None or len(t) < 100_000 else t[:3000] + t[-300:]) for i, t in rows]
    got = suffixes.remove_repeats(docs_of(*short), ["doc_id"], length=50, gram=16, hot=hot).collect()
    want = without_repeats([t for _, t in short], 50)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((i or 0, *w) for (i, _), w in zip(short, want))


def test_suffixes_long_and_empty(docs_of):
    got = suffixes.remove_repeats(odd(docs_of), ["doc_id"]).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.n_removed for r in got}[6] >= 199_999
    assert suffixes.remove_repeats(empty(docs_of), ["doc_id"]).count() == 0


def test_passages(docs_of):
    passage, far = prose(80, 40), prose(70, 41)
    fuzzy = " ".join(w if i % 17 else "changed" for i, w in enumerate(passage.split()))
    rows = [(10, prose(40, 42) + " " + passage), (11, passage + " " + prose(33, 43)), (12, prose(20, 44) + " " + fuzzy + " " + prose(20, 45)),
            (13, prose(200, 46)), (14, far + " " + prose(30, 47)), (15, prose(30, 48) + " " + far + " " + passage), (16, " ".join(passage.split()[:30]) + " " + prose(60, 49))]
    found = {}
    for r in chaining.repeated_passages(docs_of(*rows)).collect():
        found.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.other_doc_id))
    assert set(found) == {11, 12, 15} and found[11] == [(0, 80, 10)] and found[15] == [(30, 180, 10)]
    (a, b, other), = found[12]
    assert other == 10 and a <= 22 and b >= 98
    cut = {r.doc_id: r.text for r in chaining.drop_repeated_passages(docs_of(*rows)).collect()}
    assert cut[11] == prose(33, 43) and cut[15] == prose(30, 48) and cut[13] == prose(200, 46) and len(cut) == len(rows)


def test_passages_in_odd_rows(docs_of):
    docs = odd(docs_of)
    kept = chaining.drop_repeated_passages(docs)
    assert kept.columns == docs.columns
    assert texts_of(kept.collect()) == texts_of(r for r in docs.collect() if r.doc_id != 8)  # 8 repeats 7 and nothing is left of it
    assert chaining.repeated_passages(empty(docs_of)).count() == 0 and chaining.drop_repeated_passages(empty(docs_of)).count() == 0


def test_passages_cover_all_exact_runs(docs_of):
    r = random.Random(8)
    parts = [prose(r.randint(20, 90), 300 + k) for k in range(12)]
    rows = [(i, " ".join(r.choice(parts) if r.random() < 0.5 else prose(r.randint(5, 60), 1000 + 50 * i + k) for k in range(6))) for i in range(60)]
    got = {}
    for x in chaining.repeated_passages(docs_of(*rows)).collect():
        got.setdefault(x.doc_id, set()).update(range(x.start_word, x.end_word))
    for i, places in exact_repeats(rows).items():
        assert places <= got.get(i, set())


def reworded(words, rate, r, edits="r"):
    """The words with a share of them replaced, left out or doubled up."""
    out = []
    for w in words:
        kind = r.choice(edits) if r.random() < rate else ""
        out += {"": [w], "r": [f"new{r.random()}"], "d": [], "i": [w, f"new{r.random()}"]}[kind]
    return out


def close_passage(a, b, size=50, share=0.8):
    """Whether some ``size`` words of a agree in place with those of b."""
    same = [x == y for x, y in zip(a, b)]
    return any(sum(same[k:k + size]) >= share * size for k in range(len(same) - size + 1))


def test_passages_are_found_at_every_similarity(docs_of):
    r = random.Random(12)
    rows, want, loose = [], set(), set()
    for k, (rate, size) in enumerate([(rate, size) for rate in (0.05, 0.1, 0.14, 0.2) for size in (60, 120) for _ in range(12)]):
        words = prose(size, 5000 + k).split()
        copy = reworded(words, rate, r)
        rows += [(2 * k, prose(30, 6000 + k) + " " + " ".join(words) + " " + prose(30, 6500 + k)),
                 (2 * k + 1, prose(30, 7000 + k) + " " + " ".join(copy) + " " + prose(30, 7500 + k))]
        if close_passage(words, copy):
            want.add(2 * k + 1)
    for k in range(20):  # words left out and put in
        words = prose(90, 8000 + k).split()
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, " ".join(reworded(words, 0.08, r, "rdi")))]
        loose.add(1001 + 2 * k)
    every7 = prose(60, 9000).split()
    rows += [(2000, " ".join(every7)), (2001, " ".join(w if i % 7 else f"x{i}" for i, w in enumerate(every7, 1)))]
    got = {x.doc_id: x.other_doc_id for x in chaining.repeated_passages(docs_of(*rows)).collect()}
    assert len(want) > 60 and all(got.get(i) == i - 1 for i in want | loose | {2001})


def test_passages_need_one_earlier_document(docs_of):
    lines = [prose(17, 400 + k) for k in range(3)]
    stock = [(k, prose(40, 410 + k) + " " + x + " " + prose(40, 420 + k)) for k, x in enumerate(lines)]
    clean = (10, prose(30, 430) + " " + " ".join(lines) + " " + prose(30, 431))
    assert chaining.repeated_passages(docs_of(*stock, clean)).count() == 0
    # the later of two documents that share more than the stock lines is found, although the lines occur earlier
    words = f"{lines[0]} {prose(6, 440)} {lines[1]} {prose(6, 441)} {lines[2]}".split()
    copy = [w if i not in (18, 42, 50) else "changed" for i, w in enumerate(words)]
    rows = [*stock, (20, prose(30, 442) + " " + " ".join(words)), (21, " ".join(copy) + " " + prose(30, 443))]
    (x,) = chaining.repeated_passages(docs_of(*rows)).collect()
    assert (x.doc_id, x.other_doc_id, x.start_word, x.end_word) == (21, 20, 0, len(words))


def covered(rows):
    out = {}
    for x in rows:
        out.setdefault(x.doc_id, set()).update(range(x.start_word, x.end_word))
    return out


@pytest.mark.parametrize("size,between", [(400, 0), (60, 0), (400, 9), (60, 9)])
def test_a_copy_whose_pieces_all_occur_earlier_is_found(docs_of, size, between):
    words = prose(size, 700).split()
    step = max(1, (size - 24) // 19)
    pieces = [words[min(k * step, size - 24):][:24] for k in range(20)]
    stock = lambda first: [(first + k, prose(30, 710 + first + k) + " " + " ".join(x) + " " + prose(30, 740 + first + k)) for k, x in enumerate(pieces)]
    rows = [r for first in range(0, 20 * 6, 20) for r in stock(first)]  # every seed occurs in six earlier documents
    rows += [(500, prose(20, 770) + " " + " ".join(words))] + [r for first in range(600, 600 + 20 * between, 20) for r in stock(first)]
    rows += [(900, " ".join(words) + " " + prose(20, 771)), (901, " ".join(words) + " " + prose(20, 771))]
    got = chaining.repeated_passages(docs_of(*rows)).collect()
    found = covered(got)
    assert found[900] >= set(range(size)) and found[901] == set(range(size + 20))
    assert not set(found) - {900, 901}
    assert {x.other_doc_id for x in got if x.doc_id == 900} == {500}


def test_a_copy_is_found_beside_a_text_that_holds_all_its_pieces(docs_of):
    r = random.Random(12)
    rows = []
    for k in range(6):
        words = [f"t{k}_{r.randrange(10_000)}" for _ in range(120)]
        pieces = [words[i:i + 8] for i in range(0, 117, 5)]  # all runs of four, in another order
        r.shuffle(pieces)
        rows.append((10 * k, " ".join(" ".join(x) + f" n{k}_{i} m{k}_{i}" for i, x in enumerate(pieces))))
        rows.append((10 * k + 1, " ".join(f"z{k}_{i}" if i % 6 == 3 else x for i, x in enumerate(words))))
        rows.append((10 * k + 2, " ".join(words)))
    found = chaining.repeated_passages(docs_of(*rows)).collect()
    assert {(x.doc_id, x.other_doc_id) for x in found} >= {(10 * k + 2, 10 * k + 1) for k in range(6)}


def test_chains_decide_what_is_aligned(docs_of):
    one, two = prose(35, 780).split(), prose(35, 781).split()
    rows = [(1, " ".join(one + two)), (2, " ".join(one + [f"put{k}" for k in range(12)] + two)),  # no half has 50 words alone
            (3, " ".join(two + prose(40, 782).split() + one))]  # the halves in the other order are no passage
    found = chaining.repeated_passages(docs_of(*rows)).collect()
    assert [(x.doc_id, x.other_doc_id, x.start_word, x.end_word) for x in found] == [(2, 1, 0, 82)]


def test_passages_of_stock_lines_are_found(docs_of):
    r = random.Random(21)
    lines = [prose(r.randint(10, 22), 800 + k) for k in range(30)]
    rows, want = [(k, " ".join(r.choice(lines) + (" " + prose(9, 830 + 7 * k + j) if r.random() < 0.5 else "") for j in range(8))) for k in range(60)], {}
    for k in range(60):
        source = rows[r.randrange(len(rows))][1].split()
        at = r.randrange(max(1, len(source) - 70))
        part = source[at:at + 70]
        copy = reworded(part, 0.08, r)
        head = prose(25, 2000 + k) + " " + " ".join(r.choice(lines) for _ in range(2))
        if len(part) >= 50 and close_passage(part, copy):
            want[1000 + k] = set(range(len(head.split()), len(head.split()) + len(copy)))
        rows.append((1000 + k, head + " " + " ".join(copy) + " " + prose(25, 3000 + k)))
    found = covered(chaining.repeated_passages(docs_of(*rows)).collect())
    hit = sum(len(found.get(i, set()) & w) >= 0.8 * len(w) for i, w in want.items())
    assert len(want) > 50 and hit >= 0.9 * len(want)


def test_simhash(docs_of):
    got = sh.near_duplicates(odd(docs_of)).collect()
    rows = sorted(ODD, key=lambda x: (x[0] is None, x[0] or 0))
    rows = [(i, t) for i, t in rows if i != 6]
    prints = [simhash(t) for _, t in rows]
    by_class = classes(prints, 2)
    low = {c: min((i for (i, _), k in zip(rows, by_class) if k == c and i is not None), default=None) for c in by_class}
    want = sorted((i or -1, f"{p:016x}", low[c]) for (i, _), p, c in zip(rows, prints, by_class))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in got if r.doc_id != 6) == want
    kept = sh.drop_near_duplicates(odd(docs_of))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 9] and kept.filter("doc_id is null").count() == 2
    assert sh.near_duplicates(empty(docs_of)).count() == 0 and sh.drop_near_duplicates(empty(docs_of)).count() == 0


def test_an_id_with_several_texts_is_judged_text_by_text(docs_of):
    one, other, third = prose(80, 900), prose(80, 901), prose(80, 902)
    docs = docs_of((3, one), (5, other), (5, one), (5, third), (7, third), (5, other))
    kept = sorted((r.doc_id, r.text) for r in sh.drop_near_duplicates(docs).collect())
    assert kept == sorted([(3, one), (5, other), (5, third)])


@pytest.mark.parametrize("shard", [256, 4])
def test_hot_shards_lose_no_link(spark, shard):
    r = random.Random(3)
    base = r.getrandbits(64)
    values = sorted({base ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 5))) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)})
    values = [v & (1 << 64) - 1 for v in values]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    roots = {x.node: x.root for x in shared.components(sh.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, shard=shard)).collect()}
    want = classes(values, 2)
    groups = {}
    for v, c in zip(signed, want):
        groups.setdefault(c, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in shared.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 900: 900, 901: 900}


def test_language_model(docs_of):
    docs = odd(docs_of)
    got = interpolation.score(docs, interpolation.train(docs), ["doc_id"]).collect()
    assert len(got) == len(ODD) and sorted(r.n_tokens for r in got if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert all(r.score >= r.base_score - 50 and r.score < 0 for r in got)
    blank = interpolation.score(docs, interpolation.train(empty(docs_of)), ["doc_id"]).collect()
    assert {(r.n_known, r.train_tokens) for r in blank} == {(0, 0)} and all(abs(r.base_score) < 1e-9 for r in blank)
    assert interpolation.score(empty(docs_of), interpolation.train(docs), ["doc_id"]).count() == 0


@pytest.mark.parametrize("block,part", [(1 << 20, 1 << 21), (2000, 3000)])
def test_language_model_keeps_bigrams_of_rare_contexts(docs_of, monkeypatch, block, part):
    monkeypatch.setattr(interpolation, "BLOCK", block)
    monkeypatch.setattr(interpolation, "PART", part)
    r = random.Random(6)
    names = [f"n{k}" for k in range(40)]
    train = [(k, " ".join(prose(400, 3000 + k).split() + [f"{w} {w}end" for w in r.sample(names, 6)])) for k in range(120)]
    held = [(900, prose(5, 3999)), (901, " ".join(f"{w} {w}end" for w in names)), (902, "n1 n2end unseen n3 n3end")]
    got = {x.doc_id: x for x in interpolation.score(docs_of(*held), interpolation.train(docs_of(*train)), ["doc_id"]).collect()}
    # every word: context count, and the mixture of its bigram and its unigram estimate, by hand
    tokens = [t.split() + ["</s>"] for _, t in train]
    one, two = Counter(w for t in tokens for w in t), Counter(p for t in tokens for p in zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    p1 = {w: (c + 0.1) / (n + 0.1 * (v + 1)) for w, c in one.items()}
    none = 0.1 / (n + 0.1 * (v + 1))
    bins = {}
    for (a, b), c in two.items():
        if one[a] >= 2:
            key = one[a].bit_length() - 1, round(float(np.log((c - 1) / (one[a] - 1) / p1[b]) * 16)) if c > 1 else None
            bins[key] = bins.get(key, 0) + c
    w = interpolation.learn_weights([(*k, float(c)) for k, c in bins.items()])
    for i, text in held:
        t = text.split() + ["</s>"]
        want = np.log10(p1.get(t[0], none))
        for a, b in zip(t, t[1:]):
            s = w[one[a].bit_length() - 1] if one[a] >= 2 else 0.0
            want += np.log10(s * two[a, b] / max(one[a], 1) + (1 - s) * p1.get(b, none))
        assert abs(got[i].score - want) < 0.02 * abs(want)
    assert got[901].score > got[901].base_score + 40


def test_weights_follow_the_evidence():
    w = interpolation.learn_weights([(0, 32, 100.0), (0, None, 1.0), (1, None, 50.0), (1, 32, 1.0)])
    assert w[0] > 0.8 and w[1] < 0.1 and (w[2:] == 0).all()


def test_toxicity_learns_one_text_per_id(spark, docs_of):
    rows = [(i, prose(30, 7000 + i) + (" grumblefoot" if i % 2 else "")) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once, often = docs_of(*rows), docs_of(*rows * 5, *[(i, text + " zz") for i, text in rows])
    held = docs_of((900, prose(30, 7900)), (901, prose(30, 7901) + " grumblefoot"))
    one, many = (sorted(map(tuple, toxkernel.score(held, toxkernel.learn(d, labels), ["doc_id"]).collect())) for d in (once, often))
    assert one == many


def reshuffled(words, tag):
    """Texts that together hold every run of four of the words, in pieces of eight that do not follow each other."""
    pieces = [words[i:i + 8] for i in range(0, len(words) - 3, 5)]
    return [" ".join(" ".join(x) + f" {tag}a{k} {tag}b{k}" for k, x in enumerate(pieces[half::2])) for half in (0, 1)]


@pytest.mark.parametrize("between", [1, 30])
def test_a_fuzzy_copy_of_stock_text_is_compared_with_every_earlier_text(docs_of, between):
    """Every seed of the copy is in more than four texts; its source is neither the first nor the previous one of them."""
    rows = []
    for k in range(4):
        words = [f"t{k}_{i}" for i in range(120)]
        copy = [f"new{k}_{i}" if i % 6 == 3 else x for i, x in enumerate(words)]
        stock = lambda first, n: [(1000 * k + first + 2 * j + h, x) for j in range(n) for h, x in enumerate(reshuffled(words, f"{k}x{first}x{j}x"))]  # noqa: E731, B023
        rows += stock(0, 6) + [(1000 * k + 300, " ".join(words))] + stock(400, between) + [(1000 * k + 900, " ".join(copy))]
    found = chaining.repeated_passages(docs_of(*rows)).collect()
    got = covered(found)
    assert all(got.get(1000 * k + 900, set()) >= set(range(4, 116)) for k in range(4))
    assert {x.other_doc_id for x in found if x.doc_id % 1000 == 900} == {1000 * k + 300 for k in range(4)}


def test_stock_lines_alone_make_no_passage(docs_of):
    line = prose(19, 790)
    rows = [(k, prose(60, 3000 + 2 * k) + " " + line + " " + prose(60, 3001 + 2 * k)) for k in range(300)]
    assert chaining.repeated_passages(docs_of(*rows)).count() == 0


def test_what_a_hot_occurrence_meets():
    import numpy as np
    r = np.random.default_rng(3)
    n, size = 400, 50
    near = r.integers(0, chaining.ABSENT, (n, 2 * size + chaining.K), dtype=np.uint8)
    near[:, size - 4:size + 8] = 7 + np.arange(12)  # a stock line
    near[350] = near[40]  # the same words
    near[351] = np.where(r.random(near.shape[1]) < 0.15, r.integers(0, chaining.ABSENT, near.shape[1]), near[200])
    near[351, size:size + chaining.K] = near[200, size:size + chaining.K]
    near[352, 20:] = near[100, 20:]  # the text before the line differs
    near[352, :20], near[100, :20] = chaining.ABSENT, chaining.ABSENT
    mine, theirs = chaining._meet(np.arange(n), near, size, 0.8)
    assert set(zip(mine.tolist(), theirs.tolist())) == {(350, 40), (351, 200), (352, 100)}
    packed = [np.packbits(np.unpackbits(x[:, None], axis=1)[:, 8 - chaining.NEAR_BITS:].ravel()).tobytes() for x in near]
    assert (chaining._unpacked(packed, size) == near).all()
