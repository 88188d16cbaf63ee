import random

import pytest
from pyspark.sql import functions as F

from crewlake.operators import inverted
from crewlake.operators import retrieve as RT


def _texts(n, seed):
    rnd = random.Random(seed)
    names = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(rnd.choices(names, weights, k=rnd.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("wave", [1, 16])
def test_index_finds_what_the_scan_finds(spark, monkeypatch, wave):
    monkeypatch.setattr(inverted, "WAVE", wave)
    monkeypatch.setattr(inverted, "GROWTH", 3)
    rows = _texts(1500, 1) + [(7, "w1 w2"), (None, "w399 w398"), (5000, None), (5001, " ,; ")]
    docs = spark.createDataFrame(rows, "id int, body string").repartition(7)
    asked = {"common": "w0", "pair": "w0 w1", "mixed": "W0 w350 w7, nowhere", "rare": "w399 w398 w397", "none": "qqq", "blank": " - ",
             "long": " ".join(f"w{i}" for i in range(0, 400, 9))}
    asked_rows = spark.createDataFrame(list(asked.items()) + [("null", None)], "name string, q string")
    hits, reading = inverted.KeywordIndex.build(docs, "id", "body").search(asked_rows, "name", "q", 5)
    want = RT.keyword_search(docs, {n: q for n, q in asked.items() if n != "blank"}, "id", "body", 5)
    assert sorted((r.query_id, r.rank, r.item, r.score) for r in hits.collect()) == sorted((r.query_id, r.rank, r.id, r.score) for r in want.collect())
    got = {r.query_id: (r.postings, r.postings_read) for r in reading.collect()}
    assert set(got) == set(asked) - {"blank"} and got["none"] == (0, 0)
    assert all(read <= every for every, read in got.values())
    if wave == 1:  # the first blocks settle a common word; a rare pair is settled by the blocks that hold it
        assert got["common"][1] * 4 < got["common"][0] and got["pair"][1] * 2 < got["pair"][0]


def test_building_takes_words_once_and_deals_postings_once(spark, monkeypatch):
    plans, kept = {}, inverted.kept

    def spy(df, path=None):
        plans[(path or "").rsplit("/", 1)[-1]] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, path)

    monkeypatch.setattr(inverted, "kept", spy)
    inverted.KeywordIndex.build(spark.createDataFrame(_texts(80, 3), "id int, body string"), "id", "body")
    assert "RepartitionByExpression" not in plans["postings"]
    assert plans["items"].index("split(") < plans["items"].index("Sort [")  # above the sort, whose exchange reads its input twice


def test_empty_tables(spark):
    docs = spark.createDataFrame(_texts(80, 2), "id int, body string")
    asked = spark.createDataFrame([("a", "w1 w2")], "name string, q string")
    for some, q in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.withColumn("body", F.lit(None).cast("string")), asked)):
        hits, _ = inverted.KeywordIndex.build(some, "id", "body").search(q, "name", "q")
        assert hits.columns == ["query_id", "item", "rank", "score"] and hits.count() == 0
