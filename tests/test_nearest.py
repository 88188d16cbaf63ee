import numpy as np
import pytest
from pyspark.sql import functions as F

from crewlake.operators import nearest
from crewlake.operators import retrieve as RT


def _vectors(n, seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, 8))
    rows = [(i, (centres[rnd.integers(12)] + 0.3 * rnd.normal(size=8)).round(4).tolist()) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(60)] + [(9001, None), (9002, [0.0] * 8), (9003, [1.0, 2.0]), (None, rows[5][1])]


def _found(df, item):
    return sorted((r.query_id, r["rank"], -1 if r[item] is None else r[item], r.score) for r in df.collect())


@pytest.mark.parametrize("shard", [4096, 20])
def test_index_against_scan(spark, monkeypatch, shard):
    monkeypatch.setattr(nearest, "SHARD", shard)
    monkeypatch.setattr(nearest, "TOGETHER", shard // 4)
    rows = _vectors(900, 1)
    items = spark.createDataFrame(rows, "id int, v array<double>")
    asked = {f"q{i}": rows[i][1] for i in range(0, 900, 45)}
    table = spark.createDataFrame([*asked.items(), ("zero", [0.0] * 8), ("none", None), ("short", [1.0])], "name string, q array<double>")
    index = nearest.VectorIndex.build(items, "id", "v", lists=16)
    assert index.vectors.count() == 961
    want = _found(RT.vector_search(items.filter("size(v) = 8"), asked, "id", "v", 5), "id")
    assert _found(index.search(table, "name", "q", 5, probes=2, exact=True), "item") == want
    near = _found(index.search(table, "name", "q", 5), "item")
    assert len({x[:1] + x[2:3] for x in near} & {x[:1] + x[2:3] for x in want}) >= 0.9 * len(want)


def test_a_query_goes_once_to_neighbouring_lists(spark):
    items = spark.createDataFrame(_vectors(900, 3), "id int, v array<double>")
    index = nearest.VectorIndex.build(items, "id", "v", lists=16)
    asked = spark.createDataFrame([(i, _vectors(9, 4)[i][1]) for i in range(9)], "id int, q array<double>")
    left = index._plan(asked.select(F.col("id").alias("query_id"), "q"), True).withColumn("least", F.lit(0.0))
    looks = index._looks(left, 0, len(index.names)).collect()  # all lists together are no more than one group holds
    assert len(looks) == 9 and max(len(r.lists) for r in looks) > 8
    assert all(set(r.lists) <= set(index.names.tolist()) and len(set(r.lists)) == len(r.lists) for r in looks)


def test_empty_tables(spark):
    items = spark.createDataFrame(_vectors(30, 2), "id int, v array<double>")
    asked = spark.createDataFrame([("a", [1.0] * 8)], "name string, q array<double>")
    for some, q in ((items.limit(0), asked), (items, asked.limit(0)), (items.filter("id = 9002"), asked)):
        assert nearest.VectorIndex.build(some, "id", "v").search(q, "name", "q", exact=True).count() == 0
