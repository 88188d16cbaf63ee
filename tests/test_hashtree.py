import random

import pytest
from pyspark.sql import functions as F

from crewlake.operators import hashtree as H

SHAPE = "id long, name string, v double"


def _rows(n, seed):
    rnd = random.Random(seed)
    return [(rnd.randint(-3000, 60_000), rnd.choice(["a", "b", None]), rnd.random()) for _ in range(n)] + [(None, "x", 1.0), (None, None, None)]


def _brute(a, b):
    def by(rows):
        out = {}
        for r in rows:
            out.setdefault(r[0], []).append(r)
        return {k: sorted(v, key=str) for k, v in out.items()}
    x, y = by(a), by(b)
    return {(k, len(x.get(k, [])), len(y.get(k, [])), "only_b" if k not in x else "only_a" if k not in y else "changed")
            for k in x.keys() | y.keys() if x.get(k) != y.get(k)}


@pytest.mark.parametrize("bounds", [200, 1])
def test_differences_equal_brute_force(spark, monkeypatch, bounds):
    monkeypatch.setattr(H, "BOUNDS", bounds)
    a = _rows(3000, 1)
    gone, moved, swapped = a[10], a[20], a[30]
    b = [r for r in a if r is not gone and r is not moved and r is not swapped] + [(moved[0], moved[1], 9.5), (swapped[0], None, swapped[2]), (70_001, "new", 0.0),
                                                                                 a[40], (None, "y", 2.0)]
    random.Random(2).shuffle(b)
    x, y = spark.createDataFrame(a, SHAPE), spark.createDataFrame(b, SHAPE)
    tx, ty = H.HashTree.build(x, "id", 64), H.HashTree.build(y, "id", 64)
    got = {tuple(r) for r in H.differing_keys(x, y, tx, ty).collect()}
    assert got == _brute(a, b) and {r[3] for r in got} >= {"changed", "only_b"}


def test_trees_of_batches_add_up(spark):
    rows = _rows(500, 3)
    whole = H.HashTree.build(spark.createDataFrame(rows, SHAPE), "id", 16)
    one, two = (H.HashTree.build(spark.createDataFrame(part, SHAPE), "id", 16) for part in (rows[:200], rows[200:]))
    assert whole.differing(one.merge(two)).count() == 0 and whole.differing(one).count() > 0
    none = spark.createDataFrame([], SHAPE)
    empty = H.HashTree.build(none, "id", 16)
    assert empty.differing(empty).count() == 0
    assert H.differing_keys(none, spark.createDataFrame(rows, SHAPE), empty, whole).count() == len({r[0] for r in rows})


def test_one_changed_row_is_read_in_its_range_only(spark, tmp_path):
    base = spark.range(200_000).select("id", (F.col("id") * 7 % 1001).alias("v"))
    base.sort("id").write.parquet(f"{tmp_path}/a")
    base.withColumn("v", F.when(F.col("id") == 123_456, -1).otherwise(F.col("v"))).sort("id").write.parquet(f"{tmp_path}/b")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    ta, tb = H.HashTree.build(a, "id"), H.HashTree.build(b, "id")
    ranges = ta.differing(tb)
    assert [r.node for r in ranges.collect()] == [123_456 // 1024]
    assert ta.inside(a, ranges).count() == 1024 and "GreaterThanOrEqual(id,122880)" in ta.inside(a, ranges)._jdf.queryExecution().toString()
    assert [tuple(r) for r in H.differing_keys(a, b, ta, tb).collect()] == [(123_456, 1, 1, "changed")]
