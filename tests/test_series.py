import random

import pytest
from pyspark.sql import functions as F

from crewlake.functions.ordered import numbered
from crewlake.operators import analytics as A

SHAPE = "metric string, date int, value double"


def _series():
    rnd = random.Random(4)
    rows = [("hot", i, float(rnd.choice([1, 2, 3, 40]))) for i in range(700)] + [("cold", i, float(i % 5)) for i in range(9)]
    return rows + [("one", 1, 2.0), (None, 1, 3.0), (None, 2, None), (None, 3, 5.0)]


@pytest.mark.parametrize("size", [14, 33, 100_000])
def test_parts_equal_one_window(spark, size):
    df = spark.createDataFrame(_series(), SHAPE).repartition(5)
    want = sorted(map(tuple, A.trend_deltas(df).select("metric", "date", "value", "prev", "delta", "anomaly").collect()), key=str)
    got = sorted(map(tuple, A.series_deltas(df, "metric", ["date"], size).select("metric", "date", "value", "prev", "delta", "anomaly").collect()), key=str)
    assert got == want and any(r[-1] for r in got)


def test_a_hot_key_is_cut(spark):
    df = spark.createDataFrame(_series(), SHAPE)
    got = numbered(df, ["metric"], ["date"], "n")
    assert {(r.metric, r.date): r.n for r in got.collect()} == {
        (m, d): sorted(x for k, x, _ in _series() if k == m).index(d) for m, d, _ in _series()}
    with pytest.raises(ValueError):
        A.series_deltas(df, "metric", ["date"], 3)
    assert A.series_deltas(df.limit(0), "metric", ["date"]).count() == 0
    assert A.series_deltas(df, "metric", ["date"], 20).filter(F.col("metric") == "hot").count() == 699
