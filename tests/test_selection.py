import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crewlake.operators import selection


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_percentiles_equal_sorting(spark, monkeypatch, share):
    monkeypatch.setattr(selection, "FEW", 20)
    monkeypatch.setattr(selection, "BINS", 8)
    rnd = random.Random(2)
    groups = {"same": [5.0] * 300, "two": [1.0, 2.0], "one": [7.5], None: [rnd.gauss(0, 1) for _ in range(200)], "wide": [1.7e308, -1.7e308, 0.0] * 30,
              "steep": [10.0 ** rnd.randint(-9, 9) for _ in range(400)], "empty": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("empty", None), ("two", None), ("two", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("h", F.lit(1))
    got = {r.g: r.p for r in selection.exact_percentile(df, ["g", "h"], "v", share, "p").collect()}
    assert set(got) == set(groups) and got["empty"] is None
    for g, vs in groups.items():
        if vs and g != "wide":
            assert got[g] == pytest.approx(np.percentile(vs, 100 * share), rel=1e-12, abs=1e-300)
    assert got["wide"] in (-1.7e308, 0.0, 1.7e308)
