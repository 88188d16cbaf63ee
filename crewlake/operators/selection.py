"""Exact order statistics per group without a group's values in one place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlake.session import kept

#: Ranges into which a round cuts what is left of a group, and values that may be sorted together at the end.
BINS, FEW = 4096, 4096


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def exact_percentile(rows: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """One row per group (keys, ``name``): the value below which ``share`` of a group's values lie, interpolated as SQL does.

    The two neighbouring ranks are searched for at once.  A round cuts the range that is known to hold a rank into bins and
    counts them, which is summed in the tasks before anything is sent; the bin that holds the rank, with the least and
    greatest value in it, is the next range.  Every round splits the least from the greatest value, so it ends; ranges of few
    values are sorted at once.  Values that are NULL or not a number do not count; a group without values has a NULL result.
    """
    data = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    groups = kept(data.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    place = (F.col("_n") - 1) * F.lit(float(share))
    # one row per rank: how many values of the range lie before it, and the range
    ranks = groups.select(*keys, "_low", "_high", F.col("_n").alias("_left"), F.explode(F.array_distinct(F.array(
        F.floor(place).cast("long"), F.ceil(place).cast("long")))).alias("_rank")).withColumn("_skip", F.col("_rank"))
    done: list[DataFrame] = []
    while True:
        ranks = kept(ranks)
        done.append(ranks.filter("_low = _high").select(*keys, "_rank", F.col("_low").alias("_x")))
        few = ranks.filter(f"_low < _high AND _left <= {FEW}")
        met = data.join(few.select(*[F.col(k).alias(f"k_{k}") for k in keys], "_rank", "_skip", "_low", "_high"),
                        reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]) & F.col("_v").between(F.col("_low"), F.col("_high")))
        done.append(met.groupBy(*keys, "_rank", "_skip").agg(F.sort_array(F.collect_list("_v")).alias("_all")).select(
            *keys, "_rank", F.get("_all", F.col("_skip").cast("int")).alias("_x")))
        open_ranks = ranks.filter(f"_low < _high AND _left > {FEW}")
        if open_ranks.isEmpty():
            break
        asked = open_ranks.select(*[F.col(k).alias(f"k_{k}") for k in keys], "_rank", "_skip", "_low", "_high")
        inside = data.join(asked, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys])
                           & F.col("_v").between(F.col("_low"), F.col("_high")))
        # halves first, so that a range wider than the largest number does not overflow
        bin_of = F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * BINS)
        bins = inside.groupBy(*keys, "_rank", "_skip", F.least(F.lit(BINS - 1), bin_of).alias("_bin")).agg(
            F.count("*").alias("_left"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = Window.partitionBy(*keys, "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_ahead", F.coalesce(F.sum("_left").over(before), F.lit(0)))  # at most BINS rows per rank
        ranks = bins.filter("_skip >= _ahead AND _skip < _ahead + _left").select(
            *keys, "_low", "_high", "_left", "_rank", (F.col("_skip") - F.col("_ahead")).alias("_skip"))
    found = reduce(DataFrame.unionByName, done).groupBy(*keys).agg(F.min_by("_x", "_rank").alias("_a"), F.max_by("_x", "_rank").alias("_b"))
    both = groups.join(found, _same(groups, found, keys), "left").select(*[groups[k] for k in keys], "_n", "_a", "_b")
    part = (F.col("_n") - 1) * F.lit(float(share)) - F.floor((F.col("_n") - 1) * F.lit(float(share)))
    every = rows.select(*keys).distinct()
    out = both.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias(name))
    return every.join(out, _same(every, out, keys), "left").select(*[every[k] for k in keys], name)
