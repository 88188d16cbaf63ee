"""Order-dependent lookups that do not put one key's whole history in one task.

A plain ``lag`` over (worker order by time) sorts everything a worker ever did in a
single task.  Here the history is cut into buckets: inside a bucket an ordinary window
is used, and only one summary row per bucket takes part in the per-key window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewlake.session import kept


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
              values: Sequence[str], *, after: bool = False, only: Column | None = None,
              into: str = "prev") -> DataFrame:
    """Add struct column ``into`` with ``values`` of the previous (or next) row of the same key.

    ``bucket`` must be monotone in ``order``.  With ``only`` rows failing that condition
    are skipped over, which makes this "last known value before this row".
    """
    part, near, far = f"__{into}_part", f"__{into}_near", f"__{into}_far"
    payload = F.struct(*values)
    if only is not None:
        payload = F.when(only, payload)
    rows = df.withColumn(part, bucket)
    asc = [F.col(c).desc() if after else F.col(c).asc() for c in order]
    inside = Window.partitionBy(*keys, part).orderBy(*asc).rowsBetween(Window.unboundedPreceding, -1)
    rows_near = rows.withColumn(near, F.last(payload, ignorenulls=True).over(inside))

    edge = F.min_by if after else F.max_by
    rank = F.struct(*order) if only is None else F.when(only, F.struct(*order))
    carry = rows.groupBy(*keys, part).agg(edge(F.struct(*values), rank).alias(far))
    by = F.col(part).desc() if after else F.col(part).asc()
    across = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumn(far, F.last(far, ignorenulls=True).over(across))
    return (
        rows_near.join(carry, [*keys, part], "left")
        .withColumn(into, F.coalesce(near, far))
        .drop(part, near, far)
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, first: bool = False) -> DataFrame:
    """One whole row per key: the last (or first) by ``order``.

    An aggregation, not a window: duplicates collapse before the shuffle, so a key with
    very many copies costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    pick = F.min_by if first else F.max_by
    order_by = F.struct(*order)
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), order_by).alias("__row"))
    return one.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """Add ``into``, the number from 0 of each row among those of its key in ``order``; NULL keys are one key.

    Rows are sorted over all tasks by key and order, so a hot key lies in many of them; only a count per key and task meets in
    one window.  What was sorted is stored, so a task that is run again numbers alike.
    """
    at, ahead = f"__{into}_at", f"__{into}_ahead"
    by = [*keys, *order]
    placed = kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.spark_partition_id()))
    sums = placed.groupBy(*keys, at).agg(F.count("*").alias(ahead))
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(at).alias("__at"), F.coalesce(F.sum(ahead).over(before), F.lit(0)).alias(ahead))
    inside = Window.partitionBy(*keys, at).orderBy(*order)
    same = F.col(at) == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return placed.withColumn(into, F.row_number().over(inside) - 1).join(sums, same).withColumn(into, F.col(into) + F.col(ahead)).select(*df.columns, into)


def with_edges(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int, size: int, part: str, edge: str) -> DataFrame:
    """Cut every key's rows in ``order`` into parts of ``size`` rows, each led by the ``back`` rows before it.

    ``part`` is the part's number, ``edge`` marks rows that belong to the part before and are there to be looked back at.  A
    window by key and part that looks back at most ``back`` rows gives every other row what a window by key would.
    """
    if size < back:
        raise ValueError("a part must hold the rows that are looked back at")
    n = f"__{part}_n"
    rows = numbered(df, keys, order, n)
    copies = F.array(F.struct(F.floor(F.col(n) / size).alias(part), F.lit(False).alias(edge)),
                     F.when(F.col(n) % size >= size - back, F.struct((F.floor(F.col(n) / size) + 1).alias(part), F.lit(True).alias(edge))))
    return rows.select(*df.columns, F.inline(F.filter(copies, lambda x: x.isNotNull())))
