"""Mixing sources to target weights by systematic sampling, in SQL functions only.

Every document of a source expects the same number of copies, target / source size.  Documents of a source are put in a
fixed order, size classes first, so that the running sum spreads over short and long texts alike; with one random offset per
source, a document comes out once for every whole number its stretch of the running sum crosses.

The running sum of a source is not one sorted task: documents are counted per cell (source, size class, hash slot), the
cells are summed up in order, and a document adds its rank within its cell.  Slots follow the source's number of documents,
so that a cell holds about ``CELL`` of them whatever the source holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType

from crewlake.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2
CELL = 5_000
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """Rows (source, source_size, n, target) from (source, source_size, n), one per source.

    Sources in code point order, NULL last, take ``weights`` in turn and share ``percent`` of all words.  A target stops at
    ``most`` times its source and the excess is shared again by weight until none is above.  That end state is a common
    level: target = min(weight * level, most * size).  In the order of most * size / weight the sources that stop come
    first, so the level follows from running sums over the (few) sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    capped = ranked.withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    level = ((F.sum("source_size").over(everything) * (percent / 100.0) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    levels = capped.withColumn("level", level).withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    first_open = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return levels.withColumn("common", first_open["level"]).select(
        "source", "source_size", "n", F.coalesce(F.least(F.col("weight") * F.col("common"), F.col("cap")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, carry: list[str], id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """Carried columns with size, source_size, target and copies of every document.

    size: words of the text (NULL: 0).  NULL sources are one source.  Documents without words expect copies like any other
    but add nothing.  Repeated rows are drawn one by one.  The order within a cell is by size, hash of the id and id, so
    reruns agree.  Sources without words have target 0 and give no copies.
    """
    size = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    ident = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    base = docs.select(F.struct(*carry).alias("_doc"), F.col(source_column).alias("_source"), ident.alias("_id"), size.alias("size"),
                       F.md5(F.concat(F.lit(seed + "|"), ident)).alias("_hash"))
    if all(isinstance(docs.schema[c].dataType, (NumericType, BooleanType, DatetimeType)) for c in carry):
        base = cut(base)  # rows of a few numbers: words are counted once, not once per use
    cells_of = base.withColumn("_class", F.length(F.bin("size")))
    totals = base.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goals = targets(totals, weights, percent, most).withColumn("_slots", F.ceil(F.col("n") / CELL)).select(
        F.col("source").alias("_goal"), "source_size", "target", "_slots")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|source|"), F.coalesce("_source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    slotted = (cells_of.join(goals, F.col("_source").eqNullSafe(F.col("_goal"))).drop("_goal")
               .withColumn("_slot", F.pmod(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long"), F.col("_slots"))))
    cell = ["_source", "_class", "_slot"]
    ahead = Window.partitionBy("_source").orderBy("_class", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slotted.groupBy(*cell).agg(F.count("*").alias("_n")).select(
        F.col("_source").alias("_s"), F.col("_class").alias("_c"), F.col("_slot").alias("_t"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "_hash", "_id"))
    ranked = slotted.withColumn("_rank", within)
    met = ranked.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_slot") == F.col("_t")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("_before") + F.col("_rank")
    copies = (F.floor(offset + rank * expected) - F.floor(offset + (rank - 1) * expected)).cast("long")
    return met.select(*[F.col("_doc")[c].alias(c) for c in carry], "size", "source_size", "target", copies.alias("copies"))
