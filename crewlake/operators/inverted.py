"""Keyword search on a stored inverted index that reads only the blocks which can still hold a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewlake.operators.retrieve import tokens
from crewlake.session import kept, new_folder

#: Items per block and blocks per head row: the bits of a long.
BITS = 6
#: Blocks per query in the first wave, and how much larger each further wave is.
WAVE, GROWTH = 16, 16
#: Up to so many different query words are handed to the scan as a list; the join decides in any case.
LISTED = 1000


def _mark(c: Column) -> Column:
    """A long with the bit of ``c``'s last binary digits set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND((1 << BITS) - 1).cast("int"))


def _per_bit(masks: Column) -> Column:
    """How many of an array of longs have each bit set, as an array over the bits."""
    return F.transform(F.sequence(F.lit(0), F.lit((1 << BITS) - 1)), lambda i: F.aggregate(
        masks, F.lit(0), lambda n, m: n + F.call_function("shiftright", m, i).bitwiseAND(1).cast("int")))


class KeywordIndex:
    """Distinct words of texts, stored by word and block.

    Items are numbered in their order; 64 consecutive ones are a block.  ``postings`` (term, block, bits) has a bit per item of
    the block that holds the word, ``heads`` (term, head, blocks, items) a bit per block of 64 consecutive blocks, ``items``
    (no, item, terms) the numbers.  Files of postings and heads are sorted by word and place: a word in a third of all texts is
    spread over many files, and a scan skips the pages of other words.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.items, self.postings, self.heads = (spark.read.parquet(f"{root}/{name}") for name in ("items", "postings", "heads"))

    @classmethod
    def build(cls, items: DataFrame, item: str, body: str, root: str | None = None) -> KeywordIndex:
        """Index all rows of ``items`` under ``root``, by default a new folder in the shared one.

        A NULL text has no words; an item that is there twice is two items.
        """
        spark = items.sparkSession
        root = root or new_folder(spark, "words")
        # words are taken after the sort, which reads its input twice
        ordered = items.select(F.col(item).alias("item"), F.col(body).alias("body")).sort("item")
        terms = F.coalesce(tokens(F.col("body")), F.array().cast("array<string>")).alias("terms")
        numbered = kept(ordered.select(F.monotonically_increasing_id().alias("no"), "item", terms), f"{root}/items")
        words = numbered.select("no", F.explode("terms").alias("term"))
        block = F.call_function("shiftright", F.col("no"), F.lit(BITS))
        rows = words.select("term", block.alias("block"), _mark(F.col("no")).alias("bit")).groupBy("term", "block").agg(F.bit_or("bit").alias("bits"))
        postings = kept(rows.sortWithinPartitions("term", "block"), f"{root}/postings")  # dealt by word and block
        head = F.call_function("shiftright", F.col("block"), F.lit(BITS))
        heads = postings.groupBy("term", head.alias("head")).agg(
            F.bit_or(_mark(F.col("block"))).alias("blocks"), F.sum(F.bit_count("bits")).cast("long").alias("items"))
        heads.repartitionByRange("term", "head").sortWithinPartitions("term", "head").write.parquet(f"{root}/heads")
        return cls(spark, root)

    def _bounds(self, words: DataFrame, listed: Column) -> DataFrame:
        """(query_id, block, bound): how many words of the query occur in the block, and so at most in one item of it."""
        met = self.heads.filter(listed).join(words, "term").groupBy("query_id", "head").agg(F.collect_list("blocks").alias("masks"))
        each = met.select("query_id", "head", F.posexplode(_per_bit(F.col("masks"))).alias("i", "bound")).filter("bound > 0")
        return each.select("query_id", (F.col("head") * (1 << BITS) + F.col("i")).alias("block"), "bound")

    def search(self, queries: DataFrame, query_id: str, text: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
        """The ``k`` items that hold the largest share of each query's distinct words, and what was read for that.

        Returns (query_id, item, rank, score) and (query_id, postings, postings_read).  Queries are rows with different ids;
        those without a word, or whose words are nowhere, have no hits.  Equal scores rank by item, as in a scan.

        Blocks are read in waves, those with the highest bounds first and the foremost of equal ones, and a block is dropped
        once ``k`` items are known that no item of it can pass.  All results are exact: the waves end when no block is left.
        """
        asked = kept(queries.select(F.col(query_id).alias("query_id"), tokens(F.col(text)).alias("words")).filter(F.size("words") > 0))
        words = asked.select("query_id", F.explode("words").alias("term"))
        some = words.select("term").distinct().limit(LISTED + 1).collect()
        listed = F.lit(True) if len(some) > LISTED else F.col("term").isin([r.term for r in some])
        left = kept(self._bounds(words, listed))
        best = asked.limit(0).select("query_id", F.lit(0).cast("long").alias("no"), F.lit(0).alias("hits"))
        reads, wave = [], WAVE
        foremost = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        ranked = Window.partitionBy("query_id").orderBy(F.desc("hits"), "no")
        while True:
            chosen = kept(left.withColumn("_n", F.row_number().over(foremost)).filter(F.col("_n") <= wave).drop("_n"))
            ends = chosen.agg(F.min("block"), F.max("block")).first()
            if ends[0] is None:
                break
            near = self.postings.filter(listed & F.col("block").between(*ends))
            met = near.join(words, "term").join(chosen.select("query_id", "block"), ["query_id", "block"], "left_semi")
            read = kept(met.groupBy("query_id", "block").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"), F.collect_list("bits").alias("masks")).select(
                "query_id", "block", "n", _per_bit(F.col("masks")).alias("hits")))
            reads.append(read.select("query_id", "n"))
            found = read.select("query_id", "block", F.posexplode("hits").alias("i", "hits")).filter("hits > 0").select(
                "query_id", (F.col("block") * (1 << BITS) + F.col("i")).alias("no"), "hits")
            best = kept(best.unionByName(found).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= int(k)))
            last = best.filter(F.col("rank") == int(k)).select(
                "query_id", F.col("hits").alias("_hits"), F.call_function("shiftright", F.col("no"), F.lit(BITS)).alias("_block"))
            best = best.drop("rank")
            cut = chosen.groupBy("query_id").agg(F.max_by(F.struct("bound", "block"), F.struct(-F.col("bound"), "block")).alias("_cut"))
            after = F.col("bound") < F.col("_cut.bound")
            after |= (F.col("bound") == F.col("_cut.bound")) & (F.col("block") > F.col("_cut.block"))
            passes = F.col("_hits").isNull() | (F.col("bound") > F.col("_hits"))
            passes |= (F.col("bound") == F.col("_hits")) & (F.col("block") < F.col("_block"))
            left = kept(left.join(cut, "query_id").filter(after).join(last, "query_id", "left").filter(passes).select("query_id", "block", "bound"))
            wave *= GROWTH
        rank = F.row_number().over(ranked)
        hits = best.withColumn("rank", rank).join(self.items.select("no", "item"), "no").join(asked, "query_id").select(
            "query_id", "item", "rank", F.round(F.col("hits") / F.size("words"), 4).alias("score"))
        every = self.heads.filter(listed).join(words, "term").groupBy("query_id").agg(F.sum("items").alias("postings"))
        done = every.limit(0).select("query_id", F.col("postings").alias("n"))
        for part in reads:
            done = done.unionByName(part)
        reading = asked.select("query_id").join(every, "query_id", "left").join(
            done.groupBy("query_id").agg(F.sum("n").alias("postings_read")), "query_id", "left")
        return hits, reading.select("query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("postings", "postings_read")])
