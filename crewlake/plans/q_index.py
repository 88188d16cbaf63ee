"""Queries over stored indexes, digests and long series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.operators import analytics as A
from crewlake.operators.hashtree import HashTree, differing_keys
from crewlake.operators.inverted import KeywordIndex
from crewlake.operators.nearest import VectorIndex
from crewlake.plans.registry import add
from crewlake.plans.stand_in import Tables


def _asked(t: Tables) -> DataFrame:
    """Every benchmark item as a question to all documents."""
    index = KeywordIndex.build(t.raw("documents"), "doc_id", "text")
    hits, _ = index.search(t.raw("benchmark"), "item_id", "text", 5)
    return hits.select(F.col("query_id").alias("item_id"), F.col("item").alias("doc_id"), "rank", "score")


add("keyword_index_search", _asked, r"""
WITH q AS (SELECT item_id, list_filter(list_distinct(regexp_split_to_array(lower(text),'[^\p{L}\p{N}]+')), lambda x: x <> '') AS words FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text),'[^\p{L}\p{N}]+'))) AS word FROM documents),
s AS (SELECT item_id, doc_id, count(*) / any_value(n) AS raw FROM d JOIN (SELECT item_id, len(words) AS n, unnest(words) AS word FROM q) USING (word) GROUP BY 1, 2)
SELECT item_id, doc_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, doc_id) AS INTEGER) AS rank, round(raw,4) AS score
FROM s QUALIFY rank <= 5""")


def _differing(t: Tables) -> DataFrame:
    """Orders against a copy with some prices changed, some rows lost and some keys new."""
    a = t.raw("orders")
    key = F.col("o_orderkey")
    b = a.filter(key % 1009 != 5).withColumn("o_totalprice", F.when(key % 997 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    b = b.unionByName(a.filter(key % 1013 == 7).withColumn("o_orderkey", -key))
    return differing_keys(a, b, HashTree.build(a, "o_orderkey", 256), HashTree.build(b, "o_orderkey", 256))


add("parity_keys", _differing, """
SELECT o_orderkey AS key, CAST(1 AS BIGINT) AS rows_a, CAST(CASE WHEN o_orderkey % 1009 = 5 THEN 0 ELSE 1 END AS BIGINT) AS rows_b,
  CASE WHEN o_orderkey % 1009 = 5 THEN 'only_a' ELSE 'changed' END AS state FROM orders WHERE o_orderkey % 1009 = 5 OR o_orderkey % 997 = 3
UNION ALL SELECT -o_orderkey, 0, 1, 'only_b' FROM orders WHERE o_orderkey % 1013 = 7""")


def _nearest(t: Tables) -> DataFrame:
    """Every twentieth vector against all vectors."""
    vectors = t.raw("embeddings").select("vec_id", "embedding")
    hits = VectorIndex.build(vectors, "vec_id", "embedding").search(vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5, exact=True)
    return hits.select(F.col("query_id").alias("vec_id"), F.col("item").alias("near_id"), "rank", "score")


add("vector_index_search", _nearest, """
WITH s AS (SELECT q.vec_id, e.vec_id AS near_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS raw
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
SELECT vec_id, near_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY raw DESC, near_id) AS INTEGER) AS rank, round(raw,4) AS score
FROM s WHERE raw > 0 QUALIFY rank <= 5""")


def _series(t: Tables) -> DataFrame:
    """Every event's value against the events of its type before it."""
    events = t.raw("events").select("event_type", "ts", "event_id", F.col("value").cast("double").alias("value"))
    return A.series_deltas(events, "event_type", ["ts", "event_id"], 5_000).select("event_type", "event_id", "prev", F.round("delta", 4).alias("delta"), "anomaly")


add("series_deltas", _series, """
SELECT event_type, event_id, prev, round(value - prev, 4) AS delta, coalesce(n >= 7 AND sd > 0 AND abs(value - mean) > 2*sd, FALSE) AS anomaly FROM (
SELECT event_type, event_id, CAST(value AS DOUBLE) AS value, lag(CAST(value AS DOUBLE)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev, count(value) OVER b AS n,
  avg(CAST(value AS DOUBLE)) OVER b AS mean, stddev_pop(CAST(value AS DOUBLE)) OVER b AS sd FROM events
  WINDOW b AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) WHERE prev IS NOT NULL AND value IS NOT NULL""")
