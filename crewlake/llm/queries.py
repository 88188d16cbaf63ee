"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlake.llm import (chaining, decontam, hostrules, interpolation, langid, merkle, mixing, packing, repair, simhash, suffixes, toxkernel,
                          urltrees)
from crewlake.llm.shared import is_test_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    parser = langid.learn(docs.filter(~is_test_fold("doc_id", 4, 2)))
    said = langid.predict(docs.withColumn("held_out", is_test_fold("doc_id", 4, 2)), parser, carry=["doc_id", "held_out"])
    return said.select("doc_id", "held_out", "lang_pred", "score")


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "item_windows", "coverage", "changed_slots")


def op3_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrees.judge(_table(spark, sf_dir, "pages"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(_table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op5_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxkernel.learn(docs, _table(spark, sf_dir, "labels"))
    return toxkernel.score(docs.withColumn("held_out", is_test_fold("doc_id", 4, 2)), model, ["doc_id", "held_out"])


def op6_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(_table(spark, sf_dir, "documents"), ["doc_id"])
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).drop("kept")


def op8_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chaining.repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start_word", "end_word", "similarity", "other_doc_id", "other_start", "other_end")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, radius=2)


def op10_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", is_test_fold("doc_id", 10, 0))
    return interpolation.learn_and_score(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(_table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tree = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", tampered, {"n_chars": more})
    return tree.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"),
                       F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_language_id, op2_template_decontamination, op3_url_trees, op4_host_rules, op5_toxicity_kernel,
                            op6_systematic_mixing, op7_suffix_dedup, op8_chained_passages, op9_simhash_components, op10_interpolated_lm,
                            op11_conversation_repair, op12_mixture_packing, op13_merkle_manifest)}

_WORD = r"[^\x20\x09-\x0D]+"
#: Statements for the operators that SQL can express; the others learn, hash or align and are tested against plain versions.
ORACLES: dict[str, str] = {
    "op4_host_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM (
  SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams) WHERE c > 1) GROUP BY 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
base AS (SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
judged AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats FROM base),
fails AS (SELECT source, 'short' AS rule, count(*) AS n, count(*) FILTER (short) AS failed FROM judged WHERE source IS NOT NULL GROUP BY 1
  UNION ALL SELECT source, 'repeats', count(*), count(*) FILTER (repeats) FROM judged WHERE source IS NOT NULL GROUP BY 1),
prior AS (SELECT rule, avg(failed / n) AS m, var_pop(failed / n) AS v FROM fails GROUP BY 1),
weighed AS (SELECT rule, m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 1.0 END AS k FROM prior),
hosts AS (SELECT source, max((failed + m * k) / (n + k)) AS rate FROM fails JOIN weighed USING (rule) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, round(rate, 6) AS host_rate,
  NOT (short OR repeats) AND coalesce(rate <= 0.5, TRUE) AS kept FROM judged LEFT JOIN hosts USING (source)""",
    "op6_systematic_mixing": rf"""
WITH d0 AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS ident FROM documents),
d AS (SELECT *, md5('mix-1|' || ident) AS h, length(bin(size)) AS class FROM d0),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT level AS common FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
g AS (SELECT source, source_size, coalesce(least(weight * (SELECT common FROM c), cap), cap) AS target, CAST(ceil(n / 5000.0) AS BIGINT) AS slots FROM l),
placed AS (SELECT d.*, g.source_size, g.target, CAST('0x' || substr(h, 1, 8) AS BIGINT) % slots AS slot,
  CAST('0x' || substr(md5('mix-1|source|' || coalesce(d.source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS start FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slot, size, h, ident) AS r, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e FROM placed)
SELECT doc_id, size, source_size, target, CAST(floor(start + r * e) - floor(start + (r - 1) * e) AS BIGINT) * size AS taken FROM ranked""",
}
