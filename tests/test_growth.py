"""What lets work grow with its input alone: spread NULL keys, short compiled rows, one pass per table."""

import re

from pyspark.sql import functions as F

from crewlake.functions.scalars import local_ts
from crewlake.operators.gold import match
from crewlake.operators.reconcile import roster_lines
from crewlake.operators.resolve import WORD, alias_table, detect_mentions, vocabulary
from crewlake.operators.silver import lookup_title
from crewlake.plans.stand_in import Tables

DIR = "/root/testdata/sf0.001"


def _with(spark, settings: dict, run):
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return run()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _method_sizes(df) -> list[int]:
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    left = spark.range(800).select(F.col("id").alias("txn"), F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).alias("who"))
    right = spark.range(800).select(F.col("id").alias("id"), F.concat(F.lit("p"), F.col("id")).alias("Title"))

    def sizes():
        for out in (match(left, right.withColumnRenamed("id", "key"), "who", "key"), lookup_title(left, "who", right, "name")):
            rows = out.withColumn("part", F.spark_partition_id()).collect()
            assert len(rows) == 800
            assert {r.txn: r[2] for r in rows} == {i: f"p{i}" if i % 4 == 0 else None for i in range(800)}
            counts = [sum(r.part == p for r in rows) for p in {r.part for r in rows}]
            assert max(counts) < 300  # 600 rows have no key

    _with(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}, sizes)


def test_roster_lines_compile_to_short_methods(spark):
    """The JVM runs methods of more than 8,000 bytes uncompiled, many times slower."""
    sizes = _method_sizes(roster_lines(Tables(spark, DIR).roster_list))
    assert sizes and max(sizes) <= 8000


def test_local_times_of_all_spellings(spark):
    said = {"2024-01-02T20:30:00Z": "2024-01-03 04:30:00", " 2024-01-02T20:30:00Z ": "2024-01-03 04:30:00", "2024-01-02T20:30:00": "2024-01-02 20:30:00",
            "2/1/2024 07:00": "2024-01-02 07:00:00", "02/01/2024": "2024-01-02 00:00:00", "2024-01-02": "2024-01-02 00:00:00", "2024-01-02Z": "2024-01-02 00:00:00",
            "": None, "nan": None, "NaN": None, "soon": None, "T1Z": None, None: None}
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", F.date_format(local_ts("t"), "yyyy-MM-dd HH:mm:ss").alias("at")).collect()
    assert {r.t: r.at for r in rows} == said


def test_phrases_of_a_question_are_taken_once(spark):
    vocab = vocabulary(spark.createDataFrame([("site", "small ring", 0), ("site", "hot bolt", 0)], "type string, value string, source_rank int"))
    asked = spark.createDataFrame([(1, "hours at small ring this week"), (2, "site = hot bolt"), (3, "nothing"), (4, None), (1, "hours at small ring this week")],
                                  "question_id int, text string")
    found = detect_mentions(asked, vocab, alias_table(spark, {"SR": "small ring"}))
    assert sorted((r.question_id, r.value) for r in found.collect()) == [(1, "small ring"), (2, "hot bolt")]
    assert WORD not in found._jdf.queryExecution().optimizedPlan().toString()
