"""Quality gates, sentinel checks, parity, freshness and issues (Q1-Q15)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlake.functions.scalars import AsOf, day
from crewlake.spec import CRITICAL, EXPECTED_EMPTY

# --- fixed values ---------------------------------------------------------------------------
DROP_LIMIT, SWING_LIMIT, HORIZON_DAYS = 0.30, 0.30, 60
STALE_DAYS = {"accounts": 30}
STALE_DEFAULT = 2
LEVELS = {"OK": 0, "WARN": 1, "FAIL": 2}
SEVERITIES = ["low", "medium", "high", "critical"]
NULL_CEILINGS = {
    ("employee_profile", "first_name"): 0.05,
    ("training_compliance", "is_expired"): 0.01,
    ("roster_summary", "roster_date"): 0.02,
    ("weekly_timesheet", "work_date"): 0.0,
    ("project_bridge", "client_code"): 0.10,
}
# ----------------------------------------------------------------------------------------------


def table_counts(tables: Mapping[str, DataFrame], prefix: str = "gold:") -> DataFrame:
    """(key, rows) of many tables; each is one counting scan, the driver sees nothing."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(prefix + name).alias("key"), "rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# --- Q1-Q4: the gate ------------------------------------------------------------------------------

def gold_guard(counts: DataFrame, critical: Sequence[str] = tuple(CRITICAL)) -> DataFrame:
    """Q1: critical tables that are missing or empty."""
    spark = counts.sparkSession
    need = spark.createDataFrame([("gold:" + t,) for t in critical], "key string")
    state = F.when(F.col("rows").isNull(), "MISSING").when(F.col("rows") <= 0, "EMPTY")
    return need.join(counts, "key", "left").select("key", state.alias("problem"), F.lit("FAIL").alias("level")).filter(
        "problem IS NOT NULL")


def row_drops(counts: DataFrame, baseline: DataFrame, exempt: Sequence[str] = tuple(sorted(EXPECTED_EMPTY))) -> DataFrame:
    """Q2: published tables that lost more than 30 % of their rows."""
    base = baseline.select("key", F.col("rows").alias("was"))
    hit = counts.filter(F.col("key").startswith("gold:") & ~F.col("key").isin(list(exempt))).join(base, "key")
    lost = (F.col("was") > 0) & (F.col("rows") >= 0) & (F.col("rows") < F.col("was") * (1 - DROP_LIMIT))
    return hit.filter(lost).select("key", "was", "rows", F.round(100 * (1 - F.col("rows") / F.col("was")), 0).alias("drop_pct"),
                                   F.lit("WARN").alias("level"))


def regressions(counts: DataFrame, baseline: DataFrame, exempt: Sequence[str] = tuple(sorted(EXPECTED_EMPTY))) -> DataFrame:
    """Q3: had rows last run, now none or an error.  ``counts`` may carry a column ``error``."""
    now = counts if "error" in counts.columns else counts.withColumn("error", F.lit(None).cast("string"))
    both = baseline.select("key", F.col("rows").alias("was")).join(now, "key", "full_outer")
    gone = (F.col("was") > 0) & (F.coalesce("rows", F.lit(0)) == 0) & ~F.col("key").isin(list(exempt))
    return both.filter(gone).select("key", "was", F.coalesce("error", F.lit("0 rows")).alias("reason"),
                                    F.lit("WARN").alias("level"))


def guard_report(counts: DataFrame, baseline: DataFrame, critical: Sequence[str] = tuple(CRITICAL)) -> DataFrame:
    """All findings of the gate in one shape."""
    fails = gold_guard(counts, critical).select("level", "key", F.concat(F.lit("critical table "), "problem").alias("detail"))
    drops = row_drops(counts, baseline).select("level", "key", F.concat(
        F.lit("row drop "), F.col("was").cast("string"), F.lit(" to "), F.col("rows").cast("string")).alias("detail"))
    lost = regressions(counts, baseline).select("level", "key", F.concat(F.lit("regression: "), "reason").alias("detail"))
    return fails.unionByName(drops).unionByName(lost)


def next_baseline(counts: DataFrame, baseline: DataFrame, report: DataFrame, strict: bool = False) -> DataFrame:
    """Q4: today's counts become the baseline unless the gate failed (or, strictly, warned)."""
    bad = ["FAIL", "WARN"] if strict else ["FAIL"]
    blocked = report.filter(F.col("level").isin(bad)).limit(1).count() > 0
    return baseline if blocked else counts.select("key", "rows")


# --- Q5-Q8: the sentinel ---------------------------------------------------------------------------------

def check(name: Column, ok: Column, detail: Column, level: str) -> list[Column]:
    passed = F.coalesce(ok, F.lit(False))
    return [name.alias("check"), passed.alias("ok"), detail.cast("string").alias("detail"),
            F.when(passed, "OK").otherwise(level).alias("level")]


def table_checks(counts: DataFrame) -> DataFrame:
    """Q5: every table has rows."""
    return counts.select(*check(F.concat("key", F.lit(": non-empty")), F.col("rows") > 0, F.col("rows"), "FAIL"))


def horizon_check(roster: DataFrame, as_of: AsOf, days: int = HORIZON_DAYS) -> DataFrame:
    """Q5: the roster reaches far enough into the future."""
    need = F.date_format(F.date_add(day(as_of), int(days)), "yyyy-MM-dd")
    top = roster.agg(F.max("roster_date").alias("top"))
    return top.select(*check(F.lit("roster_summary: future horizon"), F.col("top") >= need, F.col("top"), "FAIL"))


def null_rates(df: DataFrame, table: str, ceilings: Mapping[tuple[str, str], float] = NULL_CEILINGS) -> DataFrame:
    """Q6: all checked columns of a table in one scan."""
    cols = [(c, limit) for (t, c), limit in ceilings.items() if t == table and c in df.columns]
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c, _ in cols])
    rows = [F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), (F.col(c) / F.col("_n")).alias("null_rate"),
                     F.lit(float(limit)).alias("ceiling")) for c, limit in cols]
    out = one.filter("_n > 0").select(F.inline(F.array(*rows)))
    return out.withColumn("ok", F.col("null_rate") <= F.col("ceiling")).withColumn(
        "level", F.when(F.col("ok"), "OK").otherwise("WARN")).withColumn("null_rate", F.round("null_rate", 4))


def stability(counts: DataFrame, previous: DataFrame) -> DataFrame:
    """Q7: row counts against the previous report."""
    was = previous.select("key", F.col("rows").alias("was")).filter("was > 0")
    drop = (F.col("was") - F.col("rows")) / F.col("was")
    return counts.join(was, "key").select(*check(F.concat("key", F.lit(": row-count stability")), drop <= DROP_LIMIT,
                                                 F.round(drop, 3), "WARN"))


def kpi_swings(values: DataFrame, previous: DataFrame) -> DataFrame:
    """Q7: (metric, value) against the previous report's."""
    was = previous.select("metric", F.col("value").cast("double").alias("was")).filter("was <> 0")
    now = values.select("metric", F.col("value").cast("double").alias("value"))
    swing = F.abs(F.col("value") - F.col("was")) / F.greatest(F.abs("was"), F.lit(1.0))
    return now.join(was, "metric").select(*check(F.concat(F.lit("kpi "), "metric", F.lit(": swing")), swing <= SWING_LIMIT,
                                                 F.round(swing, 3), "WARN"))


def overall_status(checks: DataFrame) -> DataFrame:
    """Q8: FAIL over WARN over OK, with how many of each."""
    out = checks.agg(F.count_if(F.col("level") == "FAIL").alias("fails"), F.count_if(F.col("level") == "WARN").alias("warns"),
                     F.count("*").alias("checks"))
    return out.withColumn("status", F.when(F.col("fails") > 0, "FAIL").when(F.col("warns") > 0, "WARN").otherwise("OK"))


# --- Q9: parity -----------------------------------------------------------------------------------------------

def fingerprint(df: DataFrame) -> DataFrame:
    """(aspect, column, value) of a table from one aggregation: rows, types, nulls, sums, date ranges."""
    def dated(name: str) -> bool:
        return "date" in name.lower() or name.lower().endswith("_at")

    aggs, cells = [F.count("*").alias("_n")], []

    def add(aspect: str, column: str, value: Column) -> None:
        alias = f"{aspect}|{column}"
        aggs.append(value.cast("string").alias(alias))
        cells.append((aspect, column, F.col(f"`{alias}`")))

    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        add("nulls", f.name, F.count_if(c.isNull()))
        if isinstance(f.dataType, T.NumericType):
            add("sum", f.name, F.coalesce(F.sum(c.cast("decimal(38,4)")), F.lit(0).cast("decimal(38,4)")))
        if dated(f.name):
            add("min", f.name, F.min(c))
            add("max", f.name, F.max(c))
    one = df.agg(*aggs)
    cells += [("schema", f.name, F.lit(f.dataType.simpleString())) for f in df.schema.fields]
    cells.append(("rows", "*", F.col("_n").cast("string")))
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(c).alias("column"), v.alias("value"))
                                         for a, c, v in cells])))


def parity(a: DataFrame | None, b: DataFrame | None, table: str, spark=None) -> DataFrame:
    """Q9: differing fingerprints of two copies of a table; no row means they agree."""
    shape = "table string, aspect string, column string, value_a string, value_b string"
    if a is None or b is None:
        state = (("missing" if a is None else "present"), ("missing" if b is None else "present"))
        rows = [] if a is None and b is None else [(table, "presence", "*", *state)]
        return spark.createDataFrame(rows, shape)
    left = fingerprint(a).withColumnRenamed("value", "value_a")
    right = fingerprint(b).withColumnRenamed("value", "value_b")
    both = left.join(right, ["aspect", "column"], "full_outer")
    return both.filter(~F.col("value_a").eqNullSafe(F.col("value_b"))).select(
        F.lit(table).alias("table"), "aspect", "column", "value_a", "value_b")


# --- Q10: freshness ------------------------------------------------------------------------------------------------

def source_freshness(sources: DataFrame, as_of: AsOf) -> DataFrame:
    """Q10: (source, as_of_date) -> age and status; accounts may lag longer."""
    limit = F.lit(STALE_DEFAULT)
    for name, days in STALE_DAYS.items():
        limit = F.when(F.col("source") == name, days).otherwise(limit)
    age = F.datediff(day(as_of), F.col("as_of_date").cast("date"))
    return sources.select("source", "as_of_date", age.alias("age_days"),
                          F.when(age <= limit, "ok").otherwise("stale").alias("status"))


def freshness_caution(tables_used: DataFrame, freshness: DataFrame) -> DataFrame:
    """Q10: per answer, the stale sources behind its tables as one caution line.

    ``tables_used`` is (answer_id, table, source).  An answer touches a handful of sources,
    so the collected list stays small.
    """
    stale = freshness.filter("status = 'stale'").select("source", F.concat(
        "source", F.lit(" ("), F.coalesce(F.col("age_days").cast("string"), F.lit("unknown")), F.lit("d old)")).alias("note"))
    return (tables_used.select("answer_id", "source").distinct().join(stale, "source")
            .groupBy("answer_id").agg(F.array_join(F.sort_array(F.collect_set("note")), ", ").alias("stale_sources"))
            .withColumn("caution", F.concat(F.lit("I can answer this, but "), "stale_sources",
                                            F.lit(", so this may be incomplete."))))


# --- Q11-Q14: issues ---------------------------------------------------------------------------------------------------

ISSUE = ["issue_id", "type", "node", "entity", "owner", "severity", "affected_count", "evidence_source"]


def issues_of(df: DataFrame, *detectors: dict) -> DataFrame:
    """One row for each detector that any record of ``df`` meets; all detectors of a table share one scan.

    A detector has issue_id, type, node, entity, owner, source, condition, severity (a word or an aggregate column) and
    maybe count (an aggregate column instead of the number of records).
    """
    aggs, rows = [], []
    for i, d in enumerate(detectors):
        n = d.get("count")
        aggs += [(F.count_if(d["condition"]) if n is None else n).cast("bigint").alias(f"n{i}"),
                 (F.max(F.lit(d["severity"])) if isinstance(d["severity"], str) else d["severity"]).alias(f"s{i}")]
        words = [F.lit(d[k]).alias(k) for k in ("issue_id", "type", "node", "entity", "owner")]
        rows.append(F.struct(*words, F.col(f"s{i}").alias("severity"), F.col(f"n{i}").alias("affected_count"),
                             F.lit(d["source"]).alias("evidence_source")))
    return df.agg(*aggs).select(F.inline(F.array(*rows))).filter("affected_count > 0")


def week_due() -> Column:
    return F.col("is_expiring_soon") & (F.col("days_to_expiry") <= 7)


def detect_issues(certs: DataFrame, audit: DataFrame, roster: DataFrame, freshness: DataFrame, checks: DataFrame,
                  register: DataFrame, runs: DataFrame) -> DataFrame:
    """Q11: all detectors as one union of equally shaped frames."""
    stale = F.col("status") == "stale"
    unpaid = (F.col("invoice_type") == "ACCREC") & (F.col("status") == "AUTHORISED") & (F.col("amount_due") > 0)
    failed = F.col("conclusion").isNotNull() & (F.col("conclusion") != "success")
    people = dict(type="expired_certificate", node="opms", entity="certificates", owner="HR / Compliance", source="gold:training_compliance")
    from_lake, from_accounts = stale & (F.col("source") == "lake"), stale & (F.col("source") == "accounts")
    found = [
        issues_of(certs, dict(people, condition=F.col("is_expired"), issue_id="iss-cert-expired", severity="high"),
                  dict(people, condition=week_due(), issue_id="iss-cert-7d", severity="medium")),
        issues_of(audit, dict(condition=F.col("status") != "ok", issue_id="iss-links", type="broken_folder_link", node="bms", entity="jms_jobs",
                              owner="File Agent", severity="medium", source="link_audit")),
        issues_of(roster, dict(condition=F.col("roster_date").isNull(), issue_id="iss-roster", type="missing_field", node="opms",
                               entity="roster", owner="Operations", severity="medium", source="gold:roster_summary")),
        issues_of(freshness,
                  dict(condition=from_lake, issue_id="iss-snapshot-stale", type="data_freshness", node="lake", entity="data_quality",
                       owner="Operations", severity="high", source="freshness", count=F.max(F.when(from_lake, F.col("age_days")))),
                  dict(condition=from_accounts, issue_id="iss-accounts-stale", type="failed_sync", node="accounts", entity="invoice_register",
                       owner="Finance", severity="high", source="freshness", count=F.max(F.when(from_accounts, F.col("age_days"))))),
        issues_of(checks, dict(condition=~F.col("ok"), issue_id="iss-dq-fail", type="data_freshness", node="lake", entity="data_quality",
                               owner="Operations", source="checks",
                               severity=F.when(F.bool_or(F.col("level") == "FAIL"), "critical").otherwise("medium"))),
        issues_of(register, dict(condition=unpaid, issue_id="iss-ar", type="finance_mismatch", node="accounts", entity="ar_aging",
                                 owner="Finance", severity="medium", source="gold:invoice_register")),
        issues_of(runs, dict(condition=failed, issue_id="iss-automation", type="failed_sync", node="functions", entity="daily_jobs",
                             owner="Operations", severity="high", source="job_runs")),
    ]
    return reduce(DataFrame.unionByName, found)


def severity_rank(c: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(c) if isinstance(c, str) else c)


def issue_rollup(issues: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """Q12: count and worst severity per node or entity; known ones without issues are healthy."""
    per = issues.groupBy(by).agg(F.count("*").alias("issues"), F.max_by("severity", severity_rank("severity")).alias("severity"))
    return known.select(by).distinct().join(per, by, "left").select(
        by, F.coalesce("issues", F.lit(0)).cast("bigint").alias("issues"),
        F.coalesce("severity", F.lit("healthy")).alias("severity"))


def issue_evidence(certs: DataFrame, top: int | None = None) -> DataFrame:
    """Q13: the records behind each certificate issue, worst first; only the ``top`` worst of each if asked for."""
    tag = F.when(F.col("is_expired"), "iss-cert-expired").when(week_due(), "iss-cert-7d")
    w = Window.partitionBy("issue_id").orderBy("days_to_expiry", "training_record_id")
    rows = certs.withColumn("issue_id", tag).filter("issue_id IS NOT NULL")
    if top is not None:
        rows = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= int(top))
    return (rows.orderBy("issue_id", "days_to_expiry", "training_record_id")
            .select("issue_id", "opms_employee_id", F.concat_ws(" ", "first_name", "last_name").alias("name"),
                    "competency_name", "expiry_date", F.abs("days_to_expiry").alias("days")))


def revalidate(issues: DataFrame, live: DataFrame) -> DataFrame:
    """Q14: reported count against a recount, (issue_id, live) rows."""
    return issues.select("issue_id", F.col("affected_count").alias("reported")).join(live, "issue_id", "left").withColumn(
        "matches", F.coalesce(F.col("reported") == F.col("live"), F.lit(False)))


# --- Q15: grain ------------------------------------------------------------------------------------------------------------

def grain_violations(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Q15: key values that occur more than once."""
    return df.groupBy(*grain).agg(F.count("*").alias("copies")).filter("copies > 1")
