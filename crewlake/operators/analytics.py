"""Dashboard aggregates, KPIs, alerts and trends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlake.functions.ordered import with_edges
from crewlake.functions.scalars import AsOf, day, iso_date
from crewlake.operators.serve import (
    FIELD_POSITIONS,
    WORKER,
    beside,
    due_within,
    expired,
    rostered_from,
    since_days,
    supplier_compliance_risk,
    worker_facts,
    workforce_figures,
)

# --- fixed values ---------------------------------------------------------------------------
TREND_DAYS, TREND_MIN, TREND_SIGMA = 14, 7, 2
SEVERITY_ORDER = {"red": 0, "amber": 1, "info": 2}
OPEN_JOB_STOP = "(?i)COMPLETE|Cancel|Unsucces"
DRILL_PATHS = {
    "stage": ["stage", "client", "project", "job"],
    "project": ["project", "status", "job"],
    "client": ["client", "project", "status"],
    "status": ["status", "project", "job"],
}
ALERT_RULES = [
    # rule, metric, comparison, threshold, severity, message, recommended action
    ("workforce_risk_high", "workforce_risk", ">=", "50", "red",
     "Rostered since 30 days ago with an expired certificate: {value} pairs of worker and certificate.",
     "Open compliance review: re-validate certs for rostered workers first"),
    ("certs_expiring_week", "expiring_7d", ">=", "5", "amber",
     "Certificates due within 7 days: {value}.",
     "Book renewals for the 7-day list this week"),
    ("deployable_pool_thin", "deployable", "<=", "10", "amber",
     "Field workers ready to deploy: {value}.",
     "Start recruitment or free up bench workers"),
    ("supplier_risk_concentrated", "top_supplier_expired", ">=", "100", "amber",
     "Most expired certificates at one supplier: {value} ({top_supplier_name}).",
     "Raise at the next supplier review meeting"),
    ("weekly_hours_swing", "hours_wow_change_pct", "abs>=", "30", "amber",
     "Weekly hours changed by {value} %: {hours_prev} h before, {hours_last} h now.",
     "Check rosters and timesheets for the swing"),
    ("data_quality_not_ok", "sentinel_status", "!=", "OK", "red",
     "Data quality status: {value}.",
     "Check the data quality report before trusting today's numbers"),
    ("roster_horizon_short", "roster_horizon_days", "<", "60", "red",
     "Days of roster ahead: {value}.",
     "Check the roster extraction window"),
    ("gold_stale", "gold_age_hours", ">", "30", "amber",
     "Age of the published tables: {value} hours.",
     "Check the nightly refresh or run the pipeline manually"),
    ("accounts_sync_stale", "xero_age_days", ">", "14", "amber",
     "Financial data is {value} days behind.", None),
]
RULE_SCHEMA = ("rule string, metric string, op string, threshold string, severity string, message string, "
               "action string")
# ----------------------------------------------------------------------------------------------


# --- A: dashboard ---------------------------------------------------------------------------------

def drill_counts(jobs: DataFrame, path: Sequence[str]) -> DataFrame:
    """A1: job counts at every level of a drill path, ``level`` 1 being the outermost."""
    rolled = jobs.rollup(*path).agg(F.grouping_id().alias("_g"), F.count("*").alias("jobs"))
    # with n path columns level k has the lowest n-k grouping bits set
    levels = {2 ** (len(path) - k) - 1: k for k in range(len(path) + 1)}
    level = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    return rolled.withColumn("level", F.element_at(level, F.col("_g").cast("int"))).filter("level > 0").drop("_g")


def selected_workers(profile: DataFrame, roster: DataFrame, weekly: DataFrame, suppliers: Sequence[str] = (),
                     projects: Sequence[str] = ()) -> DataFrame | None:
    """A2: ids of the workers a supplier and a project selection have in common."""
    out = None
    if suppliers:
        out = profile.filter(F.col("supplier_name").isin(list(suppliers))).select(WORKER).distinct()
    if projects:
        hit = F.col("project_name").isin(list(projects))
        on_project = roster.filter(hit).select(WORKER).unionByName(weekly.filter(hit).select(WORKER)).distinct()
        out = on_project if out is None else out.join(on_project, WORKER, "left_semi")
    return out


def cross_filter(df: DataFrame, workers: DataFrame | None) -> DataFrame:
    """A2: keep the rows of the selected workers; frames without a worker are left alone."""
    if workers is None or WORKER not in df.columns:
        return df
    return df.join(workers, WORKER, "left_semi")


def _in_range(c: str, date_from: str, date_to: str) -> Column:
    return F.col(c).between(date_from, date_to)


def at_risk_by_project(roster: DataFrame, certs: DataFrame, date_from: str, date_to: str, top_n: int = 8) -> DataFrame:
    """A3."""
    lapsed = expired(certs).select(WORKER).distinct()
    rows = roster.filter(_in_range("roster_date", date_from, date_to)).join(lapsed, WORKER, "left_semi")
    return rows.groupBy("project_name").agg(F.countDistinct(WORKER).alias("at_risk_workers")).orderBy(
        F.desc("at_risk_workers"), "project_name").limit(int(top_n))


def certs_expiring_by_month(certs: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """A4."""
    return certs.filter(_in_range("expiry_date", date_from, date_to)).groupBy(
        F.substring("expiry_date", 1, 7).alias("month")).agg(F.count("*").alias("certs_expiring")).orderBy("month")


def workforce_by_supplier(profile: DataFrame, top_n: int = 8) -> DataFrame:
    """A4/K3."""
    return profile.filter("is_active AND supplier_name IS NOT NULL").groupBy("supplier_name").agg(
        F.count("*").alias("workers")).orderBy(F.desc("workers"), "supplier_name").limit(int(top_n))


def drill_through(profile: DataFrame, certs: DataFrame, roster: DataFrame, *, project: str | None = None,
                  month: str | None = None, supplier: str | None = None, date_from: str = "", date_to: str = "9") -> DataFrame:
    """A5: the rows behind a clicked project, expiry month or supplier."""
    of = profile.select(WORKER, "supplier_name")
    if project:
        lapsed = expired(certs).select(WORKER).distinct()
        hit = roster.filter(_in_range("roster_date", date_from, date_to) & (F.col("project_name") == project))
        return hit.join(lapsed, WORKER, "left_semi").join(of, WORKER, "left").select(
            "first_name", "last_name", "supplier_name", "project_name", "position_name", "roster_date",
            "hours").orderBy(F.desc("roster_date"))
    rows = certs.filter(F.col("expiry_date").startswith(month)) if month else expired(certs)
    rows = rows.join(of, WORKER, "left")
    if supplier:
        rows = rows.filter(F.col("supplier_name") == supplier)
    return rows.select("first_name", "last_name", "supplier_name", "competency_name", "status", "expiry_date",
                       "days_to_expiry").orderBy("expiry_date")


def _week_start(c: str = "work_date") -> Column:
    return F.trunc(F.col(c).cast("date"), "week")


def weekly_hours_in_range(weekly: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """A6."""
    return weekly.filter(_in_range("work_date", date_from, date_to)).groupBy(iso_date(_week_start()).alias("week")).agg(
        F.round(F.sum("actual_hours"), 2).alias("actual_hours")).orderBy("week")


def project_pipeline(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Projects with jobs, jobs in progress, jobs still open."""
    status = F.coalesce("job_status", F.lit(""))
    return jobs.agg(
        F.countDistinct("project_name").alias("projects_with_jobs"), F.count("*").alias("jobs"),
        F.count_if(F.lower(status).contains("progress")).alias("in_progress"),
        F.count_if(~status.rlike(OPEN_JOB_STOP)).alias("open_jobs"))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls and, for numbers, a summary.  One pass, no sampling."""
    numeric = (T.NumericType,)
    parts = [F.count("*").alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        stats = [F.count_if(c.isNull()).alias("nulls")]
        if isinstance(f.dataType, numeric):
            d = c.cast("double")
            stats += [F.min(d).alias("min"), F.max(d).alias("max"), F.round(F.avg(d), 2).alias("mean"),
                      F.round(F.stddev_samp(d), 2).alias("std")]
        parts += [s.alias(f"{i}:{n}") for s, n in zip(stats, ["nulls", "min", "max", "mean", "std"])]
    one = df.agg(*parts)
    rows = []
    for i, f in enumerate(df.schema.fields):
        num = isinstance(f.dataType, numeric)
        pick = {n: (F.col(f"`{i}:{n}`") if num else F.lit(None).cast("double")) for n in ["min", "max", "mean", "std"]}
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                             F.col("_rows").alias("rows"), F.col(f"`{i}:nulls`").alias("nulls"),
                             *[v.alias(k) for k, v in pick.items()]))
    return one.select(F.inline(F.array(*rows)))


# --- K: KPIs ----------------------------------------------------------------------------------------------

def kpis(profile: DataFrame, certs: DataFrame, roster: DataFrame, projects: DataFrame, as_of: AsOf,
         positions: Sequence[str] = tuple(FIELD_POSITIONS)) -> DataFrame:
    """K1: the six headline numbers as one row.

    Certificates, roster and people are read once each and reduced to one row per worker.
    """
    figures = workforce_figures(worker_facts(profile, certs, roster, positions), as_of).select(
        F.col("expired_kinds").alias("workforce_risk"), F.col("due_30d").alias("expiring_30d"), F.col("expired").alias("expired_total"),
        F.col("idle").alias("idle_pool"), "deployable")
    active = projects.agg(F.count_if(F.col("is_active") == True).alias("active_projects"))  # noqa: E712
    return beside(figures, active)


def business_exposure(certs: DataFrame, roster: DataFrame, as_of: AsOf) -> DataFrame:
    """K2: people and jobs exposed, not record counts."""
    lapsed = expired(certs).select(WORKER).filter(F.col(WORKER).isNotNull()).distinct()
    ahead = rostered_from(roster, str(as_of)).join(lapsed, WORKER, "left_semi")
    holders = certs.filter("is_expired AND is_active").agg(F.countDistinct(WORKER).alias("workers_at_risk"))
    exposed = ahead.agg(F.countDistinct(WORKER).alias("at_risk_rostered"),
                        F.countDistinct("project_name").alias("jobs_exposed"))
    return beside(holders, exposed)


def supplier_risk(profile: DataFrame, certs: DataFrame, top_n: int = 8) -> DataFrame:
    """K3."""
    return supplier_compliance_risk(profile, certs).limit(int(top_n))


def risk_by_project(roster: DataFrame, certs: DataFrame, as_of: AsOf, top_n: int = 8, days: int = 90) -> DataFrame:
    """K3."""
    named = roster.filter("project_name IS NOT NULL")
    return at_risk_by_project(named, certs, since_days(as_of, days), "9999-12-31", top_n)


def expiry_ladder(certs: DataFrame, steps: Sequence[int] = (7, 30, 90)) -> DataFrame:
    """K4: cumulative steps in one scan."""
    return certs.filter(~F.col("is_expired")).agg(
        *[F.count_if(F.col("days_to_expiry").between(0, d)).alias(f"expiring_{d}d") for d in steps])


def urgent_expiries(certs: DataFrame, days: int = 7, top_n: int = 12) -> DataFrame:
    """K4."""
    return due_within(certs, days).select("first_name", "last_name", "competency_name", "expiry_date",
                                          "days_to_expiry").orderBy(
        "days_to_expiry", "last_name", "first_name", "competency_name").limit(int(top_n))


def weekly_hours(weekly: DataFrame, as_of: AsOf, weeks: int = 10) -> DataFrame:
    """K5: hours and people per week, weeks start on Monday."""
    return weekly.filter(F.col("work_date") >= since_days(as_of, weeks * 7)).groupBy(
        iso_date(_week_start()).alias("week_start")).agg(
        F.round(F.sum("actual_hours"), 2).alias("actual_hours"), F.countDistinct(WORKER).alias("workers")).orderBy("week_start")


def week_on_week(weekly: DataFrame, as_of: AsOf, weeks: int = 4) -> DataFrame:
    """K6: the last two complete weeks; no earlier week or zero hours there gives a change of 0."""
    this_monday = iso_date(F.trunc(day(as_of), "week"))
    full = weekly_hours(weekly, as_of, weeks).filter(F.col("week_start") < this_monday)
    two = full.orderBy(F.desc("week_start")).limit(2)
    last = F.coalesce(F.max_by("actual_hours", "week_start"), F.lit(0.0))
    prev = F.when(F.count("*") > 1, F.min_by("actual_hours", "week_start")).otherwise(0.0)
    out = two.agg(last.alias("hours_last"), prev.alias("hours_prev"))
    return out.withColumn("hours_wow_change_pct", F.when(
        F.col("hours_prev") != 0, F.round(100.0 * (F.col("hours_last") - F.col("hours_prev")) / F.col("hours_prev"), 2))
        .otherwise(0.0))


def rules_table(spark: SparkSession, rules=ALERT_RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def long_metrics(one_row: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row metrics frame; values as text."""
    return one_row.select(*[F.col(c).cast("string").alias(c) for c in one_row.columns]).unpivot(
        [], list(one_row.columns), "metric", "value")


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """K7: rules that fire on (metric, value) rows, worst first, with message and recommended action.

    Numbers compare as numbers, texts as texts; a missing metric never fires.
    """
    known = metrics.filter("value IS NOT NULL")
    hit = known.join(rules, "metric")
    # what a message mentions besides its own value, looked up among the metrics; one small map per rule
    named = rules.select("rule", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"\{(\w+)\}"), 1))).alias("_name"))
    filled = named.join(known.select(F.col("metric").alias("_name"), F.col("value").alias("_value")), "_name").groupBy("rule").agg(
        F.collect_list(F.struct(F.concat(F.lit("{"), "_name", F.lit("}")).alias("mark"), F.col("_value").alias("text"))).alias("_filled"))
    hit = hit.join(filled, "rule", "left")
    v, t = F.col("value").try_cast("double"), F.col("threshold").try_cast("double")
    numeric = v.isNotNull() & t.isNotNull()
    same = F.when(numeric, v == t).otherwise(F.col("value") == F.col("threshold"))
    tests = {"<": v < t, "<=": v <= t, ">": v > t, ">=": v >= t, "abs>=": F.abs(v) >= t, "==": same, "!=": ~same}
    fired = None
    for op, test in tests.items():
        cond = F.col("op") == op
        fired = F.when(cond, test) if fired is None else fired.when(cond, test)
    order = F.create_map(*[F.lit(x) for pair in SEVERITY_ORDER.items() for x in pair])
    return (hit.filter(F.coalesce(fired, F.lit(False)))
            .withColumn("severity_rank", F.coalesce(F.try_element_at(order, F.col("severity")), F.lit(3)))
            .select("rule", "severity", "severity_rank", "metric", "value",
                    F.aggregate(F.coalesce("_filled", F.array().cast("array<struct<mark:string,text:string>>")),
                                F.replace("message", F.lit("{value}"), F.col("value")), lambda m, x: F.replace(m, x["mark"], x["text"])).alias("message"), "action")
            .orderBy("severity_rank", "rule"))


def trend_deltas(snapshots: DataFrame) -> DataFrame:
    """K8: change against the previous snapshot and whether it is unusual.

    ``snapshots`` is (date, metric, value).  Unusual means more than two population standard
    deviations away from the mean of the up to 14 snapshots before, of which at least 7 are
    needed.  The window runs per metric over one row per day.
    """
    return _trend(snapshots, Window.partitionBy("metric").orderBy("date")).filter("prev IS NOT NULL AND value IS NOT NULL").select(
        "date", "metric", "value", "prev", "delta", "anomaly")


def series_deltas(series: DataFrame, metric: str, order: Sequence[str], size: int = 100_000) -> DataFrame:
    """K8 for long series: the rows of ``series`` (``metric``, ``order``, value) with prev, delta and anomaly.

    A metric's rows are cut into parts of ``size`` rows, each led by the rows that its window looks back at, so one metric with
    most rows is the work of many tasks.  ``order`` must tell a metric's rows apart.  Rows without a value or one before are left out.
    """
    cut = with_edges(series, [metric], order, TREND_DAYS, size, "_part", "_edge")
    out = _trend(cut, Window.partitionBy(metric, "_part").orderBy(*order)).filter("NOT _edge AND prev IS NOT NULL AND value IS NOT NULL")
    return out.select(*series.columns, "prev", "delta", "anomaly")


def _trend(rows: DataFrame, w) -> DataFrame:
    """``rows`` with the value before, the difference to it and whether that is unusual, along the window's order."""
    back = w.rowsBetween(-TREND_DAYS, -1)
    out = (rows.withColumn("prev", F.lag("value").over(w))
           .withColumn("n", F.count("value").over(back)).withColumn("mean", F.avg("value").over(back))
           .withColumn("sd", F.stddev_pop("value").over(back)))
    odd = (F.col("n") >= TREND_MIN) & (F.col("sd") > 0) & (F.abs(F.col("value") - F.col("mean")) > TREND_SIGMA * F.col("sd"))
    return out.withColumn("delta", F.col("value") - F.col("prev")).withColumn("anomaly", F.coalesce(odd, F.lit(False)))


def snapshot_upsert(history: DataFrame, today: DataFrame, key: str = "date") -> DataFrame:
    """K9: one row per day; a rerun of a day replaces it."""
    return history.join(today.select(key).distinct(), key, "left_anti").unionByName(today, allowMissingColumns=True)


def recommendations(one_row: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """Today's problems stated directly: one line per metric above zero that has a template."""
    rows = long_metrics(one_row).filter(F.col("value").try_cast("double") > 0)
    text = reduce(lambda acc, kv: acc.when(F.col("metric") == kv[0], F.lit(kv[1])), templates.items(), F.when(F.lit(False), F.lit("")))
    return rows.withColumn("text", F.replace(text, F.lit("{value}"), F.col("value"))).filter("text IS NOT NULL")
