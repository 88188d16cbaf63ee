"""Project hours per job and document links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.functions.scalars import AsOf, iso_date, day, job_prefix, link_cell

DRIFT_LIMIT_PCT = 10  # fixed value


def project_hours_status(jobs: DataFrame, roster: DataFrame, weekly: DataFrame, as_of: AsOf) -> DataFrame:
    """Scheduled, observed and actual hours of every job, kept apart, with stated gaps.

    Project texts start with the job code, so the code is extracted once per row and all
    jobs are answered by two aggregations and two equi-joins.
    """
    future = F.col("roster_date") >= iso_date(day(as_of))
    sched = roster.withColumn("ref", job_prefix("project_name")).filter("ref IS NOT NULL").groupBy("ref").agg(
        F.count("*").alias("roster_entries"), F.count_if(future).alias("future_entries"),
        F.round(F.coalesce(F.sum("hours"), F.lit(0.0)), 1).alias("scheduled_hours"),
        F.round(F.coalesce(F.sum(F.when(future, F.col("hours"))), F.lit(0.0)), 1).alias("future_hours"),
        F.max("roster_date").alias("roster_max_date"))
    done = weekly.withColumn("ref", job_prefix("project_name")).filter("ref IS NOT NULL").groupBy("ref").agg(
        F.round(F.sum("actual_hours"), 1).alias("actual_hours"),
        F.round(F.sum("roster_hours"), 1).alias("observed_hours"),
        F.round(F.sum(F.when(F.col("shift_type") == "DS", F.col("actual_hours")).otherwise(0.0)), 1).alias("actual_ds"),
        F.round(F.sum(F.when(F.col("shift_type") == "NS", F.col("actual_hours")).otherwise(0.0)), 1).alias("actual_ns"),
        F.max("work_date").alias("timesheet_max_date"))
    out = (jobs.withColumn("ref", F.upper(F.trim("job_code"))).join(sched, "ref", "left").join(done, "ref", "left")
           .na.fill(0, ["roster_entries", "future_entries"])
           .na.fill(0.0, ["scheduled_hours", "future_hours", "actual_hours", "observed_hours", "actual_ds", "actual_ns"]))
    to_date = F.when(F.col("scheduled_hours") != 0, F.col("scheduled_hours") - F.col("future_hours")).otherwise(
        F.col("observed_hours"))
    drift = F.when((to_date > 0) & (F.col("actual_hours") > 0),
                   F.round(F.abs(F.col("actual_hours") - to_date) / to_date * 100, 1))
    return out.select(
        "job_code", "job_title", "job_status", "project_name", "client_name", "roster_entries", "future_entries",
        "scheduled_hours", "future_hours", "observed_hours", "actual_hours", "actual_ds", "actual_ns",
        drift.alias("drift_pct"), F.coalesce(drift > DRIFT_LIMIT_PCT, F.lit(False)).alias("drift_warning"),
        ((F.col("roster_entries") > 0) & (F.col("scheduled_hours") == 0)).alias("scheduled_hours_missing"),
        F.when(F.col("future_hours") > 0, "medium").otherwise("high").alias("confidence"),
        "roster_max_date", "timesheet_max_date")


# --- links ------------------------------------------------------------------------------------------

def link_cells(rows: DataFrame, id_col: str, title_col: str, columns: Sequence[str]) -> DataFrame:
    """One row per link cell with its parts."""
    present = [c for c in columns if c in rows.columns]
    long = rows.select(F.col(id_col).alias("jobid"), F.col(title_col).alias("title"),
                       *present).unpivot(["jobid", "title"], present, "column", "cell")
    parts = link_cell("cell")
    return long.select("jobid", "title", "column", "cell",
                       F.regexp_replace(parts["head"], r":\s*\d+\s*$", "").alias("library"),
                       parts["item_id"].alias("item_id"), parts["url"].alias("url"))


def link_audit(cells: DataFrame, index: DataFrame) -> DataFrame:
    """Every cell is ok (the file exists), broken (it does not) or missing (no URL)."""
    known = index.select(F.col("web_url").alias("_known")).distinct()
    status = (F.when(F.col("url").isNull(), "missing").when(F.col("_known").isNotNull(), "ok").otherwise("broken"))
    return cells.join(known, F.col("url") == F.col("_known"), "left").withColumn("status", status).drop("_known")


def link_totals(audit: DataFrame) -> DataFrame:
    """Counts per column, plus one line for all columns."""
    counts = [F.count("*").alias("checked")] + [F.count_if(F.col("status") == s).alias(s)
                                                for s in ("ok", "broken", "missing")]
    return audit.rollup("column").agg(*counts).withColumn("column", F.coalesce("column", F.lit("(all)")))


def link_problems(audit: DataFrame) -> DataFrame:
    """Rows with at least one cell that is not ok, with how many of each kind."""
    return audit.filter("status <> 'ok'").groupBy("jobid", "title").agg(
        F.count_if(F.col("status") == "broken").alias("broken"), F.count_if(F.col("status") == "missing").alias("missing"))


def link_repair_plan(audit: DataFrame, locations: DataFrame) -> DataFrame:
    """Proposed cell values for broken links whose item still exists under another URL.

    ``locations`` maps (library, item_id) to the item's current URL.  Nothing is written.
    """
    broken = audit.filter("status = 'broken' AND item_id IS NOT NULL")
    now = locations.select("library", "item_id", F.col("web_url").alias("current_url"))
    plan = broken.join(now, ["library", "item_id"]).filter(F.col("current_url") != F.col("url"))
    return plan.select("jobid", "column", F.col("cell").alias("old_value"),
                       F.replace("cell", F.col("url"), F.col("current_url")).alias("new_value"))
