"""A sample of registered queries against the other engine, and the shape of their plans."""

import re

import duckdb
import pytest

from check_queries import NAMES, rows_of
from crewlake.plans.registry import load_all

SF = "/root/testdata/sf0.001"
SAMPLE = ["timesheet_summary", "winning_sheet", "gap_pairs", "weekly_timesheet", "roster_summary", "training_compliance", "quote_hours", "link_repair_plan",
          "find_deployable_workers", "worker_360", "kpis", "trend_deltas", "parity", "detect_issues", "scrub_secrets", "stream_ingest", "near_names", "chunks",
          "followups", "failure_streaks"]
PLANNED = ["weekly_timesheet", "kpis", "detect_issues", "resolve_mentions", "detect_mentions", "check_roster_risk", "project_hours_status", "workforce_report",
           "parity", "link_repair_plan", "followups", "vector_search", "revalidate", "zero_row_diagnosis"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, con, name):
    q = load_all()[name]
    df = q(spark, SF)
    res = con.execute(q.oracle)
    cols = [d[0] for d in res.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


@pytest.mark.parametrize("name", PLANNED)
def test_plans_stay_relational(spark, name):
    plan = load_all()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|EvalPython|MapInPandas", plan)


def test_every_query_names_its_statement():
    assert all(q.oracle for q in load_all().values())


def test_scan_reads_only_needed_columns(spark):
    plan = load_all()["expiry_ladder"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert not any("l_tax" in s or "l_comment" in s or "o_totalprice" in s and "o_orderpriority" not in s for s in schemas)
