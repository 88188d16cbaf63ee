import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crewlake.operators import reconcile as R
from crewlake.operators import silver as D

SHEET = ("id string, site_id string, date string, last_modified_date string, "
         "entries array<struct<employee: struct<id: bigint>, value: double>>")
ROSTER = ("employee struct<id: bigint, first_name: string, last_name: string>, rostered_days array<struct<date: string, position: struct<name: string>, "
          "work_type: struct<name: string>, resource_request_allocations: array<struct<resource_request: struct<project: string>>>>>")
LIST = ("OPMS string, Date_x0020_From string, Hours double, First_x0020_Name string, Last_x0020_Name string, Position string, Project string, WorkType string, "
        "SiteLookupId string, SupplierLookupId bigint, _pos bigint")


def sheet(i, day, site, modified, entries):
    return (i, site, day, modified, [((w,), float(h)) for w, h in entries])


def hours_of(spark, sheets):
    rows = R.entered_hours(D.fact_timesheet(spark.createDataFrame(sheets, SHEET))).collect()
    return {(r.opms, str(r.work_date)): r.hours for r in rows}


def test_winning_sheet_per_site(spark):
    got = hours_of(spark, [sheet("s1", "2026-07-28", "10", "2026-07-28T10:00:00", [(896, 8)]), sheet("s2", "2026-07-28", "10", "2026-07-28T12:00:00", [(896, 6)]),
                           sheet("s3", "2026-07-28", "20", "2026-07-28T11:00:00", [(896, 2)])])
    assert got == {("896", "2026-07-28"): 8.0}


def test_live_hours_filters_worker_and_range(spark):
    e = D.fact_timesheet(spark.createDataFrame([sheet("s1", "2026-07-28", "10", "m1", [(896, 5), (291, 9)]), sheet("s2", "2026-07-20", "10", "m1", [(896, 7)])], SHEET))
    assert [tuple(r) for r in R.live_worker_hours(e, "2026-07-27", "2026-08-02", 896).collect()] == [("896", "2026-07-28", 5.0)]


def weekly(spark, lines, mode="default"):
    sheets = [sheet("S1", "2026-07-28", "10", "2026-07-28T10:00:00Z", [(896, 8.0)]), sheet("S2", "2026-07-30", "10", "2026-07-30T10:00:00Z", [(896, 8.5), (999, 12.0)])]
    roster = spark.createDataFrame([
        ((896, "JANE", "DOE"), [("2026-07-30", ("Analyst",), ("NIGHT SHIFT",), [(("SH-26046 - Major",),)])]),
        ((999, "CRANE", "UNIT"), [("2026-07-30", ("Z. CRANE 100T",), ("DAY SHIFT",), [])])], ROSTER)
    people = spark.createDataFrame([("896", 7, 1)], "OPMS string, SupplierLookupId bigint, _pos bigint")
    employees = spark.createDataFrame([(896, "JANE", "DOE", 1)], "id bigint, first_name string, last_name string, _pos bigint")
    titles = spark.createDataFrame([(7, "FullT")], "id bigint, Title string")
    forms = spark.createDataFrame([], "OPMS string, Status string, Date string")
    client = lambda df: df.withColumn("client_name", F.when(F.col("project_name").isNotNull(), "C0060"))
    hours = R.entered_hours(D.fact_timesheet(spark.createDataFrame(sheets, SHEET)))
    return R.weekly_timesheet(spark.createDataFrame(lines, LIST), hours, R.gap_hours(forms), R.roster_context(roster), people, employees,
                              titles.limit(0), titles, client, mode)


LINE = ("896.0", "2026-07-28", 10.0, "JANE", "DOE", "Analyst", "SH-26046 - Major", "DAY SHIFT", None, 7, 1)


def test_backfill_of_days_without_roster_line(spark):
    rows = {r.work_date: r for r in weekly(spark, [LINE]).collect()}
    assert set(rows) == {"2026-07-28", "2026-07-30"}           # the plant line of worker 999 is left out
    back, day = rows["2026-07-30"], rows["2026-07-28"]
    assert (back.hours_source, back.actual_hours, back.shift_type, back.supplier_name, back.client_name, back.last_name) == (
        "opms_no_bms_roster", 8.5, "NS", "FullT", "C0060", "DOE")
    assert (day.hours_source, day.actual_hours) == ("opms", 8.0)


def test_duplicate_roster_lines(spark):
    twice = [LINE, LINE[:-1] + (2,)]
    day = lambda m: sorted(r.actual_hours for r in weekly(spark, twice, m).collect() if r.work_date == "2026-07-28")
    assert day("default") == [0.0, 8.0] and day("reference") == [8.0, 8.0]


def gaps(spark, events):
    df = spark.createDataFrame([("7.0", s, t) for s, t in events], "OPMS string, Status string, Date string")
    return {str(r.work_date): r.gap_hours for r in R.gap_hours(df).collect()}


@pytest.mark.parametrize("events,want", [
    ([("Sign Out", "2026-01-01T10:00:00"), ("Sign Out", "2026-01-01T11:00:00"), ("Sign In", "2026-01-01T12:00:00")], {"2026-01-01": 1.0}),
    ([("Sign In", "2026-01-01T10:00:00")], {}),
    ([("Sign Out", "2026-01-01T22:00:00"), ("Sign In", "2026-01-02T02:00:00")], {"2026-01-01": 2.0, "2026-01-02": 2.0}),
    ([("Sign Out", "2026-01-01T20:00:00"), ("Sign In", "2026-01-02T03:00:00")], {}),
    ([("Sign Out", "2026-01-01T08:00:00"), ("Sign In", "2026-01-01T18:00:00")], {"2026-01-01": 10.0}),
    ([("Sign Out", "2026-01-01T08:00:00"), ("Sign In", "2026-01-01T08:00:00")], {})])
def test_gap_rules(spark, events, want):
    assert gaps(spark, events) == want


def test_gaps_equal_a_loop_over_each_worker(spark):
    rnd = random.Random(5)
    start = datetime(2026, 1, 1)
    events = sorted({start + timedelta(minutes=rnd.randint(0, 60 * 24 * 20)): None for _ in range(600)})
    rows = [(str(rnd.randint(1, 3)), rnd.choice(["Sign Out", "Sign In", "Other"]), t.isoformat()) for t in events]
    want, open_out = {}, {}
    for w, s, t in rows:                                         # straightforward state per worker
        t = datetime.fromisoformat(t)
        if s == "Sign Out":
            open_out[w] = t
        elif s == "Sign In" and w in open_out:
            o = open_out.pop(w)
            h = (t - o).total_seconds() / 3600
            if h > 0 and (o.date() == t.date() or h <= 6):
                while o < t:
                    end = min(t, datetime.combine(o.date() + timedelta(1), datetime.min.time()))
                    want[w, str(o.date())] = want.get((w, str(o.date())), 0) + (end - o).total_seconds() / 3600
                    o = end
    df = spark.createDataFrame(rows, "OPMS string, Status string, Date string").repartition(7)
    got = {(r.opms, str(r.work_date)): r.gap_hours for r in R.gap_hours(df).collect()}
    assert got == {k: pytest.approx(v, abs=0.006) for k, v in want.items()}
