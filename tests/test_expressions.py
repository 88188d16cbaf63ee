from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crewlake.functions import costs, phrases
from crewlake.functions import scalars as E


@pytest.mark.parametrize("text,want", [
    ("2026-07-28T16:30:00Z", datetime(2026, 7, 29, 0, 30)), ("14/04/2026", datetime(2026, 4, 14)), ("4/9/2026", datetime(2026, 9, 4)),
    ("2026-04-14", datetime(2026, 4, 14)), ("2026-04-14T10:00:00", datetime(2026, 4, 14, 10)), ("", None), ("nan", None), ("junk", None), (None, None)])
def test_local_ts(one, text, want):
    assert one(v=E.local_ts(F.lit(text).cast("string"))).v == want


@pytest.mark.parametrize("raw,norm,key,whole", [
    ("6", "6", "6", 6), ("6.0", "6", "6", None), (" 6 ", "6", "6", 6), ("A12", "A12", None, None), ("", None, None, None), (None, None, None, None), ("nan", None, None, None)])
def test_ids(one, raw, norm, key, whole):
    c = F.lit(raw).cast("string")
    r = one(n=E.norm_id(c), k=E.lookup_key(c), i=E.to_int(c))
    assert (r.n, r.k, r.i) == (norm, key, whole)


def test_expiry_flags_at_the_edges(spark):
    df = spark.createDataFrame([("2026-05-31",), ("2026-06-01",), ("2026-08-30",), ("2026-08-31",), (None,)], "d string")
    f = E.expiry_flags("d", "2026-06-01")
    rows = df.select(f["is_expired"].alias("e"), f["is_expiring_soon"].alias("s")).collect()
    assert [tuple(r) for r in rows] == [(True, False), (False, True), (False, True), (False, False), (False, False)]


def test_codes(one):
    r = one(a=E.job_prefix(F.lit("sh-25006 - July")), b=E.invoice_job_code(F.lit("INV-1234")), c=E.normalise_job_id(F.lit("26046")),
            d=E.normalise_job_id(F.lit(" sh-26046 ")), e=E.shift_type(F.lit("night shift")), f=E.shift_type(F.lit(None).cast("string")),
            g=E.truthy(F.lit("Yes")), h=E.truthy(F.lit(None).cast("string")), i=E.norm_name(F.lit("T & H-Group 工")))
    assert tuple(r) == ("SH-25006", None, "SH-26046", "SH-26046", "NS", "DS", True, False, "tandhgroup工")


def test_link_cell(one):
    p = E.link_cell(F.lit("IMS/Ops:5788<#>https://x/a<->open"))
    assert tuple(one(**p)) == ("IMS/Ops:5788", 5788, "https://x/a")
    assert tuple(one(**E.link_cell(F.lit("nan")))) == (None, None, None)


def test_cost(one):
    prices = {"chat": {"in": 0.27, "out": 1.10, "cache_read": 0.07}}
    m = F.lit(1_000_000)
    none = F.lit(None).cast("int")
    r = one(a=costs.estimate_cost(F.lit("a/chat-1 -> c/d (fallback)"), m, m, m, prices), b=costs.estimate_cost(F.lit("x/other"), m, m, m, prices),
            c=costs.estimate_cost(F.lit("a/chat"), none, none, none, prices), d=costs.avoided_cost(F.lit("x" * 4000)),
            e=costs.estimate_cost(F.lit("p/chat-2 (fallback)"), m, m, m, prices))
    assert r.b is None and r.c is None and r.e == 1.44 and r.d == 0.003


def test_phrases(one):
    r = one(r=phrases.relative_range(F.lit("上个礼拜 hours"), "2026-07-29"), m=phrases.relative_range(F.lit("in April 2026"), "2026-07-29"),
            l=phrases.range_label(F.lit("2026-07-20"), F.lit("2026-07-26"), F.lit(None).cast("string"), "2026-07-29"),
            t=phrases.schedule_intent(F.lit("timesheet or roster")))
    assert (r.r.date_from, r.r.date_to, r.m.period, r.l, r.t) == ("2026-07-20", "2026-07-26", "2026-04", "last_week", "timesheet")


def test_ids_of_number_columns_and_long_ids(spark):
    df = spark.createDataFrame([(6.0, "9007199254740993", "9007199254740993.0"), (6.5, "x", None)], "d double, t string, p string")
    rows = df.select(E.to_int("d").alias("i"), E.norm_id("d").alias("n"), E.norm_id("t").alias("big"), E.lookup_key("p").alias("key"), E.to_int("t").alias("whole")).collect()
    assert tuple(rows[0]) == (6, "6", "9007199254740993", "9007199254740993", 9007199254740993)
    assert rows[1].i is None and rows[1].big == "x" and rows[1].key is None
