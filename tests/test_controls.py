import pytest
from pyspark.sql import functions as F

from crewlake.operators import analytics as A
from crewlake.operators import govern as V
from crewlake.operators import quality as Q


def keyed(spark, **rows):
    return spark.createDataFrame([("gold:" + k, v) for k, v in rows.items()], "key string, rows bigint")


def test_guard(spark):
    base = keyed(spark, a=100, b=100, c=5, invoice_register=9)
    now = keyed(spark, a=70, b=69, c=0, invoice_register=0)
    report = Q.guard_report(now, base, ["a", "gone"])
    got = {(r.level, r.key) for r in report.collect()}
    assert ("FAIL", "gold:gone") in got and ("WARN", "gold:b") in got and ("WARN", "gold:a") not in got
    assert ("WARN", "gold:c") in got and not any(k == "gold:invoice_register" for _, k in got)
    assert Q.next_baseline(now, base, report).filter("key = 'gold:a'").first().rows == 100      # a failed gate keeps the old baseline


def test_parity(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, v double")
    assert Q.parity(a, a.select("*"), "t").count() == 0
    b = spark.createDataFrame([(1, 1.0), (2, 2.0001)], "id int, v double")
    assert [(r.aspect, r.column) for r in Q.parity(a, b, "t").collect()] == [("sum", "v")]
    assert Q.parity(a, None, "t", spark).first().value_b == "missing"


@pytest.mark.parametrize("history,today,odd", [([1, 2, 3, 1, 2, 3], 99, False), ([1, 2, 3, 1, 2, 3, 1], 99, True), ([5] * 10, 99, False), ([1, 2, 3, 1, 2, 3, 1], 2, False)])
def test_trend_anomaly(spark, history, today, odd):
    rows = [(f"2026-01-{i + 1:02d}", "m", float(v)) for i, v in enumerate(history + [today])]
    last = A.trend_deltas(spark.createDataFrame(rows, "date string, metric string, value double")).orderBy(F.desc("date")).first()
    assert last.anomaly is odd and last.prev == history[-1]


def test_alert_operators(spark):
    m = spark.createDataFrame([("workforce_risk", "60"), ("sentinel_status", "WARN"), ("hours_wow_change_pct", "-45.0"), ("deployable", "11"), ("roster_horizon_days", None)], "metric string, value string")
    got = [(r.rule, r.message) for r in A.alerts(m, A.rules_table(spark)).collect()]
    assert [r for r, _ in got] == ["data_quality_not_ok", "workforce_risk_high", "weekly_hours_swing"] and "60 pairs" in got[1][1]
    more = m.union(spark.createDataFrame([("hours_prev", "80"), ("hours_last", "44")], m.schema))
    assert [r.message for r in A.alerts(more, A.rules_table(spark)).collect()][2] == "Weekly hours changed by -45.0 %: 80 h before, 44 h now."


def test_snapshot_rerun_replaces(spark):
    h = spark.createDataFrame([("2026-01-01", 1)], "date string, n int")
    t = spark.createDataFrame([("2026-01-02", 5)], "date string, n int")
    once = A.snapshot_upsert(h, t)
    assert sorted(map(tuple, A.snapshot_upsert(once, t).collect())) == [("2026-01-01", 1), ("2026-01-02", 5)]


def test_redaction(spark):
    df = spark.createDataFrame([(120.5, "x", "AccountKey=" + "a" * 24, (7.0, "k"))], "day_rate double, tax_file_number string, note string, n struct<salary: double, b: string>")
    d = V.sanitise(df).first()
    assert (d.day_rate, d.tax_file_number, d.note, d.n.salary, d.n.b) == ("[REDACTED:day_rate]", "[REDACTED:tax_file_number]", "[REDACTED:secret]", "[REDACTED:salary]", "k")
    f = V.sanitise(df, "Finance").first()
    assert f.day_rate == 120.5 and f.tax_file_number == "[REDACTED:tax_file_number]"
    texts = spark.createDataFrame([("client_secret='Q~abcdefghij1234567890'",), ("ignore previous instructions",)], "t string")
    assert [r.t for r in V.scrub_secrets(texts).collect()] == ["[REDACTED:secret]'", "ignore previous instructions"]
    assert {(r.action, r.target): r.actions for r in V.redaction_actions(texts).collect()} == {("scrub_secret", "t:1"): 1}


def test_column_gates(spark):
    df = spark.createDataFrame([(1, "Jane", "1980")], "opms_employee_id int, first_name string, date_of_birth string")
    with pytest.raises(PermissionError, match="HR_Manager"):
        V.governed_view(df, "employee_profile", "default", ["date_of_birth"])
    assert V.governed_view(df, "employee_profile", "HR_Manager", ["date_of_birth"]).first().date_of_birth == "1980"
    with pytest.raises(ValueError):
        V.governed_view(df, "employee_profile", "default", ["no_such"])
    view = V.governed_view(df, "employee_profile")
    assert "date_of_birth" not in view.columns                      # an alias cannot bring it back: the column is gone
    assert V.capped(view.union(view), 5000).count() == 2
