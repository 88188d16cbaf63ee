from pyspark.sql import functions as F

from crewlake.operators import gold as G
from crewlake.operators import serve as S

QUOTE = ("job_code string, uploaded_at string, job_title string, payload struct<shift_types: array<struct<desc: string, hrs: double, type: string>>, "
         "staff_roles: array<struct<id: string, role: string, qty: double, dsRate: double>>, new_roles: array<struct<id: string, role: string, qty: double, dsRate: double>>, "
         "manning: map<string, map<string, string>>>")


def payload(manned=True):
    grid = {"r1": {"d1": "DS12.5", "d2": "DS12.5", "d3": "OFF"}, "r2": {"d1": "DS12.5", "d2": "NS12"}} if manned else {}
    return ([("DS12.5", 12.5, "DS"), ("NS12", 12.0, "NS")], [("r1", "Supervisor", 1.0, 999.0), ("r2", "Trades Assistant", 4.0, None)], [], grid)


def test_quote_hours_uses_newest_manned_version_without_rates(spark):
    df = spark.createDataFrame([("26046", "2026-07-24", "manned", payload()), ("26046", "2026-07-25", "newer but empty", payload(False))], QUOTE)
    out = G.quote_hours(df)
    rows = {r.role: r for r in out.collect()}
    assert rows["Supervisor"].total_hours == 25.0 and rows["Supervisor"].job_code == "SH-26046" and rows["Supervisor"].job_title == "manned"
    assert (rows["Trades Assistant"].ds_hours, rows["Trades Assistant"].ns_hours) == (50.0, 48.0)
    assert G.quote_totals(out).first().total_hours == 123.0
    assert not any("rate" in c.lower() for c in out.columns)


def test_bridge_prefers_manual_map(spark):
    jobs = spark.createDataFrame([("sh-26046", "T", "1", 1), ("bad", "T", "1", 2)], "JobID string, Title string, ProjectLookupId string, _pos bigint")
    projects = spark.createDataFrame([(1, "P", "", 5)], "id bigint, Title string, ATitle string, ClientLookupId bigint")
    clients = spark.createDataFrame([(5, "Client Five")], "id bigint, Title string")
    manual = spark.createDataFrame([("SH-26046 - Special", "C9", 1)], "resourceRequestProject string, resourceRequestClient string, _pos bigint")
    r = G.ClientResolver.build(jobs, projects, clients, manual)
    df = spark.createDataFrame([("SH-26046 - Special",), ("sh-26046 - other",), ("nothing",), (None,)], "project_name string")
    assert {x.project_name: x.client_name for x in r.attach(df).collect()} == {
        "SH-26046 - Special": "C9", "sh-26046 - other": "Client Five", "nothing": None, None: None}
    assert G.project_bridge(jobs, projects, clients, manual).count() == 2


def test_movement_kind_precedence(spark):
    df = spark.createDataFrame([("1", "2", "Stores Moved"), (None, "2", "Stores Moved"), (None, None, "Stores Moved x"), (None, None, None)], "p string, b string, t string")
    assert [r.k for r in df.select(G.movement_kind(F.col("p"), F.col("b"), F.col("t")).alias("k")).collect()] == ["sign_out", "stock_in", "store_move", "other"]


def test_all_null_totals_are_zero_and_null_months_dropped(spark):
    p = spark.createDataFrame([("1", None, None, "7", "n", 1.0, "d")], "purchase_id string, unit_count string, unit_cost string, supplier_id string, inv_number string, inv_amount double, invoice_date string")
    assert G.purchase_summary(p, spark.createDataFrame([(7, "S")], "id bigint, Title string")).first().computed_total == 0.0
    assert G.revenue_summary(None, spark).count() == 0
    reg = spark.createDataFrame([("a", "ACCREC", "PAID", "c", None, 1.0, 1.0, 0.0), ("b", "ACCREC", "PAID", "c", "2026-01", 2.0, 2.0, 0.0)],
                                "invoice_id string, invoice_type string, status string, contact_name string, month string, total double, amount_paid double, amount_due double")
    assert [tuple(r) for r in G.revenue_summary(reg).collect()] == [("c", "2026-01", 1, 2.0, 2.0, 0.0)]


def test_low_stock_lists_unknown_first_and_ratings(spark):
    stock = spark.createDataFrame([("a", 3, "x"), ("b", None, "x"), ("c", 9, "x")], "item_name string, stock int, location_name string")
    assert [r.item_name for r in S.find_low_stock(stock).collect()] == ["b", "a"]
    r = G.rating_average(spark.createDataFrame([(1, "4, 5,x"), (1, None)], "PersonLookupId int, RankingData string"), extra=3).first()
    assert (r.scores, r.average, r.projected) == (2, 4.5, 4.0)


def test_missing_source_is_answered_with_a_caveat(spark):
    df, note = S.or_insufficient(None, lambda t: S.get_outstanding_invoices(t, "Finance"), "invoice_register")
    assert df.count() == 0 and note.startswith("insufficient_data")
