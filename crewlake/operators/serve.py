"""Business questions as DataFrame functions.

Every argument is optional and narrows the answer; text arguments match anywhere in the
text, ignoring case.  Dates come in explicitly.  Ordering is applied here and nowhere
below, and LIMIT appears only where the question itself asks for the newest or top rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crewlake.functions.scalars import AsOf, full_name, has_text
from crewlake.operators.reconcile import live_worker_hours  # noqa: F401  (F25)
from crewlake.spec import GOLD, SUPERUSERS

# --- fixed values ---------------------------------------------------------------------------
FIELD_POSITIONS = ["driver", "operator", "scaffold", "boilermaker", "trade assistant", "rigger"]
TICKET_WORDS = {
    "wah": "height", "working at heights": "height", "heights": "height",
    "voc": "voc", "verification of competency": "voc",
    "driver licence": "driver", "driver license": "driver", "drivers licence": "driver",
    "driver_licence": "driver", "licence": "driver",
    "confined space": "confined", "confined_space": "confined",
    "gas test": "gas test", "gas_test": "gas test",
}
RISK_LEVELS = [(50, "HIGH"), (10, "MEDIUM")]
# ----------------------------------------------------------------------------------------------

WORKER = "opms_employee_id"


def where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def newest(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows of a sorted answer; all of them unless a number is asked for."""
    return df if n is None else df.limit(int(n))


def contains(c: Column | str, term: str | None) -> Column | None:
    return None if not term else has_text(c, term)


def any_contains(columns: Sequence[str], term: str | None) -> Column | None:
    return None if not term else reduce(lambda a, b: a | b, [has_text(c, term) for c in columns])


def equals(c: str, value) -> Column | None:
    return None if value is None else F.col(c) == value


def starts(c: str, prefix) -> Column | None:
    return None if not prefix else F.col(c).startswith(str(prefix))


def named(name: str | None) -> Column | None:
    return None if not name else has_text(full_name(), name)


def finance(role: str) -> bool:
    return role == "Finance" or role in SUPERUSERS


# --- people -------------------------------------------------------------------------------------

def search_employee(profile: DataFrame, name: str) -> DataFrame:
    """F1."""
    return where(profile, named(name)).select(WORKER, "first_name", "last_name", "position_name", "supplier_name",
                                              "is_active")


PROFILE = [WORKER, "person_id", "first_name", "last_name", "preferred_name", "position_name", "company_name",
           "supplier_name", "ops_section_name", "arrangement_type", "email_work", "phone_work",
           "home_airport_code", "is_active"]


def get_employee_profile(profile: DataFrame, worker_id=None, name: str | None = None) -> DataFrame:
    """without an argument the answer is empty, never everybody."""
    cond = equals(WORKER, worker_id) if worker_id is not None else named(name)
    return where(profile, F.lit(False) if cond is None else cond).select(*PROFILE)


def find_workers(profile: DataFrame, active: bool = True, position: str | None = None) -> DataFrame:
    """F3."""
    return where(profile, F.col("is_active") == active, contains("position_name", position)).select(
        WORKER, "first_name", "last_name", "position_name", "supplier_name")


def get_supplier_summary(suppliers: DataFrame, active_only: bool = True) -> DataFrame:
    """F4."""
    return where(suppliers, F.col("is_active") == True if active_only else None).select(  # noqa: E712
        "supplier_name", "worker_count", "phone", "email").orderBy(F.desc("worker_count"), "supplier_name")


def get_worker_licences(licences: DataFrame, worker_id=None, name: str | None = None) -> DataFrame:
    """F5."""
    cond = equals(WORKER, worker_id) if worker_id is not None else named(name)
    return where(licences, cond).select("first_name", "last_name", "licence", "licence_items")


def get_worker_ranking(ranking: DataFrame, role: str, top_n: int = 10) -> DataFrame:
    """needs the role that unlocks the scores."""
    need = GOLD["worker_ranking"].restricted["mob_score"]
    if role != need and role not in SUPERUSERS:
        raise PermissionError(f"worker_ranking.mob_score requires the {need} role")
    return ranking.select("first_name", "last_name", "mob_score", "site_score").orderBy(
        F.desc("mob_score"), "last_name", "first_name").limit(int(top_n))


# --- certificates ---------------------------------------------------------------------------------

def expired(certs: DataFrame) -> DataFrame:
    return certs.filter("is_expired")


def due_within(certs: DataFrame, days: int) -> DataFrame:
    return certs.filter(~F.col("is_expired") & F.col("days_to_expiry").between(0, int(days)))


def find_expired_tickets(certs: DataFrame, count_only: bool = False) -> DataFrame:
    """F7."""
    if count_only:
        return expired(certs).agg(F.count("*").alias("expired_certs"))
    return expired(certs).select("first_name", "last_name", "competency_name", "expiry_date").orderBy(
        F.desc("expiry_date"), "last_name", "first_name", "competency_name")


def find_expiring_tickets(certs: DataFrame, days: int = 30) -> DataFrame:
    """F8."""
    return due_within(certs, days).select("first_name", "last_name", "competency_name", "expiry_date",
                                          "days_to_expiry").orderBy("days_to_expiry", "last_name", "competency_name")


def check_worker_compliance(certs: DataFrame, worker_id=None, worker_name: str | None = None,
                            competency: str | None = None) -> DataFrame:
    """verdict per worker: compliant when any matching certificate is unexpired."""
    hit = where(certs, equals(WORKER, worker_id), named(worker_name), contains("competency_name", competency))
    return hit.groupBy(WORKER, "first_name", "last_name").agg(
        F.count("*").alias("certs"), F.bool_or(~F.col("is_expired")).alias("is_compliant"),
        F.max("expiry_date").alias("last_expiry"))


def compliance_of(workers: DataFrame, certs: DataFrame, competency: str) -> DataFrame:
    """F9 for a list of workers: nobody without a matching certificate is compliant."""
    verdicts = check_worker_compliance(certs, competency=competency).select(WORKER, "is_compliant")
    return workers.select(WORKER).distinct().join(verdicts, WORKER, "left").select(
        WORKER, F.coalesce("is_compliant", F.lit(False)).alias("is_compliant"))


def find_not_eligible_workers(certs: DataFrame) -> DataFrame:
    """F10."""
    return expired(certs).groupBy("first_name", "last_name").agg(F.count("*").alias("expired_certs")).orderBy(
        F.desc("expired_certs"), "last_name", "first_name")


def expiry_forecast(certs: DataFrame, months: int = 6, days_per_month: int = 30) -> DataFrame:
    """F11."""
    return due_within(certs, int(months) * days_per_month).groupBy(
        F.substring("expiry_date", 1, 7).alias("month")).agg(F.count("*").alias("certs_expiring")).orderBy("month")


def compliance_by_group(certs: DataFrame) -> DataFrame:
    """F12."""
    return certs.groupBy("group_name").agg(F.count("*").alias("total_certs"),
                                           F.count_if("is_expired").alias("expired")).orderBy(F.desc("expired"), "group_name")


def workers_holding_all(certs: DataFrame, tickets: Sequence[str]) -> DataFrame:
    """workers with a valid certificate for every required ticket (relational division)."""
    words = [TICKET_WORDS.get(t, t.replace("_", " ")) for t in tickets]
    valid = certs.filter(~F.col("is_expired"))
    flags = [F.max(has_text("competency_name", w).cast("int")).alias(f"_t{i}") for i, w in enumerate(words)]
    held = valid.groupBy("first_name", "last_name").agg(*flags)
    score = reduce(lambda a, b: a + b, [F.coalesce(f"_t{i}", F.lit(0)) for i in range(len(words))])
    return held.withColumn("matched", score).filter(F.col("matched") == len(words)).select(
        "first_name", "last_name", "matched").orderBy("last_name", "first_name")


# --- rosters -----------------------------------------------------------------------------------------

def since_days(as_of: AsOf, days: int) -> str:
    """ISO bound computed on the driver so that the filter stays on the raw text column."""
    from datetime import date, timedelta
    return (date.fromisoformat(str(as_of)) - timedelta(days=int(days))).isoformat()


def rostered_from(roster: DataFrame, first_day: str) -> DataFrame:
    return roster.filter(F.col("roster_date") >= first_day)


def get_roster_summary(roster: DataFrame, period: str | None = None, project: str | None = None, worker_id=None,
                       date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """F13."""
    return where(roster, starts("roster_date", period), contains("project_name", project), equals(WORKER, worker_id),
                 F.col("roster_date") >= date_from if date_from else None,
                 F.col("roster_date") <= date_to if date_to else None).select(
        "first_name", "last_name", "roster_date", "project_name", "position_name").distinct().orderBy("roster_date")


def find_roster_gaps(profile: DataFrame, roster: DataFrame, as_of: AsOf, days: int = 90) -> DataFrame:
    """active workers without any roster in the window; the roster side is reduced to ids first."""
    busy = rostered_from(roster, since_days(as_of, days)).select(WORKER).distinct()
    return profile.filter("is_active").join(busy, WORKER, "left_anti").select(
        WORKER, "first_name", "last_name", "position_name")


def check_roster_risk(roster: DataFrame, certs: DataFrame, as_of: AsOf, days_back: int = 30,
                      project: str | None = None) -> DataFrame:
    """rostered workers with expired certificates, one row per distinct combination.

    Both sides are made distinct before the join, so repeated roster days do not multiply
    repeated certificates.
    """
    recent = where(rostered_from(roster, since_days(as_of, days_back)), contains("project_name", project)).select(
        WORKER, "first_name", "last_name", "project_name").distinct()
    lapsed = expired(certs).select(WORKER, "competency_name", "expiry_date").distinct()
    return recent.join(lapsed, WORKER).select(
        "first_name", "last_name", "project_name", "competency_name", "expiry_date").distinct().orderBy(
        "last_name", "first_name")


# --- time ---------------------------------------------------------------------------------------------

def weekly_filter(weekly: DataFrame, date_from=None, date_to=None, worker_id=None, worker_name=None, project=None,
                  site=None) -> DataFrame:
    return where(weekly, F.col("work_date") >= date_from if date_from else None,
                 F.col("work_date") <= date_to if date_to else None, equals(WORKER, worker_id), named(worker_name),
                 contains("project_name", project), contains("site_name", site))


def get_weekly_timesheet(weekly: DataFrame, **filters) -> DataFrame:
    """F16: day entries."""
    return weekly_filter(weekly, **filters).select(
        WORKER, "first_name", "last_name", "position_name", "supplier_name", "project_name", "site_name", "work_date",
        "shift_type", "roster_hours", "gap_hours", "actual_hours", "hours_source").orderBy(
        "work_date", "last_name", "first_name")


def weekly_matrix(weekly: DataFrame, date_from: str, date_to: str, **filters) -> DataFrame:
    """one row per person, a column per day and shift (at most seven days), then totals."""
    from datetime import date, timedelta
    first = date.fromisoformat(date_from)
    days = [first + timedelta(i) for i in range(min((date.fromisoformat(date_to) - first).days, 6) + 1)]
    keys = ["position_name", "first_name", "last_name", "site_name", "project_name"]

    def hours(cond: Column, empty=None) -> Column:
        return F.sum(F.when(cond, F.col("actual_hours")).otherwise(F.lit(empty)))

    # explicit slots instead of a value scan: the pivot is one aggregation
    slots = [hours((F.col("work_date") == d.isoformat()) & (F.col("shift_type") == s)).alias(f"{d:%a %d/%m} {s}")
             for d in days for s in ("DS", "NS")]
    return weekly_filter(weekly, date_from=date_from, date_to=date_to, **filters).groupBy(*keys).agg(
        *slots, hours(F.col("shift_type") == "DS", 0.0).alias("total_ds"),
        hours(F.col("shift_type") == "NS", 0.0).alias("total_ns"),
        F.sum("actual_hours").alias("total_hours")).orderBy("position_name", "last_name", "first_name")


def weekly_by_worker(weekly: DataFrame, **filters) -> DataFrame:
    """F18."""
    return weekly_filter(weekly, **filters).groupBy(WORKER, "first_name", "last_name", "position_name").agg(
        F.max("supplier_name").alias("supplier_name"), F.count("*").alias("days_worked"),
        F.sum("roster_hours").alias("roster_hours"), F.sum("gap_hours").alias("gap_hours"),
        F.sum("actual_hours").alias("actual_hours")).orderBy(F.desc("actual_hours"), WORKER)


def weekly_by_day(weekly: DataFrame, **filters) -> DataFrame:
    """F19."""
    return weekly_filter(weekly, **filters).groupBy("work_date").agg(
        F.countDistinct(WORKER).alias("workers"), F.sum("actual_hours").alias("actual_hours")).orderBy("work_date")


def get_worker_hours(months: DataFrame, worker_id=None, worker_name=None, month=None, year=None) -> DataFrame:
    """total hours and entries per worker; the arguments are pushed-down filters."""
    return where(months, equals(WORKER, worker_id), named(worker_name), equals("month", month),
                 starts("month", year) if not month else None).groupBy(WORKER, "first_name", "last_name").agg(
        F.sum("total_hours").alias("total_hours"), F.sum("entry_count").alias("entries"))


def get_site_hours(months: DataFrame, site=None, year=None) -> DataFrame:
    """F21."""
    return where(months, contains("site_name", site), starts("month", year)).groupBy("site_name").agg(
        F.sum("total_hours").alias("total_hours")).orderBy(F.desc("total_hours"), "site_name")


def get_project_hours(roster: DataFrame, project=None) -> DataFrame:
    """rostered hours stand in for project hours, timesheets do not know projects."""
    cond = contains("project_name", project) if project else F.col("project_name").isNotNull()
    return where(roster, cond).groupBy("project_name").agg(F.sum("hours").alias("rostered_hours")).orderBy(
        F.desc("rostered_hours"), "project_name")


def get_timesheet_summary(months: DataFrame, year=None, by: str = "site") -> DataFrame:
    """F23."""
    dim = "site_name" if by == "site" else "month"
    return where(months, starts("month", year)).groupBy(dim).agg(
        F.sum("total_hours").alias("total_hours"), F.sum("entry_count").alias("entries")).orderBy(
        F.desc("total_hours"), dim)


def top_workers_by_hours(months: DataFrame, year=None, top_n: int = 10) -> DataFrame:
    """F24."""
    return where(months, starts("month", year)).groupBy("first_name", "last_name").agg(
        F.sum("total_hours").alias("total_hours")).orderBy(F.desc("total_hours"), "last_name", "first_name").limit(int(top_n))


# --- projects ---------------------------------------------------------------------------------------------

def resolve_project_client(bridge: DataFrame, term: str) -> DataFrame:
    """F26."""
    cols = ["job_code", "job_title", "project_name", "client_code", "client_name", "opms_project_name"]
    return where(bridge, any_contains(cols, term)).select(*cols, "source").orderBy("source", "job_code")


def get_active_projects(projects: DataFrame, client=None) -> DataFrame:
    """F27."""
    return where(projects, F.col("is_active") == True, contains("client_name", client)).select(  # noqa: E712
        "project_name", "client_name", "job_count", "active_job_count", "project_start_date").orderBy(
        F.desc("job_count"), "project_name")


def get_project_jobs(projects: DataFrame, client=None, project=None) -> DataFrame:
    """F28."""
    return where(projects, contains("client_name", client), contains("project_name", project)).select(
        "project_name", "client_name", "job_count", "active_job_count").orderBy(F.desc("job_count"), "project_name")


def project_job_totals(projects: DataFrame, client=None, project=None) -> DataFrame:
    zero = F.lit(0)
    return get_project_jobs(projects, client, project).agg(
        F.count("*").alias("projects"), F.coalesce(F.sum("job_count"), zero).alias("jobs"),
        F.coalesce(F.sum("active_job_count"), zero).alias("active_jobs"))


def get_job_detail(jobs: DataFrame, job_code=None, client=None, active_only: bool = False) -> DataFrame:
    """F29."""
    return where(jobs, any_contains(["job_code", "job_title"], job_code), contains("client_name", client),
                 F.col("is_active") == True if active_only else None).select(  # noqa: E712
        "job_code", "job_title", "job_status", "project_name", "client_name", "work_location_name",
        "lead_first_name", "lead_last_name", "is_active").orderBy("job_code")


def get_site_assignments(sites: DataFrame, site=None, worker=None) -> DataFrame:
    """F30."""
    return where(sites, contains("site_name", site), named(worker)).select(
        "first_name", "last_name", "position_name", "site_name", "team_name").distinct().orderBy("last_name", "first_name")


# --- assets and stock ---------------------------------------------------------------------------------------

def search_assets(assets: DataFrame, term=None, status=None) -> DataFrame:
    """F31."""
    return where(assets, any_contains(["asset_name", "asset_id", "model"], term), contains("status", status)).select(
        "asset_id", "asset_name", "status", "model", "manufacturer_name", "location_name", "asset_group_name").orderBy("asset_id")


def assets_by_status(assets: DataFrame) -> DataFrame:
    """F31."""
    return assets.groupBy("status").agg(F.count("*").alias("asset_count")).orderBy(F.desc("asset_count"), "status")


def get_inventory_summary(stock: DataFrame, item=None, location=None) -> DataFrame:
    """F32."""
    return where(stock, contains("item_name", item), contains("location_name", location)).select(
        "item_name", "stock", "location_name", "category_name").orderBy(F.desc("stock"), "item_name")


def find_low_stock(stock: DataFrame, threshold: int = 5) -> DataFrame:
    """unknown stock counts as low and is listed first."""
    return stock.filter(F.col("stock").isNull() | (F.col("stock") <= int(threshold))).select(
        "item_name", "stock", "location_name").orderBy(F.asc_nulls_first("stock"), "item_name")


def _signouts(ledger: DataFrame, item, location) -> DataFrame:
    return where(ledger, F.col("txn_kind") == "sign_out", any_contains(["item_name", "item_code"], item),
                 contains("from_location", location))


def get_ppe_signouts(ledger: DataFrame, person=None, item=None, location=None, job=None, month=None,
                     n: int | None = None) -> DataFrame:
    """sign-outs, newest first."""
    return newest(where(_signouts(ledger, item, location), contains("person_name", person),
                 any_contains(["job_code", "job_title", "project_name"], job), equals("txn_month", month)).select(
        "txn_date", "item_name", "units", "from_location", "person_name", "job_code", "project_name",
        "bms_txn_id").orderBy(F.desc("txn_date"), F.desc("bms_txn_id")), n)


def get_ppe_monthly_usage(ledger: DataFrame, item=None, location=None, project=None, months: int | None = None) -> DataFrame:
    """usage per month, newest first."""
    return newest(where(_signouts(ledger, item, location), contains("project_name", project)).groupBy("txn_month").agg(
        F.sum("units").alias("total_units"), F.count("*").alias("sign_out_lines"),
        F.countDistinct("person_name").alias("distinct_people")).orderBy(F.desc("txn_month")), months)


def hardware_stock(hardware: DataFrame, term=None) -> DataFrame:
    """F36."""
    return where(hardware, any_contains(["hardware_name", "code"], term)).select(
        "hardware_name", "code", "status", "in_stock", "category_name").orderBy(F.desc("in_stock"), "hardware_name")


# --- money ----------------------------------------------------------------------------------------------------

def get_purchase_summary(purchases: DataFrame, role: str = "default", supplier=None) -> DataFrame:
    """amounts only for the Finance role."""
    aggs = [F.count("*").alias("purchase_count"), F.sum("line_count").alias("total_lines")]
    order = "purchase_count"
    if finance(role):
        aggs.append(F.sum("computed_total").alias("total_spend"))
        order = "total_spend"
    return where(purchases, contains("supplier_name", supplier)).groupBy("supplier_name").agg(*aggs).orderBy(
        F.desc(order), "supplier_name")


def _absent(columns: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """the typed empty answer of a source that is not loaded."""
    return SparkSession.active().createDataFrame([], ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))


def get_client_revenue(revenue: DataFrame | None, role: str = "default", client=None, year=None) -> DataFrame:
    """an absent source answers with no rows."""
    if revenue is None:
        money = ["invoiced", "paid", "outstanding"] if finance(role) else []
        return _absent(["contact_name", "invoices", *money], ["string", "long", *["double"] * len(money)])
    aggs = [F.sum("invoices").alias("invoices")]
    if finance(role):
        aggs += [F.sum(c).alias(c) for c in ("invoiced", "paid", "outstanding")]
    return where(revenue, contains("contact_name", client), starts("month", year)).groupBy("contact_name").agg(
        *aggs).orderBy(F.desc("invoiced" if finance(role) else "invoices"), "contact_name")


def get_outstanding_invoices(register: DataFrame | None, role: str = "default", client=None) -> DataFrame:
    """F39."""
    cols = ["invoice_number", "contact_name", "job_code", "invoice_date", "due_date"]
    if register is None:
        money = ["total", "amount_due"] if finance(role) else []
        return _absent([*cols, *money], [*["string"] * len(cols), *["double"] * len(money)])
    rows = where(register, F.col("invoice_type") == "ACCREC", F.col("status") == "AUTHORISED",
                 F.col("amount_due") > 0 if finance(role) else None, contains("contact_name", client))
    return rows.select(*cols, *(["total", "amount_due"] if finance(role) else [])).orderBy("due_date", "invoice_number")


def get_project_revenue(register: DataFrame | None, role: str = "default", job_code: str | None = None) -> DataFrame:
    """every job code at once unless one is asked for."""
    if register is None:
        money = ["invoiced", "outstanding"] if finance(role) else []
        return _absent(["job_code", "contact_name", "invoices", *money], ["string", "string", "long", *["double"] * len(money)])
    rows = where(register, F.col("invoice_type") == "ACCREC", F.col("job_code").isNotNull(), contains("job_code", job_code),
                 F.col("status").isin("AUTHORISED", "PAID") if finance(role) else None)
    aggs = [F.count("*").alias("invoices")]
    if finance(role):
        aggs += [F.sum("total").alias("invoiced"), F.sum("amount_due").alias("outstanding")]
    out = rows.groupBy("job_code", "contact_name").agg(*aggs)
    return out.orderBy(F.desc("invoiced")) if finance(role) else out


def get_rate_card(rates: DataFrame, role: str = "default", project=None, position=None) -> DataFrame:
    """F41."""
    cols = ["day_shift_rate", "night_shift_rate"] if finance(role) else ["project_code"]
    return where(rates, contains("project_name", project), contains("rate_title", position)).select(
        "rate_title", "project_name", *cols).orderBy("project_name", "rate_title")


def or_insufficient(table: DataFrame | None, question, name: str) -> tuple[DataFrame, str | None]:
    """the answer, and a caveat when its source is absent; other errors still raise."""
    caveat = None if table is not None else f"insufficient_data: {name} is not loaded; no figure may be substituted"
    return question(table), caveat


# --- safety and audit --------------------------------------------------------------------------------------------

def get_hseq_register(register: DataFrame, open_only=False, overdue_only=False, priority=None) -> DataFrame:
    """F43."""
    flag = F.col("is_overdue") if overdue_only else F.col("is_open") if open_only else None
    return where(register, flag, contains("action_priority", priority)).select(
        "issue_title", "issue_type", "issue_status", "action_priority", "action_due_date", "is_open",
        "is_overdue").orderBy("action_due_date")


def get_audit_issues(audit: DataFrame, worker_id=None, event_type=None, limit: int | None = None) -> DataFrame:
    """changes, newest first."""
    return newest(where(audit, equals(WORKER, worker_id), contains("event_type", event_type)).select(
        "created_at", "event_type", "first_name", "last_name", "change_log_id").orderBy(
        F.desc("created_at"), F.desc("change_log_id")), limit)


def audit_event_breakdown(audit: DataFrame) -> DataFrame:
    """F44."""
    return audit.groupBy("event_type").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "event_type")


# --- across domains --------------------------------------------------------------------------------------------------

def find_deployable_workers(profile: DataFrame, certs: DataFrame, roster: DataFrame, as_of: AsOf,
                            positions: Sequence[str] = tuple(FIELD_POSITIONS)) -> DataFrame:
    """active field trade, no expired certificate, not rostered from today on."""
    trade = reduce(lambda a, b: a | b, [has_text("position_name", p) for p in positions])
    lapsed = expired(certs).select(WORKER).distinct()
    busy = rostered_from(roster, str(as_of)).select(WORKER).distinct()
    return (profile.filter(F.col("is_active") & trade).join(lapsed, WORKER, "left_anti").join(busy, WORKER, "left_anti")
            .select(WORKER, "first_name", "last_name", "position_name", "supplier_name"))


def worker_facts(profile: DataFrame, certs: DataFrame, roster: DataFrame, positions: Sequence[str] = tuple(FIELD_POSITIONS)) -> DataFrame:
    """One row per worker with what all workforce figures need; every table is read once and reduced before they meet.

    is_active, field (holds a field position), expired, expired_kinds (competencies with an expired certificate), due_30d,
    due_90d, last_day (last rostered day).  Workers of one table alone are there as well.
    """
    trade = reduce(lambda a, b: a | b, [has_text("position_name", p) for p in positions])
    people = profile.select(WORKER, F.coalesce("is_active", F.lit(False)).alias("is_active"), F.coalesce(trade, F.lit(False)).alias("field"))
    open_days = lambda n: F.count_if(~F.col("is_expired") & F.col("days_to_expiry").between(0, n))
    held = certs.groupBy(WORKER, "competency_name").agg(
        F.count_if("is_expired").alias("expired"), open_days(30).alias("due_30d"), open_days(90).alias("due_90d")).withColumn(
        "expired_kinds", (F.col("expired") > 0).cast("bigint")).drop("competency_name")
    days = roster.groupBy(WORKER).agg(F.max("roster_date").alias("last_day"))
    all_of = people.unionByName(held, allowMissingColumns=True).unionByName(days, allowMissingColumns=True)
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expired", "expired_kinds", "due_30d", "due_90d")]
    flag = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("is_active", "field")]
    return all_of.groupBy(WORKER).agg(*flag, *total, F.max("last_day").alias("last_day"))


def not_rostered_since(first_day: str) -> Column:
    return F.col("last_day").isNull() | (F.col("last_day") < first_day)


def workforce_figures(facts: DataFrame, as_of: AsOf) -> DataFrame:
    """One row of figures from :func:`worker_facts`."""
    def total(c: str, when: Column | None = None) -> Column:
        return F.coalesce(F.sum(c if when is None else F.when(when, F.col(c))), F.lit(0)).alias(c)

    recent = F.col(WORKER).isNotNull() & (F.col("last_day") >= since_days(as_of, 30))
    return facts.agg(
        total("expired_kinds", recent), total("due_30d"), total("expired"), F.count_if("is_active").alias("active"),
        F.count_if(F.col("is_active") & not_rostered_since(since_days(as_of, 90))).alias("idle"),
        F.count_if(F.col("is_active") & F.col("field") & (F.col("expired") == 0) & not_rostered_since(str(as_of))).alias("deployable"))


def expired_per_worker(certs: DataFrame) -> DataFrame:
    """Expired certificates counted per worker: one row per worker before any join."""
    return expired(certs).groupBy(WORKER).agg(F.count("*").alias("expired_certs"))


def site_compliance_report(sites: DataFrame, certs: DataFrame, site: str | None = None) -> DataFrame:
    """F46."""
    crew = where(sites, contains("site_name", site))
    return crew.join(expired_per_worker(certs), WORKER).groupBy("site_name", "first_name", "last_name", "position_name").agg(
        F.sum("expired_certs").alias("expired_certs")).orderBy(F.desc("expired_certs"), "last_name")


def supplier_compliance_risk(profile: DataFrame, certs: DataFrame) -> DataFrame:
    """F47."""
    holders = profile.filter("supplier_name IS NOT NULL").select(WORKER, "supplier_name")
    return holders.join(expired_per_worker(certs), WORKER).groupBy("supplier_name").agg(
        F.countDistinct(WORKER).alias("workers_with_expired"), F.sum("expired_certs").alias("expired_certs")).orderBy(
        F.desc("expired_certs"), "supplier_name")


def worker_360(profile: DataFrame, certs: DataFrame, roster: DataFrame, months: DataFrame, licences: DataFrame,
               worker_id=None, recent: int = 5) -> DataFrame:
    """everything about each worker; a worker id is just a filter pushed into every input.

    The roster part holds the newest ``recent`` days (Spark limits each group before the shuffle); licences are listed by
    name, which is bounded by what one person holds.
    """
    p, c, r, m, li = (where(t, equals(WORKER, worker_id)) for t in (profile, certs, roster, months, licences))
    counts = c.groupBy(WORKER).agg(F.count_if("is_expired").alias("expired"), F.count_if(~F.col("is_expired")).alias("valid"),
                                   F.count_if("is_expiring_soon").alias("expiring_90d"))
    newest = Window.partitionBy(WORKER).orderBy(F.desc("roster_date"), "project_name", "position_name")
    last = (r.select(WORKER, "roster_date", "project_name", "position_name")
            .withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= recent)
            .groupBy(WORKER).agg(F.sort_array(F.collect_list(F.struct("n", "roster_date", "project_name", "position_name")))
                                 .alias("recent_roster")))
    hours = m.groupBy(WORKER).agg(F.sum("total_hours").alias("total_hours"))
    held = li.groupBy(WORKER).agg(F.count("*").alias("licences"), F.sort_array(F.collect_list("licence")).alias("licence_list"))
    out = p.select(WORKER, "first_name", "last_name", "position_name", "supplier_name", "is_active", "email_work")
    for part in (counts, last, hours, held):
        out = out.join(part, WORKER, "left")
    return out.na.fill(0, ["expired", "valid", "expiring_90d", "licences"]).na.fill(0.0, ["total_hours"])


# --- files and forms ---------------------------------------------------------------------------------------------------

FILE_COLUMNS = ["site", "library", "file_name", "folder_path", "ext", "size_kb", "modified_at", "modified_by", "web_url"]


def find_files(index: DataFrame, keyword: str, library=None, ext=None, site=None, n: int | None = None) -> DataFrame:
    """every word must appear in the name or the path."""
    words = [any_contains(["file_name", "folder_path"], w) for w in (keyword or "").split()]
    return newest(where(index, *words, contains("site", site), contains("library", library),
                 equals("ext", ext.lstrip(".").lower()) if ext else None).select(*FILE_COLUMNS).orderBy(
        F.desc("modified_at"), "web_url"), n)


def list_folder(index: DataFrame, folder: str, library=None, site=None, n: int | None = None) -> DataFrame:
    """F50."""
    return newest(where(index, contains("folder_path", folder), contains("site", site), contains("library", library)).select(
        *FILE_COLUMNS).orderBy(F.desc("modified_at"), "web_url"), n)


def list_form_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """catalogue of the form lists and their fields."""
    rows = [(name, ", ".join(c for c in df.columns if c != "id")) for name, df in sorted(tables.items())]
    return spark.createDataFrame(rows, "table string, fields string")


def form_table(tables: dict[str, DataFrame], name: str) -> tuple[str, DataFrame] | None:
    """the one list whose name is, or else contains, ``name``; several are not guessed between."""
    asked = name.strip().lower().replace(" ", "_").replace("-", "_")
    found = [t for t in sorted(tables) if t == asked] or [t for t in sorted(tables) if asked and asked in t]
    return (found[0], tables[found[0]]) if len(found) == 1 else None


def search_form(table: DataFrame, keyword=None, limit: int | None = None, modified: str = "Modified") -> DataFrame:
    """rows of one form list, newest first, the keyword in any of its columns."""
    cols = [c for c in table.columns if not c.endswith("LookupId") and c != "id"]
    return newest(where(table, any_contains(cols, keyword)).orderBy(F.desc(modified), "id"), limit)


def job_runs(history: DataFrame, name: str | None = None, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """newest runs per job, and those of them that did not succeed (a run without verdict is open)."""
    newest = Window.partitionBy("automation").orderBy(F.desc("updated_at"), F.desc("run_id"))
    runs = (where(history, contains("automation", name)).withColumn("n", F.row_number().over(newest))
            .filter(F.col("n") <= int(limit)).drop("n"))
    return runs, runs.filter("conclusion IS NOT NULL AND conclusion <> 'success'")


# --- reports -------------------------------------------------------------------------------------------------------------

def beside(*parts: DataFrame) -> DataFrame:
    """One-row frames next to each other: stacked as a union and folded, so nothing is cross-joined."""
    names = [c for p in parts for c in p.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def workforce_risk_report(roster, certs, profile, as_of: AsOf) -> DataFrame:
    """one row with risk level, combinations, worst supplier, idle bench and expiries to come."""
    risk = check_roster_risk(roster, certs, as_of).agg(F.count("*").alias("combinations"))
    worst = supplier_compliance_risk(profile, certs).agg(
        F.max_by("supplier_name", F.struct("expired_certs", "supplier_name")).alias("worst_supplier"),
        F.max("expired_certs").alias("worst_supplier_certs"))
    idle = find_roster_gaps(profile, roster, as_of).agg(F.count("*").alias("idle_workers"))
    due = due_within(certs, 90).agg(F.count("*").alias("due_90d"))
    level = None
    for bound, label in RISK_LEVELS:
        hit = F.col("combinations") > bound
        level = F.when(hit, label) if level is None else level.when(hit, label)
    return beside(risk, worst, idle, due).withColumn("level", level.otherwise("LOW"))


def workforce_report(profile, certs, roster, suppliers, as_of: AsOf, positions=tuple(FIELD_POSITIONS)) -> DataFrame:
    """F54."""
    figures = workforce_figures(worker_facts(profile, certs, roster, positions), as_of).select(
        F.col("active").alias("active_workers"), F.col("expired").alias("expired_certs"), F.col("due_30d").alias("expiring_30d"),
        "deployable", F.col("idle").alias("bench"))
    supply = suppliers.filter("is_active").agg(F.count("*").alias("active_suppliers"),
                  F.max_by("supplier_name", F.struct("worker_count", "supplier_name")).alias("largest_supplier"))
    return beside(figures, supply)


def site_readiness(sites: DataFrame, certs: DataFrame) -> DataFrame:
    """verdict for every site at once."""
    crew = sites.select("site_name", WORKER, "first_name", "last_name", "position_name").distinct()
    holes = crew.join(expired_per_worker(certs), WORKER, "left")
    return holes.groupBy("site_name").agg(
        F.count("*").alias("crew"), F.count_if(F.col("expired_certs") > 0).alias("crew_with_expired")).withColumn(
        "verdict", F.when(F.col("crew_with_expired") > 0, "AT RISK").when(F.col("crew") > 0, "READY")
        .otherwise("NO CREW ASSIGNED"))


def result_meta(df: DataFrame, tables: Sequence[str], approx: bool = False, blocked: bool = False) -> DataFrame:
    """row count, confidence and caveats of an answer."""
    notes = "; ".join(GOLD[t].caveat for t in tables if t in GOLD and GOLD[t].caveat)
    meta = df.agg(F.count("*").alias("row_count"))
    level = (F.when(F.lit(blocked), "Low").when((F.col("row_count") == 0) | F.lit(approx), "Medium").otherwise("High"))
    return meta.withColumn("confidence", level).withColumn("caveats", F.lit(notes))
