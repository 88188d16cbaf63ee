"""Queries for gold tables, quotes, job status and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlake.operators import gold as G
from crewlake.operators import jobs as J
from crewlake.plans.registry import add
from crewlake.plans.stand_in import AS_OF, Tables


def cols(text: str) -> list[str]:
    return [c.strip() for c in text.split(",")]


PROFILE = ("opms_employee_id, person_id, first_name, last_name, preferred_name, is_active, position_name, company_name, ops_section_name, "
           "supplier_name, arrangement_type, email_work, phone_work, home_airport_code, bms_position_id, ops_section_id, bms_supplier_id")
add("employee_profile", lambda t: t.profile.select(*cols(PROFILE)), f"SELECT {PROFILE} FROM profile")
CERTS = ("training_record_id, opms_employee_id, first_name, last_name, competency_name, group_name, status, issue_date, expiry_date, validity_years, "
         "days_to_expiry, is_expired, is_expiring_soon, has_document, arrangement_type, is_active, classified")
add("training_compliance", lambda t: t.certs.select(*cols(CERTS)), f"SELECT {CERTS.replace('days_to_expiry', 'CAST(days_to_expiry AS INTEGER) AS days_to_expiry')} FROM certs")
BRIDGE = "job_code, job_title, bms_project_id, project_name, client_code, client_name, opms_project_name, source"
add("project_bridge", lambda t: t.bridge.select(*cols(BRIDGE)), f"SELECT {BRIDGE} FROM bridge")


def _resolved(t: Tables):
    seen = t.roster.select("project_name").distinct()
    return t.resolver.attach(seen, into="client")


add("resolve_client", _resolved, "SELECT DISTINCT project_name, client_name AS client FROM roster")
ROSTER = "opms_employee_id, first_name, last_name, roster_date, position_name, work_type_name, project_name, client_name, hours, source"
add("roster_summary", lambda t: t.roster.select(*cols(ROSTER)), f"SELECT {ROSTER} FROM roster")
PROJECTS = "bms_project_id, project_name, project_code, status, is_active, bms_client_id, client_name, job_count, active_job_count, project_start_date"
add("project_job_summary", lambda t: t.project_jobs.select(*cols(PROJECTS)), f"SELECT {PROJECTS} FROM project_jobs")
JOBS = ("bms_job_id, job_title, job_code, job_status, is_active, project_name, client_name, lead_first_name, lead_last_name, work_location_name, "
        "ops_section_name")
add("job_detail", lambda t: t.job_details.select(*cols(JOBS)), f"SELECT {JOBS} FROM job_details")
ASSETS = "bms_asset_id, asset_name, asset_id, status, model, manufacturer_name, location_name, asset_group_name"
add("asset_register", lambda t: t.assets.select(*cols(ASSETS)), f"SELECT {ASSETS} FROM assets")
add("hardware_register", lambda t: t.hardware.select("bms_hardware_id", "hardware_name", "code", "status", "in_stock", "category_name", "hire_price"), """
SELECT p_partkey AS bms_hardware_id, p_name AS hardware_name, p_brand AS code, p_type AS status, p_size AS in_stock, s.title AS category_name,
  p_retailprice AS hire_price FROM part LEFT JOIN sections s ON s.id = p_partkey % 5""")
STOCK = "bms_store_id, item_name, stock, location_name, category_name"
add("inventory_summary", lambda t: t.stock.select(*cols(STOCK)), f"SELECT {STOCK} FROM stock")
add("licence_register", lambda t: t.licences, "SELECT * FROM licences")
add("worker_ranking", lambda t: t.ranking, """
SELECT c_custkey AS bms_ranking_id, 'Customer' AS first_name, split_part(c_name,'#',2) AS last_name, c_custkey AS opms_employee_id,
  c_nationkey AS site_score, c_acctbal AS mob_score FROM customer""")
add("site_assignment", lambda t: t.assignments, "SELECT * FROM assignments")
RATES = "bms_rate_id, rate_title, project_name, project_code, day_shift_rate, night_shift_rate"
add("rate_card", lambda t: t.rates.select(*cols(RATES)), f"SELECT {RATES} FROM rates")
ACTIONS = "bms_issue_id, issue_title, issue_type, issue_status, action_priority, action_due_date, action_completed_date, is_open, is_overdue"
add("hseq_register", lambda t: t.actions.select(*cols(ACTIONS)), f"SELECT {ACTIONS} FROM actions")
add("supplier_summary", lambda t: G.supplier_summary(t.supplier, t.person).select("bms_supplier_id", "supplier_name", "is_active", "worker_count"), """
SELECT n_nationkey AS bms_supplier_id, n_name AS supplier_name, n_nationkey % 2 = 0 AS is_active, count(p.opms_employee_id) AS worker_count
FROM nation LEFT JOIN person p ON p.bms_supplier_id = n_nationkey GROUP BY 1, 2, 3""")
PURCHASES = "purchase_id, supplier_id, inv_number, inv_amount, invoice_date, line_count, computed_total, supplier_name"
add("purchase_summary", lambda t: t.purchases.select(*cols(PURCHASES)), f"SELECT {PURCHASES} FROM purchases")
LEDGER = ("bms_txn_id, txn_date, txn_month, txn_kind, title, item_name, item_code, units, from_location, to_location, person_name, job_code, job_title, "
          "project_name")
add("ppe_transactions", lambda t: t.ledger.select(*cols(LEDGER)), f"SELECT {LEDGER} FROM ledger")
AUDIT = "change_log_id, created_at, event_type, opms_employee_id, first_name, last_name, value_before, value_after"
add("audit_activity", lambda t: t.audit.select(*cols(AUDIT)), f"SELECT {AUDIT} FROM audit")
INVOICES = ("invoice_id, invoice_number, invoice_type, status, contact_name, reference, job_code, bridge_client, invoice_date, month, due_date, subtotal, "
            "total, amount_paid, amount_due")
add("invoice_register", lambda t: t.invoices.select(*cols(INVOICES)), f"SELECT {INVOICES} FROM invoices")
add("revenue_summary", lambda t: t.revenue, "SELECT * FROM revenue")


# --- quotes: each order is one quote version of a job ----------------------------------------------

def quotes(t: Tables):
    li = t.raw("orders")
    key = F.col("o_orderkey")

    def role(i: str, qty):
        return F.struct(F.lit(i).alias("id"), F.concat(F.lit("Role "), F.lit(i)).alias("role"), qty.cast("double").alias("qty"),
                        F.lit(999.0).alias("dsRate"))
    off = F.col("o_orderpriority") == "5-LOW"
    day, night = F.when(off, "OFF").otherwise("DS12.5"), F.when(off, " ").otherwise("NS12")
    shifts = F.array(F.struct(F.lit("DS12.5").alias("desc"), F.lit(12.5).alias("hrs"), F.lit("DS").alias("type")),
                     F.struct(F.lit("NS12").alias("desc"), F.lit(12.0).alias("hrs"), F.lit("ns").alias("type")))
    grid = F.create_map(F.lit("r1"), F.create_map(F.lit("d1"), day, F.lit("d2"), day, F.lit("d3"), F.lit("OFF")),
                        F.lit("r2"), F.create_map(F.lit("d1"), day, F.lit("d2"), night, F.lit("d3"), F.lit("unknown shift")))
    payload = F.struct(shifts.alias("shift_types"), F.array(role("r1", F.lit(1))).alias("staff_roles"),
                       F.array(role("r2", key % 4 + 1)).alias("new_roles"), F.to_json(grid).alias("grid"))
    versions = li.select((F.lit(25000) + key % 100).cast("string").alias("job_code"),
                         F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("#"), F.lpad(key.cast("string"), 12, "0")).alias("uploaded_at"),
                         F.concat(F.lit("Quote "), key.cast("string")).alias("job_title"), payload.alias("p"))
    # the manning grid arrives as JSON text keyed by role and day
    manning = F.when(F.col("p.grid").contains("S"), F.from_json("p.grid", "map<string,map<string,string>>"))
    full = F.struct("p.shift_types", "p.staff_roles", "p.new_roles", manning.alias("manning"))
    return versions.select("job_code", "uploaded_at", "job_title", full.alias("payload"))


# versions of low priority plan only days off and are passed over
QUOTE_SQL = """
SELECT 'SH-'||(25000 + o_orderkey % 100) AS job_code, 'Quote '||o_orderkey AS job_title, r AS role, q AS qty,
  CAST(ds * q AS BIGINT) AS ds_shifts, CAST(ns * q AS BIGINT) AS ns_shifts, round(ds * 12.5 * q, 1) AS ds_hours, round(ns * 12.0 * q, 1) AS ns_hours,
  round((ds * 12.5 + ns * 12.0) * q, 1) AS total_hours
FROM (SELECT *, CASE WHEN r = 'Role r1' THEN 1.0 ELSE CAST(o_orderkey % 4 + 1 AS DOUBLE) END AS q
      FROM (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'
            QUALIFY row_number() OVER (PARTITION BY o_orderkey % 100 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
           (VALUES ('Role r1', 2, 0), ('Role r2', 1, 1)) v(r, ds, ns))"""
add("quote_hours", lambda t: G.quote_hours(quotes(t)).drop("uploaded_at"), QUOTE_SQL)


def _ratings(t: Tables):
    li = t.raw("lineitem")
    data = F.concat_ws(",", F.col("l_quantity").cast("string"), F.lit(" 3.5 "), F.lit("n/a"), F.when(F.col("l_returnflag") == "R", "7"))
    return G.rating_average(li.select(F.col("l_suppkey").alias("PersonLookupId"), data.alias("RankingData")), extra=4.0)


add("rating_average", _ratings, """
SELECT l_suppkey AS "PersonLookupId", CAST(sum(n) AS BIGINT) AS scores, round(sum(s)/sum(n),2) AS average, round((sum(s)+4.0)/(sum(n)+1),2) AS projected FROM (
SELECT l_suppkey, l_quantity + 3.5 + CASE WHEN l_returnflag='R' THEN 7 ELSE 0 END AS s, 2 + CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS n FROM lineitem) GROUP BY 1""")


def _status(t: Tables):
    jobs = t.job_details.withColumn("job_code", F.regexp_replace("job_code", "-A$", ""))
    return J.project_hours_status(jobs, t.roster, t.weekly, AS_OF)


add("project_hours_status", _status, """
SELECT j.job_code, job_title, job_status, project_name, client_name, coalesce(n,0) AS roster_entries, coalesce(nf,0) AS future_entries,
  coalesce(sh,0.0) AS scheduled_hours, coalesce(fh,0.0) AS future_hours, coalesce(oh,0.0) AS observed_hours, coalesce(ah,0.0) AS actual_hours,
  coalesce(ds,0.0) AS actual_ds, coalesce(ns,0.0) AS actual_ns, d AS drift_pct, coalesce(d > 10, FALSE) AS drift_warning,
  coalesce(n,0) > 0 AND coalesce(sh,0) = 0 AS scheduled_hours_missing, CASE WHEN coalesce(fh,0) > 0 THEN 'medium' ELSE 'high' END AS confidence,
  roster_max_date, timesheet_max_date
FROM (SELECT *, CASE WHEN past > 0 AND ah > 0 THEN round(abs(ah - past)/past*100, 1) END AS d FROM (
  SELECT j.*, r.*, w.*, CASE WHEN coalesce(sh,0) <> 0 THEN sh - fh ELSE coalesce(oh,0) END AS past
  FROM (SELECT upper(replace(job_code,'-A','')) AS ref, replace(job_code,'-A','') AS job_code, job_title, job_status, project_name, client_name FROM job_details) j
  LEFT JOIN (SELECT upper(nullif(regexp_extract(project_name,'(?i)^([A-Z]{2,4}-\\d{4,6})',1),'')) AS rref, count(*) AS n,
      count(*) FILTER (roster_date >= '2000-06-01') AS nf, round(coalesce(sum(hours),0),1) AS sh,
      round(coalesce(sum(hours) FILTER (roster_date >= '2000-06-01'),0),1) AS fh, max(roster_date) AS roster_max_date FROM roster GROUP BY 1) r ON r.rref = j.ref
  LEFT JOIN (SELECT upper(nullif(regexp_extract(project_name,'(?i)^([A-Z]{2,4}-\\d{4,6})',1),'')) AS wref, round(sum(actual_hours),1) AS ah,
      round(sum(roster_hours),1) AS oh, round(coalesce(sum(actual_hours) FILTER (shift_type='DS'),0),1) AS ds,
      round(coalesce(sum(actual_hours) FILTER (shift_type='NS'),0),1) AS ns, max(work_date) AS timesheet_max_date FROM weekly GROUP BY 1) w ON w.wref = j.ref)) j""")

# --- links ------------------------------------------------------------------------------------------------

add("link_audit", lambda t: t.links.select("jobid", "title", "column", "url", "status"), 'SELECT jobid, title, "column", url, status FROM links')
add("link_totals", lambda t: J.link_totals(t.links), """
SELECT coalesce("column",'(all)') AS "column", count(*) AS checked, count(*) FILTER (status='ok') AS ok, count(*) FILTER (status='broken') AS broken,
  count(*) FILTER (status='missing') AS missing FROM links GROUP BY ROLLUP ("column")""")
add("link_problems", lambda t: J.link_problems(t.links), """
SELECT jobid, title, count(*) FILTER (status='broken') AS broken, count(*) FILTER (status='missing') AS missing FROM links WHERE status <> 'ok' GROUP BY 1, 2""")
add("link_repair_plan", lambda t: J.link_repair_plan(t.links, t.link_locations), """
SELECT jobid, "column", cell AS old_value, replace(cell, l.url, p.url) AS new_value FROM links l JOIN pages p ON p.page_id = l.item_id
WHERE status = 'broken' AND p.url <> l.url""")
