"""Queries for serving functions, dashboard aggregates and KPIs (F, A, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlake.operators import analytics as A
from crewlake.operators import serve as S
from crewlake.plans.registry import add
from crewlake.plans.stand_in import AS_OF, FIELD_TRADES, Tables
from crewlake.sources.flatten import auto_tables

# --- people -------------------------------------------------------------------------------------------

add("search_employee", lambda t: S.search_employee(t.profile, "r 00000001"), """
SELECT opms_employee_id, first_name, last_name, position_name, supplier_name, is_active FROM profile
WHERE first_name||' '||last_name ILIKE '%r 00000001%'""")
PROFILE = ", ".join(S.PROFILE)
add("get_employee_profile", lambda t: S.get_employee_profile(t.profile, worker_id=17), f"SELECT {PROFILE} FROM profile WHERE opms_employee_id = 17")
add("find_active_workers", lambda t: S.find_workers(t.profile, True, "Ring"), """
SELECT opms_employee_id, first_name, last_name, position_name, supplier_name FROM profile WHERE is_active AND position_name ILIKE '%ring%'""")
add("find_inactive_workers", lambda t: S.find_workers(t.profile, False), """
SELECT opms_employee_id, first_name, last_name, position_name, supplier_name FROM profile WHERE NOT is_active""")


def suppliers(t: Tables):
    from crewlake.operators.gold import supplier_summary
    return supplier_summary(t.supplier, t.person)


SUPPLIERS = """(SELECT n_name AS supplier_name, n_nationkey % 2 = 0 AS is_active, count(p.opms_employee_id) AS worker_count, '08'||n_nationkey AS phone,
  's'||n_nationkey||'@example.com' AS email FROM nation LEFT JOIN person p ON p.bms_supplier_id = n_nationkey GROUP BY ALL)"""
add("get_supplier_summary", lambda t: S.get_supplier_summary(suppliers(t)), f"SELECT supplier_name, worker_count, phone, email FROM {SUPPLIERS} WHERE is_active")
add("get_worker_licences", lambda t: S.get_worker_licences(t.licences, name="customer 0000000"), """
SELECT first_name, last_name, licence, licence_items FROM licences WHERE first_name||' '||last_name ILIKE '%customer 0000000%'""")
add("get_worker_ranking", lambda t: S.get_worker_ranking(t.ranking, "HR_Manager", 25), """
SELECT 'Customer' AS first_name, split_part(c_name,'#',2) AS last_name, c_acctbal AS mob_score, c_nationkey AS site_score FROM customer
ORDER BY c_acctbal DESC, last_name LIMIT 25""")

# --- certificates -----------------------------------------------------------------------------------------

add("find_expired_tickets", lambda t: S.find_expired_tickets(t.certs), "SELECT first_name, last_name, competency_name, expiry_date FROM certs WHERE is_expired")
add("count_expired_tickets", lambda t: S.find_expired_tickets(t.certs, True), "SELECT count(*) AS expired_certs FROM certs WHERE is_expired")
add("find_expiring_tickets", lambda t: S.find_expiring_tickets(t.certs, 30), """
SELECT first_name, last_name, competency_name, expiry_date, CAST(days_to_expiry AS INTEGER) AS days_to_expiry FROM certs
WHERE NOT is_expired AND days_to_expiry BETWEEN 0 AND 30""")
add("check_worker_compliance", lambda t: S.check_worker_compliance(t.certs, competency="promo"), """
SELECT opms_employee_id, first_name, last_name, count(*) AS certs, bool_or(NOT is_expired) AS is_compliant, max(expiry_date) AS last_expiry FROM certs
WHERE competency_name ILIKE '%promo%' GROUP BY 1, 2, 3""")
add("compliance_of_workers", lambda t: S.compliance_of(t.profile, t.certs, "PROMO"), """
SELECT p.opms_employee_id, coalesce(bool_or(NOT c.is_expired), FALSE) AS is_compliant FROM profile p
LEFT JOIN certs c ON c.opms_employee_id = p.opms_employee_id AND c.competency_name = 'PROMO' GROUP BY 1""")
add("find_not_eligible_workers", lambda t: S.find_not_eligible_workers(t.certs),
    "SELECT first_name, last_name, count(*) AS expired_certs FROM certs WHERE is_expired GROUP BY 1, 2")
add("expiry_forecast", lambda t: S.expiry_forecast(t.certs, 6), """
SELECT substr(expiry_date,1,7) AS month, count(*) AS certs_expiring FROM certs WHERE NOT is_expired AND days_to_expiry BETWEEN 0 AND 180 GROUP BY 1""")
add("compliance_by_group", lambda t: S.compliance_by_group(t.certs),
    "SELECT group_name, count(*) AS total_certs, count(*) FILTER (is_expired) AS expired FROM certs GROUP BY 1")
add("workers_holding_all", lambda t: S.workers_holding_all(t.certs, ["promo", "small"]), """
SELECT first_name, last_name, 2 AS matched FROM certs WHERE NOT is_expired AND competency_name IN ('PROMO','SMALL') GROUP BY 1, 2
HAVING count(DISTINCT competency_name) = 2""")

# --- rosters --------------------------------------------------------------------------------------------------

add("get_roster_summary", lambda t: S.get_roster_summary(t.roster, project="urgent", date_from="1999-01-01", date_to="1999-12-31"), """
SELECT DISTINCT first_name, last_name, roster_date, project_name, position_name FROM roster
WHERE project_name ILIKE '%urgent%' AND roster_date BETWEEN '1999-01-01' AND '1999-12-31'""")
GAPS = """SELECT opms_employee_id, first_name, last_name, position_name FROM profile e WHERE is_active AND NOT EXISTS
  (SELECT 1 FROM roster r WHERE r.opms_employee_id = e.opms_employee_id AND r.roster_date >= '2000-03-03')"""
add("find_roster_gaps", lambda t: S.find_roster_gaps(t.profile, t.roster, AS_OF, 90), GAPS)
RISK = """SELECT DISTINCT r.first_name, r.last_name, r.project_name, t.competency_name, t.expiry_date FROM roster r
  JOIN certs t USING (opms_employee_id) WHERE t.is_expired AND r.roster_date >= '2000-05-02'"""
add("check_roster_risk", lambda t: S.check_roster_risk(t.roster, t.certs, AS_OF, 30), RISK)

# --- time -------------------------------------------------------------------------------------------------------

WEEK = "opms_employee_id, first_name, last_name, position_name, supplier_name, project_name, site_name, work_date, shift_type, roster_hours, gap_hours, actual_hours, hours_source"
add("get_weekly_timesheet", lambda t: S.get_weekly_timesheet(t.weekly, date_from="1999-01-01", date_to="1999-02-28", project="sh-"), f"""
SELECT {WEEK} FROM weekly WHERE work_date BETWEEN '1999-01-01' AND '1999-02-28' AND project_name ILIKE '%sh-%'""")


def _matrix_sql() -> str:
    from datetime import date, timedelta
    days = [date(1999, 3, 1) + timedelta(i) for i in range(7)]
    slots = ", ".join(f"sum(actual_hours) FILTER (work_date = '{d}' AND shift_type = '{s}') AS \"{d:%a %d/%m} {s}\"" for d in days for s in ("DS", "NS"))
    return f"""SELECT position_name, first_name, last_name, site_name, project_name, {slots},
  sum(CASE WHEN shift_type='DS' THEN actual_hours ELSE 0 END) AS total_ds, sum(CASE WHEN shift_type='NS' THEN actual_hours ELSE 0 END) AS total_ns,
  sum(actual_hours) AS total_hours FROM weekly WHERE work_date BETWEEN '1999-03-01' AND '1999-03-07' GROUP BY 1, 2, 3, 4, 5"""


add("weekly_matrix", lambda t: S.weekly_matrix(t.weekly, "1999-03-01", "1999-03-07"), _matrix_sql())
add("weekly_by_worker", lambda t: S.weekly_by_worker(t.weekly, date_from="1999-01-01", date_to="1999-12-31"), """
SELECT opms_employee_id, first_name, last_name, position_name, max(supplier_name) AS supplier_name, count(*) AS days_worked, sum(roster_hours) AS roster_hours,
  sum(gap_hours) AS gap_hours, sum(actual_hours) AS actual_hours FROM weekly WHERE work_date BETWEEN '1999-01-01' AND '1999-12-31' GROUP BY 1, 2, 3, 4""")
add("weekly_by_day", lambda t: S.weekly_by_day(t.weekly, site="transport"), """
SELECT work_date, count(DISTINCT opms_employee_id) AS workers, sum(actual_hours) AS actual_hours FROM weekly WHERE site_name ILIKE '%transport%' GROUP BY 1""")
add("get_worker_hours", lambda t: S.get_worker_hours(t.months, year="1999"), """
SELECT opms_employee_id, first_name, last_name, sum(total_hours) AS total_hours, CAST(sum(entry_count) AS BIGINT) AS entries FROM months
WHERE month LIKE '1999%' GROUP BY 1, 2, 3""")
add("get_site_hours", lambda t: S.get_site_hours(t.months, "site", "1998"), """
SELECT site_name, sum(total_hours) AS total_hours FROM months WHERE month LIKE '1998%' AND site_name ILIKE '%site%' GROUP BY 1""")
add("get_project_hours", lambda t: S.get_project_hours(t.roster),
    "SELECT project_name, sum(hours) AS rostered_hours FROM roster WHERE project_name IS NOT NULL GROUP BY 1")
add("get_timesheet_summary", lambda t: S.get_timesheet_summary(t.months, by="month"),
    "SELECT month, sum(total_hours) AS total_hours, CAST(sum(entry_count) AS BIGINT) AS entries FROM months GROUP BY 1")
add("get_timesheet_summary_by_site", lambda t: S.get_timesheet_summary(t.months, "1999"),
    "SELECT site_name, sum(total_hours) AS total_hours, CAST(sum(entry_count) AS BIGINT) AS entries FROM months WHERE month LIKE '1999%' GROUP BY 1")
add("top_workers_by_hours", lambda t: S.top_workers_by_hours(t.months, "1999", 10), """
SELECT first_name, last_name, sum(total_hours) AS total_hours FROM months WHERE month LIKE '1999%' GROUP BY 1, 2
ORDER BY total_hours DESC, last_name, first_name LIMIT 10""")

# --- projects ------------------------------------------------------------------------------------------------------

BRIDGE = "job_code, job_title, project_name, client_code, client_name, opms_project_name, source"
add("resolve_project_client", lambda t: S.resolve_project_client(t.bridge, "asia"), f"""
SELECT {BRIDGE} FROM bridge WHERE job_code ILIKE '%asia%' OR job_title ILIKE '%asia%' OR project_name ILIKE '%asia%' OR client_code ILIKE '%asia%'
  OR client_name ILIKE '%asia%' OR opms_project_name ILIKE '%asia%'""")
add("get_active_projects", lambda t: S.get_active_projects(t.project_jobs, "a"), """
SELECT project_name, client_name, job_count, active_job_count, project_start_date FROM project_jobs WHERE is_active AND client_name ILIKE '%a%'""")
add("get_project_jobs", lambda t: S.get_project_jobs(t.project_jobs, project="NATION_1"), """
SELECT project_name, client_name, job_count, active_job_count FROM project_jobs WHERE contains(lower(project_name), 'nation_1')""")
add("project_job_totals", lambda t: S.project_job_totals(t.project_jobs), """
SELECT count(*) AS projects, CAST(coalesce(sum(job_count),0) AS BIGINT) AS jobs, CAST(coalesce(sum(active_job_count),0) AS BIGINT) AS active_jobs FROM project_jobs""")
JOBS = "job_code, job_title, job_status, project_name, client_name, work_location_name, lead_first_name, lead_last_name, is_active"
add("get_job_detail", lambda t: S.get_job_detail(t.job_details, client="america"), f"SELECT {JOBS} FROM job_details WHERE client_name ILIKE '%america%'")
add("get_site_assignments", lambda t: S.get_site_assignments(t.assignments, "site 3"), """
SELECT DISTINCT first_name, last_name, position_name, site_name, team_name FROM assignments WHERE site_name ILIKE '%site 3%'""")

# --- assets and stock -------------------------------------------------------------------------------------------------

ASSET = "asset_id, asset_name, status, model, manufacturer_name, location_name, asset_group_name"
add("search_assets", lambda t: S.search_assets(t.assets, "ring", "promo"), f"""
SELECT {ASSET} FROM assets WHERE (asset_name ILIKE '%ring%' OR asset_id ILIKE '%ring%' OR model ILIKE '%ring%') AND status ILIKE '%promo%'""")
add("assets_by_status", lambda t: S.assets_by_status(t.assets), "SELECT status, count(*) AS asset_count FROM assets GROUP BY 1")
add("get_inventory_summary", lambda t: S.get_inventory_summary(t.stock, "bolt", "nation"), """
SELECT item_name, stock, location_name, category_name FROM stock WHERE item_name ILIKE '%bolt%' AND location_name ILIKE '%nation%'""")
add("find_low_stock", lambda t: S.find_low_stock(t.stock, 5), "SELECT item_name, stock, location_name FROM stock WHERE stock IS NULL OR stock <= 5")
add("get_ppe_signouts", lambda t: S.get_ppe_signouts(t.ledger, item="ring"), """
SELECT txn_date, item_name, units, from_location, person_name, job_code, project_name, bms_txn_id FROM ledger
WHERE txn_kind = 'sign_out' AND (item_name ILIKE '%ring%' OR item_code ILIKE '%ring%') """)
add("get_ppe_monthly_usage", lambda t: S.get_ppe_monthly_usage(t.ledger, months=6), """
SELECT txn_month, sum(units) AS total_units, count(*) AS sign_out_lines, count(DISTINCT person_name) AS distinct_people FROM ledger
WHERE txn_kind = 'sign_out' GROUP BY 1 ORDER BY txn_month DESC LIMIT 6""")
add("hardware_stock", lambda t: S.hardware_stock(t.hardware, "brand#1"), """
SELECT p_name AS hardware_name, p_brand AS code, p_type AS status, p_size AS in_stock, s.title AS category_name FROM part
LEFT JOIN sections s ON s.id = p_partkey % 5 WHERE p_brand ILIKE '%brand#1%'""")

# --- money -----------------------------------------------------------------------------------------------------------------

add("get_purchase_summary", lambda t: S.get_purchase_summary(t.purchases, "Finance"), """
SELECT supplier_name, count(*) AS purchase_count, CAST(sum(line_count) AS BIGINT) AS total_lines, sum(computed_total) AS total_spend FROM purchases GROUP BY 1""")
add("get_purchase_summary_default_role", lambda t: S.get_purchase_summary(t.purchases, "default"), """
SELECT supplier_name, count(*) AS purchase_count, CAST(sum(line_count) AS BIGINT) AS total_lines FROM purchases GROUP BY 1""")
add("get_client_revenue", lambda t: _r2(S.get_client_revenue(t.revenue, "Finance", year="1999"), "invoiced", "paid", "outstanding"), """
SELECT contact_name, CAST(sum(invoices) AS BIGINT) AS invoices, round(sum(invoiced),2) AS invoiced, round(sum(paid),2) AS paid, round(sum(outstanding),2) AS outstanding
FROM revenue WHERE month LIKE '1999%' GROUP BY 1""")
add("get_outstanding_invoices", lambda t: S.get_outstanding_invoices(t.invoices, "Finance", "client 1"), """
SELECT invoice_number, contact_name, job_code, invoice_date, due_date, total, amount_due FROM invoices
WHERE invoice_type = 'ACCREC' AND status = 'AUTHORISED' AND amount_due > 0 AND contact_name ILIKE '%client 1%'""")
add("get_project_revenue", lambda t: _r2(S.get_project_revenue(t.invoices, "Finance"), "invoiced", "outstanding"), """
SELECT job_code, contact_name, count(*) AS invoices, round(sum(total),2) AS invoiced, round(sum(amount_due),2) AS outstanding FROM invoices
WHERE invoice_type = 'ACCREC' AND job_code IS NOT NULL AND status IN ('AUTHORISED','PAID') GROUP BY 1, 2""")
add("get_rate_card", lambda t: S.get_rate_card(t.rates, "Finance", "nation_2"), """
SELECT rate_title, project_name, day_shift_rate, night_shift_rate FROM rates WHERE contains(lower(project_name),'nation_2')""")
add("get_rate_card_default_role", lambda t: S.get_rate_card(t.rates), "SELECT rate_title, project_name, project_code FROM rates")


def _r2(df, *names):
    return df.withColumns({n: F.round(n, 2) for n in names})


# --- safety and audit -----------------------------------------------------------------------------------------------------------

HSEQ = "issue_title, issue_type, issue_status, action_priority, action_due_date, is_open, is_overdue"
add("get_hseq_register", lambda t: S.get_hseq_register(t.actions, overdue_only=True, priority="urgent"),
    f"SELECT {HSEQ} FROM actions WHERE is_overdue AND action_priority ILIKE '%urgent%'")
add("get_audit_issues", lambda t: S.get_audit_issues(t.audit, event_type="error"), """
SELECT created_at, event_type, first_name, last_name, change_log_id FROM audit WHERE event_type ILIKE '%error%' """)
add("audit_event_breakdown", lambda t: S.audit_event_breakdown(t.audit), "SELECT event_type, count(*) AS events FROM audit GROUP BY 1")

# --- across domains ---------------------------------------------------------------------------------------------------------------

DEPLOY = """SELECT opms_employee_id, first_name, last_name, position_name, supplier_name FROM profile e WHERE is_active
  AND (position_name ILIKE '%ring%' OR position_name ILIKE '%bolt%')
  AND NOT EXISTS (SELECT 1 FROM certs t WHERE t.opms_employee_id = e.opms_employee_id AND t.is_expired)
  AND NOT EXISTS (SELECT 1 FROM roster r WHERE r.opms_employee_id = e.opms_employee_id AND r.roster_date >= '2000-06-01')"""
add("find_deployable_workers", lambda t: S.find_deployable_workers(t.profile, t.certs, t.roster, AS_OF, FIELD_TRADES), DEPLOY)
add("site_compliance_report", lambda t: S.site_compliance_report(t.assignments, t.certs, "site 3"), """
SELECT s.site_name, s.first_name, s.last_name, s.position_name, count(*) AS expired_certs FROM assignments s JOIN certs t USING (opms_employee_id)
WHERE s.site_name ILIKE '%site 3%' AND t.is_expired GROUP BY 1, 2, 3, 4""")
SUPPLIER_RISK = """SELECT e.supplier_name, count(DISTINCT e.opms_employee_id) AS workers_with_expired, count(*) AS expired_certs FROM profile e
  JOIN certs t USING (opms_employee_id) WHERE t.is_expired AND e.supplier_name IS NOT NULL GROUP BY 1"""
add("supplier_compliance_risk", lambda t: S.supplier_compliance_risk(t.profile, t.certs), SUPPLIER_RISK)


def _w360(t: Tables):
    out = S.worker_360(t.profile, t.certs, t.roster, t.months, t.licences)
    recent = F.array_join(F.transform("recent_roster", lambda r: F.concat_ws("|", r["roster_date"], r["project_name"], r["position_name"])), ";")
    return out.withColumn("recent_roster", recent).withColumn("licence_list", F.array_join("licence_list", "|"))


add("worker_360", _w360, """
SELECT p.opms_employee_id, p.first_name, p.last_name, p.position_name, p.supplier_name, p.is_active, p.email_work, coalesce(c.expired,0) AS expired,
  coalesce(c.valid,0) AS valid, coalesce(c.expiring_90d,0) AS expiring_90d, r.recent_roster, coalesce(h.total_hours,0) AS total_hours, coalesce(l.n,0) AS licences, l.licence_list
FROM profile p
LEFT JOIN (SELECT opms_employee_id, count(*) FILTER (is_expired) AS expired, count(*) FILTER (NOT is_expired) AS valid, count(*) FILTER (is_expiring_soon) AS expiring_90d
  FROM certs GROUP BY 1) c USING (opms_employee_id)
LEFT JOIN (SELECT opms_employee_id, string_agg(concat_ws('|', roster_date, project_name, position_name), ';' ORDER BY n) AS recent_roster FROM (
  SELECT *, row_number() OVER (PARTITION BY opms_employee_id ORDER BY roster_date DESC, project_name, position_name) AS n FROM roster) WHERE n <= 5 GROUP BY 1) r USING (opms_employee_id)
LEFT JOIN (SELECT opms_employee_id, sum(total_hours) AS total_hours FROM months GROUP BY 1) h USING (opms_employee_id)
LEFT JOIN (SELECT opms_employee_id, count(*) AS n, string_agg(licence, '|' ORDER BY licence) AS licence_list FROM licences GROUP BY 1) l USING (opms_employee_id)""")

# --- files and forms -----------------------------------------------------------------------------------------------------------------

FILE = "site, library, file_name, folder_path, ext, size_kb, strftime(modified_at,'%Y-%m-%d %H:%M:%S') AS modified_at, modified_by, web_url"


def _ts(df):
    return df.withColumn("modified_at", F.col("modified_at").cast("string"))


add("find_files", lambda t: _ts(S.find_files(t.files, "en HTML", library="com")), f"""
SELECT {FILE} FROM files WHERE (file_name ILIKE '%en%' OR folder_path ILIKE '%en%') AND (file_name ILIKE '%html%' OR folder_path ILIKE '%html%')
  AND library ILIKE '%com%' """)
add("list_folder", lambda t: _ts(S.list_folder(t.files, "fr/")), f"""
SELECT {FILE} FROM files WHERE folder_path ILIKE '%fr/%' """)


def _form(t: Tables):
    d = t.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("Title"), "lang", "source",
                                  F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("Modified"))
    return auto_tables({"FDS-Daily Sheets": d})["fds_daily_sheets"]


add("search_form", lambda t: S.search_form(_form(t), "src1"), """
SELECT doc_id AS id, text AS "Title", lang, source, lpad(CAST(doc_id AS VARCHAR),12,'0') AS "Modified" FROM documents
WHERE lower(text) LIKE '%src1%' OR lang LIKE '%src1%' OR source LIKE '%src1%'""")
add("job_runs", lambda t: S.job_runs(t.runs, limit=3)[0].select("automation", "run_id", "conclusion"), """
SELECT automation, run_id, conclusion FROM runs QUALIFY row_number() OVER (PARTITION BY automation ORDER BY updated_at DESC, run_id DESC) <= 3""")
add("job_runs_failed", lambda t: S.job_runs(t.runs, limit=3)[1].select("automation", "run_id", "conclusion"), """
SELECT * FROM (SELECT automation, run_id, conclusion FROM runs QUALIFY row_number() OVER (PARTITION BY automation ORDER BY updated_at DESC, run_id DESC) <= 3)
WHERE conclusion <> 'success'""")

# --- reports --------------------------------------------------------------------------------------------------------------------------------

add("workforce_risk_report", lambda t: S.workforce_risk_report(t.roster, t.certs, t.profile, AS_OF), f"""
SELECT c AS combinations, s AS worst_supplier, m AS worst_supplier_certs, i AS idle_workers, d AS due_90d,
  CASE WHEN c > 50 THEN 'HIGH' WHEN c > 10 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT (SELECT count(*) FROM ({RISK})) AS c,
  (SELECT supplier_name FROM ({SUPPLIER_RISK}) ORDER BY expired_certs DESC, supplier_name DESC LIMIT 1) AS s, (SELECT max(expired_certs) FROM ({SUPPLIER_RISK})) AS m,
  (SELECT count(*) FROM ({GAPS})) AS i, (SELECT count(*) FROM certs WHERE NOT is_expired AND days_to_expiry BETWEEN 0 AND 90) AS d)""")
add("workforce_report", lambda t: S.workforce_report(t.profile, t.certs, t.roster, suppliers(t), AS_OF, FIELD_TRADES), f"""
SELECT (SELECT count(*) FROM profile WHERE is_active) AS active_workers, (SELECT count(*) FROM certs WHERE is_expired) AS expired_certs,
  (SELECT count(*) FROM certs WHERE NOT is_expired AND days_to_expiry BETWEEN 0 AND 30) AS expiring_30d, (SELECT count(*) FROM ({DEPLOY})) AS deployable,
  (SELECT count(*) FROM ({GAPS})) AS bench, (SELECT count(*) FROM {SUPPLIERS} WHERE is_active) AS active_suppliers,
  (SELECT supplier_name FROM {SUPPLIERS} WHERE is_active ORDER BY worker_count DESC, supplier_name DESC LIMIT 1) AS largest_supplier""")
add("site_readiness", lambda t: S.site_readiness(t.assignments, t.certs), """
SELECT site_name, count(*) AS crew, count(*) FILTER (n > 0) AS crew_with_expired, CASE WHEN count(*) FILTER (n > 0) > 0 THEN 'AT RISK' ELSE 'READY' END AS verdict
FROM assignments LEFT JOIN (SELECT opms_employee_id, count(*) AS n FROM certs WHERE is_expired GROUP BY 1) USING (opms_employee_id) GROUP BY 1""")
add("result_meta", lambda t: S.result_meta(S.get_project_hours(t.roster), ["roster_summary"], approx=True), """
SELECT count(DISTINCT project_name) AS row_count, 'Medium' AS confidence, 'Two roster feeds are combined.' AS caveats FROM roster""")

# --- dashboard --------------------------------------------------------------------------------------------------------------------------------


def _drill(t: Tables):
    j = t.job_details.select(F.col("client_name").alias("client"), F.col("project_name").alias("project"), F.col("job_status").alias("status"))
    return A.drill_counts(j, A.DRILL_PATHS["client"])


add("drill_counts", _drill, """
SELECT client_name AS client, project_name AS project, job_status AS status, count(*) AS jobs,
  CASE GROUPING(client_name, project_name, job_status) WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS level
FROM job_details GROUP BY ROLLUP (client_name, project_name, job_status) HAVING GROUPING(client_name, project_name, job_status) < 7""")


def _cross(t: Tables):
    ids = A.selected_workers(t.profile, t.roster, t.weekly, ["NATION_3", "NATION_4"], ["SH-25007 - 1-URGENT", "SH-25008 - 2-HIGH", "Yard 1"])
    return A.cross_filter(t.certs, ids).select("training_record_id", "opms_employee_id", "is_expired")


add("cross_filter", _cross, """
SELECT training_record_id, opms_employee_id, is_expired FROM certs WHERE opms_employee_id IN (SELECT opms_employee_id FROM profile WHERE supplier_name IN ('NATION_3','NATION_4'))
AND opms_employee_id IN (SELECT opms_employee_id FROM roster WHERE project_name IN ('SH-25007 - 1-URGENT','SH-25008 - 2-HIGH','Yard 1')
  UNION ALL SELECT opms_employee_id FROM weekly WHERE project_name IN ('SH-25007 - 1-URGENT','SH-25008 - 2-HIGH','Yard 1'))""")
add("at_risk_by_project", lambda t: A.at_risk_by_project(t.roster, t.certs, "2000-03-01", "2000-12-01"), """
SELECT project_name, count(DISTINCT opms_employee_id) AS at_risk_workers FROM roster WHERE roster_date BETWEEN '2000-03-01' AND '2000-12-01'
AND opms_employee_id IN (SELECT opms_employee_id FROM certs WHERE is_expired) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
add("certs_expiring_by_month", lambda t: A.certs_expiring_by_month(t.certs, "2000-03-03", "2000-12-01"), """
SELECT substr(expiry_date,1,7) AS month, count(*) AS certs_expiring FROM certs WHERE expiry_date BETWEEN '2000-03-03' AND '2000-12-01' GROUP BY 1""")
add("workforce_by_supplier", lambda t: A.workforce_by_supplier(t.profile, 10), """
SELECT supplier_name, count(*) AS workers FROM profile WHERE is_active AND supplier_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
add("drill_through", lambda t: A.drill_through(t.profile, t.certs, t.roster, project="SH-25007 - 1-URGENT"), """
SELECT r.first_name, r.last_name, p.supplier_name, r.project_name, r.position_name, r.roster_date, r.hours FROM roster r LEFT JOIN profile p USING (opms_employee_id)
WHERE r.project_name = 'SH-25007 - 1-URGENT' AND r.opms_employee_id IN (SELECT opms_employee_id FROM certs WHERE is_expired)""")
add("drill_through_supplier", lambda t: A.drill_through(t.profile, t.certs, t.roster, supplier="NATION_3"), """
SELECT c.first_name, c.last_name, p.supplier_name, c.competency_name, c.status, c.expiry_date, CAST(c.days_to_expiry AS INTEGER) AS days_to_expiry FROM certs c
LEFT JOIN profile p USING (opms_employee_id) WHERE c.is_expired AND p.supplier_name = 'NATION_3'""")
add("weekly_hours_in_range", lambda t: A.weekly_hours_in_range(t.weekly, "1999-01-01", "1999-12-31"), """
SELECT strftime(date_trunc('week', CAST(work_date AS DATE)),'%Y-%m-%d') AS week, round(sum(actual_hours),2) AS actual_hours FROM weekly
WHERE work_date BETWEEN '1999-01-01' AND '1999-12-31' GROUP BY 1""")
add("project_pipeline", lambda t: A.project_pipeline(t.project_jobs, t.job_details), """
SELECT count(DISTINCT project_name) AS projects_with_jobs, count(*) AS jobs, count(*) FILTER (job_status ILIKE '%progress%') AS in_progress,
  count(*) FILTER (NOT regexp_matches(job_status,'(?i)COMPLETE|Cancel|Unsucces')) AS open_jobs FROM job_details""")
add("column_profile", lambda t: A.column_profile(t.raw("customer")), """
SELECT 'c_custkey' AS "column", 'bigint' AS type, count(*) AS rows, count(*) FILTER (c_custkey IS NULL) AS nulls, CAST(min(c_custkey) AS DOUBLE) AS min, CAST(max(c_custkey) AS DOUBLE) AS max,
  round(avg(c_custkey),2) AS mean, round(stddev_samp(c_custkey),2) AS std FROM customer
UNION ALL SELECT 'c_name', 'string', count(*), 0, NULL, NULL, NULL, NULL FROM customer
UNION ALL SELECT 'c_nationkey', 'int', count(*), 0, min(c_nationkey), max(c_nationkey), round(avg(c_nationkey),2), round(stddev_samp(c_nationkey),2) FROM customer
UNION ALL SELECT 'c_acctbal', 'double', count(*), 0, min(c_acctbal), max(c_acctbal), round(avg(c_acctbal),2), round(stddev_samp(c_acctbal),2) FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', count(*), 0, NULL, NULL, NULL, NULL FROM customer""")

# --- KPIs ------------------------------------------------------------------------------------------------------------------------------------------

KPI_SQL = f"""SELECT (SELECT count(*) FROM (SELECT DISTINCT opms_employee_id, competency_name FROM certs WHERE is_expired AND opms_employee_id IN
    (SELECT opms_employee_id FROM roster WHERE roster_date >= '2000-05-02'))) AS workforce_risk,
  (SELECT count(*) FROM certs WHERE NOT is_expired AND days_to_expiry BETWEEN 0 AND 30) AS expiring_30d, (SELECT count(*) FROM certs WHERE is_expired) AS expired_total,
  (SELECT count(*) FROM ({GAPS})) AS idle_pool, (SELECT count(*) FROM project_jobs WHERE is_active) AS active_projects, (SELECT count(*) FROM ({DEPLOY})) AS deployable"""
add("kpis", lambda t: A.kpis(t.profile, t.certs, t.roster, t.project_jobs, AS_OF, FIELD_TRADES), KPI_SQL)
add("business_exposure", lambda t: A.business_exposure(t.certs, t.roster, AS_OF), """
SELECT (SELECT count(DISTINCT opms_employee_id) FROM certs WHERE is_expired AND is_active) AS workers_at_risk, count(DISTINCT opms_employee_id) AS at_risk_rostered,
  count(DISTINCT project_name) AS jobs_exposed FROM roster WHERE roster_date >= '2000-06-01' AND opms_employee_id IN (SELECT opms_employee_id FROM certs WHERE is_expired)""")
add("supplier_risk", lambda t: A.supplier_risk(t.profile, t.certs, 8), SUPPLIER_RISK + " ORDER BY expired_certs DESC, supplier_name LIMIT 8")
add("risk_by_project", lambda t: A.risk_by_project(t.roster, t.certs, AS_OF), """
SELECT project_name, count(DISTINCT opms_employee_id) AS at_risk_workers FROM roster WHERE roster_date >= '2000-03-03' AND project_name IS NOT NULL
AND opms_employee_id IN (SELECT opms_employee_id FROM certs WHERE is_expired) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
add("expiry_ladder", lambda t: A.expiry_ladder(t.certs), """
SELECT count(*) FILTER (days_to_expiry BETWEEN 0 AND 7) AS expiring_7d, count(*) FILTER (days_to_expiry BETWEEN 0 AND 30) AS expiring_30d,
  count(*) FILTER (days_to_expiry BETWEEN 0 AND 90) AS expiring_90d FROM certs WHERE NOT is_expired""")
add("urgent_expiries", lambda t: A.urgent_expiries(t.certs), """
SELECT first_name, last_name, competency_name, expiry_date, CAST(days_to_expiry AS INTEGER) AS days_to_expiry FROM certs WHERE NOT is_expired AND days_to_expiry BETWEEN 0 AND 7
ORDER BY days_to_expiry, last_name, first_name, competency_name LIMIT 12""")
add("expiry_forecast_31_day_months", lambda t: S.expiry_forecast(t.certs, 6, 31), """
SELECT substr(expiry_date,1,7) AS month, count(*) AS certs_expiring FROM certs WHERE NOT is_expired AND days_to_expiry BETWEEN 0 AND 186 GROUP BY 1""")
WEEKLY = """SELECT strftime(date_trunc('week', CAST(work_date AS DATE)),'%Y-%m-%d') AS week_start, round(sum(actual_hours),2) AS actual_hours,
  count(DISTINCT opms_employee_id) AS workers FROM weekly WHERE work_date >= '{}' GROUP BY 1"""
add("weekly_hours", lambda t: A.weekly_hours(t.weekly, AS_OF, 10), WEEKLY.format("2000-03-23"))
add("week_on_week", lambda t: A.week_on_week(t.weekly, AS_OF, 4), f"""
SELECT l AS hours_last, p AS hours_prev, round(100.0*(l-p)/p,2) AS hours_wow_change_pct FROM (SELECT arg_max(actual_hours, week_start) AS l, arg_min(actual_hours, week_start) AS p FROM (
SELECT * FROM ({WEEKLY.format('2000-05-04')}) WHERE week_start < '2000-05-29' ORDER BY week_start DESC LIMIT 2))""")


def metrics(t: Tables):
    return A.long_metrics(A.kpis(t.profile, t.certs, t.roster, t.project_jobs, AS_OF, FIELD_TRADES))


add("alerts", lambda t: A.alerts(metrics(t), A.rules_table(t.spark)), f"""
WITH k AS ({KPI_SQL}), m AS (SELECT 'workforce_risk' AS metric, workforce_risk AS v, 'workforce_risk_high' AS rule, 'red' AS severity, 0 AS severity_rank, workforce_risk >= 50 AS hit FROM k
UNION ALL SELECT 'deployable', deployable, 'deployable_pool_thin', 'amber', 1, deployable <= 10 FROM k)
SELECT rule, severity, severity_rank, metric, CAST(v AS VARCHAR) AS value, CASE rule WHEN 'workforce_risk_high' THEN
  'Rostered since 30 days ago with an expired certificate: '||v||' pairs of worker and certificate.' ELSE 'Field workers ready to deploy: '||v||'.' END AS message,
  CASE rule WHEN 'workforce_risk_high' THEN 'Open compliance review: re-validate certs for rostered workers first' ELSE 'Start recruitment or free up bench workers' END AS action FROM m WHERE hit""")
ADVICE = {"workforce_risk": "{value} rostered workers with expired certificates", "idle_pool": "{value} idle workers", "broken_links": "{value} broken links", "missing_links": "{value} missing links"}


def _advice(t: Tables):
    links = t.links.agg(F.count_if(F.col("status") == "broken").alias("broken_links"), F.count_if(F.col("status") == "missing").alias("missing_links"))
    return A.recommendations(S.beside(A.kpis(t.profile, t.certs, t.roster, t.project_jobs, AS_OF, FIELD_TRADES), links), ADVICE)


add("recommendations", _advice, f"""
WITH k AS ({KPI_SQL}), m AS (SELECT 'workforce_risk' AS metric, workforce_risk AS v, ' rostered workers with expired certificates' AS said FROM k UNION ALL SELECT 'idle_pool', idle_pool, ' idle workers' FROM k
UNION ALL SELECT 'broken_links', count(*) FILTER (status = 'broken'), ' broken links' FROM links UNION ALL SELECT 'missing_links', count(*) FILTER (status = 'missing'), ' missing links' FROM links)
SELECT metric, CAST(v AS VARCHAR) AS value, v||said AS text FROM m WHERE v > 0""")


def snapshots(t: Tables):
    days = t.raw("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(
        F.count("*").cast("double").alias("orders"), F.count_if(F.col("o_totalprice") > 250000).cast("double").alias("large"))
    return days.unpivot(["date"], ["orders", "large"], "metric", "value")


add("trend_deltas", lambda t: A.trend_deltas(snapshots(t)), """
WITH s AS (SELECT strftime(o_orderdate,'%Y-%m-%d') AS date, CAST(count(*) AS DOUBLE) AS orders, CAST(count(*) FILTER (o_totalprice > 250000) AS DOUBLE) AS large FROM orders GROUP BY 1),
u AS (SELECT date, 'orders' AS metric, orders AS value FROM s UNION ALL SELECT date, 'large', large FROM s),
w AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY date) AS prev, count(*) OVER b AS n, avg(value) OVER b AS mean, stddev_pop(value) OVER b AS sd FROM u
  WINDOW b AS (PARTITION BY metric ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT date, metric, value, prev, value - prev AS delta, coalesce(n >= 7 AND sd > 0 AND abs(value - mean) > 2*sd, FALSE) AS anomaly FROM w WHERE prev IS NOT NULL""")


def _snap(t: Tables):
    days = t.raw("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("orders"))
    return A.snapshot_upsert(days, days.filter("date >= '2001-01-01'").withColumn("orders", F.col("orders") + 100))


add("snapshot_upsert", _snap, """
SELECT strftime(o_orderdate,'%Y-%m-%d') AS date, count(*) + CASE WHEN o_orderdate >= DATE '2001-01-01' THEN 100 ELSE 0 END AS orders FROM orders GROUP BY o_orderdate""")

