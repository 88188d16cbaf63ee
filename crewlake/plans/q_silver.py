"""Queries for sources, expressions, dimensions, facts and reconciliation (S, E, D, G3-G10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewlake.functions import costs, phrases
from crewlake.functions import scalars as E
from crewlake.operators import reconcile as R
from crewlake.operators import silver as D
from crewlake.plans.registry import add
from crewlake.plans.stand_in import AS_OF, Tables
from crewlake.sources import bronze, files, flatten

# --- sources -------------------------------------------------------------------------------------

add("capped_chunks", lambda t: bronze.capped_chunks(t.raw("lineitem"), ["l_suppkey", "l_linenumber"], 80),
    "SELECT l_suppkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 80")


def _manifest(t: Tables):
    landed = t.raw("documents").select(F.col("source").alias("name"))
    expected = t.raw("region").select(
        F.concat(F.lit("src"), (F.col("r_regionkey") * 5).cast("string")).alias("name"),
        (F.col("r_regionkey") == 1).alias("schema_only"), F.when(F.col("r_regionkey") == 2, "timeout").alias("error"))
    return bronze.landing_manifest(landed, expected)


add("landing_manifest", _manifest, """
SELECT 'src'||(r_regionkey*5) AS name, r_regionkey = 1 AS schema_only, CASE WHEN r_regionkey = 2 THEN 'timeout' END AS error,
  CASE WHEN r_regionkey IN (1, 2) THEN 0 ELSE (SELECT count(*) FROM documents d WHERE d.source = 'src'||(r_regionkey*5)) END AS rows
FROM region""")

add("sensitive_exclude", lambda t: bronze.sensitive_exclude(t.raw("events").select(
    F.when(F.col("event_type") == "error", "SYS-FlowErrorLog").when(F.col("event_type") == "view", "PPL-PayrollDeductions")
    .otherwise(F.col("event_type")).alias("name"))).groupBy("name", "schema_only").agg(F.count("*").alias("rows")), """
SELECT CASE WHEN event_type = 'view' THEN 'PPL-PayrollDeductions' ELSE event_type END AS name, event_type = 'view' AS schema_only,
  count(*) AS rows FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")


def _flat(t: Tables):
    nested = t.raw("events").select(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("name"))
                                    .alias("kind")).alias("employee"), F.array("event_type").alias("tags"))
    return flatten.flatten_mirror(nested)


add("flatten_mirror", _flat, """
SELECT event_id AS id, user_id AS "employee.id", '{"name":"'||event_type||'"}' AS "employee.kind", '["'||event_type||'"]' AS tags FROM events""")

add("flatten_heavy", lambda t: flatten.flatten_heavy(t.raw("documents"), ["text"]),
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(n_chars AS VARCHAR) AS n_chars, source FROM documents")


def _auto(t: Tables):
    form = t.raw("documents").select(F.col("doc_id").alias("id"), F.struct("lang", "source").alias("Data"), F.lit("x").alias("Edit"))
    return flatten.auto_tables({"FDS-Daily Sheets!": form})["fds_daily_sheets"]


add("auto_tables", _auto, """SELECT doc_id AS id, '{"lang":"'||lang||'","source":"'||source||'"}' AS "Data" FROM documents""")
add("pick", lambda t: flatten.pick(t.raw("supplier"), {"s_suppkey": "id", "s_name": "name", "no_such": "gone"}),
    "SELECT s_suppkey AS id, s_name AS name FROM supplier")
add("file_facts", lambda t: files.file_facts(t.file_items).drop("_pos"), """
SELECT nullif(regexp_extract(url,'^https?://([^/]+)/',1),'') AS site, regexp_extract(regexp_extract(url,'^https?://([^/]+)/',1),'([^.]+)$',1) AS library,
  regexp_extract(url,'([^/]*)$',1)||'.HTML' AS file_name, 'html' AS ext,
  regexp_replace(regexp_extract(url,'^https?://[^/]+/(.*?)[^/]*$',1),'^/+','') AS folder_path, round(length(html)/1024.0,1) AS size_kb, url AS web_url,
  strftime(DATE '2000-01-01' + CAST(page_id AS INTEGER), '%Y-%m-%dT01:02:03Z') AS modified_at, 'u'||(page_id % 7) AS modified_by
FROM pages WHERE length(html) > 1000""")
add("file_index", lambda t: t.files.withColumn("modified_at", F.col("modified_at").cast("string")),
    "SELECT * REPLACE (strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified_at) FROM files")
add("table_version", lambda t: files.table_version(t.raw("orders")).select("files", F.col("version").isNotNull().alias("known")),
    "SELECT CAST(1 AS BIGINT) AS files, count(*) > 0 AS known FROM orders")

# --- expressions ----------------------------------------------------------------------------------

SPELLINGS = "concat(CASE event_type WHEN 'click' THEN ' ' ELSE '' END, user_id, CASE event_type WHEN 'view' THEN '.0' WHEN 'error' THEN 'x' ELSE '' END)"


def _ids(t: Tables):
    e = t.raw("events").select("event_id", F.expr(SPELLINGS).alias("v"))
    big = F.concat(F.lit("900719925474"), F.lpad(F.col("event_id").cast("string"), 7, "0"))
    return e.select("event_id", E.to_int("v").alias("to_int"), E.norm_id("v").alias("norm_id"), E.lookup_key("v").alias("lookup_key"),
                    E.to_int(F.col("event_id").cast("double")).alias("of_double"), E.norm_id(big).alias("big_id"),
                    E.lookup_key(F.concat(big, F.lit(".0"))).alias("big_key"))


add("id_spellings", _ids, """
SELECT event_id, CASE WHEN event_type NOT IN ('view','error') THEN user_id END AS to_int,
  CASE WHEN event_type = 'error' THEN user_id||'x' ELSE CAST(user_id AS VARCHAR) END AS norm_id,
  CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS lookup_key, event_id AS of_double,
  '900719925474'||lpad(CAST(event_id AS VARCHAR),7,'0') AS big_id, '900719925474'||lpad(CAST(event_id AS VARCHAR),7,'0') AS big_key FROM events""")


def _dates(t: Tables):
    e = t.raw("events")
    kind = F.col("event_type")
    v = (F.when(kind == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == "view", F.date_format("ts", "d/M/yyyy"))
         .when(kind == "error", F.lit("junk")).when(kind == "signup", F.lit("nan")).otherwise(F.date_format("ts", "yyyy-MM-dd")))
    return e.select("event_id", F.date_format(E.local_ts(v), "yyyy-MM-dd HH:mm:ss").alias("local"), E.month_of(E.local_date(v)).alias("month"))


add("local_ts", _dates, """
SELECT event_id, strftime(l, '%Y-%m-%d %H:%M:%S') AS local, strftime(l, '%Y-%m') AS month FROM (
SELECT event_id, CASE WHEN event_type = 'click' THEN date_trunc('second', ts) + INTERVAL 8 HOUR WHEN event_type IN ('view','purchase')
  THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END AS l FROM events)""")


def _codes(t: Tables):
    i = t.raw("orders").select("o_orderkey", F.expr("concat(CASE WHEN o_orderpriority='2-HIGH' THEN 'po-' WHEN o_orderpriority='1-URGENT' THEN ' ab-' "
                                                     "ELSE 'WXYZ-' END, o_orderkey, ' text')").alias("ref"), F.col("o_orderkey").cast("string").alias("k"))
    return i.select("o_orderkey", E.job_prefix("ref").alias("prefix"), E.invoice_job_code("ref").alias("job_code"), E.normalise_job_id("k").alias("job_id"),
                    E.truthy(F.when(F.col("o_orderkey") % 2 == 0, " Yes".strip()).otherwise("no")).alias("flag"))


add("job_codes", _codes, """
SELECT o_orderkey, p AS prefix, CASE WHEN p NOT LIKE 'PO-%' THEN p END AS job_code, 'SH-'||o_orderkey AS job_id, o_orderkey % 2 = 0 AS flag FROM (
SELECT o_orderkey, CASE WHEN o_orderkey >= 1000 THEN CASE o_orderpriority WHEN '2-HIGH' THEN 'PO-' WHEN '1-URGENT' THEN 'AB-' ELSE 'WXYZ-' END
  ||substr(CAST(o_orderkey AS VARCHAR),1,6) END AS p FROM orders)""")
add("norm_name", lambda t: t.raw("pages").select("page_id", E.norm_name("url").alias("norm")), """
SELECT page_id, regexp_replace(replace(lower(url),'&',' and '),'[^a-z0-9一-鿿]','','g') AS norm FROM pages""")


def _cells(t: Tables):
    rows = t.link_rows.select("jobid", F.explode(F.array("quote_link", "contract_link", "photo_link")).alias("cell"))
    p = E.link_cell("cell")
    return rows.select("jobid", *[p[k].alias(k) for k in ("head", "item_id", "url")])


add("link_cell", _cells, """
SELECT page_id AS jobid, 'IMS/Ops:'||page_id AS head, page_id AS item_id, url FROM pages
UNION ALL SELECT page_id, CASE WHEN length(html)>4000 THEN 'IMS/Ops:'||page_id END, CASE WHEN length(html)>4000 THEN page_id END,
  CASE WHEN length(html)>4000 THEN url||'-old' END FROM pages
UNION ALL SELECT page_id, CASE WHEN length(html)>3000 THEN 'IMS/Ops' END, NULL, CASE WHEN length(html)>3000 THEN url||'/gone' END FROM pages""")


def _expiry(t: Tables):
    li = t.raw("lineitem").select("l_shipdate", "l_quantity").withColumn("d", F.when(F.col("l_quantity") > 2, F.date_format("l_shipdate", "yyyy-MM-dd")))
    f = E.expiry_flags("d", AS_OF)
    return li.select(*[v.alias(k) for k, v in f.items()]).groupBy("is_expired", "is_expiring_soon").agg(
        F.count("*").alias("n"), F.min("days_to_expiry").alias("lo"), F.max("days_to_expiry").alias("hi"))


add("expiry_flags", _expiry, """
SELECT coalesce(d < 0, FALSE) AS is_expired, coalesce(d BETWEEN 0 AND 90, FALSE) AS is_expiring_soon, count(*) AS n,
  CAST(min(d) AS INTEGER) AS lo, CAST(max(d) AS INTEGER) AS hi FROM (
SELECT CASE WHEN l_quantity > 2 THEN date_diff('day', DATE '2000-06-01', CAST(l_shipdate AS DATE)) END AS d FROM lineitem) GROUP BY 1, 2""")


def _asked(t: Tables):
    d = t.raw("conversations")
    n = F.length("text")
    said = (F.when(n < 100, "hours last week please").when(n < 150, "排班 下周").when(n < 200, "roster for today").when(n < 250, "what happened this month")
            .when(n < 300, "invoices in april 2026").when(n < 350, "from 2026-01-02 to 2026-02-03").when(n < 400, "timesheet 2024-05")
            .when(n < 500, "everything of 2023").otherwise("上个月"))
    return d.select("conv_id", "turn", F.concat(said, F.lit(" "), "text").alias("q"))


def _ranges(t: Tables):
    r = phrases.relative_range("q", AS_OF)
    rows = _asked(t).withColumn("r", r)
    return rows.select("conv_id", "turn", "r.phrase", "r.date_from", "r.date_to", "r.month", "r.period", "r.year",
                       phrases.range_label("r.date_from", "r.date_to", "r.month", AS_OF).alias("label"),
                       phrases.schedule_intent("q").alias("intent"))


add("relative_range", _ranges, """
SELECT conv_id, turn, p AS phrase,
  CASE p WHEN 'last_week' THEN '2000-05-22' WHEN 'next_week' THEN '2000-06-05' WHEN 'today' THEN '2000-06-01' WHEN 'range' THEN '2026-01-02' END AS date_from,
  CASE p WHEN 'last_week' THEN '2000-05-28' WHEN 'next_week' THEN '2000-06-11' WHEN 'today' THEN '2000-06-01' WHEN 'range' THEN '2026-02-03' END AS date_to,
  CASE p WHEN 'this_month' THEN '2000-06' WHEN 'last_month' THEN '2000-05' WHEN 'month' THEN '2024-05' END AS month,
  CASE p WHEN 'period' THEN '2026-04' END AS period, CASE p WHEN 'year' THEN '2023' END AS year,
  CASE WHEN p IN ('last_week','next_week','today','this_month','last_month') THEN p END AS label,
  CASE WHEN p = 'month' OR contains(lower(text),'timesheet') THEN 'timesheet'
       WHEN p IN ('next_week','today') OR contains(lower(text),'roster') OR contains(lower(text),'schedule') THEN 'roster' END AS intent
FROM (SELECT conv_id, turn, text, CASE WHEN n < 100 THEN 'last_week' WHEN n < 150 THEN 'next_week' WHEN n < 200 THEN 'today' WHEN n < 250 THEN 'this_month'
  WHEN n < 300 THEN 'period' WHEN n < 350 THEN 'range' WHEN n < 400 THEN 'month' WHEN n < 500 THEN 'year' ELSE 'last_month' END AS p
  FROM (SELECT *, length(text) AS n FROM conversations))""")
add("topic_intent", lambda t: _asked(t).groupBy(phrases.topic_intent("q").alias("topic")).agg(F.count("*").alias("questions")), """
SELECT topic, count(*) AS questions FROM (SELECT CASE
  WHEN regexp_matches(q,'shutdown|turnaround') THEN 'Shutdown' WHEN regexp_matches(q,'compliant|compliance|cert|ticket|expir') THEN 'Compliance'
  WHEN regexp_matches(q,'invoice|bill|receivable|overdue|xero|revenue') THEN 'Billing'
  WHEN regexp_matches(q,'stale|sync|data quality|freshness|broken|missing file') THEN 'Data Health'
  WHEN regexp_matches(q,'available|bench|idle|deploy|roster|who can') THEN 'Workforce' WHEN regexp_matches(q,'project|job|status') THEN 'Project'
  WHEN regexp_matches(q,'document|folder|file') THEN 'Document' ELSE 'General' END AS topic
  FROM (SELECT CASE WHEN n >= 100 AND n < 200 THEN 'roster ' WHEN n >= 250 AND n < 300 THEN 'invoices ' ELSE '' END||lower(text) AS q
  FROM (SELECT text, length(text) AS n FROM conversations))) GROUP BY 1""")

# fixed values: example price list
PRICES = {"large": {"in": 5.0, "out": 25.0, "cache_read": 0.5}, "mini": {"in": 0.25, "out": 2.0, "cache_read": 0.025}}


def _costs(t: Tables):
    c = t.raw("conversations").withColumn("label", F.when(F.col("role") == "user", "a/mini-1 (fallback)").when(F.col("role") == "system", "a/b")
                                          .otherwise("x/large-2"))
    n = F.length("text") * 1000
    return c.groupBy("label").agg(F.round(F.sum(costs.estimate_cost("label", n, F.length("text"), F.lit(1000000), PRICES)), 4).alias("usd"),
                                  F.sum(costs.avoided_tokens("text")).alias("tokens"))


add("estimate_cost", _costs, """
SELECT label, round(sum(usd),4) AS usd, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
SELECT CASE role WHEN 'user' THEN 'a/mini-1 (fallback)' WHEN 'system' THEN 'a/b' ELSE 'x/large-2' END AS label,
  CASE role WHEN 'user' THEN round((length(text)*1000*0.25 + length(text)*2.0 + 25000)/1000000, 6)
            WHEN 'assistant' THEN round((length(text)*1000*5.0 + length(text)*25.0 + 500000)/1000000, 6) END AS usd,
  length(text)//4 AS tokens FROM conversations) GROUP BY 1""")

# --- dimensions and facts ------------------------------------------------------------------------------

PERSON_COLS = "opms_employee_id, first_name, last_name, preferred_name, gender_name, nationality_name, email_work, phone_work, home_airport_code, " \
              "bms_person_id, person_id, arrangement_type, is_active, bms_position_id, ops_section_id, bms_supplier_id"
add("dim_person", lambda t: t.person.select(*PERSON_COLS.split(", ")), f"SELECT {PERSON_COLS} FROM person")
POSITION_COLS = "opms_position_id, bms_position_id, position_name, company_name, access_level_id, is_active, code1"
add("dim_position", lambda t: t.position.select(*POSITION_COLS.split(", ")), f"SELECT {POSITION_COLS} FROM position")
add("dim_project", lambda t: t.project.select("bms_project_id", "project_name", "project_code", "status", "is_active", "bms_client_id"),
    "SELECT id AS bms_project_id, title AS project_name, project_code, status, is_active, client_id AS bms_client_id FROM projsrc")
add("dim_client", lambda t: t.client.select("bms_client_id", "client_name", "client_short_name"),
    "SELECT r_regionkey AS bms_client_id, r_name AS client_name, substr(r_name,1,3) AS client_short_name FROM region")
add("dim_company", lambda t: D.dim_company(t.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))),
    "SELECT n_nationkey AS company_id, n_name AS company_name FROM nation")
add("dim_site", lambda t: t.site, """
SELECT CAST(r_regionkey + 1 AS VARCHAR) AS opms_site_id, 'Site '||r_name AS site_name, r_regionkey AS company_id, r_regionkey AS area_id FROM region""")
add("dim_supplier", lambda t: t.supplier.select("bms_supplier_id", "supplier_name", "is_active", "abn", "phone", "email"), """
SELECT n_nationkey AS bms_supplier_id, n_name AS supplier_name, n_nationkey % 2 = 0 AS is_active, 'ABN'||n_nationkey AS abn, '08'||n_nationkey AS phone,
  's'||n_nationkey||'@example.com' AS email FROM nation""")
add("dim_asset", lambda t: t.assets.select("bms_asset_id", "asset_name", "asset_id", "status", "model"),
    "SELECT bms_asset_id, asset_name, asset_id, status, model FROM assets")
add("dim_job", lambda t: t.job.select("bms_job_id", "job_title", "job_code", "job_status", "bms_project_id"),
    "SELECT id AS bms_job_id, title AS job_title, job_id AS job_code, job_status, project_id AS bms_project_id FROM jobsrc")
add("dim_competency", lambda t: D.dim_competency(t.competencies), """
SELECT CAST(id AS BIGINT) AS opms_competency_id, competency_name, group_name, classified, validity_years FROM competency""")
add("fact_roster", lambda t: D.fact_roster(t.roster_feed), """
SELECT opms_employee_id, strftime(roster_day,'%Y-%m-%d') AS roster_date, position_id, position_name, CAST(1 AS BIGINT) AS work_type_id, work_type_name,
  allowance_count FROM feed_days""")
ENTRY_COLS = "timesheet_id, site_id, supervisor_id, timesheet_date, status, opms_employee_id, hours, modified_at"
add("fact_timesheet", lambda t: t.entries.select(*ENTRY_COLS.split(", ")), f"SELECT {ENTRY_COLS} FROM entries")
TRAINING_COLS = "training_record_id, opms_employee_id, competency_id, competency_name, status, issue_date, expiry_date, has_document"
add("fact_training", lambda t: D.fact_training(t.training_feed).select(*TRAINING_COLS.split(", ")),
    f"SELECT {TRAINING_COLS.replace('competency_id', 'CAST(competency_id AS BIGINT) AS competency_id')} FROM training")
add("fact_change_log", lambda t: D.fact_change_log(t.change_feed), """
SELECT change_log_id, created_at, opms_employee_id + 1 AS created_by_id, event_type, opms_employee_id, value_before, value_after FROM audit""")
add("fact_inventory_txn", lambda t: D.fact_inventory_txn(t.raw("lineitem").select(
    F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("Title"), F.col("l_quantity").alias("Units"), F.col("l_partkey").alias("ItemLookupId"),
    F.col("l_suppkey").alias("ToStoreLookupId"), F.lit(None).cast("bigint").alias("FromPurchaseLookupId"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("Modified"))), """
SELECT l_orderkey AS bms_inv_transaction_id, l_returnflag AS title, l_quantity AS units, l_partkey AS store_item_id, l_suppkey AS to_store_id,
  CAST(NULL AS BIGINT) AS from_purchase_id, strftime(l_shipdate,'%Y-%m-%d') AS modified_at FROM lineitem""")
add("fact_purchase", lambda t: t.purchase_lines, """
SELECT l_orderkey||'-'||l_linenumber AS purchase_item_id, l_orderkey||'.0' AS purchase_id, l_partkey AS store_item_id, l_quantity AS unit_count,
  round(l_discount*100) AS unit_cost, strftime(o_orderdate,'%Y-%m-%d') AS invoice_date, o_custkey % 25 AS supplier_id, 'N'||o_orderkey AS inv_number,
  o_totalprice AS inv_amount FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
add("lookup_title", lambda t: D.lookup_title(t.raw("customer").select("c_custkey", F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")).alias("nation_id")),
                                             "nation_id", t.nation_titles, "nation_name"), """
SELECT c_custkey, c_nationkey||'.0' AS nation_id, n_name AS nation_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")

# --- reconciliation ----------------------------------------------------------------------------------------

add("winning_sheet", lambda t: R.winning_sheet(t.entries).select(*ENTRY_COLS.split(", ")), f"SELECT {ENTRY_COLS} FROM won")
add("winning_sheet_by_worker", lambda t: R.winning_sheet(t.entries).groupBy("opms_employee_id").agg(
    F.count("*").alias("entries"), F.count_distinct("timesheet_id").alias("sheets"), F.round(F.sum(E.to_number("hours")), 2).alias("hours")),
    "SELECT opms_employee_id, count(*) AS entries, count(DISTINCT timesheet_id) AS sheets, round(sum(hours), 2) AS hours FROM won GROUP BY 1")
MONTH_COLS = "opms_employee_id, site_id, month, total_hours, entry_count, first_name, last_name, site_name"
add("timesheet_summary", lambda t: t.months.select(*MONTH_COLS.split(", ")), f"SELECT {MONTH_COLS} FROM months")
add("opms_hours", lambda t: t.hours.select("opms", E.iso_date("work_date").alias("work_date"), "hours"),
    "SELECT CAST(opms AS VARCHAR) AS opms, strftime(work_date,'%Y-%m-%d') AS work_date, hours FROM day_hours")
add("get_live_worker_hours", lambda t: R.live_worker_hours(t.entries, "1999-01-01", "1999-06-30"), """
SELECT CAST(opms AS VARCHAR) AS opms, strftime(work_date,'%Y-%m-%d') AS work_date, hours FROM day_hours
WHERE work_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'""")
add("gap_pairs", lambda t: R.gap_pairs(t.forms).select("opms", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"),
                                                       F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"), F.round("hours", 4).alias("hours")), """
SELECT CAST(opms AS VARCHAR) AS opms, strftime(started,'%Y-%m-%d %H:%M:%S') AS started, strftime(ended,'%Y-%m-%d %H:%M:%S') AS ended, round(hours,4) AS hours FROM pairs""")
add("split_midnight", lambda t: t.gaps.select("opms", E.iso_date("work_date").alias("work_date"), "gap_hours"),
    "SELECT CAST(opms AS VARCHAR) AS opms, strftime(work_date,'%Y-%m-%d') AS work_date, gap_hours FROM gaps")
add("roster_context", lambda t: R.roster_context(t.roster_feed).withColumn("work_date", E.iso_date("work_date")), """
SELECT CAST(opms AS VARCHAR) AS opms, strftime(work_date,'%Y-%m-%d') AS work_date, first_name, last_name, position_name, work_type_name, project_name FROM context""")
add("weekly_timesheet", lambda t: t.weekly, "SELECT * FROM weekly")
add("weekly_timesheet_reference_mode", lambda t: t.weekly_of("reference"), "SELECT * FROM weekly_ref")
add("weekly_backfill", lambda t: t.weekly.filter("hours_source = 'opms_no_bms_roster'"), "SELECT * FROM weekly WHERE hours_source = 'opms_no_bms_roster'")
