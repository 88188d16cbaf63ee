"""Queries for quality, governance and incremental refresh (Q, R, I, and the landing cycle)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.operators import govern as V
from crewlake.operators import quality as Q
from crewlake.plans.registry import add
from crewlake.session import shared_folder
from crewlake.plans.stand_in import AS_OF, Tables
from crewlake.sources import bronze, gold_io
from crewlake.streaming import incremental as I
from crewlake.streaming.gaps import gap_pairs_stream

# --- the gate ---------------------------------------------------------------------------------------


def counts(t: Tables) -> DataFrame:
    return Q.table_counts({"employee_profile": t.raw("customer"), "roster_summary": t.raw("orders"), "timesheet_summary": t.raw("lineitem"),
                           "weekly_timesheet": t.raw("events").filter("value < 0"), "invoice_register": t.raw("events").filter("value < 0"),
                           "project_bridge": t.raw("supplier"), "job_detail": t.raw("part")})


def baseline(t: Tables) -> DataFrame:
    return Q.table_counts({"employee_profile": t.raw("orders"), "roster_summary": t.raw("orders"), "timesheet_summary": t.raw("lineitem"),
                           "weekly_timesheet": t.raw("events"), "invoice_register": t.raw("orders"), "retired": t.raw("nation")})


COUNTS = """now AS (SELECT 'gold:employee_profile' AS key, count(*) AS rows FROM customer UNION ALL SELECT 'gold:roster_summary', count(*) FROM orders
  UNION ALL SELECT 'gold:timesheet_summary', count(*) FROM lineitem UNION ALL SELECT 'gold:weekly_timesheet', 0 UNION ALL SELECT 'gold:invoice_register', 0
  UNION ALL SELECT 'gold:project_bridge', count(*) FROM supplier UNION ALL SELECT 'gold:job_detail', count(*) FROM part),
base AS (SELECT 'gold:employee_profile' AS key, count(*) AS was FROM orders UNION ALL SELECT 'gold:roster_summary', count(*) FROM orders
  UNION ALL SELECT 'gold:timesheet_summary', count(*) FROM lineitem UNION ALL SELECT 'gold:weekly_timesheet', count(*) FROM events
  UNION ALL SELECT 'gold:invoice_register', count(*) FROM orders UNION ALL SELECT 'gold:retired', count(*) FROM nation)"""
add("gold_guard", lambda t: Q.gold_guard(counts(t)), f"""
WITH {COUNTS} SELECT k AS key, CASE WHEN rows IS NULL THEN 'MISSING' ELSE 'EMPTY' END AS problem, 'FAIL' AS level
FROM (VALUES ('gold:employee_profile'),('gold:roster_summary'),('gold:weekly_timesheet'),('gold:timesheet_summary'),('gold:project_bridge'),
  ('gold:project_job_summary'),('gold:job_detail')) c(k) LEFT JOIN now ON now.key = k WHERE rows IS NULL OR rows <= 0""")
add("row_drops", lambda t: Q.row_drops(counts(t), baseline(t)), f"""
WITH {COUNTS} SELECT key, was, rows, round(100*(1 - rows/was)) AS drop_pct, 'WARN' AS level FROM now JOIN base USING (key)
WHERE key <> 'gold:invoice_register' AND was > 0 AND rows < was * 0.7""")
add("regressions", lambda t: Q.regressions(counts(t), baseline(t)), f"""
WITH {COUNTS} SELECT key, was, '0 rows' AS reason, 'WARN' AS level FROM base LEFT JOIN now USING (key)
WHERE coalesce(rows,0) = 0 AND was > 0 AND key <> 'gold:invoice_register'""")
add("guard_report", lambda t: Q.guard_report(counts(t), baseline(t)), f"""
WITH {COUNTS} SELECT 'FAIL' AS level, k AS key, 'critical table '||CASE WHEN rows IS NULL THEN 'MISSING' ELSE 'EMPTY' END AS detail
FROM (VALUES ('gold:employee_profile'),('gold:roster_summary'),('gold:weekly_timesheet'),('gold:timesheet_summary'),('gold:project_bridge'),
  ('gold:project_job_summary'),('gold:job_detail')) c(k) LEFT JOIN now ON now.key = k WHERE rows IS NULL OR rows <= 0
UNION ALL SELECT 'WARN', key, 'row drop '||was||' to '||rows FROM now JOIN base USING (key) WHERE key <> 'gold:invoice_register' AND was > 0 AND rows < was * 0.7
UNION ALL SELECT 'WARN', key, 'regression: 0 rows' FROM base LEFT JOIN now USING (key) WHERE coalesce(rows,0) = 0 AND was > 0 AND key <> 'gold:invoice_register'""")

# --- the sentinel ---------------------------------------------------------------------------------------


def checks(t: Tables) -> DataFrame:
    horizon = Q.horizon_check(t.roster, AS_OF, 600)
    return Q.table_checks(counts(t)).unionByName(horizon).unionByName(Q.stability(counts(t), baseline(t)))


CHECKS = """chk AS (SELECT key||': non-empty' AS "check", rows > 0 AS ok, CAST(rows AS VARCHAR) AS detail, CASE WHEN rows > 0 THEN 'OK' ELSE 'FAIL' END AS level FROM now
UNION ALL SELECT 'roster_summary: future horizon', max(roster_date) >= '2002-01-22', max(roster_date), CASE WHEN max(roster_date) >= '2002-01-22' THEN 'OK' ELSE 'FAIL' END FROM roster
UNION ALL SELECT key||': row-count stability', (was - rows)/was <= 0.3, CAST(round((was-rows)/was,3) AS VARCHAR), CASE WHEN (was-rows)/was <= 0.3 THEN 'OK' ELSE 'WARN' END
  FROM now JOIN base USING (key) WHERE was > 0)"""
add("sentinel_checks", checks, f'WITH {COUNTS}, {CHECKS} SELECT "check", ok, detail, level FROM chk')
add("overall_status", lambda t: Q.overall_status(checks(t)), f"""
WITH {COUNTS}, {CHECKS} SELECT count(*) FILTER (level='FAIL') AS fails, count(*) FILTER (level='WARN') AS warns, count(*) AS checks, 'FAIL' AS status FROM chk""")


def _nulls(t: Tables) -> DataFrame:
    r = t.raw("orders").select(F.when(F.col("o_totalprice") > 20000, F.col("o_orderdate")).alias("roster_date"))
    b = t.bridge
    return Q.null_rates(r, "roster_summary").unionByName(Q.null_rates(b, "project_bridge"))


add("null_rates", _nulls, """
SELECT *, rate <= ceiling AS ok, CASE WHEN rate <= ceiling THEN 'OK' ELSE 'WARN' END AS level, round(rate,4) AS null_rate FROM (
SELECT 'roster_summary' AS "table", 'roster_date' AS "column", count(*) FILTER (o_totalprice <= 20000)/count(*) AS rate, CAST(0.02 AS DOUBLE) AS ceiling FROM orders
UNION ALL SELECT 'project_bridge', 'client_code', count(*) FILTER (client_code IS NULL)/count(*), CAST(0.10 AS DOUBLE) FROM bridge)""".replace("SELECT *,", 'SELECT "table", "column", ceiling,'))


def _swings(t: Tables) -> DataFrame:
    now = t.raw("orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("value"))
    was = t.raw("orders").filter("o_orderstatus <> 'P' OR o_orderpriority < '3'").groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("value"))
    return Q.kpi_swings(now, was)


add("kpi_swings", _swings, """
SELECT 'kpi '||o_orderpriority||': swing' AS "check", s <= 0.3 AS ok, CAST(round(s,3) AS VARCHAR) AS detail, CASE WHEN s <= 0.3 THEN 'OK' ELSE 'WARN' END AS level FROM (
SELECT o_orderpriority, abs(count(*) - count(*) FILTER (o_orderstatus <> 'P' OR o_orderpriority < '3')) / count(*) FILTER (o_orderstatus <> 'P' OR o_orderpriority < '3') AS s
FROM orders GROUP BY 1)""")

# --- parity and freshness ---------------------------------------------------------------------------------------


def _parity(t: Tables) -> DataFrame:
    a = t.raw("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))
    b = t.raw("orders").select("o_orderkey", F.when(F.col("o_orderkey") == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
                               F.when(F.col("o_orderkey") != 9, F.col("o_orderstatus")).alias("o_orderstatus"),
                               F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 1), "yyyy-MM-dd").alias("order_date"), F.lit(1).alias("extra"))
    return Q.parity(a, b, "orders")


add("parity", _parity, """
SELECT 'orders' AS "table", aspect, "column", value_a, value_b FROM (
SELECT 'sum' AS aspect, 'o_totalprice' AS "column", printf('%.4f', sum(o_totalprice)) AS value_a,
  printf('%.4f', sum(o_totalprice + CASE WHEN o_orderkey = 7 THEN 1 ELSE 0 END)) AS value_b FROM orders
UNION ALL SELECT 'nulls', 'o_orderstatus', '0', CAST(count(*) FILTER (o_orderkey = 9) AS VARCHAR) FROM orders
UNION ALL SELECT 'min', 'order_date', strftime(min(o_orderdate),'%Y-%m-%d'), strftime(min(o_orderdate) + INTERVAL 1 DAY,'%Y-%m-%d') FROM orders
UNION ALL SELECT 'max', 'order_date', strftime(max(o_orderdate),'%Y-%m-%d'), strftime(max(o_orderdate) + INTERVAL 1 DAY,'%Y-%m-%d') FROM orders
UNION ALL SELECT 'schema', 'extra', NULL, 'int' UNION ALL SELECT 'nulls', 'extra', NULL, '0'
UNION ALL SELECT 'sum', 'extra', NULL, printf('%.4f', CAST(count(*) AS DOUBLE)) FROM orders)""")


def freshness(t: Tables) -> DataFrame:
    def top(name: str, c: str, source: str) -> DataFrame:
        return t.raw(name).agg(F.max(c).alias("d")).select(F.lit(source).alias("source"), F.date_format("d", "yyyy-MM-dd").alias("as_of_date"))
    seen = top("orders", "o_orderdate", "workforce").unionByName(top("lineitem", "l_shipdate", "lists")).unionByName(
        top("orders", "o_orderdate", "accounts")).unionByName(top("lineitem", "l_shipdate", "lake"))
    return Q.source_freshness(seen, "2001-11-10")


FRESH = """fresh AS (SELECT source, strftime(d,'%Y-%m-%d') AS as_of_date, CAST(date_diff('day', CAST(d AS DATE), DATE '2001-11-10') AS INTEGER) AS age_days,
  CASE WHEN date_diff('day', CAST(d AS DATE), DATE '2001-11-10') <= CASE WHEN source = 'accounts' THEN 30 ELSE 2 END THEN 'ok' ELSE 'stale' END AS status
  FROM (SELECT 'workforce' AS source, max(o_orderdate) AS d FROM orders UNION ALL SELECT 'lists', max(l_shipdate) FROM lineitem
  UNION ALL SELECT 'accounts', max(o_orderdate) FROM orders UNION ALL SELECT 'lake', max(l_shipdate) FROM lineitem))"""
add("source_freshness", freshness, f"WITH {FRESH} SELECT * FROM fresh")


def _caution(t: Tables) -> DataFrame:
    used = t.raw("events").select(F.col("user_id").alias("answer_id"), F.when(F.col("event_type") == "click", "workforce").when(
        F.col("event_type") == "view", "accounts").otherwise("unknown").alias("source"))
    return Q.freshness_caution(used, freshness(t))


add("freshness_caution", _caution, f"""
WITH {FRESH} SELECT answer_id, s AS stale_sources, 'I can answer this, but '||s||', so this may be incomplete.' AS caution FROM (
SELECT answer_id, string_agg(source||' ('||age_days||'d old)', ', ' ORDER BY source) AS s FROM (
  SELECT DISTINCT user_id AS answer_id, CASE event_type WHEN 'click' THEN 'workforce' WHEN 'view' THEN 'accounts' END AS source FROM events) JOIN fresh USING (source)
WHERE status = 'stale' GROUP BY 1)""")

# --- issues ---------------------------------------------------------------------------------------------------------


def issues(t: Tables) -> DataFrame:
    dated = t.roster.withColumn("roster_date", F.when(F.col("hours").isNull() | (F.col("hours") > 1), F.col("roster_date")))
    return Q.detect_issues(t.certs, t.links, dated, freshness(t), checks(t), t.invoices, t.runs)


ISSUES = """iss AS (
SELECT 'iss-cert-expired' AS issue_id, 'opms' AS node, 'certificates' AS entity, 'high' AS severity, count(*) AS affected_count FROM certs WHERE is_expired HAVING count(*) > 0
UNION ALL SELECT 'iss-cert-7d', 'opms', 'certificates', 'medium', count(*) FROM certs WHERE is_expiring_soon AND days_to_expiry <= 7 HAVING count(*) > 0
UNION ALL SELECT 'iss-links', 'bms', 'jms_jobs', 'medium', count(*) FROM links WHERE status <> 'ok' HAVING count(*) > 0
UNION ALL SELECT 'iss-roster', 'opms', 'roster', 'medium', count(*) FROM roster WHERE hours <= 1 HAVING count(*) > 0
UNION ALL SELECT 'iss-snapshot-stale', 'lake', 'data_quality', 'high', age_days FROM fresh WHERE source = 'lake' AND status = 'stale'
UNION ALL SELECT 'iss-dq-fail', 'lake', 'data_quality', 'critical', count(*) FROM chk WHERE NOT ok HAVING count(*) > 0
UNION ALL SELECT 'iss-accounts-stale', 'accounts', 'invoice_register', 'high', age_days FROM fresh WHERE source = 'accounts' AND status = 'stale'
UNION ALL SELECT 'iss-ar', 'accounts', 'ar_aging', 'medium', count(*) FROM invoices WHERE invoice_type = 'ACCREC' AND status = 'AUTHORISED' AND amount_due > 0 HAVING count(*) > 0
UNION ALL SELECT 'iss-automation', 'functions', 'daily_jobs', 'high', count(*) FROM runs WHERE conclusion <> 'success' HAVING count(*) > 0)"""
ISSUE_BASE = f"WITH {COUNTS}, {CHECKS}, {FRESH}, {ISSUES} "
add("detect_issues", lambda t: issues(t).select("issue_id", "node", "entity", "severity", "affected_count"), ISSUE_BASE + "SELECT * FROM iss")
NODES = "opms bms lake accounts functions gateway".split()
add("issue_rollup", lambda t: Q.issue_rollup(issues(t), t.spark.createDataFrame([(n,) for n in NODES], "node string"), "node"), ISSUE_BASE + """
SELECT n AS node, count(issue_id) AS issues, coalesce(CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END)
  WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END, 'healthy') AS severity
FROM (VALUES ('opms'),('bms'),('lake'),('accounts'),('functions'),('gateway')) v(n) LEFT JOIN iss ON iss.node = n GROUP BY 1""")
add("issue_evidence", lambda t: Q.issue_evidence(t.certs), """
SELECT issue_id, opms_employee_id, first_name||' '||last_name AS name, competency_name, expiry_date, CAST(abs(days_to_expiry) AS INTEGER) AS days FROM (
SELECT *, CASE WHEN is_expired THEN 'iss-cert-expired' WHEN is_expiring_soon AND days_to_expiry <= 7 THEN 'iss-cert-7d' END AS issue_id FROM certs) WHERE issue_id IS NOT NULL""")


def _revalidate(t: Tables) -> DataFrame:
    tag = F.when(F.col("is_expired"), "iss-cert-expired").otherwise("iss-valid").alias("issue_id")
    live = t.certs.groupBy(tag).agg(F.count("*").alias("live"))
    reported = live.select(F.when(F.col("issue_id") == "iss-valid", "iss-old").otherwise(F.col("issue_id")).alias("issue_id"),
                           F.col("live").alias("affected_count"))
    return Q.revalidate(reported, live)


add("revalidate", _revalidate, """
SELECT 'iss-cert-expired' AS issue_id, count(*) AS reported, count(*) AS live, TRUE AS matches FROM certs WHERE is_expired
UNION ALL SELECT 'iss-old', count(*), NULL, FALSE FROM certs WHERE NOT is_expired""")
add("grain_violations", lambda t: Q.grain_violations(t.roster, ["opms_employee_id", "roster_date"]),
    "SELECT opms_employee_id, roster_date, count(*) AS copies FROM roster GROUP BY 1, 2 HAVING count(*) > 1")

# --- governance ---------------------------------------------------------------------------------------------------------

add("governed_view_default", lambda t: V.governed_view(t.invoices, "invoice_register"), """
SELECT invoice_id, invoice_number, invoice_type, status, contact_name, reference, job_code, invoice_date, month, due_date, bridge_client FROM invoices""")
add("governed_view_finance", lambda t: V.governed_view(t.invoices, "invoice_register", "Finance", ["invoice_id", "total", "amount_due"]),
    "SELECT invoice_id, total, amount_due FROM invoices")
add("capped", lambda t: V.capped(t.raw("events").select("event_id", "user_id").orderBy("event_id"), 1000),
    "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 1000")
add("redact_fields", lambda t: V.redact_fields(t.profile.select("opms_employee_id", "first_name", "gender_name", "date_of_birth",
                                                                F.struct(F.col("bms_position_id").alias("salary"), "position_name").alias("job")), "default")
    .select("opms_employee_id", "first_name", "gender_name", "date_of_birth", F.col("job.salary").alias("salary"), F.col("job.position_name").alias("position_name")), """
SELECT opms_employee_id, first_name, '[REDACTED:gender_name]' AS gender_name, '[REDACTED:date_of_birth]' AS date_of_birth, '[REDACTED:salary]' AS salary, position_name FROM profile""")
# fixed values: the given texts hold none of the six standard secrets, so three more patterns are passed in
TEXT_PATTERNS = V.SECRET_PATTERNS + [r"token = \"[0-9a-f]{40}\"", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", r"[0-9]{16}"]
add("scrub_secrets", lambda t: V.scrub_secrets(t.raw("documents").select("doc_id", "text"), TEXT_PATTERNS), """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,'token = "[0-9a-f]{40}"','[REDACTED:secret]','g'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+','[REDACTED:secret]','g'),'[0-9]{16}','[REDACTED:secret]','g') AS text FROM documents""")
add("redaction_actions", lambda t: V.redaction_actions(t.raw("documents").select("doc_id", "text", F.col("n_chars").alias("salary")), "default", TEXT_PATTERNS), """
SELECT 'redact_field' AS action, 'salary' AS target, count(*) AS actions FROM documents
UNION ALL SELECT 'scrub_secret', 'text:6', count(*) FROM documents WHERE regexp_matches(text,'token = "[0-9a-f]{40}"') HAVING count(*) > 0
UNION ALL SELECT 'scrub_secret', 'text:7', count(*) FROM documents WHERE regexp_matches(text,'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+') HAVING count(*) > 0
UNION ALL SELECT 'scrub_secret', 'text:8', count(*) FROM documents WHERE regexp_matches(text,'[0-9]{16}') HAVING count(*) > 0""")


def _access(t: Tables) -> DataFrame:
    e = t.raw("events").select(F.col("event_type").alias("tool"), F.when(F.col("value") > 20, "Finance").otherwise("default").alias("role"),
                               (F.col("value") > 1).alias("allowed"), F.col("value").alias("latency_ms"),
                               F.get_json_object("props", "$.k").cast("bigint").alias("row_count"), F.col("props").alias("payload"))
    return V.access_report(e)


add("access_report", _access, """
SELECT event_type AS tool, CASE WHEN value > 20 THEN 'Finance' ELSE 'default' END AS role, count(*) AS calls, count(*) FILTER (value <= 1) AS denied,
  round(avg(value),2) AS avg_latency_ms, max(value) AS max_latency_ms, round(quantile_cont(value, 0.95), 4) AS p95_latency_ms, CAST(sum(CAST(json_extract(props,'$.k') AS BIGINT)) AS BIGINT) AS rows,
  round(sum(round((length(props)//4)/1000000*3.0, 6)), 6) AS avoided_usd FROM events GROUP BY 1, 2""")


def _roles(t: Tables) -> DataFrame:
    users = t.raw("customer").select(F.col("c_custkey").alias("user"), F.array(F.lower("c_mktsegment"), F.when(F.col("c_acctbal") > 5000, "ORG-HR").otherwise("none")).alias("groups"))
    mapping = t.spark.createDataFrame([("MACHINERY", "Finance"), ("Building", "Admin_IT"), ("org-hr", "HR_Manager")], "group string, role string")
    return V.user_roles(users, mapping)


add("user_roles", _roles, """
SELECT c_custkey AS "user", CASE WHEN c_mktsegment = 'BUILDING' THEN 'Admin_IT' WHEN c_mktsegment = 'MACHINERY' THEN 'Finance'
  WHEN c_acctbal > 5000 THEN 'HR_Manager' ELSE 'default' END AS role FROM customer""")
add("raw_lookup", lambda t: V.raw_lookup({"parts": t.raw("part"), "nations": t.raw("nation"), "pages": t.raw("pages")},
                                         [("parts", "p_name"), ("nations", "n_name"), ("pages", "url"), ("gone", "x")], "N", "Admin_IT"), """
SELECT 'parts' AS "table", 'p_name' AS "column", v AS value FROM (SELECT DISTINCT p_name AS v FROM part WHERE p_name ILIKE '%n%' )
UNION ALL SELECT 'nations', 'n_name', v FROM (SELECT DISTINCT n_name AS v FROM nation WHERE n_name ILIKE '%n%' )
UNION ALL SELECT 'pages', 'url', v FROM (SELECT DISTINCT url AS v FROM pages WHERE url ILIKE '%n%' )""")

# --- incremental ---------------------------------------------------------------------------------------------------------


def work_dir(t: Tables) -> str:
    """A new folder for this run, under the folder that all executors share."""
    return f"{shared_folder(t.spark)}/crewlake-{uuid.uuid4().hex}"


def _versions(t: Tables, cond: str) -> DataFrame:
    from crewlake.functions.ordered import latest
    o = t.raw("orders").filter(cond).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


add("upsert", lambda t: I.upsert(_versions(t, "o_orderdate < '2000-01-01'"), _versions(t, "o_orderdate >= '1999-06-01'"), ["o_custkey"], "o_orderdate")
    .select("o_custkey", "o_orderkey", "o_totalprice"), """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CASE WHEN o_orderdate < '2000-01-01' THEN 0 ELSE 1 END, o_orderkey DESC) = 1""")


def _landed(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.col("event_type").alias("object"), F.col("ts").alias("modified_at"))


add("high_watermarks", lambda t: I.high_watermarks(_landed(t)).withColumn("high_watermark", F.date_format("high_watermark", "yyyy-MM-dd HH:mm:ss")), """
SELECT event_type AS object, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS high_watermark, count(*) AS rows FROM events GROUP BY 1""")
add("changed_since", lambda t: I.changed_since(_landed(t), I.high_watermarks(_landed(t).filter("object <> 'view'"))).select("event_id", "object"), """
SELECT event_id, event_type AS object FROM events JOIN (SELECT event_type, max(ts) AS m FROM events GROUP BY 1) USING (event_type)
WHERE event_type = 'view' OR ts > m - INTERVAL 48 HOUR""")
add("reconcile_deletes", lambda t: I.reconcile_deletes(t.raw("customer").select("c_custkey", "c_name"), t.raw("orders").filter("o_orderdate >= '2001-01-01'")
                                                       .select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], "2001-08-02 00:00:00")
    .withColumn("deleted_at", F.date_format("deleted_at", "yyyy-MM-dd")), """
SELECT c_custkey, c_name, NOT seen AS is_deleted, CASE WHEN NOT seen THEN '2001-08-02' END AS deleted_at FROM (
SELECT c_custkey, c_name, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= '2001-01-01') AS seen FROM customer)""")
add("changed_dimension", lambda t: I.changed_dimension(t.audit, t.person, "2024-01-29T00:00:00", "opms_employee_id", "opms_employee_id").select("opms_employee_id", "last_name"), """
SELECT opms_employee_id, last_name FROM person WHERE opms_employee_id IN (SELECT opms_employee_id FROM audit WHERE created_at > '2024-01-29T00:00:00')""")
add("since_filter", lambda t: bronze.since(t.raw("events"), "ts", "2024-01-20 00:00:00").groupBy("event_type").agg(F.count("*").alias("rows")),
    "SELECT event_type, count(*) AS rows FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")


def _landing_cycle(t: Tables) -> DataFrame:
    """Land two days, one of them twice, and read the newest back."""
    root = work_dir(t)
    e = t.raw("events").select(F.struct("event_id", "user_id", "event_type").alias("fields"), F.lit(1).alias("version"))
    bronze.land(e.filter("fields.event_type = 'click'"), root, "workforce", "events", "2024-01-30")
    bronze.land(e.filter("fields.event_type = 'view'"), root, "workforce", "events", "2024-01-31")
    bronze.land(e.filter("fields.event_type <> 'click'"), root, "workforce", "events", "2024-01-31")
    return bronze.read_bronze(t.spark, root, "workforce", "events").select("event_id", "user_id", "event_type")


add("read_bronze", _landing_cycle, "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'click'")


def _stream(t: Tables) -> DataFrame:
    """Land events as NDJSON, consume them as a stream in two runs and merge by user."""
    root = work_dir(t)
    e = t.raw("events").select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"))
    schema = "user_id bigint, event_id bigint, event_type string, ts string"
    for day, cond in (("2024-01-20", "ts >= '2024-01-15'"), ("2024-01-21", "ts < '2024-01-25'")):
        bronze.land(e.filter(cond), root, "workforce", "events", day)
        I.stream_ingest(t.spark, f"{root}/workforce/events", schema, f"{root}/merged", ["user_id"], "ts", f"{root}/checkpoint", 8).awaitTermination()
    return I.read_merged(t.spark, f"{root}/merged").select("user_id", "event_id", "event_type")


add("stream_ingest", _stream, """
SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")


def _gap_stream(t: Tables) -> DataFrame:
    """Land the sign forms as NDJSON, a later part first, and pair them as a stream; a form years later closes the last gaps."""
    root = work_dir(t)
    forms = t.forms.select("OPMS", "Status", "Date").withColumns({c: F.col(c).cast("string") for c in ("OPMS", "Status", "Date")})
    half = F.pmod(F.xxhash64("OPMS", "Date"), F.lit(2))
    schema = "OPMS string, Status string, Date string"
    closing = t.spark.createDataFrame([("0", "Sign In", "2100-01-01T00:00:00")], schema)
    for part in (forms.filter(half == 1), forms.filter(half == 0), closing):
        part.write.mode("append").json(f"{root}/forms")
        stream = t.spark.readStream.schema(schema).json(f"{root}/forms")
        # the delay spans the table, so whatever order its parts come in nothing is late
        gap_pairs_stream(stream, "3650 days").writeStream.format("parquet").option("path", f"{root}/pairs").option(
            "checkpointLocation", f"{root}/pairs-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("opms string, started timestamp, ended timestamp, hours double").parquet(f"{root}/pairs").select(
        "opms", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("ended", "yyyy-MM-dd HH:mm:ss").alias("ended"),
        F.round("hours", 4).alias("hours"))


add("gap_pairs_stream", _gap_stream, """
SELECT CAST(opms AS VARCHAR) AS opms, strftime(started,'%Y-%m-%d %H:%M:%S') AS started, strftime(ended,'%Y-%m-%d %H:%M:%S') AS ended, round(hours,4) AS hours FROM pairs""")


def _gold_cycle(t: Tables) -> DataFrame:
    root = work_dir(t)
    gold_io.write_gold(t.project_jobs, root, "project_job_summary")
    gold_io.write_gold(t.project_jobs.select(), root, "project_job_summary")
    return gold_io.read_gold(t.spark, root, "project_job_summary").select("bms_project_id", "project_name", "job_count")


add("write_gold", _gold_cycle, "SELECT bms_project_id, project_name, job_count FROM project_jobs")
