"""SQL statements of the stand-in tables, for comparing results with another engine.

``sql(body)`` puts the needed definitions in front of a query as common table expressions.
They are written from the business rules, not from the Spark plans.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2000-06-01'"

TWIN: dict[str, str] = {
    "people": """
SELECT o_orderkey AS id, o_custkey AS opms, 'P'||o_orderkey AS person_id, o_orderstatus AS arrangement_type,
  o_totalprice > 50000 AS is_active, o_orderkey % 997 + 1000 AS bms_position_id, o_orderkey % 5 AS ops_section_id,
  o_orderkey % 25 AS bms_supplier_id, 'Person '||o_orderkey AS title
FROM orders""",
    "person": """
SELECT c.c_custkey AS opms_employee_id, split_part(c.c_name,'#',1) AS first_name, split_part(c.c_name,'#',2) AS last_name,
  c.c_name AS preferred_name, c.c_mktsegment AS gender_name, CAST(c.c_nationkey AS VARCHAR) AS nationality_name,
  'w'||c.c_custkey||'@example.com' AS email_work, '04'||c.c_custkey AS phone_work, 'A'||c.c_nationkey AS home_airport_code,
  p.id AS bms_person_id, p.person_id, p.arrangement_type, p.is_active, p.bms_position_id, p.ops_section_id, p.bms_supplier_id
FROM customer c LEFT JOIN (SELECT * FROM people QUALIFY row_number() OVER (PARTITION BY opms ORDER BY id DESC) = 1) p
  ON c.c_custkey = p.opms""",
    "position": """
SELECT p.p_partkey AS opms_position_id, l.id AS bms_position_id, p.p_name AS position_name, p.p_brand AS company_name,
  l.access_level_id, l.is_active, p.p_type AS code1
FROM part p LEFT JOIN (
  SELECT * FROM (SELECT p_partkey + 1000 AS id, p_partkey AS k, p_size AS access_level_id, TRUE AS is_active, 0 AS again
                 FROM part WHERE p_size > 10
                 UNION ALL SELECT p_partkey + 1001, p_partkey, p_size, FALSE, 1 FROM part WHERE p_size > 40)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY again DESC) = 1) l ON l.k = p.p_partkey""",
    "sections": "SELECT r_regionkey AS id, CASE WHEN r_regionkey = 0 THEN 'TRANSPORT & HIRE' ELSE r_name END AS title FROM region",
    "profile": """
SELECT d.*, q.position_name, q.company_name, n.n_name AS supplier_name, s.title AS ops_section_name
FROM person d LEFT JOIN (SELECT * FROM position WHERE bms_position_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY bms_position_id ORDER BY CAST(opms_position_id AS BIGINT)) = 1) q USING (bms_position_id)
LEFT JOIN nation n ON n.n_nationkey = d.bms_supplier_id LEFT JOIN sections s ON s.id = d.ops_section_id""",
    "linesx": """
SELECT l.*, o.o_custkey, o.o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "competency": """
SELECT length(p_type)*1000 + ascii(p_type) AS id, p_type AS competency_name, min(p_brand) AS group_name,
  min(p_size) > 1 AS classified, min(p_size) AS validity_years FROM part GROUP BY p_type""",
    "training": """
SELECT 'T-'||o_custkey||'-'||p_type AS training_record_id, o_custkey AS opms_employee_id,
  length(p_type)*1000 + ascii(p_type) AS competency_id, p_type AS competency_name, max(l_returnflag) AS status,
  strftime(min(l_shipdate), '%Y-%m-%d') AS issue_date,
  CASE WHEN count(*) > 1 THEN strftime(max(l_shipdate), '%Y-%m-%d') END AS expiry_date, count(*) > 3 AS has_document,
  strftime(max(l_shipdate), '%Y-%m-%d') AS modified_at
FROM linesx JOIN part ON l_partkey = p_partkey GROUP BY o_custkey, p_type""",
    "certs": f"""
SELECT t.*, p.first_name, p.last_name, p.arrangement_type, p.is_active, c.group_name, c.validity_years, c.classified,
  date_diff('day', {AS_OF}, CAST(t.expiry_date AS DATE)) AS days_to_expiry,
  coalesce(CAST(t.expiry_date AS DATE) < {AS_OF}, FALSE) AS is_expired,
  coalesce(date_diff('day', {AS_OF}, CAST(t.expiry_date AS DATE)) BETWEEN 0 AND 90, FALSE) AS is_expiring_soon
FROM training t LEFT JOIN person p USING (opms_employee_id) LEFT JOIN competency c ON c.id = t.competency_id""",
    "jobsrc": """
SELECT s_suppkey AS id, s_name AS title, 'sh-'||(25000 + s_suppkey)||'-A' AS job_id, s_nationkey AS project_id,
  CASE WHEN s_acctbal < 2000 THEN 'COMPLETE/CLOSED' WHEN s_acctbal < 5000 THEN 'In Progress'
       WHEN s_acctbal < 7000 THEN 'Cancelled' ELSE 'Requested' END AS job_status, s_acctbal > 5000 AS active FROM supplier""",
    "projsrc": """
SELECT n_nationkey AS id, 'Project '||n_name AS title, 'PC'||n_nationkey AS project_code, 'Stage '||n_regionkey AS status,
  n_nationkey % 3 <> 0 AS is_active, n_regionkey AS client_id,
  CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'C'||lpad(CAST(n_nationkey AS VARCHAR),4,'0') END AS client_code FROM nation""",
    "bridge": """
SELECT upper(regexp_extract(j.job_id, '(?i)^([A-Z]{2,4}-\\d{4,6})', 1)) AS job_code, j.title AS job_title, p.id AS bms_project_id,
  p.title AS project_name, p.client_code, r.r_name AS client_name, CAST(NULL AS VARCHAR) AS opms_project_name, 'jms_bridge' AS source
FROM jobsrc j JOIN projsrc p ON p.id = j.project_id LEFT JOIN region r ON r.r_regionkey = p.client_id
UNION ALL
SELECT NULL, NULL, NULL, NULL, 'C9'||r_regionkey, NULL, 'Yard '||r_regionkey, 'manual_map' FROM region""",
    "code_client": """
SELECT job_code, coalesce(nullif(client_code,''), client_name) AS client FROM bridge WHERE source = 'jms_bridge'
QUALIFY row_number() OVER (PARTITION BY job_code ORDER BY job_title) = 1""",
    "name_client": "SELECT opms_project_name AS name, client_code AS client FROM bridge WHERE source = 'manual_map'",
    "feed_days": """
SELECT o_custkey AS opms_employee_id, 'Customer' AS first_name, lpad(CAST(o_custkey AS VARCHAR),9,'0') AS last_name,
  CAST(o_orderdate AS DATE) + CAST(d AS INTEGER) AS roster_day, o_orderkey AS pos, d AS dayno, o_orderkey % 10 AS position_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Z. CRANE' ELSE o_orderpriority END AS position_name,
  CASE WHEN o_orderstatus = 'F' THEN 'Night Shift' ELSE 'DAY SHIFT' END AS work_type_name,
  CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS allowance_count,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Yard '||(o_orderkey % 7)
       ELSE 'SH-'||(25000 + o_orderkey % 100)||' - '||o_orderpriority END AS project_name
FROM orders, (VALUES (0), (1)) t(d)""",
    "list_lines": """
SELECT o_custkey AS opms_employee_id, 'Customer' AS first_name, lpad(CAST(o_custkey AS VARCHAR),9,'0') AS last_name,
  CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS roster_day, o_orderkey AS pos,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Z. CRANE' ELSE o_orderpriority END AS position_name,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Yard '||(o_orderkey % 7)
       WHEN o_orderstatus = 'F' THEN 'sh-'||(25000 + o_orderkey % 100)||' - list'
       ELSE 'SH-'||(25000 + o_orderkey % 100)||' - list' END AS project_name,
  CASE WHEN o_orderstatus = 'F' THEN 'Night Shift' ELSE 'DAY SHIFT' END AS work_type_name,
  CASE WHEN o_totalprice > 100000 THEN CAST(o_orderkey % 12 + 1 AS DOUBLE) END AS hours, o_orderkey % 6 AS site_key,
  CASE WHEN o_totalprice > 250000 THEN o_orderkey % 25 END AS supplier_key
FROM orders""",
    "roster0": """
SELECT opms_employee_id, first_name, last_name, strftime(roster_day, '%Y-%m-%d') AS roster_date, position_name, work_type_name,
  project_name, CAST(NULL AS DOUBLE) AS hours, 'opms' AS source FROM feed_days
UNION ALL
SELECT opms_employee_id, first_name, last_name, strftime(roster_day, '%Y-%m-%d'), position_name, work_type_name, project_name,
  hours, 'bms' FROM list_lines""",
    "roster": """
SELECT r.*, coalesce(n.client, c.client) AS client_name FROM roster0 r LEFT JOIN name_client n ON n.name = r.project_name
LEFT JOIN code_client c ON c.job_code = upper(nullif(regexp_extract(r.project_name, '(?i)^([A-Z]{2,4}-\\d{4,6})', 1), ''))""",
    "entries": """
SELECT 'S'||l_suppkey AS timesheet_id, CAST(l_linenumber AS VARCHAR) AS site_id, CAST(l_suppkey AS VARCHAR) AS supervisor_id,
  strftime(o_orderdate, '%Y-%m-%d') AS timesheet_date, l_linestatus AS status, o_custkey AS opms_employee_id, l_quantity AS hours,
  strftime(l_shipdate, '%Y-%m-%d') AS modified_at FROM linesx
UNION ALL
SELECT 'S'||l_suppkey, CAST(l_linenumber AS VARCHAR), CAST(l_suppkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), l_linestatus,
  o_custkey, 1.0, strftime(l_shipdate, '%Y-%m-%d') FROM linesx WHERE l_returnflag = 'R'""",
    "winners": """
SELECT opms_employee_id, timesheet_date, site_id, timesheet_id FROM entries
QUALIFY row_number() OVER (PARTITION BY opms_employee_id, timesheet_date, site_id ORDER BY modified_at DESC, timesheet_id DESC) = 1""",
    "won": "SELECT e.* FROM entries e JOIN winners w USING (opms_employee_id, timesheet_date, site_id, timesheet_id)",
    "months": """
SELECT g.*, p.first_name, p.last_name, s.site_name FROM (
  SELECT opms_employee_id, site_id, substr(timesheet_date,1,7) AS month, coalesce(sum(hours),0) AS total_hours, count(*) AS entry_count
  FROM won GROUP BY ALL) g LEFT JOIN person p USING (opms_employee_id)
LEFT JOIN (SELECT CAST(r_regionkey + 1 AS VARCHAR) AS site_id, 'Site '||r_name AS site_name FROM region) s USING (site_id)""",
    "day_hours": """
SELECT opms_employee_id AS opms, CAST(timesheet_date AS DATE) AS work_date, round(sum(hours),2) AS hours FROM won GROUP BY ALL""",
    "moves": """
SELECT user_id AS opms, event_type = 'view' AS is_in, date_trunc('second', ts - INTERVAL 24 YEAR) + INTERVAL 8 HOUR AS ts FROM events
WHERE event_type IN ('click','view')""",
    "pairs": """
SELECT opms, prev AS started, ts AS ended, date_diff('microsecond', prev, ts) / 3600000000.0 AS hours FROM (
  SELECT *, lag(is_in) OVER w AS was_in, lag(ts) OVER w AS prev FROM moves WINDOW w AS (PARTITION BY opms ORDER BY ts, is_in))
WHERE is_in AND NOT was_in AND ts > prev AND (CAST(ts AS DATE) = CAST(prev AS DATE) OR ts - prev <= INTERVAL 6 HOUR)""",
    "gaps": """
SELECT opms, CAST(d AS DATE) AS work_date, round(sum(date_diff('microsecond', greatest(started, d), least(ended, d + INTERVAL 1 DAY))
  / 3600000000.0), 2) AS gap_hours
FROM (SELECT *, unnest(range(date_trunc('day', started), date_trunc('day', ended) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM pairs)
WHERE least(ended, d + INTERVAL 1 DAY) > greatest(started, d) GROUP BY ALL""",
    "context": """
SELECT opms_employee_id AS opms, roster_day AS work_date, first_name, last_name, position_name, work_type_name, project_name
FROM feed_days QUALIFY row_number() OVER (PARTITION BY opms_employee_id, roster_day ORDER BY pos, dayno) = 1""",
    "first_supplier": """
SELECT p.opms, n.n_name AS list_name FROM people p JOIN nation n ON n.n_nationkey = p.bms_supplier_id
QUALIFY row_number() OVER (PARTITION BY p.opms ORDER BY p.id) = 1""",
    "sited": """
SELECT l.*, s.title AS site_name FROM list_lines l LEFT JOIN sections s ON s.id = l.site_key
WHERE NOT (upper(l.position_name) LIKE 'Z.%' AND coalesce(s.title,'') = 'TRANSPORT & HIRE')""",
    "weekly0": """
SELECT l.opms_employee_id, l.first_name, l.last_name, l.position_name, l.project_name, l.site_name,
  coalesce(n.n_name, f.list_name) AS supplier_name, l.roster_day AS work_date, l.work_type_name,
  h.hours AS sheet_hours, l.hours AS line_hours, coalesce(g.gap_hours, 0) AS gap,
  row_number() OVER (PARTITION BY l.opms_employee_id, l.roster_day ORDER BY l.pos) AS nth, FALSE AS backfill
FROM sited l LEFT JOIN day_hours h ON h.opms = l.opms_employee_id AND h.work_date = l.roster_day
LEFT JOIN gaps g ON g.opms = l.opms_employee_id AND g.work_date = l.roster_day
LEFT JOIN nation n ON n.n_nationkey = l.supplier_key LEFT JOIN first_supplier f ON f.opms = l.opms_employee_id
UNION ALL
SELECT h.opms, coalesce(c.first_name, split_part(k.c_name,'#',1)), coalesce(c.last_name, split_part(k.c_name,'#',2)), c.position_name,
  c.project_name, NULL, f.list_name, h.work_date, c.work_type_name, h.hours, NULL, coalesce(g.gap_hours, 0), 1, TRUE
FROM day_hours h LEFT JOIN context c ON c.opms = h.opms AND c.work_date = h.work_date
LEFT JOIN gaps g ON g.opms = h.opms AND g.work_date = h.work_date LEFT JOIN first_supplier f ON f.opms = h.opms
LEFT JOIN customer k ON k.c_custkey = h.opms
WHERE NOT EXISTS (SELECT 1 FROM sited s WHERE s.opms_employee_id = h.opms AND s.roster_day = h.work_date)
  AND coalesce(c.position_name,'') NOT LIKE 'Z.%'""",
    "weekly1": """
SELECT w.*, coalesce(n.client, c.client) AS client_name FROM weekly0 w LEFT JOIN name_client n ON n.name = w.project_name
LEFT JOIN code_client c ON c.job_code = upper(nullif(regexp_extract(w.project_name, '(?i)^([A-Z]{2,4}-\\d{4,6})', 1), ''))""",
    "weekly": """
SELECT opms_employee_id, first_name, last_name, position_name, project_name, client_name, site_name, supplier_name,
  strftime(work_date, '%Y-%m-%d') AS work_date, CASE WHEN upper(work_type_name) = 'NIGHT SHIFT' THEN 'NS' ELSE 'DS' END AS shift_type,
  round(h, 2) AS roster_hours, round(g, 2) AS gap_hours, round(greatest(0, h - g), 2) AS actual_hours,
  CASE WHEN backfill THEN 'opms_no_bms_roster' WHEN sheet_hours IS NOT NULL THEN 'opms' WHEN line_hours IS NOT NULL THEN 'bms_writeback'
       ELSE 'none' END AS hours_source
FROM (SELECT *, CASE WHEN nth = 1 THEN gap ELSE 0 END AS g,
        CASE WHEN sheet_hours IS NULL THEN coalesce(line_hours, 0) WHEN nth = 1 THEN sheet_hours ELSE 0 END AS h FROM weekly1)""",
    "weekly_ref": """
SELECT opms_employee_id, first_name, last_name, position_name, project_name, client_name, site_name, supplier_name,
  strftime(work_date, '%Y-%m-%d') AS work_date, CASE WHEN upper(work_type_name) = 'NIGHT SHIFT' THEN 'NS' ELSE 'DS' END AS shift_type,
  round(h, 2) AS roster_hours, round(gap, 2) AS gap_hours, round(greatest(0, h - gap), 2) AS actual_hours,
  CASE WHEN backfill THEN 'opms_no_bms_roster' WHEN sheet_hours IS NOT NULL THEN 'opms' WHEN line_hours IS NOT NULL THEN 'bms_writeback'
       ELSE 'none' END AS hours_source
FROM (SELECT *, coalesce(sheet_hours, line_hours, 0) AS h FROM weekly1)""",
    "project_jobs": """
SELECT p.id AS bms_project_id, p.title AS project_name, p.project_code, p.status, p.is_active, p.client_id AS bms_client_id,
  r.r_name AS client_name, j.job_count, j.active_job_count, '1995-01-01' AS project_start_date
FROM projsrc p LEFT JOIN (SELECT project_id, count(*) AS job_count, count(*) FILTER (active) AS active_job_count FROM jobsrc GROUP BY 1) j
  ON j.project_id = p.id LEFT JOIN region r ON r.r_regionkey = p.client_id""",
    "job_details": """
SELECT j.id AS bms_job_id, j.title AS job_title, j.job_id AS job_code, j.job_status,
  CASE WHEN j.active THEN 'True' ELSE 'no' END AS is_active, p.title AS project_name, r.r_name AS client_name,
  n.n_name AS work_location_name, s.title AS ops_section_name, d.first_name AS lead_first_name, d.last_name AS lead_last_name
FROM jobsrc j LEFT JOIN projsrc p ON p.id = j.project_id LEFT JOIN region r ON r.r_regionkey = j.project_id % 5
LEFT JOIN nation n ON n.n_nationkey = j.project_id LEFT JOIN sections s ON s.id = j.project_id % 5
LEFT JOIN person d ON d.bms_person_id = j.id""",
    "assets": """
SELECT p_partkey AS bms_asset_id, p_name AS asset_name, 'A'||p_partkey AS asset_id, p_type AS status, p_brand AS model,
  m.n_name AS manufacturer_name, l.n_name AS location_name, s.title AS asset_group_name
FROM part LEFT JOIN nation m ON m.n_nationkey = p_partkey % 25 LEFT JOIN nation l ON l.n_nationkey = p_size
LEFT JOIN sections s ON s.id = p_partkey % 5""",
    "stock": """
SELECT p_partkey AS bms_store_id, p_name||' '||p_brand AS item_name, CASE WHEN p_size <= 45 THEN p_size END AS stock,
  n.n_name AS location_name, s.title AS category_name
FROM part LEFT JOIN nation n ON n.n_nationkey = p_partkey % 25 LEFT JOIN sections s ON s.id = p_partkey % 5""",
    "rates": """
SELECT p_partkey AS bms_rate_id, p_name AS rate_title, 'Project '||n_name AS project_name, p_brand AS project_code,
  p_retailprice AS day_shift_rate, p_retailprice + 100 AS night_shift_rate
FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 30""",
    "ledger0": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS bms_txn_id, l_quantity AS units, l_partkey,
  CASE WHEN l_linestatus = 'F' THEN 'Stores Moved out' WHEN l_returnflag = 'A' THEN 'Purchase to store' ELSE 'Other' END AS title,
  CASE WHEN l_returnflag = 'R' THEN l_orderkey END AS person_id, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS job_id,
  l_returnflag = 'N' AND l_linestatus = 'O' AS bought,
  l_shipdate + CASE WHEN l_quantity > 5 THEN INTERVAL 28 HOUR ELSE INTERVAL 18 HOUR END AS local_ts FROM lineitem""",
    "ledger": """
SELECT t.bms_txn_id, t.title, t.units, strftime(t.local_ts, '%Y-%m-%d') AS txn_date, strftime(t.local_ts, '%Y-%m') AS txn_month,
  CASE WHEN t.person_id IS NOT NULL THEN 'sign_out' WHEN bought OR t.title LIKE 'Purchase to store%' THEN 'stock_in'
       WHEN t.title LIKE 'Stores Moved%' THEN 'store_move' ELSE 'other' END AS txn_kind,
  f.n_name AS from_location, g.n_name AS to_location, w.title AS person_name, i.p_name AS item_name, i.p_brand AS item_code,
  j.job_id AS job_code, j.title AS job_title, p.title AS project_name
FROM ledger0 t LEFT JOIN nation f ON f.n_nationkey = t.l_partkey % 30 LEFT JOIN nation g ON g.n_nationkey = t.l_partkey % 20
LEFT JOIN people w ON w.id = t.person_id LEFT JOIN part i ON i.p_partkey = t.l_partkey LEFT JOIN jobsrc j ON j.id = t.job_id
LEFT JOIN projsrc p ON p.id = j.project_id""",
    "actions": f"""
SELECT o_orderkey AS bms_issue_id, 'Issue '||o_orderkey AS issue_title, o_orderstatus AS issue_type, 'raised' AS issue_status,
  o_orderpriority AS action_priority, CASE WHEN o_totalprice > 20000 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') END AS action_due_date,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%dT08:00:00Z') END AS action_completed_date,
  o_orderstatus <> 'F' AS is_open,
  o_orderstatus <> 'F' AND o_totalprice > 20000 AND o_orderdate < {AS_OF} AS is_overdue FROM orders""",
    "purchases": """
SELECT l.l_orderkey||'.0' AS purchase_id, any_value(o.o_custkey % 25) AS supplier_id, any_value('N'||o.o_orderkey) AS inv_number,
  any_value(o.o_totalprice) AS inv_amount, any_value(strftime(o.o_orderdate, '%Y-%m-%d')) AS invoice_date, count(*) AS line_count,
  sum(l.l_quantity * round(l.l_discount * 100)) AS computed_total, any_value(n.n_name) AS supplier_name
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey LEFT JOIN nation n ON n.n_nationkey = o.o_custkey % 25 GROUP BY l.l_orderkey""",
    "invoices0": """
SELECT 'I'||o_orderkey AS invoice_id, 'INV-'||o_orderkey AS invoice_number,
  CASE WHEN o_totalprice > 50000 THEN 'ACCREC' ELSE 'ACCPAY' END AS invoice_type,
  CASE o_orderstatus WHEN 'F' THEN 'PAID' ELSE 'AUTHORISED' END AS status,
  CASE WHEN o_totalprice < 490000 THEN 'Client '||(o_custkey % 40) END AS contact_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'sh-'||(25000 + o_orderkey % 100)||' | 4500'||o_orderkey
    WHEN '2-HIGH' THEN 'INV-'||substr(lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0'), 1, 6)
    WHEN '3-MEDIUM' THEN '  SH-'||(25000 + o_orderkey % 100) END AS reference,
  CASE WHEN o_orderpriority IN ('1-URGENT','3-MEDIUM') THEN 'SH-'||(25000 + o_orderkey % 100) END AS job_code,
  strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, strftime(o_orderdate, '%Y-%m') AS month,
  strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due_date, o_totalprice AS subtotal, o_totalprice AS total,
  CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE 0.0 END AS amount_paid, CASE o_orderstatus WHEN 'F' THEN 0.0 ELSE o_totalprice END AS amount_due
FROM orders WHERE o_orderstatus <> 'P'""",
    "invoices": "SELECT i.*, c.client AS bridge_client FROM invoices0 i LEFT JOIN code_client c USING (job_code)",
    "revenue": """
SELECT contact_name, month, count(*) AS invoices, round(sum(total),2) AS invoiced, round(sum(amount_paid),2) AS paid,
  round(sum(amount_due),2) AS outstanding FROM invoices WHERE invoice_type = 'ACCREC' AND contact_name IS NOT NULL GROUP BY 1, 2""",
    "audit": """
SELECT e.event_id AS change_log_id, strftime(e.ts, '%Y-%m-%dT%H:%M:%S') AS created_at, e.event_type, e.user_id AS opms_employee_id,
  p.first_name, p.last_name, '{"kind":"'||e.event_type||'","n":'||e.user_id||'}' AS value_before, CAST(e.event_id AS VARCHAR) AS value_after
FROM events e LEFT JOIN person p ON p.opms_employee_id = e.user_id""",
    "assignments": """
SELECT DISTINCT o_custkey AS opms_employee_id, 'Customer' AS first_name, lpad(CAST(o_custkey AS VARCHAR),9,'0') AS last_name,
  o_custkey % 10 AS opms_position_id, 'Role '||(o_custkey % 10) AS position_name, l_linenumber AS opms_site_id,
  'Site '||l_linenumber AS site_name, 'Team' AS team_name FROM linesx""",
    "licences": """
SELECT o_orderkey AS bms_licence_id, 'Customer' AS first_name, lpad(CAST(o_custkey AS VARCHAR),9,'0') AS last_name,
  o_custkey AS opms_employee_id, o_orderstatus AS licence, o_orderpriority AS licence_items FROM orders""",
    "files": """
SELECT coalesce(nullif(regexp_extract(url, '^https?://([^/]+)/', 1), ''), 'BMS') AS site,
  regexp_extract(regexp_extract(url, '^https?://([^/]+)/', 1), '([^.]+)$', 1) AS library,
  regexp_extract(url, '([^/]*)$', 1)||'.HTML' AS file_name, 'html' AS ext,
  regexp_replace(regexp_extract(url, '^https?://[^/]+/(.*?)[^/]*$', 1), '^/+', '') AS folder_path,
  round(length(html) / 1024.0, 1) AS size_kb, url AS web_url,
  TIMESTAMP '2000-01-01 01:02:03' + to_days(CAST(page_id AS INTEGER)) AS modified_at, 'u'||(page_id % 7) AS modified_by
FROM (SELECT * FROM pages WHERE length(html) > 1000 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)""",
    "link_cells": """
SELECT page_id AS jobid, 'Job '||page_id AS title, 'quote_link' AS "column", 'IMS/Ops:'||page_id||'<#>'||url||'<->open' AS cell,
  page_id AS item_id, url FROM pages
UNION ALL SELECT page_id, 'Job '||page_id, 'contract_link', CASE WHEN length(html) > 4000 THEN 'IMS/Ops:'||page_id||'<#>'||url||'-old<->open'
  WHEN length(html) > 2000 THEN 'nan' END, CASE WHEN length(html) > 4000 THEN page_id END, CASE WHEN length(html) > 4000 THEN url||'-old' END FROM pages
UNION ALL SELECT page_id, 'Job '||page_id, 'photo_link', CASE WHEN length(html) > 3000 THEN 'IMS/Ops<#>'||url||'/gone' END, NULL,
  CASE WHEN length(html) > 3000 THEN url||'/gone' END FROM pages""",
    "links": """
SELECT c.*, CASE WHEN c.url IS NULL THEN 'missing' WHEN EXISTS (SELECT 1 FROM files f WHERE f.web_url = c.url) THEN 'ok' ELSE 'broken' END AS status
FROM link_cells c""",
    "calls": """
SELECT event_id AS call_id, ts, user_id AS "user", CASE WHEN event_type <> 'signup' THEN event_type END AS tool, event_type||'_fn' AS function,
  event_type <> 'error' AS ok, greatest(CAST(json_extract(props,'$.k') AS INTEGER) - 10, 0) AS row_count,
  CASE WHEN value > 20 THEN 'High' ELSE 'Medium' END AS confidence, CASE WHEN value < 3 THEN 'No, that is wrong' ELSE 'show hours' END AS question
FROM events""",
    "usage": """
SELECT *, coalesce(nq LIKE 'No,%', FALSE) AS corrected, coalesce(nt = tool AND NOT nq LIKE 'No,%', FALSE) AS followed_up FROM (
  SELECT *, lead(question) OVER w AS nq, lead(tool) OVER w AS nt FROM calls WINDOW w AS (PARTITION BY "user" ORDER BY ts, call_id))""",
    "runs": """
SELECT event_id AS run_id, 'job '||user_id AS automation, 'job '||user_id AS job, ts AS updated_at, ts AS started,
  CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type <> 'signup' THEN 'success' END AS conclusion,
  CASE WHEN event_type IN ('error','click','view') THEN 'Failed' ELSE 'Succeeded' END AS status FROM events""",
    "traces": """
SELECT concat_ws('-', q.conv_id, q.turn) AS trace_id, q.conv_id AS conversation_id, q.turn,
  TIMESTAMP '2024-01-01' + to_hours(CAST(q.conv_id AS INTEGER)) + to_minutes(CAST(q.turn AS INTEGER)) AS ts,
  CASE WHEN length(q.text) > 200 THEN 'Last week: '||q.text ELSE q.text END AS question,
  CASE WHEN length(q.text) < 90 THEN 'Tool error: '||a.text ELSE a.text END AS answer,
  CASE WHEN length(q.text) % 2 = 0 THEN 'deterministic' ELSE 'gateway' END AS engine, length(q.text) < 60 AS needs_clarification,
  CASE WHEN length(q.text) > 400 THEN 1 ELSE 0 END AS validator_errors,
  CASE WHEN length(q.text) > 250 THEN '{"date_from": "2024-01-01"}' ELSE '{}' END AS args,
  CASE WHEN length(q.text) > 100 THEN 'Westlake' END AS entity, CASE WHEN length(q.text) > 120 THEN 'site westlake' END AS resolved_terms,
  CASE WHEN length(q.text) > 80 THEN 'timesheet' END AS tool, CASE WHEN length(q.text) > 80 THEN 'get_weekly_timesheet' END AS function,
  length(a.text) % 5 AS result_rows, CASE WHEN length(a.text) > 300 THEN 'High' ELSE 'Low' END AS confidence
FROM (SELECT * FROM conversations WHERE role = 'user') q LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a
  ON a.conv_id = q.conv_id AND a.turn = q.turn""",
    "traced": """
SELECT t.*, CASE WHEN length(question) > 150 THEN 'wrong hours' ELSE 'fine' END AS user_feedback, length(question) > 150 AS correction_flag FROM traces t""",
}


def _uses(text: str) -> list[str]:
    return [n for n in TWIN if re.search(rf"(?<![.\w'\"]){n}(?![\w'(])", text)]


def sql(body: str) -> str:
    """The query with every stand-in definition it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _uses(TWIN[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for name in _uses(body):
        visit(name)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({TWIN[n].strip()})" for n in order)
    head = "WITH RECURSIVE " if body.lstrip().upper().startswith("WITH RECURSIVE") else "WITH "
    rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", ",\n", body, flags=re.I) if re.match(r"\s*WITH\b", body, re.I) else "\n" + body.strip()
    return head + ctes + rest
