"""Queries for sources, gates and reports that need more than one step (S7, S13, S14, Q4, Q12, I7, F42, F51, A5, join keys)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.operators import analytics as A
from crewlake.operators import govern as V
from crewlake.operators import quality as Q
from crewlake.operators import serve as S
from crewlake.plans.q_controls import ISSUE_BASE, issues
from crewlake.plans.registry import add
from crewlake.plans.stand_in import Tables
from crewlake.session import shared_folder
from crewlake.sources import bronze, gold_io
from crewlake.sources.flatten import auto_tables
from crewlake.streaming.incremental import VersionGate


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/crewlake-{uuid.uuid4().hex}"


def _typed(t: Tables) -> DataFrame:
    """The rows of a list under the columns of its empty, typed form."""
    empty = bronze.schema_only(t.spark, t.raw("supplier").columns)
    rows = t.raw("supplier").select(*[F.col(c).cast("string").alias(c) for c in ("s_suppkey", "s_name", "s_nationkey")])
    return empty.select(*rows.columns).unionByName(rows)


add("schema_only", _typed, "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")


def _exported(t: Tables) -> DataFrame:
    path = f"{_folder(t)}/affected"
    gold_io.export_affected(t.certs.filter("is_expired").select("training_record_id", "opms_employee_id", "expiry_date"), path)
    return t.spark.read.option("header", True).schema("training_record_id string, opms_employee_id bigint, expiry_date string").csv(path)


add("export_affected", _exported, "SELECT training_record_id, opms_employee_id, expiry_date FROM certs WHERE is_expired")


def _log(t: Tables) -> DataFrame:
    """Turns as a JSON log in which every system line is cut short."""
    path = f"{_folder(t)}/log"
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    t.raw("conversations").select(F.when(F.col("role") == "system", F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return bronze.read_log(t.spark, path, "conv_id long, turn long, role string, text string")


add("read_log", _log, "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations WHERE role <> 'system'")


def _baseline(t: Tables, strict: bool) -> DataFrame:
    was = t.raw("orders").groupBy(F.col("o_orderstatus").alias("key")).agg(F.count("*").alias("rows"))
    now = was.withColumn("rows", F.col("rows") + 1)
    report = was.select(F.lit("WARN").alias("level"), "key", F.lit("few rows").alias("detail"))
    return Q.next_baseline(now, was, report, strict)


add("next_baseline", lambda t: _baseline(t, False), "SELECT o_orderstatus AS key, count(*) + 1 AS rows FROM orders GROUP BY 1")
add("next_baseline_strict", lambda t: _baseline(t, True), "SELECT o_orderstatus AS key, count(*) AS rows FROM orders GROUP BY 1")
add("issue_rollup_entity", lambda t: Q.issue_rollup(issues(t), t.raw("nation").select(F.lit("certificates").alias("entity")).distinct(), "entity").filter("issues > 0"), f"""
{ISSUE_BASE} SELECT entity, count(*) AS issues, CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END)
  WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS severity FROM iss WHERE entity = 'certificates' GROUP BY 1""")


def _gated(t: Tables) -> DataFrame:
    """The table after its version moved: the reload is what the second question gets."""
    versions = iter([1, 2])
    loads = iter([t.raw("region"), t.raw("nation")])
    gate = VersionGate(lambda: next(versions), lambda: next(loads), ttl=0.0)
    gate.table()
    return gate.table().select("n_nationkey", "n_name")


add("version_gate", _gated, "SELECT n_nationkey, n_name FROM nation")


def _sources(t: Tables) -> DataFrame:
    """Rows and caveat of one question on a source that is there and on one that is not."""
    def answer(name: str, table: DataFrame | None) -> DataFrame:
        rows, note = S.or_insufficient(table, lambda x: S.get_outstanding_invoices(x, "Finance"), name)
        return rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("source"), "rows", F.lit(note).cast("string").alias("caveat"))
    return answer("invoice_register", t.invoices).unionByName(answer("aged_debt", bronze.table_or_none(t.spark, "aged_debt_not_loaded")))


add("absent_source", _sources, """
SELECT 'invoice_register' AS source, count(*) AS rows, CAST(NULL AS VARCHAR) AS caveat FROM invoices WHERE invoice_type = 'ACCREC' AND status = 'AUTHORISED' AND amount_due > 0
UNION ALL SELECT 'aged_debt', 0, 'insufficient_data: aged_debt is not loaded; no figure may be substituted'""")


def _forms(t: Tables) -> dict[str, DataFrame]:
    d = t.raw("documents")
    return auto_tables({"FDS-Daily Sheets": d.select(F.col("doc_id").alias("id"), "lang", "source"), "FDS-Gas Test": d.select(F.col("doc_id").alias("id"), "text")})


add("list_form_tables", lambda t: S.list_form_tables(t.spark, _forms(t)).join(
    _forms(t)["fds_gas_test"].agg(F.count("*").alias("rows")).withColumn("table", F.lit("fds_gas_test")), "table", "left"), """
SELECT 'fds_daily_sheets' AS "table", 'lang, source' AS fields, CAST(NULL AS BIGINT) AS rows UNION ALL SELECT 'fds_gas_test', 'text', count(*) FROM documents""")
add("form_table", lambda t: S.form_table(_forms(t), "Daily sheets")[1].select("id", "lang"), "SELECT doc_id AS id, lang FROM documents")
add("drill_through_month", lambda t: A.drill_through(t.profile, t.certs, t.roster, month="2000-09").select("first_name", "last_name", "competency_name", "expiry_date"), """
SELECT first_name, last_name, competency_name, expiry_date FROM certs WHERE expiry_date LIKE '2000-09%'""")
add("join_published", lambda t: V.join_published(t.profile.select("opms_employee_id", "supplier_name"), t.assignments.select("opms_employee_id", "site_name"), "opms_employee_id"), """
SELECT opms_employee_id, supplier_name, site_name FROM profile JOIN assignments USING (opms_employee_id)""")
