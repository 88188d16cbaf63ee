"""Conformed dimensions and facts.

Each table is a projection over raw records.  Source columns that a feed does not
deliver become NULL, so every table has one fixed shape.  ``_pos`` is the record's
position in its landing and decides which duplicate wins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlake.functions.ordered import latest
from crewlake.functions.scalars import key_of, lookup_key, spread_nulls, stringify, text, to_int
from crewlake.sources.bronze import unwrap

POS = "_pos"


def source_field(df: DataFrame, path: str) -> T.DataType | None:
    kind: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return kind


def get(df: DataFrame, path: str, kind: str = "string") -> Column:
    """Nested field by path, or a typed NULL when the feed does not have it."""
    if source_field(df, path) is None:
        return F.lit(None).cast(kind)
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def shape(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Project ``{output: source path}``."""
    return df.select(*[get(df, path).alias(name) for name, path in fields.items()])


# --- fixed values: published column -> source field -----------------------------------
PERSON_EMPLOYEE = {
    "opms_employee_id": "id", "first_name": "first_name", "last_name": "last_name",
    "middle_name": "middle_name", "preferred_name": "preferred_name", "date_of_birth": "date_of_birth",
    "gender_name": "gender.name", "nationality_name": "nationality.name", "email_work": "work_email_address",
    "phone_work": "work_phone", "home_airport_code": "home_airport.code",
}
PERSON_LIST = {
    "bms_person_id": "id", "person_id": "PersonID", "arrangement_type": "Arrangement", "is_active": "Active",
    "bms_position_id": "PositionLookupId", "ops_section_id": "OpsSectionLookupId",
    "bms_supplier_id": "SupplierLookupId",
}
POSITION_FEED = {"opms_position_id": "id", "position_name": "name", "company_name": "company.name",
                 "code1": "code1", "code2": "code2", "code3": "code3"}
POSITION_LIST = {"bms_position_id": "id", "access_level_id": "AccessLevelLookupId", "is_active": "ZActive"}
PROJECT = {"bms_project_id": "id", "project_name": "Title", "project_code": "ProjectID", "status": "Status",
           "is_active": "Active", "bms_client_id": "ClientLookupId", "ops_section_id": "OpsSectionLookupId",
           "project_start_date": "ProjectStartDate", "modified_at": "Modified"}
CLIENT = {"bms_client_id": "id", "client_name": "Title", "client_short_name": "ClientShortName",
          "address": "Address", "vendor_number": "VENDOR_x0023_", "is_active": "Active", "modified_at": "Modified"}
COMPANY = {"company_id": "id", "company_name": "name"}
SITE = {"opms_site_id": "id", "site_name": "name", "company_id": "company_id", "area_id": "area_id"}
SUPPLIER = {"bms_supplier_id": "id", "supplier_name": "Title", "is_active": "Active", "abn": "ABN",
            "phone": "Phone", "email": "EmailContact", "website": "Website", "address": "Adress",
            "opms_supplier_ref": "OPMS"}
ASSET = {"bms_asset_id": "id", "asset_name": "Title", "asset_id": "AssetID", "status": "Status", "model": "Model",
         "serial_number": "SerialNumber", "manufacturer_id": "ManufacturerLookupId",
         "location_id": "LocationLookupId", "asset_group_id": "AssetGroupLookupId", "is_active": "Active",
         "opms_asset_ref": "OPMS", "modified_at": "Modified"}
JOB = {"bms_job_id": "id", "job_title": "Title", "job_code": "JobID", "job_status": "JobStatus",
       "is_active": "Active", "bms_project_id": "ProjectLookupId", "bms_client_id": "ClientShortNameLookupId",
       "work_location_id": "WorkLocationLookupId", "mg_lead_person_id": "MGLeadLookupId",
       "ops_section_id": "OpsSectionLookupId", "is_overhead": "Overhead", "modified_at": "Modified"}
COMPETENCY = {"opms_competency_id": "id", "competency_name": "name", "group_name": "group.name",
              "classified": "classified", "validity_years": "validity_period.years"}
TRAINING = {"training_record_id": "id", "opms_employee_id": "worker.id", "competency_id": "competency.id",
            "competency_name": "competency.name", "status": "status", "issue_date": "issue_date",
            "expiry_date": "expiry_date", "document_number": "document_number", "has_document": "has_document",
            "modified_at": "last_modified_date"}
INVENTORY_TXN = {"bms_inv_transaction_id": "id", "title": "Title", "units": "Units",
                 "store_item_id": "ItemLookupId", "to_store_id": "ToStoreLookupId",
                 "from_purchase_id": "FromPurchaseLookupId", "modified_at": "Modified"}
# ----------------------------------------------------------------------------------------


def _matched(feed: DataFrame, feed_fields: Mapping[str, str], listed: DataFrame, list_fields: Mapping[str, str],
             list_key: str, feed_key: str) -> DataFrame:
    """Feed rows with the matching list row; of several list rows with one key the last wins."""
    keyed = listed.select(
        to_int(get(listed, list_key)).alias("_key"), get(listed, POS, "bigint").alias(POS),
        *[get(listed, path).alias(name) for name, path in list_fields.items()],
    ).filter(F.col("_key").isNotNull())
    one = latest(keyed, ["_key"], [POS]).drop(POS)
    return shape(feed, feed_fields).join(one, F.col(feed_key) == F.col("_key"), "left").drop("_key")


def dim_person(employees: DataFrame, people: DataFrame) -> DataFrame:
    """D1."""
    return _matched(employees, PERSON_EMPLOYEE, people, PERSON_LIST, "OPMS", "opms_employee_id")


def dim_position(positions: DataFrame, listed: DataFrame) -> DataFrame:
    """D2."""
    return _matched(positions, POSITION_FEED, listed, POSITION_LIST, "OPMSID", "opms_position_id")


def dim_project(df: DataFrame) -> DataFrame:
    return shape(df, PROJECT)


def dim_client(df: DataFrame) -> DataFrame:
    return shape(df, CLIENT)


def dim_company(df: DataFrame) -> DataFrame:
    return shape(df, COMPANY)


def dim_site(df: DataFrame) -> DataFrame:
    return shape(df, SITE)


def dim_supplier(df: DataFrame) -> DataFrame:
    return shape(df, SUPPLIER)


def dim_asset(df: DataFrame) -> DataFrame:
    return shape(df, ASSET)


def dim_job(df: DataFrame) -> DataFrame:
    return shape(df, JOB)


def dim_competency(df: DataFrame) -> DataFrame:
    """Records arrive bare or wrapped as ``{competency: {..}}``."""
    return shape(unwrap(df, "competency"), COMPETENCY)


def fact_roster(roster: DataFrame) -> DataFrame:
    """One row per rostered day."""
    days = roster.select("employee", F.explode("rostered_days").alias("d"))
    return days.select(
        get(days, "employee.id", "bigint").alias("opms_employee_id"),
        get(days, "d.date").alias("roster_date"),
        get(days, "d.position.id", "bigint").alias("position_id"),
        get(days, "d.position.name").alias("position_name"),
        get(days, "d.work_type.id", "bigint").alias("work_type_id"),
        get(days, "d.work_type.name").alias("work_type_name"),
        F.size(F.coalesce(F.col("d.allowances"), F.array())).alias("allowance_count"),
    )


def fact_timesheet(sheets: DataFrame) -> DataFrame:
    """One row per entry of a sheet."""
    rows = sheets.withColumn("e", F.explode("entries"))
    return rows.select(
        get(rows, "id").alias("timesheet_id"), get(rows, "site_id").alias("site_id"),
        get(rows, "supervisor_id").alias("supervisor_id"), get(rows, "date").alias("timesheet_date"),
        get(rows, "status").alias("status"), get(rows, "e.employee.id").alias("opms_employee_id"),
        get(rows, "e.value", "double").alias("hours"), get(rows, "e.level1.name").alias("level1_name"),
        get(rows, "e.level2.name").alias("level2_name"), get(rows, "e.allowance.id").alias("allowance_id"),
        get(rows, "last_modified_date").alias("modified_at"),
    )


def fact_training(records: DataFrame) -> DataFrame:
    """D7."""
    return shape(records, TRAINING)


def fact_change_log(events: DataFrame) -> DataFrame:
    """Before and after may be text, number or nested; all become text."""

    def side(name: str) -> Column:
        kind = source_field(events, f"display_values.{name}")
        return F.lit(None).cast("string") if kind is None else stringify(F.col(f"display_values.{name}"), kind)

    return events.select(
        get(events, "id").alias("change_log_id"), get(events, "created_date").alias("created_at"),
        get(events, "created_by.id").alias("created_by_id"), get(events, "event").alias("event_type"),
        get(events, "employee.id").alias("opms_employee_id"),
        side("before").alias("value_before"), side("after").alias("value_after"),
    )


def fact_inventory_txn(rows: DataFrame) -> DataFrame:
    """D7."""
    return shape(rows, INVENTORY_TXN)


def purchase_key(c: Column) -> Column:
    """Numeric spelling first, else the raw value."""
    return F.coalesce(lookup_key(c), text(c))


def fact_purchase(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Purchase lines with their header."""
    head = headers.select(
        purchase_key(F.col("id")).alias("_key"), get(headers, "InvDate").alias("invoice_date"),
        get(headers, "SupplierLookupId").alias("supplier_id"), get(headers, "InvNumber").alias("inv_number"),
        get(headers, "InvAmount", "double").alias("inv_amount"),
    )
    lines = items.select(
        purchase_key(F.col("PurchaseLookupId")).alias("_key"), get(items, "id").alias("purchase_item_id"),
        F.col("PurchaseLookupId").alias("purchase_id"), get(items, "StoreItemLookupId").alias("store_item_id"),
        get(items, "UnitCount", "double").alias("unit_count"), get(items, "UnitCost", "double").alias("unit_cost"),
    )
    return lines.join(head, "_key", "left").drop("_key")


def lookup_title(df: DataFrame, key: str, titles: DataFrame, into: str, *, title: str = "Title",
                 keep_key: bool = True) -> DataFrame:
    """Resolve a lookup id to the title kept in another list.

    A plain left equi-join: Spark broadcasts the list when its size is small enough and
    shuffles (splitting hot keys) when it is not; rows without a key are spread over all tasks.
    """
    names = titles.select(key_of(titles, "id").alias("_k"), F.col(title).alias(into)).filter("_k IS NOT NULL")
    one = latest(names, ["_k"], [into]) if "_pos" not in titles.columns else latest(
        titles.select(key_of(titles, "id").alias("_k"), F.col(title).alias(into), "_pos").filter("_k IS NOT NULL"),
        ["_k"], ["_pos"]).drop("_pos")
    out = df.withColumn("_lk", spread_nulls(df, key_of(df, key))).join(one, F.col("_lk") == F.col("_k"), "left").drop("_lk", "_k")
    return out if keep_key else out.drop(key)
