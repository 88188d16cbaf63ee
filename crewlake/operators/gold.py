"""Denormalised gold tables.

Joins to dimensions are plain equi-joins on normalised keys.  No broadcast is forced:
worker, job and supplier lists grow with the business, so Spark decides from their
measured size, and hot keys are split by adaptive execution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlake.functions.ordered import latest
from crewlake.functions.scalars import (
    AsOf,
    day,
    expiry_flags,
    invoice_job_code,
    iso_date,
    job_prefix,
    key_of,
    local_date,
    local_date_month,
    lookup_key,
    normalise_job_id,
    spread_nulls,
    text,
    to_int,
    to_number,
    truthy,
)
from crewlake.operators.reconcile import roster_days
from crewlake.operators.silver import get, lookup_title
from crewlake.sources.flatten import pick

# --- fixed values ------------------------------------------------------------------------
DEAD_INVOICE = ["DELETED", "VOIDED"]
SALES, COUNTED_INVOICE = "ACCREC", ["AUTHORISED", "PAID"]
MOVE_TITLE, STOCK_TITLE = "Stores Moved", "Purchase to store"
OFF_SHIFT = "OFF"
REVENUE_COLUMNS = "contact_name string, month string, invoices bigint, invoiced double, paid double, outstanding double"

SITE_ASSIGNMENT = {"employee.id": "opms_employee_id", "employee.first_name": "first_name",
                   "employee.last_name": "last_name", "position.id": "opms_position_id",
                   "position.name": "position_name", "site.id": "opms_site_id", "site.name": "site_name",
                   "team.name": "team_name"}
INVENTORY = {"id": "bms_store_id", "Title": "item_name", "Stock": "stock", "Active": "is_active",
             "StoreLocationLookupId": "location_id", "CategoryLookupId": "category_id",
             "EffectiveDate": "effective_date"}
HARDWARE = {"id": "bms_hardware_id", "Title": "hardware_name", "Code": "code", "Status": "status",
            "InStock": "in_stock", "HirePrice": "hire_price", "Active": "is_active",
            "CategoryLookupId": "category_id"}
RATES = {"id": "bms_rate_id", "Title": "rate_title", "ProjectLookupId": "bms_project_id",
         "PositionLookupId": "bms_position_id", "DayShift": "day_shift_rate", "NightShift": "night_shift_rate",
         "ProjectID": "project_code"}
LICENCES = {"id": "bms_licence_id", "FirstName": "first_name", "LastName": "last_name", "OPMS": "opms_employee_id",
            "Licence": "licence", "LicenceItems": "licence_items", "Mobile": "mobile", "WorkEmail": "email_work",
            "PositionLookupId": "bms_position_id"}
RANKING = {"id": "bms_ranking_id", "FirstName": "first_name", "LastName": "last_name", "OPMS": "opms_employee_id",
           "SiteScoreIndex": "site_score", "MobScoreIndex": "mob_score", "MobScore0": "mob_score_raw",
           "MobTest": "mob_test"}
HSEQ = {"id": "bms_issue_id", "Title": "issue_title", "ItemType": "issue_type", "Status": "issue_status",
        "ActionPriority": "action_priority", "Investigation": "Investigation", "ActionStartDate": "ActionStartDate",
        "ActionDueDate": "action_due_date", "ActionCompletedDate": "action_completed_date",
        "IssueDetail": "IssueDetail", "ActionPlan": "ActionPlan", "CauseDetail": "CauseDetail",
        "CompletionNotes": "CompletionNotes", "Modified": "Modified", "Created": "Created"}
LEDGER = {"id": "bms_txn_id", "Title": "title", "Units": "units", "ItemLookupId": "item_id",
          "FromStoreLookupId": "from_location_id", "ToStoreLookupId": "to_location_id",
          "PersonLookupId": "person_id", "ToJobLookupId": "job_id", "FromPurchaseLookupId": "purchase_id",
          "CommitTime": "commit_time", "Created": "created_at"}
# -------------------------------------------------------------------------------------------


def match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """Join on the numeric spelling of two id columns; keys that are not numbers never match."""
    r = right.withColumn("_rk", key_of(right, right_key)).drop(right_key)
    key = key_of(left, left_key)
    return left.withColumn("_lk", spread_nulls(left, key) if how == "left" else key).join(r, F.col("_lk") == F.col("_rk"), how).drop("_lk", "_rk")


# --- people -----------------------------------------------------------------------------------

def employee_profile(person: DataFrame, position: DataFrame, supplier: DataFrame, sections: DataFrame) -> DataFrame:
    """G1."""
    roles = latest(position.filter(lookup_key("bms_position_id").isNotNull())
                   .select(lookup_key("bms_position_id").alias("bms_position_id"), "position_name", "company_name",
                           get(position, "opms_position_id").alias("_o")),
                   ["bms_position_id"], ["_o"], first=True).drop("_o")
    out = match(person, roles, "bms_position_id", "bms_position_id")
    out = match(out, supplier.select("bms_supplier_id", "supplier_name"), "bms_supplier_id", "bms_supplier_id")
    return lookup_title(out, "ops_section_id", sections, "ops_section_name")


def training_compliance(training: DataFrame, person: DataFrame, competency: DataFrame, as_of: AsOf) -> DataFrame:
    """Certificates with holder, group and expiry flags as of a given day."""
    who = person.select("opms_employee_id", "first_name", "last_name", "arrangement_type", "is_active")
    groups = competency.select("opms_competency_id", "group_name", "validity_years", "classified")
    out = match(training.join(who, "opms_employee_id", "left"), groups, "competency_id", "opms_competency_id")
    return out.withColumns(expiry_flags("expiry_date", as_of))


def supplier_summary(supplier: DataFrame, person: DataFrame) -> DataFrame:
    """G18."""
    heads = (person.select(lookup_key("bms_supplier_id").alias("_s")).filter("_s IS NOT NULL")
             .groupBy("_s").agg(F.count("*").alias("worker_count")))
    out = supplier.join(heads, lookup_key("bms_supplier_id") == F.col("_s"), "left").drop("_s")
    return out.withColumn("worker_count", F.coalesce("worker_count", F.lit(0)).cast("bigint"))


def audit_activity(change_log: DataFrame, person: DataFrame) -> DataFrame:
    """G21."""
    return change_log.join(person.select("opms_employee_id", "first_name", "last_name"), "opms_employee_id", "left")


def site_assignment(flat: DataFrame) -> DataFrame:
    return pick(flat, SITE_ASSIGNMENT)


def licence_register(flat: DataFrame) -> DataFrame:
    return pick(flat, LICENCES)


def worker_ranking(flat: DataFrame) -> DataFrame:
    return pick(flat, RANKING)


# --- projects and clients ---------------------------------------------------------------------

BRIDGE = ["job_code", "job_title", "bms_project_id", "project_name", "client_code", "client_name",
          "opms_project_name", "source"]


def _manual(mapping: DataFrame) -> DataFrame:
    rows = mapping.select(text("resourceRequestProject").alias("name"), text("resourceRequestClient").alias("client"),
                          get(mapping, "_pos", "bigint").alias("_pos"))
    return rows.filter("name IS NOT NULL AND client IS NOT NULL")


def _job_rows(jobs: DataFrame, projects: DataFrame, clients: DataFrame) -> DataFrame:
    coded = jobs.select(job_prefix("JobID").alias("job_code"), F.col("Title").alias("job_title"),
                        F.col("ProjectLookupId").cast("string").alias("_p"),
                        get(jobs, "_pos", "bigint").alias("_pos")).filter("job_code IS NOT NULL")
    proj = projects.select(F.col("id").cast("string").alias("_p"), F.col("id").alias("bms_project_id"),
                           F.col("Title").alias("project_name"), F.col("ATitle").alias("client_code"),
                           F.col("ClientLookupId").cast("string").alias("_c"))
    cli = clients.select(F.col("id").cast("string").alias("_c"), F.col("Title").alias("client_name"))
    return coded.join(proj, "_p").join(cli, "_c", "left").drop("_p", "_c")


def project_bridge(jobs: DataFrame, projects: DataFrame, clients: DataFrame, manual: DataFrame) -> DataFrame:
    """Job-code rows from the job list plus the hand-kept project-to-client map."""
    listed = (_job_rows(jobs, projects, clients)
              .withColumn("opms_project_name", F.lit(None).cast("string"))
              .withColumn("source", F.lit("jms_bridge")))
    none = F.lit(None).cast("string")
    kept = _manual(manual).select(
        job_prefix("name").alias("job_code"), none.alias("job_title"),
        F.lit(None).cast(listed.schema["bms_project_id"].dataType).alias("bms_project_id"),
        none.alias("project_name"), F.col("client").alias("client_code"), none.alias("client_name"),
        F.col("name").alias("opms_project_name"), F.lit("manual_map").alias("source"))
    return listed.select(*BRIDGE).unionByName(kept)


@dataclass(frozen=True)
class ClientResolver:
    """Project text -> client, exact manual entries before the job-code prefix."""

    by_name: DataFrame
    by_code: DataFrame

    @staticmethod
    def build(jobs: DataFrame, projects: DataFrame, clients: DataFrame, manual: DataFrame) -> ClientResolver:
        names = latest(_manual(manual), ["name"], ["_pos"]).select("name", F.col("client").alias("_named"))
        rows = _job_rows(jobs, projects, clients).select(
            "job_code", F.coalesce(text("client_code"), text("client_name")).alias("_coded"), "_pos")
        codes = latest(rows, ["job_code"], ["_pos"], first=True).select(F.col("job_code").alias("_code"), "_coded")
        return ClientResolver(names, codes)

    def attach(self, df: DataFrame, project: str = "project_name", into: str = "client_name") -> DataFrame:
        keyed = df.withColumn("_name", spread_nulls(df, F.trim(project))).withColumn("_prefix", spread_nulls(df, job_prefix(project)))
        out = (keyed.join(self.by_name, F.col("_name") == F.col("name"), "left").drop("name")
               .join(self.by_code, F.col("_prefix") == F.col("_code"), "left").drop("_code"))
        return out.withColumn(into, F.coalesce("_named", "_coded")).drop("_name", "_prefix", "_named", "_coded")


def roster_summary(roster: DataFrame, lines: DataFrame, resolver: ClientResolver) -> DataFrame:
    """Both roster feeds in one shape, dates local, client resolved."""
    cols = ["opms_employee_id", "first_name", "last_name", "roster_date", "position_name", "work_type_name",
            "project_name", "hours", "source"]
    feed = (roster_days(roster)
            .withColumn("opms_employee_id", to_int("opms_employee_id"))
            .withColumn("roster_date", iso_date(local_date("date")))
            .withColumn("hours", F.lit(None).cast("double")).withColumn("source", F.lit("opms")))
    listed = lines.select(
        to_int("OPMS").alias("opms_employee_id"), F.col("First_x0020_Name").alias("first_name"),
        F.col("Last_x0020_Name").alias("last_name"), iso_date(local_date("Date_x0020_From")).alias("roster_date"),
        F.col("Position").alias("position_name"), F.col("WorkType").alias("work_type_name"),
        F.col("Project").alias("project_name"), to_number("Hours").alias("hours"), F.lit("bms").alias("source"))
    return resolver.attach(feed.select(*cols).unionByName(listed))


def project_job_summary(project: DataFrame, client: DataFrame, job: DataFrame) -> DataFrame:
    """Projects with their job counts; projects without jobs keep a NULL count."""
    counts = (job.select(lookup_key("bms_project_id").alias("_p"), truthy("is_active").alias("_a"))
              .groupBy("_p").agg(F.count("*").alias("job_count"), F.count_if("_a").alias("active_job_count")))
    out = project.join(counts, lookup_key("bms_project_id") == F.col("_p"), "left").drop("_p")
    return match(out, client.select("bms_client_id", "client_name"), "bms_client_id", "bms_client_id")


def job_detail(job: DataFrame, project: DataFrame, client: DataFrame, lead: DataFrame, locations: DataFrame,
               sections: DataFrame, lead_key: str = "bms_person_id") -> DataFrame:
    """Jobs with project, client, lead and titles.  ``lead_key`` is the id the lead column refers to."""
    out = match(job, project.select("bms_project_id", "project_name"), "bms_project_id", "bms_project_id")
    out = match(out, client.select("bms_client_id", "client_name"), "bms_client_id", "bms_client_id")
    people = lead.select(lead_key, F.col("first_name").alias("lead_first_name"),
                         F.col("last_name").alias("lead_last_name"))
    out = match(out, people, "mg_lead_person_id", lead_key)
    return lookup_title(lookup_title(out, "work_location_id", locations, "work_location_name"),
                        "ops_section_id", sections, "ops_section_name")


def rate_card(flat: DataFrame, project: DataFrame) -> DataFrame:
    out = pick(flat, RATES)
    return match(out, project.select("bms_project_id", "project_name"), "bms_project_id", "bms_project_id")


# --- assets and stock -----------------------------------------------------------------------------

def asset_register(asset: DataFrame, manufacturers: DataFrame, locations: DataFrame, groups: DataFrame) -> DataFrame:
    out = lookup_title(asset, "manufacturer_id", manufacturers, "manufacturer_name")
    out = lookup_title(out, "location_id", locations, "location_name")
    return lookup_title(out, "asset_group_id", groups, "asset_group_name")


def hardware_register(flat: DataFrame, categories: DataFrame) -> DataFrame:
    return lookup_title(pick(flat, HARDWARE), "category_id", categories, "category_name")


def inventory_summary(flat: DataFrame, locations: DataFrame, categories: DataFrame) -> DataFrame:
    out = lookup_title(pick(flat, INVENTORY), "location_id", locations, "location_name")
    return lookup_title(out, "category_id", categories, "category_name")


def movement_kind(person: Column, purchase: Column, title: Column) -> Column:
    """A person makes it a sign-out whatever else is set; a purchase beats a store move."""
    t = F.coalesce(title, F.lit(""))
    return (F.when(person.isNotNull(), "sign_out")
            .when(purchase.isNotNull() | t.startswith(STOCK_TITLE), "stock_in")
            .when(t.startswith(MOVE_TITLE), "store_move").otherwise("other"))


def ppe_transactions(flat: DataFrame, locations: DataFrame, people: DataFrame, items: DataFrame, jobs: DataFrame,
                     projects: DataFrame) -> DataFrame:
    """Movement ledger, one row per transaction with all ids resolved."""
    out = pick(flat, LEDGER)
    txn_date, txn_month = local_date_month("commit_time", "created_at")
    out = (out.withColumn("txn_date", txn_date).withColumn("txn_month", txn_month)
           .withColumn("txn_kind", movement_kind(key_of(out, "person_id"), key_of(out, "purchase_id"), F.col("title"))))
    out = lookup_title(out, "from_location_id", locations, "from_location")
    out = lookup_title(out, "to_location_id", locations, "to_location")
    out = lookup_title(out, "person_id", people, "person_name")
    goods = items.select(F.col("id").alias("_item"), F.col("Title").alias("item_name"), F.col("Code").alias("item_code"))
    out = match(out, goods, "item_id", "_item")
    named = lookup_title(jobs.select(F.col("id").alias("_job"), F.col("Title").alias("job_title"),
                                     F.col("JobID").alias("job_code"), "ProjectLookupId"),
                         "ProjectLookupId", projects, "project_name", keep_key=False)
    return match(out, named, "job_id", "_job").drop("commit_time", "created_at", "purchase_id")


# --- safety ------------------------------------------------------------------------------------------

def hseq_register(flat: DataFrame, as_of: AsOf) -> DataFrame:
    """An action without completion date is open; open and past its due date is overdue."""
    out = pick(flat, HSEQ)
    due = text("action_due_date").try_cast("timestamp_ntz")
    done = text("action_completed_date").try_cast("timestamp_ntz")
    late = F.coalesce(due < day(as_of).cast("timestamp_ntz"), F.lit(False))
    return out.withColumn("is_open", done.isNull()).withColumn("is_overdue", done.isNull() & late)


# --- money ---------------------------------------------------------------------------------------------

def purchase_summary(purchase: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One row per purchase with header values, line count and computed total."""
    total = to_number("unit_count") * to_number("unit_cost")
    # header values of the first line that has one, in the order of the line ids
    line = F.col("purchase_item_id") if "purchase_item_id" in purchase.columns else None
    head = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(c) if line is None else line)).alias(c) for c in ("supplier_id", "inv_number", "inv_amount", "invoice_date")]
    out = purchase.groupBy("purchase_id").agg(*head, F.count("*").alias("line_count"),
                                              F.coalesce(F.sum(total), F.lit(0.0)).alias("computed_total"))
    return lookup_title(out, "supplier_id", suppliers, "supplier_name")


def invoice_register(invoices: DataFrame, resolver: ClientResolver) -> DataFrame:
    """Live invoices with the job code mined from the reference."""
    def amount(name: str) -> Column:
        return F.coalesce(to_number(name), F.lit(0.0))

    def first_ten(name: str) -> Column:
        return F.nullif(F.substring(F.col(name), 1, 10), F.lit(""))

    alive = invoices.filter(F.col("Status").isNull() | ~F.col("Status").isin(DEAD_INVOICE))
    rows = alive.select(
        F.col("InvoiceID").alias("invoice_id"), F.col("InvoiceNumber").alias("invoice_number"),
        F.col("Type").alias("invoice_type"), F.col("Status").alias("status"),
        F.col("Contact_Name").alias("contact_name"), F.nullif("Reference", F.lit("")).alias("reference"),
        invoice_job_code("Reference").alias("job_code"), first_ten("DateString").alias("invoice_date"),
        F.substring(first_ten("DateString"), 1, 7).alias("month"), first_ten("DueDateString").alias("due_date"),
        amount("SubTotal").alias("subtotal"), amount("Total").alias("total"),
        amount("AmountPaid").alias("amount_paid"), amount("AmountDue").alias("amount_due"))
    return resolver.attach(rows, "job_code", "bridge_client")


def revenue_summary(register: DataFrame | None, spark=None) -> DataFrame:
    """Counted sales invoices per client and month; no source gives an empty typed table."""
    if register is None or "invoice_type" not in register.columns:
        return spark.createDataFrame([], REVENUE_COLUMNS)
    sales = register.filter((F.col("invoice_type") == SALES) & F.col("status").isin(COUNTED_INVOICE)
                            & F.col("contact_name").isNotNull() & F.col("month").isNotNull())
    return sales.groupBy("contact_name", "month").agg(
        F.count("invoice_id").alias("invoices"), F.round(F.sum("total"), 2).alias("invoiced"),
        F.round(F.sum("amount_paid"), 2).alias("paid"), F.round(F.sum("amount_due"), 2).alias("outstanding"))


# --- quotes and ratings -------------------------------------------------------------------------------------

def _working(desc: Column) -> Column:
    d = F.trim(F.coalesce(desc, F.lit("")))
    return (d != "") & (F.upper(d) != OFF_SHIFT)


def _roles(path: str) -> Column:
    """Role lines without their rates."""
    slim = F.transform(path, lambda r: F.struct(r["id"].cast("string").alias("id"), r["role"].alias("role"),
                                                r["qty"].cast("double").alias("qty")))
    return F.coalesce(slim, F.array().cast("array<struct<id:string,role:string,qty:double>>"))


def quote_hours(quotes: DataFrame) -> DataFrame:
    """Quoted hours per job and role from the newest version that has people planned.

    Rates are never read.  Everything about one quote version sits in one record, so the
    arithmetic runs on its arrays and only choosing the version needs a shuffle.
    """
    p = "payload."
    planned = F.exists(F.map_values(F.coalesce(F.col(p + "manning"), F.create_map().cast("map<string,map<string,string>>"))),
                       lambda days: F.exists(F.map_values(days), _working))
    roles = F.concat(_roles(p + "staff_roles"), _roles(p + "new_roles"))
    slim = quotes.filter(planned).select(
        normalise_job_id("job_code").alias("job_code"), "uploaded_at", "job_title",
        F.transform(p + "shift_types", lambda s: F.struct(s["desc"].alias("desc"), s["hrs"].cast("double").alias("hrs"),
                                                          s["type"].alias("type"))).alias("shifts"),
        F.col(p + "manning").alias("manning"), roles.alias("roles"))
    newest = latest(slim, ["job_code"], ["uploaded_at"])
    rows = newest.select("job_code", "uploaded_at", "job_title", "shifts", "manning", F.explode("roles").alias("r"))

    def known(night: bool) -> Column:
        """Hours of each planned day of one shift type; a shift named twice counts as last defined."""
        def hours_of(desc: Column) -> Column:
            same = F.filter(F.col("shifts"), lambda s: F.trim(s["desc"]) == F.trim(desc))
            return F.try_element_at(same, F.lit(-1))
        days = F.filter(F.coalesce(F.map_values(F.try_element_at("manning", F.col("r.id"))), F.array().cast("array<string>")),
                        _working)
        shifts = F.filter(F.transform(days, hours_of), lambda s: s.isNotNull())
        is_night = F.filter(shifts, lambda s: (F.coalesce(F.upper(s["type"]), F.lit("")) == "NS") == F.lit(night))
        return F.transform(is_night, lambda s: F.coalesce(s["hrs"], F.lit(0.0)))

    def add(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    qty = F.coalesce(F.col("r.qty"), F.lit(0.0))
    ds, ns = known(False), known(True)
    return rows.select(
        "job_code", "uploaded_at", "job_title", F.trim("r.role").alias("role"), qty.alias("qty"),
        (F.size(ds) * qty).cast("bigint").alias("ds_shifts"), (F.size(ns) * qty).cast("bigint").alias("ns_shifts"),
        F.round(add(ds) * qty, 1).alias("ds_hours"), F.round(add(ns) * qty, 1).alias("ns_hours"),
        F.round((add(ds) + add(ns)) * qty, 1).alias("total_hours"))


def quote_totals(hours: DataFrame) -> DataFrame:
    return hours.groupBy("job_code", "job_title").agg(
        F.round(F.sum("ds_hours"), 1).alias("ds_hours"), F.round(F.sum("ns_hours"), 1).alias("ns_hours"),
        F.round(F.sum("total_hours"), 1).alias("total_hours"))


def rating_average(ratings: DataFrame, person: str = "PersonLookupId", data: str = "RankingData",
                   extra: float | None = None) -> DataFrame:
    """Mean of all comma-separated numeric scores per person, and the mean with one more score."""
    scores = ratings.select(person, F.explode(F.split(F.coalesce(data, F.lit("")), ",")).alias("t"))
    out = scores.select(person, F.trim("t").try_cast("double").alias("s")).filter("s IS NOT NULL").groupBy(person).agg(
        F.count("s").alias("scores"), F.sum("s").alias("_sum"))
    out = out.withColumn("average", F.round(F.col("_sum") / F.col("scores"), 2))
    if extra is not None:
        out = out.withColumn("projected", F.round((F.col("_sum") + float(extra)) / (F.col("scores") + 1), 2))
    return out.drop("_sum")
