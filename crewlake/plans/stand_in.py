"""Domain tables built from the driver's generic tables.

The given data knows customers, orders, line items, events and pages; the library knows
workers, rosters, sheets, sign-out forms and files.  Each property below lends given rows
the source field names of one feed, whole table for whole table.  Nothing is sampled.
``twins.py`` states the same tables in SQL for the correctness check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewlake.operators import gold as G
from crewlake.operators import jobs as J
from crewlake.operators import reconcile as R
from crewlake.operators import silver as D
from crewlake.sources.files import file_facts, file_index
from crewlake.sources.flatten import flatten_mirror

AS_OF = "2000-06-01"
FIELD_TRADES = ("ring", "bolt")


def job_code(key: str) -> Column:
    return F.concat(F.lit("SH-"), (F.lit(25000) + F.col(key) % 100).cast("string"))


def iso(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._raw[name]

    # --- lists -----------------------------------------------------------------------------
    @cached_property
    def employees(self) -> DataFrame:
        c = self.raw("customer")
        name = F.split("c_name", "#")
        return c.select(
            F.col("c_custkey").alias("id"), name[0].alias("first_name"), name[1].alias("last_name"),
            F.lit(None).cast("string").alias("middle_name"), F.col("c_name").alias("preferred_name"),
            F.lit("1980-01-01").alias("date_of_birth"), F.struct(F.col("c_mktsegment").alias("name")).alias("gender"),
            F.struct(F.col("c_nationkey").cast("string").alias("name")).alias("nationality"),
            F.concat(F.lit("w"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("work_email_address"),
            F.concat(F.lit("04"), F.col("c_custkey").cast("string")).alias("work_phone"),
            F.struct(F.concat(F.lit("A"), F.col("c_nationkey").cast("string")).alias("code")).alias("home_airport"),
            F.col("c_custkey").alias("_pos"))

    @cached_property
    def people(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("OPMS"),
            F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("PersonID"),
            F.col("o_orderstatus").alias("Arrangement"), (F.col("o_totalprice") > 50000).alias("Active"),
            (F.col("o_orderkey") % 997 + 1000).alias("PositionLookupId"),
            (F.col("o_orderkey") % 5).alias("OpsSectionLookupId"), (F.col("o_orderkey") % 25).alias("SupplierLookupId"),
            F.concat(F.lit("Person "), F.col("o_orderkey").cast("string")).alias("Title"), F.col("o_orderkey").alias("_pos"))

    @cached_property
    def positions(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                                       F.struct(F.col("p_brand").alias("name")).alias("company"),
                                       F.col("p_type").alias("code1"))

    @cached_property
    def position_list(self) -> DataFrame:
        p = self.raw("part")
        first = p.filter("p_size > 10").select((F.col("p_partkey") + 1000).alias("id"), F.col("p_partkey").alias("OPMSID"),
                                               F.col("p_size").alias("AccessLevelLookupId"), F.lit(True).alias("ZActive"),
                                               F.col("p_partkey").alias("_pos"))
        again = p.filter("p_size > 40").select((F.col("p_partkey") + 1001).alias("id"), F.col("p_partkey").alias("OPMSID"),
                                               F.col("p_size").alias("AccessLevelLookupId"), F.lit(False).alias("ZActive"),
                                               (F.col("p_partkey") + 1000000000).alias("_pos"))
        return first.unionByName(again)

    @cached_property
    def sections(self) -> DataFrame:
        r = self.raw("region")
        return r.select(F.col("r_regionkey").alias("id"),
                        F.when(F.col("r_regionkey") == 0, "TRANSPORT & HIRE").otherwise(F.col("r_name")).alias("Title"))

    @cached_property
    def supplier_list(self) -> DataFrame:
        n = self.raw("nation")
        key = F.col("n_nationkey").cast("string")
        return n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("Title"),
                        (F.col("n_nationkey") % 2 == 0).alias("Active"), F.concat(F.lit("ABN"), key).alias("ABN"),
                        F.concat(F.lit("08"), key).alias("Phone"), F.concat(F.lit("s"), key, F.lit("@example.com")).alias("EmailContact"))

    @cached_property
    def projects(self) -> DataFrame:
        n = self.raw("nation")
        key = F.col("n_nationkey")
        return n.select(
            key.alias("id"), F.concat(F.lit("Project "), F.col("n_name")).alias("Title"),
            F.concat(F.lit("PC"), key.cast("string")).alias("ProjectID"),
            F.concat(F.lit("Stage "), F.col("n_regionkey").cast("string")).alias("Status"), (key % 3 != 0).alias("Active"),
            F.col("n_regionkey").alias("ClientLookupId"), F.col("n_regionkey").alias("OpsSectionLookupId"),
            F.lit("1995-01-01").alias("ProjectStartDate"),
            F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("C"), F.lpad(key.cast("string"), 4, "0"))).alias("ATitle"))

    @cached_property
    def clients(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("Title"),
                                         F.substring("r_name", 1, 3).alias("ClientShortName"))

    @cached_property
    def jobs(self) -> DataFrame:
        s = self.raw("supplier")
        key, nat = F.col("s_suppkey"), F.col("s_nationkey")
        status = (F.when(F.col("s_acctbal") < 2000, "COMPLETE/CLOSED").when(F.col("s_acctbal") < 5000, "In Progress")
                  .when(F.col("s_acctbal") < 7000, "Cancelled").otherwise("Requested"))
        return s.select(
            key.alias("id"), F.col("s_name").alias("Title"),
            F.concat(F.lit("sh-"), (key + 25000).cast("string"), F.lit("-A")).alias("JobID"), status.alias("JobStatus"),
            F.when(F.col("s_acctbal") > 5000, "True").otherwise("no").alias("Active"), nat.alias("ProjectLookupId"),
            (nat % 5).alias("ClientShortNameLookupId"), F.concat(nat.cast("string"), F.lit(".0")).alias("WorkLocationLookupId"),
            key.alias("MGLeadLookupId"), (nat % 5).alias("OpsSectionLookupId"), F.lit(False).alias("Overhead"),
            F.lit("2000-01-01").alias("Modified"), key.alias("_pos"))

    @cached_property
    def manual_map(self) -> DataFrame:
        r = self.raw("region")
        key = F.col("r_regionkey").cast("string")
        return r.select(F.concat(F.lit("Yard "), key).alias("resourceRequestProject"),
                        F.concat(F.lit("C9"), key).alias("resourceRequestClient"), F.col("r_regionkey").alias("_pos"))

    # --- feeds -----------------------------------------------------------------------------
    @cached_property
    def roster_feed(self) -> DataFrame:
        o = self.raw("orders")
        low = F.col("o_orderpriority") == "5-LOW"
        project = F.when(low, F.concat(F.lit("Yard "), (F.col("o_orderkey") % 7).cast("string"))).otherwise(
            F.concat(job_code("o_orderkey"), F.lit(" - "), F.col("o_orderpriority")))

        def one(offset: int) -> Column:
            return F.struct(
                iso(F.date_add(F.col("o_orderdate").cast("date"), offset)).alias("date"),
                F.struct((F.col("o_orderkey") % 10).alias("id"),
                         F.when(low, "Z. CRANE").otherwise(F.col("o_orderpriority")).alias("name")).alias("position"),
                F.struct(F.lit(1).cast("bigint").alias("id"), F.when(F.col("o_orderstatus") == "F", "Night Shift")
                         .otherwise("DAY SHIFT").alias("name")).alias("work_type"),
                F.when(F.col("o_orderstatus") == "O", F.array(F.lit("meal"), F.lit("travel"))).alias("allowances"),
                F.array(F.struct(F.struct(F.lit("").alias("project")).alias("resource_request")),
                        F.struct(F.struct(project.alias("project")).alias("resource_request"))).alias("resource_request_allocations"))
        return o.select(
            F.struct(F.col("o_custkey").alias("id"), F.lit("Customer").alias("first_name"),
                     F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("last_name")).alias("employee"),
            F.array(one(0), one(1)).alias("rostered_days"), F.col("o_orderkey").alias("_pos"))

    @cached_property
    def roster_list(self) -> DataFrame:
        o = self.raw("orders")
        low = F.col("o_orderpriority") == "5-LOW"
        # 16:30 UTC is the next day here; pending orders are listed a day late, so their worked day has no line
        moved = F.when(F.col("o_orderstatus") == "P", 0).otherwise(1)
        code = F.when(F.col("o_orderstatus") == "F", F.lower(job_code("o_orderkey"))).otherwise(job_code("o_orderkey"))
        return o.select(
            F.col("o_custkey").cast("string").alias("OPMS"),
            F.concat(iso(F.date_sub(F.col("o_orderdate").cast("date"), moved)), F.lit("T16:30:00Z")).alias("Date_x0020_From"),
            F.lit("Customer").alias("First_x0020_Name"),
            F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("Last_x0020_Name"),
            F.when(low, "Z. CRANE").otherwise(F.col("o_orderpriority")).alias("Position"),
            F.when(low, F.concat(F.lit("Yard "), (F.col("o_orderkey") % 7).cast("string"))).otherwise(
                F.concat(code, F.lit(" - list"))).alias("Project"),
            F.when(F.col("o_orderstatus") == "F", "Night Shift").otherwise("DAY SHIFT").alias("WorkType"),
            F.when(F.col("o_totalprice") > 100000, (F.col("o_orderkey") % 12 + 1).cast("double")).alias("Hours"),
            (F.col("o_orderkey") % 6).alias("SiteLookupId"),
            F.when(F.col("o_totalprice") > 250000, F.col("o_orderkey") % 25).alias("SupplierLookupId"),
            F.col("o_orderkey").alias("_pos"))

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with their order's worker and day.

        Both sides grow together, so this is a shuffled join at any scale worth planning for; saying
        so also spreads a small single-split file over all cores.
        """
        li, o = self.raw("lineitem"), self.raw("orders")
        return li.hint("merge").join(o.select("o_orderkey", "o_custkey", "o_orderdate"), li["l_orderkey"] == o["o_orderkey"])

    @cached_property
    def sheets(self) -> DataFrame:
        who = F.struct(F.col("o_custkey").alias("id"))
        first = F.struct(who.alias("employee"), F.col("l_quantity").alias("value"))
        extra = F.struct(who.alias("employee"), F.lit(1.0).alias("value"))
        return self.lines.select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("id"),
            F.col("l_linenumber").cast("string").alias("site_id"), F.col("l_suppkey").cast("string").alias("supervisor_id"),
            iso("o_orderdate").alias("date"), F.col("l_linestatus").alias("status"), iso("l_shipdate").alias("last_modified_date"),
            F.when(F.col("l_returnflag") == "R", F.array(first, extra)).otherwise(F.array(first)).alias("entries"))

    @cached_property
    def entries(self) -> DataFrame:
        return D.fact_timesheet(self.sheets)

    @cached_property
    def forms(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.concat(F.col("user_id").cast("string"), F.lit(".0")).alias("OPMS"),
            F.when(F.col("event_type") == "click", "Sign Out").when(F.col("event_type") == "view", " sign in ")
            .otherwise("Other").alias("Status"),
            F.date_format(F.col("ts") - F.expr("INTERVAL 24 YEARS"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Date"))

    @cached_property
    def sites(self) -> DataFrame:
        r = self.raw("region")
        return r.select((F.col("r_regionkey") + 1).cast("string").alias("id"), F.concat(F.lit("Site "), F.col("r_name")).alias("name"),
                        F.col("r_regionkey").alias("company_id"), F.col("r_regionkey").alias("area_id"))

    @cached_property
    def competencies(self) -> DataFrame:
        p = self.raw("part").groupBy("p_type").agg(F.min("p_brand").alias("b"), F.min("p_size").alias("y"))
        return p.select(F.struct(self.competency_id("p_type").alias("id"), F.col("p_type").alias("name"),
                                 F.struct(F.col("b").alias("name")).alias("group"), (F.col("y") > 1).alias("classified"),
                                 F.struct(F.col("y").alias("years")).alias("validity_period")).alias("competency"))

    @staticmethod
    def competency_id(c: str) -> Column:
        return (F.length(c) * 1000 + F.ascii(c)).cast("bigint")

    @cached_property
    def training_feed(self) -> DataFrame:
        p = self.raw("part").select("p_partkey", "p_type")
        held = self.lines.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey", "p_type").agg(
            F.max("l_shipdate").alias("last"), F.min("l_shipdate").alias("first"), F.max("l_returnflag").alias("flag"),
            F.count("*").alias("n"))
        return held.select(
            F.concat_ws("-", F.lit("T"), F.col("o_custkey").cast("string"), "p_type").alias("id"),
            F.struct(F.col("o_custkey").alias("id")).alias("worker"),
            F.struct(self.competency_id("p_type").alias("id"), F.col("p_type").alias("name")).alias("competency"),
            F.col("flag").alias("status"), iso("first").alias("issue_date"),
            F.when(F.col("n") > 1, iso("last")).alias("expiry_date"), (F.col("n") > 3).alias("has_document"),
            F.lit(None).cast("string").alias("document_number"), iso("last").alias("last_modified_date"))

    @cached_property
    def change_feed(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_date"),
            F.struct((F.col("user_id") + 1).alias("id")).alias("created_by"), F.col("event_type").alias("event"),
            F.struct(F.col("user_id").alias("id")).alias("employee"),
            F.struct(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("n")).alias("before"),
                     F.col("event_id").alias("after")).alias("display_values"))

    # --- dimensions ----------------------------------------------------------------------------
    @cached_property
    def person(self) -> DataFrame:
        return D.dim_person(self.employees, self.people)

    @cached_property
    def position(self) -> DataFrame:
        return D.dim_position(self.positions, self.position_list)

    @cached_property
    def project(self) -> DataFrame:
        return D.dim_project(self.projects)

    @cached_property
    def client(self) -> DataFrame:
        return D.dim_client(self.clients)

    @cached_property
    def supplier(self) -> DataFrame:
        return D.dim_supplier(self.supplier_list)

    @cached_property
    def job(self) -> DataFrame:
        return D.dim_job(self.jobs)

    @cached_property
    def site(self) -> DataFrame:
        return D.dim_site(self.sites)

    # --- gold ----------------------------------------------------------------------------------
    @cached_property
    def profile(self) -> DataFrame:
        return G.employee_profile(self.person, self.position, self.supplier, self.sections)

    @cached_property
    def certs(self) -> DataFrame:
        return G.training_compliance(D.fact_training(self.training_feed), self.person, D.dim_competency(self.competencies), AS_OF)

    @cached_property
    def resolver(self) -> G.ClientResolver:
        return G.ClientResolver.build(self.jobs, self.projects, self.clients, self.manual_map)

    @cached_property
    def roster(self) -> DataFrame:
        return G.roster_summary(self.roster_feed, self.roster_list, self.resolver)

    @cached_property
    def months(self) -> DataFrame:
        return R.timesheet_summary(self.entries, self.person, self.site)

    @cached_property
    def hours(self) -> DataFrame:
        return R.entered_hours(self.entries)

    @cached_property
    def gaps(self) -> DataFrame:
        return R.gap_hours(self.forms)

    def weekly_of(self, mode: str) -> DataFrame:
        return R.weekly_timesheet(self.roster_list, self.hours, self.gaps, R.roster_context(self.roster_feed), self.people,
                                  self.employees, self.sections, self.supplier_list, self.resolver.attach, mode)

    @cached_property
    def weekly(self) -> DataFrame:
        return self.weekly_of("default")

    @cached_property
    def bridge(self) -> DataFrame:
        return G.project_bridge(self.jobs, self.projects, self.clients, self.manual_map)

    @cached_property
    def project_jobs(self) -> DataFrame:
        return G.project_job_summary(self.project, self.client, self.job)

    @cached_property
    def nation_titles(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("Title"))

    @cached_property
    def job_details(self) -> DataFrame:
        return G.job_detail(self.job, self.project, self.client, self.person, self.nation_titles, self.sections)

    @cached_property
    def assets(self) -> DataFrame:
        p = self.raw("part")
        feed = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("Title"),
                        F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("AssetID"), F.col("p_type").alias("Status"),
                        F.col("p_brand").alias("Model"), (F.col("p_partkey") % 25).alias("ManufacturerLookupId"),
                        F.col("p_size").alias("LocationLookupId"), (F.col("p_partkey") % 5).alias("AssetGroupLookupId"))
        return G.asset_register(D.dim_asset(feed), self.nation_titles, self.nation_titles, self.sections)

    @cached_property
    def stock(self) -> DataFrame:
        p = self.raw("part")
        flat = p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("Title"),
                        F.when(F.col("p_size") <= 45, F.col("p_size")).alias("Stock"), F.lit(True).alias("Active"),
                        (F.col("p_partkey") % 25).alias("StoreLocationLookupId"), (F.col("p_partkey") % 5).alias("CategoryLookupId"))
        return G.inventory_summary(flat, self.nation_titles, self.sections)

    @cached_property
    def hardware(self) -> DataFrame:
        p = self.raw("part")
        flat = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("Title"), F.col("p_brand").alias("Code"),
                        F.col("p_type").alias("Status"), F.col("p_size").alias("InStock"), F.col("p_retailprice").alias("HirePrice"),
                        (F.col("p_partkey") % 5).alias("CategoryLookupId"))
        return G.hardware_register(flat, self.sections)

    @cached_property
    def rates(self) -> DataFrame:
        p = self.raw("part")
        flat = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("Title"),
                        F.concat((F.col("p_partkey") % 30).cast("string"), F.lit(".0")).alias("ProjectLookupId"),
                        F.col("p_retailprice").alias("DayShift"), (F.col("p_retailprice") + 100).alias("NightShift"),
                        F.col("p_brand").alias("ProjectID"))
        return G.rate_card(flat, self.project)

    @cached_property
    def ledger(self) -> DataFrame:
        li = self.raw("lineitem")
        flag = F.col("l_returnflag")
        flat = li.select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]).alias("id"),
            F.when(F.col("l_linestatus") == "F", "Stores Moved out").when(flag == "A", "Purchase to store").otherwise("Other").alias("Title"),
            F.col("l_quantity").alias("Units"), F.concat(F.col("l_partkey").cast("string"), F.lit(".0")).alias("ItemLookupId"),
            (F.col("l_partkey") % 30).alias("FromStoreLookupId"), (F.col("l_partkey") % 20).alias("ToStoreLookupId"),
            F.when(flag == "R", F.col("l_orderkey")).alias("PersonLookupId"), F.when(flag == "R", F.col("l_suppkey")).alias("ToJobLookupId"),
            F.when((flag == "N") & (F.col("l_linestatus") == "O"), F.col("l_orderkey").cast("string")).alias("FromPurchaseLookupId"),
            F.when(F.col("l_quantity") > 5, F.concat(iso("l_shipdate"), F.lit("T20:00:00Z"))).alias("CommitTime"),
            F.concat(iso("l_shipdate"), F.lit("T10:00:00Z")).alias("Created"))
        items = self.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("Title"), F.col("p_brand").alias("Code"))
        return G.ppe_transactions(flat, self.nation_titles, self.people.select("id", "Title", "_pos"), items, self.jobs, self.projects)

    @cached_property
    def actions(self) -> DataFrame:
        o = self.raw("orders")
        flat = o.select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("Issue "), F.col("o_orderkey").cast("string")).alias("Title"),
            F.col("o_orderstatus").alias("ItemType"), F.lit("raised").alias("Status"), F.col("o_orderpriority").alias("ActionPriority"),
            F.when(F.col("o_totalprice") > 20000, F.concat(iso("o_orderdate"), F.lit("T00:00:00Z"))).alias("ActionDueDate"),
            F.when(F.col("o_orderstatus") == "F", F.concat(iso("o_orderdate"), F.lit("T08:00:00Z"))).alias("ActionCompletedDate"),
            F.lit("detail").alias("IssueDetail"))
        return G.hseq_register(flat, AS_OF)

    @cached_property
    def purchase_lines(self) -> DataFrame:
        li, o = self.raw("lineitem"), self.raw("orders")
        items = li.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
            F.concat(F.col("l_orderkey").cast("string"), F.lit(".0")).alias("PurchaseLookupId"), F.col("l_partkey").alias("StoreItemLookupId"),
            F.col("l_quantity").alias("UnitCount"), F.round(F.col("l_discount") * 100).alias("UnitCost"))
        heads = o.select(F.col("o_orderkey").alias("id"), iso("o_orderdate").alias("InvDate"), (F.col("o_custkey") % 25).alias("SupplierLookupId"),
                         F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("InvNumber"), F.col("o_totalprice").alias("InvAmount"))
        return D.fact_purchase(items, heads)

    @cached_property
    def purchases(self) -> DataFrame:
        return G.purchase_summary(self.purchase_lines, self.supplier_list)

    @cached_property
    def invoices(self) -> DataFrame:
        o = self.raw("orders")
        key = F.col("o_orderkey").cast("string")
        status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
        ref = (F.when(prio == "1-URGENT", F.concat(F.lower(job_code("o_orderkey")), F.lit(" | 4500"), key))
               .when(prio == "2-HIGH", F.concat(F.lit("INV-"), F.lpad(key, 6, "0")))
               .when(prio == "3-MEDIUM", F.concat(F.lit("  "), job_code("o_orderkey"))).when(prio == "4-NOT SPECIFIED", ""))
        paid = F.when(status == "F", F.col("o_totalprice")).otherwise(0.0)
        feed = o.select(
            F.concat(F.lit("I"), key).alias("InvoiceID"), F.concat(F.lit("INV-"), key).alias("InvoiceNumber"),
            F.when(F.col("o_totalprice") > 50000, "ACCREC").otherwise("ACCPAY").alias("Type"),
            F.when(status == "F", "PAID").when(status == "O", "AUTHORISED").otherwise("VOIDED").alias("Status"),
            F.when(F.col("o_totalprice") < 490000, F.concat(F.lit("Client "), (F.col("o_custkey") % 40).cast("string"))).alias("Contact_Name"),
            ref.alias("Reference"), F.concat(iso("o_orderdate"), F.lit("T00:00:00")).alias("DateString"),
            F.concat(iso(F.date_add(F.col("o_orderdate").cast("date"), 30)), F.lit("T00:00:00")).alias("DueDateString"),
            F.col("o_totalprice").alias("SubTotal"), F.col("o_totalprice").alias("Total"), paid.alias("AmountPaid"),
            (F.col("o_totalprice") - paid).alias("AmountDue"))
        return G.invoice_register(feed, self.resolver)

    @cached_property
    def revenue(self) -> DataFrame:
        return G.revenue_summary(self.invoices)

    @cached_property
    def audit(self) -> DataFrame:
        return G.audit_activity(D.fact_change_log(self.change_feed), self.person)

    @cached_property
    def assignments(self) -> DataFrame:
        li = self.lines.select("o_custkey", "l_linenumber").distinct()
        nested = li.select(
            F.struct(F.col("o_custkey").alias("id"), F.lit("Customer").alias("first_name"),
                     F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("last_name")).alias("employee"),
            F.struct((F.col("o_custkey") % 10).alias("id"), F.concat(F.lit("Role "), (F.col("o_custkey") % 10).cast("string")).alias("name")).alias("position"),
            F.struct(F.col("l_linenumber").alias("id"), F.concat(F.lit("Site "), F.col("l_linenumber").cast("string")).alias("name")).alias("site"),
            F.struct(F.lit("Team").alias("name")).alias("team"))
        return G.site_assignment(flatten_mirror(nested))

    @cached_property
    def licences(self) -> DataFrame:
        o = self.raw("orders")
        flat = o.select(F.col("o_orderkey").alias("id"), F.lit("Customer").alias("FirstName"),
                        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("LastName"), F.col("o_custkey").alias("OPMS"),
                        F.col("o_orderstatus").alias("Licence"), F.col("o_orderpriority").alias("LicenceItems"))
        return G.licence_register(flat)

    @cached_property
    def ranking(self) -> DataFrame:
        c = self.raw("customer")
        flat = c.select(F.col("c_custkey").alias("id"), F.lit("Customer").alias("FirstName"), F.split("c_name", "#")[1].alias("LastName"),
                        F.col("c_custkey").alias("OPMS"), F.col("c_acctbal").alias("MobScoreIndex"), F.col("c_nationkey").alias("SiteScoreIndex"))
        return G.worker_ranking(flat)

    # --- files and links ----------------------------------------------------------------------
    @cached_property
    def file_items(self) -> DataFrame:
        p = self.raw("pages")
        host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
        return p.select(
            F.nullif(host, F.lit("")).alias("site"), F.regexp_extract(host, r"([^.]+)$", 1).alias("library"),
            F.concat(F.regexp_extract("url", r"([^/]*)$", 1), F.lit(".HTML")).alias("name"),
            F.concat(F.lit("/drives/d1/root:/"), F.regexp_extract("url", r"^https?://[^/]+/(.*?)[^/]*$", 1)).alias("parent_path"),
            F.length("html").alias("size"), (F.length("html") > 1000).alias("is_file"), F.col("url").alias("web_url"),
            F.concat(iso(F.date_add(F.lit("2000-01-01").cast("date"), F.col("page_id").cast("int"))), F.lit("T01:02:03Z")).alias("modified_at"),
            F.concat(F.lit("u"), (F.col("page_id") % 7).cast("string")).alias("modified_by"), F.col("page_id").alias("_pos"))

    @cached_property
    def files(self) -> DataFrame:
        return file_index(file_facts(self.file_items))

    @cached_property
    def link_rows(self) -> DataFrame:
        p = self.raw("pages")
        head = F.concat(F.lit("IMS/Ops:"), F.col("page_id").cast("string"), F.lit("<#>"))
        n = F.length("html")
        return p.select(
            F.col("page_id").alias("jobid"), F.concat(F.lit("Job "), F.col("page_id").cast("string")).alias("title"),
            F.concat(head, F.col("url"), F.lit("<->open")).alias("quote_link"),
            F.when(n > 4000, F.concat(head, F.col("url"), F.lit("-old<->open"))).when(n > 2000, "nan").alias("contract_link"),
            F.when(n > 3000, F.concat(F.lit("IMS/Ops<#>"), F.col("url"), F.lit("/gone"))).alias("photo_link"))

    @cached_property
    def links(self) -> DataFrame:
        cells = J.link_cells(self.link_rows, "jobid", "title", ["quote_link", "contract_link", "photo_link", "absent_link"])
        return J.link_audit(cells, self.files)

    @cached_property
    def link_locations(self) -> DataFrame:
        return self.raw("pages").select(F.lit("IMS/Ops").alias("library"), F.col("page_id").alias("item_id"), F.col("url").alias("web_url"))

    # --- logs -----------------------------------------------------------------------------------
    @cached_property
    def calls(self) -> DataFrame:
        e = self.raw("events")
        k = F.get_json_object("props", "$.k").cast("int")
        return e.select(
            F.col("event_id").alias("call_id"), "ts", F.col("user_id").alias("user"),
            F.when(F.col("event_type") != "signup", F.col("event_type")).alias("tool"),
            F.concat(F.col("event_type"), F.lit("_fn")).alias("function"), (F.col("event_type") != "error").alias("ok"),
            F.greatest(k - 10, F.lit(0)).alias("row_count"), F.when(F.col("value") > 20, "High").otherwise("Medium").alias("confidence"),
            F.when(F.col("value") < 3, "No, that is wrong").otherwise("show hours").alias("question"))

    @cached_property
    def usage(self) -> DataFrame:
        from crewlake.operators.logs import retro_signals
        return retro_signals(self.calls, ["user"], ["ts", "call_id"], F.date_trunc("day", F.col("ts")))

    @cached_property
    def runs(self) -> DataFrame:
        e = self.raw("events")
        kind = F.col("event_type")
        return e.select(
            F.col("event_id").alias("run_id"), F.concat(F.lit("job "), F.col("user_id").cast("string")).alias("automation"),
            F.concat(F.lit("job "), F.col("user_id").cast("string")).alias("job"), F.col("ts").alias("updated_at"), F.col("ts").alias("started"),
            F.when(kind == "error", "failure").when(kind != "signup", "success").alias("conclusion"),
            F.when(kind.isin("error", "click", "view"), "Failed").otherwise("Succeeded").alias("status"))

    @cached_property
    def traces(self) -> DataFrame:
        c = self.raw("conversations")
        asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
        said = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
        n = F.length("q")
        rows = asked.join(said, ["conv_id", "turn"], "left")
        return rows.select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("trace_id"),
            F.col("conv_id").alias("conversation_id"), "turn",
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"))).alias("ts"),
            F.when(n > 200, F.concat(F.lit("Last week: "), F.col("q"))).otherwise(F.col("q")).alias("question"),
            F.when(n < 90, F.concat(F.lit("Tool error: "), F.col("a"))).otherwise(F.col("a")).alias("answer"),
            F.when(n % 2 == 0, "deterministic").otherwise("gateway").alias("engine"), (n < 60).alias("needs_clarification"),
            F.when(n > 400, 1).otherwise(0).alias("validator_errors"),
            F.when(n > 250, '{"date_from": "2024-01-01"}').otherwise("{}").alias("args"),
            F.when(n > 100, "Westlake").alias("entity"), F.when(n > 120, "site westlake").alias("resolved_terms"),
            F.when(n > 80, "timesheet").alias("tool"), F.when(n > 80, "timesheet").alias("selected_tool"),
            F.when(n > 80, "get_weekly_timesheet").alias("function"),
            F.when(F.col("a").isNotNull(), F.length("a") % 5).alias("result_rows"),
            F.when(F.length("a") > 300, "High").otherwise("Low").alias("confidence"))

    @cached_property
    def feedback(self) -> DataFrame:
        t = self.traces
        first = t.select("trace_id", F.lit("fine").alias("user_feedback"), F.lit(False).alias("correction_flag"), "ts")
        later = t.filter(F.length("question") > 150).select(
            "trace_id", F.lit("wrong hours").alias("user_feedback"), F.lit(True).alias("correction_flag"),
            (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
        return first.unionByName(later)
