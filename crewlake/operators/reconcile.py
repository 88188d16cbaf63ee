"""From raw sheets, rosters and sign-out forms to trustworthy hours.

Hot keys: every rule that picks "the best of several" is written as an aggregation, so
copies of one sheet or one worker-day collapse on the map side.  The only ordered rule,
sign-out pairing, cuts each worker's history into buckets (``functions.ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewlake.functions.ordered import latest, neighbour
from crewlake.functions.scalars import (
    first_project,
    id_of,
    iso_date,
    key_of,
    local_date,
    local_ts,
    micros,
    month_of,
    norm_id,
    number_of,
    plain_ts,
    shift_type,
    spread_nulls,
    text,
    to_int,
    wall_ts,
)
from crewlake.operators.silver import get

# --- fixed values ------------------------------------------------------------------------
MAX_CROSS_DAY_HOURS = 6
OUT, IN = "sign out", "sign in"
PLANT_PREFIX, PLANT_SITE = "Z.", "TRANSPORT & HIRE"
SOURCE_SHEET, SOURCE_ROSTER, SOURCE_NONE, SOURCE_BACKFILL = "opms", "bms_writeback", "none", "opms_no_bms_roster"
# -------------------------------------------------------------------------------------------

SHEET_KEY = ("opms_employee_id", "timesheet_date", "site_id")
WEEKLY = ["opms_employee_id", "first_name", "last_name", "position_name", "project_name", "client_name",
          "site_name", "supplier_name", "work_date", "shift_type", "roster_hours", "gap_hours",
          "actual_hours", "hours_source"]


# --- G3: the winning sheet ---------------------------------------------------------------------

def _sheet_rank() -> Column:
    """Newest modification wins; equal times go to the higher sheet id, so reruns agree."""
    return F.struct("modified", "timesheet_id")


def sheet_sums(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key and sheet: hours, entries and last modification.

    All three buffers have a fixed width, so Spark hashes instead of sorting, and entries
    collapse before the shuffle.  Times that cannot be read rank lowest.
    """
    return rows.groupBy(*key, "timesheet_id").agg(
        F.sum("hours").alias("hours"), F.count("*").alias("entries"), F.max("modified").alias("modified"))


def _ranked(entries: DataFrame) -> DataFrame:
    # cleaned once in a step of its own: expressions that use a text several times would repeat the cleaning
    rows = entries.withColumns({"_m": text("modified_at"), "hours": number_of(entries, "hours")})
    return rows.withColumn("modified", micros(plain_ts(F.col("_m")))).drop("_m")


def winning_sheets(entries: DataFrame, key: Sequence[str] = SHEET_KEY) -> DataFrame:
    """The one sheet per (worker, date, site) that counts."""
    return sheet_sums(_ranked(entries), key).groupBy(*key).agg(F.max_by("timesheet_id", _sheet_rank()).alias("timesheet_id"))


def winning_sheet(entries: DataFrame, key: Sequence[str] = SHEET_KEY) -> DataFrame:
    """Entries of the winning sheets.

    One winner row per key is joined back on key and sheet, so a key with very many entries
    is an ordinary hot partition of a sort-merge join, which Spark splits at run time.
    """
    won = winning_sheets(entries, key)
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*key, "timesheet_id"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return entries.alias("e").join(won.alias("w"), cond, "left_semi")


# --- G4: monthly summary -----------------------------------------------------------------------

def timesheet_months(entries: DataFrame) -> DataFrame:
    """Hours of the winning sheets per worker, site and month, without a join back.

    Each sheet is summed first; then the best sheet's sums are picked; then months are
    added.  Three partial aggregations, so any key may be hot.
    """
    sheets = sheet_sums(_ranked(entries), SHEET_KEY)
    best = sheets.groupBy(*SHEET_KEY).agg(F.max_by(F.struct("hours", "entries"), _sheet_rank()).alias("s"))
    return best.groupBy("opms_employee_id", "site_id", month_of("timesheet_date").alias("month")).agg(
        F.coalesce(F.sum("s.hours"), F.lit(0.0)).alias("total_hours"), F.sum("s.entries").alias("entry_count"))


def timesheet_summary(entries: DataFrame, person: DataFrame, site: DataFrame) -> DataFrame:
    """Monthly hours with names; rows without worker, site or month are kept."""
    names = person.select("opms_employee_id", "first_name", "last_name")
    sites = site.select(F.col("opms_site_id").alias("site_id"), "site_name")
    return timesheet_months(entries).join(names, "opms_employee_id", "left").join(sites, "site_id", "left")


# --- G5: hours per worker-day -------------------------------------------------------------------

def entered_hours(entries: DataFrame) -> DataFrame:
    """(opms, work_date, hours): sheet sums, best sheet per site, then all sites of the day.

    ``entries`` is the flat sheet fact; hours that are not numbers count as zero.
    """
    rows = entries.select(
        id_of(entries, "opms_employee_id").alias("opms"), text("timesheet_date").alias("_d"), "site_id", "timesheet_id",
        text("modified_at").alias("_m"), F.coalesce(number_of(entries, "hours"), F.lit(0.0)).alias("hours"))
    rows = rows.withColumns({"work_date": wall_ts(F.col("_d")).cast("date"), "modified": micros(plain_ts(F.col("_m")))}).filter(
        "opms IS NOT NULL AND work_date IS NOT NULL")
    key = ["opms", "work_date", "site_id"]
    best = sheet_sums(rows, key).groupBy(*key).agg(F.max_by("hours", _sheet_rank()).alias("hours"))
    return best.groupBy("opms", "work_date").agg(F.round(F.sum("hours"), 2).alias("hours"))


def live_worker_hours(entries: DataFrame, date_from: str, date_to: str, worker_id: int | str | None = None) -> DataFrame:
    """daily hours in a range straight from the newest landing, under the G5 rule."""
    inside = entries.filter(local_date("timesheet_date").between(F.lit(date_from).cast("date"),
                                                                  F.lit(date_to).cast("date")))
    if worker_id is not None:
        inside = inside.filter(norm_id("opms_employee_id") == str(worker_id))
    return entered_hours(inside).select("opms", iso_date("work_date").alias("work_date"), "hours")


# --- G6/G7: sign-out gaps --------------------------------------------------------------------------

def hour_bucket(ts: str = "ts") -> Column:
    return F.date_trunc("hour", F.col(ts))


def gap_pairs(forms: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(opms, started, ended, hours) of sign-outs with their next sign-in.

    A pair exists exactly where a sign-in directly follows a sign-out of the same worker;
    a repeated sign-out replaces the open one and a sign-in without one is ignored.
    """
    events = forms.select(
        norm_id("OPMS").alias("opms"), F.lower(text("Status")).alias("status"), local_ts("Date").alias("ts"),
        F.when(F.lower(text("Status")) == OUT, 0).otherwise(1).alias("is_in"),
    ).filter(F.col("opms").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(OUT, IN))
    near = neighbour(events, ["opms"], ["ts", "is_in"], hour_bucket() if bucket is None else bucket,
                     ["status", "ts"])
    micros = F.timestamp_diff("MICROSECOND", F.col("prev.ts"), F.col("ts"))
    hours = micros / 3_600_000_000
    same_day = F.col("prev.ts").cast("date") == F.col("ts").cast("date")
    return (near.filter((F.col("status") == IN) & (F.col("prev.status") == OUT))
            .select("opms", F.col("prev.ts").alias("started"), F.col("ts").alias("ended"), hours.alias("hours"),
                    same_day.alias("same_day"))
            .filter((F.col("hours") > 0) & (F.col("same_day") | (F.col("hours") <= MAX_CROSS_DAY_HOURS)))
            .drop("same_day"))


def split_midnight(pairs: DataFrame, keys: Sequence[str] = ("opms",)) -> DataFrame:
    """Hours per key and calendar day of intervals that may cross midnight."""
    first, last = F.col("started").cast("date"), F.col("ended").cast("date")
    days = pairs.withColumn("work_date", F.explode(F.sequence(first, last)))
    start = F.greatest("started", F.col("work_date").cast("timestamp_ntz"))
    end = F.least("ended", F.date_add("work_date", 1).cast("timestamp_ntz"))
    piece = F.timestamp_diff("MICROSECOND", start, end) / 3_600_000_000
    return (days.select(*keys, "work_date", piece.alias("piece")).filter("piece > 0")
            .groupBy(*keys, "work_date").agg(F.round(F.sum("piece"), 2).alias("gap_hours")))


def gap_hours(forms: DataFrame) -> DataFrame:
    return split_midnight(gap_pairs(forms))


# --- G8: roster context ------------------------------------------------------------------------------

def roster_days(roster: DataFrame) -> DataFrame:
    """Exploded roster feed with position in the feed and the day's project."""
    rows = roster.select(get(roster, "_pos", "bigint").alias("_pos"), "employee",
                         F.posexplode("rostered_days").alias("_day", "d"))
    return rows.select(
        "_pos", "_day", F.col("employee.id").alias("opms_employee_id"),
        get(rows, "employee.first_name").alias("first_name"), get(rows, "employee.last_name").alias("last_name"),
        F.col("d.date").alias("date"), get(rows, "d.position.name").alias("position_name"),
        get(rows, "d.work_type.name").alias("work_type_name"),
        first_project("d.resource_request_allocations").alias("project_name"),
    )


def roster_context(roster: DataFrame) -> DataFrame:
    """The first roster row of each worker-day."""
    days = roster_days(roster)
    days = days.select(
        id_of(days, "opms_employee_id").alias("opms"), local_date("date").alias("work_date"), "_pos", "_day",
        "first_name", "last_name", "position_name", "work_type_name", "project_name",
    ).filter("opms IS NOT NULL AND work_date IS NOT NULL")
    return latest(days, ["opms", "work_date"], ["_pos", "_day"], first=True).drop("_pos", "_day")


# --- G9/G10: weekly timesheet ----------------------------------------------------------------------------

def people_supplier(people: DataFrame) -> DataFrame:
    """Supplier id per worker from the people list; the first entry that has one wins."""
    rows = people.select(id_of(people, "OPMS").alias("opms"), key_of(people, "SupplierLookupId").alias("supplier_id"),
                         get(people, "_pos", "bigint").alias("_pos"))
    return latest(rows.filter("opms IS NOT NULL AND supplier_id IS NOT NULL"), ["opms"], ["_pos"],
                  first=True).drop("_pos")


def roster_lines(lines: DataFrame) -> DataFrame:
    """Roster list rows with a usable worker and date, in contract names."""
    return lines.select(
        id_of(lines, "OPMS").alias("opms"), local_date("Date_x0020_From").alias("work_date"),
        F.col("First_x0020_Name").alias("first_name"), F.col("Last_x0020_Name").alias("last_name"),
        text("Position").alias("position_name"), F.col("Project").alias("project_name"),
        text("WorkType").alias("work_type"), number_of(lines, "Hours").alias("line_hours"),
        key_of(lines, "SiteLookupId").alias("site_id"), key_of(lines, "SupplierLookupId").alias("supplier_id"),
        get(lines, "_pos", "bigint").alias("_pos"),
    ).filter("opms IS NOT NULL AND work_date IS NOT NULL")


def _titles(lists: DataFrame, key: str, into: str) -> DataFrame:
    return lists.select(key_of(lists, "id").alias(key), F.col("Title").alias(into)).filter(F.col(key).isNotNull())


def _finish(rows: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    gap = F.coalesce("gap_hours", zero)
    return rows.select(
        to_int("opms").alias("opms_employee_id"), "first_name", "last_name", "position_name", "project_name",
        "client_name", "site_name", "supplier_name", iso_date("work_date").alias("work_date"),
        shift_type("work_type").alias("shift_type"), F.round("roster_hours", 2).alias("roster_hours"),
        F.round(gap, 2).alias("gap_hours"),
        F.round(F.greatest(zero, F.col("roster_hours") - gap), 2).alias("actual_hours"), "hours_source",
    )


def weekly_timesheet(lines: DataFrame, hours: DataFrame, gaps: DataFrame, context: DataFrame, people: DataFrame,
                     employees: DataFrame, sections: DataFrame, suppliers: DataFrame, with_client,
                     mode: str = "default") -> DataFrame:
    """G9 + G10: one row per roster line with reconciled hours, then worker-days nobody rostered.

    ``with_client(df)`` adds ``client_name`` for ``project_name``.  Two roster lines of one
    worker-day both receive the day's entered hours under ``mode='reference'``, which counts
    the day twice; by default only the first line carries hours and gap, later ones get 0.
    """
    all_lines = roster_lines(lines)
    fallback = people_supplier(people)
    site_names = _titles(sections, "site_id", "site_name")
    supplier_names = _titles(suppliers, "supplier_id", "supplier_name")
    own = supplier_names.withColumnRenamed("supplier_name", "own_name")
    listed = fallback.join(supplier_names, "supplier_id", "left").select("opms", F.col("supplier_name").alias("list_name"))

    plant = F.upper("position_name").startswith(PLANT_PREFIX) & (F.upper(F.trim("site_name")) == PLANT_SITE)
    sited = all_lines.withColumn("site_id", spread_nulls(all_lines, F.col("site_id"))).join(site_names, "site_id", "left").filter(~F.coalesce(plant, F.lit(False)))
    if mode != "reference" and "_pos" not in lines.columns:
        raise ValueError("roster lines need their position (_pos): without it the first line of a day is unknown")
    day = ["opms", "work_date"]
    # everything known about a worker-day in one row: entered hours, gaps, and its first roster line (plant lines were
    # dropped above, so they do not cover a day)
    known = (hours.select(*day, "hours").unionByName(gaps.select(*day, "gap_hours"), allowMissingColumns=True)
             .unionByName(sited.select(*day, F.col("_pos").alias("_first"), F.lit(True).alias("_lined")), allowMissingColumns=True)
             .groupBy(*day).agg(F.max("hours").alias("hours"), F.max("gap_hours").alias("gap_hours"), F.min("_first").alias("_first"),
                                F.coalesce(F.bool_or("_lined"), F.lit(False)).alias("_lined")))
    # one row per line, and one for each entered day that nobody rostered; all take the same way from here
    rows = known.filter("_lined OR hours IS NOT NULL").join(sited, day, "left")
    if mode != "reference":
        # only the first line of a day keeps hours
        later = F.coalesce(F.col("_pos") > F.col("_first"), F.lit(False))
        rows = (rows.withColumn("hours", F.when(later & F.col("hours").isNotNull(), F.lit(0.0)).otherwise(F.col("hours")))
                .withColumn("gap_hours", F.when(~later, F.col("gap_hours"))))

    names = latest(employees.select(id_of(employees, "id").alias("opms"), F.col("first_name").alias("_fn"),
                                    F.col("last_name").alias("_ln"), get(employees, "_pos", "bigint").alias("_pos")),
                   ["opms"], ["_pos"], first=True).drop("_pos")
    about = {"first_name": "_cf", "last_name": "_cl", "position_name": "_cp", "project_name": "_cj", "work_type_name": "_cw"}
    lined, not_plant = F.col("_lined"), ~F.coalesce(F.upper(F.trim("_cp")).startswith(PLANT_PREFIX), F.lit(False))
    rows = rows.join(context.select(*day, *[F.col(c).alias(n) for c, n in about.items()]), day, "left").filter(lined | not_plant)
    rows = rows.withColumn("supplier_id", spread_nulls(rows, F.col("supplier_id"))).join(own, "supplier_id", "left").join(names, "opms", "left").join(listed, "opms", "left")

    def either(line: str, other: Column) -> Column:
        return F.when(lined, F.col(line)).otherwise(other)

    both = rows.withColumns({
        "first_name": either("first_name", F.coalesce(text("_cf"), F.col("_fn"))),
        "last_name": either("last_name", F.coalesce(text("_cl"), F.col("_ln"))),
        "position_name": either("position_name", text("_cp")), "project_name": either("project_name", F.col("_cj")),
        "work_type": either("work_type", F.col("_cw")), "roster_hours": F.coalesce("hours", "line_hours", F.lit(0.0)),
        "hours_source": F.when(~lined, SOURCE_BACKFILL).when(F.col("hours").isNotNull(), SOURCE_SHEET)
        .when(F.col("line_hours").isNotNull(), SOURCE_ROSTER).otherwise(SOURCE_NONE),
        "supplier_name": F.coalesce("own_name", "list_name")})
    return _finish(with_client(both)).select(*WEEKLY)
