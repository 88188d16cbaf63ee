"""Column expressions shared by every layer.

All of them are built-in Spark expressions: no Python runs per row, so they stay
inside whole-stage code generation and push down with the surrounding plan.
Values that cannot be parsed become NULL; nothing here throws on bad input.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
LOCAL_OFFSET_HOURS = 8
JOB_PREFIX_PATTERN = r"(?i)^([A-Z]{2,4}-\d{4,6})"
NON_JOB_PREFIXES = ["INV", "PO", "GST", "RCTI"]
DEFAULT_JOB_PREFIX = "SH-"
NIGHT_WORK_TYPE = "NIGHT SHIFT"
TRUE_WORDS = ["true", "1", "yes"]
EXPIRING_SOON_DAYS = 90
_HASHED = ("string", "long", "integer", "short", "byte", "double", "date", "timestamp", "timestamp_ntz")
# -----------------------------------------------------------------------------

AsOf = date | str


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(as_of: AsOf) -> Column:
    """The explicit business date; there is no hidden 'today' anywhere."""
    return F.lit(str(as_of)).cast("date")


def text(c: Column | str) -> Column:
    """Trimmed text; blank and the spelling ``nan`` count as missing."""
    t = F.trim(as_col(c).cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def to_number(c: Column | str) -> Column:
    return F.nanvl(F.trim(as_col(c).cast("string")).try_cast("double"), F.lit(None).cast("double"))


def _whole(c: Column | str) -> Column:
    """Digits as they stand (a tail of ``.000`` is dropped), so ids beyond 2**53 keep every digit; NULL for other text."""
    t = F.trim(as_col(c).cast("string"))
    return F.regexp_replace(t, r"^([+-]?\d+)\.0*$", "$1").try_cast("bigint")


def to_int(c: Column | str) -> Column:
    """Whole number, NULL when the value is not one.

    A number column counts where it holds a whole number (JSON makes a column double as soon as one value has a point); a
    text must be digits alone.
    """
    n = to_number(c)
    number = F.typeof(as_col(c)).rlike("^(double|float|decimal)")
    return F.when(number, F.when(n == F.floor(n), n.try_cast("bigint"))).otherwise(
        F.trim(as_col(c).cast("string")).try_cast("bigint"))


def lookup_key(c: Column | str) -> Column:
    """``48``, ``48.0`` and ``' 48 '`` become the same key, other text is NULL; decimals are cut off."""
    return F.coalesce(_whole(c), to_number(c).try_cast("bigint")).cast("string")


def norm_id(c: Column | str) -> Column:
    """As :func:`lookup_key`, but ids that are not numbers survive trimmed."""
    return F.coalesce(lookup_key(c), text(c))


def spread_nulls(df, key: Column) -> Column:
    """``key`` as the left side of a left join whose other side holds trimmed texts.

    NULL matches nothing, but all NULL keys would meet in one task; each gets a text that no trimmed text equals, dealt out by
    the first columns of its row, which name it.
    """
    first = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() in _HASHED][:3]
    return F.coalesce(key, F.concat(F.lit(" "), F.xxhash64(*first).cast("string"))) if first else key


def local_ts(c: Column | str, offset_hours: int = LOCAL_OFFSET_HOURS) -> Column:
    """One business-local wall-clock time from mixed spellings, value by value.

    ``...T...Z`` is UTC and is moved to local time, ``d/m/yyyy`` is day-first,
    anything else must be ISO.  The result has no time zone, so it does not
    depend on the session's.
    """
    return wall_ts(F.trim(as_col(c).cast("string")), offset_hours)


def wall_ts(t: Column, offset_hours: int = LOCAL_OFFSET_HOURS) -> Column:
    """:func:`local_ts` of a text that is already trimmed.

    The text stands in it as few times as possible: a filter on the result repeats whatever the text is made of.
    """
    shift = F.when(t.like("%T%Z"), F.expr(f"INTERVAL {int(offset_hours)} HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    return plain_ts(t) + shift


def plain_ts(t: Column) -> Column:
    """Wall clock as written.  Only texts that are no time as they stand are rewritten."""
    iso = F.regexp_replace(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$2-$1")
    return F.coalesce(*[F.rtrim(x, F.lit("Z")).try_cast("timestamp_ntz") for x in (t, iso)])


def micros(ts: Column) -> Column:
    """Sortable number of a wall-clock time; aggregating it stays in the hash aggregate."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def local_date(c: Column | str) -> Column:
    return local_ts(c).cast("date")


def utc_ts(c: Column | str) -> Column:
    """Wall-clock UTC time of an ISO text with or without ``Z``."""
    return F.regexp_replace(F.trim(as_col(c).cast("string")), r"Z$", "").try_cast("timestamp_ntz")


def iso_date(c: Column | str) -> Column:
    """ISO text of a date column (the published contract keeps dates as text)."""
    return F.date_format(as_col(c).cast("date"), "yyyy-MM-dd")


def _is_whole(df, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("integer", "long", "short", "byte")


def id_of(df, name: str) -> Column:
    """:func:`norm_id` of a column; whole-number columns need no text rules."""
    return F.col(name).cast("string") if _is_whole(df, name) else norm_id(name)


def key_of(df, name: str) -> Column:
    """:func:`lookup_key` of a column; whole-number columns need no text rules, which keeps a row's compiled code short."""
    return F.col(name).cast("string") if _is_whole(df, name) else lookup_key(name)


def number_of(df, name: str) -> Column:
    """:func:`to_number` of a column; numeric columns are only cast."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("integer", "long", "short", "byte"):
        return F.col(name).cast("double")
    if kind in ("double", "float"):
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return to_number(name)


def month_of(c: Column | str) -> Column:
    return F.date_format(as_col(c).cast("date"), "yyyy-MM")


def local_date_month(ts: Column | str, fallback: Column | str) -> tuple[Column, Column]:
    """E5: local ISO date and month of a UTC text, using a second text when the first is unusable."""
    shift = F.expr(f"INTERVAL {LOCAL_OFFSET_HOURS} HOURS")
    best = F.coalesce(utc_ts(ts), utc_ts(fallback)) + shift
    return F.date_format(best, "yyyy-MM-dd"), F.date_format(best, "yyyy-MM")


def truthy(c: Column | str) -> Column:
    """E6."""
    return F.coalesce(F.lower(as_col(c).cast("string")).isin(TRUE_WORDS), F.lit(False))


def job_prefix(c: Column | str) -> Column:
    """Leading job code in upper case, NULL when there is none."""
    found = F.regexp_extract(F.trim(as_col(c)), JOB_PREFIX_PATTERN, 1)
    return F.upper(F.nullif(found, F.lit("")))


def invoice_job_code(c: Column | str) -> Column:
    """Job code of a reference; invoice, order and tax numbers only look like one."""
    code = job_prefix(c)
    return F.when(~F.substring_index(code, "-", 1).isin(NON_JOB_PREFIXES), code)


def normalise_job_id(c: Column | str) -> Column:
    """E9."""
    t = F.upper(F.trim(as_col(c).cast("string")))
    return F.when(t.rlike(r"^\d+$"), F.concat(F.lit(DEFAULT_JOB_PREFIX), t)).otherwise(t)


def shift_type(work_type: Column | str) -> Column:
    """E10."""
    is_night = F.upper(F.trim(as_col(work_type))) == NIGHT_WORK_TYPE
    return F.when(is_night, F.lit("NS")).otherwise(F.lit("DS"))


def first_project(allocations: Column | str) -> Column:
    """First non-empty project of an allocation array."""
    projects = F.transform(as_col(allocations), lambda a: a["resource_request"]["project"])
    named = F.filter(projects, lambda p: p.isNotNull() & (p != ""))
    return F.try_element_at(named, F.lit(1))


def link_cell(c: Column | str) -> dict[str, Column]:
    """Parts of ``head:id<#>url<->label``; each part is NULL when absent."""
    cell = text(c)
    head = F.when(cell.contains("<#>"), F.substring_index(cell, "<#>", 1))
    url = F.trim(F.regexp_extract(cell, r"(?s)<#>(.*?)(?:<->|$)", 1))
    url = F.when(F.lower(url).startswith("http"), url)
    item = F.nullif(F.regexp_extract(head, r":\s*(\d+)\s*$", 1), F.lit(""))
    return {"head": head, "item_id": item.try_cast("bigint"), "url": url}


def norm_name(c: Column | str) -> Column:
    """Comparison form of a name: lower case, ``&`` read as *and*, letters, digits and CJK only."""
    spoken = F.replace(F.lower(as_col(c)), F.lit("&"), F.lit(" and "))
    return F.coalesce(F.regexp_replace(spoken, r"[^a-z0-9一-鿿]", ""), F.lit(""))


def has_text(c: Column | str, term: str | None) -> Column:
    """Case-insensitive containment, the filter behind every text argument."""
    return F.lower(as_col(c).cast("string")).contains(str(term).lower())


def full_name(first: Column | str = "first_name", last: Column | str = "last_name") -> Column:
    return F.concat(as_col(first), F.lit(" "), as_col(last))


def days_to_expiry(expiry: Column | str, as_of: AsOf) -> Column:
    return F.datediff(F.to_date(as_col(expiry).cast("string").try_cast("timestamp_ntz")), day(as_of))


def expiry_flags(expiry: Column | str, as_of: AsOf) -> dict[str, Column]:
    """A certificate without expiry date is neither expired nor expiring."""
    left = days_to_expiry(expiry, as_of)
    no = F.lit(False)
    return {
        "days_to_expiry": left,
        "is_expired": F.coalesce(left < 0, no),
        "is_expiring_soon": F.coalesce(left.between(0, EXPIRING_SOON_DAYS), no),
    }


def stringify(c: Column, data_type) -> Column:
    """Text stays text, nested values become JSON, the rest is cast."""
    from pyspark.sql import types as T

    if isinstance(data_type, T.StringType):
        return c
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")
