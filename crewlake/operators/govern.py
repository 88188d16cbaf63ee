"""Governance as data operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlake.functions.costs import avoided_cost
from crewlake.functions.scalars import has_text
from crewlake.operators.selection import exact_percentile
from crewlake.spec import GOLD, ROLES, TableSpec, check_join_key

# --- fixed values ---------------------------------------------------------------------------
RAW_ROLE = "Admin_IT"
SECRET_MASK = "[REDACTED:secret]"
SECRET_PATTERNS = [
    r"AccountKey=[A-Za-z0-9+/=]{20,}",
    r"client_secret[\"'=: ]+[A-Za-z0-9~._-]{10,}",
    r"(?i)bearer\s+[A-Za-z0-9._-]{20,}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"(?i)connectionstring[\"'=: ]+\S{20,}",
    r"eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
]
RESTRICTED_FIELDS = {
    "day_rate": ["Finance", "Admin_IT"], "night_rate": ["Finance", "Admin_IT"],
    "pay_rate": ["Finance", "Admin_IT"], "charge_rate": ["Finance", "Admin_IT"],
    "salary": ["Finance", "Admin_IT"], "amount_ex_gst": ["Finance", "Admin_IT"],
    "invoice_amount": ["Finance", "Admin_IT"],
    "date_of_birth": ["HR_Manager", "Admin_IT"], "gender_name": ["HR_Manager", "Admin_IT"],
    "nationality_name": ["HR_Manager", "Admin_IT"], "middle_name": ["HR_Manager", "Admin_IT"],
    "medical_information": [], "bank_details": [], "tax_file_number": [],
    "personal_address": [], "personal_phone": [],
}
# ----------------------------------------------------------------------------------------------


def governed_view(df: DataFrame, table: str | TableSpec, role: str = "default",
                  columns: Sequence[str] | None = None) -> DataFrame:
    """The columns of a table that a role may see, chosen before any expression can use them."""
    spec = GOLD[table] if isinstance(table, str) else table
    allowed = spec.visible(role)
    if columns is None:
        return df.select(*[c for c in allowed if c in df.columns])
    for c in columns:
        if c in spec.restricted and c not in allowed:
            raise PermissionError(f"{spec.name}.{c} requires the {spec.restricted[c]} role")
        if c not in allowed:
            raise ValueError(f"{spec.name} has no readable column '{c}'")
    return df.select(*columns)


def capped(df: DataFrame, n: int) -> DataFrame:
    """R2: the serving row cap, applied to the final frame whatever built it; the number is the caller's and is kept."""
    return df.limit(int(n))


def _rewrite(c: Column, kind: T.DataType, name: str, leaf: Callable[[Column, T.DataType, str], Column]) -> Column:
    """Apply ``leaf`` to every field at any depth; a leaf that answers for a struct stops the descent."""
    done = leaf(c, kind, name)
    if done is not None:
        return done
    if isinstance(kind, T.StructType):
        parts = [_rewrite(c.getField(f.name), f.dataType, f.name, leaf).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _rewrite(x, kind.elementType, "", leaf))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: _rewrite(v, kind.valueType, "", leaf))
    return c


def _apply(df: DataFrame, leaf) -> DataFrame:
    return df.select(*[_rewrite(F.col(f"`{f.name}`"), f.dataType, f.name, leaf).alias(f.name) for f in df.schema.fields])


def _hidden(name: str, role: str, fields: Mapping[str, Sequence[str]]) -> bool:
    allowed = fields.get(name.lower())
    return allowed is not None and role not in allowed


def redact_fields(df: DataFrame, role: str = "default",
                  fields: Mapping[str, Sequence[str]] = RESTRICTED_FIELDS) -> DataFrame:
    """Mask the values of restricted fields at any depth; an empty role list means nobody sees them."""
    def leaf(c: Column, kind: T.DataType, name: str):
        return F.lit(f"[REDACTED:{name}]") if _hidden(name, role, fields) else None
    return _apply(df, leaf)


def scrub(c: Column, patterns: Sequence[str] = SECRET_PATTERNS) -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, p, SECRET_MASK), patterns, c)


def scrub_secrets(df: DataFrame, patterns: Sequence[str] = SECRET_PATTERNS) -> DataFrame:
    """Remove secrets from every text at any depth, for every role."""
    def leaf(c: Column, kind: T.DataType, name: str):
        return scrub(c, patterns) if isinstance(kind, T.StringType) else None
    return _apply(df, leaf)


def sanitise(df: DataFrame, role: str = "default", patterns: Sequence[str] = SECRET_PATTERNS) -> DataFrame:
    return scrub_secrets(redact_fields(df, role), patterns)


def redaction_actions(df: DataFrame, role: str = "default", patterns: Sequence[str] = SECRET_PATTERNS,
                      fields: Mapping[str, Sequence[str]] = RESTRICTED_FIELDS) -> DataFrame:
    """How often each action fires, (action, target, actions), in one scan over top-level columns.

    A secret counts once per text and pattern; later patterns see what earlier ones left.
    """
    aggs, cells = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if _hidden(f.name, role, fields):
            aggs.append(F.count("*").alias(f"f:{f.name}"))
            cells.append(("redact_field", f.name, F.col(f"`f:{f.name}`")))
        elif isinstance(f.dataType, T.StringType):
            for i, p in enumerate(patterns):
                seen = scrub(c, patterns[:i])
                aggs.append(F.count_if(seen.rlike(p)).alias(f"s:{f.name}:{i}"))
                cells.append(("scrub_secret", f"{f.name}:{i}", F.col(f"`s:{f.name}:{i}`")))
    rows = [F.struct(F.lit(a).alias("action"), F.lit(t).alias("target"), n.alias("actions")) for a, t, n in cells]
    return df.agg(*aggs).select(F.inline(F.array(*rows))).filter("actions > 0")


def access_report(log: DataFrame) -> DataFrame:
    """Calls per tool and role with denials, latency, rows and avoided cost.

    The 95th percentile is exact and found by counting ranges of latencies, so a busy tool's latencies never meet.
    """
    sums = log.groupBy("tool", "role").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("allowed")).alias("denied"),
        F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"),
        F.sum("row_count").alias("rows"), F.round(F.sum(avoided_cost("payload")), 6).alias("avoided_usd"))
    high = exact_percentile(log, ["tool", "role"], "latency_ms", 0.95, "p95").select(
        F.col("tool").alias("_tool"), F.col("role").alias("_role"), F.round("p95", 4).alias("p95_latency_ms"))
    both = sums.join(high, F.col("tool").eqNullSafe(F.col("_tool")) & F.col("role").eqNullSafe(F.col("_role")), "left")
    return both.select("tool", "role", "calls", "denied", "avg_latency_ms", "max_latency_ms", "p95_latency_ms", "rows", "avoided_usd")


def user_roles(users: DataFrame, group_roles: DataFrame, precedence: Sequence[str] = tuple(ROLES)) -> DataFrame:
    """Each user's strongest role among the groups they are in; none gives ``default``."""
    mapped = group_roles.select(F.lower("group").alias("_g"), "role")
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col("role"))
    member = users.select("user", F.explode("groups").alias("g")).select("user", F.lower("g").alias("_g"))
    best = member.join(mapped, "_g").groupBy("user").agg(F.min_by("role", rank).alias("role"))
    return users.select("user").distinct().join(best, "user", "left").select(
        "user", F.coalesce("role", F.lit("default")).alias("role"))


def raw_lookup(tables: Mapping[str, DataFrame], targets: Sequence[tuple[str, str]], term: str, role: str,
               limit: int | None = None) -> DataFrame:
    """Where a name occurs in the unvalidated mirror: distinct values per listed column, the first ``limit`` if asked for."""
    if role != RAW_ROLE:
        raise PermissionError(f"raw layer access requires the {RAW_ROLE} role")
    parts = []
    for table, column in targets:
        if table in tables and column in tables[table].columns:
            hit = tables[table].filter(has_text(f"`{column}`", term)).select(F.col(f"`{column}`").alias("value"))
            found = hit.distinct()
            parts.append((found if limit is None else found.orderBy("value").limit(int(limit))).select(
                F.lit(table).alias("table"), F.lit(column).alias("column"), "value"))
    return reduce(DataFrame.unionByName, parts)


def join_published(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join two published tables; only a registered identity key may connect them."""
    return left.join(right, check_join_key(key), how)
