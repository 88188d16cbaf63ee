"""Flat mirrors of nested records."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: list-system columns without business content ---------------------
SYSTEM_NOISE = {"@odata.etag", "Edit", "LinkTitle", "LinkTitleNoMenu", "ItemChildCount", "FolderChildCount",
                "_UIVersionString", "_ComplianceFlags", "_ComplianceTag", "_ComplianceTagWrittenTime",
                "_ComplianceTagUserId", "AppAuthorLookupId", "AppEditorLookupId", "ContentType", "Attachments"}
HEAVY_COLUMNS = {"FDD-FormInbox": {"Schema", "Images", "Data"}}
FORM_PREFIX = "FDS-"
# --------------------------------------------------------------------------------------

NESTED = (T.StructType, T.ArrayType, T.MapType)


def quoted(*parts: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in parts))


def _flat(c: Column, kind: T.DataType) -> Column:
    return F.to_json(c) if isinstance(kind, NESTED) else c


def flatten_mirror(df: DataFrame) -> DataFrame:
    """One level of structs becomes dotted columns, anything deeper becomes JSON text."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [_flat(quoted(f.name, g.name), g.dataType).alias(f"{f.name}.{g.name}")
                    for g in f.dataType.fields]
        else:
            out.append(_flat(quoted(f.name), f.dataType).alias(f.name))
    return df.select(*out)


def flatten_heavy(df: DataFrame, drop: Iterable[str]) -> DataFrame:
    """Mirror without the oversized columns, all text; the scan never reads what is dropped."""
    gone = set(drop)
    fields = sorted((f for f in df.schema.fields if f.name not in gone), key=lambda f: f.name)
    return df.select(*[_flat(quoted(f.name), f.dataType).cast("string").alias(f.name) for f in fields])


def table_name(list_name: str, prefix: str = "fds_") -> str:
    slug = re.sub(r"[^a-z0-9]+", "_", list_name.replace(FORM_PREFIX, "").lower()).strip("_")
    return prefix + slug


def auto_tables(lists: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """One table per list with its own columns minus system noise; lists without columns give none."""
    out = {}
    for name, df in sorted(lists.items()):
        fields = [f for f in df.schema.fields if f.name not in SYSTEM_NOISE]
        if fields:
            out[table_name(name)] = df.select(*[_flat(quoted(f.name), f.dataType).alias(f.name) for f in fields])
    return out


def pick(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename and keep the mapped columns that exist; sources may lack some."""
    return df.select(*[quoted(k).alias(v) for k, v in mapping.items() if k in df.columns])


def ensure(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add missing columns as typed NULLs so that later steps see one schema."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df
