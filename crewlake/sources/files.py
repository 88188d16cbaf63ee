"""File facts, file index and table versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewlake.functions.ordered import latest
from crewlake.functions.scalars import utc_ts

DEFAULT_SITE = "BMS"  # fixed value: site of records written before sites were recorded


def file_facts(items: DataFrame) -> DataFrame:
    """Searchable facts of file records; folders are skipped.

    Needs site, library, name, parent_path, size, is_file, web_url, modified_at, modified_by.
    """
    name = F.coalesce("name", F.lit(""))
    path = F.coalesce("parent_path", F.lit(""))
    after_root = F.regexp_replace(F.substring(path, F.instr(path, "root:") + F.lit(5), F.length(path)), "^/+", "")
    return items.filter("is_file").select(
        "site", "library", name.alias("file_name"),
        F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("").alias("ext"),
        F.when(path.contains("root:"), after_root).otherwise("").alias("folder_path"),
        F.round(F.coalesce(F.col("size"), F.lit(0)) / 1024, 1).alias("size_kb"),
        "web_url", "modified_at", "modified_by", *[c for c in items.columns if c == "_pos"],
    )


def file_index(files: DataFrame, position: str = "_pos") -> DataFrame:
    """One row per URL, the first record seen wins; modification time read as UTC."""
    one = latest(files, ["web_url"], [position], first=True)
    return one.select(
        F.coalesce("site", F.lit(DEFAULT_SITE)).alias("site"), "library", "file_name", "ext", "folder_path",
        "size_kb", "web_url", utc_ts("modified_at").alias("modified_at"), "modified_by",
    )


def table_version(df: DataFrame) -> DataFrame:
    """Newest file time behind a table, from file metadata (no data column is read)."""
    return df.select(F.col("_metadata.file_path").alias("p"),
                     F.col("_metadata.file_modification_time").alias("t")).agg(
        F.max("t").alias("version"), F.countDistinct("p").alias("files"))
