"""Writing published tables and exports.

A published table is a folder of complete versions and a small log of pointers.  A version is written under its own name;
only then one pointer row is appended, which is a single committed file.  Readers take the newest pointer, so they see the
old table or the new one, never part of either, and a job lost on the way changes nothing.  No rename is involved, so the
same holds on object stores.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "version string, published_at long"


def gold_path(root: str, name: str) -> str:
    return f"{root}/gold/{name}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder; true when it is gone afterwards."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.delete(p, True) or not fs.exists(p)


def current_version(spark: SparkSession, root: str, name: str) -> str | None:
    """Name of the version that readers see; None before the first one."""
    try:
        pointers = spark.read.schema(POINTER).parquet(f"{gold_path(root, name)}/pointers")
    except AnalysisException:
        return None
    return pointers.agg(F.max_by("version", F.struct("published_at", "version"))).first()[0]


def write_gold(df: DataFrame | None, root: str, name: str, partition_by: list[str] | None = None) -> bool:
    """Publish a table; a frame without columns never replaces a good table.

    The version before the current one stays for readers that are still on it, older ones are deleted.
    """
    if df is None or not df.columns:
        return False
    spark, folder = df.sparkSession, gold_path(root, name)
    before = current_version(spark, root, name)
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{folder}/{version}")
    spark.createDataFrame([(version, time.time_ns())], POINTER).coalesce(1).write.mode("append").parquet(f"{folder}/pointers")
    spark.catalog.refreshByPath(f"{folder}/pointers")
    listed = spark.read.schema(POINTER).parquet(f"{folder}/pointers").select("version").collect()  # one row per publication
    for old in {r[0] for r in listed} - {version, before}:
        remove(spark, f"{folder}/{old}")
    return True


def read_gold(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    version = current_version(spark, root, name)
    return None if version is None else spark.read.parquet(f"{gold_path(root, name)}/{version}")


def export_affected(df: DataFrame, path: str) -> None:
    """Affected records of an issue as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)
