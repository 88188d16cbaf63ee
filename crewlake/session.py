"""Spark session defaults.

Only settings that matter for large, skewed inputs are set here.  A cluster may
override any of them; operators never depend on a particular value.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCALE_SETTINGS = {
    # run-time re-planning: merge small partitions, split hot ones, pick joins by real size
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join partition even if that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from the session's ``spark.checkpoint.dir``.

    Only a session on one machine may do without: it gets a temporary folder.  Elsewhere each executor would write to its
    own disk, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not str(spark.conf.get("spark.master", "")).startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="crewlake-")
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read from there: later steps start from the rows, not from their plan."""
    path = path or new_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_session(app: str = "crewlake", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the scale settings; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(SCALE_SETTINGS)
    settings.update({k.replace("__", "."): v for k, v in extra.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_session(cpus: int | None = None, **extra: str) -> SparkSession:
    """Single-machine session for tests and the bench."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    local = {
        "spark__sql__shuffle__partitions": str(n),
        "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
        # call-site capture costs milliseconds for every column expression
        "spark__python__sql__dataFrameDebugging__enabled": "false",
        "spark__driver__memory": os.environ.get("CREWLAKE_DRIVER_MEMORY", "8g"),
        "spark__driver__bindAddress": "127.0.0.1",
        "spark__driver__host": "127.0.0.1",
    }
    local.update(extra)
    return build_session(master=f"local[{n}]", **local)
