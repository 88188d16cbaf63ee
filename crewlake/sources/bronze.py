"""Landing and reading raw newline-delimited JSON."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: objects that are never landed, and those landed without rows ---
NEVER_LAND = {"SYS-APITokens", "SYS-FlowErrorLog", "PPL-PeopleTest", "AMS-AssetsTest", "TestList",
              "Access Requests", "Web Template Extensions", "Events", "Documents"}
SCHEMA_ONLY = {"PPL-PayrollDeductions", "Archived Staff Data"}
ENVELOPES = ("data", "timesheets")
PARTITION = "ingest_date"
# ----------------------------------------------------------------------------------


def _field(df: DataFrame, name: str):
    return next((f for f in df.schema.fields if f.name == name), None)


def unwrap(df: DataFrame, field: str = "fields") -> DataFrame:
    """Lift the members of a wrapping struct; rows without the wrapper keep their own columns."""
    wrapper = _field(df, field)
    if wrapper is None or not isinstance(wrapper.dataType, T.StructType):
        return df
    inner = wrapper.dataType.fieldNames()
    own = [c for c in df.columns if c != field]
    keep = []
    for name in inner:
        lifted = F.col(f"`{field}`.`{name}`")
        if name in own:
            bare = F.col(f"`{field}`").isNull()
            same = _field(df, name).dataType == wrapper.dataType[name].dataType
            other = F.col(f"`{name}`") if same else F.col(f"`{name}`").cast(wrapper.dataType[name].dataType)
            lifted = F.when(bare, other).otherwise(lifted)
        keep.append(lifted.alias(name))
    return df.select(*keep, *[F.col(f"`{c}`") for c in own if c not in inner])


def open_envelope(df: DataFrame, names: Iterable[str] = ENVELOPES) -> DataFrame:
    """``{data:[..]}`` and ``{timesheets:[..]}`` responses become one row per record."""
    for name in names:
        found = _field(df, name)
        if found is not None and isinstance(found.dataType, T.ArrayType):
            df = df.select(F.explode(name).alias("_record")).select("_record.*")
    return df


def latest_partition(spark: SparkSession, path: str) -> str | None:
    """Newest ``ingest_date`` from directory names alone; no data file is opened."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    dates = [n.split("=", 1)[1] for n in names if n.startswith(PARTITION + "=")]
    return max(dates) if dates else None


def read_bronze(spark: SparkSession, root: str, source: str, obj: str, *, schema: T.StructType | str | None = None,
                ingest_date: str | None = None, wrapper: str | None = "fields") -> DataFrame | None:
    """Records of one object from its newest (or the given) landing; None when never landed."""
    path = f"{root}/{source}/{obj}"
    when = ingest_date or latest_partition(spark, path)
    if when is None:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.json(f"{path}/{PARTITION}={when}")
    return unwrap(df, wrapper) if wrapper else df


def allowed(obj: str) -> bool:
    return obj not in NEVER_LAND


def land(df: DataFrame, root: str, source: str, obj: str, ingest_date: str, *,
         include_sensitive: bool = False) -> bool:
    """Write one landing; a rerun on the same day replaces only that day.

    Credential and test objects are refused, sensitive ones keep their columns but no rows.
    """
    if not allowed(obj):
        return False
    rows = df.limit(0) if obj in SCHEMA_ONLY and not include_sensitive else df
    (rows.withColumn(PARTITION, F.lit(ingest_date)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).json(f"{root}/{source}/{obj}"))
    return True


def sensitive_exclude(objects: DataFrame, name: str = "name") -> DataFrame:
    """S16 over a catalogue: drops never-landed objects and marks the ones landed without rows."""
    return (objects.filter(~F.col(name).isin(sorted(NEVER_LAND)))
            .withColumn("schema_only", F.col(name).isin(sorted(SCHEMA_ONLY))))


def landing_manifest(landed: DataFrame, expected: DataFrame) -> DataFrame:
    """S3: one line per expected object: rows landed, its error, and whether it is schema-only.

    ``landed`` has a column ``name`` per record, ``expected`` has name, schema_only, error.
    """
    counts = landed.groupBy("name").agg(F.count("*").alias("n"))
    rows = F.when(F.col("error").isNotNull() | F.col("schema_only"), F.lit(0)).otherwise(F.coalesce("n", F.lit(0)))
    return expected.join(counts, "name", "left").select("name", "schema_only", "error",
                                                        rows.cast("bigint").alias("rows"))


def capped_chunks(rows: DataFrame, chunk: list[str], cap: int) -> DataFrame:
    """Chunks that returned a full page and may therefore be cut short."""
    return rows.groupBy(*chunk).agg(F.count("*").alias("rows")).filter(F.col("rows") >= cap)


def schema_only(spark: SparkSession, columns: Iterable[str]) -> DataFrame:
    """Typed empty table for an object that has columns but no records."""
    names = list(columns) or ["_no_data"]
    return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def read_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Append-only log; lines that are not valid JSON are left out."""
    bad = "_corrupt_record"
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType(list(typed.fields) + [T.StructField(bad, T.StringType())])
    df = (spark.read.schema(full).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", bad).json(path))
    return df.filter(F.col(bad).isNull()).drop(bad)


def since(df: DataFrame, column: str, after: str) -> DataFrame:
    """Only records changed after a point; the predicate stays on the raw column so it is pushed down."""
    return df.filter(F.col(column) > F.lit(after).cast(df.schema[column].dataType))


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    try:
        return spark.table(name)
    except AnalysisException:
        return None
