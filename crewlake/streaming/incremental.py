"""Incremental refresh: merge by key, never append.

The reference design is a nightly reload with a specified incremental mode; here the merge
rule is one function used by batch and stream alike, so a replay changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewlake.functions.ordered import latest
from crewlake.sources.gold_io import exists, remove

# --- fixed values ---------------------------------------------------------------------------
LOOKBACK_HOURS = 48
FANOUT = 4
# ----------------------------------------------------------------------------------------------


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], watermark: str) -> DataFrame:
    """One row per key; an incoming row replaces the stored one only when it is newer."""
    both = current.withColumn("_stored", F.lit(1)).unionByName(incoming.withColumn("_stored", F.lit(0)))
    return latest(both, list(keys), [watermark, "_stored"]).select(*current.columns)


def high_watermarks(landed: DataFrame, obj: str = "object", column: str = "modified_at") -> DataFrame:
    """Per object the highest change mark seen, to be stored as the control table."""
    return landed.groupBy(obj).agg(F.max(column).alias("high_watermark"), F.count("*").alias("rows"))


def changed_since(landed: DataFrame, marks: DataFrame, obj: str = "object", column: str = "modified_at",
                  lookback_hours: int = LOOKBACK_HOURS) -> DataFrame:
    """Records after each object's mark minus the lookback; objects without a mark come whole."""
    marks = marks.select(obj, "high_watermark")
    edge = F.col("high_watermark") - F.expr(f"INTERVAL {int(lookback_hours)} HOURS")
    return landed.join(marks, obj, "left").filter(F.col("high_watermark").isNull() | (F.col(column) > edge)).drop("high_watermark")


def reconcile_deletes(table: DataFrame, full_keys: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """I4: soft-delete rows whose key is missing from a full pull; rows seen again are restored."""
    present = full_keys.select(*keys).distinct().withColumn("_present", F.lit(True))
    out = table.drop("is_deleted", "deleted_at").join(present, list(keys), "left")
    gone = F.col("_present").isNull()
    was = table.columns
    stamp = F.lit(at).cast("timestamp_ntz")
    out = out.withColumn("is_deleted", gone).withColumn("deleted_at", F.when(gone, stamp)).drop("_present")
    base = [c for c in was if c not in ("is_deleted", "deleted_at")]
    return out.select(*base, "is_deleted", "deleted_at")


def changed_dimension(change_log: DataFrame, dimension: DataFrame, since: str, log_key: str, dim_key: str) -> DataFrame:
    """The dimension rows whose ids occur in the change log after a point."""
    ids = change_log.filter(F.col("created_at") > F.lit(since).cast(change_log.schema["created_at"].dataType)).select(
        F.col(log_key).alias(dim_key)).distinct()
    return dimension.join(ids, dim_key, "left_semi")


class VersionGate:
    """Reload a table only when its version moved, asking at most once per ``ttl`` seconds."""

    def __init__(self, version: Callable[[], object], load: Callable[[], DataFrame], ttl: float = 300.0,
                 clock: Callable[[], float] = time.monotonic):
        self._version, self._load, self._ttl, self._clock = version, load, ttl, clock
        self._seen: object = None
        self._asked: float | None = None
        self._table: DataFrame | None = None

    def table(self) -> DataFrame:
        now = self._clock()
        if self._table is not None and self._asked is not None and now - self._asked < self._ttl:
            return self._table
        self._asked = now
        version = self._version()
        if self._table is None or version != self._seen:
            self._table, self._seen = self._load(), version
        return self._table


# --- merge on read ------------------------------------------------------------------------------
#
# A merged table is a set of runs and a log.  A run is a folder of files sorted by key hash with one row per key; a batch
# adds one run of its own size and touches no other.  Readers merge the live runs.  Runs of like size (within a factor of
# the fan-out) are merged into one when there are as many as the fan-out, so a row is written again about once per
# factor, and no more than fan-out times log(rows) runs are live.  The log has one file per commit; a run counts once its
# commit is there, and a merge takes its sources out in the same commit that puts it in.

RUN_LOG = "run string, live boolean, seq long, rows long, batch_id long, keys array<string>, watermark string"


def _commit(spark: SparkSession, root: str, rows: Sequence[tuple]) -> None:
    """Append rows to the log as one file: they all count, or none."""
    spark.createDataFrame(list(rows), RUN_LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    if not exists(spark, f"{root}/log"):
        return None
    spark.catalog.refreshByPath(f"{root}/log")
    return spark.read.schema(RUN_LOG).parquet(f"{root}/log")


def live_runs(spark: SparkSession, root: str) -> list:
    """Log rows of the runs that make up the table, in order of their batches; at most fan-out times log(rows) of them."""
    log = _log(spark, root)
    if log is None:
        return []
    gone = log.filter("NOT live").select("run")
    return log.filter("live").join(gone, "run", "left_anti").dropDuplicates(["run"]).orderBy("seq").collect()


def size_class(rows: int, fanout: int) -> int:
    size = 0
    while rows >= fanout:
        rows, size = rows // fanout, size + 1
    return size


def _write_run(rows: DataFrame, root: str, run: str, keys: Sequence[str]) -> int:
    """Write one row per key, sorted by key hash within files; a leftover of a lost attempt is replaced."""
    path = f"{root}/runs/{run}"
    rows.withColumn("_hash", F.xxhash64(*keys)).sortWithinPartitions("_hash").write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def _newest(rows: DataFrame, keys: Sequence[str], watermark: str) -> DataFrame:
    """The row of each key that an upsert batch by batch would leave: the newest, of equally new ones the first that came."""
    return latest(rows, list(keys), [watermark, -F.col("_seq")])


def merge_batch(batch: DataFrame, root: str, keys: Sequence[str], watermark: str, batch_id: int, fanout: int = FANOUT) -> None:
    """Merge a batch into the table under ``root``, writing about the batch's own size.

    A batch that is in the log is not merged again, so a rerun after a lost job goes on where that one stopped.
    """
    spark = batch.sparkSession
    log = _log(spark, root)
    if log is None or log.filter(F.col("batch_id") == int(batch_id)).isEmpty():
        seq = 1 if log is None else log.agg(F.max("seq")).first()[0] + 1
        run = f"batch-{int(batch_id)}"
        incoming = latest(batch, list(keys), [watermark]).withColumn("_seq", F.lit(seq).cast("long"))
        rows = _write_run(incoming, root, run, keys)
        _commit(spark, root, [(run, True, seq, rows, int(batch_id), list(keys), watermark)])
    compact(spark, root, fanout)


def compact(spark: SparkSession, root: str, fanout: int = FANOUT) -> None:
    """Merge runs of like size until no size has as many as ``fanout``, then delete runs that an earlier commit took out."""
    removable = _removable(spark, root)
    while True:
        by_size: dict[int, list] = {}
        for run in live_runs(spark, root):
            by_size.setdefault(size_class(run.rows, fanout), []).append(run)
        full = [runs for _, runs in sorted(by_size.items()) if len(runs) >= fanout]
        if not full:
            break
        runs = full[0]
        keys, watermark = runs[0]["keys"], runs[0].watermark
        rows = spark.read.option("mergeSchema", "true").parquet(*[f"{root}/runs/{r.run}" for r in runs]).drop("_hash")
        name = f"merged-{runs[0].seq}-{runs[-1].seq}-{sum(r.rows for r in runs)}"
        n = _write_run(_newest(rows, keys, watermark), root, name, keys)
        _commit(spark, root, [(name, True, runs[-1].seq, n, None, keys, watermark),
                              *[(r.run, False, r.seq, r.rows, None, keys, watermark) for r in runs]])
    for run in removable:
        remove(spark, f"{root}/runs/{run}")


def _removable(spark: SparkSession, root: str) -> list[str]:
    """Runs taken out by commits before this call: readers that began earlier have had one batch's time to finish."""
    log = _log(spark, root)
    out = [] if log is None else [r[0] for r in log.filter("NOT live").select("run").distinct().collect()]
    return [run for run in out if exists(spark, f"{root}/runs/{run}")]


def read_merged(spark: SparkSession, root: str, only: Sequence[tuple] | None = None) -> DataFrame:
    """The merged table; with ``only`` (values of the keys) just those rows, read from the parts of the files that may hold them."""
    runs = live_runs(spark, root)
    if not runs:
        raise FileNotFoundError(f"no merged table under {root}")
    keys, watermark = runs[0]["keys"], runs[0].watermark
    rows = spark.read.option("mergeSchema", "true").parquet(*[f"{root}/runs/{r.run}" for r in runs])
    if only is not None:
        kinds = [rows.schema[k].dataType for k in keys]
        wanted = spark.createDataFrame(list(only), T.StructType([T.StructField(k, t) for k, t in zip(keys, kinds)]))
        hashes = [r[0] for r in wanted.select(F.xxhash64(*keys)).collect()]  # as many as were asked for
        rows = rows.filter(F.col("_hash").isin(hashes)).join(wanted.distinct(), list(keys), "left_semi")
    rows = rows.drop("_hash")
    return (rows if len(runs) == 1 else _newest(rows, keys, watermark)).drop("_seq")


def stream_ingest(spark: SparkSession, landing: str, schema: T.StructType | str, root: str, keys: Sequence[str],
                  watermark: str, checkpoint: str, fanout: int = FANOUT):
    """I8: consume newly landed NDJSON once and merge it; restartable from the checkpoint."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(landing)

    def each(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, root, keys, watermark, batch_id, fanout)

    return (reader.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
