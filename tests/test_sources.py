import json
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crewlake.operators import reconcile as R
from crewlake.sources import bronze, flatten, gold_io
from crewlake.streaming import incremental as I
from crewlake.streaming.gaps import gap_pairs_stream


def folder():
    return tempfile.mkdtemp(prefix="run-test-", dir="/tmp")


def test_landing_and_reading(spark):
    root = folder()
    df = spark.createDataFrame([((1, "a"),), ((2, "b"),)], "fields struct<id: int, Title: string>")
    for day in ("2026-01-01", "2026-01-02", "2026-01-02"):
        assert bronze.land(df, root, "lists", "People", day)
    assert sorted(map(tuple, bronze.read_bronze(spark, root, "lists", "People").collect())) == [("a", 1), ("b", 2)] or \
        {r.id for r in bronze.read_bronze(spark, root, "lists", "People").collect()} == {1, 2}
    assert not bronze.land(df, root, "lists", "SYS-APITokens", "2026-01-01")
    assert bronze.read_bronze(spark, root, "lists", "Never") is None
    assert bronze.schema_only(spark, ["a", "b"]).columns == ["a", "b"]


def test_log_skips_malformed_lines(spark):
    path = folder() + "/log.jsonl"
    with open(path, "w") as f:
        f.write('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in bronze.read_log(spark, path, "a int").collect()) == [1, 2]


def test_envelopes_and_flattening(spark):
    df = spark.createDataFrame([([(1,), (2,)],)], "data array<struct<id: int>>")
    assert [r.id for r in bronze.open_envelope(df).collect()] == [1, 2]
    nested = spark.createDataFrame([(1, (2, (3,)), [4])], "a int, b struct<c: int, d: struct<e: int>>, f array<int>")
    flat = flatten.flatten_mirror(nested)
    assert flat.columns == ["a", "b.c", "b.d", "f"] and json.loads(flat.first()["b.d"]) == {"e": 3}
    assert flatten.flatten_heavy(nested, ["b"]).dtypes == [("a", "string"), ("f", "string")]
    assert flatten.table_name("FDS-SRC Request/Line") == "fds_src_request_line"


def test_gold_is_not_replaced_by_a_frame_without_columns(spark):
    root = folder()
    df = spark.createDataFrame([(1,)], "a int")
    assert gold_io.write_gold(df, root, "t") and not gold_io.write_gold(df.select(), root, "t") and not gold_io.write_gold(None, root, "t")
    assert gold_io.write_gold(df.union(df), root, "t") and gold_io.read_gold(spark, root, "t").count() == 2


def test_upsert_ignores_old_and_equal_rows_and_replays(spark):
    cur = spark.createDataFrame([(1, 5, "stored"), (2, 5, "stored")], "id int, m int, v string")
    inc = spark.createDataFrame([(1, 4, "old"), (2, 5, "equal"), (3, 1, "new")], "id int, m int, v string")
    once = I.upsert(cur, inc, ["id"], "m")
    want = [(1, 5, "stored"), (2, 5, "stored"), (3, 1, "new")]
    assert sorted(map(tuple, once.collect())) == want and sorted(map(tuple, I.upsert(once, inc, ["id"], "m").collect())) == want


def test_merge_batches_survive_a_repeat(spark):
    root = folder()
    def rows(*r):
        return spark.createDataFrame(list(r), "id int, m int, v string")
    I.merge_batch(rows((1, 1, "a"), (2, 1, "a")), root, ["id"], "m", 0, 4)
    for _ in range(2):                                            # the second call stands for a rerun after a lost job
        I.merge_batch(rows((1, 2, "b"), (2, 0, "late"), (3, 1, "c")), root, ["id"], "m", 1, 4)
    assert sorted((r.id, r.v) for r in I.read_merged(spark, root).collect()) == [(1, "b"), (2, "a"), (3, "c")]


class Lost(Exception):
    pass


def merged_model(batches):
    """One row per key: the newest, of equally new ones the first."""
    out = {}
    for batch in batches:
        for k, m, v in batch:
            if k not in out or m > out[k][0]:
                out[k] = (m, v)
    return sorted((k, m, v) for k, (m, v) in out.items())


@pytest.mark.parametrize("lost_at", range(12))
def test_a_merge_lost_at_any_step_is_finished_by_a_rerun(spark, monkeypatch, lost_at):
    root, rnd = folder(), random.Random(lost_at)
    batches = [[(rnd.randint(0, 30), rnd.randint(0, 5), f"{b}") for _ in range(rnd.randint(1, 12))] for b in range(4)]
    batches = [[r for k, r in enumerate(b) if r[0] not in {x[0] for x in b[:k]}] for b in batches]
    left = [lost_at]

    def failing(name, before):
        whole = getattr(I, name)

        def run(*args, **more):
            left[0] -= 1
            if before and left[0] == 0:
                raise Lost
            out = whole(*args, **more)
            if not before and left[0] == 0:
                raise Lost
            return out
        monkeypatch.setattr(I, name, run)

    for name in ("_write_run", "_commit", "remove"):
        failing(name, lost_at % 2)
    for b, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, "id int, m int, v string")
        for _ in range(2):
            try:
                I.merge_batch(frame, root, ["id"], "m", b, 2)
                break
            except Lost:
                pass
    assert sorted(tuple(r) for r in I.read_merged(spark, root).select("id", "m", "v").collect()) == merged_model(batches)


def test_small_batches_write_a_few_times_their_size(spark):
    root = folder()
    rows = lambda lo, hi, m: spark.range(lo, hi).select(F.col("id"), F.lit(m).alias("m"), F.lit("x" * 20).alias("v"))
    I.merge_batch(rows(0, 20_000, 0), root, ["id"], "m", 0)
    for b in range(1, 13):
        I.merge_batch(rows(b * 1000, b * 1000 + 200, b), root, ["id"], "m", b)
    log = spark.read.schema(I.RUN_LOG).parquet(f"{root}/log").filter("live")
    written = log.agg(F.sum("rows")).first()[0] - 20_000
    assert written <= 3 * 12 * 200  # each batch once, and once more per merge of four
    assert len(I.live_runs(spark, root)) <= 4
    table = I.read_merged(spark, root)
    assert table.count() == 20_000 and table.filter("m > 0").count() == 12 * 200
    assert sorted(tuple(r) for r in I.read_merged(spark, root, [(1100,), (3,), (99_999,)]).select("id", "m").collect()) == [(3, 0), (1100, 1)]


def test_gap_stream_equals_the_batch_after_disorder(spark):
    rnd, root = random.Random(4), folder()
    start = datetime(2024, 1, 1)
    rows = [(str(rnd.randint(1, 6)), rnd.choice(["Sign Out", "Sign In"]), start + timedelta(minutes=rnd.randint(0, 60 * 24 * 12))) for _ in range(400)]
    words = {"Sign Out": R.OUT, "Sign In": R.IN}
    frame = lambda rs: spark.createDataFrame([(o, words[s], t.strftime("%Y-%m-%dT%H:%M:%S")) for o, s, t in rs], "OPMS string, Status string, Date string")
    rows = sorted(rows, key=lambda r: r[2] + timedelta(hours=rnd.uniform(0, 20)))  # up to 20 hours out of order
    late = [("1", "Sign Out", start), ("2", "Sign In", start + timedelta(hours=1))]  # far beyond the delay
    close = [("0", "Sign In", start + timedelta(days=60))]
    query = None
    for k, part in enumerate([rows[:100], rows[100:250], rows[250:], late, close, close]):
        frame(part).coalesce(1).write.mode("append").json(f"{root}/in")
        stream = spark.readStream.schema("OPMS string, Status string, Date string").json(f"{root}/in")
        query = gap_pairs_stream(stream, "1 day").writeStream.format("parquet").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.opms, r.started, r.ended, round(r.hours, 6)) for r in spark.read.parquet(f"{root}/out").collect())
    want = sorted((r.opms, r.started, r.ended, round(r.hours, 6)) for r in R.gap_pairs(frame(rows)).collect())
    assert got == want and len(want) > 30


def test_gap_stream_keeps_groups_of_workers(spark):
    rnd, root = random.Random(6), folder()
    start = datetime(2024, 1, 1)
    rows = [(str(w), s, (start + timedelta(minutes=w % 500 + m)).strftime("%Y-%m-%dT%H:%M:%S")) for w in range(1, 2501)
            for s, m in ((R.OUT, 0), (R.IN, rnd.choice([0, 30, 420, 1300])), (R.OUT, 1500), (R.OUT, 1510), (R.IN, 1530))]
    rnd.shuffle(rows)
    form = "OPMS string, Status string, Date string"
    held = []
    for part in (rows[:6000], rows[6000:], [("0", R.IN, "2024-03-01T00:00:00")]):
        spark.createDataFrame(part, form).coalesce(1).write.mode("append").json(f"{root}/in")
        query = gap_pairs_stream(spark.readStream.schema(form).json(f"{root}/in"), "20 days").writeStream.format("parquet").option("path", f"{root}/out").option(
            "checkpointLocation", f"{root}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress))
    got = sorted((r.opms, r.started, r.ended, round(r.hours, 6)) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == sorted((r.opms, r.started, r.ended, round(r.hours, 6)) for r in R.gap_pairs(spark.createDataFrame(rows, form)).collect())
    assert len(got) > 2500 and 0 < max(held) <= 1024  # a call of Python per group, not per worker


def test_version_gate(spark):
    now, version, loads = [0.0], ["v1"], []
    gate = I.VersionGate(lambda: version[0], lambda: loads.append(version[0]) or spark.range(1), ttl=10, clock=lambda: now[0])
    gate.table(), gate.table()
    version[0] = "v2"
    gate.table()                                                  # still inside the waiting time
    now[0] = 11
    gate.table()
    assert loads == ["v1", "v2"]


def test_deletes_are_marked_and_undone(spark):
    t = spark.createDataFrame([(1,), (2,)], "id int")
    gone = I.reconcile_deletes(t, t.filter("id = 1"), ["id"], "2026-01-01 00:00:00")
    assert {r.id: r.is_deleted for r in gone.collect()} == {1: False, 2: True}
    back = I.reconcile_deletes(gone, t, ["id"], "2026-01-02 00:00:00")
    assert not any(r.is_deleted for r in back.collect()) and back.filter(F.col("deleted_at").isNotNull()).count() == 0


def test_lost_publication_keeps_the_old_table(spark, tmp_path):
    from crewlake.sources import gold_io
    root = str(tmp_path)
    one, two = spark.range(3), spark.range(5)
    assert gold_io.read_gold(spark, root, "t") is None and gold_io.write_gold(one, root, "t")
    two.write.parquet(f"{root}/gold/t/v-lost")  # a version whose job ended before its pointer was written
    assert gold_io.read_gold(spark, root, "t").count() == 3
    for n in (5, 6, 7):
        assert gold_io.write_gold(spark.range(n), root, "t")
    assert gold_io.read_gold(spark, root, "t").count() == 7
    assert not gold_io.write_gold(spark.range(1).select(), root, "t") and gold_io.read_gold(spark, root, "t").count() == 7
