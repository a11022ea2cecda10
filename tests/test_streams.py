"""Streams give what their batch twins give, also over several micro-batches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from folioworks.operators import ledger
from folioworks.plans.ordered import ordered_columns
from folioworks.streaming import feeds, sinks


def write_parts(spark, rows, schema, path, parts):
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(autouse=True)
def state_store(spark):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    with sinks.rocksdb(spark):
        yield
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


START = datetime.datetime(2024, 1, 1)
FAR = START + datetime.timedelta(days=4000)


def shuffled(spark, rows, schema, time, closing, path, parts=5, seed=3):
    """A stream of files in which rows are up to two hours off their place, and a last row that moves the watermark."""
    rng = random.Random(seed)
    names = [f.split()[0] for f in schema.split(", ")]
    order = sorted(rows, key=lambda r: r[names.index(time)] + datetime.timedelta(minutes=rng.uniform(0, 120)))
    write_parts(spark, order, schema, path, parts)
    write_parts(spark, [closing], schema, path, 1)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_unique_jobs_out_of_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, "w", str(i % 3), START + datetime.timedelta(seconds=rng.randrange(0, 40_000))) for i in range(300)]
    feed = shuffled(spark, rows, "job_id long, worker string, args string, ts timestamp", "ts", (-1, "", "", FAR), str(tmp_path / "jobs"))
    got = sinks.run_appends(feeds.unique_jobs_stream(feed, 600, "3 hours"), "t-unique")
    want = ledger.unique_jobs(spark.createDataFrame(rows, "job_id long, worker string, args string, ts timestamp"), 600)
    assert sorted((r.job_id, r.ts) for r in got.collect()) == sorted((r.job_id, r.ts) for r in want.collect())


def test_edit_sessions_out_of_order(spark, tmp_path):
    rng = random.Random(2)
    times = sorted(rng.randrange(0, 90_000) for _ in range(250))
    rows = [(i, i % 3, START + datetime.timedelta(seconds=t), rng.choice(["push", "push", "undo", "redo"])) for i, t in enumerate(times)]
    schema = "op_id long, document_id long, ts timestamp, kind string"
    feed = shuffled(spark, rows, schema, "ts", (-1, -1, FAR, "undo"), str(tmp_path / "ops"))
    got = sinks.run_appends(feeds.edit_session_stream(feed, idle_ms=1_500_000, late="3 hours"), "t-edits")
    placed = ordered_columns(spark.createDataFrame(rows, schema), ["document_id"], ["ts", "op_id"], lags={"before": "ts"})
    silent = placed.withColumn("gap", F.coalesce((F.unix_micros("ts") - F.unix_micros("before") > 1_500_000_000).cast("long"), F.lit(0)))
    sessions = ordered_columns(silent, ["document_id"], ["ts", "op_id"], sums={"session": "gap"})
    want = ledger.undo_redo(sessions, ["document_id", "session"])
    columns = ["op_id", "ok", "journal_depth", "redo_depth"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert want.select(F.max("session")).first()[0] > 3


def test_expiry_timers(spark, tmp_path):
    """Moved, closed in time, closed too late, reopened in vain; a restart adds nothing."""
    day = lambda n: START + datetime.timedelta(days=n)
    rows = [
        (1, "sent", day(30), day(0)),
        (2, "sent", day(30), day(0)), (2, "completed", None, day(29)), (2, "partially_signed", day(90), day(40)),
        (3, "sent", day(30), day(0)), (3, "completed", None, day(31)),
        (4, "sent", day(30), day(0)), (4, "partially_signed", day(50), day(20)),
        (5, "sent", day(30), day(0)), (5, "sent", day(10), day(5)),
        (6, "draft", day(3), day(0)), (7, "sent", None, day(0)),
        (8, "sent", day(30), day(0)), (8, "voided", None, day(30)),
    ]
    schema = "envelope_id long, status string, expires_at timestamp, changed_at timestamp"
    random.Random(5).shuffle(rows)
    path = str(tmp_path / "changes")
    write_parts(spark, rows, schema, path, 4)
    write_parts(spark, [(-1, "draft", None, FAR)], schema, path, 1)
    feed = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "audit")
    for _ in range(2):
        writer = feeds.expiry_timers(feed, "60 days").writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        writer.option("checkpointLocation", str(tmp_path / "checkpoint")).start(out).awaitTermination()
        got = spark.read.parquet(out).collect()
        assert sorted((r.envelope_id, r.event, r.occurred_at) for r in got) == [
            (1, "expired", day(30)), (3, "expired", day(30)), (4, "expired", day(50)), (5, "expired", day(10))]


def test_bursts_with_spark_deduplication(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, "w", "x", start + datetime.timedelta(seconds=i)) for i in range(5)]
    path = str(tmp_path / "burst")
    write_parts(spark, rows, "job_id long, worker string, args string, ts timestamp", path, 1)
    feed = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    assert sinks.run_appends(feeds.unique_jobs_within_watermark(feed), "t-burst").count() == 1


def test_edit_sessions_end_after_silence(spark, tmp_path):
    ops = [("push", 0), ("push", 60), ("undo", 120), ("redo", 130), ("undo", 140), ("undo", 3 * 3600), ("push", 3 * 3600 + 5)]
    rows = [(i, 5, START + datetime.timedelta(seconds=s), k) for i, (k, s) in enumerate(ops)]
    feed = shuffled(spark, rows, "op_id long, document_id long, ts timestamp, kind string", "ts", (-1, -1, FAR, "undo"), str(tmp_path / "ops"), parts=1)
    got = sinks.run_appends(feeds.edit_session_stream(feed), "t-edits").orderBy("op_id").collect()
    assert [(r.ok, r.target_op, r.journal_depth, r.redo_depth) for r in got] == [
        (True, 0, 1, 0), (True, 1, 2, 0), (True, 1, 1, 1), (True, 1, 2, 0), (True, 1, 1, 1), (False, None, 0, 0), (True, 6, 1, 0)]


def test_progress_updates(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    messages = [("progress", 10), ("progress", 60), ("completed", 0), ("progress", 70)]
    rows = [(i, i % 3, start + datetime.timedelta(seconds=i), *messages[i % 4]) for i in range(30)]
    path = str(tmp_path / "progress")
    write_parts(spark, rows, "event_id long, operation_id long, ts timestamp, message string, progress long", path, 3)
    feed = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sinks.run_updates(feeds.progress_stream(feed), "t-progress", ["operation_id"])
    want = ledger.latest_progress(spark.read.parquet(path))
    columns = ["operation_id", "percent", "status"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_finished_operations_leave_the_state(spark, tmp_path):
    messages = ["progress", "completed", "progress"]
    rows = [(i, i, START + datetime.timedelta(seconds=i), messages[i % 3], 10) for i in range(30)]
    path = str(tmp_path / "progress")
    schema = "event_id long, operation_id long, ts timestamp, message string, progress long"
    write_parts(spark, rows, schema, path, 2)
    write_parts(spark, [(99, 99, FAR, "progress", 1)], schema, path, 1)
    feed = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    checkpoint = str(tmp_path / "checkpoint")
    writer = feeds.progress_stream(feed).writeStream.format("noop").outputMode("update").trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint).start().awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint)
    held = {r.key.operation_id for r in state.select("key").collect()}
    assert held == {i for i in range(30) if i % 3 != 1} | {99}


def test_keys_share_state_entries(spark, tmp_path):
    """What is kept of many envelopes lies in few state entries, so a micro-batch makes few calls for many of them."""
    rows = [(i, "sent", START + datetime.timedelta(days=30 + i % 5), START) for i in range(500)]
    schema = "envelope_id long, status string, expires_at timestamp, changed_at timestamp"
    path, checkpoint, out = (str(tmp_path / name) for name in ("changes", "checkpoint", "audit"))
    write_parts(spark, rows, schema, path, 1)
    write_parts(spark, [(-1, "draft", None, START + datetime.timedelta(days=40))], schema, path, 1)
    feed = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    writer = feeds.expiry_timers(feed, buckets=4).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint).start(out).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted((r.envelope_id, r.occurred_at) for r in got) == sorted((r[0], r[2]) for r in rows)
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    assert state.count() <= 4


def test_journal_longer_than_a_block(spark, tmp_path):
    """Undoing and redoing across blocks, over two micro-batches, gives what the batch fold gives."""
    kinds = ["push"] * 1200 + ["undo"] * 700 + ["redo"] * 300 + ["push"] * 5 + ["undo"] * 810
    rows = [(i, 7, START + datetime.timedelta(seconds=i), kind) for i, kind in enumerate(kinds)]
    schema = "op_id long, document_id long, ts timestamp, kind string"
    path = str(tmp_path / "ops")
    write_parts(spark, rows, schema, path, 2)
    feed = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sinks.run_appends(feeds.edit_session_stream(feed, idle_ms=None), "t-blocks")
    stack, undone, targets = [], [], []
    for i, kind in enumerate(kinds):
        if kind == "push":
            stack, undone = [*stack, i], []
        elif kind == "undo" and stack:
            undone.append(stack.pop())
        elif kind == "redo" and undone:
            stack.append(undone.pop())
        targets.append((i, (undone[-1] if kind == "undo" else stack[-1]) if (stack or undone) else None, len(stack), len(undone)))
    rows = got.where("ok").select("op_id", "target_op", "journal_depth", "redo_depth").collect()
    failed = {r.op_id for r in got.where("NOT ok").collect()}
    assert sorted(map(tuple, rows)) == [t for t in targets if t[0] not in failed]
    assert failed == set(range(3010, 3015))


def test_operations_of_no_document_stay_apart(spark, tmp_path):
    """Rows without a document share a state of their own; they neither take nor change that of another document."""
    rows = [(i, None if i % 3 == 0 else i % 3, START + datetime.timedelta(seconds=i), "push") for i in range(60)]
    schema = "op_id long, document_id long, ts timestamp, kind string"
    path = str(tmp_path / "ops")
    write_parts(spark, rows, schema, path, 2)
    feed = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sinks.run_appends(feeds.edit_session_stream(feed, idle_ms=None), "t-null")
    assert {(r.document_id, r.op_id, r.journal_depth) for r in got.collect()} == {(r[1], r[0], r[0] // 3 + 1) for r in rows}
