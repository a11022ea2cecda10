"""Streaming operators: progress, unique jobs, edit sessions and expiry."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioworks.operators.sweeps import OPEN_STATES, expire_envelopes

IDLE_END_MS = 30 * 60 * 1000


class Progress(StatefulProcessor):
    """Percentage and status of one operation; forgotten once it has finished and the watermark has passed its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "percent long, at long, event_id long, status string, ended_at long, ended_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        percent, at, event_id, status, ended_at, ended_id = self.newest.get() if self.newest.exists() else (None, -1, -1, "running", -1, -1)
        for batch in rows:
            for when, event, message, progress in zip(batch["at_us"], batch["event_id"], batch["message"], batch["progress"]):
                ends = {"completed": "success", "failed": "error"}.get(message)
                if (when, event) > (at, event_id):
                    at, event_id = int(when), int(event)
                    percent = 100 if message != "progress" else None if pd.isna(progress) else int(progress)
                if ends and (when, event) > (ended_at, ended_id):
                    ended_at, ended_id, status = int(when), int(event), ends
        self.newest.update((percent, at, event_id, status, ended_at, ended_id))
        if status != "running":
            wake(self.handle, at)
        yield pd.DataFrame({"operation_id": [key[0]], "percent": pd.array([percent], dtype="Int64"), "status": [status]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def plain(column: pd.Series) -> list:
    """A column's values for the state: null instead of a missing value, whole numbers that pandas holds as floats whole again."""
    if column.dtype.kind == "f":
        return [None if pd.isna(v) else int(v) for v in column.tolist()]
    return [None if pd.isna(v) else v for v in column.tolist()] if column.dtype == object else column.tolist()


def wake(handle: StatefulProcessorHandle, at_us: int | None) -> None:
    """Leave the key one timer, just behind a time in microseconds, or none."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
    if at_us is not None:
        handle.registerTimer(at_us // 1000 + 1)


def progress_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Latest state per operation, for update mode; the same columns as the batch fold.

    An operation's state goes when it has finished and no message can come that is `late` behind the newest. Needs the
    RocksDB state store.
    """
    timed = events.withWatermark("ts", late).withColumn("at_us", F.unix_micros(F.col("ts")))
    schema = T.StructType(
        [timed.schema["operation_id"], T.StructField("percent", T.LongType()), T.StructField("status", T.StringType())]
    )
    return timed.groupBy("operation_id").transformWithStateInPandas(
        statefulProcessor=Progress(), outputStructType=schema, outputMode="Update", timeMode="EventTime"
    )


def unique_jobs_within_watermark(jobs: DataFrame, seconds: int = 60) -> DataFrame:
    """Drop repeated (worker, args) with Spark's own deduplication.

    Cheaper than unique_jobs_stream and exact for bursts, but it forgets a job only
    when the watermark passes, so a repeat in the same micro-batch goes however
    far away it is.
    """
    return jobs.withWatermark("ts", f"{seconds} seconds").dropDuplicatesWithinWatermark(["worker", "args"])


#: Groups of keys that share a state entry. A checkpoint holds for one number only.
BUCKETS = 1024


def by_bucket(rows: DataFrame, keys: list[str], buckets: int) -> GroupedData:
    """Rows grouped by a hash of their keys: a call to the state costs much more than a row, so many keys share one."""
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).groupBy("_bucket")


def fields(text: str) -> list[tuple[str, str]]:
    return [tuple(field.split()) for field in text.split(",") if field]


def arrays(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} array<{kind}>" for name, kind in columns)


class Keyed(StatefulProcessor):
    """One bucket of keys, with one row of `memory` for each key in a single state value."""

    #: Types of what is kept of a key.
    memory = ""

    def __init__(self, keys: list[T.StructField]):
        self.keys = [(f.name, f.dataType.simpleString()) for f in keys]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", arrays([*self.keys, *fields(self.memory)]))

    def load(self) -> dict[tuple, tuple]:
        n = len(self.keys)
        return {row[:n]: row[n:] for row in zip(*self.held.get())} if self.held.exists() else {}

    def store(self, held: dict[tuple, tuple]) -> None:
        if held:
            self.held.update(tuple(map(list, zip(*[(*key, *kept) for key, kept in held.items()]))))
        else:
            self.held.clear()

    def close(self) -> None:
        pass


class InOrder(Keyed):
    """Holds rows back until the watermark has passed them, then passes them on in event order, key by key.

    Rows come with their time in microseconds as `at_us` and a number `row_id` that orders equal times. Whatever order they
    arrive in, within the watermark's delay, `release` sees them in the order of their batch twin. One timer a
    bucket stands at the next time that matters to one of its keys; when it goes off, the bucket's state is read and
    written once and all rows that are due are sorted and released, the others stay.
    """

    #: Types of the waiting rows' columns behind at_us and row_id.
    payload = ""
    #: Columns of the output.
    names: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        columns = [*self.keys, ("at_us", "long"), ("row_id", "long"), *fields(self.payload)]
        self.columns = [name for name, _ in columns]
        self.waiting = handle.getListState("waiting", arrays(columns))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.waiting.appendValue(tuple(plain(batch[c]) for c in self.columns))
            first = min(filter(lambda t: t is not None, (first, int(batch["at_us"].min()))))
        timers = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        if first is not None and all(first // 1000 + 1 < t for t in timers):
            wake(self.handle, first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        n = len(self.keys)
        due: dict[tuple, list[tuple]] = {}
        later: list[tuple] = []
        for part in self.waiting.get():
            for row in zip(*part):
                if row[n] <= passed:
                    due.setdefault(row[:n], []).append(row[n:])
                else:
                    later.append(row)
        if later:
            self.waiting.put([tuple(map(list, zip(*later)))])
        else:
            self.waiting.clear()
        held, out, kept = self.load(), [], {}
        wait, times = {row[:n] for row in later}, [row[n] for row in later]
        for one in dict.fromkeys([*held, *due]):
            rows = sorted(due.get(one, ()), key=lambda row: row[:2])
            memory = self.release(one, rows, held.get(one), passed, out)
            until = None if memory is None else self.until(memory)
            if until is not None and until > passed:
                times.append(until)
            elif until is not None and one not in wait:
                # what is kept of a key goes only when nothing waits
                self.drop(one, memory)
                continue
            if memory is not None:
                kept[one] = memory
        self.store(kept)
        wake(self.handle, min(times, default=None))
        if out:
            yield self.frame(out)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=self.names)

    def release(self, key: tuple, rows: list[tuple], memory: tuple | None, passed: int, out: list[tuple]) -> tuple | None:
        """Append the output for rows in order, the last of them not behind `passed`; what to keep of the key."""
        raise NotImplementedError

    def until(self, memory: tuple) -> int | None:
        """When what is kept has to be looked at; it is useless if that has passed."""
        raise NotImplementedError

    def drop(self, key: tuple, memory: tuple) -> None:
        """Clear what else the state holds of a key."""


class UniqueJobs(InOrder):
    """Jobs farther than `reach` behind the last kept one."""

    memory = "at long"
    names = ["worker", "args", "job_id", "at_us"]

    def __init__(self, keys: list[T.StructField], reach: int):
        super().__init__(keys)
        self.reach = reach

    def release(self, key, rows, memory, passed, out):
        kept = memory[0] if memory else None
        for at, job_id in rows:
            if kept is None or at - kept > self.reach:
                kept = at
                out.append((*key, job_id, at))
        return None if kept is None else (kept,)

    def until(self, memory):
        return memory[0] + self.reach


def unique_jobs_stream(jobs: DataFrame, seconds: int = 60, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Jobs kept when repeats within `seconds` of a kept job are dropped, as the batch twin keeps them.

    Jobs are judged in event order, once the watermark (`late` behind the newest) has passed them. The state of a
    (worker, args) is the waiting jobs and the time of the last kept one. Needs the RocksDB state store.
    """
    timed = jobs.withWatermark("ts", late).withColumns({"at_us": F.unix_micros(F.col("ts")), "row_id": F.col("job_id").cast("long")})
    schema = T.StructType([jobs.schema["worker"], jobs.schema["args"], T.StructField("job_id", T.LongType()), T.StructField("at_us", T.LongType())])
    keys = [jobs.schema["worker"], jobs.schema["args"]]
    kept = by_bucket(timed, ["worker", "args"], buckets).transformWithStateInPandas(
        statefulProcessor=UniqueJobs(keys, seconds * 1_000_000), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return kept.select("worker", "args", F.col("job_id").cast(jobs.schema["job_id"].dataType), F.timestamp_micros("at_us").alias("ts"))


#: Journal levels in one state entry.
BLOCK = 512


class Levels:
    """Operations of one document by journal level from 1, in blocks that are read when first used and written once."""

    def __init__(self, state, key: tuple, kept: int):
        self.state, self.key, self.kept, self.readable = state, key, kept, kept
        self.blocks: dict[int, list[int]] = {}
        self.changed: set[int] = set()

    def _block(self, number: int) -> list[int]:
        if number not in self.blocks:
            stored = number * BLOCK < self.readable
            self.blocks[number] = list(self.state.getValue((*self.key, number))[0]) if stored else []
        return self.blocks[number]

    def get(self, level: int) -> int:
        return self._block((level - 1) // BLOCK)[(level - 1) % BLOCK]

    def push(self, level: int, op_id: int) -> None:
        number, at = divmod(level - 1, BLOCK)
        self._block(number)[at:] = [op_id]
        self.changed.add(number)

    def clear(self) -> None:
        self.readable = 0
        self.blocks.clear()
        self.changed.clear()

    def write(self, top: int) -> None:
        """Bring the state to levels 1 to `top`."""
        for number in range(-(-top // BLOCK), -(-self.kept // BLOCK)):
            self.state.removeKey((*self.key, number))
        for number in self.changed:
            if number * BLOCK < top:
                self.state.updateValue((*self.key, number), (self.blocks[number][: top - number * BLOCK],))


class Journal:
    """The pushed operations of a bucket's documents, in a map state by document and block of journal levels.

    An operation reads and writes one block at most, and the state holds only what can be undone or redone.
    """

    memory = "journal long, redo long, seen long"

    def __init__(self, handle: StatefulProcessorHandle, keys: list[tuple[str, str]]):
        self.levels = handle.getMapState("levels", ", ".join(f"{name} {kind}" for name, kind in [*keys, ("block", "long")]), "ops array<long>")

    def apply(self, key: tuple, rows: list[tuple], memory: tuple | None, out: list[tuple], idle_us: int | None = None) -> tuple | None:
        """Append the outcome of (time, op_id, kind) rows in order; a silence of more than idle_us ends the session before it."""
        if not rows:
            return memory
        journal, redo, seen = memory or (0, 0, None)
        levels = Levels(self.levels, key, journal + redo)
        for at, op_id, kind in rows:
            if idle_us is not None and seen is not None and at - seen > idle_us:
                levels.clear()
                journal, redo = 0, 0
            ok, target, seen = True, None, at
            if kind == "undo":
                ok = journal > 0
                if ok:
                    target = levels.get(journal)
                    journal, redo = journal - 1, redo + 1
            elif kind == "redo":
                ok = redo > 0
                if ok:
                    journal, redo = journal + 1, redo - 1
                    target = levels.get(journal)
            else:
                journal, redo, target = journal + 1, 0, op_id
                levels.push(journal, op_id)
            out.append((*key, op_id, kind, ok, target, journal, redo))
        levels.write(journal + redo)
        return journal, redo, seen

    def drop(self, key: tuple, memory: tuple) -> None:
        Levels(self.levels, key, memory[0] + memory[1]).write(0)


def session_frame(out: list[tuple]) -> pd.DataFrame:
    """Outcomes as a frame; numbers that may be missing stay whole."""
    return pd.DataFrame(out, columns=SESSION_ROW.names).astype({"document_id": "Int64", "target_op": "Int64"})


class EditSession(Keyed):
    """Operations as they arrive, ordered inside a micro-batch only; sessions never end."""

    memory = Journal.memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.journal = Journal(handle, self.keys)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ops: dict[tuple, list[tuple]] = {}
        columns = [self.keys[0][0], "at_us", "row_id", "kind"]
        for batch in rows:
            for document, *op in zip(*[plain(batch[c]) for c in columns]):
                ops.setdefault((document,), []).append(tuple(op))
        held, out = self.load(), []
        for one, changes in ops.items():
            held[one] = self.journal.apply(one, sorted(changes, key=lambda op: op[:2]), held.get(one), out)
        self.store(held)
        yield session_frame(out)


class OrderedSession(InOrder):
    """Operations in event order; a session ends after a silence, in the state when the watermark has passed it."""

    payload = "kind string"
    memory = Journal.memory

    def __init__(self, keys: list[T.StructField], idle_ms: int):
        super().__init__(keys)
        self.idle_us = idle_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.journal = Journal(handle, self.keys)

    def release(self, key, rows, memory, passed, out):
        return self.journal.apply(key, rows, memory, out, self.idle_us)

    def until(self, memory):
        return memory[2] + self.idle_us

    def drop(self, key, memory):
        self.journal.drop(key, memory)

    def frame(self, out):
        return session_frame(out)


SESSION_ROW = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("op_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("target_op", T.LongType()),
        T.StructField("journal_depth", T.LongType()),
        T.StructField("redo_depth", T.LongType()),
    ]
)


def edit_session_stream(
    journal: DataFrame, idle_ms: int | None = IDLE_END_MS, late: str = "1 hour", buckets: int = BUCKETS
) -> DataFrame:
    """Every operation with its outcome and the operation it pushed, undid or redid.

    With idle_ms operations are applied in event order once the watermark (`late` behind the newest) has passed them,
    and a silence of more than idle_ms starts from empty stacks. Without idle_ms sessions never end and operations are
    applied at once, in order inside a micro-batch only. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    if idle_ms is not None:
        journal = journal.withWatermark("ts", late)
    timed = journal.withColumns({"at_us": F.unix_micros(F.col("ts")), "row_id": F.col("op_id").cast("long")})
    keys = [journal.schema["document_id"]]
    return by_bucket(timed, ["document_id"], buckets).transformWithStateInPandas(
        statefulProcessor=EditSession(keys) if idle_ms is None else OrderedSession(keys, idle_ms),
        outputStructType=SESSION_ROW,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "EventTime",
    )


class ExpiryTimers(InOrder):
    """A timer at each open envelope's end, moved when the end moves and deleted when the envelope closes in time."""

    payload = "status string, expires_us long"
    memory = "status string, expires long, closed long"

    def __init__(self, keys: list[T.StructField], keep_us: int):
        super().__init__(keys)
        self.keep_us = keep_us

    def release(self, key, rows, memory, passed, out):
        status, expires, closed = memory or (None, None, None)
        for at, _, changed, until in [*rows, (passed + 1, 0, None, None)]:
            if status in OPEN_STATES and expires is not None and expires < at:
                out.append((*key, "expired", expires))
                status, closed = "expired", expires
            if changed is not None and closed is None:
                status, expires = changed, until
                closed = None if changed in OPEN_STATES or changed == "draft" else at
        return None if status is None else (status, expires, closed)

    def until(self, memory):
        status, expires, closed = memory
        if closed is None:
            return expires if status in OPEN_STATES else None
        return closed + self.keep_us

    def frame(self, out):
        return pd.DataFrame(out, columns=[self.keys[0][0], "event", "expires_us"]).astype({self.keys[0][0]: "Int64"})


def expiry_timers(changes: DataFrame, late: str = "1 hour", keep_closed_days: int = 90, buckets: int = BUCKETS) -> DataFrame:
    """(envelope_id, event, occurred_at): one audit row when the watermark passes an open envelope's end.

    `changes` is (envelope_id, status, expires_at, changed_at), one row per change of an envelope. Changes that come
    within `late` of the newest count in the order of their times; at the same time, closing comes last. A closed
    envelope does not open again; that it is closed is remembered for `keep_closed_days`. Needs the RocksDB state store.
    """
    timed = changes.withWatermark("changed_at", late).withColumns(
        {
            "at_us": F.unix_micros(F.col("changed_at")),
            "row_id": F.when(F.col("status").isin(OPEN_STATES), 0).otherwise(1).cast("long"),
            "expires_us": F.unix_micros(F.col("expires_at")),
        }
    )
    schema = T.StructType([timed.schema["envelope_id"], T.StructField("event", T.StringType()), T.StructField("expires_us", T.LongType())])
    expired = by_bucket(timed, ["envelope_id"], buckets).transformWithStateInPandas(
        statefulProcessor=ExpiryTimers([timed.schema["envelope_id"]], keep_closed_days * 86_400_000_000), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return expired.select("envelope_id", "event", F.timestamp_micros("expires_us").alias("occurred_at"))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def expiry_stream(envelopes: DataFrame, now: datetime.datetime) -> DataFrame:
    """Audit rows for the overdue envelopes of a stream; stateless, so any trigger works."""
    return expire_envelopes(envelopes, now)[1]
