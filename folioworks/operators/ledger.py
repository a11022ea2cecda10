"""Workflow ledgers: signing order, envelope replay, edit journals and operation progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.plans.folds import JointSigning, StateMachine, Threshold, UndoRedo, fold_rows
from folioworks.plans.ordered import ordered_columns
from folioworks.session import spread_partitions

# Legal moves of envelopes and signers.
ENVELOPE_MOVES = {
    "draft": ["sent", "draft"],
    "sent": ["partially_signed", "declined", "voided", "expired"],
    "partially_signed": ["completed", "declined", "voided", "expired"],
    "completed": [],
    "declined": [],
    "voided": [],
    "expired": [],
}
SIGNER_MOVES = {"pending": ["viewed", "declined", "pending"], "viewed": ["signed", "declined"], "signed": [], "declined": []}

# Why nobody can sign in a state.
SIGNING_REFUSALS = {
    "draft": "envelope_not_sent",
    "completed": "envelope_already_completed",
    "declined": "envelope_declined",
    "voided": "envelope_voided",
    "expired": "envelope_expired",
}

DONE = ["signed", "declined"]
SIGNER = ["envelope_id", "signer_id"]


def unsigned_count(envelopes: DataFrame, signers: DataFrame) -> DataFrame:
    """(envelope_id, unsigned, complete): signers still to act."""
    waiting = signers.groupBy("envelope_id").agg(F.count_if(~F.col("status").isin(DONE)).alias("unsigned"))
    joined = envelopes.select("envelope_id").join(waiting, "envelope_id", "left")
    counted = joined.withColumn("unsigned", F.coalesce("unsigned", F.lit(0).cast("bigint")))
    return counted.withColumn("complete", F.col("unsigned") == 0)


def next_signers(envelopes: DataFrame, signers: DataFrame) -> DataFrame:
    """(envelope_id, signer_order) of those who may act now: everyone in parallel
    mode, else the first who has neither signed nor declined.

    The first is a minimum, so it combines before the shuffle.
    """
    first = signers.where(~F.col("status").isin(DONE)).groupBy("envelope_id").agg(
        F.min("signer_order").alias("signer_order")
    )
    modes = envelopes.select("envelope_id", F.coalesce("signing_mode", F.lit("sequential")).alias("mode"))
    in_turn = first.join(modes.where("mode <> 'parallel'"), "envelope_id").select("envelope_id", "signer_order")
    everyone = signers.select("envelope_id", "signer_order").join(
        modes.where("mode = 'parallel'"), "envelope_id", "left_semi"
    )
    return in_turn.unionByName(everyone)


def audit_trail(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Events numbered per envelope in time order, with the seconds until the next one."""
    placed = ordered_columns(
        events, ["envelope_id"], ["occurred_at", "event_id"],
        row_number="event_no", leads={"_next_at": "occurred_at"}, limit=limit,
    )
    dwell = F.unix_micros(F.col("_next_at").cast("timestamp")) - F.unix_micros(F.col("occurred_at").cast("timestamp"))
    return placed.withColumn("dwell_micros", dwell).drop("_next_at")


def envelope_replay(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Replay (envelope_id, event_id, occurred_at, event) through the envelope's states.

    Signing moves a sent envelope to partially_signed and may repeat there. Adds
    state_before, state_after, accepted and, for refused events, a reason.
    """
    moves = {state: list(targets) for state, targets in ENVELOPE_MOVES.items()}
    moves["partially_signed"].append("partially_signed")
    target = F.when(F.col("event") == "signed", "partially_signed").otherwise(F.col("event"))
    fold = StateMachine("_target", "draft", moves)
    replayed = fold_rows(
        events.withColumn("_target", target), ["envelope_id"], ["occurred_at", "event_id"], fold, limit
    )
    refusal = F.lit("invalid_transition")
    for state, why in SIGNING_REFUSALS.items():
        refusal = F.when((F.col("event") == "signed") & (F.col("state_before") == state), why).otherwise(refusal)
    return replayed.withColumn("reason", F.when(~F.col("accepted"), refusal)).drop("_target")


def signer_replay(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Replay (signer_id, event_id, occurred_at, event) through a signer's states."""
    fold = StateMachine("event", "pending", SIGNER_MOVES)
    return fold_rows(events, ["signer_id"], ["occurred_at", "event_id"], fold, limit)


def _with_signers(events: DataFrame, known: DataFrame) -> DataFrame:
    """The left join of events with known by envelope and signer, for events dealt by envelope.

    A join would deal them by both and leave the fold to deal them by envelope again. Here the known rows of a signer come before
    the signer's events, where Spark leaves rows that are dealt by part of the keys.
    """
    fields = [c for c in known.columns if c not in SIGNER]
    own = known.dropna(subset=SIGNER).groupBy(*SIGNER).agg(F.collect_list(F.struct(*fields)).alias("_own"))
    own = own.repartition(spread_partitions(events.sparkSession), "envelope_id")
    both = own.select("*", F.lit(True).alias("_first")).unionByName(events.withColumn("_first", F.lit(False)), allowMissingColumns=True)
    mine = Window.partitionBy(*SIGNER).orderBy(F.desc("_first")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_own", F.first("_own", ignorenulls=True).over(mine)).where("not _first")
    order = [*[F.col(c).cast(events.schema[c].dataType).alias(c) for c in SIGNER], *[c for c in events.columns if c not in SIGNER]]
    return met.select(*order, F.explode_outer("_own").alias("_own")).select(*SIGNER, *order[2:], "_own.*")


def signing_replay(events: DataFrame, signers: DataFrame, envelopes: DataFrame, limit: int | None = None) -> DataFrame:
    """Replay (envelope_id, event_id, occurred_at, event, signer_id) through an envelope and its signers together.

    `signers` is (envelope_id, signer_id, signer_order), `envelopes` (envelope_id, signing_mode), null meaning
    sequential. Events are sent, viewed, signed, declined, voided and expired. Adds the states of the envelope and of
    the event's signer before and after, accepted, and a reason for each refused event. In sequential mode signers sign
    in their order (ties by id); the last signature completes the envelope; only a signer who has not looked yet can
    decline, and only before the first signature. A signer that the envelope does not have is `signer_not_found`.
    """
    places = ordered_columns(
        signers.select("envelope_id", "signer_id", "signer_order"), ["envelope_id"], ["signer_order", "signer_id"],
        row_number="_place", limit=limit,
    )
    counts = signers.groupBy("envelope_id").agg(F.count(F.lit(1)).alias("_signers"))
    modes = envelopes.select("envelope_id", F.coalesce(F.col("signing_mode") == "parallel", F.lit(False)).alias("_parallel"))
    known = places.join(counts.join(modes, "envelope_id", "left"), "envelope_id")
    known = known.select("envelope_id", "signer_id", "_place", "_signers", F.coalesce("_parallel", F.lit(False)).alias("_parallel"))
    fold = JointSigning("event", "_place", "_signers", "_parallel", SIGNING_REFUSALS)
    replayed = fold_rows(
        events, ["envelope_id"], ["occurred_at", "event_id"], fold, limit,
        widen=lambda rows, dealt: _with_signers(rows, known) if dealt else rows.join(known, SIGNER, "left"),
    )
    return replayed.drop("_place", "_signers", "_parallel")


# ── edit journals ───────────────────────────────────────────────────────────

COALESCING_KINDS = ["text.style", "annot.update"]


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def coalesce_edits(journal: DataFrame, keys: list[str], gap_micros: int = 800_000, limit: int | None = None) -> DataFrame:
    """The journal after merging: an operation goes when the next one of its key
    is the same coalescing kind on the same target within the gap."""
    placed = ordered_columns(
        journal, keys, ["ts", "op_id"], leads={"_kind": "kind", "_target": "target", "_ts": "ts"}, limit=limit
    )
    merged = (
        F.col("kind").isin(COALESCING_KINDS)
        & (F.col("kind") == F.col("_kind"))
        & F.col("target").eqNullSafe(F.col("_target"))
        & (micros(F.col("_ts")) - micros(F.col("ts")) < gap_micros)
    )
    return placed.where(~F.coalesce(merged, F.lit(False))).drop("_kind", "_target", "_ts")


def undo_redo(journal: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Every operation with ok, journal_depth and redo_depth after it."""
    return fold_rows(journal, keys, ["ts", "op_id"], UndoRedo("kind"), limit)


def undo_redo_state(replayed: DataFrame, keys: list[str]) -> DataFrame:
    """What the two stacks of each key hold in the end: (keys, level, op_id, stack).

    A level of the journal holds the last operation pushed to it, so the stacks
    come from aggregates; no journal is gathered into one value.
    """
    position = F.struct("ts", "op_id")
    final = replayed.groupBy(*keys).agg(
        F.max_by(F.struct("journal_depth", "redo_depth"), position).alias("_end")
    )
    pushes = replayed.where(~F.col("kind").isin("undo", "redo"))
    levels = pushes.groupBy(*keys, F.col("journal_depth").alias("level")).agg(F.max_by("op_id", position).alias("op_id"))
    depth, redo = F.col("_end.journal_depth"), F.col("_end.redo_depth")
    stack = F.when(F.col("level") <= depth, "journal").when(F.col("level") <= depth + redo, "redo")
    return levels.join(final, keys).withColumn("stack", stack).where(F.col("stack").isNotNull()).drop("_end")


# ── operations and jobs ─────────────────────────────────────────────────────

# Plain-language failure messages.
FAILURE_MESSAGES = {
    "password_required": "The document is password-protected",
    "invalid_pdf": "The file is not a readable PDF",
    "not_found": "The document could not be found",
    "no_pages": "The document has no pages to process",
}
OTHER_FAILURE = "The conversion failed (see logs for details)"


def latest_progress(events: DataFrame) -> DataFrame:
    """The state of each operation after all its messages: (operation_id, percent, status).

    Completed and failed set 100 percent and the status; a later progress message
    moves the percentage only.
    """
    percent = F.when(F.col("message") == "progress", F.col("progress")).otherwise(100)
    status = F.when(F.col("message") == "completed", "success").when(F.col("message") == "failed", "error")
    position = F.struct("ts", "event_id")
    return events.groupBy("operation_id").agg(
        F.max_by(percent, position).cast("bigint").alias("percent"),
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), position)), F.lit("running")).alias("status"),
    )


def progress_violations(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Progress messages that fall below the one before, or lie outside 0..100."""
    progress = events.where("message = 'progress'")
    placed = ordered_columns(
        progress, ["operation_id"], ["ts", "event_id"], lags={"previous": "progress"}, limit=limit
    )
    return placed.where((F.col("progress") < F.col("previous")) | ~F.col("progress").between(0, 100))


def failure_message(reason: Column) -> Column:
    text = F.lit(OTHER_FAILURE)
    for code, message in FAILURE_MESSAGES.items():
        text = F.when(reason == code, message).otherwise(text)
    return F.when(reason.isNotNull(), text)


def operation_durations(operations: DataFrame) -> DataFrame:
    """Operations with duration_micros and a readable failure message."""
    return operations.withColumns(
        {
            "duration_micros": micros(F.col("finished_at")) - micros(F.col("started_at")),
            "failure": failure_message(F.col("reason")),
        }
    )


def operation_report(operations: DataFrame) -> DataFrame:
    """(kind, status, operations, total_micros, longest_micros)"""
    return operation_durations(operations).groupBy("kind", "status").agg(
        F.count(F.lit(1)).alias("operations"),
        F.sum("duration_micros").alias("total_micros"),
        F.max("duration_micros").alias("longest_micros"),
    )


def unique_jobs(jobs: DataFrame, seconds: int = 60, limit: int | None = None) -> DataFrame:
    """Jobs kept when equal (worker, args) within `seconds` of a kept job are dropped.

    The distance counts from the kept job, not from the previous one.
    """
    timed = jobs.withColumn("_at", micros(F.col("ts")))
    fold = Threshold("_at", "_at", seconds * 1_000_000, inclusive=False)
    kept = fold_rows(timed, ["worker", "args"], ["ts", "job_id"], fold, limit)
    return kept.where("opens").drop("_at", "opens", "run")
