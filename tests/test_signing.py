"""Joint signing replay: its chunk summaries, the chunked way, and every reason of a refusal."""

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.operators import ledger
from folioworks.plans.folds import JointSigning

EVENTS = ["sent", "viewed", "signed", "signed", "declined", "voided", "expired", "archived"]


def machine():
    return JointSigning("event", "place", "n", "parallel", ledger.SIGNING_REFUSALS)


def frame(rows, n, parallel):
    return pd.DataFrame([(e, p, None if p is None else n, None if p is None else parallel) for e, p in rows], columns=["event", "place", "n", "parallel"])


steps = st.lists(st.tuples(st.sampled_from(EVENTS), st.integers(1, 4)), max_size=40)


@given(steps, steps, st.booleans(), st.integers(2, 4))
@settings(deadline=None, max_examples=300)
def test_summary_acts_like_its_rows(before, chunk, parallel, n):
    def rows(items):
        return frame([(e, None if e in ("sent", "voided", "expired", "archived") or p > n else p) for e, p in items], n, parallel)

    fold = machine()
    _, state = fold.run(rows(before), fold.initial())
    summary = fold.summarise(rows(chunk))
    assert len(summary) <= len(chunk)
    assert fold.apply_summary(state, summary) == fold.run(rows(chunk), state)[1]


def test_summary_stays_small():
    rng = random.Random(4)
    many = [(rng.choice(EVENTS[:5]), rng.randrange(1, 6)) for _ in range(5000)]
    many = [(e, None if e == "sent" else p) for e, p in many]
    assert len(machine().summarise(frame(many, 5, False))) < 60


@pytest.fixture(scope="module")
def signing(spark):
    rng = random.Random(9)
    signers = [(e, 100 * e + i, i // 2) for e in range(12) for i in range(1 + e % 5)]
    envelopes = [(e, [None, "parallel", "sequential"][e % 3]) for e in range(11)]
    events = []
    for i in range(900):
        e = 3 if rng.random() < 0.5 else rng.randrange(13)
        kind = "sent" if rng.random() < 0.06 else rng.choices(EVENTS, [1, 6, 8, 2, 1, 0.15, 0.15, 0.2])[0]
        whom = None if kind in ("sent", "voided", "expired", "archived") else 100 * e + rng.randrange(2 + e % 5)
        events.append((e, i, rng.randrange(500), kind, whom))
    return (
        spark.createDataFrame(events, "envelope_id long, event_id long, occurred_at long, event string, signer_id long").cache(),
        spark.createDataFrame(signers, "envelope_id long, signer_id long, signer_order long").cache(),
        spark.createDataFrame(envelopes, "envelope_id long, signing_mode string").cache(),
    )


def slow_replay(events, signers, envelopes):
    """Every event through plain objects."""
    mode = {r.envelope_id: r.signing_mode for r in envelopes}
    status = {(r.envelope_id, r.signer_id): "pending" for r in signers}
    turn = {e: [r.signer_id for r in sorted(signers, key=lambda r: (r.signer_order, r.signer_id)) if r.envelope_id == e] for e in {r.envelope_id for r in signers}}
    envelope, out = {}, {}
    for r in sorted(events, key=lambda r: (r.occurred_at, r.event_id)):
        before, key = envelope.get(r.envelope_id, "draft"), (r.envelope_id, r.signer_id)
        live, mine, why, after = before in ("sent", "partially_signed"), status.get(key), None, before
        if r.event == "sent":
            why, after = (None, "sent") if before == "draft" else ("invalid_transition", before)
        elif r.event in ("voided", "expired"):
            why, after = (None, r.event) if live else ("invalid_transition", before)
        elif r.event == "archived":
            why = "invalid_transition"
        elif mine is None:
            why = "signer_not_found"
        elif r.event == "viewed":
            why = None if mine == "pending" else "invalid_transition"
        elif r.event == "declined":
            why, after = (None, "declined") if (before, mine) == ("sent", "pending") else ("invalid_transition", before)
        elif before == "draft":
            why = "envelope_not_sent"
        elif not live:
            why = "envelope_already_completed" if before == "completed" else f"envelope_{before}"
        elif mine != "viewed":
            why = "signer_not_viewed_yet" if mine == "pending" else f"already_{mine}"
        else:
            waiting = [s for s in turn[r.envelope_id] if status[r.envelope_id, s] not in ("signed", "declined")]
            if mode.get(r.envelope_id) != "parallel" and waiting[0] != r.signer_id:
                why = "signer_out_of_order"
            else:
                after = "completed" if len(waiting) == 1 else "partially_signed"
        if why is None and mine is not None:
            status[key] = r.event
        envelope[r.envelope_id] = after
        out[r.event_id] = (before, after, mine, status.get(key), why is None, why)
    return out


def test_replay_against_plain_objects(signing):
    events, signers, envelopes = signing
    want = slow_replay(events.collect(), signers.collect(), envelopes.collect())
    for limit in (3, 40, None):
        got = ledger.signing_replay(events, signers, envelopes, limit)
        assert {r.event_id: (r.state_before, r.state_after, r.signer_before, r.signer_after, r.accepted, r.reason) for r in got.collect()} == want
    assert "completed" in {w[1] for w in want.values()}


def test_reasons_of_refusals(spark):
    """One envelope per reason, after the life of an envelope in order."""
    log = {
        "envelope_not_sent": ["viewed 1", "signed 1"],
        "signer_not_viewed_yet": ["sent", "signed 1"],
        "signer_out_of_order": ["sent", "viewed 2", "signed 2"],
        "already_signed": ["sent", "viewed 1", "signed 1", "signed 1"],
        "envelope_already_completed": ["sent", "viewed 1", "signed 1", "viewed 2", "signed 2", "signed 2"],
        "envelope_declined": ["sent", "viewed 2", "declined 1", "signed 2"],
        "envelope_voided": ["sent", "viewed 1", "voided", "signed 1"],
        "envelope_expired": ["sent", "viewed 1", "signed 1", "expired", "signed 2"],
        "signer_not_found": ["sent", "viewed 9"],
        "invalid_transition": ["sent", "viewed 1", "declined 1"],
    }
    events = [(e, i, i, step.split()[0], int(step.split()[1]) if " " in step else None) for e, steps in log.items() for i, step in enumerate(steps)]
    events = spark.createDataFrame(events, "envelope_id string, event_id long, occurred_at long, event string, signer_id long")
    signers = spark.createDataFrame([(e, s, s) for e in log for s in (1, 2)], "envelope_id string, signer_id long, signer_order long")
    got = ledger.signing_replay(events, signers, spark.createDataFrame([], "envelope_id string, signing_mode string")).collect()
    for envelope, steps in log.items():
        own = sorted((r for r in got if r.envelope_id == envelope), key=lambda r: r.event_id)
        assert [r.reason for r in own] == [None] * (len(steps) - 1) + [envelope]


def moved(df, column):
    """Exchanges in the frame's plan that carry a column."""
    found, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
            continue
        found += node.nodeName() == "Exchange" and f"{column}#" in node.output().mkString(",")
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_events_cross_one_shuffle(spark, signing):
    """Dealt by envelope once, for their signers and for the replay."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moved(ledger.signing_replay(*signing), "event_id") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_and_null_signers(spark):
    """As a left join has it: a signer listed twice doubles the signer's events, null is nobody, nulls of both sides do not meet."""
    events = [(1, i, i, e, s) for i, (e, s) in enumerate([("sent", None), ("viewed", 5), ("signed", 5), ("viewed", 6), ("viewed", None)])] + [(None, 9, 9, "viewed", 5)]
    events = spark.createDataFrame(events, "envelope_id int, event_id long, occurred_at long, event string, signer_id int")
    signers = spark.createDataFrame([(1, 5, 0), (1, 5, 0), (1, 6, 1), (1, None, 2), (None, 5, 0)], "envelope_id long, signer_id long, signer_order long")
    envelopes = spark.createDataFrame([(1, "parallel")], "envelope_id long, signing_mode string")
    got = ledger.signing_replay(events, signers, envelopes)
    assert got.columns == ["envelope_id", "signer_id", "event_id", "occurred_at", "event", *got.columns[5:]]
    assert [kind for _, kind in got.dtypes[:2]] == ["int", "int"]
    rows = [(r.envelope_id, r.event_id, r.reason == "signer_not_found") for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(1, 0, False), *[(1, i, False) for i in (1, 1, 2, 2, 3)], (1, 4, True), (None, 9, True)], key=str)
