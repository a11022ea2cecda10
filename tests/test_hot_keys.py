"""A key over the row limit takes the chunked way and must give the same rows."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioworks.operators import layout, ledger, pages
from folioworks.plans.folds import HeadRuns, StateMachine, Threshold, UndoRedo, fold_rows
from folioworks.plans.ordered import ordered_columns


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in columns) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, a null key, and small keys."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        kind = rng.choice(["undo", "redo", "undo", "push"]) if rng.random() < 0.8 else "push"
        rows.append((key, i * 3 + rng.randrange(3), rng.randrange(0, 40), kind, rng.choice([10.0, 10.2, 10.4]), rng.choice(["x", "x", "y"])))
    return spark.createDataFrame(rows, "k string, pos long, v long, kind string, size double, font string").cache()


def test_windows_agree(skewed):
    def run(limit):
        return rows_of(
            ordered_columns(
                skewed, ["k"], ["pos"], row_number="rn", lags={"before": "v"}, leads={"after": "kind"},
                sums={"total": "v"}, limit=limit,
            )
        )

    assert run(20) == run(10_000)


@pytest.mark.parametrize("limit", [15, 60, 250])
def test_folds_agree(skewed, limit):
    running = ordered_columns(skewed, ["k"], ["pos"], sums={"end": "v"}).withColumn("begin", F.col("end") - F.col("v"))
    running = running.cache()
    moves = {"draft": ["push", "redo"], "push": ["undo"], "undo": ["redo", "push"], "redo": ["undo"]}
    for fold in [
        Threshold("begin", "end", 55, inclusive=False),
        Threshold("begin", "end", 55, inclusive=True),
        Threshold("pos", "pos", 9, inclusive=False),
        UndoRedo("kind"),
        StateMachine("kind", "draft", moves),
        HeadRuns(["font"], {"size": 0.25}),
        HeadRuns([], {"size": 0.25}),
    ]:
        assert rows_of(fold_rows(running, ["k"], ["pos"], fold, limit)) == rows_of(
            fold_rows(running, ["k"], ["pos"], fold, 10_000)
        ), (fold.__class__.__name__, limit)


def test_folds_match_plain_python(skewed):
    ordered = {}
    for r in skewed.collect():
        ordered.setdefault(r.k, []).append(r)
    want = []
    for key, rows in ordered.items():
        kept = None
        for r in sorted(rows, key=lambda r: r.pos):
            if kept is None or r.pos - kept > 9:
                kept = r.pos
                want.append((key, r.pos))
    fold = Threshold("pos", "pos", 9, inclusive=False)
    got = fold_rows(skewed, ["k"], ["pos"], fold, 40).where("opens").select("k", "pos").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_operators_take_the_limit(spark):
    sizes = spark.createDataFrame(
        [(1, i, (i * 37) % 100 + 1) for i in range(300)] + [(2, i, 5) for i in range(4)],
        "revision_id int, page_index int, byte_size long",
    )
    assert rows_of(pages.split_by_size(sizes, 180, limit=30)) == rows_of(pages.split_by_size(sizes, 180))
    journal = spark.createDataFrame(
        [(1, i, i * 10, "undo" if i % 3 == 2 else "text.style", 1) for i in range(200)],
        "document_id int, op_id int, ts_s long, kind string, target int",
    ).withColumn("ts", F.timestamp_seconds("ts_s"))
    small, plain = (ledger.undo_redo(journal, ["document_id"], limit=n) for n in (25, None))
    assert rows_of(small) == rows_of(plain)
    assert rows_of(ledger.undo_redo_state(small, ["document_id"])) == rows_of(ledger.undo_redo_state(plain, ["document_id"]))
    merged = [rows_of(ledger.coalesce_edits(journal, ["document_id"], 30_000_000, limit=n)) for n in (25, None)]
    assert merged[0] == merged[1]
    glyphs = spark.createDataFrame(
        [(1, 0, i, "x", "F" if i % 17 else "G", 10.0, 700.0 - i // 40, False, False) for i in range(300)],
        "revision_id int, page_index int, ord int, ch string, font_name string, font_size double, baseline_y double, bold boolean, italic boolean",
    ).withColumn("bounds", F.expr("named_struct('x0', 1.0D * ord, 'y0', 0.0D, 'x1', 1.0D + ord, 'y1', 9.0D)"))
    assert rows_of(layout.char_runs(glyphs, limit=40)) == rows_of(layout.char_runs(glyphs))


def test_undo_redo_summaries_do_what_the_rows_do():
    fold, rng = UndoRedo("kind"), np.random.default_rng(0)
    for _ in range(300):
        kinds = rng.choice(["undo", "redo", "edit"], rng.integers(1, 14), p=rng.dirichlet([1, 1, 0.4]))
        rows = pd.DataFrame({"kind": kinds})
        summary = fold.summarise(rows)
        for state in itertools.product(range(6), range(6)):
            assert list(fold.run(rows, list(state))[1]) == list(fold.apply_summary(list(state), summary))
    long = fold.summarise(pd.DataFrame({"kind": ["undo"] * 10_000 + ["redo"] * 10_000}))
    assert len(long["ends"]) == 10_000 and fold.apply_summary([3, 4], long) == [7, 0]
