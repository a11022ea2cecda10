"""Many small keys: runs cut in one pass over sorted characters, folds fed by plain columns."""

import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.operators import layout
from folioworks.plans.folds import Fold, fold_rows

SCHEMA = (
    "revision_id long, page_index int, ord int, ch string, font_name string, font_size double, baseline_y double, bold boolean,"
    " italic boolean, bounds struct<x0: double, y0: double, x1: double, y1: double>"
)


def _expected(rows):
    pages, out = {}, []
    for r in rows:
        pages.setdefault(r[:2], []).append(r)
    for key, page in pages.items():
        runs = []
        for r in sorted(page, key=lambda r: r[2]):
            h = runs[-1][0] if runs else None
            font = lambda x: "Unknown" if x[4] is None else x[4].split("+")[-1]
            if h is None or font(h) != font(r) or abs(h[5] - r[5]) > 0.25 or abs(h[6] - r[6]) > 2:
                runs.append([])
            runs[-1].append(r)
        for n, run in enumerate(runs):
            side = [[r[9][i] for r in run if r[9][i] is not None] for i in range(4)]
            best = [how(s) if s else 0.0 for how, s in zip([min, min, max, max], side)]
            out.append((*key, n + 1, "".join(r[3] or "" for r in run), *run[0][4:9], *best))
    return sorted(map(str, out))


def test_char_runs_of_many_pages_need_no_aggregate(spark):
    rng, rows = random.Random(3), []
    for doc in [None, *range(40)]:
        for page in range(3):
            for i in range(rng.choice([1, 2, 7, 60])):
                box = tuple(rng.choice([None, float(rng.randrange(90))]) for _ in range(4))
                rows.append((
                    doc, page, i, rng.choice(["x", "yz", None]), rng.choice(["A", "ABCDEF+A", "A", None]), 10 + rng.randrange(4) * 0.125,
                    700.0 - i // 5, bool(i % 2), False, box,
                ))
    chars = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = layout.char_runs(chars)
        assert sorted(str(tuple(r)) for r in got.collect()) == _expected(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
    assert layout.char_runs(chars.where("false")).collect() == []


class _Counts(Fold):
    outputs = {"n": T.LongType()}
    inputs = ["v"]

    def initial(self):
        return 0

    def run(self, rows, state):
        assert not isinstance(rows, pd.DataFrame)
        n = len(rows["v"])
        return {"n": list(range(state + 1, state + n + 1))}, state + n


def test_folds_take_columns_not_frames(spark):
    rows = spark.range(3000).selectExpr("IF(id % 700 = 3, NULL, id % 700) AS k", "id AS v")
    got = fold_rows(rows, ["k"], ["v"], _Counts(), 10_000).groupBy("k").agg(F.max("n").alias("n"), F.count("*").alias("c"))
    assert got.where("n <> c").count() == 0 and got.count() == 700
