"""Detected boxes against a plain greedy pass in Python."""

import random

import pytest

from folioworks.operators import boxes as op

SCHEMA = "doc int, page int, x0 double, y_top double, x1 double, y_bot double, ord int"


def brute(boxes, lines, tol=3):
    def ok(b):
        return all(v is not None and abs(v) < float("inf") for v in b[2:6]) and b[2] <= b[4] and b[3] <= b[5]

    first = [b for b in boxes if ok(b)]
    found = [(b, 0) for b in first]
    for b in filter(ok, lines):
        x, y = (b[2] + b[4]) / 2, (b[3] + b[5]) / 2
        if b[4] - b[2] >= 60 and not any(o[:2] == b[:2] and o[2] <= x <= o[4] and o[3] <= y <= o[5] for o in first):
            found.append(((*b[:3], max(b[3] - 30, 0), b[4], b[5] + 1, b[6]), 1))
    found.sort(key=lambda f: (-(f[0][4] - f[0][2]) * (f[0][5] - f[0][3]), f[1], f[0][6], f[0][2:6]))
    kept = []
    for b, d in found:
        if not any(
            o[:2] == b[:2] and b[2] >= o[2] - tol and b[4] <= o[4] + tol and b[3] >= o[3] - tol and b[5] <= o[5] + tol for o, _ in kept
        ):
            kept.append((b, d))
    return sorted((*b[:2], d, b[6], *b[2:6]) for b, d in kept if b[4] - b[2] >= 20 and b[5] - b[3] >= 14)


def run(spark, boxes, lines):
    got = op.detected_boxes(spark.createDataFrame(boxes, SCHEMA), spark.createDataFrame(lines, SCHEMA), ["doc", "page"])
    rows = [(r.doc, r.page, r.detection, r.ord, r.x0, r.y_top, r.x1, r.y_bot) for r in got.collect()]
    return got, sorted(rows, key=lambda r: [(v is None, v or 0) for v in r])


@pytest.mark.parametrize("seed", [1, 2])
def test_nests_overlaps_and_drifts_as_a_greedy_pass_leaves_them(spark, seed):
    rng = random.Random(seed)
    boxes, lines = [], []
    for i in range(260):
        x, y = rng.choice([rng.randint(-40, 400), rng.randint(0, 30) * 2 + 0.5]), rng.randint(0, 300)
        w, h = rng.choice([(30, 20), (200, 120), (rng.randint(0, 90), rng.randint(0, 60)), (31, 21)])
        boxes.append((1, rng.randint(0, 2), float(x), float(y), float(x + w), float(y + h), i))
        if i % 4 == 0:
            lines.append((1, rng.randint(0, 2), float(x), float(y + h), float(x + rng.randint(40, 150)), float(y + h + 2), i))
    # a chain in which each lies in the one before it, but not in the one before that
    boxes += [(2, 0, 100.0 + 3 * k, 10.0, 180.0 + 3 * k - 0.01 * k, 50.0, k) for k in range(8)]
    _, got = run(spark, boxes, lines)
    assert got == brute(boxes, lines)


def test_equal_and_broken_boxes(spark):
    inf, nan = float("inf"), float("nan")
    boxes = [
        (1, 0, 10.0, 10.0, 50.0, 50.0, 2), (1, 0, 10.0, 10.0, 50.0, 50.0, 1), (1, 0, None, 10.0, 50.0, 50.0, 3),
        (1, 0, nan, 10.0, 50.0, 50.0, 4), (1, 0, -inf, 10.0, inf, 50.0, 5), (1, 0, 90.0, 10.0, 50.0, 50.0, 6),
        (1, 1, 10.0, 10.0, 15.0, 50.0, 7),
    ]
    got, rows = run(spark, boxes, [])
    assert rows == [(1, 0, 0, 1, 10.0, 10.0, 50.0, 50.0)]
    assert [r.kind for r in got.collect()] == ["checkbox"]
    assert run(spark, [], [])[1] == []
    far, _ = run(spark, [(None, 0, 0.0, 0.0, 100.0, 100.0, 0), (None, 0, 5.0, 5.0, 60.0, 60.0, 1), (None, None, 0.0, 0.0, 80.0, 20.0, 2)], [])
    assert sorted(r.ord for r in far.collect()) == [0, 2]


def test_a_full_page_meets_no_pairs_of_strangers(spark):
    n = 100_000
    grid = spark.range(n).selectExpr(
        "1 AS doc", "0 AS page", "double(id % 400 * 40) AS x0", "double(id div 400 * 40) AS y_top",
        "double(id % 400 * 40 + 30) AS x1", "double(id div 400 * 40 + 30) AS y_bot", "int(id) AS ord",
    )
    frame = spark.createDataFrame([(1, 0, -10.0, -10.0, 8000.0, 20000.0, n)], SCHEMA)
    got = op.detected_boxes(grid.unionByName(frame), spark.createDataFrame([], SCHEMA), ["doc", "page"])
    assert got.count() == n // 2 + 1
    points = op._at(op._valid(grid, ["doc", "page"]), *map(op.F.col, ("x0", "y_top")), op.F.lit(30.0))
    assert op._holders(points, op._valid(grid, ["doc", "page"]), 3.0).count() == n
