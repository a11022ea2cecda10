"""Hits among the spans of a page: against brute force, and on a large page."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from folioworks.functions.text import running_starts
from folioworks.operators import search


def test_places_against_brute_force():
    rng = random.Random(8)
    for gap in (0, 1):
        rows = []
        for _ in range(60):
            spans = [rng.randrange(0, 5) for _ in range(rng.randrange(0, 9))]
            total = sum(spans) + gap * max(len(spans) - 1, 0)
            cuts = sorted(rng.sample(range(total + 1), 2 * min((total + 1) // 2, rng.randrange(0, 4))))
            hits = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            ends = [0, *[b for _, b in hits]]
            pieces = [a - e for (a, _), e in zip(hits, ends)] + [total - ends[-1]]
            rows.append((spans, pieces, [b - a for a, b in hits], hits))
        rows.insert(3, (None, [2, 0], [1], [(2, 3)]))
        columns = [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(3)]
        got = search.hit_places(*columns, gap).to_pylist()
        for (spans, _, _, hits), places in zip(rows, got, strict=True):
            at, placed = 0, []
            for width in spans or []:
                placed.append((at, at + width))
                at += width + gap
            assert len(places) == len(hits)
            for (a, b), place in zip(hits, places, strict=True):
                assert place["start"] == a
                under = [i for i, (s, e) in enumerate(placed) if s < b and e > a]
                assert list(range(place["first"], max(place["first"], place["past"]))) == under
                assert place["at"] == next((i for i, (s, e) in enumerate(placed) if s <= a < e), -1)


def test_large_page(spark):
    """2,000 spans and 200 hits in a second, and a page a hundred times as large as well."""
    def page(n):
        words = spark.range(1).select(F.expr(f"transform(sequence(1, {n}), i -> if(i % 10 = 0, 'needle', concat('w', i)))").alias("w"))
        return words.selectExpr(
            "1L AS revision_id", "0 AS page_index", "array_join(w, '\n') AS content",
            "transform(w, (t, i) -> named_struct('text', t, 'bounds', named_struct('x0', 1.0D * i, 'y0', 0.0D, 'x1', i + 1.0D, 'y1', 1.0D))) AS spans",
        )

    for n, seconds in ((2000, 60), (2000, 1.5), (20_000, 10)):  # the first run compiles
        pages = page(n).checkpoint()
        start = time.time()
        found = search.search(pages, "needle").collect()
        took = time.time() - start
        assert [r.bounds.x0 for r in found] == [10.0 * i + 9 for i in range(n // 10)]
        assert took < seconds
    hits = search.pattern_search(page(3000), "needlew").collect()
    assert len(hits) == 299 and all(r.rect.x1 - r.rect.x0 == 2 for r in hits)


def test_running_starts(spark):
    df = spark.createDataFrame([([3, 0, 2],), ([],), (None,), ([5],)], "n array<int>")
    assert [r.s for r in df.select(running_starts(F.col("n"), 1).alias("s")).collect()] == [[0, 4, 5], [], [], [0]]
