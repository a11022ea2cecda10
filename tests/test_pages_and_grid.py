"""Pages counted and measured where texts are read; sheet rows that cross one shuffle; near copies in few jobs."""

import random

import pytest

from folioworks import fixtures as fx
from folioworks.llm import shingles, simhash
from folioworks.operators import boxes
from folioworks.plans import page_queries
from folioworks.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    texts = [None, "", "one", "\n", "a\n" * 7, "ab\n" * 8, "\n".join(f"line {i}" * (i % 4) for i in range(30)), "ä\n\n€"]
    rows = [(i, t) for i, t in enumerate([*texts, "twice"])] + [(8, "twice"), (None, "no id\nat all")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_page_numbers_move_no_text(spark, folder):
    got, pages = fx.page_numbers(spark, folder), fx.page_text(spark, folder).select("revision_id", "page_index")
    assert got.dtypes == pages.dtypes and sorted_rows(got) == sorted_rows(pages)
    assert "Exchange" not in plan(page_queries.outline(spark, folder))


def test_line_lengths_move_no_text(spark, folder):
    got = fx.line_lengths(spark, folder)
    spans = fx.page_text(spark, folder).selectExpr("revision_id", "page_index", "posexplode(spans) AS (ord, s)")
    spans = spans.selectExpr("revision_id", "page_index", "ord", "length(s.text) AS chars")
    assert got.dtypes == spans.dtypes and sorted_rows(got) == sorted_rows(spans)
    assert "Exchange" not in plan(got)


def test_pairs_of_boxes_are_pairs_of_numbers(spark, monkeypatch):
    seen, plain = [], boxes._hidden
    monkeypatch.setattr(boxes, "_hidden", lambda edges: (seen.append(edges.dtypes), plain(edges))[1])
    rows = [(1, 0, 0.0, 0.0, 90.0, 90.0, 0), (1, 0, 5.0, 5.0, 60.0, 60.0, 1)]
    schema = "doc int, page int, x0 double, y_top double, x1 double, y_bot double, ord int"
    got = boxes.detected_boxes(spark.createDataFrame(rows, schema), spark.createDataFrame([], schema), ["doc", "page"])
    assert [r.ord for r in got.collect()] == [0]
    assert seen == [[("outer", "bigint"), ("inner", "bigint")]]


def test_sheet_rows_cross_one_shuffle(spark):
    rows = [(1, 2, "B2", "x"), (1, 2, "A2", " y "), (1, 5, "C5", "z"), (None, 1, "A1", "no sheet"), (2, None, "A1", "no row"),
            (2, 3, "A3", None), (3, None, "A1", "only"), (1, None, "A1", "none")]
    cells = spark.createDataFrame(rows, "sheet_id long, row int, ref string, value string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grid = files.sheet_grid(cells)
        moved = [line for line in plan(grid).splitlines() if "Exchange hashpartitioning(sheet_id" in line]
        got = {(r.sheet_id, r.row): (r.is_header, r.cells) for r in grid.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {
        (1, 2): (True, ["y", "x"]), (1, 5): (False, ["", "", "z"]), (1, None): (None, ["none"]), (2, None): (None, ["no row"]),
        (2, 3): (True, [""]), (3, None): (None, ["only"]),
    }
    # the cells by sheet and row, the first rows by sheet and then by sheet and row: no exchange by sheet carries cells
    assert not [line for line in moved if ", row" not in line and "cells" in line]
    assert len(moved) == 3


def test_components_are_found_once_however_many_rounds(spark, monkeypatch):
    calls, plain = [], shingles.components
    monkeypatch.setattr(shingles, "components", lambda *a: (calls.append(1), plain(*a))[1])
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:20])]
    for _ in range(24):  # each differs by a word from the one before it
        drift = texts[-1].split()
        drift[-1:] = [drift[-1], rng.choice(words)] if len(drift) < 32 else [rng.choice(words)]
        texts.append(" ".join(drift))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "quite another text of six words"])], "doc_id long, text string")
    sets = [set(shingles.shingle_set(t).tolist()) for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    kept = simhash.keep_first(docs, width=5, similarity=0.8, bucket_limit=2)
    first = {min(i for i, q in enumerate(part) if q == p) for p in part}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*first, len(texts)})
    assert len(calls) == 1


def test_links_of_near_copies_follow_their_number(spark, monkeypatch):
    """Texts alike in all but a word: the links handed on are a small multiple of the texts, not their pairs."""
    passage, seen, plain = " ".join(f"p{i}" for i in range(90)), [], shingles.components
    texts = [f"{passage} e{i}" for i in range(40)] + ["some other text of seven words"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(shingles, "components", lambda found: (seen.append(found.count()), plain(found))[1])
    kept = simhash.keep_first(docs, width=5, similarity=0.8, bucket_limit=4)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 40]
    assert len(seen) == 1 and seen[0] <= 3 * 40


def test_links_that_labels_do_not_reach_go_on(spark):
    """A chain is longer than the hops of a round: what is left between its parts connects them in the end."""
    chain = spark.createDataFrame([(i, i + 1) for i in random.Random(1).sample(range(64), 64)], "a long, b long")
    labels, rest = shingles._labels(chain)
    for _ in range(2):
        found = labels.selectExpr("fp a", "component b").unionByName(rest)
        assert {r.component for r in shingles.components(found).collect()} == {0}
        left = rest.count()
        assert 0 < left < 64
        labels, rest = shingles._labels(rest, labels)
        assert rest.count() < left
    # more links between two parts than one, and links inside a part, are not handed on
    more = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (1, 2)], "a long, b long")
    labels, rest = shingles._labels(more)
    assert {(r.fp, r.component) for r in labels.collect()} == {(1, 1), (2, 1)} and rest.isEmpty()
