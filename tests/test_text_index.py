"""The text index against the plain scan, and what a search reads of it."""

import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.operators import search, text_index


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def folder_of(spark):
    return f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"


def paged(spark, contents):
    rows = [(i // 3, i % 3, c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "revision_id long, page_index int, content string").selectExpr(
        "*",
        "transform(split(content, '\n'), (l, i) -> named_struct('text', l, 'bounds', named_struct("
        "'x0', 1.0D, 'y0', 1.0D * i, 'x1', 2.0D, 'y1', 1.0D + i))) AS spans",
    )


def rows_of(df):
    return sorted(map(str, df.collect()))


WORDS = ["the", "The", "THE", "other", "of", "straße", "STRAẞE", "ſchon", "ΣΟΦΟΣ", "σοφος", "maſs", "mass", "Kelvin", "Kelvin", "İç", "ıç", "ic", "x_1", "a1", "é", "thé", "µ", "μ"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    contents = ["", "the", " the\nof the other", "the-the the", "thé of the", None]
    contents += ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "\n", "-", "", ". "]) for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    pages = paged(spark, contents).cache()
    folder = folder_of(spark)
    text_index.build(pages, folder, buckets=5, parts=7, splits=2)
    return pages, folder


QUERIES = ["of the", "f the o", "ST", "STRAẞE", "mass", "kelvin", "ic ", "σοφος ", "the-the the", "s\nthe"]


@pytest.mark.parametrize("match_case, whole_word", [(False, False), (False, True), (True, True)])
def test_equals_the_scan(spark, corpus, match_case, whole_word):
    pages, folder = corpus
    for query in QUERIES if not match_case else ["of the", "straße", " "]:
        want = rows_of(search.search(pages, query, match_case, whole_word))
        assert rows_of(text_index.search_indexed(spark, folder, query, match_case, whole_word)) == want
    assert rows_of(text_index.search_indexed(spark, folder, "the", page=2)) == rows_of(search.search(pages, "the", page=2))


def test_phrase_needs_the_order(spark):
    folder = folder_of(spark)
    text_index.build(paged(spark, ["one two three", "two one three", "one x two three", "one two", "three one two two three"]), folder, buckets=2, parts=2)
    found = text_index.candidates(spark, folder, " one two three ", whole_word=False)
    assert {(r.revision_id, r.page_index) for r in found.collect()} == {(0, 0)}
    found = text_index.candidates(spark, folder, "one two", whole_word=True)
    assert {(r.revision_id, r.page_index) for r in found.collect()} == {(0, 0), (1, 0), (1, 1)}


def test_reads_only_parts_with_candidates(spark):
    """The plan prunes the page table by the candidates' parts, and few of its rows are read."""
    folder = folder_of(spark)
    pages = paged(spark, [f"page number{i} of many" for i in range(600)])
    text_index.build(pages, folder, buckets=4, parts=40, splits=1)
    found = text_index.search_indexed(spark, folder, "number77", whole_word=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+", plan)
    assert len(found.collect()) == 1
    scans, stack = [], [found._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            stack.append(node.plan())
            continue
        if "Scan parquet" in node.nodeName() and "content" in node.toString():
            scans.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    assert len(scans) == 1 and scans[0] < 60, scans


def test_a_term_has_one_row_for_a_lot_of_pages(spark):
    texts = ["abc abd İx ab", "", None, "ABC ſ 😀😀😀 abc", "a b c", "ab"]
    pages = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "revision_id long, page_index int, content string").coalesce(1)
    got = {(r.kind, r.term): [(p.revision_id, p.places) for p in r.pages] for r in text_index.postings(pages).collect()}
    assert got["word", "abc"] == [(0, [0]), (3, [0, 1])] and got["gram", "abc"] == [(0, []), (3, [])]
    assert got["word", text_index.ODD_PAGE] == [(0, []), (3, [])]
    want = {(i, text_index.folded(t or "")[k : k + 3]) for i, t in enumerate(texts) for k in range(len(text_index.folded(t or "")) - 2)}
    assert want == {(i, term) for (kind, term), held in got.items() if kind == "gram" for i, _ in held}


def bytes_of(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def test_postings_are_packed(spark):
    """A page of a term takes a few bytes, in the shuffle before and in the folder."""
    rng = random.Random(2)
    pages = paged(spark, [" ".join(rng.choice("abcdefgh") * 3 for _ in range(12)) for _ in range(3000)])
    packed = text_index._packed(pages).selectExpr("octet_length(keys) k", "octet_length(places) p", "pages").collect()
    posted = text_index.postings(pages).selectExpr("sum(size(pages)) n").first().n
    assert all(r.pages is None for r in packed) and sum(r.k + (r.p or 0) for r in packed) < 5 * posted
    folder = folder_of(spark)
    text_index.build(pages, folder, buckets=2, parts=2, splits=1)
    assert bytes_of(spark, f"{folder}/postings") < 5 * posted


def test_numbers_come_back():
    values = np.array([0, 1, -1, 63, 64, -64, -65, 300, 2**62, -(2**63), 2**63 - 1, *range(-200, 200)], np.int64)
    for some in (values, values[:0], values[8:9]):
        packed, sizes = text_index.varints(some)
        found, ends = text_index.numbers(packed)
        assert found.tolist() == some.tolist() and ends.tolist() == np.cumsum(sizes).tolist()


@pytest.mark.parametrize("revision", ["string(revision_id)", "if(revision_id = 1, null, revision_id)", "revision_id * 3000000000000000000 - 9000000000000000000", "CAST(revision_id AS SMALLINT)"])
def test_any_page_keys(spark, revision):
    texts = ["of the other", "the of", "The of the", "", None, "mass of the", "a the", "of", "of the ſ"]
    pages = paged(spark, texts).withColumn("revision_id", F.expr(revision))
    folder = folder_of(spark)
    text_index.build(pages, folder, buckets=2, parts=3, splits=2)
    there = pages.where("revision_id is not null")
    for query, whole in (("of the", True), ("e o", False), ("other", False)):
        got = text_index.search_indexed(spark, folder, query, whole_word=whole)
        assert rows_of(got) == rows_of(search.search(there, query, False, whole))
    held = text_index.postings(pages).where("kind = 'word' and term = 'of'").selectExpr("inline(pages)")
    want = pages.selectExpr("revision_id", "page_index", "lower(content) c").where(r"c rlike '\\bof\\b'")
    assert held.schema["revision_id"].dataType == pages.schema["revision_id"].dataType
    assert rows_of(held.select("revision_id", "page_index")) == rows_of(want.select("revision_id", "page_index"))
