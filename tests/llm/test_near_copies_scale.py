"""What near copies broadcast, shuffle and leave behind."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioworks.llm import common, shingles, simhash
from folioworks.session import FILE_CLEANUP


@pytest.fixture
def threshold(spark):
    """Sets the size up to which Spark broadcasts a table."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield lambda size: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_run(df):
    """The plan that Spark came to while it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_signatures_are_not_broadcast(spark, monkeypatch, threshold):
    """3,000 fingerprints are 48 KB, their 198,000 signatures some hundred times that; Spark takes them for 48 KB too."""
    threshold("64k")
    seen, plain = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: (seen.append(df), plain(df))[1])
    simhash.fingerprint_links(spark.range(3000).select(F.xxhash64("id").alias("fp"))).count()
    assert "Generate explode" in (plan := plan_run(seen[0]))
    assert "BroadcastExchange" not in plan


def text_exchanges(df):
    """Exchanges of the frame that carry texts, alone or in a struct."""
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            stack.append(node.plan())
            continue
        if node.nodeName() == "Exchange" and any("string" in node.output().apply(i).dataType().catalogString() for i in range(node.output().size())):
            found.append(node.toString().splitlines()[0])
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return found


def test_kept_texts_cross_one_shuffle(spark, threshold):
    threshold("-1")
    rows = [(i, f"some text number {(i or 0) % 5} of a few words", "x") for i in (None, *range(9), 3, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    kept = simhash.keep_first(docs, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]
    assert len(text_exchanges(kept)) == 1


def test_whole_sets_shuffle_no_text(spark, threshold):
    """Sets of the wanted rows only, whatever repeats or has no id."""
    threshold("-1")
    texts = [f"w{i} a b c d e f" for i in range(300)]
    rows = [*enumerate(texts), (None, texts[7]), (7, texts[7]), (7, texts[8]), (400, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = docs.where("doc_id in (7, 11, 400) or doc_id is null").distinct().select(
        F.row_number().over(Window.orderBy("doc_id", "text")).cast("long").alias("fp"), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("one"), "text"
    )
    wanted = common.stored(wanted)
    got = shingles._whole_sets(docs, wanted.drop("text"), "doc_id", "text", 5, 42)
    want = {r.fp: shingles.shingle_set(r.text).tolist() for r in wanted.collect()}
    assert len(want) == 5 and sorted((r.fp, r.toks) for r in got.collect()) == sorted(want.items())
    assert text_exchanges(got) == []


def test_stored_and_cut_leave_no_shuffle_files(spark):
    """What the driver cleans up on its own depends on when it collects garbage."""
    before = spark.conf.get(FILE_CLEANUP, None)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        return {f for d in local.localDirs() for at, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}

    for write in (common.stored, common.cut):
        sums = spark.range(50_000).groupBy((F.col("id") % 20_000).alias("k")).agg(F.sum("id").alias("s"))
        there = held()
        assert write(sums).count() == 20_000
        wide = [f for f in held() - there if (os.stat(p).st_size if os.path.exists(p := local.getFile(f).getPath()) else 0) > 10_000]
        assert wide == []
    assert spark.conf.get(FILE_CLEANUP, None) == before


def test_stored_tables_are_not_broadcast(spark, threshold):
    """100,000 rows of few different values are 2.4 MB in memory and some kB in files."""
    threshold("1m")
    rows = common.stored(spark.range(100_000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("v")))
    other = spark.range(100_000).select((F.col("id") % 100_000).alias("k"))
    assert "BroadcastExchange" not in plan_run(other.join(rows.where("v = 1"), "k"))
