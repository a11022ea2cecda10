"""The filter of the quality rules keeps rows, not ids."""

from folioworks.llm import rules


def test_rows_of_one_id_are_judged_apart(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", "s"), (1, "bad", "en", "s"), (None, good + " more", "en", None), (None, None, None, None), (2, good, "en", "s"), (2, good, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS _row", "2 AS _good", "3 AS id")
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((r[0] or 0, r[1]) for r in (rows[0], rows[2], rows[4], rows[5]))
    assert rules.keep(docs.where("doc_id < 0")).count() == 0
