"""The page-text table: build pages from spans, upsert, flag, and read in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["revision_id", "page_index"]


def pages_from_spans(spans: DataFrame) -> DataFrame:
    """(revision_id, page_index, content, spans) from one row per span with its `ord`."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text", "bounds")))
    return (
        spans.groupBy(*KEY)
        .agg(ordered.alias("s"))
        .select(
            *KEY,
            F.array_join(F.transform("s", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("content"),
            F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["bounds"].alias("bounds"))).alias("spans"),
        )
    )


def upsert(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows by (revision_id, page_index): fresh content and spans win, the rest stays."""
    marked = fresh.select(*KEY, F.struct("content", "spans").alias("_new"))
    joined = existing.join(marked, KEY, "full")
    # a fresh empty text must win too, so the choice is by presence, not by value
    picked = {
        name: F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name))
        for name in ["content", "spans"]
    }
    return joined.withColumns(picked).drop("_new")


def mark_has_text(pages: DataFrame, page_text: DataFrame) -> DataFrame:
    """Pages with has_text: some non-empty text was extracted for them."""
    texts = page_text.where(F.col("content") != "").select(*KEY).distinct().withColumn("has_text", F.lit(True))
    return pages.join(texts, KEY, "left").withColumn("has_text", F.coalesce("has_text", F.lit(False)))


def reading_order_text(page_text: DataFrame) -> DataFrame:
    """(revision_id, page_index, text): spans joined directly. A document's text is
    its pages in order, one after a newline; it stays rows, as a document has no
    size limit. Write it with write_reading_order."""
    joined = F.array_join(F.transform("spans", lambda s: F.coalesce(s["text"], F.lit(""))), "")
    return page_text.select(*KEY, joined.alias("text"))


def write_reading_order(page_text: DataFrame, path: str) -> None:
    """One folder per revision whose part files, in name order, are its text."""
    ordered = reading_order_text(page_text).orderBy(*KEY).select("revision_id", "text")
    ordered.write.mode("error").partitionBy("revision_id").text(path)
