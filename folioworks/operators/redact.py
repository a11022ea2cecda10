"""Redaction: marks from hits, text under marks, masking and the survivor check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.functions.text import running_starts
from folioworks.plans.rows import positions
from folioworks.session import ensure_checkpoint_dir

BAND = 36.0  # height in points of the strips that split a page's rectangle join

# gram lengths that anchor the survivor search; a text uses the longest that fits
GRAMS = [12, 3, 1]
SLOT_BITS = 12


def marks_for_hits(hits: DataFrame, accepted: DataFrame, inline: DataFrame | None = None) -> DataFrame:
    """Distinct (revision_id, page_index, rect) of the accepted hits and inline marks.

    `accepted` holds (revision_id, hit_id) and, for hits of several detectors,
    preset; ids without a hit drop out.
    """
    key = [c for c in ["revision_id", "preset", "hit_id"] if c in accepted.columns]
    chosen = hits.join(accepted.distinct(), key, "left_semi")
    marks = chosen.select("revision_id", "page_index", "rect")
    if inline is not None:
        marks = marks.unionByName(inline.select("revision_id", "page_index", "rect"))
    return marks.dropDuplicates(["revision_id", "page_index", "rect"])


def _bands(rect: Column) -> Column:
    return F.explode(
        F.sequence(F.floor(rect["y0"] / BAND).cast("int"), F.floor(rect["y1"] / BAND).cast("int"))
    )


def overlaps(a: Column, b: Column) -> Column:
    """Strict overlap of two rectangles; touching edges do not count."""
    return (F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])) & (
        F.least(a["y1"], b["y1"]) > F.greatest(a["y0"], b["y0"])
    )


def _covered(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """(revision_id, page_index, ord, text) of the spans under any mark.

    The join key is (revision, page, strip), so one crowded page still spreads.
    """
    marked = marks.select("revision_id", "page_index").distinct()
    spans = (
        positions(
            pages.join(marked, ["revision_id", "page_index"], "left_semi"),
            ["revision_id", "page_index"], F.col("spans"), "ord", "s",
        )
        .select("revision_id", "page_index", "ord", "s.text", F.col("s.bounds").alias("span_rect"))
        .withColumn("band", _bands(F.col("span_rect")))
    )
    strips = marks.select("revision_id", "page_index", F.col("rect").alias("mark_rect")).withColumn(
        "band", _bands(F.col("mark_rect"))
    )
    return (
        spans.join(strips, ["revision_id", "page_index", "band"])
        .where(overlaps(F.col("span_rect"), F.col("mark_rect")))
        .select("revision_id", "page_index", "ord", "text")
        .distinct()
    )


def spans_under_marks(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct non-empty (revision_id, page_index, text) lying under a mark."""
    return (
        _covered(pages, marks).where(F.col("text") != "").select("revision_id", "page_index", "text").distinct()
    )


def mask(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s).", "█")


def redact_marks(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Pages with the spans under marks masked in spans and content."""
    hidden = (
        _covered(pages, marks)
        .groupBy("revision_id", "page_index")
        .agg(F.collect_set("ord").alias("hidden"))
    )
    joined = pages.join(hidden, ["revision_id", "page_index"], "left")
    spans = F.transform(
        F.col("spans"),
        lambda s, i: F.when(
            F.array_contains(F.col("hidden"), i), s.withField("text", mask(s["text"]))
        ).otherwise(s),
    )
    spans = F.when(F.col("hidden").isNull(), F.col("spans")).otherwise(spans)
    return joined.withColumn("spans", spans).withColumn(
        "content",
        F.when(F.col("hidden").isNull(), F.col("content")).otherwise(
            F.array_join(F.transform("spans", lambda s: s["text"]), "\n")
        ),
    ).drop("hidden")


def _woven(text: Column, pattern: str) -> Column:
    """The text with every match masked character by character, so its length stays."""
    masked = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), mask), F.array(F.lit("")))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("p"), masked.alias("m"))
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["p"], x["m"])), "")


def _darker(a: Column, b: Column) -> Column:
    """Two masked forms of one text laid over each other."""
    both = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == "█", x).otherwise(y))
    return F.when(a == b, a).otherwise(F.array_join(both, ""))


def redact_pattern(pages: DataFrame, pattern: str) -> DataFrame:
    """Pages with every match masked character by character, in span texts and content.

    A match counts in the spans joined directly, as the detectors see them, and in the content, where line breaks
    stand between them; what either way finds is masked in its spans, and the content is made from the masked spans.
    Pages without spans have their content masked.
    """
    keep = [F.col(c) for c in pages.columns]
    texts = F.transform("spans", lambda s: F.coalesce(s["text"], F.lit("")))
    df = pages.select(*keep, texts.alias("_texts"))
    df = df.select(*keep, "_texts", F.array_join("_texts", "").alias("_joined"), F.array_join("_texts", "\n").alias("_lined"))
    hit = F.col("_joined").rlike(pattern) | F.col("_lined").rlike(pattern)
    df = df.withColumns({"_hit": hit, "_direct": _woven(F.col("_joined"), pattern), "_lines": _woven(F.col("_lined"), pattern)})
    df = df.withColumn("_starts", running_starts(F.transform("_texts", F.length)))
    cut = F.transform(
        "_texts",
        lambda t, i: _darker(
            F.substring(F.col("_direct"), F.get("_starts", i) + 1, F.length(t)),
            F.substring(F.col("_lines"), F.get("_starts", i) + i + 1, F.length(t)),
        ),
    )
    df = df.withColumn("_cut", F.when(F.col("_hit"), cut).otherwise(F.col("_texts")))
    spans = F.transform("spans", lambda s, i: F.when(F.col("_hit"), s.withField("text", F.get("_cut", i))).otherwise(s))
    without = F.coalesce(F.size("spans"), F.lit(0)) <= 0
    content = F.when(without & F.col("content").rlike(pattern), _woven(F.col("content"), pattern))
    content = content.when(~without & F.col("_hit"), F.array_join("_cut", "\n")).otherwise(F.col("content"))
    new = {"spans": spans.alias("spans"), "content": content.alias("content")}
    return df.select(*[new.get(c, F.col(c)) for c in pages.columns])


def _gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` code points from each place on; the last size - 1 places have none."""
    n = max(len(codes) - size + 1, 0)
    found = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            found = found * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
        found ^= found >> np.uint64(32)
        return found * np.uint64(0xD6E8FEB86659FD93)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@F.arrow_udf(T.LongType())
def _anchor(texts: pa.Array) -> pa.Array:
    """Hash of the first characters of a text, as many as the longest anchor length that fits."""
    found = []
    for text in texts.to_pylist():
        size = next((g for g in GRAMS if len(text) >= g), GRAMS[-1])
        found.append(_gram_hashes(_codes(text[:size]), size)[0])
    return pa.array(np.array(found, dtype=np.uint64).view(np.int64))


@F.arrow_udf(T.IntegerType())
def _anchor_slot(anchors: pa.Array) -> pa.Array:
    return pa.array(_slot(anchors.to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.int32))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _page_grams(rows: pa.Array) -> pa.Array:
    """Distinct hashed substrings of the anchor lengths in the two readings of a page, as far as their slots are wanted."""
    out, step = [], 256  # a table of wanted slots for so many pages at once
    for low in range(0, len(rows), step):
        part = rows.slice(low, step)
        slots = part.field("slots")
        wanted = np.zeros((len(part), 1 << SLOT_BITS), dtype=bool)
        owner = np.repeat(np.arange(len(part)), slots.value_lengths().to_numpy(zero_copy_only=False))
        wanted[owner, slots.flatten().to_numpy(zero_copy_only=False)] = True
        texts = [t or "" for side in ("content", "joined") for t in part.field(side).to_pylist()]
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        codes = _codes("".join(texts))
        page = np.repeat(np.tile(np.arange(len(part)), 2), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
        pages, grams = [], []
        for size in GRAMS:
            hashes = _gram_hashes(codes, size)
            n = len(hashes)
            at = np.flatnonzero((left[:n] >= size) & wanted[page[:n], _slot(hashes)])
            pages.append(page[at])
            grams.append(hashes[at])
        pages, grams = np.concatenate(pages), np.concatenate(grams)
        order = np.lexsort((grams, pages))
        pages, grams = pages[order], grams[order]
        fresh = np.ones(len(pages), dtype=bool)
        fresh[1:] = (pages[1:] != pages[:-1]) | (grams[1:] != grams[:-1])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(pages[fresh], minlength=len(part)))])
        out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(grams[fresh].view(np.int64))))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


def _joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), "")


def verify_absent(redacted: DataFrame, strings: DataFrame) -> DataFrame:
    """Redacted texts that can still be read somewhere in their document, in content or spans.

    Returns (revision_id, page_index, text, found_on, same_page): a survivor on
    its own page means the mark failed, one on another page is a repeat. The
    text's first characters are the join key. A page knows the slots that its
    document's keys fall in, so of its substrings only those in such a slot are
    exploded, and only pages that hold a key are joined back to their text.
    """
    ensure_checkpoint_dir(strings.sparkSession)
    # read three times below
    wanted = strings.where(F.col("text") != "").distinct().checkpoint()
    anchored = wanted.withColumn("anchor", _anchor("text"))
    # no more slots a document than there are
    slots = anchored.select("revision_id", _anchor_slot("anchor").alias("slot")).distinct()
    slots = slots.groupBy("revision_id").agg(F.collect_list("slot").alias("slots"))
    pages = redacted.select(
        "revision_id", F.col("page_index").alias("found_on"), "content", _joined_spans(F.col("spans")).alias("joined")
    ).join(slots, "revision_id")
    readable = _page_grams(F.struct("content", "joined", "slots"))
    grams = positions(pages, ["revision_id", "found_on"], readable, "_", "anchor").drop("_")
    likely = grams.join(anchored, ["revision_id", "anchor"]).drop("anchor").distinct()
    return (
        likely.join(pages.drop("slots"), ["revision_id", "found_on"])
        .where(F.contains("content", "text") | F.coalesce(F.contains("joined", "text"), F.lit(False)))
        .select(
            "revision_id", "page_index", "text", "found_on",
            (F.col("found_on") == F.col("page_index")).alias("same_page"),
        )
        .distinct()
    )


def release_gate(redacted: DataFrame, survivors: DataFrame) -> DataFrame:
    """Pages of the documents without any survivor; the others are held back."""
    return redacted.join(survivors.select("revision_id").distinct(), "revision_id", "left_anti")
