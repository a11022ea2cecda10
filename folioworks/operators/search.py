"""Exact text and pattern search over page text, with offsets, snippets and boxes.

Everything about a page is computed inside its row, without a shuffle. Texts stay in the JVM; the places of hits among
spans come from lengths alone, as sums and binary searches over a batch of pages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.text import (
    WORD_EDGE,
    around,
    collapsed,
    cut_at,
    flat_lists,
    literal_pattern,
    normalised,
    quoted,
    sums_by_row,
    trimmed,
)
from folioworks.plans.rows import positions

# The five detectors, label and pattern.
PRESETS = {
    "ssn": ("Social Security Number", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"),
    "card": ("Credit / debit card", r"(?<!\d)(?:\d{4}[-\s]?){3}\d{4}(?!\d)"),
    "email": ("Email address", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    "phone": ("Phone number", r"(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}(?!\d)"),
    "iban": ("IBAN", r"\b[A-Z]{2}\d{2}(?:[ \-]?[A-Z0-9]){11,30}\b"),
}


# a cheap pattern every hit of a detector contains
HINTS = {"ssn": "[0-9]-[0-9]", "card": "[0-9]{4}", "email": "@", "phone": "[0-9]{4}", "iban": "[A-Z]{2}[0-9]{2}"}


def preset_pattern(name: str) -> str:
    if name not in PRESETS:
        raise ValueError(f"unknown preset: {name}")
    return PRESETS[name][1].replace(r"\b", WORD_EDGE)


def checked_pattern(df: DataFrame, pattern: str) -> str:
    """The pattern, once Spark accepts it and it can not match the empty text."""
    try:
        empty = df.sparkSession.sql("SELECT '' RLIKE :p AS hit", args={"p": pattern}).first()["hit"]
    except Exception as error:
        raise ValueError(f"invalid regular expression: {pattern}") from error
    if empty:
        raise ValueError(f"the pattern matches the empty text: {pattern}")
    return pattern


def _texts(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.coalesce(s["text"], F.lit("")))


def _lengths(texts: Column) -> Column:
    return F.transform(texts, F.length)


PLACE = "array<struct<start:int,first:int,past:int,at:int>>"


def hit_places(spans: pa.ListArray, pieces: pa.ListArray, found: pa.ListArray, gap: int) -> pa.ListArray:
    """Where the hits of each row are, out of the lengths of its spans, of its hits and of the pieces between hits.

    Spans follow each other `gap` characters apart. start is the hit's offset; spans first to past - 1 lie under the
    hit; at is the span that holds its first character, or -1. Sums and one binary search per hit, whatever their number.
    """
    far = np.int64(1) << 32  # keeps the rows apart in one ascending array
    width, span_row = flat_lists(spans)
    ends = sums_by_row(width + gap, span_row) - gap
    starts = ends - width
    hit, hit_row = flat_lists(found)
    # one piece more than hits in a row: the last one stands behind the last hit
    piece, piece_row = flat_lists(pieces)
    counts = np.bincount(hit_row, minlength=len(found))
    nth = sums_by_row(np.ones(len(piece), dtype=np.int64), piece_row) - 1
    before = sums_by_row(piece, piece_row)[nth < counts[piece_row]]
    start = before + sums_by_row(hit, hit_row) - hit
    first = np.searchsorted(ends + span_row * far, start + hit_row * far, side="right")
    past = np.searchsorted(starts + span_row * far, start + hit + hit_row * far, side="left")
    own = np.searchsorted(span_row, hit_row)  # first span of the row
    inside = (first < past) & (first < len(starts))
    inside[inside] = starts[first[inside]] <= start[inside]
    fields = {"start": start, "first": first - own, "past": past - own, "at": np.where(inside, first - own, -1)}
    struct = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), struct)


def _places(spans: Column, pieces: Column, found: Column, gap: int) -> Column:
    @F.arrow_udf(PLACE)
    def run(spans: pa.Array, pieces: pa.Array, found: pa.Array) -> pa.Array:
        return hit_places(spans, pieces, found, gap)

    return run(_lengths(_texts(spans)), _lengths(pieces), _lengths(found))


def _box(boxes: Column) -> Column:
    """Union of boxes; zeros where there is none."""
    zero = F.lit(0.0)
    return F.struct(
        F.coalesce(F.array_min(F.transform(boxes, lambda b: b["x0"])), zero).alias("x0"),
        F.coalesce(F.array_min(F.transform(boxes, lambda b: b["y0"])), zero).alias("y0"),
        F.coalesce(F.array_max(F.transform(boxes, lambda b: b["x1"])), zero).alias("x1"),
        F.coalesce(F.array_max(F.transform(boxes, lambda b: b["y1"])), zero).alias("y1"),
    )


def _hits(spans: Column, places: Column, found: Column, box: str) -> Column:
    """array<struct<start, text, box>>: boxes are looked up inside the page, so no hit carries the page's spans."""

    def bounds(place: Column) -> Column:
        if box == "first":
            return F.get(spans, F.when(place["at"] >= 0, place["at"]))["bounds"]
        under = F.slice(spans, place["first"] + 1, F.greatest(place["past"] - place["first"], F.lit(0)))
        return _box(F.transform(under, lambda s: s["bounds"]))

    return F.transform(
        F.arrays_zip(places.alias("p"), found.alias("m")),
        lambda x: F.struct(x["p"]["start"].alias("start"), x["m"].alias("text"), bounds(x["p"]).alias("box")),
    )


def search(
    pages: DataFrame,
    query: str,
    match_case: bool = False,
    whole_word: bool = False,
    page: int | None = None,
) -> DataFrame:
    """Hits (revision_id, page, hit, offset, snippet, bounds); page is one-based."""
    if query.strip() == "":
        pages = pages.where(F.lit(False))
        query = " "
    if page is not None:
        pages = pages.where(F.col("page_index") == page - 1)
    pattern = literal_pattern(query, match_case, whole_word)
    content = F.col("content")
    cut = pages.where(content.rlike(pattern)).select("revision_id", "page_index", "content", "spans", *cut_at(content, pattern))
    cut = cut.withColumn("_places", _places(F.col("spans"), F.col("_p"), F.col("_m"), 1))
    found = _hits(F.col("spans"), F.col("_places"), F.col("_m"), "first")
    hits = positions(cut, ["revision_id", "page_index", "content"], found, "hit", "m")
    offset, length = F.col("m.start"), F.length("m.text")
    return hits.select(
        "revision_id",
        (F.col("page_index") + 1).alias("page"),
        "hit",
        offset.alias("offset"),
        trimmed(F.replace(around(content, offset, length, 30, 30), F.lit("\n"), F.lit(" "))).alias("snippet"),
        F.col("m.box").alias("bounds"),
    )


def page_tokens(content: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(content), r"[^\p{L}\p{N}_]+"), lambda t: t != ""))


def token_table(pages: DataFrame) -> DataFrame:
    """Inverted index rows (token, revision_id, page_index), for repeated lookups."""
    tokens = positions(pages, ["revision_id", "page_index"], page_tokens(F.col("content")), "_", "token")
    return tokens.select("token", "revision_id", "page_index")


def search_prefilter(pages: DataFrame, query: str) -> DataFrame:
    """Candidate pages: the text contains the query, or holds all of its words."""
    words = page_tokens(F.lit(query))
    has_words = (F.size(words) > 0) & (F.size(F.array_except(words, page_tokens(F.col("content")))) == 0)
    return pages.where(F.col("content").rlike(literal_pattern(query)) | has_words)


def pattern_search(pages: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Case-sensitive hits in the spans joined without separator, so hits cross spans."""
    pattern = checked_pattern(pages, query if regex else quoted(query))
    return _pattern_hits(pages, {"": pattern}).drop("preset")


def preset_scan(pages: DataFrame, presets: list[str] | None = None) -> DataFrame:
    """Hits of several detectors in one pass over the pages."""
    return _pattern_hits(pages, {name: preset_pattern(name) for name in presets or PRESETS})


def _pattern_hits(pages: DataFrame, patterns: dict[str, str]) -> DataFrame:
    texts = pages.select(
        "revision_id", "page_index", "spans", F.array_join(_texts(F.col("spans")), "").alias("joined")
    )
    joined = F.col("joined")
    found = []
    for name, pattern in patterns.items():
        all_of = F.regexp_extract_all(joined, F.lit(pattern), F.lit(0))
        # without its hint a text is not searched
        all_of = F.when(joined.rlike(HINTS[name]), all_of) if name in HINTS else all_of
        found.append(F.struct(F.lit(name).alias("preset"), all_of.alias("_m")))
    hit = positions(texts, ["revision_id", "page_index", "spans", "joined"], F.array(*found), "_", "f").where(F.size("f._m") > 0)
    pieces = F.lit(None).cast("array<string>")
    for name, pattern in patterns.items():
        pieces = F.when(F.col("f.preset") == name, F.split(joined, pattern, -1)).otherwise(pieces)
    cut = hit.select("revision_id", "page_index", "joined", "spans", "f.preset", "f._m", pieces.alias("_p"))
    cut = cut.withColumn("_places", _places(F.col("spans"), F.col("_p"), F.col("_m"), 0))
    all_of = _hits(F.col("spans"), F.col("_places"), F.col("_m"), "all")
    hits = positions(cut, ["revision_id", "page_index", "joined", "preset"], all_of, "i", "m")
    start, length = F.col("m.start"), F.length("m.text")
    return hits.select(
        "revision_id",
        "page_index",
        "preset",
        F.concat(F.lit("srh-"), F.col("page_index"), F.lit("-"), F.col("i")).alias("hit_id"),
        start.alias("offset"),
        F.col("m.text").alias("text"),
        collapsed(around(joined, start, length, 25, 40)).alias("snippet"),
        F.col("m.box").alias("rect"),
    )


def luhn_valid(digits: Column) -> Column:
    """Luhn check of the digits in a text."""
    only = F.reverse(F.regexp_replace(digits, r"[^0-9]", ""))
    numbers = F.transform(F.split(only, ""), lambda d: d.cast("int"))
    doubled = F.transform(
        numbers, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def bbox_union(boxes: DataFrame, keys: list[str], rect: str = "rect") -> DataFrame:
    """One box per key around all boxes; zeros where every box is null."""
    return boxes.groupBy(*keys).agg(
        *[
            F.coalesce(how(f"{rect}.{side}"), F.lit(0.0)).alias(side)
            for side, how in [("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max)]
        ]
    )


def viewer_pages(pages: DataFrame, query: str, match_case: bool = False) -> DataFrame:
    """Pages the viewer's own matcher would find: a plain scan of normalised text."""
    q = normalised(F.lit(query), match_case)
    return pages.where(F.contains(normalised(F.col("content"), match_case), q)).select(
        "revision_id", (F.col("page_index") + 1).alias("page")
    )


def hit_set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found by only one of two searches; empty when both agree."""
    left, right = left.distinct(), right.distinct()
    only_left = left.exceptAll(right).withColumn("found_by", F.lit("left"))
    return only_left.unionByName(right.exceptAll(left).withColumn("found_by", F.lit("right")))
