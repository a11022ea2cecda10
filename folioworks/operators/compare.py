"""Revision comparison: page pairing, word diff, token counts and raster diff."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.plans.ordered import ordered_columns
from folioworks.plans.rows import positions
from folioworks.session import spread_partitions

KEY = ["revision_id", "page_index"]

# ── words ───────────────────────────────────────────────────────────────────


def token_key(word: Column) -> Column:
    """Words compare by this: lower case, letters, marks and digits only."""
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{M}\p{N}]", ""))


def _words(spans: Column) -> Column:
    """array<struct<word, key, rect>> of all spans of a page, in order."""
    per_span = F.transform(
        spans,
        lambda s: F.transform(
            F.filter(F.split(F.coalesce(s["text"], F.lit("")), r"\s+"), lambda w: w != ""),
            lambda w: F.struct(w.alias("word"), token_key(w).alias("key"), s["bounds"].alias("rect")),
        ),
    )
    return F.flatten(per_span)


def tokenise(pages: DataFrame) -> DataFrame:
    """(revision_id, page_index, pos, word, key, rect): one row per word."""
    words = positions(pages, KEY, _words(F.col("spans")), "pos", "w")
    return words.select(*KEY, "pos", "w.word", "w.key", "w.rect")


def page_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pages both revisions have, side by side.

    The partition count is fixed: page text is small in bytes but costly to
    align, so adaptive merging of small partitions would starve the cores.
    """
    n = spread_partitions(left.sparkSession)
    left, right = left.repartition(n, *KEY), right.repartition(n, *KEY)
    a = left.select(*KEY, F.col("content").alias("content_a"), F.col("spans").alias("spans_a"))
    b = right.select(*KEY, F.col("content").alias("content_b"), F.col("spans").alias("spans_b"))
    return a.join(b, KEY)


def page_change_status(left: DataFrame, right: DataFrame) -> DataFrame:
    """unchanged, changed, only_left or only_right for every page of either side.

    Only content hashes are shuffled.
    """
    a = left.select(*KEY, F.sha2("content", 256).alias("hash_a"))
    b = right.select(*KEY, F.sha2("content", 256).alias("hash_b"))
    status = (
        F.when(F.col("hash_b").isNull(), "only_left")
        .when(F.col("hash_a").isNull(), "only_right")
        .when(F.col("hash_a") == F.col("hash_b"), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, KEY, "full").select(*KEY, status.alias("status"))


def token_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """Words whose count differs on a page: (revision_id, page_index, key, removed, added)."""

    def side(pages: DataFrame, a: int, b: int) -> DataFrame:
        keys = F.filter(F.transform(_words(F.col("spans")), lambda w: w["key"]), lambda k: k != "")
        return pages.select(*KEY, F.lit(a).alias("a"), F.lit(b).alias("b"), F.array_join(keys, " ").alias("keys"))

    # a page's keys, which hold no blanks, are shuffled as one string; dealt by page, the words need no shuffle to be counted
    paged = side(left, 1, 0).unionByName(side(right, 0, 1)).repartition(spread_partitions(left.sparkSession), *KEY)
    sides = positions(paged, [*KEY, "a", "b"], F.split("keys", " "), "pos", "key").where(F.col("key") != "")
    counts = sides.groupBy(*KEY, "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counts.where("a <> b").select(
        *KEY, "key", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("removed"),
        F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added"),
    )


MAX_ROW_BYTES = 256 * 1024 * 1024


def _advance(row: int, same: int, ones: int) -> int:
    """The next row of the table of common subsequence lengths, as a bit set.

    Bit j is clear where the length grows from column j to j + 1 (Hyyrö's
    bit-parallel recurrence).
    """
    hit = row & same
    return ((row + hit) | (row & ~same)) & ones


def lcs_steps(a: list[str], b: list[str]) -> list[tuple[str, int]]:
    """Alignment in document order: ("same"|"deleted", index in a) or ("inserted", index in b).

    Among equally long alignments a pair that matches is taken first, then an
    insertion, read from the end. Empty keys match nothing. All rows are kept
    while they are small; beyond that only every k-th, and the rows between are
    made again on the way back, so no page is too long.
    """
    same_tail = 0
    while same_tail < min(len(a), len(b)) and a[-1 - same_tail] == b[-1 - same_tail] != "":
        same_tail += 1
    n, m = len(a) - same_tail, len(b) - same_tail
    ones = (1 << m) - 1
    where: dict[str, int] = {}
    for j in range(m):
        if b[j]:
            where[b[j]] = where.get(b[j], 0) | (1 << j)
    block = 1 if n * m // 8 <= MAX_ROW_BYTES else math.isqrt(n)
    kept, row = [ones], ones
    for i in range(n):
        row = _advance(row, where.get(a[i], 0), ones)
        if (i + 1) % block == 0:
            kept.append(row)
    steps: list[tuple[str, int]] = []
    i, j = n, m
    first, rows = n + 1, []
    while i > 0 or j > 0:
        if i > 0 and j > 0 and a[i - 1] == b[j - 1] != "":
            i, j = i - 1, j - 1
            steps.append(("same", i))
            continue
        take_b = i == 0
        if i > 0 and j > 0:
            if i < first:
                first = i // block * block
                rows = [kept[first // block]]
                for k in range(first, i):
                    rows.append(_advance(rows[-1], where.get(a[k], 0), ones))
            # no growth in this column: going left loses nothing
            take_b = rows[i - first] >> (j - 1) & 1 == 1
        if take_b:
            j -= 1
            steps.append(("inserted", j))
        else:
            i -= 1
            steps.append(("deleted", i))
    steps.reverse()
    return steps + [("same", n + k) for k in range(same_tail)]


RUNS = T.ArrayType(
    T.StructType(
        [
            T.StructField("class", T.StringType()),
            T.StructField("first", T.IntegerType()),
            T.StructField("size", T.IntegerType()),
        ]
    )
)


def lcs_runs(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """Runs (class, first word, words); the words of a run lie side by side in a or b."""
    runs: list[list] = []
    open_class = "same"
    for kind, at in lcs_steps(a, b):
        if kind != "same":
            if kind == open_class:
                runs[-1][2] += 1
            else:
                runs.append([kind, at, 1])
        open_class = kind
    return [tuple(run) for run in runs]


ARROW_RUNS = pa.list_(pa.struct([("class", pa.string()), ("first", pa.int32()), ("size", pa.int32())]))
#: Page pairs whose words are Python values at one time.
SLICE = 64


def _align(keys_a: pa.Array, keys_b: pa.Array) -> pa.Array:
    """The runs of every pair of key lists."""
    parts = []
    for at in range(0, max(len(keys_a), 1), SLICE):
        pairs = zip(keys_a.slice(at, SLICE).to_pylist(), keys_b.slice(at, SLICE).to_pylist())
        runs = [[dict(zip(("class", "first", "size"), run)) for run in lcs_runs(x, y)] for x, y in pairs]
        parts.append(pa.array(runs, type=ARROW_RUNS))
    return pa.concat_arrays(parts)


def text_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Word changes of every page pair: (revision_id, page_index, change, class, text, rects).

    Equal pages drop out by content before any word is compared. Python sees the
    words' keys only and answers with positions; text and boxes stay in Spark.
    """
    changed = page_pairs(left, right).where(F.col("content_a") != F.col("content_b"))
    pairs = changed.select(*KEY, _words(F.col("spans_a")).alias("a"), _words(F.col("spans_b")).alias("b"))
    keys = lambda side: F.transform(side, lambda w: w["key"])
    # non-deterministic, so that the optimizer does not repeat it
    align = F.arrow_udf(_align, RUNS).asNondeterministic()
    runs = pairs.withColumn("runs", align(keys("a"), keys("b")))
    exploded = positions(runs, [*KEY, "a", "b"], F.col("runs"), "change", "r")
    side = F.when(F.col("r.class") == "deleted", F.col("a")).otherwise(F.col("b"))
    words = exploded.select(
        *KEY, "change", F.col("r.class").alias("class"), F.slice(side, F.col("r.first") + 1, F.col("r.size")).alias("w")
    )
    return words.select(
        *KEY,
        "change",
        "class",
        F.array_join(F.transform("w", lambda w: w["word"]), " ").alias("text"),
        F.array_distinct(F.transform("w", lambda w: w["rect"])).alias("rects"),
    )


# ── rasters ─────────────────────────────────────────────────────────────────

ROW = ["document_id", "page_index"]


def _size(lines: DataFrame, suffix: str) -> DataFrame:
    return lines.groupBy(*ROW).agg(
        F.max((F.size("px") / F.col("channels")).cast("int")).alias("width" + suffix),
        (F.max("y") + 1).alias("height" + suffix),
    )


def raster_rows(left: DataFrame, right: DataFrame, tolerance: int = 10) -> DataFrame:
    """Changed columns of every scan line: (document_id, page_index, y, width, xs).

    A pixel changes if any channel differs by more than the tolerance. Pages of
    unequal size change everywhere; pages on one side only are left out.
    """
    sizes = _size(left, "_a").join(_size(right, "_b"), ROW)
    sizes = sizes.withColumn("same_size", F.expr("width_a = width_b AND height_a = height_b"))
    a = left.select(*ROW, "y", "channels", F.col("px").alias("px_a"))
    b = right.select(*ROW, "y", F.col("px").alias("px_b"))
    rows = a.join(b, [*ROW, "y"], "left").join(sizes, ROW)
    differs = F.zip_with("px_a", "px_b", lambda p, q: F.abs(p - q) > tolerance)
    changed = F.array_distinct(
        F.filter(
            F.transform(differs, lambda d, i: F.when(d, F.floor(i / F.col("channels")).cast("int"))),
            lambda x: x.isNotNull(),
        )
    )
    everywhere = F.sequence(F.lit(0), F.col("width_a") - 1)
    return rows.select(
        *ROW, "y", F.col("width_a").alias("width"), F.when(F.col("same_size"), changed).otherwise(everywhere).alias("xs")
    )


def pixel_counts(rows: DataFrame) -> DataFrame:
    """(document_id, page_index, diff_pixels, total_pixels)"""
    return rows.groupBy(*ROW).agg(
        F.sum(F.size("xs")).cast("bigint").alias("diff_pixels"), F.sum("width").cast("bigint").alias("total_pixels")
    )


def raster_diff(left: DataFrame, right: DataFrame, tolerance: int = 10) -> DataFrame:
    """Pixel counts of every page of either side; 0 of 0 for a page without partner."""
    pages = left.select(*ROW).union(right.select(*ROW)).distinct()
    counted = pages.join(pixel_counts(raster_rows(left, right, tolerance)), ROW, "left")
    zero = F.lit(0).cast("bigint")
    return counted.select(
        *ROW,
        F.coalesce("diff_pixels", zero).alias("diff_pixels"),
        F.coalesce("total_pixels", zero).alias("total_pixels"),
    )


def diff_ratio(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Share of changed pixels per key, 0.0 where there are no pixels."""
    sums = counts.groupBy(*keys).agg(
        F.sum("diff_pixels").alias("diff_pixels"), F.sum("total_pixels").alias("total_pixels")
    )
    ratio = F.coalesce(F.try_divide(F.col("diff_pixels").cast("double"), F.col("total_pixels")), F.lit(0.0))
    return sums.withColumn("ratio", ratio)


def changed_bands(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Boxes around runs of consecutive changed scan lines: (…, x, y, width, height)."""
    hit = rows.where(F.size("xs") > 0).select(
        *ROW, "y", F.array_min("xs").alias("x0"), F.array_max("xs").alias("x1")
    )
    numbered = ordered_columns(hit, ROW, ["y"], row_number="_rn", limit=limit)
    bands = numbered.withColumn("_band", F.col("y") - F.col("_rn")).groupBy(*ROW, "_band")
    return bands.agg(
        F.min("x0").alias("x"),
        F.min("y").alias("y"),
        (F.max("x1") - F.min("x0") + 1).alias("width"),
        (F.max("y") - F.min("y") + 1).alias("height"),
    ).drop("_band")
