"""Page planning: selectors, range specs, split, merge, page maps and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.plans.folds import Threshold, fold_rows
from folioworks.plans.ordered import ordered_columns
from folioworks.session import ensure_checkpoint_dir

NO_PAGES = "cast(array() as array<int>)"


# ── selectors and range specs ───────────────────────────────────────────────


def page_selected(page_index: Column, mode: Column, first: Column, last: Column, pages: Column) -> Column:
    """Is a zero-based page inside a one-based selector? Unknown modes take every page."""
    n = page_index + 1
    return (
        F.when(mode == "range", (n >= F.coalesce(first, F.lit(1))) & (last.isNull() | (n <= last)))
        .when(mode == "odd", n % 2 == 1)
        .when(mode == "even", n % 2 == 0)
        .when(mode == "custom", F.coalesce(F.array_contains(pages, n), F.lit(False)))
        .otherwise(True)
    )


# What a broken page range is answered with.
SPEC_ERRORS = {
    "number": 'invalid page number "%s"',
    "small": "page number %s must be ≥ 1",
    "range": 'invalid range "%s"',
    "reversed": "range %s is reversed (must be from ≤ to)",
    "beyond": "page %d is out of range (document has %d pages)",
    "none": "no ranges given",
}


def _number(text: Column) -> Column:
    """(value, error) of one page number in a spec."""
    value = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.struct(
        value.alias("value"),
        F.when(value.isNull(), F.format_string(SPEC_ERRORS["number"], text))
        .when(value < 1, F.format_string(SPEC_ERRORS["small"], text))
        .alias("error"),
    )


def _span_of(part: Column, page_count: Column) -> Column:
    """(first, last, error) of one comma-separated part of a spec."""
    sides = F.split(part, "-")
    a, b = _number(F.get(sides, F.lit(0))), _number(F.get(sides, F.lit(1)))
    single = F.size(sides) == 1
    top = F.when(single, a["value"]).otherwise(b["value"])
    beyond = F.format_string(SPEC_ERRORS["beyond"], top, page_count)
    error = (
        F.when(F.size(sides) > 2, F.format_string(SPEC_ERRORS["range"], part))
        .when(a["error"].isNotNull(), a["error"])
        .when(~single & b["error"].isNotNull(), b["error"])
        .when(~single & (a["value"] > b["value"]), F.format_string(SPEC_ERRORS["reversed"], part))
        .when(top > page_count, beyond)
    )
    return F.struct(
        F.when(error.isNull(), a["value"] - 1).cast("int").alias("first"),
        F.when(error.isNull(), top - 1).cast("int").alias("last"),
        error.alias("error"),
    )


def _spans(spec: Column, page_count: Column) -> Column:
    return F.transform(F.split(F.trim(spec), ","), lambda part: _span_of(F.trim(part), page_count))


def _first_error(spans: Column) -> Column:
    return F.get(F.filter(F.transform(spans, lambda s: s["error"]), lambda e: e.isNotNull()), F.lit(0))


def parse_ranges(specs: DataFrame, spec: str = "spec", page_count: str = "page_count") -> DataFrame:
    """Add `pages` (sorted distinct zero-based indices, null on error) and `error`.

    A blank spec takes every page.
    """
    blank = F.trim(spec) == ""
    parsed = specs.withColumn("_spans", _spans(F.col(spec), F.col(page_count))).withColumn(
        "error", F.when(~blank, _first_error(F.col("_spans")))
    )
    listed = F.transform("_spans", lambda s: F.sequence(s["first"], s["last"]))
    every = F.sequence(F.lit(0), (F.col(page_count) - 1).cast("int"))
    pages = F.when(blank, every).when(
        F.col("error").isNull(), F.array_sort(F.array_distinct(F.flatten(listed)))
    )
    return parsed.withColumn("pages", pages).drop("_spans")


def parse_range_groups(specs: DataFrame, spec: str = "spec", page_count: str = "page_count") -> DataFrame:
    """Add `groups` (one page array per part, in the order given) and `error`."""
    blank = F.trim(spec) == ""
    parsed = specs.withColumn("_spans", _spans(F.col(spec), F.col(page_count))).withColumn(
        "error", F.when(blank, SPEC_ERRORS["none"]).otherwise(_first_error(F.col("_spans")))
    )
    groups = F.transform("_spans", lambda s: F.sequence(s["first"], s["last"]))
    return parsed.withColumn("groups", F.when(F.col("error").isNull(), groups)).drop("_spans")


# ── split ───────────────────────────────────────────────────────────────────


def part_name(prefix: Column, part: Column) -> Column:
    """prefix-001.pdf; numbers past 999 are not cut"""
    digits = part.cast("string")
    padded = F.lpad(digits, 3, "0")
    return F.concat(prefix, F.lit("-"), F.when(F.length(digits) >= 3, digits).otherwise(padded), F.lit(".pdf"))


def split_every_n(pages: DataFrame, n: int) -> DataFrame:
    """Add the one-based `part` of every page in chunks of n."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return pages.withColumn("part", (F.floor(F.col("page_index") / n) + 1).cast("bigint"))


def split_at_bookmarks(
    documents: DataFrame, outline: DataFrame, level: int, limit: int | None = None
) -> DataFrame:
    """Parts (revision_id, part, first_page, last_page, error) cut at outline pages.

    `documents` holds (revision_id, page_count); level 1 is the top of the tree.
    A document without entries on the level gives one row with an error.
    """
    points = (
        outline.where((F.col("depth") == level - 1) & F.col("page").isNotNull())
        .select("revision_id", F.col("page").alias("first_page"))
        .distinct()
    )
    counted = documents.select("revision_id", "page_count")
    inside = points.join(counted, "revision_id").where("first_page < page_count")
    heads = points.select("revision_id").distinct().join(counted, "revision_id").select(
        "revision_id", F.lit(0).alias("first_page"), "page_count"
    )
    starts = inside.unionByName(heads).distinct()
    parts = ordered_columns(
        starts, ["revision_id"], ["first_page"], row_number="part", leads={"_next": "first_page"}, limit=limit
    )
    found = parts.select(
        "revision_id",
        "part",
        "first_page",
        F.coalesce(F.col("_next") - 1, F.col("page_count") - 1).cast("int").alias("last_page"),
        F.lit(None).cast("string").alias("error"),
    )
    none = counted.join(points, "revision_id", "left_anti").selectExpr(
        "revision_id", "CAST(NULL AS INT) AS part", "CAST(NULL AS INT) AS first_page",
        "CAST(NULL AS INT) AS last_page", f"'no bookmarks on level {level}' AS error",
    )
    return found.unionByName(none)


def split_by_size(pages: DataFrame, target: int, limit: int | None = None) -> DataFrame:
    """Greedy parts: a page that would lift its part over the target opens the next.

    Adds the one-based `part`; a page larger than the target stands alone.
    """
    if target <= 0:
        raise ValueError("target must be positive")
    key, order = ["revision_id"], ["page_index"]
    sized = ordered_columns(pages, key, order, sums={"_end": "byte_size"}, limit=limit)
    sized = sized.withColumn("_begin", F.col("_end") - F.col("byte_size"))
    fold = Threshold("_begin", "_end", target, inclusive=False)
    return (
        fold_rows(sized, key, order, fold, limit)
        .withColumnRenamed("run", "part")
        .drop("_begin", "_end", "opens")
    )


def part_summary(pages: DataFrame) -> DataFrame:
    """(revision_id, part, first_page, last_page, bytes) from pages with a part."""
    return pages.groupBy("revision_id", "part").agg(
        F.min("page_index").alias("first_page"),
        F.max("page_index").alias("last_page"),
        F.sum("byte_size").alias("bytes"),
    )


def split_ranges(documents: DataFrame) -> DataFrame:
    """One row per output page of (revision_id, title, spec, page_count) requests.

    Returns (revision_id, part, position, page_index, name, error).
    """
    grouped = parse_range_groups(documents)
    parts = grouped.select(
        "revision_id", "title", "error", F.posexplode_outer("groups").alias("part0", "pages")
    )
    return parts.select(
        "revision_id",
        (F.col("part0") + 1).alias("part"),
        F.when(F.col("error").isNull(), part_name(F.col("title"), F.col("part0") + 1)).alias("name"),
        "error",
        F.posexplode_outer("pages").alias("position", "page_index"),
    )


def extract_pages(requests: DataFrame) -> DataFrame:
    """One part per requested page; a page outside the document fails the request.

    `requests` holds (revision_id, title, page_count, pages array).
    """
    outside = F.exists("pages", lambda p: (p < 0) | (p >= F.col("page_count")))
    checked = requests.withColumn("error", F.when(outside, F.lit("page out of bounds")))
    wanted = F.when(F.col("error").isNull(), F.col("pages"))
    parts = checked.select("revision_id", "title", "error", F.posexplode_outer(wanted).alias("i", "page_index"))
    return parts.select(
        "revision_id",
        (F.col("i") + 1).alias("part"),
        "page_index",
        F.when(F.col("error").isNull(), part_name(F.col("title"), F.col("i") + 1)).alias("name"),
        "error",
    )


# ── merge ───────────────────────────────────────────────────────────────────


def page_offsets(sources: DataFrame, max_sources: int | None = None) -> DataFrame:
    """Add `page_offset` (pages before each source) and `error`.

    `sources` holds (merge_id, ord, page_count), ord unique in a merge. With max_sources, merges of more sources get
    an error in place of their offsets; without it any number is placed.
    """
    placed = ordered_columns(sources, ["merge_id"], ["ord"], sums={"_upto": "page_count"})
    offset = (F.col("_upto") - F.col("page_count")).cast("bigint")
    if max_sources is None:
        return placed.select(*sources.columns, offset.alias("page_offset"), F.lit(None).cast("string").alias("error"))
    counts = sources.groupBy("merge_id").agg(F.count(F.lit(1)).alias("_sources")).where(F.col("_sources") > max_sources)
    over = counts.select(F.col("merge_id").alias("_merge"), "_sources")
    placed = placed.join(over, placed["merge_id"].eqNullSafe(over["_merge"]), "left")
    return placed.select(
        *sources.columns,
        F.when(F.col("_sources").isNull(), offset).alias("page_offset"),
        F.when(
            F.col("_sources").isNotNull(), F.format_string("too many sources: %d (at most %d)", "_sources", F.lit(max_sources))
        ).alias("error"),
    )


def page_labels(placed: DataFrame, continue_numbering: bool) -> DataFrame:
    """(merge_id, source ord, page, label) of every merged page; labels start at 1."""
    pages = placed.where(F.col("error").isNull() & (F.col("page_count") > 0)).select(
        "merge_id", "ord", "page_offset", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("_p")
    )
    page = (F.col("page_offset") + F.col("_p")).cast("bigint")
    label = page + 1 if continue_numbering else (F.col("_p") + 1).cast("bigint")
    return pages.select("merge_id", "ord", page.alias("page"), label.alias("label"))


# ── page maps ───────────────────────────────────────────────────────────────

IDENTITY_OPERATIONS = ["rotate", "crop", "remove_crop", "page_size_margin"]


def preserved_map(
    operation: Column, page_order: Column, page_count: Column, position: Column, replacements: Column
) -> Column:
    """array<struct<new_idx, old_idx>>: where each new page comes from, null if it is new.

    `page_order` lists old pages; `position` is where insert_blank and replace
    act; `replacements` is the number of pages replace brings in.
    """

    def run(first: Column, end: Column) -> Column:
        # an empty sequence where there is nothing between
        return F.when(end > first, F.sequence(first.cast("int"), (end - 1).cast("int"))).otherwise(F.expr(NO_PAGES))

    # every operation is some old pages, a gap of new ones, and the rest of a list of old pages, numbered by place
    gap = F.when(operation == "insert_blank", F.lit(1)).when(operation == "replace", replacements).otherwise(F.lit(0)).cast("int")
    cut = F.when(operation.isin("insert_blank", "replace"), position).otherwise(F.lit(0)).cast("int")
    source = F.when(operation.isin("insert_blank", "background"), run(F.lit(0), page_count)).otherwise(page_order)
    rest = F.slice(source, cut + 1, F.greatest(F.size(source) - cut, F.lit(0)))
    olds = F.concat(run(F.lit(0), cut), F.array_repeat(F.lit(None).cast("int"), gap), rest)

    def numbered(old: Column, place: Column) -> Column:
        new = F.when(operation.isin(IDENTITY_OPERATIONS), old).otherwise(place)
        return F.struct(new.cast("int").alias("new_idx"), old.cast("int").alias("old_idx"))

    return F.transform(olds, numbered)


def carry_forward(page_map: DataFrame, pages: DataFrame, page_text: DataFrame) -> DataFrame:
    """Page rows and text of new revisions, reused from the old ones.

    `page_map` holds (new_revision_id, old_revision_id, new_idx, old_idx); a null
    old_idx gives an empty placeholder page, a page without text an empty text.
    """
    old_pages = pages.selectExpr(
        "revision_id AS old_revision_id", "page_index AS old_idx", "width", "height", "has_text"
    )
    old_text = page_text.selectExpr(
        "revision_id AS old_revision_id", "page_index AS old_idx", "content", "spans"
    )
    on = ["old_revision_id", "old_idx"]
    return (
        page_map.join(old_pages, on, "left")
        .join(old_text, on, "left")
        .select(
            F.col("new_revision_id").alias("revision_id"),
            F.col("new_idx").alias("page_index"),
            "width",
            "height",
            F.coalesce("has_text", F.lit(False)).alias("has_text"),
            F.coalesce("content", F.lit("")).alias("content"),
            "spans",
        )
    )


def remap_annotations(annotations: DataFrame, page_map: DataFrame) -> DataFrame:
    """Copies of annotations on the new revision's pages, all columns kept.

    A page used twice keeps its annotations on both; deleted pages drop theirs.
    """
    moves = page_map.where(F.col("old_idx").isNotNull()).selectExpr(
        "old_revision_id AS revision_id", "old_idx AS page_index", "new_revision_id", "new_idx"
    )
    kept = [c for c in annotations.columns if c not in ("revision_id", "page_index")]
    return annotations.join(moves, ["revision_id", "page_index"]).select(
        F.col("new_revision_id").alias("revision_id"), F.col("new_idx").alias("page_index"), *kept
    )


# ── outlines ────────────────────────────────────────────────────────────────


def filter_outline(outline: DataFrame, kept: DataFrame, offset: int = 0) -> DataFrame:
    """Outline rows that survive keeping some pages, with remapped page numbers.

    `kept` holds (revision_id, old_idx, new_idx). An entry on a page stays if the page does; an entry without a page
    stays if a child does; entries under a dropped entry go with it. So those on kept pages stay that have no dropped
    entry above them, and with them all that is above. Both follow pointers to the ancestors 1, 2, 4, ... levels up: an
    outline n levels deep takes log n joins. What hangs from a missing parent or from a circle of parents goes.
    """
    pages = kept.selectExpr("revision_id", "old_idx AS page", "new_idx")
    mapped = outline.join(pages, ["revision_id", "page"], "left")
    left = mapped.where("new_idx IS NOT NULL OR page IS NULL").where("depth = 0 OR parent_id IS NOT NULL")
    ensure_checkpoint_dir(outline.sparkSession)
    up = F.when(F.col("depth") > 0, F.col("parent_id")).alias("up")
    clear = left.select("revision_id", "node_id", up).distinct().checkpoint()
    entries, steps = clear.count(), []
    # in round k: entries with the 2^k next above them there, and the one that is 2^k above, null beyond the root
    while not clear.where("up IS NOT NULL").isEmpty():
        if 2 ** len(steps) > entries:
            clear = clear.where("up IS NULL")
            break
        steps.append(clear)
        there = clear.select("revision_id", F.col("node_id").alias("up"), F.col("up").alias("further"), F.lit(True).alias("there"))
        clear = clear.join(there, ["revision_id", "up"], "left").where("up IS NULL OR there")
        clear = clear.select("revision_id", "node_id", F.col("further").alias("up")).checkpoint()
    node = ["revision_id", "node_id"]
    stay = mapped.where("new_idx IS NOT NULL").select(*node).distinct().join(clear, node, "left_semi")
    for step in steps:
        with_above = stay.join(step, node).select("revision_id", F.explode(F.array("node_id", "up")).alias("node_id"))
        stay = with_above.where("node_id IS NOT NULL").distinct()
    return left.join(stay, node, "left_semi").select(
        *[c for c in outline.columns if c != "page"],
        (F.col("new_idx") + offset).cast("int").alias("page"),
    )
