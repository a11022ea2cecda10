"""Layout reconstruction: lines, positioned text, character runs and nearest runs.

Lines and layout text work inside a page row; runs are cut from sorted characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.plans.folds import HeadRuns, fold_rows, key_cuts
from folioworks.plans.ordered import group_limit, split_hot
from folioworks.plans.rows import positions
from folioworks.session import spread_partitions

SPACE_WIDTH = 4.0

# Fonts every viewer has.
STANDARD_FONTS = [
    "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique",
    "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic",
    "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique", "Symbol", "ZapfDingbats",
]
SUBSET_PREFIX = r"^[A-Z0-9]{6,}\+"


SPAN = "struct<depth:double,left:double,ord:int,span:struct<text:string,bounds:struct<x0:double,y0:double,x1:double,y1:double>>>"


def _with_lines(pages: DataFrame) -> DataFrame:
    """Pages with `_lines`: spans top to bottom, left to right, as an array of lines.

    A span opens a line when it overlaps the span before it by less than half
    the average height (at least 4 points). The sorted spans and the line starts
    are columns of their own, used several times but computed once.
    """
    boxed = F.filter("spans", lambda s: s["bounds"].isNotNull())
    ordered = F.sort_array(
        F.transform(
            boxed,
            lambda s, i: F.struct(
                (-(s["bounds"]["y1"] + s["bounds"]["y0"])).alias("depth"),
                s["bounds"]["x0"].alias("left"),
                i.alias("ord"),
                F.struct(s["text"].alias("text"), s["bounds"].alias("bounds")).alias("span"),
            ),
        )
    )
    spans, n = F.col("_ordered"), F.size("_ordered")
    heights = F.aggregate(
        spans, F.lit(0.0), lambda acc, s: acc + F.abs(s["span"]["bounds"]["y1"] - s["span"]["bounds"]["y0"])
    )
    need = F.greatest(heights / n * 0.5, F.lit(4.0))

    def opens(z: Column) -> Column:
        box, before = z["s"]["span"]["bounds"], z["before"]["span"]["bounds"]
        overlap = F.least(before["y1"], box["y1"]) - F.greatest(before["y0"], box["y0"])
        return z["before"].isNull() | (F.greatest(overlap, F.lit(0.0)) < z["need"])

    neighbours = F.arrays_zip(
        spans.alias("s"),
        F.slice(F.concat(F.array(F.lit(None).cast(SPAN)), spans), F.lit(1), n).alias("before"),
        F.array_repeat(need, n).alias("need"),
    )
    starts = F.filter(F.transform(neighbours, lambda z, i: F.when(opens(z), i)), lambda i: i.isNotNull())
    lines = F.transform(
        "_starts",
        lambda i, k: F.slice("_ordered", i + 1, F.coalesce(F.get(F.col("_starts"), k + 1), n) - i),
    )
    return (
        pages.select("revision_id", "page_index", ordered.alias("_ordered"))
        .select("revision_id", "page_index", "_ordered", starts.alias("_starts"))
        .select("revision_id", "page_index", lines.alias("_lines"))
    )


def line_groups(pages: DataFrame) -> DataFrame:
    """(revision_id, page_index, line, text, bounds): one row per span, lines from 1."""
    lines = positions(_with_lines(pages), ["revision_id", "page_index"], F.col("_lines"), "i", "spans")
    spans = lines.select("revision_id", "page_index", (F.col("i") + 1).alias("line"), F.explode("spans").alias("s"))
    return spans.select(
        "revision_id", "page_index", "line", F.col("s.span.text").alias("text"), F.col("s.span.bounds").alias("bounds")
    )


def layout_text(pages: DataFrame) -> DataFrame:
    """Page text with gaps as blanks: (revision_id, page_index, text)."""

    def line_text(line: Column) -> Column:
        left_to_right = F.sort_array(
            F.transform(line, lambda s: F.struct(s["left"].alias("left"), s["ord"].alias("ord"), s["span"].alias("span")))
        )
        return F.aggregate(
            left_to_right,
            F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("right")),
            lambda acc, s: F.struct(
                F.concat(
                    acc["text"],
                    F.when(acc["right"].isNull(), "").otherwise(
                        F.repeat(F.lit(" "), _blanks(s["span"]["bounds"]["x0"] - acc["right"]))
                    ),
                    F.coalesce(s["span"]["text"], F.lit("")),
                ).alias("text"),
                s["span"]["bounds"]["x1"].alias("right"),
            ),
            lambda acc: acc["text"],
        )

    text = F.array_join(F.transform("_lines", line_text), "\n")
    return _with_lines(pages).select("revision_id", "page_index", F.coalesce(text, F.lit("")).alias("text"))


def _blanks(gap: Column) -> Column:
    return F.greatest(F.round(F.greatest(gap, F.lit(0.0)) / SPACE_WIDTH).cast("int"), F.lit(1))


def font_base(name: Column) -> Column:
    """Font name without its subset prefix."""
    return F.coalesce(F.trim(F.regexp_replace(name, SUBSET_PREFIX, "")), F.lit("Unknown"))


def char_runs(chars: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs of characters with the font, size and baseline of the run's first one.

    Returns (revision_id, page_index, run, text, font_name, font_size,
    baseline_y, bold, italic, x0, y0, x1, y1). Pages within the limit become runs in
    one pass over the sorted characters; a larger one is folded in chunks.
    """
    # flat columns pass through Arrow much faster than structs
    named = chars.select(*PAGE, "ord", "ch", *HEAD, *[F.col(f"bounds.{s}").cast("double").alias(s) for s in SIDES])
    fold = HeadRuns(["_font"], {"font_size": 0.25, "baseline_y": 2.0})
    limit = group_limit(named, limit)
    cold, hot, _ = split_hot(named, PAGE, limit)
    runs = _page_runs(cold, fold)
    return runs if hot is None else runs.unionByName(_chunked_runs(hot, fold, limit))


PAGE = ["revision_id", "page_index"]
HEAD = ["font_name", "font_size", "baseline_y", "bold", "italic"]
SIDES = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}


def _chunked_runs(named: DataFrame, fold: HeadRuns, limit: int) -> DataFrame:
    placed = fold_rows(named.withColumn("_font", font_base(F.col("font_name"))), PAGE, ["ord"], fold, limit)
    head = F.min_by(F.struct(*HEAD), "ord").alias("h")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "ch"))), lambda c: c["ch"]), "")
    boxes = [F.coalesce(how(s), F.lit(0.0)).alias(s) for s, how in SIDES.items()]
    return placed.groupBy(*PAGE, "run").agg(text.alias("text"), head, *boxes).select(*PAGE, "run", "text", "h.*", *SIDES)


def _page_runs(named: DataFrame, fold: HeadRuns) -> DataFrame:
    """Runs of pages that a task may hold: sorted by page and order, cut and joined batch by batch."""
    fields = {f.name: f for f in named.schema}
    schema = T.StructType(
        [
            *[fields[k] for k in PAGE], T.StructField("run", T.LongType()), T.StructField("text", T.StringType()),
            *[fields[h] for h in HEAD], *[T.StructField(s, T.DoubleType()) for s in SIDES],
        ]
    )

    def pages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches cut where a page ends."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_pandas().to_numpy() for k in PAGE]
            last = key_cuts(columns)[-2]
            other = bool(held) and [held[-1].column(k)[-1].as_py() for k in PAGE] != [batch.column(k)[0].as_py() for k in PAGE]
            if last or other:
                whole = [*held, batch.slice(0, last)]
                held = []
                yield pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
            held.append(batch.slice(last))
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pages_of(batches):
            columns = {c: batch.column(c).to_pandas() for c in [*PAGE, *fold.inputs]}
            values = fold.rows(columns)
            cuts = key_cuts([columns[k].to_numpy() for k in PAGE])
            starts, numbers = [], []
            for start, end in zip(cuts[:-1], cuts[1:]):
                opens, runs, _ = fold.follow(values[start:end], fold.initial())
                starts.extend(opens)
                numbers.extend(runs)
            at = np.flatnonzero(starts)
            ends = [*at[1:].tolist(), batch.num_rows]
            chars = ["" if c is None else c for c in batch.column("ch").to_pylist()]
            text = ["".join(chars[i:j]) for i, j in zip(at.tolist(), ends)]
            heads = batch.select([*PAGE, *HEAD]).take(pa.array(at))
            boxes = [_extreme(batch.column(s), at, how is F.min) for s, how in SIDES.items()]
            arrays = [
                *[heads.column(k) for k in PAGE], pa.array(np.array(numbers, np.int64)[at]), pa.array(text, pa.string()),
                *[heads.column(h) for h in HEAD], *boxes,
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    # a fixed count: Python work is costly per byte, so small partitions must not merge
    dealt = named.repartition(spread_partitions(named.sparkSession), *PAGE).sortWithinPartitions(*PAGE, "ord", "ch")
    return dealt.withColumn("_font", font_base(F.col("font_name"))).mapInArrow(run, schema)


def _extreme(side: pa.Array, starts: np.ndarray, least: bool) -> pa.Array:
    """The least or greatest of each slice as the SQL aggregates take it: nulls do not count, NaN is the greatest; 0 where all are null."""
    values, given = side.to_numpy(zero_copy_only=False), side.is_valid().to_numpy(zero_copy_only=False)
    found = (np.fmin if least else np.fmax).reduceat(values, starts)
    nan = np.logical_or.reduceat(given & np.isnan(values), starts)
    nan = nan & np.isnan(found) if least else nan
    return pa.array(np.where(nan, np.nan, np.where(np.isnan(found), 0.0, found)), pa.float64(), from_pandas=False)


def nearest_run(points: DataFrame, pages: DataFrame) -> DataFrame:
    """The run under each point: the first whose box holds it, else the nearest centre.

    `pages` holds runs as array<struct<text, bounds>>; a point joins its page's
    row, so no run is shuffled twice.
    """
    x, y = F.col("x"), F.col("y")
    ranked = F.transform(
        "runs",
        lambda r, i: F.struct(
            (~_holds(r["bounds"], x, y)).alias("outside"),
            F.when(_holds(r["bounds"], x, y), i.cast("double"))
            .otherwise(
                F.sqrt(
                    F.pow(x - (r["bounds"]["x0"] + r["bounds"]["x1"]) / 2, F.lit(2.0))
                    + F.pow(y - (r["bounds"]["y0"] + r["bounds"]["y1"]) / 2, F.lit(2.0))
                )
            )
            .alias("rank"),
            i.alias("run"),
            r["text"].alias("text"),
        ),
    )
    joined = points.join(pages.select("revision_id", "page_index", "runs"), ["revision_id", "page_index"], "left")
    best = F.array_min(ranked)
    return joined.withColumn("_best", best).select(
        *points.columns, F.col("_best.run").alias("run"), F.col("_best.text").alias("text")
    )


def _holds(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])


def font_audit(runs: DataFrame) -> DataFrame:
    """(document_id, font, available, runs): embedded subsets and standard fonts are available."""
    available = F.col("font_name").rlike(SUBSET_PREFIX) | font_base(F.col("font_name")).isin(STANDARD_FONTS)
    return (
        runs.select("document_id", font_base(F.col("font_name")).alias("font"), F.coalesce(available, F.lit(False)).alias("available"))
        .groupBy("document_id", "font", "available")
        .agg(F.count(F.lit(1)).alias("runs"))
    )
