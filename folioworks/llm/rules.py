"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every text is measured as a whole, inside its row. Per language and source each
rate's distribution is kept as a quantile sketch: counts of logarithmic buckets
with a relative error of ACCURACY (a DDSketch), which merge by adding counts.
The sketches of a source with fewer than `min_rows` rows give way to the merged
sketches of its language, those to the merged sketches of everything. Upper
limits are q75 + reach * (q75 - q25), with a least width per rate, so that a
uniform source does not reject its own tail; a joined filter then applies them.

Rows that fail the fixed base rule count in no sketch. Only narrow rows (an id,
counts, language and source) are written and shuffled, and counts per bucket
combine before the shuffle, so a source with a third of all rows is no hot task.

Defined results: null, empty and wordless texts have zero counts and fail the
base rule. Null languages and sources are groups of their own. Repeated rows are
measured and judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.common import WORD, cut, free_name

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Rates in thousandths: numerator, denominator, least width between q25 and q75.
RATES = {
    "symbols": ("n_symbols", "word_chars", 5),
    "marks": ("n_marks", "word_chars", 10),
    "upper": ("n_upper", "word_chars", 15),
    "dup_lines": ("n_dup_lines", "n_lines", 100),
    "repeats": ("n_repeat_words", "n_words", 100),
    "length": ("word_chars", "n_words", 500),
}
BROADCAST_ROWS = 100_000


def _count(text: Column, other: str) -> Column:
    """Characters of text left without those of the class `other`."""
    return F.char_length(F.regexp_replace(text, other, "")).cast("long")


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_upper, n_lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(*keep, text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda line: F.regexp_like(line, F.lit(WORD)))
    # low bits of a window's sort key hold its position: as many as the number of words needs
    df = df.select(
        *keep,
        "_words",
        F.size("_words").alias("_n"),
        F.array_join("_words", "").alias("_chars"),
        lines.alias("_lines"),
    )
    mask = F.call_function("shiftleft", F.lit(-1).cast("long"), F.ceil(F.log2(F.col("_n") + 1)).cast("int"))
    df = df.withColumn("_mask", mask)
    window = F.transform(
        "_words",
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).bitwiseAND(F.col("_mask")).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn("_keys", F.sort_array(F.slice(window, F.lit(1), F.greatest(F.col("_n") - 2, F.lit(0)))))
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_keys", _repeated), _position)))
    # windows start less than three words apart overlap
    span = F.transform("_at", lambda p, k: F.least(F.coalesce(F.get("_at", k + 1) - p, F.lit(3)), F.lit(3)).cast("long"))
    zero = F.lit(0).cast("long")
    return df.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.char_length("_chars").cast("long").alias("word_chars"),
        _count(F.col("_chars"), r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(span, zero, lambda a, x: a + x).alias("n_repeat_words"),
        _count(F.col("_chars"), r"[\p{L}\p{N}\p{M}]+").alias("n_marks"),
        _count(F.col("_chars"), r"[^\p{Lu}]+").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def _position(key: Column) -> Column:
    return key.bitwiseAND(F.bitwise_not(F.col("_mask"))).cast("int")


def _repeated(key: Column, k: Column) -> Column:
    """Whether the window beside this one in key order has the same words."""

    def same(other: Column) -> Column:
        equal = key.bitwiseAND(F.col("_mask")) == other.bitwiseAND(F.col("_mask"))
        for i in range(3):
            equal = equal & (F.get("_words", _position(key) + i) == F.get("_words", _position(other) + i))
        return F.coalesce(equal, F.lit(False))

    return (F.when(k > 0, same(F.get("_keys", k - 1))).otherwise(F.lit(False))) | same(F.get("_keys", k + 1))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rate(name: str) -> Column:
    """A rate in whole thousandths."""
    over, under, _ = RATES[name]
    return F.when(F.col(under) > 0, F.call_function("div", 1000 * F.col(over), F.col(under))).otherwise(F.lit(0)).cast("long")


def _bucket(value: Column) -> Column:
    return F.ceil(F.ln(value + 1) / math.log(GAMMA)).cast("int")


def _value(bucket: Column) -> Column:
    """The middle of a bucket, within ACCURACY of all its values."""
    return 2 * F.pow(F.lit(GAMMA), bucket) / (GAMMA + 1) - 1


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rate, bucket, n) of measured rows that pass the base rule."""
    items = F.array(*[F.struct(F.lit(r).alias("rate"), _bucket(_rate(r)).alias("bucket")) for r in RATES])
    each = rows.where(~base_failed()).select("lang", "source", F.explode(items).alias("_i")).select("lang", "source", "_i.*")
    return each.groupBy("lang", "source", "rate", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _limits(sketch: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """(keys, rows, limits): rows sketched and a map of rate to upper limit."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*keys, "rate").orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = merged.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(whole)})
    q25, q75 = (F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bucket"))) for q in (25, 75))
    per_rate = ranked.groupBy(*keys, "rate").agg(_value(q25).alias("q25"), _value(q75).alias("q75"), F.max("all").alias("rows"))
    width = F.create_map(*[F.lit(x) for r, (_, _, w) in RATES.items() for x in (r, float(w))])
    limit = F.col("q75") + reach * F.greatest(F.col("q75") - F.col("q25"), F.element_at(width, F.col("rate")))
    return per_rate.groupBy(*keys).agg(
        F.max("rows").alias("rows"), F.map_from_entries(F.collect_list(F.struct("rate", limit.alias("limit")))).alias("limits")
    )


def thresholds(sketch: DataFrame, min_rows: int = 200, reach: float = 3.0) -> DataFrame:
    """(lang, source, limits): own limits where enough rows were sketched, else the language's, else everything's."""
    own = _limits(sketch, ["lang", "source"], reach)
    lang = _limits(sketch, ["lang"], reach).select(F.col("lang").alias("_lang"), F.col("rows").alias("_n"), F.col("limits").alias("_l"))
    whole = _limits(sketch.withColumn("one", F.lit(1)), ["one"], reach).first()  # one number per rate
    default = F.create_map(*[F.lit(x) for pair in sorted((whole["limits"] if whole else {}).items()) for x in pair])
    found = own.join(lang, own["lang"].eqNullSafe(lang["_lang"]), "left")
    limits = F.when(F.col("rows") >= min_rows, F.col("limits")).when(F.col("_n") >= min_rows, F.col("_l")).otherwise(default)
    return found.select("lang", "source", limits.alias("limits"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    *,
    min_rows: int = 200,
    reach: float = 3.0,
) -> DataFrame:
    """(id, measures, base_failed, failed, kept) of every row; failed names the rates over their limits."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")
    )
    rows = cut(measures(rows, keep=("id", "lang", "source")))
    limits = cut(thresholds(cut(sketches(rows)), min_rows, reach))
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "limits")
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    over = [F.when(_rate(r) > F.element_at("limits", F.lit(r)), F.lit(r)) for r in RATES]
    judged = joined.withColumns({"base_failed": base_failed(), "failed": F.array_compact(F.array(*over))})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept"
    )


def keep(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, with all their columns, that are kept themselves: rows with one id or none are judged apart."""
    mark = free_name(docs, "_row")
    text, lang, source = (options.get(f"{c}_col", c) for c in ("text", "lang", "source"))
    row = F.struct(
        F.col(id_col).alias("id"), F.sha2(F.col(text).cast("binary"), 256).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")
    )
    marked = docs.withColumn(mark, row)
    good = judge(marked, mark, **options).where("kept").select(F.col(mark).alias("_good")).distinct()
    return marked.join(good, marked[mark].eqNullSafe(good["_good"]), "left_semi").drop(mark)
