"""Mixing sources to target weights.

Sizes are summed per source (combined before the shuffle), each source gets a
target share of the mix, and target / size is its repetition rate. A document is
then emitted floor(rate) times, plus once more when a number drawn from a hash
of its id and the seed is below the rate's fraction. Documents are never
shuffled: they meet only the small table of rates, one row per source.

Targets: sources in code-point order, null last, take the given weights in turn
and share `share` times the size of everything; none may exceed `max_rate` times
its own size, and what is cut there goes to the others by weight until none is
above. In closed form that is min(max_rate * size, level * weight) for one
level, found by sorting sources by size / weight.

Defined results: null and wordless texts have size 0 and are emitted like any
other; a source of size 0 has target 0 and rate 0. Rows that repeat an id get
the same number of copies each, a null id draws like any other value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.common import WORD, cut, free_name

#: Rates of up to so many sources are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Draws are whole numbers below this.
STEPS = 1 << 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_rate: float = 2.0
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The running sums go over one row per source in one task; sources are few beside documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn))
    # a smaller ratio reaches its limit at a lower level
    w = w.withColumn("ratio", F.col("source_size") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.sum("source_size").over(everything) * share
    full = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * max_rate
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    # the level if all before this source are at their limit and all from it on are not; later ones that fit are lower
    w = w.withColumn("level", (whole - full) / rest)
    fits = F.when(F.col("level") <= F.col("ratio") * max_rate, F.col("level"))
    level = F.max(fits).over(everything)
    limit = F.col("source_size") * F.lit(float(max_rate))
    target = F.when(level.isNull(), limit).otherwise(F.least(limit, level * F.col("w")))
    return w.withColumn("target", target).select("source", "source_size", "target")


def copies(rate: Column, key: Column, seed: int = 42) -> Column:
    """floor(rate), plus one with probability equal to the fraction, decided by a hash of key and seed."""
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(STEPS)) / F.lit(float(STEPS))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_rate: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """docs with a struct column `mix`: size, source_size, target, rate and copies of each document."""
    out, size = free_name(docs, "mix"), free_name(docs, "_size")
    sized = docs.withColumn(size, word_count(F.col(text_col)))
    sums = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("source_size"))
    of = cut(targets(sums, weights, share, max_rate)).select(*[F.col(c).alias(f"_{c}_{out}") for c in ("source", "source_size", "target")])
    if of.count() <= BROADCAST_ROWS:
        of = F.broadcast(of)
    joined = sized.join(of, sized[source_col].eqNullSafe(of[f"_source_{out}"]), "left")
    total, target = F.col(f"_source_size_{out}"), F.col(f"_target_{out}")
    rate = F.when(total > 0, target / total).otherwise(F.lit(0.0))
    mix = F.struct(
        F.col(size).alias("size"),
        total.alias("source_size"),
        target.alias("target"),
        rate.alias("rate"),
        copies(rate, F.col(id_col), seed).alias("copies"),
    )
    return joined.select(*docs.columns, mix.alias(out))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    planned = plan(docs, **options)
    out = planned.columns[-1]
    times = F.array_repeat(F.lit(0), F.col(out)["copies"].cast("int"))
    return planned.select(*docs.columns, F.explode(times).alias(out)).select(*docs.columns)
