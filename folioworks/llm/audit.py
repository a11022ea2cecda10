"""How the filters of a corpus interact: what each order of them removes, and what each removes alone.

A document's failures are a mask of one bit per filter. A subset of the filters
keeps it exactly if it fails none of them, so the 32 subsets of five filters make
one 32-bit word per document: bit S is set where the subset S keeps it. How many
documents every subset keeps is then the number of set bits at each position
over all words. Tasks add the words up in carry-save form: three words of one
weight become a sum word and a carry word of twice the weight, by bitwise
operations, until two are left of each weight. Only those counts (32 per part and
label) leave a task. All 120 orders, the steps in them, overlaps and Shapley
sums are differences of those 32 numbers.

A text that an earlier id has is found through the smallest id of each text: a
row repeats if (text, id) is not such a pair. That join is keyed by text and id,
so a text that a third of all rows share is spread like any other.

Defined results: a null text is empty, a null part is the empty string. A row
without an id repeats no text and is repeated by none. An id with several label
rows has a label if one of them has it. Repeated rows count one by one, but the
same id twice does not make a text repeat. Without rows there are no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm.common import WORD, cut

#: Filters by their letter; the bit of a filter is its place here.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ALL = SUBSETS - 1
#: A task keeps the counts of so many (part, label) groups before it passes them on.
GROUPS = 4096


def failures(text: Column) -> Column:
    """Failure mask of the filters that look at one text: few words, repetitive, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n < 200,
        F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * F.lit(50).cast("long"),
        capitals * F.lit(100).cast("long") > F.char_length(text) * F.lit(3).cast("long"),
        F.regexp_like(text, F.lit(r"[#$%&*|]")),
    ]
    bits = [F.when(bad, F.lit(1 << i)).otherwise(F.lit(0)) for i, bad in enumerate(fails)]
    return sum(bits[1:], bits[0])


def masks(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, good, toxic, mask) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        failures(text).alias("mask"),
    )
    rows = cut(rows)  # narrow, and read twice
    firsts = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(*[F.max(F.col(c).eqNullSafe(1).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    repeats = F.col("id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(repeats, F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    found = rows.join(firsts, ["id", "digest"], "left").join(marks, "id", "left")
    return found.select(
        "part", (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"), mask.alias("mask")
    )


def survival_word(mask: int) -> int:
    """Bit S is set where the subset S of the filters has none that fails."""
    return sum(1 << s for s in range(SUBSETS) if not mask & s)


WORDS = np.array([survival_word(m) for m in range(SUBSETS)], dtype=np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """Number of words in which each of the 32 bits is set, by carry-save adders."""
    counts, weight = np.zeros(SUBSETS, dtype=np.int64), 1
    positions = np.arange(SUBSETS, dtype=np.uint32)
    while words.size:
        carries = []
        while words.size > 2:
            third = words.size // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third :]])
        counts += weight * ((words[:, None] >> positions) & 1).sum(axis=0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


COUNTED = pa.schema([("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("survivors", pa.list_(pa.int64()))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        names, part = parts.dictionary.to_pylist(), np.asarray(parts.indices)
        good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic"))
        group = part.astype(np.int64) * 4 + good * 2 + toxic
        order = np.argsort(group, kind="stable")
        words = WORDS[np.asarray(batch.column("mask"))[order]]
        keys, begins = np.unique(group[order], return_index=True)
        for key, own in zip(keys.tolist(), np.split(words, begins[1:]), strict=True):
            at = (names[key // 4], bool(key & 2), bool(key & 1))
            counts = positional_popcount(own)
            held[at] = held[at] + counts if at in held else counts
        if len(held) >= GROUPS:
            yield _emit(held)
            held = {}
    if held:
        yield _emit(held)


def _emit(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    rows = [{"part": p, "good": g, "toxic": t, "survivors": c.tolist()} for (p, g, t), c in held.items()]
    return pa.RecordBatch.from_pylist(rows, COUNTED)


def subset_survivors(rows: DataFrame) -> DataFrame:
    """(part, survivors, good_survivors, toxic_survivors): for each subset of filters, how many documents it keeps."""
    counted = rows.mapInArrow(_count, "part string, good boolean, toxic boolean, survivors array<long>")

    def total(where: Column) -> Column:
        return F.array(*[F.sum(F.when(where, F.col("survivors")[s]).otherwise(F.lit(0))) for s in range(SUBSETS)])

    return counted.groupBy("part").agg(
        total(F.lit(True)).alias("survivors"), total(F.col("good")).alias("good_survivors"), total(F.col("toxic")).alias("toxic_survivors")
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step in it, with the counts of that step.

    kept after the step; removed by it; redundant (fails its filter, removed earlier); unique_fails (fails its filter
    alone); good_lost and toxic_lost among the removed; shapley (removed by this filter, summed over all orders).
    """
    subsets = subset_survivors(masks(docs, labels, **columns))
    orders = F.explode(F.lit(["".join(p) for p in permutations(FILTERS)]))
    rows = subsets.select("*", orders.alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), F.substr("filter_order", place, F.lit(1))) - 1)

    own = bit(F.col("step"))
    before = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda acc, i: acc + F.when(i == 0, 0).otherwise(bit(i)))
    rows = rows.withColumn("own", own).withColumn("before", before)

    def keeps(counts: str, subset: Column) -> Column:
        return F.element_at(counts, (subset + 1).cast("int"))

    after = F.col("before") + F.col("own")
    lost = {name: keeps(col, F.col("before")) - keeps(col, after) for name, col in (("removed", "survivors"), ("good_lost", "good_survivors"), ("toxic_lost", "toxic_survivors"))}
    # a filter is one of five letters: its removals over all orders weigh each subset before it by the orders that begin so
    weights = {s: _orders_with(s) for s in range(SUBSETS)}
    shapley = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.lit(ALL)), lambda s: s.bitwiseAND(F.col("own")) == 0),
        F.lit(0).cast("long"),
        lambda acc, s: acc + F.element_at(F.lit([weights[s] for s in range(SUBSETS)]), s + 1) * (keeps("survivors", s) - keeps("survivors", s + F.col("own"))),
    )
    fails = keeps("survivors", F.lit(0)) - keeps("survivors", F.col("own"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        keeps("survivors", after).alias("kept"),
        lost["removed"].alias("removed"),
        (fails - lost["removed"]).alias("redundant"),
        (keeps("survivors", F.lit(ALL) - F.col("own")) - keeps("survivors", F.lit(ALL))).alias("unique_fails"),
        lost["good_lost"].alias("good_lost"),
        lost["toxic_lost"].alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def _orders_with(before: int) -> int:
    """Number of orders that have exactly the filters of a subset in front of one other filter."""
    return int(np.prod(range(1, before.bit_count() + 1)) * np.prod(range(1, len(FILTERS) - before.bit_count())))
