"""SimHash near-dedup through deletion-variant signatures.

A document's fingerprint has 64 bits; two documents are linked when at most
`max_bits` of them differ. The fingerprint is cut into so few segments that a
linked pair has one segment with at most one differing bit: max_bits // 2 + 1
segments, two for the usual three bits. Each segment is indexed once as it is
and once for each of its bits with that bit masked out, so such a pair meets in
an equality join on (segment, masked bit, remaining bits), and the whole
fingerprints are compared there.

Copies meet first: documents with one fingerprint are one class, whatever their
number, and only classes are joined. A class list in one bucket is joined pair
by pair up to `bucket_limit`; the members of larger buckets go another exact
way, without pairs (see `_hub_links`).

Defined results: a text that is null or has no word has fingerprint zero and is
linked like any other. Ties do not set a bit. Repeated rows share their class.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm import shingles
from folioworks.llm.common import cut, free_name, unsized
from folioworks.llm.components import components
from folioworks.session import spread_partitions

BITS = 64
#: Shingles hashed at a time, so that a very long text needs bounded memory besides itself.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    flat, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (np.concatenate(([0], ends[:-1] + 1))[:n]).tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        part = [digest(flat[i:j], seed) for i, j in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id, h, fp) of every row: `h` is a hash of the text, `fp` the fingerprint as a bigint."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def run(batches):
        for batch in batches:
            fp = [fingerprint(t.as_py(), width, seed) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], ["id", "h", "fp"])

    return rows.mapInArrow(run, "id long, h long, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _signatures(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, wild, mark, sig): one row per segment as it is and one per segment with one bit masked out.

    `wild` is the masked bit or -1, `mark` the number of the mask and `sig` a hash of the mask and what it leaves.
    """
    n_seg = max_bits // 2 + 1
    edges = [BITS * i // n_seg for i in range(n_seg + 1)]
    masks = []
    for lo, hi in itertools.pairwise(edges):
        full = (1 << hi) - (1 << lo)
        masks.append((-1, full))
        if max_bits:
            masks += [(p, full & ~(1 << p)) for p in range(lo, hi)]
    keys = F.array(
        *[F.struct(F.lit(i).alias("mark"), F.lit(p).alias("wild"), F.lit(_signed(m)).alias("mask")) for i, (p, m) in enumerate(masks)]
    )
    # few bytes become many rows here, so the partition count is set and not left to be merged by size
    # (by another expression than the one that distinct has hashed by, or Spark leaves the exchange out)
    spread = fps.repartition(spread_partitions(fps.sparkSession), F.xxhash64("fp"))
    rows = spread.select("fp", F.explode(keys).alias("_k"))
    return rows.select("fp", "_k.wild", "_k.mark", F.xxhash64(F.col("_k.mark"), F.col("fp").bitwiseAND(F.col("_k.mask"))).alias("sig"))


def fingerprint_links(fps: DataFrame, max_bits: int = 3, bucket_limit: int = 256) -> DataFrame:
    """(a, b): links between distinct fingerprints (column `fp`), each within max_bits.

    Buckets of up to bucket_limit members give every pair that is within max_bits; larger ones give links that
    connect the same fingerprints.
    """
    sigs = _signatures(fps.select("fp").distinct(), max_bits)
    # most signatures stand alone; what is left after this count is small
    shared = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # signatures are sized as the fingerprints that they come from, some hundredth
    met = cut(unsized(sigs).join(shared, "sig"))
    small = met.where(F.col("n") <= bucket_limit)
    a, b = small.alias("a"), small.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # a pair with an equal segment meets by the segment as it is, one with one differing bit by the mask of that bit
    at_bit = F.call_function("shiftright", differ, F.greatest(F.col("a.wild"), F.lit(0))).bitwiseAND(F.lit(1)) == 1
    on = (
        (F.col("a.sig") == F.col("b.sig"))
        & (F.col("a.mark") == F.col("b.mark"))
        & (F.col("a.fp") < F.col("b.fp"))
        & ((F.col("a.wild") < 0) | at_bit)
        & (F.bit_count(differ) <= max_bits)
    )
    pairs = a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    hot = met.where(F.col("n") > bucket_limit).select("fp").distinct()
    return pairs.unionByName(_hub_links(hot, max_bits)).distinct()


def _hub_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links that connect all fingerprints within max_bits of each other, without pairs.

    Every fingerprint lists the points within `reach` bits of it. A pair at most max_bits apart has a point within
    `core` bits of one and within `reach` of the other, where core + reach = max_bits; so tying all that list a
    point to the smallest of those within `core` bits of it adds no false link and loses no connection. A point is
    listed by no more fingerprints than there are points within `reach` bits of it.
    """
    core = max_bits // 2
    reach = max_bits - core
    listed = None
    for r in range(reach + 1):
        masks = [_signed(sum(1 << p for p in bits)) for bits in itertools.combinations(range(BITS), r)]
        part = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("_m"))
        part = part.select("fp", F.lit(r).alias("r"), F.col("fp").bitwiseXOR(F.col("_m")).alias("hub"))
        listed = part if listed is None else listed.unionByName(part)
    centre = F.min(F.when(F.col("r") <= core, F.col("fp")))
    hubs = listed.groupBy("hub").agg(centre.alias("a"), F.collect_list("fp").alias("all"))
    tied = hubs.where("a is not null and size(all) > 1").select("a", F.explode("all").alias("b"))
    return tied.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _classes(fps: DataFrame, max_bits: int, bucket_limit: int) -> DataFrame:
    """(fp, root, component_id): the component of each distinct fingerprint and its smallest id."""
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    links = fingerprint_links(classes, max_bits, bucket_limit)
    of = components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = classes.join(of, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 3,
    max_bits: int = 3,
    seed: int = 42,
    bucket_limit: int = 256,
) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id reachable over links.

    Rows with a null id keep their fingerprint and take part in linking through it; a component of such rows only
    has a null component_id. Ids that repeat are fine.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width, seed))
    named = _classes(fps, max_bits, bucket_limit)
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 3,
    max_bits: int = 3,
    seed: int = 42,
    bucket_limit: int = 256,
    similarity: float | None = None,
) -> DataFrame:
    """One row of docs per group of near copies, that of the smallest id, with all its columns.

    With a similarity, near copies are texts whose sets of `width` word shingles have that Jaccard similarity or more,
    each checked on the whole sets: those within max_bits first, then what shares a key (see `shingles`). Null ids come last. Of different texts of the smallest id one is kept, and of rows that repeat id and text one.
    """
    if similarity is None:
        fps = cut(fingerprints(docs, id_col, text_col, width, seed))
        named = _classes(fps, max_bits, bucket_limit).select("fp", "root")
    else:
        fps, named = shingles.similar_classes(
            docs,
            id_col,
            text_col,
            width=width,
            similarity=similarity,
            seed=seed,
            bucket_limit=bucket_limit,
            near=lambda distinct: fingerprint_links(distinct, max_bits),
        )
    winner = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("w")
    winners = fps.join(named, "fp").groupBy("root").agg(winner)
    a, b, none, row = (free_name(docs, c) for c in ("_id", "_h", "_none", "_row"))

    def place(key: Column, h: Column) -> dict[str, Column]:
        return {a: F.coalesce(key, F.lit(0).cast("long")), none: key.isNull(), b: h}

    # the join and the groups go by the same columns, so texts cross one shuffle
    winners = winners.select(*[c.alias(name) for name, c in place(F.col("w.id"), F.col("w.h")).items()])
    hashed = docs.withColumns(place(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))))
    kept = hashed.join(winners, [a, none, b], "left_semi")
    # repeats of id and text: the row with the smallest hash of its other columns
    others = [F.col(c) for c, kind in docs.dtypes if c != text_col and "map<" not in kind and "variant" not in kind]
    one = kept.groupBy(a, none, b).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*others)).alias(row))
    return one.select(f"{row}.*")


def as_hex(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
