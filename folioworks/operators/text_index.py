"""A stored index of page text for repeated searches: word positions and trigrams, both in one posting table.

`build` writes two tables into a folder: `pages`, the page text dealt by a hash of
the page to partitions `part`, and `postings`, one row per term and lot of pages
with the pages that have the term, dealt by a hash of the term to partitions
`bucket`. With a word's page stand its places on it in ascending order, each as the
distance to the one before. Pages and places are packed as numbers of a byte or two
each; page keys that are no whole numbers, or null, stand as they are.

A search reads the postings of its terms only: words that the query shows whole
must stand on a page one behind the other in the query's order; a query that shows
none whole must have its trigrams on the page. Those are necessary conditions, so
the exact scan of `search` over the pages that meet them finds every hit, and the
page table is read only in the partitions that hold such pages.

Words are runs of ASCII word characters, as in the whole-word rule. Trigrams are
made of folded text in which all characters that match each other regardless of
case are the same one. A page with a character that is no ASCII word character but
matches one (a long s, a Kelvin sign) is marked and always scanned.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioworks.operators import search as scan
from folioworks.session import shuffles_dropped

WORD = re.compile("[A-Za-z0-9_]+")
GRAM = 3
#: Marks pages with characters that match ASCII word characters without being one; no word contains it.
ODD_PAGE = "\x00"
PAGE_KEY = ["revision_id", "page_index"]
#: Pages whose terms are gathered before they are written: a row each for term and page costs far more to move and sort.
LOT = 2_000


def _canonical() -> dict[int, str]:
    """Lower-case characters whose capital has another lower-case form too, to that form."""
    found = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        form = c.upper().lower()
        if len(c.upper()) == 1 and len(form) == 1 and len(c.lower()) == 1 and form != c.lower():
            found[ord(c.lower())] = form
    return found


CANONICAL = _canonical()
#: Its lower-case form is two characters, but it matches a plain i.
DOTTED_I = "İ"
ODD = re.compile("[" + DOTTED_I + "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.lower().translate(CANONICAL).isascii()) + "]")


ANY_CANONICAL = re.compile("[" + "".join(map(chr, CANONICAL)) + "]")


def folded(text: str) -> str:
    plain = text.replace(DOTTED_I, "i").lower()
    return plain.translate(CANONICAL) if ANY_CANONICAL.search(plain) else plain


def words(content: str) -> Iterator[tuple[str, list[int]]]:
    """(word, places as distances) of a page."""
    places: dict[str, list[int]] = {}
    last: dict[str, int] = {}
    for at, word in enumerate(WORD.findall(content.lower() if content.isascii() else content)):
        word = word.lower()
        places.setdefault(word, []).append(at - last.get(word, 0))
        last[word] = at
    yield from places.items()
    if not content.isascii() and ODD.search(content):
        yield ODD_PAGE, []


def grams(plain: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(trigrams, number of texts of each, those texts one trigram after the other) of folded texts."""
    lengths = np.array([len(t) for t in plain], dtype=np.int64)
    codes = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32).astype(np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    at = np.flatnonzero(left >= GRAM)
    # code points have 21 bits
    packed = codes[at] << 42 | codes[at + 1] << 21 | codes[at + 2]
    found, which = np.unique(packed, return_inverse=True)
    pairs = np.unique(which * len(plain) + np.repeat(np.arange(len(plain)), lengths)[at])
    counts = np.bincount(pairs // max(len(plain), 1), minlength=len(found))
    names = [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in found.tolist()]
    return names, counts, pairs % max(len(plain), 1)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _part(parts: int):
    return F.pmod(F.xxhash64(*PAGE_KEY), F.lit(parts)).cast("int")


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, how many each number takes) of whole numbers: seven bits a byte, lowest first, all but a number's last byte over 127."""
    plain = values.view(np.uint64) << np.uint64(1) ^ (values >> np.int64(63)).view(np.uint64)  # small of either sign first
    sizes, most = np.ones(len(plain), np.int64), int(plain.max(initial=0))
    for k in range(1, -(-most.bit_length() // 7)):
        sizes += plain >= np.uint64(1 << 7 * k)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.repeat(plain, sizes) >> (7 * at).astype(np.uint64) & np.uint64(127)
    return out.astype(np.uint8) | ((at < np.repeat(sizes, sizes) - 1) * 128).astype(np.uint8), sizes


def numbers(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, where the bytes of each end) of such bytes."""
    ends = np.flatnonzero(packed < 128) + 1
    starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
    at = np.arange(len(packed)) - np.repeat(starts, ends - starts)
    parts = (packed & 127).astype(np.uint64) << (7 * at).astype(np.uint64)
    plain = np.add.reduceat(parts, starts) if len(ends) else parts
    return (plain >> np.uint64(1)).view(np.int64) ^ -(plain & np.uint64(1)).view(np.int64), ends


def _binaries(packed: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums per group of `counts` consecutive values; a group may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _steps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each value less the one before it in its group, the first as it is."""
    steps = np.diff(values, prepend=values[:1] * 0)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    steps[starts] = values[starts]
    return steps


def _unsteps(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    starts = np.cumsum(counts) - counts
    return total - np.repeat(np.concatenate([[0], total])[starts], counts)


def _packed_lot(keys: list[np.ndarray], at: np.ndarray, counts: np.ndarray, places: list[list[int]] | None) -> tuple[pa.Array, pa.Array]:
    """(keys, places) of terms: `at` their pages one term after the other, `counts` of them each."""
    fields = [_steps(k[at], counts) for k in keys]
    if places is not None:
        fields.append(np.array([len(p) for p in places], dtype=np.int64))
    packed, sizes = varints(np.stack(fields, axis=1).reshape(-1))
    held = _binaries(packed, _sums(sizes, counts * len(fields)))
    if places is None:
        return held, pa.nulls(len(counts), pa.binary())
    packed, sizes = varints(np.array([d for p in places for d in p], dtype=np.int64))
    return held, _binaries(packed, _sums(_sums(sizes, fields[-1]), counts))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows, how many each row has) of packed rows."""
    lengths = np.array([len(b) for b in column.to_pylist()], dtype=np.int64)
    found, ends = numbers(np.frombuffer(b"".join(column.to_pylist()), np.uint8))
    upto = np.searchsorted(ends, np.cumsum(lengths), side="right")
    return found, np.diff(upto, prepend=0)


def _unpacked_rows(keys: pa.Array, places: pa.Array | None, held: pa.StructType) -> pa.Array:
    found, counts = _flat(keys)
    fields = found.reshape(-1, 2 if places is None else 3)
    counts = counts // fields.shape[1]
    pages = [pa.array(_unsteps(fields[:, i], counts)).cast(held[i].type) for i in range(2)]
    own = np.zeros(len(fields), np.int64) if places is None else fields[:, 2]
    flat = pa.array([], pa.int32()) if places is None else pa.array(_flat(places)[0].astype(np.int32))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), flat)
    rows = pa.StructArray.from_arrays([*pages, lists], fields=list(held))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), rows)


def _held(pages: DataFrame) -> T.StructType:
    return T.StructType([*[T.StructField(k, pages.schema[k].dataType) for k in PAGE_KEY], T.StructField("places", T.ArrayType(T.IntegerType()))])


def _unpacked(packed: DataFrame, held: T.StructType) -> DataFrame:
    """packed with its pages in place of keys and places."""
    whole = to_arrow_type(T.ArrayType(held))
    fields = whole.value_type

    @F.arrow_udf(T.ArrayType(held))
    def unpack(rows: pa.Array) -> pa.Array:
        keys, places = rows.field("keys"), rows.field("places")
        kinds = [pa.compute.and_(keys.is_valid(), places.is_null()), pa.compute.and_(keys.is_valid(), places.is_valid()), keys.is_null()]
        parts = [
            _unpacked_rows(keys.filter(kinds[0]), None, fields).cast(whole),
            _unpacked_rows(keys.filter(kinds[1]), places.filter(kinds[1]), fields).cast(whole),
            pa.nulls(pa.compute.sum(kinds[2]).as_py() or 0, whole),
        ]
        order = np.concatenate([np.flatnonzero(k.to_numpy(zero_copy_only=False)) for k in kinds])
        return pa.concat_arrays(parts).take(pa.array(np.argsort(order)))

    return packed.withColumn("pages", F.coalesce("pages", unpack(F.struct("keys", "places")))).drop("keys", "places")


def _packed(pages: DataFrame) -> DataFrame:
    """(kind, term, keys, places, pages): the pages of a term, packed in keys and places or else as they are."""
    narrow = pages.select(*PAGE_KEY, "content")
    whole = all(isinstance(narrow.schema[k].dataType, T.IntegralType) for k in PAGE_KEY)
    held = to_arrow_type(T.ArrayType(_held(narrow)))
    text, some = T.StringType(), T.BinaryType()
    schema = T.StructType(
        [T.StructField(name, kind) for name, kind in (("kind", text), ("term", text), ("keys", some), ("places", some), ("pages", T.ArrayType(_held(narrow))))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, LOT):
                lot = batch.slice(low, LOT)
                contents = [c or "" for c in lot.column("content").to_pylist()]
                found: dict[str, tuple[list[int], list[list[int]]]] = {}
                for i, content in enumerate(contents):
                    for word, distances in words(content):
                        entry = found.get(word)
                        if entry is None:
                            entry = found[word] = ([], [])
                        entry[0].append(i)
                        entry[1].append(distances)
                names, counts, in_pages = grams([folded(c) for c in contents])
                on = np.array([i for own, _ in found.values() for i in own], dtype=np.int64)
                sizes = np.array([len(own) for own, _ in found.values()], dtype=np.int64)
                distances = [p for _, own in found.values() for p in own]
                key_columns = [lot.column(k) for k in PAGE_KEY]
                if whole and not any(c.null_count for c in key_columns):
                    keys = [c.to_numpy().astype(np.int64) for c in key_columns]
                    parts = [_packed_lot(keys, on, sizes, distances), _packed_lot(keys, in_pages, counts, None)]
                    columns = [pa.concat_arrays(p) for p in zip(*parts, strict=True)] + [pa.nulls(len(found) + len(names), held)]
                else:
                    at = np.concatenate([on, in_pages])
                    places = pa.array([*distances, *[[]] * len(in_pages)], pa.list_(pa.int32()))
                    rows = pa.StructArray.from_arrays([*[c.take(pa.array(at)) for c in key_columns], places], fields=list(held.value_type))
                    offsets = pa.array(np.cumsum([0, *sizes.tolist(), *counts.tolist()]).astype(np.int32))
                    none = pa.nulls(len(found) + len(names), pa.binary())
                    columns = [none, none, pa.ListArray.from_arrays(offsets, rows).cast(held)]
                kinds = ["word"] * len(found) + ["gram"] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([*found, *names], pa.string()), *columns], schema.names)

    return narrow.mapInArrow(run, schema)


def postings(pages: DataFrame) -> DataFrame:
    """(kind, term, pages as array<struct<revision_id, page_index, places>>) of pages with (revision_id, page_index, content)."""
    return _unpacked(_packed(pages), _held(pages))


def build(pages: DataFrame, folder: str, *, buckets: int = 64, parts: int = 64, splits: int = 4) -> None:
    """Write the index of (revision_id, page_index, content, spans) into a new folder.

    A bucket of terms and a part of the pages are written by up to `splits` tasks, so a word of every page is no hot task.
    """
    sizes = pages.sparkSession.createDataFrame([(buckets, parts)], "bucket int, part int")
    sizes.write.parquet(f"{folder}/sizes")
    split = F.pmod(F.hash(*PAGE_KEY), F.lit(splits))
    # rows of a term differ in their pages
    own = F.pmod(F.hash("keys", *[F.col("pages")[0][k] for k in PAGE_KEY]), F.lit(splits))
    sorted_ = (
        _packed(pages).withColumn("bucket", _bucket(buckets)).repartition("kind", "bucket", own)
        .sortWithinPartitions("kind", "bucket", "term")
    )
    dealt = pages.select(*PAGE_KEY, "content", "spans").withColumn("part", _part(parts))
    dealt = dealt.repartition("part", split).sortWithinPartitions("part", *PAGE_KEY)
    with shuffles_dropped(pages.sparkSession):
        sorted_.write.option("compression", "zstd").partitionBy("kind", "bucket").parquet(f"{folder}/postings")
        dealt.write.option("compression", "zstd").partitionBy("part").parquet(f"{folder}/pages")


def whole_words(query: str, whole_word: bool) -> list[tuple[int, str]]:
    """(place, word) of the words that the query shows from edge to edge."""
    if ODD.search(query):
        return []
    found = list(enumerate(WORD.finditer(query)))
    return [
        (i, m[0].lower()) for i, m in found
        if (whole_word or m.start() > 0) and (whole_word or m.end() < len(query))
    ]


def _read(spark: SparkSession, folder: str, kind: str, wanted: list[str]) -> DataFrame:
    """Postings of the wanted terms, from their buckets only."""
    table = spark.read.parquet(f"{folder}/postings").where(F.col("kind") == kind)
    found = spark.createDataFrame([(t,) for t in wanted], "term string").select(_bucket(_count(spark, folder, "bucket")).alias("b")).distinct().collect()
    rows = table.where(F.col("bucket").isin([r["b"] for r in found]) & F.col("term").isin(wanted))
    rows = _unpacked(rows, table.schema["pages"].dataType.elementType)
    return rows.select("term", F.explode("pages").alias("p")).select("term", "p.*")


def _count(spark: SparkSession, folder: str, column: str) -> int:
    return int(spark.read.parquet(f"{folder}/sizes").first()[column])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _begins(rows: pa.Array) -> pa.Array:
    """Places out of their distances, less the word's place in the query."""
    distances, shift = rows.field("places"), rows.field("i").to_numpy(zero_copy_only=False)
    lengths = distances.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    total = np.cumsum(distances.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    before = np.concatenate([[0], total])[ends - lengths]
    places = total - np.repeat(before + shift, lengths)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(places.astype(np.int32)))


def candidates(spark: SparkSession, folder: str, query: str, whole_word: bool = False, most_grams: int = 12) -> DataFrame | None:
    """(revision_id, page_index) of the pages that can have a hit; None where every page can."""
    words = whole_words(query, whole_word)
    plain = folded(query)
    if words:
        rows = _read(spark, folder, "word", sorted({w for _, w in words} | {ODD_PAGE}))
        # each place a word has on the page says where the query would begin
        at = F.create_map(*[x for w in {w for _, w in words} for x in (F.lit(w), F.array(*[F.lit(i) for i, v in words if v == w]))])
        begins = rows.where(F.col("term") != ODD_PAGE).select(*PAGE_KEY, "places", F.explode(at[F.col("term")]).alias("i"))
        begins = begins.select(*PAGE_KEY, _begins(F.struct("places", "i")).alias("begins"))
        # no more rows a page than the query has words
        pages = begins.groupBy(*PAGE_KEY).agg(F.collect_list("begins").alias("all"))
        met = F.aggregate(F.slice("all", F.lit(2), F.lit(len(words))), F.col("all")[0], F.array_intersect)
        pages = pages.where((F.size("all") == len(words)) & (F.size(met) > 0)).select(*PAGE_KEY)
        return pages.unionByName(rows.where(F.col("term") == ODD_PAGE).select(*PAGE_KEY)).distinct()
    grams = sorted({plain[i : i + GRAM] for i in range(len(plain) - GRAM + 1)})
    if not grams:
        return None
    wanted = grams[:: -(-len(grams) // most_grams)]  # each is a necessary condition, so some of many do
    rows = _read(spark, folder, "gram", wanted)
    return rows.groupBy(*PAGE_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select(*PAGE_KEY)


def search_indexed(
    spark: SparkSession, folder: str, query: str, match_case: bool = False, whole_word: bool = False, page: int | None = None
) -> DataFrame:
    """The hits of `search`, reading page text only where the index says that there can be one.

    The postings are read at once, to know which parts of the page table to read.
    """
    pages = spark.read.parquet(f"{folder}/pages")
    if query.strip():
        wanted = candidates(spark, folder, query, whole_word)
        if wanted is not None:
            if page is not None:
                wanted = wanted.where(F.col("page_index") == page - 1)
            wanted = wanted.withColumn("part", _part(_count(spark, folder, "part")))
            # one number for each part at most
            held = [r["part"] for r in wanted.select("part").distinct().collect()]
            pages = pages.where(F.col("part").isin(held)).join(wanted, ["part", *PAGE_KEY], "left_semi")
    return scan.search(pages, query, match_case, whole_word, page)
