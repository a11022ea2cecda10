"""Packing of token documents into sequences by their length histogram, the shortest pack first.

Documents become token ids with an end id. What is longer than a sequence is cut
into full sequences and a rest, so every piece has a length of `max_tokens` at
most and the corpus is a histogram of lengths. The packing works on that
histogram alone: lengths go from the longest down, each into the pack that is
shortest so far; packs of one pattern are one run with a count, split only when
a length has fewer pieces than the run has packs. Where a length fits into no
open pack, new packs are opened. The packs that are still short afterwards are
filled by cutting: the shortest give tokens to the room of the others, in the
same runs, until less than `least_room` tokens of room are left in each; the one
pack that is left over at the end is cut into powers of two, which need no
padding. All of that is bounded by the number of lengths, whatever the input.

The patterns then meet the documents by rank: the pieces of one length are
numbered, and a run says which ranks of a length it takes, in which sequences and
from which offset. Ranks are counted in the tasks that tokenise, and the counts
per task and length are summed up, so a length that a third of all rows have is
numbered in as many tasks as there are. The ids are written once, to the folder
that all executors share, and shuffled once.

Defined results: a null text is empty and has the end id only. Rows without an
id and repeated rows are packed as rows of their own. Texts of any length are
tokenised whole, between blanks, which gives the same ids. Without rows there
are no pieces.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.session import ensure_checkpoint_dir

ID_BYTES = 4
#: Pieces of one length and task that are numbered together.
LOT = 256
#: A part of a pack: length class, first rank, first token inside the piece, number of tokens.
Part = tuple[int, int, int, int]


@dataclass
class Run:
    """`count` packs of one pattern; the i-th takes rank + i of each part's length."""

    count: int
    parts: list[Part] = field(default_factory=list)
    used: int = 0

    def add(self, part: Part) -> None:
        self.parts.append(part)
        self.used += part[3]

    def split(self, n: int) -> Run:
        """Keep the first n packs, return the others."""
        rest = Run(self.count - n, [(c, r + n, s, t) for c, r, s, t in self.parts], self.used)
        self.count = n
        return rest


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs of packs that take every piece of the histogram {length: count} whole."""
    open_: dict[int, list[Run]] = {}
    shortest: list[int] = []

    def put(run: Run) -> None:
        if run.used not in open_:
            open_[run.used] = []
            heapq.heappush(shortest, run.used)
        open_[run.used].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if shortest and shortest[0] + length <= capacity:
                run = open_[shortest[0]].pop()
                if not open_[shortest[0]]:
                    del open_[heapq.heappop(shortest)]
                n = min(left, run.count)
                if n < run.count:
                    put(run.split(n))
                run.add((length, rank, 0, length))
            else:
                # a new pack takes the next pieces of this length too, as it is the shortest while it has room
                each = min(capacity // length, left)
                run = Run(left // each, [(length, rank + i * (left // each), 0, length) for i in range(each)], each * length)
                n = run.count * each
            put(run)
            rank, left = rank + n, left - n
    return [run for used in sorted(open_) for run in open_[used]]


def fill_by_cutting(runs: list[Run], capacity: int, least_room: int) -> list[Run]:
    """Empty the shortest packs into the room of the longest, cutting a piece where none fits whole."""
    done = [r for r in runs if capacity - r.used < least_room]
    short = sorted((r for r in runs if capacity - r.used >= least_room), key=lambda r: r.used)
    while short and (len(short) > 1 or short[0].count > 1):
        if len(short) == 1:
            short.append(short[0].split(short[0].count // 2))
        giver, taker = short[0], short.pop()
        n = min(giver.count, taker.count)
        if taker.count > n:
            short.append(taker.split(n))
        if giver.count > n:
            short.insert(1, giver.split(n))
        giver.parts.sort(key=lambda p: p[3])
        while giver.parts and (room := capacity - taker.used):
            fits = bisect.bisect_right(giver.parts, room, key=lambda p: p[3])
            if fits:
                part = giver.parts.pop(fits - 1)
            elif room < least_room:
                break
            else:
                # the smallest piece left keeps its head and gives its tail
                length, rank, start, tokens = giver.parts[0]
                giver.parts[0] = (length, rank, start, tokens - room)
                part = (length, rank, start + tokens - room, room)
            giver.used -= part[3]
            taker.add(part)
        if capacity - taker.used < least_room:
            done.append(taker)
        else:
            bisect.insort(short, taker, lo=1, key=lambda r: r.used)
        if not giver.parts:
            short.pop(0)
    return done + [p for r in short for p in powers_of_two(r)]


def powers_of_two(run: Run) -> list[Run]:
    """The same tokens in packs of a power of two each, the largest first."""
    out, parts = [], list(run.parts)
    for bit in reversed(range(run.used.bit_length())):
        if not run.used >> bit & 1:
            continue
        pack = Run(run.count)
        while pack.used < 1 << bit:
            length, rank, start, tokens = parts.pop(0)
            n = min(tokens, (1 << bit) - pack.used)
            pack.add((length, rank, start, n))
            if n < tokens:
                parts.insert(0, (length, rank, start + n, tokens - n))
        out.append(pack)
    return out


def padded_length(used: Column, max_tokens: int) -> Column:
    """Length of a sequence with its padding: the full one, unless it is a power of two."""
    return F.when(F.bit_count(used) == 1, used).otherwise(F.lit(max_tokens).cast("long"))


def session_tokenizer(spark: SparkSession) -> str:
    """The tokenizer file's content, read by the driver: `spark.folioworks.packing.tokenizer` or the public one."""
    named = spark.conf.get("spark.folioworks.packing.tokenizer", "")
    if not named:
        import public_tokenizers

        named = public_tokenizers.path("word_bpe_49k.json")
    return Path(named).read_text(encoding="utf-8")


#: Parts that such a tokenizer never joins: letters that stay one character each in lower case and in composed form, a
#: digit, marks. Apostrophes and what may be a control string are left to the tokenizer.
PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder(dict):
    """Ids of a text as little-endian 32-bit numbers; as a dictionary, of what stands between two blanks.

    For tokenizers that drop white space: no token crosses a blank or a line feed, so a text's ids are those of what
    stands between them, looked up once. Where the tokenizer lowers its input and takes runs of letters as words, a word
    goes to its model alone, whatever its case and the marks around it; everything else goes through the whole tokenizer.
    """

    def __init__(self, tokenizer: str, cache_size: int = 600_000, longest: int = 64):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenize = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.cache_size, self.longest = cache_size, longest
        self.letters = _byte_letters()
        self.by_words = self._words_alone(json.loads(tokenizer))

    @staticmethod
    def _words_alone(parts: dict) -> bool:
        def kinds(step: dict | None, name: str) -> list[str]:
            return [x["type"] for x in (step or {}).get(name, [])]

        if kinds(parts["normalizer"], "normalizers") != ["NFC", "Replace", "Lowercase"]:
            return False
        if kinds(parts["pre_tokenizer"], "pretokenizers") != ["Split", "ByteLevel"]:
            return False
        runs = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex", "").split("|")
        return {r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"} <= set(runs)

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def __missing__(self, chunk: str) -> bytes:
        before = len(self.words)
        if self.by_words and chunk.isascii() and chunk.isalpha():
            coded = self._part(chunk)
        elif self.by_words and chunk[-1] in ".,;:!?" and chunk.isascii() and chunk[:-1].isalpha():
            coded = self._part(chunk[:-1]) + self._part(chunk[-1])
        else:
            parts = PARTS.findall(chunk) if self.by_words else []
            if sum(map(len, parts)) == len(chunk) and "<|" not in chunk:
                coded = b"".join(map(self._part, parts))
            else:
                coded = self._whole(chunk)
        # what has a new word is kept as that word, until it comes again
        if len(self.words) == before and len(chunk) <= self.longest:
            if len(self) >= self.cache_size:
                self.clear()
                self[""] = b""
            self[chunk] = coded
        return coded

    def _part(self, part: str) -> bytes:
        part = part.lower()
        coded = self.words.get(part)
        if coded is None:
            if part.isalpha():
                letters = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
                coded = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
            else:
                coded = self._whole(part)
            if len(part) <= self.longest:
                if len(self.words) >= self.cache_size:
                    self.words.clear()
                self.words[part] = coded
        return coded

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


PIECE = [("start", T.LongType()), ("length", T.IntegerType()), ("doc_tokens", T.LongType()), ("ids", T.BinaryType()), ("chunk", T.IntegerType()), ("nth", T.LongType())]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, *, max_tokens: int, end_id: int) -> DataFrame:
    """Tokenised documents in pieces of max_tokens and a rest; nth counts the pieces of one length in a task."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([named.schema["id"], *[T.StructField(n, t) for n, t in PIECE]])
    end = int(end_id).to_bytes(ID_BYTES, "little")
    step = max_tokens * ID_BYTES
    shared = docs.sparkSession.sparkContext.broadcast({"tokenizer": tokenizer})  # the tokenizer's size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held = shared.value  # kept by the worker for its later tasks, with what the encoder has looked up
        if "encoder" not in held:
            held["encoder"] = Encoder(held["tokenizer"])
        encoder = held["encoder"]
        chunk, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            at, rows, size = [], [], 0
            for i in range(len(batch)):
                coded = encoder.ids(texts[i].as_py() or "") + end
                n = len(coded) // ID_BYTES
                for start in range(0, len(coded), step):
                    piece = coded[start : start + step]
                    length = len(piece) // ID_BYTES
                    nth = counts[length] = counts.get(length, -1) + 1
                    at.append(i)
                    rows.append((start // ID_BYTES, length, n, piece, chunk, nth))
                    size += len(piece)
                    if size >= 1 << 23:
                        yield _batch(ids, at, rows)
                        at, rows, size = [], [], 0
            yield _batch(ids, at, rows)

    return named.mapInArrow(run, schema)


def _batch(ids: pa.Array, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *arrays], ["id", *[n for n, _ in PIECE]])


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    tokenizer: str | None = None,
    max_tokens: int = 2048,
    end_id: int = 1,
    least_room: int = 16,
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ids are little-endian 32-bit numbers."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/packing-{uuid.uuid4().hex}"
    tokenizer = session_tokenizer(spark) if tokenizer is None else tokenizer
    cut = pieces(docs, id_col, text_col, tokenizer, max_tokens=max_tokens, end_id=end_id)
    cut.write.option("compression", "zstd").parquet(folder)
    cut = spark.read.schema(cut.schema).parquet(folder)
    # a lot is what the join brings together: all full pieces of a task would be too much
    cut = cut.withColumn("lot", F.floor(F.col("nth") / LOT).cast("long"))
    counts = cut.groupBy("length", "chunk", "lot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk", "lot").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "chunk", "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows
    runs = fill_by_cutting(shortest_pack_first(histogram, max_tokens), max_tokens, least_room)
    ranked = cut.join(base.hint("shuffle_hash"), ["length", "chunk", "lot"])
    parts = Placements(runs).of(F.col("length"), F.col("base") + F.pmod("nth", F.lit(LOT)))
    found = ranked.select("id", "start", "doc_tokens", "ids", F.explode(parts).alias("part")).select("*", "part.*")
    return found.select(
        F.col("id").alias(id_col),
        (F.col("start") + F.col("inside")).alias("start"),
        F.col("tokens").cast("long").alias("length"),
        F.substr("ids", F.col("inside") * ID_BYTES + 1, F.col("tokens") * ID_BYTES).alias("ids"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


class Placements:
    """Where the pieces of each length go by rank: cells of ranks that are treated alike, and the parts of each cell.

    Their number grows with the number of lengths, not with the input.
    """

    def __init__(self, runs: list[Run]):
        by_length: dict[int, list[tuple[int, ...]]] = {}
        sequence = 0
        for run in runs:
            offset = 0
            for length, rank, start, tokens in run.parts:
                by_length.setdefault(length, []).append((rank, rank + run.count, start, tokens, sequence - rank, offset))
                offset += tokens
            sequence += run.count
        lengths, firsts, begins, parts = [], [], [], []
        for length, of in sorted(by_length.items()):
            of.sort()
            live: list[tuple[int, ...]] = []
            marks, at = sorted({m for p in of for m in p[:2]}), 0
            for first in marks[:-1]:
                live = [p for p in live if p[1] > first]
                while at < len(of) and of[at][0] == first:
                    live.append(of[at])
                    at += 1
                lengths.append(length)
                firsts.append(first)
                begins.append(len(parts))
                parts += [p[2:] for p in sorted(live, key=lambda p: p[2])]
        self.key = _key(np.array(lengths, dtype=np.int64), np.array(firsts, dtype=np.int64))
        self.begin = np.array([*begins, len(parts)], dtype=np.int64)
        self.parts = np.array(parts, dtype=np.int64).reshape(-1, 4)

    def find(self, length: np.ndarray, rank: np.ndarray) -> pa.ListArray:
        cell = np.searchsorted(self.key, _key(length, rank), side="right") - 1
        n = self.begin[cell + 1] - self.begin[cell]
        past = np.cumsum(n)
        at = np.arange(past[-1] if len(past) else 0) + np.repeat(self.begin[cell] - past + n, n)
        inside, tokens, sequence, offset = self.parts[at].T
        fields = {"inside": inside, "tokens": tokens, "sequence_id": sequence + np.repeat(rank, n), "offset": offset}
        struct = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], past]).astype(np.int32)), struct)

    def of(self, length: Column, rank: Column) -> Column:
        """array<struct<inside, tokens, sequence_id, offset>> of a piece, in the order of its tokens."""
        find = self.find

        @F.arrow_udf("array<struct<inside:long,tokens:long,sequence_id:long,offset:long>>")
        def run(length: pa.Array, rank: pa.Array) -> pa.Array:
            return find(length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False))

        return run(length, rank)


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length << 44) | rank
