"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice: its places are the nodes, vocabulary pieces the edges, and
the best segmentation has the largest sum of piece scores. A forward Viterbi
pass gives the best score from the beginning to every place. An A* search from
the end back uses those scores as its heuristic; as they are exact, complete
segmentations come out in order of their score.

Between two characters that stand side by side in no piece every segmentation
has a boundary, so a text is cut there into units that are independent of each
other; known units are looked up. The n best of a text need alternatives only in
the n - 1 units whose second segmentation is closest to their first: any other
change is no better than changing one of those. How close the second is follows
from the best scores forward and backward through each edge off the best path.

The vocabulary is read from a model file by the driver and sent to the workers
(its size is that of the model, whatever the input). Nothing is trained. A
character without a piece becomes the byte pieces of its UTF-8 form; so does the
blank mark itself where a text contains it, so decoding gives every text back
exactly.

Defined results: a null or empty text has no pieces, score 0 and decodes to the
empty text; equal scores come in a fixed order; repeated rows are encoded alike.
"""

from __future__ import annotations

import heapq
from array import array
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.common import free_name

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Stands for a blank mark that is part of the text: a lone surrogate, which no text from Spark contains.
LITERAL = "\udfff"
SLICE = 128


class Vocabulary:
    """Search in the lattice of a text; parts as `load` gives them, cache a dictionary that may outlive the object."""

    def __init__(self, parts: dict, cache: dict | None = None, cache_size: int = 800_000):
        self.pieces, self.byte_ids, self.unknown = parts["pieces"], parts["byte_ids"], parts["unknown"]
        self.trie, self.letters, self.joined = parts["trie"], parts["letters"], parts["joined"]
        self.cache, self.cache_size = {} if cache is None else cache, cache_size

    def edges(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """Edges that end at each place: (begin, score, ids)."""
        out: list[list] = [[] for _ in range(len(unit) + 1)]
        for begin in range(len(unit)):
            node, end = self.trie, begin
            while node and end < len(unit) and unit[end] in node:
                node, piece, score = node[unit[end]]
                end += 1
                if piece:
                    out[end].append((begin, score, piece))
            if unit[begin] not in self.pieces:
                out[begin + 1].append((begin, self.unknown, self.bytes_of(unit[begin])))
        return out

    def bytes_of(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in (BLANK if c == LITERAL else c).encode())

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a unit, best first."""
        edges = self.edges(unit)
        forward = [0.0] + [float("-inf")] * len(unit)
        for end in range(1, len(unit) + 1):
            forward[end] = max(forward[begin] + score for begin, score, _ in edges[end])
        # (-(best total), place, serial, score from place to the end, chain of ids); at equal totals the one nearest to
        # the beginning goes on, so ties do not widen the search
        agenda = [(-forward[-1], len(unit), 0, 0.0, None)]
        serial, out = 1, []
        while agenda and len(out) < n:
            _, place, _, behind, chain = heapq.heappop(agenda)
            if place == 0:
                ids: list[int] = []
                while chain:
                    ids += chain[0]
                    chain = chain[1]
                out.append((behind, tuple(ids)))
                continue
            for begin, score, ids in edges[place]:
                total = behind + score
                heapq.heappush(agenda, (-(total + forward[begin]), begin, serial, total, (ids, chain)))
                serial += 1
        return out

    def two_best(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of the best segmentation and how much the second falls behind."""
        known = self.cache.get(unit)
        if known is None:
            known = self._two_best(unit)
            if len(unit) <= 64:
                if len(self.cache) >= self.cache_size:
                    self.cache.clear()
                self.cache[unit] = known
        return known

    def _two_best(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        n, low = len(unit), float("-inf")
        forward, last, edges = [0.0] + [low] * n, [0] * (n + 1), []
        for begin in range(n):
            so_far, node, end = forward[begin], self.trie, begin
            while end < n:
                step = node.get(unit[end])
                if step is None:
                    break
                node, piece, score = step
                end += 1
                if piece:
                    if so_far + score > forward[end]:
                        forward[end], last[end] = so_far + score, len(edges)
                    edges.append((begin, end, score, piece))
                if node is None:
                    break
            if unit[begin] not in self.pieces:
                edges.append((begin, begin + 1, self.unknown, self.bytes_of(unit[begin])))
                if so_far + self.unknown > forward[begin + 1]:
                    forward[begin + 1], last[begin + 1] = so_far + self.unknown, len(edges) - 1
        path, place = [], n
        while place:
            path.append(last[place])
            place = edges[last[place]][0]
        ids = tuple(i for at in reversed(path) for i in edges[at][3])
        backward, on_path, second = [low] * n + [0.0], set(path), low
        for at in range(len(edges) - 1, -1, -1):
            begin, end, score, _ = edges[at]
            behind = score + backward[end]
            if behind > backward[begin]:
                backward[begin] = behind
            if at not in on_path and forward[begin] + behind > second:
                second = forward[begin] + behind
        if second == forward[n]:  # equal scores go by the order of the search
            ids = self.n_best(unit, 1)[0][1]
        return ids, forward[n], forward[n] - second

    def units(self, text: str) -> list[str]:
        """Cut the marked text wherever no piece has the two characters side by side."""
        if not text:
            return []
        marked = BLANK + text.replace(BLANK, LITERAL).replace(" ", BLANK)
        kind = self.letters[np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4")]
        cuts = [0, *(np.flatnonzero(~self.joined[kind[:-1], kind[1:]]) + 1).tolist(), len(marked)]
        return [marked[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, text: str | None, n: int = 1) -> tuple[float, array, list]:
        """(score, ids, others) of a whole text: the best segmentation, and the second to n-th as (score, edits).

        An edit (at, drop, ids) puts ids in the place of `drop` pieces from `at` on; see `expand`.
        """
        units = self.units(text or "")
        if not units:
            return 0.0, array("i"), []
        known = self.cache
        found = [known.get(u) or self.two_best(u) for u in units]
        parts, scores, gaps = zip(*found, strict=True)
        score, ids = sum(scores), array("i", chain.from_iterable(parts))
        if n < 2:
            return score, ids, []
        gaps = np.array(gaps)
        limit = np.partition(gaps, min(n - 2, len(gaps) - 1))[min(n - 2, len(gaps) - 1)]
        close = np.flatnonzero((gaps <= limit) & (gaps < np.inf))
        near = sorted(close[np.argsort(gaps[close], kind="stable")[: n - 1]].tolist())
        # totals of choices in those units: (loss, ((unit, ids), ...))
        mixes: list[tuple[float, tuple]] = [(0.0, ())]
        for i in near:
            options = self.n_best(units[i], n)
            joined = [
                (loss + options[0][0] - s, made if at == 0 else (*made, (i, way)))
                for loss, made in mixes
                for at, (s, way) in enumerate(options)
            ]
            mixes = heapq.nsmallest(n, joined, key=lambda m: m[0])
        begins = list(accumulate(map(len, parts), initial=0))
        others = [(score - loss, [(begins[i], len(parts[i]), list(way)) for i, way in made]) for loss, made in mixes[1:]]
        return score, ids, others


def expand(ids, edits) -> list[int]:
    """The ids of another segmentation: edits applied to the best one's ids."""
    out = list(ids)
    for at, drop, new in sorted(edits, reverse=True):
        out[at : at + drop] = new
    return out


class Decoder:
    """Ids back to text."""

    def __init__(self, parts: dict):
        self.parts = [(name or "").replace(BLANK, " ").encode() for name in parts["texts"]]
        for b, i in enumerate(parts["byte_ids"]):
            self.parts[i] = bytes([b])

    def spell(self, ids) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.spell(ids).decode("utf-8", "replace")[1:]


def session_model(spark: SparkSession) -> str:
    """Path of the model file on the driver, as the session sets it."""
    return spark.conf.get("spark.folioworks.pieces.model", DEFAULT_MODEL)


def load(path: str = DEFAULT_MODEL) -> dict:
    """The vocabulary of a SentencePiece model file as plain containers."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(len(names))]
    pieces = {name: (i, model.get_score(i)) for i, name in enumerate(names) if plain[i]}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte pieces")
    # character -> (further characters or None, ids or None, score)
    nodes: dict[str, dict] = {"": {}}
    for name in sorted({name[:end] for name in pieces for end in range(1, len(name) + 1)}, key=len, reverse=True):
        found = pieces.get(name)
        nodes.setdefault(name[:-1], {})[name[-1]] = (nodes.get(name), (found[0],) if found else None, found[1] if found else 0.0)
    inside = sorted({c for name in pieces if len(name) > 1 for c in name})
    letters = np.zeros(0x110000, np.int32)
    letters[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
    joined = np.zeros((len(inside) + 1, len(inside) + 1), bool)
    for name in pieces:
        codes = letters[[ord(c) for c in name]]
        joined[codes[:-1], codes[1:]] = True
    return {
        "pieces": pieces,
        "trie": nodes[""],
        "byte_ids": byte_ids,
        "unknown": min(score for _, score in pieces.values()) - 10,
        "texts": [name if ok else None for name, ok in zip(names, plain, strict=True)],
        "letters": letters,
        "joined": joined,
    }


def encode(
    docs: DataFrame,
    text_col: str = "text",
    *,
    model: str = DEFAULT_MODEL,
    n_best: int = 1,
    keep: list[str] | None = None,
    check: bool = False,
) -> DataFrame:
    """The kept columns (default: all but the text) with ids, score and others.

    ids and score are the best segmentation's; others holds the second to n-th best as struct<score, edits>, an edit
    being struct<at, drop, ids>: ids in the place of `drop` pieces from `at` on. Fewer are listed when a text has
    fewer segmentations. With `check` a column `decodes` says whether every segmentation decodes to the text.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    names = ["ids", "score", "others", *(["decodes"] if check else [])]
    added = [free_name(docs.select(*keep), c) for c in names]
    carried = docs.select(F.col(text_col).cast("string"), F.struct(*keep) if keep else F.struct(F.lit(1).alias("_")))
    carried = carried.toDF("text", "kept")
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    kept_type = carried.schema["kept"].dataType.simpleString()

    def run(batches):
        parts = shared.value
        words = Vocabulary(parts, cache=parts.setdefault("cache", {}))  # kept with the broadcast value, for later tasks
        back = Decoder(parts)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(0).to_pylist()
                found = [words.encode(t, n_best) for t in texts]
                columns = [
                    part.column(1),
                    _lists([ids for _, ids, _ in found]),
                    pa.array([score for score, _, _ in found], pa.float64()),
                    pa.array([[{"score": s, "edits": [dict(zip(EDIT, e, strict=True)) for e in edits]} for s, edits in f[2]] for f in found], others),
                ]
                if check:
                    columns.append(pa.array([_decodes(back, t or "", f) for t, f in zip(texts, found, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, ["kept", *names])

    edit = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
    others = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))]))
    kind = f"kept {kept_type}, ids array<int>, score double, "
    kind += "others array<struct<score: double, edits: array<struct<at: int, drop: int, ids: array<int>>>>>"
    kind += ", decodes boolean" if check else ""
    out = carried.mapInArrow(run, kind)
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], *[F.col(c).alias(n) for c, n in zip(names, added, strict=True)])


EDIT = ("at", "drop", "ids")


def _decodes(back: Decoder, text: str, found: tuple) -> bool:
    """Whether the best ids give the text, and the pieces of every edit spell what those they replace spell."""
    _, ids, others = found
    spelled = all(back.spell(new) == back.spell(ids[at : at + drop]) for _, edits in others for at, drop, new in edits)
    return spelled and back.decode(ids) == text


def _lists(rows: list[array]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = array("i")
    for r in rows:
        flat.extend(r)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))


def decode(rows: DataFrame, ids_col: str = "ids", out: str = "text", *, model: str = DEFAULT_MODEL) -> DataFrame:
    """rows with a column `out`: the text of the ids (null ids: null)."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        back = Decoder(shared.value)
        return pa.array([None if x is None else back.decode(x) for x in ids.to_pylist()], pa.string())

    return rows.withColumn(out, run(F.col(ids_col)))
