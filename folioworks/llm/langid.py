"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text accepts exactly the
substrings of that text. A new text is parsed into phrases: the longest match
from the current position is one phrase, the next begins behind it. The fewer
phrases a language's automaton needs for the normalised text, the closer the
text is to that language; fewest phrases win.

Texts are normalised to lower-case letters with one separator for any run of
other characters, and parsed in lanes of `lane` characters that advance side by
side through transition tables in NumPy; a phrase ends at the end of a lane, the
same for every language. Whole texts are parsed.

The fit uses a bounded sample: `texts_per_lang` different texts per language
chosen by hash, `train_chars` characters of language text in all. The tables
take about 8 * train_chars * (alphabet + 3) bytes per language.

Defined results: a text that is null or has no letter is `und` with score 0; so
is everything when there is no labelled text. Equal phrase counts go to the
language that sorts first. The score is a softmax over the negated counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.common import cut

UNDETERMINED = "und"
PAD, GAP = 0, 1
SLICE = 256


def normalise(text: str) -> str:
    """Lower-case letters, one blank for any run of other characters."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of a text; state 0 is the start, all states accept."""
    go: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


@dataclass
class Model:
    """Parsing tables: entry [state * width + class] is next state * 4 + phrases that end here."""

    langs: list[str]
    letters: str
    tables: list[np.ndarray]

    @property
    def width(self) -> int:
        return len(self.letters) + 3

    def classes(self) -> np.ndarray:
        """Class of every code point: letters by place, other letters last, anything else a gap."""
        of = np.full(0x110000, GAP, np.uint16)
        for at in range(0x110000):
            if not 0xD800 <= at < 0xE000 and chr(at).isalpha():
                of[at] = self.width - 1
        for i, c in enumerate(self.letters):
            of[ord(c)] = i + 2
        return of


def build(samples: dict[str, str]) -> Model:
    """A model from normalised text per language."""
    langs = sorted(samples)
    letters = "".join(sorted({c for t in samples.values() for c in t if c != " "}))
    place = {" ": GAP} | {c: i + 2 for i, c in enumerate(letters)}
    width, tables = len(letters) + 3, []
    for lang in langs:
        go = automaton(samples[lang])
        root = np.full(width, 1, np.int32)  # an unknown character is a phrase of its own
        for c, to in go[0].items():
            root[place[c]] = to * 4
        table = np.empty((len(go), width), np.int32)
        table[:] = root + 1  # the phrase ends, the character begins the next one
        table[0] = root
        for state, arcs in enumerate(go):
            for c, to in arcs.items():
                table[state, place[c]] = to * 4
        table[:, PAD] = np.arange(len(go), dtype=np.int32) * 4
        tables.append(table.ravel())
    return Model(langs, letters, tables)


def fit(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    texts_per_lang: int = 64,
    train_chars: int = 20000,
    seed: int = 42,
) -> Model:
    """Learn from the text and language of docs; rows without either are ignored."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))
    # different texts only, so that a group of copies counts once; the limit per language applies before the shuffle
    order = Window.partitionBy("lang").orderBy("h")
    picked = rows.select("lang", "h").distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= texts_per_lang)
    each = max(1, 2 * train_chars // texts_per_lang)
    start = F.pmod(F.col("h"), F.greatest(F.char_length("text") - each, F.lit(0)) + 1).cast("int") + 1
    found = rows.withColumn("s", F.substr("text", start, F.lit(each))).drop("text").join(F.broadcast(cut(picked)), ["lang", "h"])
    found = found.groupBy("lang", "h").agg(F.min("s").alias("s")).collect()  # texts_per_lang short strings per language
    samples: dict[str, str] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        samples[r["lang"]] = f"{samples.get(r['lang'], '')} {normalise(r['s'])}"
    samples = {k: " ".join(v.split())[:train_chars] for k, v in samples.items()}
    return build({k: v for k, v in samples.items() if v})


class Parser:
    """Phrase counts of texts."""

    def __init__(self, model: Model, kept: dict | None = None, lane: int = 512, group_chars: int = 1 << 18):
        """kept: a dictionary that outlives the task and keeps the class of every code point."""
        self.model, self.lane, self.group = model, lane, group_chars
        kept = {} if kept is None else kept
        if "classes" not in kept:
            kept["classes"] = model.classes()
        self.classes = kept["classes"]

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(letters per text, phrases per text and language)."""
        letters = np.zeros(len(texts), np.int64)
        phrases = np.zeros((len(texts), len(self.model.langs)), np.int64)
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= self.group):
                chars += len(texts[end] or "")
                end += 1
            letters[at:end], phrases[at:end] = self._group([(t or "").lower() for t in texts[at:end]])
            at = end
        return letters, phrases

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        model, lane = self.model, self.lane
        n_texts = len(texts)
        sizes = np.array([len(t) for t in texts])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.classes[codes]
        owner = np.repeat(np.arange(n_texts), sizes)
        letters = np.bincount(owner[kind != GAP], minlength=n_texts)
        # drop a gap at the beginning of a text or behind another gap
        behind = np.empty(len(kind), bool)
        behind[:1] = True
        behind[1:] = (kind[:-1] == GAP) | (owner[1:] != owner[:-1])
        keep = (kind != GAP) | ~behind
        kind, owner = kind[keep], owner[keep]
        sizes = np.bincount(owner, minlength=n_texts)
        first = np.cumsum(sizes) - sizes
        within = np.arange(len(kind)) - np.repeat(first, sizes)
        lanes = -(-sizes // lane)
        lane_of = np.repeat(np.cumsum(lanes) - lanes, sizes) + within // lane
        n_lanes = int(lanes.sum())
        grid = np.full((min(lane, int(sizes.max(initial=0))), n_lanes), PAD, np.int32)
        grid[within % lane, lane_of] = kind
        text_of = np.repeat(np.arange(n_texts), lanes)
        out = np.zeros((n_texts, len(model.langs)), np.int64)
        for i, table in enumerate(model.tables):
            state, count = np.zeros(n_lanes, np.int32), np.zeros(n_lanes, np.int64)
            for column in grid:
                step = table[state * model.width + column]
                count += step & 3
                state = step >> 2
            count += state != 0
            out[:, i] = np.bincount(text_of, weights=count, minlength=n_texts).astype(np.int64)
        return letters, out


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a column `out`: struct<lang: string, score: double> of each whole text."""
    kind = "struct<lang: string, score: double>"
    if not model.langs:
        return docs.withColumn(out, F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score")))
    # plain containers, for executors without the package; the size is set by train_chars and the number of languages
    shared = docs.sparkSession.sparkContext.broadcast({"langs": model.langs, "letters": model.letters, "tables": model.tables})
    arrow = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = shared.value
        parser = Parser(Model(kept["langs"], kept["letters"], kept["tables"]), kept)
        for texts in batches:
            found = []
            for at in range(0, len(texts), SLICE):  # few Python strings at a time
                letters, phrases = parser.counts(texts.slice(at, SLICE).to_pylist())
                best = phrases.argmin(axis=1)
                score = 1 / np.exp(-np.minimum(phrases - phrases.min(axis=1, keepdims=True), 700)).sum(axis=1)
                found += [
                    {"lang": parser.model.langs[b], "score": float(s)} if n else {"lang": UNDETERMINED, "score": 0.0}
                    for n, b, s in zip(letters, best, score, strict=True)
                ]
            yield pa.array(found, arrow)

    return docs.withColumn(out, run(F.col(text_col).cast("string")))
