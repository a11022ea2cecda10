"""Quality classifier by compression with zstandard dictionaries.

One dictionary is built from text labelled good and one from text labelled bad.
A text is compressed in blocks with either; (bad - good) / (bad + good) of the
two sizes says which kind it resembles. A logistic curve, fitted on labelled
documents that gave no dictionary text, turns that difference, the plain
compression ratio (text that repeats itself says so there) and the length into
the probability of label 1.

The fit uses a bounded sample: `rows_per_class` labelled documents of each
label, chosen by hash, half for the dictionaries (`excerpts` stretches of
`block` characters each) and half for the curve (whole texts, of which only
three numbers reach the driver). Everything scored is scored whole.

Defined results: null and empty texts have equal sizes, so they get the curve's
value at difference zero. With labels of one kind only, every score is that
label; without labels every score is 0.5. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.llm.common import cut

THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """What a fit leaves: two dictionaries of `dict_bytes` at most and the curve's numbers."""

    dictionaries: tuple[bytes, bytes] | None
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    constant: float
    block: int
    level: int

    def score(self, text: Column) -> Column:
        """Probability of label 1 for each whole text."""
        if self.dictionaries is None:
            return F.lit(self.constant)
        model = self

        @F.arrow_udf("double")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            sizes = Sizes(model)
            for texts in batches:
                x = np.array([sizes.features(t.as_py()) for t in texts], dtype=float).reshape(len(texts), -1)
                yield pa.array(model.curve(x), pa.float64())

        return run(text)

    def curve(self, x: np.ndarray) -> np.ndarray:
        z = (x - np.array(self.mean)) / np.array(self.scale)
        return _sigmoid(z @ np.array(self.weights[:-1]) + self.weights[-1])


class Sizes:
    """Compressed sizes of a text under a model's two dictionaries."""

    def __init__(self, model: Model):
        self.block = model.block
        self.pair = []
        for raw in model.dictionaries:
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=model.level)
            plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.pair.append(zstandard.ZstdCompressor(level=model.level, dict_data=known, **plain))

    def features(self, text: str | None) -> tuple[float, float, float]:
        data = (text or "").encode("utf-8", "surrogatepass")
        bad = good = 0
        for at in range(0, len(data), self.block):
            part = data[at : at + self.block]
            bad += len(self.pair[0].compress(part))
            good += len(self.pair[1].compress(part))
        both = bad + good
        return (bad - good) / both if both else 0.0, both / 2 / (len(data) + 20), float(np.log1p(len(data)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3):
    """Mean, scale and weights of a weighted logistic regression, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    beta = np.zeros(z.shape[1])
    for _ in range(30):
        p = _sigmoid(z @ beta)
        gradient = z.T @ (w * (p - y)) + ridge * beta
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta))
        beta -= np.linalg.solve(hessian, gradient)
    return tuple(mean), tuple(scale), tuple(beta)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    rows_per_class: int = 4000,
    excerpts: int = 2,
    dict_bytes: int = 16384,
    block: int = 1024,
    level: int = 3,
    seed: int = 42,
) -> Model:
    """Fit on labels (id, 0 or 1); rows with another or no label, and ids without a document, are ignored."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    marked = marked.distinct().withColumn("h", F.xxhash64("id", F.lit(seed)))
    total = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    chosen = marked.where("y = 0").orderBy("h", "id").limit(rows_per_class)
    chosen = chosen.unionByName(marked.where("y = 1").orderBy("h", "id").limit(rows_per_class))
    # 2 * rows_per_class narrow rows at most, whatever the input
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = cut(text.join(F.broadcast(chosen), "id"))
    halves = sample.withColumn("half", F.pmod(F.shiftright("h", 7), F.lit(2)))
    stretches = F.transform(
        F.sequence(F.lit(0), F.lit(excerpts - 1)),
        lambda i: F.substr(
            F.col("text"),
            F.pmod(F.xxhash64("id", i, F.lit(seed)), F.greatest(F.char_length("text") - block, F.lit(0)) + 1).cast("int") + 1,
            F.lit(block),
        ),
    )
    pieces = halves.where("half = 0 and text != ''").select("y", "h", F.posexplode(stretches).alias("i", "s"))
    pieces = pieces.orderBy("y", "h", "i", "s").collect()
    by_label = [[r["s"].encode("utf-8", "surrogatepass")[:block] for r in pieces if r["y"] == y] for y in (0, 1)]
    nothing = Model(None, (), (), (), 0.5, block, level)
    if len(total) < 2 or min(map(len, by_label)) < 8:
        share = total.get(1, 0) / sum(total.values()) if total else 0.5
        return Model(None, (), (), (), share, block, level)
    found = tuple(_dictionary(p, dict_bytes, level) for p in by_label)
    model = Model(found, (), (), (), 0.5, block, level)
    rows = halves.where("half = 1").select("y", features(model, F.col("text")).alias("x")).collect()
    x, y = np.array([r["x"] for r in rows], dtype=float), np.array([r["y"] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return nothing
    w = np.where(y == 1, total[1] / (y == 1).sum(), total[0] / (y == 0).sum())
    order = np.lexsort((*x.T, y))  # the rows come in any order; sums must not depend on it
    mean, scale, weights = _logistic(x[order], y[order], (w * len(w) / w.sum())[order])
    return Model(found, mean, scale, weights, 0.5, block, level)


def _dictionary(pieces: list[bytes], size: int, level: int) -> bytes:
    """A trained dictionary; a small or odd sample that the trainer refuses serves as it is."""
    try:
        return zstandard.train_dictionary(min(size, max(512, sum(map(len, pieces)) // 4)), pieces, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def features(model: Model, text: Column) -> Column:
    """The three numbers the curve is made of, as array<double>."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Sizes(model)
        for texts in batches:
            yield pa.array([list(sizes.features(t.as_py())) for t in texts], pa.list_(pa.float64()))

    return run(text)
