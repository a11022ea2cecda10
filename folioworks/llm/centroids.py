"""Centroid clustering whose assignments come from the threshold algorithm.

For every dimension the centroids stand in a list sorted by their value there.
From a vector's own value each list is walked outward, nearest centroid first. A
centroid seen for the first time gets its exact distance; one not seen yet lies
at least as far away as the frontiers of all lists, so the walk ends when the sum
of the squared frontier distances strictly exceeds the best exact distance (or
all centroids are seen). Ties go to the smaller number, hence the strictness.

Everything is in whole numbers: components become floor(scale * x), sums and
means are exact, so results do not depend on the order of rows or tasks. A round
is one pass: tasks send the sums of their vectors per centroid, and only
`k * dims` numbers reach the driver.

Defined results: vectors with another length than `dims`, null vectors and those
with null or non-finite components are left out. Whole numbers are held within
+-2**27 (a component of 524,288 at scale 256), so that squared distances fit a
long. Rows without an id are clustered, but start as a centroid only if ids run
out. Repeated rows count each; repeated ids start as centroids in the order of
their components. With fewer vectors than `k` there are as many centroids as
vectors; without vectors there are no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 1 << 27
#: Vectors that walk their lists together.
SLICE = 1024
FAR = int(np.iinfo(np.int64).max)


def whole_vectors(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a batch and their components as whole numbers."""
    if pa.types.is_null(vectors.type) or not len(vectors):
        return np.zeros(0, dtype=np.int64), np.zeros((0, dims), dtype=np.int64)
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dims)
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null component becomes NaN
    usable = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(scale * x[usable]), -LIMIT, LIMIT)
    return at[usable], whole.astype(np.int64)


class Lists:
    """Centroids sorted by their value in each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()  # dims x k
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each vector."""
        number, best = np.zeros(len(vectors), dtype=np.int64), np.full(len(vectors), FAR)
        for at in range(0, len(vectors), SLICE):
            number[at : at + SLICE], best[at : at + SLICE] = self._walk(vectors[at : at + SLICE])
        return number, best

    def _walk(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dims = self.centroids.shape
        number, best = np.full(len(v), k), np.full(len(v), FAR)
        seen = np.zeros((len(v), k), dtype=bool)
        right = np.stack([np.searchsorted(self.values[d], v[:, d]) for d in range(dims)], axis=1)
        left, walking, each = right - 1, np.arange(len(v)), np.arange(dims)
        while walking.size:
            x, lo, hi = v[walking], left[walking], right[walking]
            below = np.where(lo >= 0, x - self.values[each, np.maximum(lo, 0)], FAR)
            above = np.where(hi < k, self.values[each, np.minimum(hi, k - 1)] - x, FAR)
            back = below <= above
            frontier = np.minimum(below, above)
            # no list is at its end here: that happens only when all centroids are seen
            go = (frontier**2).sum(axis=1) <= best[walking]
            walking, lo, hi, back = walking[go], lo[go], hi[go], back[go]
            met = np.zeros((walking.size, k), dtype=bool)
            met[np.arange(walking.size)[:, None], self.order[each, np.where(back, lo, hi)]] = True
            new = met & ~seen[walking]
            seen[walking] |= met
            row, centroid = np.nonzero(new)
            distance = ((v[walking[row]] - self.centroids[centroid]) ** 2).sum(axis=1)
            found = np.full((walking.size, k), FAR)
            found[row, centroid] = distance
            first = found.argmin(axis=1)  # the smallest number among equals
            least = found[np.arange(walking.size), first]
            better = (least < best[walking]) | ((least == best[walking]) & (first < number[walking]))
            number[walking[better]], best[walking[better]] = first[better], least[better]
            left[walking], right[walking] = lo - back, hi + ~back
            walking = walking[~seen[walking].all(axis=1)]
        return number, best


def _named(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"))


def first_centroids(df: DataFrame, id_col: str, vec_col: str, *, k: int, dims: int, scale: int, prefix: str) -> np.ndarray:
    """The usable vectors with the k smallest sha256 of prefix and id, in the order of those digests."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            at, whole = whole_vectors(batch.column("vector"), dims, scale)
            digests = batch.column("digest").take(pa.array(at)).to_pylist()
            # null digests come last
            mine = ((d is None, d or "", tuple(x)) for d, x in zip(digests, whole.tolist(), strict=True))
            held = heapq.nsmallest(k, [*held, *heapq.nsmallest(k, mine)])
        rows = [{"missing": m, "digest": d, "whole": list(x)} for m, d, x in held]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("missing", pa.bool_()), ("digest", pa.string()), ("whole", pa.list_(pa.int64()))]))

    digest = F.sha2(F.concat(F.lit(prefix), F.col("id").cast("string")).cast("binary"), 256)
    found = _named(df, id_col, vec_col).select(digest.alias("digest"), "vector")
    found = found.mapInArrow(smallest, "missing boolean, digest string, whole array<long>")
    rows = found.orderBy("missing", "digest", "whole").limit(k).collect()
    return np.array([r["whole"] for r in rows], dtype=np.int64).reshape(-1, dims)


def assign(df: DataFrame, id_col: str, vec_col: str, centroids: np.ndarray, scale: int) -> DataFrame:
    """(id, cluster, distance) of every usable vector."""
    dims = centroids.shape[1]
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            at, whole = whole_vectors(batch.column("vector"), dims, scale)
            number, distance = lists.nearest(whole)
            ids = batch.column("id").take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return _named(df, id_col, vec_col).mapInArrow(run, schema)


def _sums(df: DataFrame, id_col: str, vec_col: str, centroids: np.ndarray, scale: int) -> dict[int, tuple[int, np.ndarray]]:
    """Number of vectors and their exact component sums for each cluster that has any."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, count, total = Lists(centroids), np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            _, whole = whole_vectors(batch.column("vector"), dims, scale)
            number, _ = lists.nearest(whole)
            count += np.bincount(number, minlength=k)
            np.add.at(total, number, whole)
        own = np.flatnonzero(count)
        dim = np.tile(np.arange(dims, dtype=np.int32), own.size)
        columns = [np.repeat(own, dims).astype(np.int32), dim, np.repeat(count[own], dims), total[own].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cluster", "dim", "n", "total"])

    parts = _named(df, id_col, vec_col).select("vector").mapInArrow(run, "cluster int, dim int, n long, total long")
    rows = parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # k * dims at most
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in rows:
        out.setdefault(r["cluster"], (r["n"], np.zeros(dims, dtype=np.int64)))[1][r["dim"]] = r["total"]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    *,
    k: int = 40,
    dims: int = 64,
    rounds: int = 5,
    scale: int = 256,
    prefix: str = "2:",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of every usable vector.

    Each round reads the two columns anew, so the input should be a table or cut before.
    """
    centroids = first_centroids(df, id_col, vec_col, k=k, dims=dims, scale=scale, prefix=prefix)
    spark = df.sparkSession
    if not len(centroids):
        centroids = np.zeros((1, dims), dtype=np.int64)  # nothing is assigned to it
    for _ in range(rounds):
        for number, (n, total) in _sums(df, id_col, vec_col, centroids, scale).items():
            centroids[number] = total // n  # floor, of negative sums too
    assigned = assign(df, id_col, vec_col, centroids, scale)
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("sum")).collect()
    of = {r["cluster"]: int(r["sum"]) for r in inertia}
    whole = sum(of.values())
    rows = [(c, min(s, FAR), min(whole, FAR), digest(centroids[c]), centroids[c].tolist()) for c, s in of.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    # k rows
    return assigned.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )
