"""Embedding near-dedup by NN-descent.

Vectors of one group (label and dimension) are linked when their cosine, in
double precision, reaches a threshold. Every vector keeps a list of its nearest
found neighbours:

1. random-projection trees cut each group into leaves; inside a leaf all pairs
   are compared and give the first lists. A leaf over `leaf_max` vectors is dealt
   into parts at random;
2. rounds of NN-descent join each vector's neighbours and reverse neighbours with
   each other (neighbours of neighbours) and keep what comes closer, until few
   lists change. A list that is full of links is saturated and doubles, up to
   `k_max`;
3. list entries that reach the threshold are edges; components of the edges are
   verified exactly: inside a component, cut into blocks, all links are counted;
4. an audit compares a bounded, hashed sample of vectors with all vectors of
   their groups. Below the wanted recall another set of trees and more rounds follow.

Equal vectors are one class from the start, with a multiplicity, so copies cost
nothing and are never expanded into pairs. Lists, leaves and blocks are bounded,
and no step gathers a group. Counting links is quadratic in the size of one
component only, spread over block pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and those with a null label, link with nothing. Rows that repeat an
id are vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.common import cut
from folioworks.llm.components import components

BROADCAST_ROWS = 100_000
NEIGHBOURS = "array<struct<sim: double, id: bigint>>"


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Unit vectors, one per row, in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _groups(batches, column: int):
    """(row number, struct array) for each row of a list<struct> column, batch by batch."""
    for batch in batches:
        lists = batch.column(column)
        for row in range(len(lists)):
            yield batch, row, lists[row].values


def classes(rows: DataFrame) -> DataFrame:
    """(h1, h2, grp, id, rep, n, vec): one row per different valid vector of a group; rep is its smallest row id."""
    keyed = rows.where("grp is not null").groupBy("h1", "h2", "grp")
    found = keyed.agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    return found.withColumn("id", F.xxhash64("h1", "h2", "grp"))


def prepare(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, grp, h1, h2, vec): grp, a hash of label and dimension, is null for what links with nothing."""
    vec = F.col(vec_col)
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    grp = F.when(F.coalesce(fine, F.lit(False)) & F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col), F.size(vec)))
    return df.select(F.col(id_col).cast("long").alias("id"), grp.alias("grp"), F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(7), vec).alias("h2"), vec.alias("vec"))


def _leaves(vectors: DataFrame, trees: int, leaf: int, leaf_max: int, seed: int) -> DataFrame:
    """(members): lists of up to leaf_max or so (u, vec) of one group that fall on the same sides of random planes."""
    sizes = cut(vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("grp", "_g"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    depth = F.greatest(F.ceil(F.log2(F.col("size") / leaf)), F.lit(0)).cast("int")
    deep = vectors.join(sizes, F.col("grp") == F.col("_g")).select("id", "grp", "vec", depth.alias("depth"))

    def sides(batches):
        planes: dict = {}
        for batch in batches:
            ids, grp, vecs, depths = (batch.column(i) for i in range(4))
            out = []
            for row in range(batch.num_rows):
                x, d = np.array(vecs[row].as_py(), dtype=np.float64), depths[row].as_py()
                key = (len(x), d)
                if key not in planes:
                    planes[key] = np.random.default_rng([seed, *key]).standard_normal((trees, d, len(x)))
                bits = (planes[key] @ x) > 0
                out.append([int(b) for b in bits @ (1 << np.arange(d, dtype=np.int64))] if d else [0] * trees)
            yield pa.RecordBatch.from_arrays([ids, grp, pa.array(out, pa.list_(pa.int64()))], ["id", "grp", "codes"])

    codes = deep.mapInArrow(sides, "id long, grp long, codes array<long>")
    placed = cut(codes.select("id", "grp", F.posexplode("codes").alias("tree", "code")))
    key = ["grp", "tree", "code"]
    full = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_max)
    placed = placed.join(full, key, "left")
    part = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.ceil(F.col("n") / leaf)))
    placed = placed.select("id", *key, part.cast("long").alias("part"))
    met = placed.join(vectors.select("id", "vec"), "id")
    return met.groupBy(*key, "part").agg(F.collect_list(F.struct(F.col("id").alias("u"), "vec", F.lit(-2.0).alias("floor"))).alias("members"))


def _compare(lists: DataFrame, k: int, k_max: int) -> DataFrame:
    """(id, found): for each member of a list its closest fellow members that beat its floor, k_max at most."""

    def run(batches):
        ids, found = [], []

        def flush():
            nonlocal ids, found
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.struct([("sim", pa.float64()), ("id", pa.int64())])))], ["id", "found"]
            )
            ids, found = [], []

        for _, _, members in _groups(batches, 0):
            u, floor = members.field("u").to_numpy(), members.field("floor").to_numpy()
            if len(u) < 2:
                continue
            x = _matrix(members.field("vec"))
            sims = x @ x.T
            np.fill_diagonal(sims, -3.0)
            take = min(k_max if len(u) <= 4 * k_max else k, len(u) - 1)
            best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
            close = np.take_along_axis(sims, best, axis=1)
            for i in range(len(u)):
                good = [{"sim": float(s), "id": int(u[j])} for s, j in zip(close[i], best[i], strict=True) if s > floor[i]]
                if good:
                    ids.append(int(u[i]))
                    found.append(good)
            if len(ids) >= 4096:
                yield from flush()
        yield from flush()

    return lists.select("members").mapInArrow(run, f"id long, found {NEIGHBOURS}")


def _merge(graph: DataFrame | None, found: DataFrame, vectors: DataFrame, k: int, k_max: int, threshold: float) -> DataFrame:
    """(id, k, near, changed): the k closest of the old and the found neighbours; a list full of links doubles its k."""
    new = found.select("id", F.lit(k).alias("k"), F.col("found").alias("near"), F.lit(False).alias("old"))
    if graph is None:
        rows = new.unionByName(vectors.select("id", F.lit(k).alias("k"), F.array().cast(NEIGHBOURS).alias("near"), F.lit(True).alias("old")))
    else:
        rows = new.unionByName(graph.select("id", "k", "near", F.lit(True).alias("old")))
    merged = rows.groupBy("id").agg(
        F.max("k").alias("k"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("near"))), asc=False).alias("all"),
        F.max(F.when(F.col("old"), F.col("near"))).alias("before"),
    )
    merged = merged.withColumn("near", F.slice("all", F.lit(1), F.col("k")))
    saturated = (F.size("near") == F.col("k")) & (F.get("near", F.col("k") - 1)["sim"] >= threshold)
    return merged.select(
        "id", F.when(saturated, F.least(F.col("k") * 2, F.lit(k_max))).otherwise(F.col("k")).alias("k"), "near", (F.col("near") != F.col("before")).alias("changed")
    )


def _round(graph: DataFrame, vectors: DataFrame, k: int, k_max: int, seed: int) -> DataFrame:
    """Candidates (id, found) of one neighbours-of-neighbours join."""
    ahead = graph.select(F.col("id").alias("p"), F.explode("near.id").alias("u"))
    order = Window.partitionBy("p").orderBy(F.xxhash64("u", F.lit(seed)), "u")
    # a vector in very many lists keeps a hashed choice of those; the limit applies before the shuffle
    back = ahead.select(F.col("u").alias("p"), F.col("p").alias("u")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")
    members = ahead.unionByName(back).unionByName(graph.select(F.col("id").alias("p"), F.col("id").alias("u"))).distinct()
    full = F.size("near") >= F.col("k")
    floor = graph.select(F.col("id").alias("u"), F.when(full, F.get("near", F.col("k") - 1)["sim"]).otherwise(F.lit(-2.0)).alias("floor"))
    known = vectors.select(F.col("id").alias("u"), "vec").join(floor, "u")
    met = members.join(known, "u").groupBy("p").agg(F.collect_list(F.struct("u", "vec", "floor")).alias("members"))
    return _compare(met, k, k_max)


def neighbours(
    vectors: DataFrame,
    *,
    threshold: float,
    graph: DataFrame | None = None,
    k: int = 8,
    k_max: int = 64,
    trees: int = 4,
    leaf: int = 256,
    leaf_max: int = 512,
    rounds: int = 6,
    settled: float = 0.01,
    seed: int = 42,
) -> DataFrame:
    """(id, k, near): the neighbour graph of (id, grp, vec), from new trees and an older graph if given."""
    first = _compare(_leaves(vectors, trees, leaf, leaf_max, seed), k, k_max)
    graph = cut(_merge(graph, first, vectors, k, k_max, threshold))
    n = graph.count()
    for i in range(rounds):
        graph = cut(_merge(graph, _round(graph, vectors, k, k_max, seed + i), vectors, k, k_max, threshold))
        if graph.where("changed").count() <= settled * n:
            break
    return graph.drop("changed")


def audit(vectors: DataFrame, component: DataFrame, threshold: float, sample: int = 256, seed: int = 42) -> tuple[int, int]:
    """(links, found) of a hashed sample of vectors against all vectors of their groups, in one pass over the vectors.

    A link counts as found when both ends are in one component, where all links are counted.
    """
    asked = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)  # bounded, whatever the input
    asked = asked.join(component, "id", "left").select("id", "grp", "vec", F.coalesce("component", "id").alias("component")).collect()
    if not asked:
        return 0, 0
    by_group: dict = {}
    for r in asked:
        x = np.array(r["vec"], dtype=np.float64)
        by_group.setdefault(r["grp"], []).append((r["id"], r["component"], x / np.sqrt((x * x).sum())))

    def run(batches):
        for batch in batches:
            grp = batch.column(1).to_numpy()
            links = found = 0
            for g, queries in by_group.items():
                at = np.flatnonzero(grp == g)
                if len(at):
                    take = pa.array(at)
                    x = _matrix(batch.column(2).take(take))
                    ids, comp = batch.column(0).take(take).to_numpy(), batch.column(3).take(take).to_numpy()
                    hit = x @ np.array([q[2] for q in queries]).T >= threshold
                    hit &= ids[:, None] != np.array([q[0] for q in queries])[None, :]
                    links += int(hit.sum())
                    found += int((hit & (comp[:, None] == np.array([q[1] for q in queries])[None, :])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([found])], ["links", "found"])

    rows = vectors.join(component, "id", "left").select("id", "grp", "vec", F.coalesce("component", "id").alias("component"))
    total = rows.mapInArrow(run, "links long, found long").agg(F.sum("links"), F.sum("found")).first()
    return total[0] or 0, total[1] or 0


def _count_links(linked: DataFrame, threshold: float, block: int) -> DataFrame:
    """(id, links): exact number of linked vectors, copies included, for (id, component, n, vec) of components.

    Components are cut into blocks of some `block` vectors by hash; every pair of blocks is compared in one row.
    """
    sizes = linked.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = linked.join(sizes, "component").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.select("component", "id", "n", "vec", "b", other.alias("o"))
    rows = rows.select("component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.struct("id", "n", "b", "vec").alias("m"))
    met = rows.groupBy("component", "i", "j").agg(F.collect_list("m").alias("members"))

    def run(batches):
        for batch, row, members in _groups(batches, 2):
            i, j = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            ids, n, b = (members.field(c).to_numpy() for c in ("id", "n", "b"))
            hit = (_matrix(members.field("vec")) @ _matrix(members.field("vec")).T >= threshold).astype(np.int64)
            np.fill_diagonal(hit, 0)
            if i != j:  # pairs inside a block are counted where both blocks are that one
                hit *= b[:, None] != b[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit @ n)], ["id", "links"])

    return met.select("i", "j", "members").mapInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    *,
    threshold: float = 0.98,
    recall: float = 0.98,
    attempts: int = 4,
    block: int = 1024,
    seed: int = 42,
    **options,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    n_links counts the other vectors linked directly, copies included; component_id is the smallest id reachable;
    kept marks the row whose id that is.
    """
    rows = cut(prepare(df, id_col, vec_col, label_col))
    found = cut(classes(rows))
    vectors = found.select("id", "grp", "vec")
    graph = None
    for attempt in range(attempts):
        graph = neighbours(vectors, threshold=threshold, graph=graph, seed=seed + 1000 * attempt, **options)
        edges = graph.select(F.col("id").alias("a"), F.explode("near").alias("e")).where(F.col("e.sim") >= threshold).select("a", F.col("e.id").alias("b"))
        component = components(edges).withColumnRenamed("node", "id")
        links, caught = audit(vectors, component, threshold, seed=seed + attempt)
        if caught >= recall * links:
            break
    linked = found.join(component, "id").select("id", "component", "n", "vec")
    counted = _count_links(linked, threshold, block)
    of = found.join(component, "id", "left").join(counted, "id", "left").withColumn("root", F.coalesce("component", "id"))
    smallest = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = of.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1).join(smallest, "root")
    of = of.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("grp").alias("_grp"), "n_links", "component_id")
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("grp") == F.col("_grp"))
    out = rows.drop("vec").join(of, same, "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"),
    )
