"""Connected components of a distributed edge list.

Every vertex starts as its own label. A round points each label at the smallest
one beside it, follows the pointers to their ends by doubling and renames the
edges; edges inside one component drop out. Only labels smaller than all beside
them survive a round, at most half of those that have an edge, so rounds are
logarithmic, and so are the doublings. All steps are joins and combined
aggregates on narrow rows: nothing is gathered per component, and the driver
sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Edges are undirected; repeated edges, loops and an empty list are fine, edges with a null end are ignored.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not e.isEmpty():
        # each root points at the smallest root beside it; pointers only go down, so there is no cycle
        hook = (
            e.select(F.explode(F.array(F.struct(F.col("b").alias("root"), F.col("a").alias("to")),
                                       F.struct(F.col("a").alias("root"), F.col("a").alias("to")))).alias("_"))
            .select("_.*").groupBy("root").agg(F.min("to").alias("to"))
        )
        hook = _ends(hook)
        labels = _follow(labels, "component", hook)
        e = _follow(_follow(e, "a", hook), "b", hook)
        e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
        labels = cut(labels)
    return labels


def _follow(df: DataFrame, column: str, hook: DataFrame) -> DataFrame:
    other = hook.select(F.col("root").alias("_root"), F.col("to").alias("_to"))
    found = df.join(other, df[column] == other["_root"], "left")
    return found.withColumn(column, F.coalesce("_to", column)).drop("_root", "_to")


def _ends(hook: DataFrame) -> DataFrame:
    """Pointers followed to their ends."""
    while True:
        hook = cut(_follow(hook.withColumn("was", F.col("to")), "to", hook))
        if hook.where("to != was").isEmpty():
            return hook.drop("was")
