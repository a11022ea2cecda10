"""Ordered per-key columns (row number, neighbours, running sums) that survive a hot key.

A plain window sends all rows of a key to one task. Here the key sizes are
counted first (a map-side combined aggregate). Keys within the limit use the
plain window; the rows of larger keys are range partitioned on (key, order), so
one key spreads over many tasks, each chunk is windowed alone, and one small
carry row per chunk links the chunks. Both ways give the same values.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.session import ensure_checkpoint_dir, shuffles_dropped

GROUP_LIMIT_CONF = "spark.folioworks.maxGroupRows"
DEFAULT_GROUP_LIMIT = 1_000_000
CHUNK = "_chunk"


def group_limit(df: DataFrame, limit: int | None) -> int:
    """Rows of one key that a single task may take."""
    if limit is not None:
        return limit
    return int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, str(DEFAULT_GROUP_LIMIT)))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    """Join condition on keys that treats nulls as equal; right keys carry a prefix."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in keys])


def split_hot(df: DataFrame, keys: list[str], limit: int):
    """(cold rows, hot rows, number of hot rows); hot is None when every key is small."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    with shuffles_dropped(df.sparkSession):
        hot_rows = sizes.agg(F.sum("_n")).first()[0]
    if hot_rows is None:
        return df, None, 0
    marks = sizes.select(*[F.col(k).alias("_h_" + k) for k in keys])
    cond = null_safe(df, marks, keys, "_h_")
    return df.join(marks, cond, "left_anti"), df.join(marks, cond, "left_semi"), hot_rows


def chunk_rows(df: DataFrame, keys: list[str], order: list[str], hot_rows: int, limit: int) -> DataFrame:
    """Add `_chunk`: an increasing number per ordered slice of each key.

    The sampled range bounds must be the same wherever the chunks are read
    again, so the result is checkpointed in the cluster's shared folder.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = max(2, math.ceil(2 * hot_rows / max(limit, 1)))
    ranged = df.repartitionByRange(n, *keys, *order)
    with shuffles_dropped(df.sparkSession):
        return ranged.withColumn(CHUNK, F.spark_partition_id()).checkpoint()


def ordered_columns(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    row_number: str | None = None,
    lags: dict[str, str] | None = None,
    leads: dict[str, str] | None = None,
    sums: dict[str, str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Add per-key columns over ascending `order`, which must be a total order in a key.

    lags and leads map an output column to an input column one row away; sums
    map an output column to the column whose inclusive running sum it holds.
    """
    lags, leads, sums = lags or {}, leads or {}, sums or {}
    limit = group_limit(df, limit)
    cold, hot, hot_rows = split_hot(df, keys, limit)
    plain = _windowed(cold, keys, order, row_number, lags, leads, sums)
    if hot is None:
        return plain
    chunks = chunk_rows(hot, keys, order, hot_rows, limit)
    return plain.unionByName(
        _stitched(chunks, keys, order, row_number, lags, leads, sums).select(*plain.columns)
    )


def _windowed(df, keys, order, row_number, lags, leads, sums):
    spec = Window.partitionBy(*keys).orderBy(*order)
    running = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {out: F.lag(src).over(spec) for out, src in lags.items()}
    new |= {out: F.lead(src).over(spec) for out, src in leads.items()}
    new |= {out: F.sum(src).over(running) for out, src in sums.items()}
    if row_number:
        new[row_number] = F.row_number().over(spec)
    return df.withColumns(new)


def _stitched(chunks, keys, order, row_number, lags, leads, sums):
    local = _windowed(chunks, [*keys, CHUNK], order, "_rn", lags, leads, sums)
    position = F.struct(*order)
    facts = [
        F.count(F.lit(1)).alias("_n"),
        F.max_by(F.struct(F.lit(1), *[F.col(s).alias(f"p_{o}") for o, s in lags.items()]), position).alias("_last"),
        F.min_by(F.struct(F.lit(1), *[F.col(s).alias(f"f_{o}") for o, s in leads.items()]), position).alias("_first"),
        *[F.sum(s).alias(f"_s_{o}") for o, s in sums.items()],
    ]
    per_chunk = chunks.groupBy(*keys, CHUNK).agg(*facts)
    spec = Window.partitionBy(*keys).orderBy(CHUNK)
    before = spec.rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *[F.col(k).alias("_c_" + k) for k in keys],
        F.col(CHUNK).alias("_c_" + CHUNK),
        F.col("_n").alias("_size"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.lag("_last").over(spec).alias("_prev"),
        F.lead("_first").over(spec).alias("_next"),
        *[F.sum(f"_s_{o}").over(before).alias(f"_b_{o}") for o in sums],
    )
    joined = local.join(carry, null_safe(local, carry, [*keys, CHUNK], "_c_"))
    fixed = {o: F.when(F.col("_rn") == 1, F.col(f"_prev.p_{o}")).otherwise(F.col(o)) for o in lags}
    fixed |= {
        o: F.when(F.col("_rn") == F.col("_size"), F.col(f"_next.f_{o}")).otherwise(F.col(o)) for o in leads
    }
    fixed |= {
        o: F.when(F.col(o).isNull(), F.col(f"_b_{o}")).otherwise(F.col(o) + F.coalesce(F.col(f"_b_{o}"), F.lit(0)))
        for o in sums
    }
    if row_number:
        fixed[row_number] = (F.col("_rn") + F.col("_base")).cast("int")
    return joined.withColumns(fixed)
