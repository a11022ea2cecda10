"""Arrays to rows, computing the array once.

For a plain explode the optimizer adds a filter on the array's size below it,
which repeats a costly array expression. The outer form gets no such filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positions(df: DataFrame, keep: list, array: Column, pos: str, item: str) -> DataFrame:
    """The kept columns with a row per array element and its zero-based position."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())
