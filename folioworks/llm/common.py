"""What several of the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.session import ensure_checkpoint_dir, shuffles_dropped

#: A word of the contracts: a run of characters other than ASCII white space (Java and DuckDB regex).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder that all executors share and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own, begun here


def stored(df: DataFrame) -> DataFrame:
    """Like cut, as a Parquet table: wide rows are compressed there and later steps read single columns.

    Spark sizes it as its files, which can be a twentieth of its rows in memory, so its joins are merged.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return unsized(spark.read.schema(df.schema).parquet(path))


def unsized(df: DataFrame) -> DataFrame:
    """The rows, whose joins are merged: for rows that Spark takes for far fewer bytes than they are, as after an explode, and would broadcast."""
    return df.hint("merge")


#: Narrow rows that the driver holds and sends easily.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """Narrow rows, broadcast in joins if they are few. They are counted, as the size of files misleads."""
    return F.broadcast(df) if df.count() <= FEW else df


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until the frame has no such column (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_fold(df_id: str, parts: int):
    """crc32(id as text) mod parts, the contracts' train and held-out folds; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(df_id).cast("string").cast("binary")) % parts, F.lit(0))
