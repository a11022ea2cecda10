"""Run a streaming query to the end of its input and read what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.session import ensure_checkpoint_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/folioworks-streams/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, pattern: str) -> DataFrame:
    """A stream over the parquet files of a pattern."""
    schema = spark.read.parquet(pattern).schema
    return spark.readStream.schema(schema).format("parquet").load(pattern)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and map states need, for the queries started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def micro_batches(rows: DataFrame, number: Column, count: int, name: str) -> DataFrame:
    """A stream that delivers rows in micro-batches by their number from 0, each from one folder of files."""
    spark = rows.sparkSession
    folder = work_dir(spark, name)
    for i in range(count):
        rows.where(number == i).repartition(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run_appends(stream: DataFrame, name: str) -> DataFrame:
    """All rows an append-mode query emits for the input available now."""
    spark = stream.sparkSession
    base = work_dir(spark, name)
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    writer.option("checkpointLocation", f"{base}/checkpoint").start(f"{base}/out").awaitTermination()
    return spark.read.schema(T.StructType(stream.schema.fields)).parquet(f"{base}/out")


def run_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The last row an update-mode query emits per key for the input available now.

    A repeated batch overwrites its own folder, so a restart adds nothing twice.
    """
    spark = stream.sparkSession
    base = work_dir(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").trigger(availableNow=True).foreachBatch(save)
    writer.option("checkpointLocation", f"{base}/checkpoint").start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")
