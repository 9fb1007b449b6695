"""Incremental runs of the batch operators with Structured Streaming.

Every query runs with ``availableNow``: it processes what has arrived, then stops, and its checkpoint remembers the
files already read, which is what chunked readers and "skip what exists" loops do by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _status(spark: SparkSession, path: str):
    """State of a path in whatever store holds it, None if there is nothing."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getFileStatus(place) if store.exists(place) else None


def table_files(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1000) -> DataFrame:
    """Stream of a table that is either one file or a folder of part files."""
    status = _status(spark, path)
    if status is None or status.isDirectory():
        return files(spark, path, schema, per_trigger=per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    return files(spark, folder, schema, name, per_trigger)


def files(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """Stream of the files of a folder; ``per_trigger`` bounds a batch, later batches take the rest."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(folder))


def _finish(query) -> None:
    query.awaitTermination()


def append_partitioned(stream: DataFrame, path: str, checkpoint: str, partitions: list[str]) -> None:
    """Exactly-once append to a partitioned table."""
    _finish(stream.writeStream.format("parquet").partitionBy(*partitions).option("checkpointLocation", checkpoint)
            .option("path", path).outputMode("append").trigger(availableNow=True).start())


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process only keys the output does not hold yet, one micro-batch at a time."""

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates([key])
        target = f"{path}/batch={batch_id}"
        done = _existing(batch.sparkSession, path, batch_id, key)
        if done is not None:
            fresh = fresh.join(done, key, "left_anti")
        # a repeated batch overwrites its own folder, so a retry after a failure adds nothing twice
        (work(fresh) if work else fresh).write.mode("overwrite").parquet(target)

    _finish(stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _existing(spark: SparkSession, path: str, batch_id: int, key: str) -> DataFrame | None:
    if batch_id == 0 or _status(spark, path) is None:
        return None
    return spark.read.parquet(path).filter(F.col("batch") < batch_id).select(key)


def running_state(stream: DataFrame, path: str, checkpoint: str, keys: list[str], value: str) -> None:
    """Accumulate (sum, count) per key over all micro-batches; each batch leaves the full state behind."""
    state = stream.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _finish(state.writeStream.foreachBatch(step).outputMode("complete").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    states = spark.read.parquet(path)
    last = states.agg(F.max("batch").alias("b")).select("b").scalar()
    return states.filter(F.col("batch") == last).drop("batch")
