"""Session settings, shared scratch storage and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot keys even where the split costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Size estimates do not see how far a generator multiplies its rows, so planning may only broadcast very small
    # inputs; anything larger is broadcast on its measured size at run time, or shuffled.
    "spark.sql.autoBroadcastJoinThreshold": "2m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
}
# on one machine, small but compute-heavy stages (edge tests, patch arithmetic) should still use all cores
LOCAL = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}

#: Shuffle files go when the statement that wrote them ends, not when the driver's garbage happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Files that a task of a write in folders has open before it begins to sort; and whether a join deals rows out again that agree on some of its keys.
WRITERS, ALL_KEYS = "spark.sql.maxConcurrentOutputFileWriters", "spark.sql.requireAllClusterKeysForCoPartition"


def build(app: str = "fieldmark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive settings to a session somebody else built."""
    local = spark.sparkContext.master.startswith("local")
    for key, value in {**ADAPTIVE, **(LOCAL if local else {})}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for what is run meanwhile; those before come back."""
    usual = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in usual.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def widen(spark: SparkSession, tasks: int) -> None:
    """Let shuffles begin with ``tasks`` partitions at least; adaptive execution joins small ones and splits hot ones as before."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(usual, tasks)))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a temporary one in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to storage shared by all executors")
    folder = tempfile.mkdtemp(prefix="fieldmark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage", by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` to shared storage, in a folder for each value of ``by``, and read it back.

    Unlike cached blocks the files outlive lost executors, and their size is known, so later joins are
    planned on measured bytes. What was shuffled for them isn't read again, so it goes with the write.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    # a task keeps the files of a few folders open at once instead of sorting its rows by folder
    with settings(spark, {CLEANUP: "true"} | ({WRITERS: "8"} if by else {})):
        df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)
