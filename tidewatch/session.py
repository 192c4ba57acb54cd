"""A Spark session with the settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    STATE_STORE: ROCKSDB,
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(name: str, cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the bench; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Only a local session may lack it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):    # not local-cluster
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidewatch-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder once and read it from there."""
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; it also keeps large state off the heap."""
    spark.conf.set(STATE_STORE, ROCKSDB)
