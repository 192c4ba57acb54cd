"""Topics and message files as streams, and keyed messages back to a topic."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Messages and files that one micro-batch takes by default, so that a backlog is worked off in pieces.
MAX_OFFSETS, MAX_FILES = 1_000_000, 1000


def topic_options(servers: str, topic: str, *, starting: str = "earliest",
                  max_offsets: int | None = MAX_OFFSETS) -> dict[str, str]:
    """Options of a topic subscription; offsets live in the checkpoint, not in a consumer group."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting,
               "failOnDataLoss": "false"}
    if max_offsets is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_topic(spark: SparkSession, servers: str, topic: str, **kwargs) -> DataFrame:
    return spark.readStream.format("kafka").options(**topic_options(servers, topic, **kwargs)).load()


def in_arrival_order(messages: DataFrame) -> DataFrame:
    """Messages of a topic (value, partition, offset) with ``seq``, the order in which they arrived.

    Messages of one key are in one partition, so this is their order for every session.
    """
    return messages.select("value", F.struct("partition", "offset").alias("seq"))


def read_message_files(spark: SparkSession, path: str, files_per_trigger: int | None = MAX_FILES) -> DataFrame:
    """Text files with one message per line, as a stream with the ``value`` column of a topic."""
    reader = spark.readStream.format("text")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def in_file_order(lines: DataFrame) -> DataFrame:
    """Lines of ``read_message_files`` with ``seq``: when their file was written, the file, and the place in it.

    A task reads one block of a file after the other; a line's place is the block's first byte plus the lines before it in
    the block, of which each has a byte at least.
    """
    rows = lines.select("value", F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("place"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, line = None, 0
        for batch in batches:
            places = []
            for here in zip(batch.column("file").to_pylist(), batch.column("place").to_pylist(), strict=True):
                line = line + 1 if here == block else 0
                block = here
                places.append(here[1] + line)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.int64())], batch.schema.names)

    return rows.mapInArrow(number, rows.schema).select("value", F.struct("written", "file", "place").alias("seq"))


def publish(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """Write ``key`` and ``value`` to a topic; returns the writer, to be started by the caller."""
    return (messages.select("key", "value").writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).outputMode("append"))
