"""Landing stream: decoded summaries appended to Parquet by event date, and what does not decode to a place of its own."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.ingest import accepted_only, decode_events, undecodable, with_event_date


def summaries(decoded: DataFrame) -> DataFrame:
    events = accepted_only(decoded)
    return with_event_date(events.withColumn("featureVector", events["features"]).drop("features"))


def landed_rows(messages: DataFrame) -> DataFrame:
    """Decodable messages as summary events with their date."""
    return summaries(decode_events(messages))


def _trigger(every: str | None) -> dict:
    return {"availableNow": True} if every is None else {"processingTime": every}


def land(messages: DataFrame, path: str, checkpoint: str, *, every: str | None = "10 seconds"):
    """Start the landing query; with ``every`` None it takes what is there and stops."""
    writer = (landed_rows(messages).writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", checkpoint).partitionBy("eventDate").outputMode("append"))
    return writer.trigger(**_trigger(every)).start()


def land_batch(path: str, rejects: str):
    """``foreachBatch`` writer with two outputs. Each batch has a folder of its own in both, which a retry replaces, so every
    message is in exactly one of them once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_events(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            summaries(decoded).write.mode("overwrite").partitionBy("eventDate").parquet(f"{path}/batch={batch_id}")
            undecodable(decoded).select("value").write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            decoded.unpersist()
    return write


def land_all(messages: DataFrame, path: str, rejects: str, checkpoint: str, *, every: str | None = "10 seconds"):
    """Like ``land``, with the messages that do not decode written to ``rejects`` (value) as they came."""
    writer = messages.writeStream.foreachBatch(land_batch(path, rejects)).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(every)).start()


def landed(spark: SparkSession, path: str) -> DataFrame:
    """The summaries that ``land_all`` has written, of all batches, with ``batch``."""
    schema = landed_rows(spark.createDataFrame([], "value string")).schema
    return spark.read.schema(schema.add("batch", "long")).parquet(path)


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The messages that did not decode (value), of all batches, with ``batch``."""
    return spark.read.schema("value string, batch long").parquet(path)
