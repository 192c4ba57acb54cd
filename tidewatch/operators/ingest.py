"""Ingest: decode messages, check them, normalise them, and shape keyed messages for a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import instants, vectors
from tidewatch.functions.labels import state_key
from tidewatch.schemas import COLLAPSED, INFERENCE_VIEW, NORMAL, SUMMARY_MESSAGE

# The schema version written to every event, and the answer to an accepted sample.
SCHEMA_VERSION = 1
ACCEPTED = "ACCEPTED"
BROKEN = "_broken"


def decode(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Message bytes or text to typed columns; ``decoded`` is false when the text is no JSON object.

    A field of the wrong type only nulls that field. Undecodable rows stay in the frame so that the
    caller can count or divert them.
    """
    text = F.col("value").cast("string")
    whole = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    parsed = messages.withColumn("_text", text).withColumn("_m", F.from_json("_text", whole, {"columnNameOfCorruptRecord": BROKEN, "allowNonNumericNumbers": "false"}))
    # One parse; only texts that it could not read in full are looked at again.
    decoded = F.when(F.col(f"_m.{BROKEN}").isNotNull() | ~F.startswith(F.ltrim("_text"), F.lit("{")), F.json_object_keys("_text").isNotNull()).otherwise(F.col("_m").isNotNull())
    rest = [c for c in messages.columns if c != "value"]
    return parsed.select(*rest, F.col("_text").alias("value"), F.coalesce(decoded, F.lit(False)).alias("decoded"), *(F.col(f"_m.{f.name}") for f in schema.fields))


def decode_events(messages: DataFrame) -> DataFrame:
    """Summary messages with parsed instants; ``features`` is null when an element is no number."""
    return decode(messages, SUMMARY_MESSAGE).withColumns({
        "capturedAt": instants.parse_instant(F.col("capturedAt")),
        "serverReceivedAt": instants.parse_instant(F.col("serverReceivedAt")),
        "features": vectors.to_doubles(F.col("featureVector"))})


def accepted_only(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("decoded")).drop("decoded", "value")


def undecodable(decoded: DataFrame) -> DataFrame:
    return decoded.where(~F.col("decoded"))


def inference_view(messages: DataFrame) -> DataFrame:
    """The four text fields the episode rules need from an open-ended message."""
    return decode(messages, INFERENCE_VIEW)


def with_instants(df: DataFrame, column: str = "capturedAt") -> DataFrame:
    """Parse a text column to instants and drop the rows whose time does not parse."""
    return df.withColumn(column, instants.parse_instant(F.col(column))).where(F.col(column).isNotNull())


def with_event_date(df: DataFrame) -> DataFrame:
    return df.withColumn("eventDate", F.to_date("capturedAt"))


def normalise_summary(requests: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Accepted requests as summary events: version 1, capture time defaulting to receive time."""
    received = F.current_timestamp() if received_at is None else received_at
    return (requests.withColumn("serverReceivedAt", received)
                    .withColumn("schemaVersion", F.lit(SCHEMA_VERSION))
                    .withColumn("capturedAt", F.coalesce("capturedAt", "serverReceivedAt")))


def _blank(name: str) -> Column:
    return F.col(name).isNull() | ~F.col(name).rlike(r"\S")


def field_errors() -> Column:
    """Map of field to message for every violated ingest rule; empty for a valid request."""
    score, status = F.col("deviationScore"), F.col("ruleStatus")
    rules = [
        ("sessionId", F.when(_blank("sessionId"), "must not be blank")),
        ("userId", F.when(_blank("userId"), "must not be blank")),
        ("featureVector", F.when(F.col("featureVector").isNull() | (F.size("featureVector") == 0),
                                 "must not be empty")),
        ("deviationScore", F.when(score.isNull(), "must not be null")
                            .when(F.isnan(score) | (score < 0) | (score > 1), "must be between 0 and 1")),
        ("ruleStatus", F.when(_blank("ruleStatus"), "must not be blank")
                        .when(~status.isin(NORMAL, COLLAPSED), "must be NORMAL or COLLAPSED")),
    ]
    entries = F.array(*[F.struct(F.lit(name).alias("key"), message.alias("value"))
                        for name, message in rules])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def validate_summary(requests: DataFrame) -> DataFrame:
    """Requests with their ``errors`` map and whether they are ``accepted``."""
    return (requests.withColumn("errors", field_errors())
                    .withColumn("accepted", F.size("errors") == 0))


def validation_errors(requests: DataFrame) -> DataFrame:
    """One row per violated rule of a rejected request."""
    rest = [c for c in requests.columns if c in ("seq", "sessionId")]
    return validate_summary(requests).select(*rest, F.explode("errors").alias("field", "message"))


def summary_messages(events: DataFrame, topic: str = "summary") -> DataFrame:
    """Accepted summary events keyed by session, with the answer each sender gets."""
    body = F.to_json(F.struct(
        "schemaVersion", "sessionId", "userId",
        instants.iso_millis(F.col("capturedAt")).alias("capturedAt"),
        instants.iso_millis(F.col("serverReceivedAt")).alias("serverReceivedAt"),
        "featureVector", "deviationScore", "ruleStatus", "sampleRateHz"), {"ignoreNullFields": "false"})
    return events.select(
        F.col("sessionId").alias("key"), body.alias("value"), F.lit(ACCEPTED).alias("status"),
        F.lit(topic).alias("topic"), F.unix_millis("serverReceivedAt").alias("receivedAtMillis"))


def inference_messages(scored: DataFrame) -> DataFrame:
    """Scored samples keyed by user, or by session where the user is missing or blank."""
    plain = [c for c in ("sessionId", "userId", "receivedRuleStatus", "inferredStatus", "probabilities",
                         "deviationScore", "model", "windowBuffered", "windowSize") if c in scored.columns]
    times = [instants.iso_millis(F.col(c)).alias(c) for c in ("capturedAt", "serverReceivedAt")
             if c in scored.columns]
    return scored.select(
        state_key(F.col("userId"), F.col("sessionId")).alias("key"),
        F.to_json(F.struct(*plain, *times), {"ignoreNullFields": "false"}).alias("value"))
