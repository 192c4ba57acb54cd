"""Schemas of the streams and tables, and the threshold parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

# Status and label names carried by messages and tables.
NORMAL, WARNING, BAD, UNKNOWN, COLLAPSED = "NORMAL", "WARNING", "BAD", "UNKNOWN", "COLLAPSED"
CLASS_NAMES = [NORMAL, WARNING, BAD]
EVENT_STARTED, RE_ALERT, EVENT_ENDED = "EVENT_STARTED", "RE_ALERT", "EVENT_ENDED"
ACTIVE, ENDED = "ACTIVE", "ENDED"
UNKNOWN_SESSION = "unknown"

SUMMARY_EVENT = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()),
    T.StructField("sessionId", T.StringType()),
    T.StructField("userId", T.StringType()),
    T.StructField("capturedAt", T.TimestampType()),
    T.StructField("serverReceivedAt", T.TimestampType()),
    T.StructField("featureVector", T.ArrayType(T.DoubleType())),
    T.StructField("deviationScore", T.DoubleType()),
    T.StructField("ruleStatus", T.StringType()),
    T.StructField("sampleRateHz", T.DoubleType()),
])

# The message as it travels: instants stay text until their shape is checked, and vector elements
# stay text so that one bad element does not null the whole array.
SUMMARY_MESSAGE = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()),
    T.StructField("sessionId", T.StringType()),
    T.StructField("userId", T.StringType()),
    T.StructField("capturedAt", T.StringType()),
    T.StructField("serverReceivedAt", T.StringType()),
    T.StructField("featureVector", T.ArrayType(T.StringType())),
    T.StructField("deviationScore", T.DoubleType()),
    T.StructField("ruleStatus", T.StringType()),
    T.StructField("sampleRateHz", T.DoubleType()),
])

# What the episode rules read from an inference message; other fields are ignored.
INFERENCE_VIEW = T.StructType([
    T.StructField("sessionId", T.StringType()),
    T.StructField("userId", T.StringType()),
    T.StructField("inferredStatus", T.StringType()),
    T.StructField("capturedAt", T.StringType()),
])

SESSIONS_TABLE = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("last_seen_at", T.TimestampType()),
    T.StructField("sample_count", T.LongType()),
    T.StructField("status", T.StringType()),
])

EPISODES_TABLE = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("alert_count", T.IntegerType()),
    T.StructField("last_alert_at", T.TimestampType()),
    T.StructField("recovered", T.BooleanType()),
    T.StructField("ongoing", T.BooleanType()),
])


def to_ms(seconds: float) -> int:
    """Smallest whole number of milliseconds that is at least ``seconds``."""
    return math.ceil(round(seconds * 1000.0, 6))


@dataclass(frozen=True)
class EpisodeParams:
    """Thresholds of the episode rules, in seconds."""

    persist_seconds: float = 3.0
    recovery_seconds: float = 3.0
    realert_seconds: float = 60.0
    timeout_seconds: float = 300.0

    @property
    def persist_ms(self) -> int:
        return to_ms(self.persist_seconds)

    @property
    def recovery_ms(self) -> int:
        return to_ms(self.recovery_seconds)

    @property
    def realert_ms(self) -> int:
        return to_ms(self.realert_seconds)

    @property
    def timeout_ms(self) -> int:
        return to_ms(self.timeout_seconds)
