"""Capture files: typed columns, session and sample tables, and summary events from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import instants
from tidewatch.schemas import COLLAPSED, NORMAL

# The columns of a capture file: name, the table it belongs to (samples also have capture_id), type.
COLUMNS = (
    ("capture_id", "session", "text"), ("participant_code", "session", "text"), ("schema_version", "session", "text"),
    ("started_at", "session", "instant"), ("pose_model", "session", "text"), ("feature_version", "session", "text"),
    ("calibration_seconds", "session", "double"), ("target_sample_hz", "session", "double"), ("task_id", "session", "text"),
    ("activity", "session", "text"), ("requested_head_direction", "session", "text"), ("requested_posture", "session", "text"),
    ("requested_presence", "session", "text"), ("repetition", "session", "int"), ("planned_seconds", "session", "double"),
    ("camera_view", "session", "text"), ("camera_height", "session", "text"), ("distance_cm", "session", "double"),
    ("desk_layout", "session", "text"), ("stop_reason", "session", "text"), ("calibration_id", "session", "text"),
    ("width", "session", "int"), ("height", "session", "int"), ("delegate", "session", "text"),
    ("review_status", "session", "text"), ("pose_training_eligible", "session", "flag"), ("sample_index", "sample", "int"),
    ("elapsed_ms", "sample", "double"), ("video_time_ms", "sample", "double"), ("gap_ms", "sample", "double"),
    ("segment_id", "sample", "text"), ("manual_label", "sample", "text"), ("label_source", "sample", "text"),
    ("measurement_quality", "sample", "text"), ("head_gap", "sample", "double"), ("lateral_offset", "sample", "double"),
    ("shoulder_tilt", "sample", "double"), ("visibility", "sample", "double"), ("baseline_head_gap", "sample", "double"),
    ("baseline_offset", "sample", "double"), ("baseline_tilt", "sample", "double"), ("delta_head_gap", "sample", "double"),
    ("delta_offset", "sample", "double"), ("delta_tilt", "sample", "double"), ("rule_score", "sample", "double"),
    ("rule_prediction", "sample", "text"), ("threshold", "sample", "double"), ("hold_seconds", "sample", "double"),
    ("realert_seconds", "sample", "double"), ("recover_seconds", "sample", "double"), ("inference_ms", "sample", "double"),
    ("pose_detected", "sample", "flag"), ("landmark_count", "sample", "int"), ("landmarks_json", "sample", "text"),
    ("world_landmarks_json", "sample", "text"),
)
KINDS = {name: kind for name, _, kind in COLUMNS}
ALL_COLUMNS = list(KINDS)
SESSION_COLUMNS = [name for name, table, _ in COLUMNS if table == "session"]
SAMPLE_COLUMNS = ["capture_id", *(name for name, table, _ in COLUMNS if table == "sample")]
DEFAULT_HZ = 10.0


def typed(name: str) -> Column:
    """A text column as its declared type; empty text is null, whole numbers may be written 3.0."""
    raw = F.nullif(F.col(name), F.lit(""))
    read = {"flag": F.when(raw.isNotNull(), F.trim(raw) == "1"), "int": raw.try_cast("double").cast("int"), "double": raw.try_cast("double"),
            "instant": instants.parse_lenient(raw), "text": raw}
    return read[KINDS[name]].alias(name)


def type_rows(rows: DataFrame) -> DataFrame:
    """All declared columns typed; other columns of the file are dropped except ``seq``."""
    rest = [F.col("seq")] if "seq" in rows.columns else []
    return rows.select(*[typed(c) for c in ALL_COLUMNS], *rest)


def pilot_samples(rows: DataFrame) -> DataFrame:
    return rows.select(*[typed(c) for c in SAMPLE_COLUMNS])


def pilot_sessions(rows: DataFrame) -> DataFrame:
    """Per capture the session columns of its first row (by ``seq``) and its number of rows."""
    meta = [c for c in SESSION_COLUMNS if c != "capture_id"]
    first = rows.groupBy("capture_id").agg(
        F.min_by(F.struct(*meta), "seq").alias("m"), F.count(F.lit(1)).alias("sample_count"))
    x = first.select("capture_id", "m.*", "sample_count")
    return x.select(*[typed(c) for c in SESSION_COLUMNS], "sample_count")


def pilot_participants(rows: DataFrame) -> DataFrame:
    return rows.select("participant_code").distinct()


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` plus the rows whose key it does not have yet."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def replace_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of the same key replaced and new ones added (keys unique in each)."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def first_sessions(rows: DataFrame, n: int, session: str = "capture_id") -> DataFrame:
    """Rows of the first ``n`` sessions in file order."""
    first = rows.groupBy(session).agg(F.min("seq").alias("_first")).orderBy("_first").limit(n)
    return rows.join(first.select(session), session, "left_semi")


def pilot_to_summary(rows: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Capture rows as summary events.

    The capture time is the session start plus the elapsed milliseconds, kept to the millisecond as
    the message carries it. A missing prediction is normal, a missing score 0. Events count as received when they were
    captured, unless ``received_at`` says otherwise (the current time, for a replay).
    """
    started = instants.parse_lenient(F.col("started_at"))
    elapsed_us = F.bround(F.col("elapsed_ms").try_cast("double") * 1000).cast("long")
    at = F.timestamp_micros(F.unix_micros(started) + elapsed_us)
    score = F.coalesce(F.nullif("rule_score", F.lit("")).try_cast("double"), F.lit(0.0))
    rest = [F.col("seq")] if "seq" in rows.columns else []
    return rows.select(
        F.col("capture_id").alias("sessionId"), F.col("participant_code").alias("userId"),
        instants.from_millis(F.unix_millis(at)).alias("capturedAt"),
        (instants.from_millis(F.unix_millis(at)) if received_at is None else received_at).alias("serverReceivedAt"),
        F.array(*[F.col(c).try_cast("double") for c in ("delta_head_gap", "delta_offset", "delta_tilt")])
         .alias("featureVector"),
        F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6).alias("deviationScore"),
        F.when(F.col("rule_prediction") == "deviation", COLLAPSED).otherwise(NORMAL).alias("ruleStatus"),
        F.coalesce(F.nullif("target_sample_hz", F.lit("")).try_cast("double"), F.lit(DEFAULT_HZ)).alias("sampleRateHz"),
        *rest)
