"""The given tables in the shapes the operators take."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import instants
from tidewatch.operators.pilot import ALL_COLUMNS
from tidewatch.operators.scoring import SequenceModel, label_by_rule
from tidewatch.schemas import EpisodeParams

HOUR, DAY = 3600.0, 86400.0

# Users of the table are sampled hours apart, so the thresholds are hours instead of seconds.
PARAMS = EpisodeParams(6 * HOUR, 6 * HOUR, 12 * HOUR, 2 * DAY)
MID = "2024-01-16 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the tables store them."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema])


def event_rows(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    at = F.col("ts").cast("timestamp")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("sessionId"),
        F.col("user_id").cast("string").alias("userId"),
        at.alias("capturedAt"), (at + F.expr("interval 1 second")).alias("serverReceivedAt"),
        F.col("event_id").alias("seq"),
        F.array(F.col("value") / 100, k / 100, (F.col("event_id") % 7) / 10).alias("featureVector"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("deviationScore"),
        F.when(F.col("event_type") == "error", "COLLAPSED").otherwise("NORMAL").alias("ruleStatus"),
        F.lit(10.0).alias("sampleRateHz"), "event_type", "value", "user_id", k.alias("k"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(table(spark, sf_dir, "events"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_by_rule(samples(spark, sf_dir))


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def messages(rows: DataFrame) -> DataFrame:
    """Samples as message text: signups cut short, a bad vector element in views, text scores in errors."""
    vector = F.transform("featureVector", lambda x: x.cast("string"))
    vector = F.when(F.col("event_type") == "view", F.array(F.lit("0.5"), F.lit("n/a"))).otherwise(vector)
    fields = [F.lit(1).alias("schemaVersion"), "sessionId", "userId",
              iso_micros(F.col("capturedAt")).alias("capturedAt"),
              iso_micros(F.col("serverReceivedAt")).alias("serverReceivedAt"),
              vector.alias("featureVector")]
    rest = ["ruleStatus", "sampleRateHz"]
    number = F.to_json(F.struct(*fields, "deviationScore", *rest))
    text = F.to_json(F.struct(*fields, F.col("deviationScore").cast("string").alias("deviationScore"), *rest))
    body = F.when(F.col("event_type") == "error", text).otherwise(number)
    cut = F.substring(body, F.lit(1), F.length(body) - 7)
    body = F.when(F.col("event_type") == "signup", cut).otherwise(body)
    return rows.select("seq", body.cast("binary").alias("value"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with one rule broken per event type, for some values."""
    x = samples(spark, sf_dir)
    kind = F.col("event_type")
    return x.withColumns({
        "sessionId": F.when((kind == "view") & (F.col("value") < 50), "  ").otherwise(F.col("sessionId")),
        "userId": F.when((kind == "view") & (F.col("value") < 10), F.lit(None)).otherwise(F.col("userId")),
        "featureVector": F.when((kind == "purchase") & (F.col("value") < 20), F.array().cast("array<double>"))
                          .otherwise(F.col("featureVector")),
        "deviationScore": F.when(kind == "signup", F.col("value") / 100)
                           .when((kind == "click") & (F.col("value") < 5), F.lit(None)).otherwise(F.col("deviationScore")),
        "ruleStatus": F.when((kind == "error") & (F.col("value") > 30), "UNKNOWN").otherwise(F.col("ruleStatus"))})


def mixed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose vectors are text, not numeric for signups and empty for some views."""
    text = F.transform("featureVector", lambda x: x.cast("string"))
    return samples(spark, sf_dir).withColumn(
        "featureVector", F.when(F.col("event_type") == "signup", F.array(F.lit("x")))
        .when((F.col("event_type") == "view") & (F.col("value") < 20), F.array().cast("array<string>")).otherwise(text))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a capture file: all text, with ``seq``."""
    x = samples(spark, sf_dir)
    start = F.lit("2024-01-01T00:00:00.000Z")
    start_ms = F.unix_millis(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    def text(c):
        return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    kind = F.col("event_type")
    given = {
        "capture_id": F.col("sessionId"),
        "participant_code": F.concat(F.lit("P"), F.col("user_id") % 20),
        "schema_version": F.lit("2"), "started_at": start, "activity": kind,
        "target_sample_hz": F.when(kind != "view", "12.5").otherwise(""),
        "planned_seconds": F.lit("60"), "repetition": text(F.col("user_id") % 3 + 1),
        "width": F.lit("640.0"), "height": F.lit("480"),
        "pose_training_eligible": F.when(F.col("user_id") % 2 == 0, "1").otherwise("0"),
        "sample_index": text("seq"), "elapsed_ms": text(F.unix_millis("capturedAt") - start_ms),
        "gap_ms": F.lit("100.0"), "segment_id": F.concat(F.lit("s"), F.date_format("capturedAt", "d")),
        "manual_label": F.when(F.col("value") >= 50, "BAD").when(F.col("value") >= 5, "NORMAL").otherwise(""),
        "measurement_quality": F.lit("ok, \"good\""), "head_gap": text("value"),
        "lateral_offset": text("k"), "shoulder_tilt": F.when(F.col("value") < 90, text(F.col("value") / 2)).otherwise(""),
        "delta_head_gap": text(F.col("value") / 100), "delta_offset": text(F.col("k") / 100),
        "delta_tilt": text((F.col("seq") % 7) / 10),
        "rule_score": F.when(kind != "signup", text(F.col("value") / 80)).otherwise(""),
        "rule_prediction": F.when(F.col("value") >= 40, "deviation").otherwise("normal"),
        "pose_detected": F.when(kind == "click", " 1 ").when(kind == "view", "").otherwise("0"),
        "landmark_count": F.lit("33"),
        "landmarks_json": F.concat(F.lit('{"k": '), F.col("k").cast("int"), F.lit(', "t": "a,b"}'))}
    return x.select(*[given.get(c, F.lit("")).alias(c) for c in ALL_COLUMNS], "seq")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a consumer-lag listing, all text but the sampling hour."""
    x = samples(spark, sf_dir)
    idle = F.col("value") < 10
    return x.select(
        F.date_trunc("hour", "capturedAt").alias("sampledAt"),
        F.concat(F.lit("stream."), F.col("event_type")).alias("topic"),
        F.when(idle, "-").otherwise(F.floor("value").cast("string")).alias("lag"),
        F.floor("k").cast("string").alias("consumed"),
        F.when(F.col("user_id") % 4 == 0, "-").otherwise(F.concat(F.lit("m"), F.col("user_id"))).alias("member"))


def instant_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One way of writing the time per event type; only some are full instants."""
    x = samples(spark, sf_dir)
    at, kind = F.col("capturedAt"), F.col("event_type")
    local = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    nine = F.concat(local, F.lit("."), F.date_format(at, "SSSSSS"), F.lit("987Z"))
    return x.select("seq", F.when(kind == "click", nine).when(kind == "purchase", F.concat(local, F.lit("+09:00")))
                    .when(kind == "view", F.date_format(at, "yyyy-MM-dd")).when(kind == "signup", local)
                    .otherwise("not-a-timestamp").alias("capturedAt"))


def split_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a session per user and event type, so a user has several sessions."""
    return samples(spark, sf_dir).withColumn("sessionId", F.concat_ws("-", "sessionId", "event_type"))


def fixed_model(hidden: int = 16, seed: int = 7) -> SequenceModel:
    """Small repeatable weights; trained ones come from a file."""
    r = np.random.default_rng(seed)
    return SequenceModel("fixed-lstm", r.normal(size=(4 * hidden, 3)), r.normal(size=(4 * hidden, hidden)) / 4, r.normal(size=4 * hidden) / 4, r.normal(size=(3, hidden)), np.zeros(3))
