"""Session and episode tables: roll-ups, upserts, expiry marks, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.schemas import ACTIVE, ENDED


def sessions_rollup(samples: DataFrame, order: bool = False) -> DataFrame:
    """Sessions table of a set of samples: first time and user, last-arrived time, sample count.

    First and last go by arrival (``seq``), not by event time. Samples without a session or without
    a time leave no trace. With ``order`` also first_seq and last_seq, by which roll-ups can be put together.
    """
    more = [F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")] if order else []
    return (samples.where(F.col("sessionId").isNotNull() & F.col("capturedAt").isNotNull())
            .groupBy(F.col("sessionId").alias("session_id"))
            .agg(F.min_by("userId", "seq").alias("user_id"),
                 F.min_by("capturedAt", "seq").alias("started_at"),
                 F.max_by("capturedAt", "seq").alias("last_seen_at"),
                 F.count(F.lit(1)).alias("sample_count"), *more)
            .withColumn("status", F.lit(ACTIVE)))


def upsert_sessions(table: DataFrame, samples: DataFrame) -> DataFrame:
    """The sessions table after a batch: new rows inserted; known rows get last-seen and count."""
    new = sessions_rollup(samples).alias("n")
    old = table.alias("o")
    def kept(c):
        return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
    known = F.col("o.session_id").isNotNull()
    return old.join(new, "session_id", "full_outer").select(
        "session_id",
        F.when(known, F.col("o.user_id")).otherwise(F.col("n.user_id")).alias("user_id"),
        kept("started_at"),
        F.coalesce("n.last_seen_at", "o.last_seen_at").alias("last_seen_at"),
        (F.coalesce("o.sample_count", F.lit(0).cast("long"))
         + F.coalesce("n.sample_count", F.lit(0).cast("long"))).alias("sample_count"),
        kept("status"))


def last_outcomes(outcomes: DataFrame) -> DataFrame:
    """The last outcome of each episode, as rows of the episodes table."""
    order = F.struct("alertCount", F.col("type") == "EVENT_ENDED")
    row = F.struct("endedAt", "durationSeconds", "alertCount", "lastAlertAt", "recovered", "ongoing")
    return (outcomes.groupBy("sessionId", "startedAt")
            .agg(F.max_by("userId", order).alias("user_id"), F.max_by(row, order).alias("r"))
            .select(F.col("sessionId").alias("session_id"), "user_id",
                    F.col("startedAt").alias("started_at"), F.col("r.endedAt").alias("ended_at"),
                    F.col("r.durationSeconds").alias("duration_seconds"),
                    F.col("r.alertCount").alias("alert_count"),
                    F.col("r.lastAlertAt").alias("last_alert_at"),
                    F.col("r.recovered").alias("recovered"), F.col("r.ongoing").alias("ongoing")))


def upsert_episodes(table: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The episodes table after a batch of outcomes: six columns overwritten, user kept."""
    keys = ["session_id", "started_at"]
    new, old = last_outcomes(outcomes).alias("n"), table.alias("o")
    fresh = F.col("n.alert_count").isNotNull()
    def newest(c):
        return F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    known = F.col("o.alert_count").isNotNull()
    return old.join(new, keys, "full_outer").select(
        "session_id", F.when(known, F.col("o.user_id")).otherwise(F.col("n.user_id")).alias("user_id"),
        "started_at", *[newest(c) for c in ("ended_at", "duration_seconds", "alert_count",
                                            "last_alert_at", "recovered", "ongoing")])


def expire_sessions(table: DataFrame, as_of: Column, timeout_seconds: float) -> DataFrame:
    """Mark ACTIVE sessions ENDED whose last sample is older than the timeout (strictly)."""
    limit = as_of - F.make_dt_interval(secs=F.lit(float(timeout_seconds)).cast("decimal(18,6)"))
    stale = (F.col("status") == ACTIVE) & (F.col("last_seen_at") < limit)
    return table.withColumn("status", F.when(stale, ENDED).otherwise(F.col("status")))


def expiry_report(before: DataFrame, after: DataFrame, closed: DataFrame) -> DataFrame:
    """Totals of one expiry run: episodes it closed and sessions it ended.

    ``closed`` is the output of ``session_expiry``; ``before`` and ``after`` the sessions table.
    """
    def active(table):
        return table.agg(F.count_if(F.col("status") == ACTIVE)).scalar()
    return closed.agg(F.count("episodeStartedAt").alias("finalisedEpisodes")).withColumn(
        "endedSessions", active(before) - active(after))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Keys of child rows without a parent row, and how many rows each has.

    Children are counted per key before the join, so a key with many rows costs no more than others.
    """
    counted = children.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return counted.join(parents.select(key).distinct(), key, "left_anti")
