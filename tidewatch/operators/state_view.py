"""The judgment state of a session over time: changes, snapshots, text form, restore, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import instants
from tidewatch.functions.labels import state_key
from tidewatch.operators import alerts
from tidewatch.operators import episodes as ep
from tidewatch.plans.ordered import PART, ROWS_PER_PART
from tidewatch.schemas import BAD, NORMAL, EpisodeParams

SUSPECT, RECOVERING = "SUSPECT", "RECOVERING"

STATE_FIELDS = ["sessionId", "userId", "candidateSince", "recoverySince", "episodeStartedAt",
                "lastAlertAt", "alertCount", "lastSeen"]


def state_name() -> Column:
    return (F.when(F.col("episodeStartedAt").isNotNull(),
                   F.when(F.col("recoverySince").isNotNull(), RECOVERING).otherwise(BAD))
             .when(F.col("candidateSince").isNotNull(), SUSPECT).otherwise(NORMAL))


def with_state(df: DataFrame) -> DataFrame:
    """Add the derived state name and the moment it began."""
    df = df.withColumn("state", state_name())
    return df.withColumn("since", F.when(F.col("state") == SUSPECT, F.col("candidateSince"))
                         .when(F.col("state") == BAD, F.col("episodeStartedAt"))
                         .when(F.col("state") == RECOVERING, F.col("recoverySince")))


def _moments(samples: DataFrame, params: EpisodeParams, rows_per_part: int) -> DataFrame:
    """The state after each moment that can change it: run starts, confirmations, re-alerts.

    ``changed`` tells whether the state really changed there. Part starts of cut runs are moments
    too; they never count as changes.
    """
    pieces = ep.run_pieces(samples, params, rows_per_part)
    part = [PART] if pieces.split.hot else []
    episode_type = pieces.df.schema["episode"].dataType
    before = F.when(~F.col("segment_start"), F.col("episode_before"))
    starts_run = (F.col("run.us") == F.col("first_us")) & (F.col("run.seq") == F.col("first_seq"))
    at_start = F.struct(
        F.unix_millis(F.timestamp_micros("first_us")).alias("ms"), F.lit(0).alias("rank"), before.alias("e"),
        (starts_run & (F.col("bad") | before.isNotNull() | ~F.col("segment_start"))).alias("changed"))
    at_confirm = F.when(F.col("opens") | F.col("recovers"), F.struct(
        F.col("confirm_ms").alias("ms"), F.lit(1).alias("rank"),
        F.when(F.col("opens"), F.col("episode")).alias("e"), F.lit(True).alias("changed")))
    x = pieces.df.select(
        "session", *part, "run", "bad", "segment_start", "first_user", "last_ms",
        F.explode(F.array_compact(F.array(at_start, at_confirm))).alias("m"))
    x = x.select("session", *part, F.col("m.ms").alias("ms"), F.col("m.rank").alias("rank"),
                 F.col("m.e").alias("e"), F.col("m.changed").alias("changed"),
                 F.struct("run", "bad").alias("of"),
                 F.when(F.col("segment_start") & (F.col("m.rank") == 0), F.struct("first_user")).alias("starter"),
                 F.lit(None).cast("struct<n:bigint,ms:bigint>").alias("alert"), "last_ms")
    spans = alerts.with_alerts(ep.episode_spans(pieces), pieces)
    again = spans.select("session", *part, "e", "alerts_before", F.posexplode("alert_ms").alias("n", "ms"))
    again = again.select("session", *part, "ms", F.lit(2).alias("rank"), F.col("e").cast(episode_type),
                         F.lit(True).alias("changed"),
                         F.struct((F.col("alerts_before") + F.col("n") + 2).alias("n"), "ms").alias("alert"))
    x = x.unionByName(again, allowMissingColumns=True)
    split = pieces.split.ordered_by("ms", "rank")
    x = split.last_before(x, "in_run", F.col("of"), inclusive=True)
    x = split.last_before(x, "begun_by", F.col("starter"), inclusive=True)
    raised = F.struct(F.col("e.us").alias("us"), F.col("e.seq").alias("seq"), "alert")
    x = split.last_before(x, "raised", F.when(F.col("alert").isNotNull(), raised), inclusive=True)
    # A run that starts with a re-alert is one change, reported by the re-alert.
    following = F.lead(F.struct("ms", "rank")).over(split.window())
    x = x.withColumn("changed", F.col("changed") & ~(
        (F.col("rank") == 0) & F.coalesce((following["ms"] == F.col("ms")) & (following["rank"] == 2), F.lit(False))))

    e, run = F.col("e"), F.col("in_run.run")
    opening = (run["us"] == e["us"]) & (run["seq"] == e["seq"])
    same = (F.col("raised.us") == e["us"]) & (F.col("raised.seq") == e["seq"])
    bad = F.col("in_run.bad")
    return x.select(
        F.col("session").alias("sessionId"), F.col("begun_by.first_user").alias("userId"), "ms", "rank", "changed",
        "last_ms",
        F.when(bad & (e.isNull() | opening), run["ms"]).alias("candidateSince"),
        F.when(~bad & e.isNotNull(), run["ms"]).alias("recoverySince"),
        e["start_ms"].alias("episodeStartedAt"),
        F.when(e.isNotNull(), F.coalesce(F.when(same, F.col("raised.alert.ms")), e["confirm_ms"])).alias("lastAlertAt"),
        F.when(e.isNull(), 0).otherwise(F.coalesce(F.when(same, F.col("raised.alert.n")), F.lit(1)))
         .cast("int").alias("alertCount"))


def _as_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: instants.from_millis(F.col(c)) for c in columns})


def state_changes(samples: DataFrame, params: EpisodeParams = EpisodeParams(),
                  rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """One row per sample that changed the judgment; state NORMAL means the stored state is deleted."""
    x = _moments(samples, params, rows_per_part).where(F.col("changed"))
    x = _as_timestamps(x.withColumn("at", instants.from_millis(F.col("ms"))),
                       ["candidateSince", "recoverySince", "episodeStartedAt", "lastAlertAt"])
    return with_state(x).drop("ms", "rank", "changed", "last_ms")


def session_states(samples: DataFrame, params: EpisodeParams = EpisodeParams(), *, as_of=None,
                   ttl_seconds: float | None = None, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Stored state of every live session at ``as_of``: not NORMAL, not expired, within its TTL."""
    now = ep.as_of_ms(samples, as_of)
    moment = F.struct("userId", "candidateSince", "recoverySince", "episodeStartedAt", "lastAlertAt", "alertCount")
    order = F.struct("ms", "rank")
    last = _moments(samples, params, rows_per_part).groupBy("sessionId").agg(
        F.max_by(moment, order).alias("s"), F.max("last_ms").alias("lastSeen"),
        F.max(F.when(F.col("changed"), F.col("ms"))).alias("written_ms"))
    live = last.where(now - F.col("lastSeen") < params.timeout_ms)
    if ttl_seconds is not None:
        live = live.where(now - F.col("written_ms") < F.lit(int(ttl_seconds * 1000)))
    x = live.select("sessionId", "s.*", "lastSeen")
    x = _as_timestamps(x, ["candidateSince", "recoverySince", "episodeStartedAt", "lastAlertAt", "lastSeen"])
    x = with_state(x).where(F.col("state") != NORMAL)
    return x.withColumn("stateKey", state_key(F.col("userId"), F.col("sessionId")))


def session_state(samples: DataFrame, params: EpisodeParams = EpisodeParams(), *, as_of=None,
                  ttl_seconds: float | None = 3600.0, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The stored snapshot per user key: that of the session seen last."""
    x = session_states(samples, params, as_of=as_of, ttl_seconds=ttl_seconds, rows_per_part=rows_per_part)
    columns = [*STATE_FIELDS, "state", "since"]
    return (x.groupBy("stateKey").agg(F.max_by(F.struct(*columns), F.struct("lastSeen", "sessionId")).alias("s"))
             .select("stateKey", "s.*"))


def to_hash(states: DataFrame) -> DataFrame:
    """``stateKey`` and the state as a text map: epoch milliseconds, and "" for null."""
    def ms(c):
        return F.unix_millis(c).cast("string")
    fields = {
        "sessionId": F.col("sessionId"), "userId": F.col("userId"), "state": F.col("state"),
        "since": ms("since"), "candidateSince": ms("candidateSince"), "recoverySince": ms("recoverySince"),
        "episodeStartedAt": ms("episodeStartedAt"), "lastAlertAt": ms("lastAlertAt"),
        "alertCount": F.when(F.col("episodeStartedAt").isNotNull(), F.col("alertCount").cast("string")),
        "lastSeen": ms("lastSeen")}
    pairs = [x for name, c in fields.items() for x in (F.lit(name), F.coalesce(c, F.lit("")))]
    return states.select("stateKey", F.create_map(*pairs).alias("hash"))


def from_hash(hashes: DataFrame) -> DataFrame:
    """Back to columns. A map without session, or with an unreadable number, gives no row.

    A restored episode counts at least one alert.
    """
    def text(name):
        return F.nullif(F.try_element_at("hash", F.lit(name)), F.lit(""))
    times = ["candidateSince", "recoverySince", "episodeStartedAt", "lastAlertAt", "lastSeen"]
    numbers = [*times, "alertCount"]
    kind = {name: "int" if name == "alertCount" else "long" for name in numbers}
    broken = F.exists(F.array(*[text(n).isNotNull() & text(n).try_cast(kind[n]).isNull() for n in numbers]),
                      lambda b: b)
    count = F.coalesce(text("alertCount").try_cast("int"), F.lit(0))
    x = hashes.where(text("sessionId").isNotNull() & ~broken).select(
        "stateKey", text("sessionId").alias("sessionId"), text("userId").alias("userId"),
        *[instants.from_millis(text(t).try_cast("long")).alias(t) for t in times],
        F.when(text("episodeStartedAt").isNotNull(), F.greatest(F.lit(1), count)).otherwise(count).alias("alertCount"))
    return with_state(x)


def restore(stored: DataFrame, incoming: DataFrame, timeout_seconds: float) -> DataFrame:
    """Look up the stored state of each session that is seen for the first time.

    ``incoming`` has one row per session (sessionId, userId, capturedAt). The state is used only if
    it belongs to that session and was last seen no longer ago than the timeout; ``discarded`` marks
    a stored state that fails either test.
    """
    first = incoming.withColumn("stateKey", state_key(F.col("userId"), F.col("sessionId"))).alias("i")
    s = stored.alias("s")
    age = F.unix_millis("i.capturedAt") - F.unix_millis("s.lastSeen")
    usable = (F.col("s.sessionId") == F.col("i.sessionId")) & (age / 1000.0 <= timeout_seconds)
    used = F.coalesce(usable, F.lit(False))
    fields = ["candidateSince", "recoverySince", "episodeStartedAt", "lastAlertAt", "alertCount"]
    return first.join(s, F.col("i.stateKey") == F.col("s.stateKey"), "left").select(
        F.col("i.sessionId").alias("sessionId"), F.col("i.stateKey").alias("stateKey"),
        used.alias("restored"), (F.col("s.stateKey").isNotNull() & ~used).alias("discarded"),
        *[F.when(used, F.col(f"s.{f}")).alias(f) for f in fields])


def expired_state_keys(samples: DataFrame, timeout_seconds: float, as_of=None) -> DataFrame:
    """State keys of expired sessions that no live session still uses."""
    now = ep.as_of_ms(samples, as_of)
    last = samples.where(F.col("capturedAt").isNotNull()).groupBy("sessionId").agg(
        F.max(F.unix_millis("capturedAt")).alias("last_ms"),
        F.min_by(state_key(F.col("userId"), F.col("sessionId")), F.struct("capturedAt", "seq")).alias("stateKey"))
    stale = now - F.col("last_ms") >= F.lit(int(timeout_seconds * 1000))
    live = last.where(~stale).select("stateKey")
    return last.where(stale).select("stateKey").distinct().join(live, "stateKey", "left_anti")
