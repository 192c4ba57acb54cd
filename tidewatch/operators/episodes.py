"""Episodes as a batch query: labelled samples -> runs -> episodes -> outcomes.

A *run* is a maximal stretch of equally good or bad samples inside a segment; a silence of at least
the timeout starts a new segment. A run is confirmed by its first later sample that lies at least
the persist (bad) or recovery (good) threshold after the run's first sample. An episode opens at a
confirmed bad run whose last confirmed predecessor in the segment is not bad, and closes at the next
confirmed good run, or at the segment's last sample if the session falls silent first.

All windows are partitioned by session (plus the part number when a session had to be cut, see
``plans.ordered``), so one exchange serves the whole chain. A cut run appears as several *pieces*;
each piece knows the start of its run, so nothing below depends on where the cuts are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import instants
from tidewatch.functions.labels import is_bad
from tidewatch.operators import alerts
from tidewatch.plans.ordered import PART, ROWS_PER_PART, Split, plan_split
from tidewatch.schemas import EVENT_ENDED, EVENT_STARTED, RE_ALERT, UNKNOWN_SESSION, EpisodeParams
from tidewatch.session import durable

SAMPLE_ORDER = ("us", "seq")
PIECE_ORDER = ("first_us", "first_seq")


@dataclass(frozen=True)
class Pieces:
    """Run pieces with the state before each of them, and how they are grouped and cut."""

    df: DataFrame
    split: Split
    params: EpisodeParams


def judged(samples: DataFrame) -> DataFrame:
    """The columns the episode rules read: session, user, us, ms, seq, bad. ``seq`` may be of any type that can be ordered."""
    return samples.where(F.col("capturedAt").isNotNull()).select(
        F.coalesce("sessionId", F.lit(UNKNOWN_SESSION)).alias("session"),
        F.col("userId").alias("user"),
        F.unix_micros("capturedAt").alias("us"),
        F.unix_millis("capturedAt").alias("ms"),
        F.col("seq"),
        is_bad(F.col("inferredStatus")).alias("bad"))


def split_sessions(rows: DataFrame, rows_per_part: int = ROWS_PER_PART) -> Split:
    return plan_split(rows, "session", SAMPLE_ORDER, rows_per_part)


def row_runs(rows: DataFrame, params: EpisodeParams, split: Split) -> DataFrame:
    """Every sample with the sample before it, its segment and run flags, and its run's start."""
    x = split.last_before(split.assign(rows), "prev", F.struct("ms", "bad", "user"))
    gap = F.col("ms") - F.col("prev.ms")
    x = x.withColumn("segment_start", F.col("prev").isNull() | (gap >= params.timeout_ms))
    x = x.withColumn("run_start", F.col("segment_start") | (F.col("bad") != F.col("prev.bad")))
    x = split.last_before(x, "run", F.when(F.col("run_start"), F.struct("us", "seq", "ms")),
                          inclusive=True)
    threshold = F.when(F.col("bad"), params.persist_ms).otherwise(params.recovery_ms)
    held = F.col("ms") - F.col("run.ms") >= threshold
    return x.withColumn("held", ~F.col("run_start") & held)


def run_pieces(samples: DataFrame, params: EpisodeParams,
               rows_per_part: int = ROWS_PER_PART, split: Split | None = None) -> Pieces:
    """Runs with their confirmation, and which of them open or close an episode."""
    rows = judged(samples)
    split = split_sessions(rows, rows_per_part) if split is None else split
    held_at = F.when(F.col("held"), F.struct("us", "seq"))
    pieces = row_runs(rows, params, split).groupBy(*split.keys, "run").agg(
        F.first("bad").alias("bad"),
        F.min(F.struct("us", "seq")).alias("first"),
        F.max("ms").alias("last_ms"),
        F.count(F.lit(1)).alias("samples"),
        F.max("segment_start").alias("segment_start"),
        F.min(F.when(F.col("held"), F.col("ms"))).alias("confirm_ms"),
        F.min_by("user", held_at).alias("confirm_user"),
        F.min_by("user", F.struct("us", "seq")).alias("first_user"),
        F.collect_list(F.when(F.col("bad"), F.col("ms"))).alias("bad_ms"))
    pieces = pieces.select("*", F.col("first.us").alias("first_us"),
                           F.col("first.seq").alias("first_seq")).drop("first")
    by_piece = split.ordered_by(*PIECE_ORDER)
    if split.hot:
        pieces = durable(pieces)

    # The state a piece leaves behind: B or G once confirmed, N for a fresh segment, else unchanged.
    confirmed = F.col("confirm_ms").isNotNull()
    state = (F.when(confirmed, F.when(F.col("bad"), "B").otherwise("G"))
              .when(F.col("segment_start"), "N"))
    x = by_piece.last_before(pieces, "state_before", state)
    was_open = F.coalesce(F.col("state_before") == "B", F.lit(False))
    x = x.withColumn("opens", confirmed & F.col("bad") & (F.col("segment_start") | ~was_open))
    x = x.withColumn("cuts", F.col("segment_start") & was_open)
    x = x.withColumn("recovers", confirmed & ~F.col("bad") & ~F.col("segment_start") & was_open)
    opened = F.struct("run.us", "run.seq", F.col("run.ms").alias("start_ms"), "confirm_ms",
                      F.col("confirm_user").alias("user"))
    seq = pieces.schema["first_seq"].dataType.simpleString()
    nothing = F.lit(None).cast(f"struct<us:bigint,seq:{seq},start_ms:bigint,confirm_ms:bigint,user:string>")
    mark = (F.when(F.col("opens"), F.struct(opened.alias("episode")))
             .when(F.col("cuts") | F.col("recovers"), F.struct(nothing.alias("episode"))))
    x = by_piece.last_before(x, "marked_before", mark)
    x = x.withColumn("episode_before", F.col("marked_before.episode"))
    x = x.withColumn("episode", F.when(F.col("opens"), opened)
                     .when(~(F.col("cuts") | F.col("recovers")), F.col("episode_before")))
    x = x.drop("marked_before")
    return Pieces(durable(x) if split.hot else x, by_piece, params)


def label_runs(samples: DataFrame, params: EpisodeParams,
               rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """One row per run: start, last sample, size, and when it was confirmed (null if never)."""
    rows = judged(samples)
    split = split_sessions(rows, rows_per_part)
    # Grouping by session and run start merges the pieces of a cut run.
    runs = row_runs(rows, params, split).groupBy("session", "run").agg(
        F.first("bad").alias("bad"), F.max("ms").alias("last_ms"),
        F.count(F.lit(1)).alias("samples"),
        F.max("segment_start").alias("segmentStart"),
        F.min(F.when(F.col("held"), F.col("ms"))).alias("confirm_ms"))
    return runs.select(
        F.col("session").alias("sessionId"), "bad",
        instants.from_millis(F.col("run.ms")).alias("startedAt"),
        instants.from_millis(F.col("last_ms")).alias("lastAt"),
        "samples", "segmentStart",
        instants.from_millis(F.col("confirm_ms")).alias("confirmedAt"))


def latest_ms(samples: DataFrame) -> Column:
    """The largest event time of the table, as a scalar subquery."""
    return samples.agg(F.max(F.unix_millis("capturedAt"))).scalar()


def as_of_ms(samples: DataFrame, as_of) -> Column:
    if as_of is None:
        return latest_ms(samples)
    return F.unix_millis(as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp"))


def episode_spans(pieces: Pieces) -> DataFrame:
    """Per episode (and part, if cut): its end if it has one, its last sample, its bad samples."""
    # A closing piece belongs to the episode it ends; a piece that cuts one and opens the next
    # belongs to both.
    closed = F.when(F.col("cuts") | F.col("recovers"), F.col("episode_before"))
    x = pieces.df.withColumn("role", F.explode(F.array_compact(F.array(
        F.when(F.col("episode").isNotNull(),
               F.struct(F.col("episode").alias("e"), F.lit(True).alias("inside"))),
        F.when(closed.isNotNull(), F.struct(closed.alias("e"), F.lit(False).alias("inside")))))))
    x = x.select("*", F.col("role.e").alias("e"), F.col("role.inside").alias("inside"))
    keys = ["session"] + ([PART] if pieces.split.hot else [])
    spans = x.groupBy(*keys, "e").agg(
        F.max(F.when(F.col("inside"), F.col("last_ms"))).alias("last_ms"),
        F.min(F.when(~F.col("inside") & F.col("recovers"), F.col("confirm_ms"))).alias("recovered_ms"),
        F.max(~F.col("inside") & F.col("cuts")).alias("cut"),
        F.flatten(F.collect_list(F.when(F.col("inside"), alerts.later_bad()))).alias("bad_ms"))
    # With cut sessions several branches read the spans, and each step above reads its input twice.
    return durable(spans) if pieces.split.hot else spans


def episodes(samples: DataFrame, params: EpisodeParams = EpisodeParams(), *, as_of=None,
             rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """One row per episode, keyed by (sessionId, startedAt).

    ``as_of`` is the moment at which a silent session counts as expired; by default the latest event
    time of the table. An episode that is still open then has a null end.
    """
    return finished(run_pieces(samples, params, rows_per_part), as_of_ms(samples, as_of))


def ended_spans(spans: DataFrame, pieces: Pieces, now_ms: Column) -> DataFrame:
    """One row per episode: ``spans`` put together over parts, with the end decided."""
    if pieces.split.hot:
        spans = spans.groupBy("session", "e").agg(
            F.max("last_ms").alias("last_ms"), F.min("recovered_ms").alias("recovered_ms"),
            F.max("cut").alias("cut"), F.sum("re_alerts").alias("re_alerts"),
            F.max("last_alert_ms").alias("last_alert_ms"))
    silent = F.col("cut") | (now_ms - F.col("last_ms") >= pieces.params.timeout_ms)
    return spans.withColumns({
        "end_ms": F.coalesce("recovered_ms", F.when(silent, F.col("last_ms"))),
        "alert_count": (F.lit(1) + F.col("re_alerts")).cast("int"),
        "last_alert_ms": F.coalesce("last_alert_ms", "e.confirm_ms")})


def finished(pieces: Pieces, now_ms: Column) -> DataFrame:
    spans = ended_spans(alerts.with_alerts(episode_spans(pieces), pieces), pieces, now_ms)
    return spans.select(
        F.col("session").alias("sessionId"), F.col("e.user").alias("userId"),
        instants.from_millis(F.col("e.start_ms")).alias("startedAt"),
        instants.from_millis(F.col("e.confirm_ms")).alias("confirmedAt"),
        instants.from_millis(F.col("end_ms")).alias("endedAt"),
        instants.elapsed_seconds(F.col("end_ms"), F.col("e.start_ms")).alias("durationSeconds"),
        F.col("alert_count").alias("alertCount"),
        instants.from_millis(F.col("last_alert_ms")).alias("lastAlertAt"),
        F.col("recovered_ms").isNotNull().alias("recovered"),
        F.col("end_ms").isNull().alias("ongoing"))


def _entry(kind: str, number, ms, last_alert_ms) -> Column:
    return F.struct(F.lit(kind).alias("type"), number.cast("int").alias("number"), ms.alias("ms"),
                    last_alert_ms.alias("last_alert_ms"))


def _log(pieces: Pieces, now_ms: Column | None) -> DataFrame:
    """Episode changes as rows; the ends are left out when ``now_ms`` is None."""
    spans = alerts.with_alerts(episode_spans(pieces), pieces)
    confirm = F.col("e.confirm_ms")
    first = F.array(_entry(EVENT_STARTED, F.lit(1), confirm, confirm))
    again = F.transform("alert_ms", lambda t, i: _entry(
        RE_ALERT, F.col("alerts_before") + i + 2, t, t))
    keep = ["session", "e"]
    if now_ms is None:
        done, edges = spans, first
        if pieces.split.hot:
            done = spans.select(*keep).distinct()
    else:
        done = ended_spans(spans, pieces, now_ms)
        last = _entry(EVENT_ENDED, F.col("alert_count"), F.col("end_ms"), F.col("last_alert_ms"))
        edges = F.concat(first, F.filter(F.array(last), lambda x: x["ms"].isNotNull()))
        keep = [*keep, (F.col("recovered_ms").isNotNull()).alias("recovered")]
    if not pieces.split.hot:
        return done.select(*keep, F.explode(F.concat(edges, again)).alias("x"))
    return done.select(*keep, F.explode(edges).alias("x")).unionByName(
        spans.select("session", "e", F.explode(again).alias("x")), allowMissingColumns=True)


def episode_alerts(samples: DataFrame, params: EpisodeParams = EpisodeParams(), *,
                   rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """One row per alert of an episode: the confirming one, then every re-alert, numbered from 1."""
    return _log(run_pieces(samples, params, rows_per_part), None).select(
        F.col("session").alias("sessionId"), F.col("e.user").alias("userId"),
        instants.from_millis(F.col("e.start_ms")).alias("startedAt"),
        F.col("x.number").alias("alertNumber"),
        instants.from_millis(F.col("x.ms")).alias("alertAt"))


def episode_outcomes(samples: DataFrame, params: EpisodeParams = EpisodeParams(), *, as_of=None,
                     rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """The change log: EVENT_STARTED, RE_ALERT and EVENT_ENDED rows with the episode as it was then.

    Natural and forced ends both appear as EVENT_ENDED; ``recovered`` tells them apart.
    """
    log = _log(run_pieces(samples, params, rows_per_part), as_of_ms(samples, as_of))
    ended = F.col("x.type") == EVENT_ENDED
    return log.select(
        F.col("x.type").alias("type"), F.col("session").alias("sessionId"),
        F.col("e.user").alias("userId"),
        instants.from_millis(F.col("e.start_ms")).alias("startedAt"),
        instants.from_millis(F.col("x.ms")).alias("at"),
        F.when(ended, instants.from_millis(F.col("x.ms"))).alias("endedAt"),
        F.when(ended, instants.elapsed_seconds(F.col("x.ms"), F.col("e.start_ms"))).alias("durationSeconds"),
        F.col("x.number").alias("alertCount"),
        instants.from_millis(F.col("x.last_alert_ms")).alias("lastAlertAt"),
        (ended & F.col("recovered")).alias("recovered"), (~ended).alias("ongoing"))


def episodes_active(episodes_df: DataFrame) -> DataFrame:
    return episodes_df.where(F.col("ongoing"))


def episodes_recent(episodes_df: DataFrame, limit: int = 20) -> DataFrame:
    """The last ``limit`` ended episodes (1..100), oldest first."""
    n = min(100, max(1, limit))
    newest = episodes_df.where(~F.col("ongoing")).orderBy(
        F.desc("endedAt"), F.desc("sessionId"), F.desc("startedAt")).limit(n)
    return newest.orderBy("endedAt", "sessionId", "startedAt")


def episode_json(df: DataFrame) -> DataFrame:
    """Episode or outcome rows as JSON messages that keep null fields."""
    return df.select(
        "sessionId", "startedAt",
        F.to_json(F.struct(
            "sessionId", "userId", instants.iso_millis(F.col("startedAt")).alias("startedAt"),
            instants.iso_millis(F.col("endedAt")).alias("endedAt"), "durationSeconds", "alertCount",
            instants.iso_millis(F.col("lastAlertAt")).alias("lastAlertAt"), "recovered", "ongoing"),
            {"ignoreNullFields": "false"}).alias("value"))


def session_expiry(samples: DataFrame, params: EpisodeParams = EpisodeParams(), *, as_of=None,
                   rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Sessions silent for at least the timeout at ``as_of``, with the episode the expiry closes."""
    now = as_of_ms(samples, as_of)
    rows = judged(samples)
    last = rows.groupBy("session").agg(F.max("ms").alias("last_ms"))
    stale = last.where(now - F.col("last_ms") >= params.timeout_ms)
    eps = episodes(samples, params, as_of=as_of, rows_per_part=rows_per_part)
    forced = eps.where(~F.col("ongoing") & ~F.col("recovered")).select(
        F.col("sessionId").alias("session"), "startedAt", "endedAt", "alertCount")
    # A session that expires now has at most one episode that ends at its last sample.
    closing = (stale.join(forced, (stale.session == forced.session)
                          & (instants.from_millis(stale.last_ms) == forced.endedAt), "left")
                    .select(stale.session.alias("sessionId"),
                            instants.from_millis(F.col("last_ms")).alias("lastSeenAt"),
                            F.col("startedAt").alias("episodeStartedAt"),
                            F.col("alertCount").alias("episodeAlertCount")))
    return closing


def sample_gaps(samples: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Milliseconds since the previous sample of the session, at least 0; null for the first."""
    rows = judged(samples)
    split = split_sessions(rows, rows_per_part)
    x = split.last_before(split.assign(rows), "prev_ms", F.col("ms"))
    return x.select(
        F.col("session").alias("sessionId"), "seq",
        F.when(F.col("prev_ms").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("ms") - F.col("prev_ms"))).alias("gapMs"))


def session_sequences(samples: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Every sample with its position in its session, counted from 1."""
    rows = judged(samples)
    split = split_sessions(rows, rows_per_part)
    x = split.running_count(split.assign(rows), "position", F.lit(True))
    return x.select(F.col("session").alias("sessionId"), "seq", "position")
