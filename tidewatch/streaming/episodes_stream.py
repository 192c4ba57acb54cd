"""Episodes on a stream: a state entry per session, in buckets of sessions, and an event-time timer for silence.

The entry holds the current run (bad or good, and since when), the last sample, and the open
episode. Samples of a micro-batch are taken in (capturedAt, seq) order. A silence is noticed in two
ways: by the bucket's timer, once the watermark has passed last-seen plus the timeout, or by the next sample
of the session if that arrives first. Both end the episode at the last sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions import instants
from tidewatch.operators.episodes import judged
from tidewatch.schemas import EVENT_ENDED, EVENT_STARTED, RE_ALERT, EpisodeParams
from tidewatch.session import durable, use_state_store
from tidewatch.streaming.buckets import Entries, bucket_of, move_timer, rung_at
from tidewatch.streaming.scoring_stream import CLOCK, OrderColumns

STATE = ("run_bad boolean, run_ms long, last_ms long, start_ms long, alert_ms long, alerts int, "
         "user string")
STATE_NAMES = [field.split()[0] for field in STATE.split(", ")]
LAST = STATE_NAMES.index("last_ms")
OUTCOME = ("session string, type string, user string, start_ms long, at_ms long, alerts int, "
           "alert_ms long, recovered boolean")


class SessionJudge:
    """The rules for one session, over plain values; emits (type, user, start, at, alerts, alert, recovered)."""

    def __init__(self, params: EpisodeParams, state=None):
        self.p = params
        (self.run_bad, self.run_ms, self.last_ms, self.start_ms, self.alert_ms, self.alerts,
         self.user) = state or (None, None, None, None, None, 0, None)

    def state(self) -> tuple:
        return (self.run_bad, self.run_ms, self.last_ms, self.start_ms, self.alert_ms, self.alerts, self.user)

    def _event(self, kind, at, recovered=False):
        return kind, self.user, self.start_ms, at, self.alerts, self.alert_ms, recovered

    def silence(self):
        """The session fell silent: the forced end of an open episode, then nothing is left."""
        if self.start_ms is not None:
            yield self._event(EVENT_ENDED, self.last_ms)
        self.__init__(self.p)

    def sample(self, ms: int, bad: bool, user):
        if self.last_ms is not None and ms - self.last_ms >= self.p.timeout_ms:
            yield from self.silence()
        new_run = self.run_bad is None or bad != self.run_bad
        if new_run:
            self.run_bad, self.run_ms = bad, ms
        confirmed = not new_run and ms - self.run_ms >= (self.p.persist_ms if bad else self.p.recovery_ms)
        self.last_ms = ms if self.last_ms is None else max(self.last_ms, ms)
        is_open = self.start_ms is not None
        if bad and is_open and ms - self.alert_ms >= self.p.realert_ms:
            self.alert_ms, self.alerts = ms, self.alerts + 1
            yield self._event(RE_ALERT, ms)
        elif bad and confirmed and not is_open:
            self.start_ms, self.alert_ms, self.alerts, self.user = self.run_ms, ms, 1, user
            yield self._event(EVENT_STARTED, ms)
        elif not bad and confirmed and is_open:
            yield self._event(EVENT_ENDED, ms, True)
            self.start_ms, self.alert_ms, self.alerts, self.user = None, None, 0, None


class EpisodeProcessor(StatefulProcessor):
    def __init__(self, params: EpisodeParams, order: list[str]):
        self.params, self.order = params, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.judgment = Entries(handle, "judgment", STATE)

    @staticmethod
    def _rows(session, events) -> Iterator[Row]:
        for event in events:
            yield Row(session=session, type=event[0], user=event[1], start_ms=event[2], at_ms=event[3],
                      alerts=event[4], alert_ms=event[5], recovered=event[6])

    def _silent_at(self, states: dict[str, tuple]) -> list[int]:
        return [state[LAST] + self.params.timeout_ms for state in states.values()]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        states = dict(zip(initialState["session"], zip(*(initialState[name] for name in STATE_NAMES), strict=True), strict=True))
        self.judgment.write(states)
        move_timer(self.handle, [], self._silent_at(states))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        states = self.judgment.read()
        before = self._silent_at(states)
        ordered = sorted(rows, key=lambda r: (r.session, r.us, *(r[c] for c in self.order)))
        for session, own in groupby(ordered, key=lambda r: r.session):
            judge = SessionJudge(self.params, states.get(session))
            for r in own:
                yield from self._rows(session, judge.sample(r.ms, r.bad, r.user))
            states[session] = judge.state()
        move_timer(self.handle, before, self._silent_at(states))
        self.judgment.write(states)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        states = self.judgment.read()
        before, now = self._silent_at(states), rung_at(timerValues, expiredTimerInfo)
        for session, state in list(states.items()):
            if state[LAST] + self.params.timeout_ms <= now:
                yield from self._rows(session, SessionJudge(self.params, states.pop(session)).silence())
        move_timer(self.handle, before, self._silent_at(states), rung=True)
        self.judgment.write(states)

    def close(self) -> None:
        pass


def state_rows(states: DataFrame) -> DataFrame:
    """Snapshots of sessions (columns of ``state_view.session_states``) as the state that a stream starts from.

    What a snapshot does not name is of no account: in an open episode after a relapse, when its run began.
    """
    def ms(c):
        return F.unix_millis(c)
    return states.select(
        F.col("sessionId").alias("session"), F.col("recoverySince").isNull().alias("run_bad"),
        F.coalesce(ms("recoverySince"), ms("candidateSince"), ms("episodeStartedAt")).alias("run_ms"), ms("lastSeen").alias("last_ms"),
        ms("episodeStartedAt").alias("start_ms"), ms("lastAlertAt").alias("alert_ms"), F.col("alertCount").cast("int").alias("alerts"),
        F.when(F.col("episodeStartedAt").isNotNull(), F.col("userId")).alias("user"))


def stored_state(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The state that a stopped outcome stream has left in its checkpoint, one row per session."""
    kept = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "judgment").load(checkpoint)
    return kept.select(F.inline(F.arrays_zip(*(f"value.{name}" for name in ("session", *STATE_NAMES)))))


def outcome_stream(samples: DataFrame, params: EpisodeParams = EpisodeParams(), *,
                   delay: str = "1 minute", initial: DataFrame | None = None) -> DataFrame:
    """Labelled samples (sessionId, userId, capturedAt, seq, inferredStatus) to outcomes.

    ``delay`` is how far the clock of the silence timers trails the newest sample. It drops nothing:
    the rows no longer carry the watermark column when they reach the state, so a late sample is
    judged when it arrives, by the time it carries. Samples of ``score_stream(clocked=True)`` bring their clock with them.

    ``initial`` (``state_rows`` of snapshots, or the ``stored_state`` of a stream that has ended) is what a new stream
    starts from; it is written down first, and read in the first micro-batch only.
    """
    use_state_store(samples.sparkSession)
    rows = judged(samples if CLOCK in samples.columns else samples.withWatermark("capturedAt", delay))
    order = OrderColumns(rows)
    bucket, start = bucket_of(F.col("session")).alias("bucket"), None
    if initial is not None:
        of_bucket = initial.groupBy(bucket).agg(F.collect_list(F.struct("session", *STATE_NAMES)).alias("all"))
        start = durable(of_bucket.select("bucket", *(F.col(f"all.{name}").alias(name) for name in ("session", *STATE_NAMES)))).groupBy("bucket")
    x = rows.select(bucket, "session", "user", "us", "ms", "bad", *order.flat).groupBy("bucket").transformWithState(
        EpisodeProcessor(params, order.names), OUTCOME, "Append", "EventTime", initialState=start)
    ended = F.col("type") == EVENT_ENDED
    return x.select(
        "type", F.col("session").alias("sessionId"), F.col("user").alias("userId"),
        instants.from_millis(F.col("start_ms")).alias("startedAt"),
        instants.from_millis(F.col("at_ms")).alias("at"),
        F.when(ended, instants.from_millis(F.col("at_ms"))).alias("endedAt"),
        F.when(ended, instants.elapsed_seconds(F.col("at_ms"), F.col("start_ms"))).alias("durationSeconds"),
        F.col("alerts").alias("alertCount"), instants.from_millis(F.col("alert_ms")).alias("lastAlertAt"),
        "recovered", (~ended).alias("ongoing"))
