"""Scoring on a stream: the last vectors of each session in keyed state, a bucket of sessions at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.scoring import WINDOW_SIZE, SequenceModel, WindowScorer, choose_label, numeric_vector, width_of, window_key
from tidewatch.schemas import to_ms
from tidewatch.session import use_state_store
from tidewatch.streaming.buckets import Entries, bucket_of, move_timer, rung_at

CARRIED = ["sessionId", "userId", "capturedAt", "serverReceivedAt", "deviationScore", "ruleStatus"]
TIMES = ["capturedAt", "serverReceivedAt"]
CLOCK = "_clock"

#: In place of a time that is missing; it sorts before all others.
NO_TIME = -1 << 63


def to_micros(c: str) -> Column:
    """A time as a number. Spark makes an object of every value that a Python processor takes in, and those of times cost most;
    pandas also has none after 2262."""
    return F.coalesce(F.unix_micros(c), F.lit(NO_TIME)).alias(c)


def from_micros(c: str) -> Column:
    return F.timestamp_micros(F.nullif(F.col(c), F.lit(NO_TIME))).alias(c)


class OrderColumns:
    """``seq`` as plain columns (seq0, ...) while rows are in keyed state: a number as it is, a struct by its fields."""

    def __init__(self, df: DataFrame):
        kind = df.schema["seq"].dataType
        fields = getattr(kind, "fields", None)
        self.names = [f"seq{i}" for i in range(len(fields) if fields else 1)]
        self.flat = ([F.col(f"seq.{f.name}").alias(n) for f, n in zip(fields, self.names, strict=True)] if fields
                     else [F.col("seq").alias(self.names[0])])
        self.whole = (F.struct(*(F.col(n).alias(f.name) for f, n in zip(fields, self.names, strict=True))) if fields
                      else F.col(self.names[0])).alias("seq")


class WindowProcessor(StatefulProcessor):
    """Adds to each sample how many vectors its session's window holds and, with a model, its class probabilities.

    Without a model the state is one number per session, with ``forget_ms`` also when it is due to be forgotten. Rows of a
    micro-batch come as pandas frames, those of a bucket's sessions together; how many there can be is the source's limit per trigger.
    Their vectors come only for a model, else whether there is one (``valid``); times come as microseconds.
    """

    def __init__(self, model: SequenceModel | None, size: int, order: list[str], forget_ms: int | None, clocked: bool):
        self.model, self.size, self.order, self.forget_ms, self.clocked = model, size, order, forget_ms, clocked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held, recent = Entries(handle, "held", "n int, due long"), Entries(handle, "recent", "vectors array<array<double>>, due long")
        self.kept = held if self.model is None else recent

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows), ignore_index=True)
        # Samples without a time come first, as in the batch query.
        x = x.sort_values(["windowKey", "capturedAt", *self.order], kind="stable", ignore_index=True)
        valid = (x["valid"] if self.model is None else x["vector"].notna()).to_numpy(bool)
        names, us = x["windowKey"].to_numpy(object), x["capturedAt"].to_numpy(np.int64)
        starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        ends, sessions = np.append(starts[1:], len(x)), names[starts].tolist()
        entries = self.kept.read()
        waiting, known = self._waiting(entries), [entries.get(s) for s in sessions]
        due = self._due(us, starts, known)
        if self.model is None:
            count = np.cumsum(valid)
            earlier = np.array([k[0] if k else 0 for k in known]) - (count[starts] - valid[starts])
            held = np.minimum(self.size, count + np.repeat(earlier, ends - starts))
            p = [None] * len(x)
            entries |= zip(sessions, zip(held[ends - 1].tolist(), due, strict=True), strict=True)
        else:
            width, held, p = self.model.w_input.shape[1], np.zeros(len(x), np.int64), []
            for session, k, at, a, b in zip(sessions, known, due, starts, ends, strict=True):
                scorer = WindowScorer(self.model, self.size, np.array(k[0] if k else [], float).reshape(-1, width))
                held[a:b], found = scorer.score(np.array(x["vector"][a:b][valid[a:b]].tolist(), float).reshape(-1, width), valid[a:b])
                p += [None if v is None else v.tolist() for v in found]
                entries[session] = scorer.recent.tolist(), at
        move_timer(self.handle, waiting, self._waiting(entries))
        self.kept.write(entries)
        out = {"windowKey": x["windowKey"], **{c: x[c] for c in [*CARRIED, *self.order]}, "windowBuffered": held.astype(np.int32), "_p": p}
        if self.clocked:
            # The clock of later operators: the sample's time, or the watermark for samples behind it.
            behind = np.maximum(timerValues.getCurrentWatermarkInMs() - us // 1000, 0)
            out[CLOCK] = pd.Series((us + 1000 * behind).astype("datetime64[us]")).dt.tz_localize("UTC")
        yield pd.DataFrame(out)

    @staticmethod
    def _waiting(entries: dict[str, tuple]) -> list[int]:
        return [due for _, due in entries.values() if due is not None]

    def _due(self, us: np.ndarray, starts: np.ndarray, known: list[tuple | None]) -> list[int | None]:
        """When each session is forgotten: some time after the newest of its samples in this micro-batch."""
        if self.forget_ms is None:
            return [None] * len(starts)
        newest = np.maximum.reduceat(us, starts).tolist()
        return [k and k[1] if m == NO_TIME else m // 1000 + self.forget_ms for m, k in zip(newest, known, strict=True)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entries, now = self.kept.read(), rung_at(timerValues, expiredTimerInfo)
        left = {session: entry for session, entry in entries.items() if entry[1] is None or entry[1] > now}
        move_timer(self.handle, self._waiting(entries), self._waiting(left), rung=True)
        self.kept.write(left)
        return iter(())

    def close(self) -> None:
        pass


def score_stream(samples: DataFrame, model: SequenceModel | None = None, *, size: int = WINDOW_SIZE,
                 forget_seconds: float | None = None, delay: str = "1 minute", clocked: bool = False) -> DataFrame:
    """Summary samples with ``seq`` to scored samples, in the columns of the batch query.

    Windows are kept for ever, as in the batch query, unless ``forget_seconds`` is given: then a
    session silent that long (by the watermark, ``delay`` behind the newest sample) starts afresh. With ``clocked`` the
    output carries an event time (``_clock``) that is never behind the watermark, so another stateful operator can follow;
    samples without a time are then left out, since that operator cannot place them.
    """
    use_state_store(samples.sparkSession)
    timed = clocked or forget_seconds is not None
    if clocked:
        samples = samples.where(F.col("capturedAt").isNotNull())
    if timed:
        samples = samples.withWatermark("capturedAt", delay)
    order, vector = OrderColumns(samples), numeric_vector(width_of(model))
    # The order, like every other column here, is derived: rows behind the watermark are not dropped before the state.
    keyed = samples.select(
        bucket_of(window_key()).alias("bucket"), window_key().alias("windowKey"), *[to_micros(c) if c in TIMES else F.col(c) for c in CARRIED],
        *order.flat, vector.isNotNull().alias("valid") if model is None else vector.alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["windowKey", *CARRIED, *order.names]) + ", windowBuffered int, _p array<double>"
    processor = WindowProcessor(model, size, order.names, None if forget_seconds is None else to_ms(forget_seconds), clocked)
    grouped = keyed.groupBy("bucket")
    if clocked:
        x = grouped.transformWithStateInPandas(processor, f"{schema}, {CLOCK} timestamp", "Append", "EventTime", eventTimeColumnName=CLOCK)
    else:
        x = grouped.transformWithStateInPandas(processor, schema, "Append", "EventTime" if timed else "None")
    x = x.withColumns({c: from_micros(c) for c in TIMES})
    return choose_label(x.select("*", order.whole), model, size, [CLOCK] if clocked else [])
