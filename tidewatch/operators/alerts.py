"""Re-alerts: on a bad sample at least the re-alert interval after the last alert.

Each alert moves the clock of the next, so the alerts of an episode are a fold over its bad samples
in time order. An episode of an uncut session folds in one array inside the JVM. For a cut session
the array holds one part of the episode; what a part needs is the last alert before it. Every part
has a small table: for each sample that could be its first alert, the last alert the part would then
end with. Two neighbouring tables compose to the table of both, so tables go up a binary tree over the
parts, and the last alerts come down it: no task sees more than two tables of an episode at once, and
the number of rounds is the logarithm of the number of parts.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.ordered import PART
from tidewatch.session import durable


def later_bad() -> Column:
    """The bad samples of a piece that can raise a re-alert.

    In the opening piece these come after the confirming sample, which is itself the first alert.
    With a persist threshold of 0 the run's first sample may share its millisecond.
    """
    times = F.sort_array("bad_ms")
    starts_here = ((F.col("run.us") == F.col("first_us")) & (F.col("run.seq") == F.col("first_seq"))
                   & (F.col("run.ms") == F.col("confirm_ms")))
    from_confirm = F.filter(times, lambda t: t >= F.col("confirm_ms"))
    after = F.slice(from_confirm, F.lit(2) + starts_here.cast("int"), F.size("bad_ms"))
    return F.when(F.col("opens"), after).otherwise(times)


def alert_times(times: Column, last_alert: Column, interval_ms: int) -> Column:
    """The alerts that sorted ``times`` raise after ``last_alert``: from each alert, jump to the first time an interval later."""
    if interval_ms <= 0:
        return times

    @F.pandas_udf("array<bigint>")
    def walk(times: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _walk(np.asarray(t).tolist(), int(a), interval_ms) for t, a in zip(times, last)])

    return walk(times, F.coalesce(last_alert, F.lit(0).cast("long")))


def _walk(times: list[int], last: int, interval: int) -> list[int]:
    out, at = [], bisect.bisect_left(times, last + interval)
    while at < len(times):
        out.append(times[at])
        at = bisect.bisect_left(times, times[at] + interval, at + 1)
    return out


def with_alerts(spans: DataFrame, pieces) -> DataFrame:
    """Add alert_ms, alerts_before (re-alerts in earlier parts), re_alerts and last_alert_ms."""
    interval = pieces.params.realert_ms
    spans = spans.withColumn("bad_ms", F.sort_array("bad_ms"))
    if pieces.split.hot:
        spans = _with_last_alert(spans, interval)
    else:
        spans = spans.withColumn("alert_before_ms", F.col("e.confirm_ms")).withColumn(
            "alerts_before", F.lit(0).cast("long"))
    spans = spans.withColumn("alert_ms", alert_times(F.col("bad_ms"), F.col("alert_before_ms"), interval))
    return (spans.withColumn("re_alerts", F.size("alert_ms").cast("long"))
                 .withColumn("last_alert_ms", F.array_max("alert_ms")).drop("bad_ms"))


def _with_last_alert(spans: DataFrame, interval: int) -> DataFrame:
    cut = spans.where(F.col(PART).isNotNull())

    @F.pandas_udf("struct<starts:array<bigint>,ends:array<bigint>,counts:array<bigint>>")
    def ends_with(times: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_chain_table(np.asarray(t, dtype=np.int64), interval) for t in times],
                            columns=["starts", "ends", "counts"])

    named = cut.where(F.size("bad_ms") > 0).select(
        "session", F.col("e.us").alias("us"), F.col("e.seq").alias("n"), F.col("e.confirm_ms").alias("confirm_ms"), PART, ends_with("bad_ms").alias("t"))
    tables = durable(named.select("session", "us", "n", "confirm_ms", PART, "t.*"))
    passed = _alerts_before(tables, interval).withColumnRenamed("n", "seq")
    joined = spans.withColumns({"us": F.col("e.us"), "seq": F.col("e.seq")}).join(
        passed, ["session", "us", "seq", PART], "left")
    return (joined.withColumn("alert_before_ms", F.coalesce("alert_before_ms", "e.confirm_ms"))
                  .withColumn("alerts_before", F.coalesce("alerts_before", F.lit(0).cast("long")))
                  .drop("us", "seq"))


EPISODE = ["session", "us", "n"]


def _alerts_before(tables: DataFrame, interval: int) -> DataFrame:
    """Of each part the last alert before it and how many re-alerts there were: session, us, n, part, alert_before_ms, alerts_before."""
    up = F.shiftright(PART, 1).alias("_up")

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(PART, ignore_index=True)
        out = pdf.iloc[:1].assign(**{PART: pdf[PART].iloc[0] >> 1})
        if len(pdf) == 2:
            starts, ends, counts = _composed(*([np.asarray(pdf[c][i]) for c in ("starts", "ends", "counts")] for i in (0, 1)), interval)
            out = out.assign(starts=[starts], ends=[ends], counts=[counts])
        return out

    levels, most = [tables], tables.agg(F.max(PART)).first()[0] or 0
    for _ in range(most.bit_length()):
        levels.append(durable(levels[-1].groupBy(*EPISODE, up).applyInPandas(both, tables.schema)))
    known = levels[-1].select(*EPISODE, PART, F.col("confirm_ms").alias("alert_before_ms"), F.lit(0).cast("long").alias("alerts_before"))
    schema = known.schema

    def down(below: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        below = below.sort_values(PART, ignore_index=True)
        last, count = above["alert_before_ms"].iloc[0], above["alerts_before"].iloc[0]
        out = below[[*EPISODE, PART]].assign(alert_before_ms=last, alerts_before=count)
        if len(below) == 2:
            i = np.searchsorted(below["starts"][0], last + interval)
            if i < len(below["starts"][0]):
                out.loc[1, ["alert_before_ms", "alerts_before"]] = below["ends"][0][i], count + below["counts"][0][i]
        return out

    for level in levels[-2::-1]:
        known = durable(level.groupBy(*EPISODE, up).cogroup(known.groupBy(*EPISODE, PART)).applyInPandas(down, schema))
    return known


def _composed(a, b, interval: int):
    """The table of two neighbouring stretches of an episode from their tables (starts, ends, counts).

    A first alert in the earlier one leads to its last one, and from there the later one goes on. The later one's own first
    alerts count where the earlier one is too short to hold a sample an interval after its beginning.
    """
    at = np.searchsorted(b[0], a[1] + interval)
    on = at < len(b[0])
    at = np.minimum(at, len(b[0]) - 1)
    ends, counts = np.where(on, b[1][at], a[1]), a[2] + np.where(on, b[2][at], 0)
    more = 0
    if interval > 0 and a[0][-1] < a[0][0] + interval:
        more = min(len(b[0]), int(np.searchsorted(b[0], a[0][0] + interval)) + 1)
    return tuple(np.concatenate([x, y[:more]]).tolist() for x, y in zip((a[0], ends, counts), b, strict=True))


def _chain_table(times: np.ndarray, interval: int):
    """For each possible first alert of a part: the last alert and how many the part then raises.

    Candidates reach up to the first sample one interval after the part begins, because an alert
    before the part allows a new one no later than that.
    """
    if len(times) == 0:
        return [], [], []
    n = len(times)
    jump = np.append(np.searchsorted(times, times + interval), n) if interval > 0 else np.arange(1, n + 2)
    jump[n] = n
    end = np.append(np.arange(n), n)
    count = np.append(np.ones(n, dtype=np.int64), 0)
    # Doubling: after k rounds each entry knows the chain of its next 2**k alerts.
    while (jump[:n] < n).any():
        end = np.where(jump < n, end[jump], end)
        count = count + count[jump]
        jump = jump[jump]
    upto = min(n, int(np.searchsorted(times, times[0] + interval)) + 1)
    first = np.unique(times[:upto], return_index=True)[1] if interval > 0 else np.arange(1)
    return times[first].tolist(), times[end[first]].tolist(), count[first].tolist()
