"""Summaries: exact percentiles, latency, status counts, lag, per-user period statistics."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import instants
from tidewatch.operators import episodes as ep
from tidewatch.plans.ordered import ROWS_PER_PART, checked
from tidewatch.schemas import EpisodeParams
from tidewatch.session import durable


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """``keys`` plus ``percentiles``: exact values with linear interpolation between neighbours; nulls do not count.

    Distinct values with their counts go through one range exchange on (keys, value), so a large group is spread over as many
    tasks as it needs and a frequent value is one row. Sums over one row per task and group tell which task holds each wanted
    rank, and only there are values counted one by one. The same path serves groups of every size.
    """
    key = keys or ["_every"]
    rows = df.where(F.col(value).isNotNull())
    if not keys:
        rows = rows.withColumn("_every", F.lit(0))
    counted = rows.groupBy(*key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ordered = counted.repartitionByRange(*key, "_v").sortWithinPartitions(*key, "_v")
    rows = durable(ordered.withColumn("_task", F.spark_partition_id()))
    here = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    own = [f"_k{i}" for i in range(len(key))]
    of_group = Window.partitionBy(*own)
    tasks = rows.groupBy(*here, F.col("_task").alias("_t")).agg(F.sum("_c").alias("_here"))
    before = F.coalesce(F.sum("_here").over(of_group.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    tasks = tasks.select(*own, "_t", "_here", before.alias("_before"), F.sum("_here").over(of_group).alias("_n"))
    ranks = [F.lit(float(p)) * (F.col("_n") - 1) for p in ps]
    wanted = [side(r) for r in ranks for side in (F.floor, F.ceil)]
    inside = functools.reduce(operator.or_, ((w >= F.col("_before")) & (w < F.col("_before") + F.col("_here")) for w in wanted))
    # At most two rows per percentile and group, each with the task that holds the rank.
    tasks = durable(tasks.where(inside).drop("_here"))
    same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(key, own, strict=True)), F.col("_task") == F.col("_t"))
    near = rows.join(checked(tasks), same)
    in_task = Window.partitionBy(*key, "_task").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_upto", F.col("_before") + F.sum("_c").over(in_task))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_v")))

    found = near.groupBy(*key).agg(F.max("_n").alias("_n"), *(at(w).alias(f"_w{i}") for i, w in enumerate(wanted)))
    values = [F.col(f"_w{2 * i}") + (F.col(f"_w{2 * i + 1}") - F.col(f"_w{2 * i}")) * (r - F.floor(r)) for i, r in enumerate(ranks)]
    return found.select(*keys, F.array(*values).alias("percentiles"))


def latency_summary(df: DataFrame, value: str, by: list[str], seconds: float | None = None) -> DataFrame:
    """n, mean, p50, p95, p99 and maximum per group; with ``seconds`` also the rate per second."""
    basic = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    ps = exact_percentiles(df, by, value, [0.5, 0.95, 0.99])
    out = _same_keys(basic, ps, by, "left") if by else basic.withColumn("percentiles", ps.scalar())
    out = out.select(*by, "n", "mean", *[F.col("percentiles")[i].alias(name) for i, name in
                                        enumerate(("p50", "p95", "p99"))], "max")
    return out if seconds is None else out.withColumn("perSecond", F.col("n") / F.lit(float(seconds)))


def status_counts(df: DataFrame, status: str, ok) -> DataFrame:
    """Rows per status and whether that status counts as success."""
    return df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "ok", F.col("status") == F.lit(ok))


def ok_totals(df: DataFrame, status: str, ok) -> DataFrame:
    good = F.col(status) == F.lit(ok)
    return df.agg(F.count_if(good).alias("ok"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"))


def lag_summary(metrics: DataFrame, topic_pattern: str) -> DataFrame:
    """Per sampling time: total lag, total consumed and members, over rows of matching topics.

    ``lag`` and ``consumed`` are text and each counts where it is a whole number; a row counts as a member where it names one.
    """
    def whole(c):
        return F.coalesce(F.sum(F.when(F.col(c).rlike(r"^[0-9]+$"), F.col(c).try_cast("long"))), F.lit(0).cast("long"))
    return metrics.where(F.col("topic").rlike(topic_pattern)).groupBy("sampledAt").agg(
        whole("lag").alias("totalLag"), whole("consumed").alias("totalConsumed"),
        F.count_if(F.col("member") != "-").alias("members"))


def max_lag(summary: DataFrame) -> DataFrame:
    return summary.agg(F.max("totalLag").alias("maxLag"))


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys where null equals null, as in grouping."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    rest = [F.col(f"{side}.{c}") for side, d in (("l", left), ("r", right)) for c in d.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), same, how).select(
        *[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], *rest)


def period_stats(samples: DataFrame, params: EpisodeParams = EpisodeParams(), *, as_of=None,
                 rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Per user and day: watched seconds, share of good time, episodes started, their durations.

    The time between two samples of a segment belongs to the day and label of the earlier one; a
    silence of at least the timeout counts nothing. Durations are those of ended episodes.
    """
    rows = ep.judged(samples)
    split = ep.split_sessions(rows, rows_per_part)
    x = ep.row_runs(rows, params, split).where(~F.col("segment_start"))
    gap = F.col("ms") - F.col("prev.ms")
    def day(ts):
        return F.date_trunc("day", ts)
    watched = x.groupBy(F.col("prev.user").alias("userId"),
                        day(instants.from_millis(F.col("prev.ms"))).alias("periodStart")).agg(
        F.sum(gap).alias("validMs"), F.sum(F.when(~F.col("prev.bad"), gap).otherwise(0)).alias("goodMs"))
    pieces = ep.run_pieces(samples, params, rows_per_part, split)
    eps = ep.finished(pieces, ep.as_of_ms(samples, as_of)).withColumn("periodStart", day("startedAt"))
    totals = [F.count(F.lit(1)).alias("n"), F.count("endedAt").alias("ended"),
              F.sum(F.unix_millis("endedAt") - F.unix_millis("startedAt")).alias("endedMs")]
    keys = ["userId", "periodStart"]
    eps = durable(eps)
    medians = exact_percentiles(eps, keys, "durationSeconds", [0.5])
    started = _same_keys(eps.groupBy(*keys).agg(*totals), medians, keys, "left").withColumn("median", F.col("percentiles")[0])
    j = _same_keys(watched, started, keys, "full_outer").withColumns({
        "validMs": F.coalesce("validMs", F.lit(0).cast("long")), "n": F.coalesce("n", F.lit(0).cast("long"))})
    valid = F.col("validMs") / F.lit(1000.0)
    has_time = F.col("validMs") > 0
    return j.select(
        "userId", "periodStart", (F.col("periodStart") + F.expr("interval 1 day")).alias("periodEnd"),
        valid.alias("validSeconds"),
        F.when(has_time, F.col("goodMs") / F.col("validMs")).alias("normalRatio"),
        F.col("n").cast("int").alias("collapseCount"),
        F.when(has_time, F.col("n") * F.lit(3600.0) / valid).alias("collapsePerHour"),
        F.when(F.col("ended") > 0, F.col("endedMs") / (F.col("ended") * F.lit(1000.0))).alias("avgDurationSeconds"),
        F.col("median").alias("medianDurationSeconds"))
