"""Results must not depend on whether, and where, a large key is cut."""

import random
import statistics
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.fold import fold_session
from tests.test_episodes import BASE, BASE_MS, frame, random_sequences
from tidewatch.operators import episodes as E
from tidewatch.operators import marts, scoring, state_view
from tidewatch.plans.ordered import plan_split
from tidewatch.schemas import EpisodeParams


@pytest.fixture(scope="module")
def skewed(spark):
    """One session holds most rows, with repeated times; the others are short."""
    rng = random.Random(3)
    rows = random_sequences(11, 30, 12)
    rows += [("hot", "W" if rng.random() < 0.5 else "N", (i // 3) * 0.9) for i in range(1500)]
    df = frame(spark, rows).cache()
    df.count()
    yield df
    df.unpersist()


def rows(df):
    return sorted(map(str, df.collect()))


def test_parts_cover_the_order(spark, skewed):
    x = E.judged(skewed)
    split = plan_split(x, "session", ("us", "seq"), 100)
    assert split.hot
    parts = (split.assign(x).where("session = 'hot'").groupBy("_part")
             .agg(F.min(F.struct("us", "seq")).alias("lo"), F.max(F.struct("us", "seq")).alias("hi"),
                  F.count("*").alias("n")).orderBy("_part").collect())
    assert len(parts) > 5 and sum(p.n for p in parts) == 1500
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(parts, parts[1:]))
    assert split.assign(x).where("session <> 'hot' and _part is not null").isEmpty()


@pytest.mark.parametrize("limit", [100, 400])
def test_gaps_sequences_runs(spark, skewed, limit):
    p = EpisodeParams(2, 2, 5, 30)
    assert rows(E.sample_gaps(skewed)) == rows(E.sample_gaps(skewed, limit))
    assert rows(E.session_sequences(skewed)) == rows(E.session_sequences(skewed, limit))
    assert rows(E.label_runs(skewed, p)) == rows(E.label_runs(skewed, p, limit))


def test_state_and_period_stats(spark, skewed):
    p = EpisodeParams(2, 2, 5, 30)
    for f in (lambda n: state_view.state_changes(skewed, p, n),
              lambda n: state_view.session_states(skewed, p, rows_per_part=n),
              lambda n: marts.period_stats(skewed, p, rows_per_part=n),
              lambda n: E.episode_alerts(skewed, p, rows_per_part=n)):
        assert rows(f(10**9)) == rows(f(120))


def test_feature_windows(spark):
    rng = random.Random(5)
    data = [("hot" if i % 5 else f"s{i % 7}", BASE + timedelta(seconds=i // 2), i,
             rng.choice([["1", str(i)], ["x"], [], None, ["nan-ish"], [str(i), "2", "3", "4"]])) for i in range(900)]
    df = spark.createDataFrame(data, "sessionId string, capturedAt timestamp, seq long, featureVector array<string>")
    buffers, want = {}, {}
    for s, _, i, v in data:
        kept = buffers.setdefault(s, [])
        try:
            kept.append([float(x) for x in v or []])
        except ValueError:
            pass
        del kept[:-10]
        want[i] = [list(x) for x in kept]
    for limit in (10**9, 150, 9):
        got = {r.seq: [list(x) for x in r.window] for r in scoring.feature_windows(df, rows_per_part=limit).collect()}
        assert got == want


@pytest.mark.parametrize("limit", [10**9, 50])
def test_state_changes_equal_fold(spark, limit):
    p = EpisodeParams(3, 3, 4, 60)
    rng = random.Random(9)
    data, t = [], 0.0
    for s in range(6):
        t, bad = 0.0, False
        for _ in range(30 if s else 300):
            t += rng.choice([0.5, 1, 1.5, 2, 3, 59, 60, 61]) if rng.random() < 0.3 else 1
            bad = not bad if rng.random() < 0.25 else bad
            data.append((f"s{s}", "W" if bad else "N", t))
    df = frame(spark, data)
    want, by_session = set(), {}
    for s, label, t in data:
        by_session.setdefault(s, []).append((BASE_MS + round(t * 1000), label == "W", None))
    for s, samples in by_session.items():
        _, _, states = fold_session(samples, p, 0)
        before = (None, None, None, None, 0)
        last = None
        for (ms, _, _), state in zip(samples, states):
            if last is not None and ms - last >= p.timeout_ms:
                before = (None, None, None, None, 0)
            if state != before:
                want.add((s, ms, *state))
            before, last = state, ms
    got = state_view.state_changes(df, p, limit).select(
        "sessionId", *[F.unix_millis(c) for c in ("at", "candidateSince", "recoverySince", "episodeStartedAt", "lastAlertAt")],
        "alertCount").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("n", [1, 2, 7, 30_000])
def test_exact_percentiles(spark, n):
    rng = random.Random(n)
    values = [round(rng.expovariate(0.01), rng.choice([0, 3])) for _ in range(n)]
    df = spark.createDataFrame([(None, v) for v in values] + [("b", 1.0), ("b", 2.0)], "k string, v double")
    ps = [0.5, 0.95, 0.99]
    cuts = statistics.quantiles(values, n=100, method="inclusive") if n > 1 else [values[0]] * 99
    want = {None: [cuts[49], cuts[94], cuts[98]], "b": [1.5, 1.95, 1.99]}
    got = {r.k: list(r.percentiles) for r in marts.exact_percentiles(df, ["k"], "v", ps).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)
    only = marts.exact_percentiles(df.where("k is null"), [], "v", ps).first().percentiles
    assert list(only) == pytest.approx(want[None], rel=1e-12)


def test_percentiles_of_many_tasks_ties_and_small_groups(spark):
    """A group over all tasks, one value that is half of it, groups of one row, and nulls."""
    rng = random.Random(2)
    values = [7.0] * 6000 + [round(rng.uniform(0, 14), 2) for _ in range(6000)]
    data = [("hot", v) for v in values] + [(f"s{i}", float(i)) for i in range(300)] + [("none", None), ("hot", None)]
    df = spark.createDataFrame(data, "k string, v double")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = {r.k: list(r.percentiles) for r in marts.exact_percentiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.999, 1.0]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    import numpy as np
    assert len(got) == 301 and all(got[f"s{i}"] == [float(i)] * 5 for i in range(300))
    assert got["hot"] == pytest.approx(np.percentile(values, [0, 10, 50, 99.9, 100]).tolist(), rel=1e-12)


def test_one_key_in_twenty_thousand_parts(spark):
    rng = random.Random(7)
    data = [("hot", "W" if rng.random() < 0.5 else "N", i * 0.9) for i in range(40_000)] + [("cold", "W", 1.0)]
    df = frame(spark, data)
    x = E.judged(df)
    split = plan_split(x, "session", ("us", "seq"), 2)
    parts = split.assign(x).groupBy("session", "_part").count()
    assert parts.where("session = 'hot'").agg(F.count("*"), F.max("count")).first() == (20_000, 2)
    p = EpisodeParams(2, 2, 5, 30)
    assert rows(E.sample_gaps(df, 2)) == rows(E.sample_gaps(df))
    assert rows(E.label_runs(df, p, 2)) == rows(E.label_runs(df, p))


def test_alerts_of_one_episode_over_many_parts(spark):
    """An alert of every second sample, in 200 parts that each hold some, and with parts shorter than the interval."""
    n = 40_000
    df = frame(spark, [("s", "W", i) for i in range(n)] + [("t", "W", 0), ("t", "W", 2)])
    for params, limit in ((EpisodeParams(1, 1, 2, 10**6), n // 200), (EpisodeParams(1, 1, 1500, 10**6), 400), (EpisodeParams(1, 1, 0, 10**6), 5000)):
        got = E.episodes(df, params, rows_per_part=limit).where("sessionId = 's'").first()
        want = fold_session([(BASE_MS + i * 1000, True, None) for i in range(n)], params, 0)[1][0]
        assert (got.alertCount, int((got.lastAlertAt - got.startedAt).total_seconds())) == (want["alerts"], (want["last_alert"] - want["start"]) // 1000)


def test_composed_tables_equal_the_walk():
    from tidewatch.operators import alerts
    import numpy as np
    rng = random.Random(6)
    for _ in range(400):
        times = sorted(rng.sample(range(200), rng.randint(2, 60)))
        interval = rng.choice([0, 1, 3, 10, 40, 150])
        cut = rng.randint(1, len(times) - 1)
        parts = [[np.asarray(c) for c in alerts._chain_table(np.asarray(t), interval)] for t in (times[:cut], times[cut:])]
        starts, ends, counts = alerts._composed(*parts, interval)
        for last in range(times[0] - interval - 3, times[0]):
            found = alerts._walk(times, last, interval) if interval else [t for t in times if t >= last]
            i = int(np.searchsorted(starts, last + interval))
            assert (i < len(starts)) == bool(found)
            assert not found or (ends[i], counts[i]) == (found[-1], len(found))
