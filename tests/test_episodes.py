import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.fold import fold_session
from tidewatch.operators import episodes as E
from tidewatch.schemas import EpisodeParams

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
BASE_MS = int(BASE.timestamp() * 1000)
COLUMNS = "sessionId string, userId string, capturedAt timestamp, seq long, inferredStatus string"


def frame(spark, rows):
    """rows: (session, label, offset seconds)"""
    return spark.createDataFrame(
        [(s, "u-" + s, BASE + timedelta(seconds=t), i, {"W": "WARNING", "N": "NORMAL"}.get(l, l))
         for i, (s, l, t) in enumerate(rows)], COLUMNS)


def sec(ts):
    return None if ts is None else (ts.replace(tzinfo=timezone.utc) - BASE).total_seconds()


def outcomes(spark, rows, as_of=None, params=EpisodeParams()):
    out = E.episode_outcomes(frame(spark, rows), params,
                             as_of=None if as_of is None else BASE + timedelta(seconds=as_of))
    return [(r.sessionId, r.type, sec(r.startedAt), sec(r.at), r.alertCount, r.recovered)
            for r in out.orderBy("at", F.col("type") == "EVENT_ENDED").collect()]


# Marks of samples (label and second) and the outcomes that the rules must give for them.
SCENARIOS = [
    ("s1 W0 W1 W2", None, []),
    ("s1 W0 W3.5", None, [("s1", "EVENT_STARTED", 0, 3.5, 1, False)]),
    ("s1 W0 W3.5 W30 W65", None,
     [("s1", "EVENT_STARTED", 0, 3.5, 1, False), ("s1", "RE_ALERT", 0, 65, 2, False)]),
    ("s1 W0 W3.5 N4 N7.5", None,
     [("s1", "EVENT_STARTED", 0, 3.5, 1, False), ("s1", "EVENT_ENDED", 0, 7.5, 1, True)]),
    ("s1 W0 W3.5 N4 W5", None, [("s1", "EVENT_STARTED", 0, 3.5, 1, False)]),
    ("s1 N0", 400, []),
    ("s1 W0 W3.5", 400,
     [("s1", "EVENT_STARTED", 0, 3.5, 1, False), ("s1", "EVENT_ENDED", 0, 3.5, 1, False)]),
    ("s1 W0 W400 W401", None, []),
    ("s1 W0 W3.5 W63.6 N64 N67.5", None,
     [("s1", "EVENT_STARTED", 0, 3.5, 1, False), ("s1", "RE_ALERT", 0, 63.6, 2, False),
      ("s1", "EVENT_ENDED", 0, 67.5, 2, True)]),
]


def parse(text):
    session, *marks = text.split()
    return [(session, m[0], float(m[1:])) for m in marks]


@pytest.mark.parametrize("text,as_of,expected", SCENARIOS)
def test_scenarios(spark, text, as_of, expected):
    assert outcomes(spark, parse(text), as_of) == expected


def test_sessions_are_independent(spark):
    rows = [("s1", "W", 0), ("s2", "W", 0), ("s1", "W", 3.5)]
    assert outcomes(spark, rows) == [("s1", "EVENT_STARTED", 0, 3.5, 1, False)]


def test_same_user_new_session_starts_from_nothing(spark):
    rows = [("s1", "W", 0), ("s2", "W", 2), ("s2", "W", 4), ("s2", "W", 5.5)]
    assert outcomes(spark, rows) == [("s2", "EVENT_STARTED", 2, 5.5, 1, False)]


def test_unknown_is_good_and_other_labels_are_bad(spark):
    rows = [("s", "COLLAPSED", 0), ("s", "", 3), ("s", "UNKNOWN", 4), ("s", None, 7)]
    assert outcomes(spark, rows) == [("s", "EVENT_STARTED", 0, 3, 1, False),
                                     ("s", "EVENT_ENDED", 0, 7, 1, True)]


def test_missing_session_and_missing_time(spark):
    df = spark.createDataFrame(
        [(None, None, BASE, 0, "BAD"), (None, None, None, 1, "NORMAL"),
         (None, None, BASE + timedelta(seconds=3), 2, "BAD")], COLUMNS)
    rows = E.episodes(df).collect()
    assert [(r.sessionId, r.userId, r.ongoing) for r in rows] == [("unknown", None, True)]


def test_ten_hertz_timeline(spark):
    rows = [("s", "N" if i < 50 or i >= 750 else "W", i / 10) for i in range(850)]
    assert outcomes(spark, rows) == [("s", "EVENT_STARTED", 5, 8, 1, False),
                                     ("s", "RE_ALERT", 5, 68, 2, False),
                                     ("s", "EVENT_ENDED", 5, 78, 2, True)]


def random_sequences(seed, sessions, length):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        t, bad = 0.0, False
        for _ in range(rng.randrange(1, length)):
            t += rng.choice([0, 0.001, 0.5, 1, 1, 2, 2.9999, 3, 5, 40, 299.999, 300, 301])
            bad = rng.random() < 0.5 if rng.random() < 0.35 else bad
            rows.append((f"s{s}", "W" if bad else "N", t))
    return rows


PARAMS = [EpisodeParams(), EpisodeParams(0, 0, 60, 300), EpisodeParams(3, 0, 0, 40),
          EpisodeParams(0, 3, 5, 300), EpisodeParams(2, 4, 1, 10_000)]


@pytest.mark.parametrize("rows_per_part", [10**9, 40, 7])
@pytest.mark.parametrize("params", PARAMS)
def test_closed_form_equals_fold(spark, params, rows_per_part):
    # With small parts nearly every session is cut, some of them many times.
    rows = random_sequences(7, 120, 60) + [
        (f"hot{k}", "W" if random.Random(i // 40 + k).random() < 0.6 else "N", i * 0.37) for k in range(2)
        for i in range(900)]
    df = frame(spark, rows).cache()
    as_of = df.agg(F.max(F.unix_millis("capturedAt"))).first()[0]
    expected_outcomes, expected_episodes = set(), set()
    by_session = {}
    for s, label, t in rows:
        # The same microsecond cut as the timestamps of the frame.
        us = round(timedelta(seconds=t).total_seconds() * 1e6)
        by_session.setdefault(s, []).append((BASE_MS + us // 1000, label == "W", "u-" + s))
    for s, samples in by_session.items():
        outs, eps, _ = fold_session(samples, params, as_of)
        expected_outcomes |= {(s, *o, i) for i, o in enumerate(outs)}
        expected_episodes |= {(s, e["start"], e["confirm"], e["end"], e["recovered"], e["alerts"],
                               e["last_alert"], j) for j, e in enumerate(eps)}
    got = E.episodes(df, params, rows_per_part=rows_per_part).select(
        "sessionId", *[F.unix_millis(c) for c in ("startedAt", "confirmedAt", "endedAt")],
        "recovered", "alertCount", F.unix_millis("lastAlertAt")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        str(e[:-1]) for e in expected_episodes)
    logged = E.episode_outcomes(df, params, rows_per_part=rows_per_part).select(
        "sessionId", "type", F.unix_millis("startedAt"), F.unix_millis("at"), "alertCount",
        "recovered").collect()
    assert sorted(map(str, map(tuple, logged))) == sorted(str(o[:-1]) for o in expected_outcomes)
    df.unpersist()


def test_one_exchange(spark):
    df = frame(spark, parse("s1 W0 W3.5 N4 N7.5"))
    plan = E.episodes(df, as_of=BASE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
