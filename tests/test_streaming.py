import json
import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_episodes import BASE, BASE_MS, COLUMNS, SCENARIOS, frame, parse, sec
from tidewatch.operators import episodes as E
from tidewatch.operators import scoring, sessions, state_view
from tidewatch.schemas import EpisodeParams
from tidewatch.sources import tables, topics
from tidewatch.streaming.episodes_stream import outcome_stream, state_rows, stored_state
from tidewatch.streaming.landing import land, land_all, land_batch, landed, rejected
from tidewatch.streaming.scoring_stream import score_stream


class Feed:
    """A folder of JSON files read as a stream, one file per micro-batch, and its output."""

    def __init__(self, spark, path, params=EpisodeParams(), delay="0 seconds"):
        self.spark, self.path, self.params, self.delay = spark, str(path), params, delay
        os.makedirs(self.path + "/in")
        self.count = self.seq = 0
        self.initial = None

    def add(self, rows):
        """rows: (session, label, offset seconds)"""
        name = f"{self.path}/in/{self.count:04d}.json"
        with open(name, "w") as f:
            for s, label, t in rows:
                at = (BASE + timedelta(seconds=t)).isoformat()
                f.write(json.dumps({"sessionId": s, "userId": "u-" + s, "capturedAt": at, "seq": self.seq,
                                    "inferredStatus": {"W": "WARNING", "N": "NORMAL"}[label]}) + "\n")
                self.seq += 1
        os.utime(name, (1_700_000_000 + self.count, 1_700_000_000 + self.count))
        self.count += 1

    def run(self):
        """Take all new files and stop; a second call starts from the checkpoint."""
        raw = (self.spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).json(self.path + "/in"))
        out = outcome_stream(raw, self.params, delay=self.delay, initial=self.initial)
        (out.writeStream.format("parquet").option("path", self.path + "/out")
         .option("checkpointLocation", self.path + "/checkpoint").trigger(availableNow=True).start().awaitTermination())
        got = self.spark.read.schema(out.schema).parquet(self.path + "/out").collect()
        return sorted([(r.sessionId, r.type, sec(r.startedAt), sec(r.at), r.alertCount, r.recovered) for r in got],
                      key=lambda r: (r[0], r[3], r[1] == "EVENT_ENDED"))


def test_scenarios_over_micro_batches(spark, tmp_path):
    """All scenarios as sessions of one stream; a last sample of another session moves the clock."""
    feed, want = Feed(spark, tmp_path), []
    todo = []
    for i, (text, as_of, expected) in enumerate(SCENARIOS):
        rows = [(f"c{i}", label, t) for _, label, t in parse(text)]
        todo.append(rows)
        if rows[-1][2] + 300 <= 500 and not any(e[1] == "EVENT_ENDED" for e in expected) and expected:
            # The stream's clock passes the timeout of every session, so open episodes are closed.
            last = expected[-1]
            expected = [*expected, (last[0], "EVENT_ENDED", last[2], rows[-1][2], last[4], False)]
        want += [(f"c{i}", *e[1:]) for e in expected]
    for step in range(max(map(len, todo))):
        feed.add([rows[step] for rows in todo if len(rows) > step and rows[step][2] < 300])
    feed.add([r for rows in todo for r in rows if r[2] >= 300])
    feed.add([("clock", "N", 1000)])
    assert feed.run() == sorted(want, key=lambda r: (r[0], r[3], r[1] == "EVENT_ENDED"))


def test_restart_continues(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.add([("s1", "W", 0), ("s1", "W", 3.5), ("s2", "W", 3.5)])
    assert feed.run() == [("s1", "EVENT_STARTED", 0, 3.5, 1, False)]
    feed.add([("s1", "W", 63.6), ("s1", "N", 64), ("s2", "W", 64)])
    assert feed.run()[1:] == [("s1", "RE_ALERT", 0, 63.6, 2, False), ("s2", "EVENT_STARTED", 3.5, 64, 1, False)]
    feed.add([("s1", "N", 67.5)])
    assert feed.run()[2] == ("s1", "EVENT_ENDED", 0, 67.5, 2, True)


def test_a_stored_snapshot_starts_a_new_stream(spark, tmp_path):
    """Each session is stopped in another state; the outcomes of both streams are those of one."""
    before = [("suspect", "W", 100), ("bad", "W", 60), ("bad", "W", 64), ("relapse", "W", 60), ("relapse", "W", 64), ("relapse", "N", 65), ("relapse", "W", 66),
              ("back", "W", 60), ("back", "W", 64), ("back", "N", 100), ("good", "N", 100), ("gone", "W", 90), ("gone", "W", 95)]
    after = [("suspect", "W", 103), ("bad", "W", 125), ("bad", "N", 126), ("bad", "N", 130), ("relapse", "W", 124), ("back", "N", 103), ("good", "W", 104), ("good", "W", 108),
             ("clock", "N", 800)]
    states = state_view.session_states(frame(spark, before), EpisodeParams())
    assert {r.sessionId for r in states.collect()} == {"suspect", "bad", "relapse", "back", "gone"}
    first = Feed(spark, tmp_path / "first")
    first.add(before)
    told = first.run()
    stored = stored_state(spark, str(tmp_path / "first" / "checkpoint"))
    assert {(r.session, r.last_ms - BASE_MS, r.alerts) for r in stored.collect()} == {
        ("suspect", 100_000, 0), ("bad", 64_000, 1), ("relapse", 66_000, 1), ("back", 100_000, 1), ("good", 100_000, 0), ("gone", 95_000, 1)}
    want = Feed(spark, tmp_path / "whole")
    want.add(before)
    want.add(after)
    expected = want.run()
    for name, initial in (("store", stored), ("snapshot", state_rows(states))):
        second = Feed(spark, tmp_path / name)
        second.initial = initial
        second.seq = len(before)
        second.add(after)
        assert sorted(told + second.run()) == sorted(expected)


def test_silence_found_by_the_next_sample(spark, tmp_path):
    """The same batch brings the sample after the silence, before any timer can fire."""
    feed = Feed(spark, tmp_path, delay="1 hour")
    feed.add([("s", "W", 0), ("s", "W", 4)])
    feed.add([("s", "W", 400), ("s", "W", 403)])
    assert feed.run() == [("s", "EVENT_STARTED", 0, 4, 1, False), ("s", "EVENT_ENDED", 0, 4, 1, False),
                          ("s", "EVENT_STARTED", 400, 403, 1, False)]


def test_stream_equals_batch_on_ordered_input(spark, tmp_path):
    rng = random.Random(1)
    rows, t = [], 0.0
    for _ in range(1500):
        t += rng.choice([0.1, 0.5, 1, 2, 20])
        rows.append((f"s{rng.randrange(6)}", "W" if rng.random() < 0.6 else "N", round(t, 1)))
    params = EpisodeParams(5, 4, 15, 90)
    feed = Feed(spark, tmp_path, params)
    for i in range(0, len(rows), 300):
        feed.add(rows[i:i + 300])
    want = [(r.sessionId, r.type, sec(r.startedAt), sec(r.at), r.alertCount, r.recovered)
            for r in E.episode_outcomes(frame(spark, rows), params).collect()]
    assert len(want) > 100
    assert feed.run() == sorted(want, key=lambda r: (r[0], r[3], r[1] == "EVENT_ENDED"))


def test_scores_on_a_stream_equal_the_batch(spark, tmp_path):
    from tests.test_scoring import COLUMNS as SAMPLE, samples
    from tidewatch.catalog.queries import fixed_model
    df = samples(spark, [[i / 9, i % 4] if i % 5 else ["x"] for i in range(40)])
    want = {r.seq: (r.inferredStatus, r.model, r.windowBuffered) for r in scoring.score_samples(df, fixed_model()).collect()}
    (tmp_path / "in").mkdir()
    for k in range(4):
        part = df.where((F.col("seq") >= 10 * k) & (F.col("seq") < 10 * k + 10)).toPandas()
        part.to_json(tmp_path / "in" / f"{k}.json", orient="records", lines=True, date_format="iso", date_unit="us")
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k,) * 2)
    raw = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for forget in (None, 3600.0):
        out = score_stream(raw, fixed_model(), forget_seconds=forget)
        path = str(tmp_path / f"out-{forget}")
        (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
        got = {r.seq: (r.inferredStatus, r.model, r.windowBuffered)
               for r in spark.read.schema(out.schema).parquet(path).collect()}
        assert got == want


def test_landing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"schemaVersion": 1, "sessionId": "s", "userId": "u", "capturedAt": "2026-01-02T00:00:00.5Z",
            "featureVector": [1, "2", 3.5], "deviationScore": 0.42, "ruleStatus": "NORMAL", "extra": 1}
    (tmp_path / "in" / "m.txt").write_text("\n".join([json.dumps(good), "{broken", json.dumps(good | {"sessionId": "t"})]))
    stream = topics.read_message_files(spark, str(tmp_path / "in"), 1)
    land(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), every=None).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("sessionId").collect()
    assert [(r.sessionId, r.featureVector, str(r.eventDate)) for r in rows] == [
        ("s", [1.0, 2.0, 3.5], "2026-01-02"), ("t", [1.0, 2.0, 3.5], "2026-01-02")]
    assert os.path.isdir(tmp_path / "out" / "eventDate=2026-01-02")


def test_topic_options():
    options = topics.topic_options("host:1", "summaries", max_offsets=5)
    assert options["subscribe"] == "summaries" and options["startingOffsets"] == "earliest"
    assert options["maxOffsetsPerTrigger"] == "5" and options["kafka.bootstrap.servers"] == "host:1"


def test_sessions_table_by_batches(spark, tmp_path):
    table = tables.sessions_table(spark, str(tmp_path / "sessions"))
    assert table.read().isEmpty()
    first = frame(spark, [("a", "N", 0), ("a", "N", 5), ("b", "N", 1)])
    second = frame(spark, [("a", "N", 9), ("c", "N", 9)]).withColumn("userId", F.lit("other"))
    write = tables.record_samples(table)
    write(first, 0)
    write(second, 1)
    write(second, 1)    # a retried batch counts once
    def state():
        return [(r.session_id, r.user_id, sec(r.started_at), sec(r.last_seen_at), r.sample_count, r.status)
                for r in table.read().orderBy("session_id").collect()]
    want = [("a", "u-a", 0, 9, 3, "ACTIVE"), ("b", "u-b", 1, 1, 1, "ACTIVE"), ("c", "other", 9, 9, 1, "ACTIVE")]
    assert state() == want
    expected = sessions.upsert_sessions(sessions.sessions_rollup(first), second).orderBy("session_id").collect()
    assert [tuple(r) for r in expected] == [tuple(r[c] for c in expected[0].asDict()) for r in table.read().orderBy("session_id").collect()]
    tables.record_expiry(table, table.read().where("session_id = 'b'"), 1)    # an id that the samples have used
    write(frame(spark, [("b", "N", 20)]), 2)
    assert state()[1] == ("b", "u-b", 1, 20, 2, "ENDED")    # never back to ACTIVE
    assert state()[0] == want[0] and state()[2] == want[2]


def test_writers_side_by_side_late_batches_and_folds(spark, tmp_path):
    path = str(tmp_path / "sessions")
    one, two = tables.sessions_table(spark, path), tables.sessions_table(spark, path)
    tables.record_samples(one)(frame(spark, [("a", "N", 0)]), 0)
    tables.record_samples(two, "other")(frame(spark, [("a", "N", 5), ("b", "N", 6)]), 0)
    tables.record_samples(one)(frame(spark, [("a", "N", 9)]), 1)

    def counts():
        return {r.session_id: (r.sample_count, sec(r.last_seen_at), r.status) for r in one.read().collect()}

    assert counts() == {"a": (3, 9, "ACTIVE"), "b": (1, 6, "ACTIVE")}
    assert one.fold("samples") == 1 and one.fold("nobody") is None
    assert counts() == {"a": (3, 9, "ACTIVE"), "b": (1, 6, "ACTIVE")}
    for i in range(2, 5):
        tables.record_samples(one)(frame(spark, [("a", "N", 10 + i)]), i)
    tables.record_expiry(two, two.read().where("session_id = 'b'"), 0)
    tables.record_expiry(two, spark.createDataFrame([("ghost",)], "session_id string"), 1)
    assert one.fold("samples") == 4 and one.fold("samples") == 4
    tables.record_samples(one)(frame(spark, [("a", "N", 14)]), 4)    # retried after it has been folded
    tables.record_samples(two, "other")(frame(spark, [("b", "N", 2)]), 1)    # an old sample that comes late
    assert counts() == {"a": (6, 14, "ACTIVE"), "b": (2, 2, "ENDED")}


def test_episode_batches_in_any_order(spark, tmp_path):
    rows = [("s", "W", 0), ("s", "W", 4), ("s", "W", 70), ("s", "N", 71), ("s", "N", 75), ("t", "W", 0), ("t", "W", 5)]
    log = E.episode_outcomes(frame(spark, rows)).cache()
    want = sorted(map(str, sessions.last_outcomes(log).collect()))
    assert log.count() == 4
    parts = [log.where("type = 'EVENT_STARTED'"), log.where("type = 'RE_ALERT'"), log.where("type = 'EVENT_ENDED'")]
    for k, order in enumerate(([0, 1, 2], [2, 0, 1], [1, 2, 0])):
        table = tables.episodes_table(spark, str(tmp_path / f"e{k}"))
        for i, part in enumerate(order):
            tables.record_outcomes(table)(parts[part], i)
            tables.record_outcomes(table)(parts[part], i)
            table.fold("outcomes") if i == 1 else None
        names = sessions.last_outcomes(log).columns
        assert sorted(map(str, table.read().select(*names).collect())) == want
    log.unpersist()


def test_landing_keeps_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"sessionId": "s", "userId": "u", "capturedAt": "2026-01-02T00:00:00Z", "featureVector": [1], "deviationScore": 0.1, "ruleStatus": "NORMAL"}

    def add(k, lines):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{k}.txt", (1_700_000_000 + k,) * 2)

    def run():
        stream = topics.read_message_files(spark, str(tmp_path / "in"), 1)
        land_all(stream, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "checkpoint"), every=None).awaitTermination()
        return landed(spark, str(tmp_path / "out")).count(), sorted(r.value for r in rejected(spark, str(tmp_path / "bad")).collect())

    add(0, [json.dumps(good), "{broken", json.dumps(good)])
    add(1, [json.dumps(good | {"capturedAt": None})])
    assert run() == (3, ["{broken"])
    add(2, ["[1]", json.dumps(good), "text"])
    assert run() == (4, ["[1]", "text", "{broken"])    # after a restart
    land_batch(str(tmp_path / "out"), str(tmp_path / "bad"))(spark.createDataFrame([("oops",), (json.dumps(good),)], "value string"), 2)
    assert run() == (4, ["oops", "{broken"])    # a retried batch replaces its folders


def test_expiry_is_strict_in_the_table(spark):
    table = sessions.sessions_rollup(frame(spark, [("a", "N", 0), ("b", "N", 0.001)]))
    now = F.lit(BASE + timedelta(seconds=300.001))
    got = sessions.expire_sessions(table, now, 300).orderBy("session_id").collect()
    assert [r.status for r in got] == ["ENDED", "ACTIVE"]


def test_late_samples(spark, tmp_path):
    feed = Feed(spark, tmp_path, delay="10 seconds")
    feed.add([("s", "W", 1000), ("s", "W", 1001)])
    feed.add([("clock", "N", 1002)])
    feed.add([("t", "W", 5), ("t", "W", 9), ("u", "W", 995), ("u", "W", 999)])
    got = feed.run()
    assert ("u", "EVENT_STARTED", 995, 999, 1, False) in got
    # Far behind the clock: still judged, and closed at once because the session counts as silent.
    assert [r[1:] for r in got if r[0] == "t"] == [("EVENT_STARTED", 5, 9, 1, False), ("EVENT_ENDED", 5, 9, 1, False)]


def test_scored_sessions_share_keyed_state(spark, tmp_path):
    from tidewatch.streaming import buckets
    rows = spark.range(3000).select(
        F.concat(F.lit("s"), F.col("id") % 1500).alias("sessionId"), F.lit("u").alias("userId"), F.col("id").alias("seq"), F.lit(BASE).cast("timestamp").alias("capturedAt"),
        F.lit(BASE).cast("timestamp").alias("serverReceivedAt"), F.array(F.lit("1")).alias("featureVector"), F.lit(0.5).alias("deviationScore"), F.lit("NORMAL").alias("ruleStatus"))
    rows.write.parquet(str(tmp_path / "in"))
    out = score_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).select("seq", "windowBuffered")
    (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
     .trigger(availableNow=True).start().awaitTermination())
    kept = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "checkpoint"))
    assert kept.count() <= buckets.BUCKETS < 1500
    assert {(r.seq < 1500, r.windowBuffered) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(True, 1), (False, 2)}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_scored_times_of_all_centuries(spark, tmp_path, zone):
    """Times go through the scorer as numbers: none, of years that pandas does not know, and of an hour that comes twice."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = [None, "1500-01-01 00:00:00.000001Z", "2024-11-03 05:30:00Z", "2024-11-03 06:30:00Z", "2500-01-01 00:00:00.123457Z", "9999-12-30 00:00:00Z"]
        rows = spark.createDataFrame([(s, at, at if s else None, seq, ["1"] if seq % 3 else ["x"]) for s in ("a", "", None) for seq, at in enumerate(times * 3)],
                                     "sessionId string, captured string, received string, seq long, featureVector array<string>")
        rows = rows.select("sessionId", F.lit("u").alias("userId"), "seq", F.col("captured").cast("timestamp").alias("capturedAt"),
                           F.col("received").cast("timestamp").alias("serverReceivedAt"), "featureVector", F.lit(0.5).alias("deviationScore"), F.lit("NORMAL").alias("ruleStatus"))
        rows = rows.withColumn("seq", F.col("seq") + F.when(F.col("sessionId") == "a", 0).when(F.col("sessionId") == "", 100).otherwise(200))
        rows.write.parquet(str(tmp_path / "in"))
        out = score_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
         .trigger(availableNow=True).start().awaitTermination())
        got, want = spark.read.schema(out.schema).parquet(str(tmp_path / "out")), scoring.score_samples(rows)
        def shown(x):
            return sorted(map(str, x.select("seq", "sessionId", "inferredStatus", "windowBuffered", F.unix_micros("capturedAt"), F.unix_micros("serverReceivedAt")).collect()))
        assert got.count() == 54 and shown(got) == shown(want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_vectors_reach_the_scorer_only_for_a_model(spark, tmp_path):
    from tests.test_scoring import COLUMNS as SAMPLE
    from tidewatch.catalog.queries import fixed_model
    raw = spark.readStream.schema(SAMPLE).json(str(tmp_path))
    for model in (None, fixed_model(2)):
        plan = score_stream(raw, model)._jdf.queryExecution().analyzed().toString()
        assert ("AS vector#" in plan) == (model is not None)
