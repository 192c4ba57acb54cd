"""The live path: messages to outcomes in one stream, against the batch operators; scoring without window arrays."""

import json
import os
import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_episodes import BASE, sec
from tests.test_scoring import samples
from tidewatch.catalog.adapters import fixed_model
from tidewatch.operators import episodes as E
from tidewatch.operators import ingest, pilot, scoring
from tidewatch.schemas import EpisodeParams
from tidewatch.sources import topics
from tidewatch.streaming import buckets
from tidewatch.streaming.episodes_stream import outcome_stream, stored_state
from tidewatch.streaming.live import live_outcomes

PARAMS = EpisodeParams(3, 3, 10, 60)


def message(session, t, score, vector=(0.1, 0.2, 0.3)):
    at = (BASE + timedelta(seconds=t)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    return json.dumps({"schemaVersion": 1, "sessionId": session, "userId": "u-" + session, "capturedAt": at, "serverReceivedAt": at,
                       "featureVector": list(vector), "deviationScore": score, "ruleStatus": "NORMAL", "sampleRateHz": 10.0})


class Folder:
    """Files of messages, one per micro-batch, and the outcomes of the live path over them."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0
        os.makedirs(self.path + "/in")

    def add(self, lines):
        name = f"{self.path}/in/{self.n:03d}.txt"
        with open(name, "w") as f:
            f.write("\n".join(lines) + "\n")
        os.utime(name, (1_700_000_000 + self.n,) * 2)
        self.n += 1

    def run(self, model=None, **how):
        raw = topics.in_file_order(topics.read_message_files(self.spark, self.path + "/in", 1))
        out = live_outcomes(raw, PARAMS, model, **how)
        (out.writeStream.format("parquet").option("path", self.path + "/out").option("checkpointLocation", self.path + "/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
        return self.spark.read.schema(out.schema).parquet(self.path + "/out")


def shown(df):
    return sorted((r.sessionId, r.type, sec(r.startedAt), sec(r.at), r.alertCount, r.recovered) for r in df.collect())


@pytest.mark.parametrize("model", [None, fixed_model(3)], ids=["rule", "model"])
def test_five_micro_batches_equal_the_batch(spark, tmp_path, model):
    rng, folder, lines, t = random.Random(4), Folder(spark, tmp_path), [], 0.0
    for i in range(500):
        t += rng.choice([0.2, 0.5, 1, 2, 9])
        vector = ["x"] if i % 17 == 0 else [rng.random(), str(rng.random()), 1]
        lines.append("{broken" if i % 23 == 0 else message(f"s{rng.randrange(5)}", t, rng.choice([0.1, 0.5, 0.9, None]), vector))
    for i in range(0, 500, 100):
        folder.add(lines[i:i + 100])
    got = folder.run(model, delay="0 seconds")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq long, value string")
    scored = scoring.score_samples(ingest.accepted_only(ingest.decode_events(rows)), model)
    want = shown(E.episode_outcomes(scored, PARAMS))
    assert len(want) > 20 and shown(got) == want
    assert model is None or scored.where("model = 'fixed-lstm'").count() > 100


def test_late_samples_pass_both_states(spark, tmp_path):
    folder = Folder(spark, tmp_path)
    folder.add([message("a", 1000, 0.1), message("b", 1000, 0.9)])
    folder.add([message("a", 1001, 0.1)])
    folder.add([message("t", 5, 0.9), message("t", 9, 0.9), message("b", 1004, 0.9)])
    got = shown(folder.run(delay="0 seconds"))
    assert ("t", "EVENT_STARTED", 5, 9, 1, False) in got and ("t", "EVENT_ENDED", 5, 9, 1, False) in got
    assert ("b", "EVENT_STARTED", 1000, 1004, 1, False) in got


def test_arrival_order(spark, tmp_path):
    text = ["ü" * (i % 5) + str(i) for i in range(2000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(text) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = topics.in_file_order(spark.read.text(str(tmp_path / "in"))).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [r.value for r in rows] == text and len({tuple(r.seq) for r in rows}) == 2000
    topic = spark.createDataFrame([(b"x", 0, 5), (b"y", 0, 4)], "value binary, partition int, offset long")
    assert [bytes(r.value) for r in topics.in_arrival_order(topic).orderBy("seq").collect()] == [b"y", b"x"]


def test_captures_with_struct_order_become_episodes(spark):
    rows = [(f"c{i % 2}", "p", "2026-01-01T00:00:00Z", str(i * 1000), "0.9" if i % 40 < 20 else "0.1", i) for i in range(120)]
    df = spark.createDataFrame(rows, "capture_id string, participant_code string, started_at string, elapsed_ms string, rule_score string, n int")
    blank = [F.lit("").alias(c) for c in ("delta_head_gap", "delta_offset", "delta_tilt", "rule_prediction", "target_sample_hz")]
    df = df.select("*", *blank, F.struct(F.lit("f").alias("file"), F.col("n").alias("row")).alias("seq"))
    got = E.episodes(scoring.score_samples(pilot.pilot_to_summary(df)), PARAMS)
    assert got.where("sessionId = 'c0'").count() == 3


def test_scoring_sends_no_window_arrays(spark):
    df = samples(spark, [[i, 1, 2] for i in range(30)])
    for model in (None, fixed_model(2)):
        plan = scoring.score_samples(df, model)._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_pieces_of_a_session_score_as_the_whole():
    rng, model = np.random.default_rng(3), fixed_model(4)
    vectors, valid = rng.normal(size=(60, 3)), rng.random(60) < 0.8
    whole = scoring.WindowScorer(model, 10).score(vectors[valid], valid)
    for cuts in ([0, 60], [0, 1, 2, 30, 60], list(range(61))):
        scorer, held, p = scoring.WindowScorer(model, 10), [], []
        for a, b in zip(cuts, cuts[1:]):
            h, q = scorer.score(vectors[a:b][valid[a:b]], valid[a:b])
            held += h.tolist()
            p += q
        assert held == whole[0].tolist()
        assert all((x is None) == (y is None) and (x is None or np.allclose(x, y)) for x, y in zip(p, whole[1], strict=True))
    for i in np.flatnonzero(valid):
        own = vectors[:i + 1][valid[:i + 1]][-10:]
        assert (whole[1][i] is None) if len(own) < 10 else np.allclose(whole[1][i], model.probabilities(own[None])[0])


def test_sessions_share_keyed_state(spark, tmp_path):
    """A key costs calls between Spark and Python, so their number may not grow with the sessions."""
    rows = spark.range(1500).select(F.concat(F.lit("s"), "id").alias("sessionId"), F.lit("u").alias("userId"), F.col("id").alias("seq"),
                                    F.lit(BASE).cast("timestamp").alias("capturedAt"), F.lit("WARNING").alias("inferredStatus"))
    rows.write.parquet(str(tmp_path / "in"))
    out = outcome_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), PARAMS, delay="1 hour")
    (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
     .trigger(availableNow=True).start().awaitTermination())
    kept = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "judgment").load(str(tmp_path / "checkpoint"))
    assert kept.count() <= buckets.BUCKETS < 1500
    assert stored_state(spark, str(tmp_path / "checkpoint")).select("session").distinct().count() == 1500


@pytest.mark.parametrize("model", [None, fixed_model(3)], ids=["rule", "model"])
def test_all_sessions_in_one_bucket(spark, tmp_path, monkeypatch, model):
    monkeypatch.setattr(buckets, "BUCKETS", 1)
    test_five_micro_batches_equal_the_batch(spark, tmp_path, model)


def test_timers_of_sessions_in_one_bucket(spark, tmp_path, monkeypatch):
    from tests import test_streaming
    monkeypatch.setattr(buckets, "BUCKETS", 1)
    test_late_samples_pass_both_states(spark, tmp_path / "late")
    test_streaming.test_scenarios_over_micro_batches(spark, tmp_path / "scenarios")
    test_streaming.test_a_stored_snapshot_starts_a_new_stream(spark, tmp_path / "stored")
