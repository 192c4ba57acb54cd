import csv
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.test_episodes import BASE, frame, parse, sec
from tidewatch.functions import instants
from tidewatch.operators import episodes as E
from tidewatch.operators import ingest, pilot, sessions, state_view, timeshift
from tidewatch.sources import files


def values(spark, texts, fn):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn(F.col("t"))).collect()]


def test_parse_instant(spark):
    texts = ["2026-09-25T14:54:17.909678710Z", "2026-01-01T09:00:00+09:00", "2026-01-01T00:00:03Z", "2026-01-01",
             "12:30", "2026-01-01T00:00:00", "not-a-timestamp", "1700000000", None, "", "2026-13-01T00:00:00Z"]
    got = values(spark, texts, lambda c: F.unix_micros(instants.parse_instant(c)))
    def micros(*args):
        return int(datetime(*args, tzinfo=timezone.utc).timestamp()) * 1_000_000
    assert got == [micros(2026, 9, 25, 14, 54, 17) + 909678, micros(2026, 1, 1), micros(2026, 1, 1, 0, 0, 3)] + [None] * 8


def test_format_instants(spark):
    texts = ["2026-01-01T00:00:03.032994Z", "2026-01-01T00:00:03Z", None]
    assert values(spark, texts, lambda c: instants.sql_text(instants.parse_instant(c))) == [
        "2026-01-01 00:00:03.032994", "2026-01-01 00:00:03", None]
    same = ["2026-01-01T00:00:03.03299Z", "2026-01-01T00:00:03Z", "2026-01-01T00:00:03.032994000Z", "2026-01-01T00:00:03.5+00:00"]
    assert values(spark, same, lambda c: instants.iso_like(instants.parse_instant(c), c)) == same


GOOD = {"sessionId": "s", "userId": "u", "featureVector": [0.1, 0.2, 0.3], "deviationScore": 0.42, "ruleStatus": "NORMAL"}


@pytest.mark.parametrize("change,fields", [
    ({}, set()), ({"ruleStatus": "UNKNOWN"}, {"ruleStatus"}), ({"featureVector": []}, {"featureVector"}),
    ({"featureVector": None}, {"featureVector"}), ({"sessionId": " ", "userId": None}, {"sessionId", "userId"}),
    ({"deviationScore": None}, {"deviationScore"}), ({"deviationScore": 1.01}, {"deviationScore"}),
    ({"deviationScore": float("nan")}, {"deviationScore"}), ({"deviationScore": 0.0, "ruleStatus": "COLLAPSED"}, set())])
def test_validation(spark, change, fields):
    df = spark.createDataFrame([GOOD | change], "sessionId string, userId string, featureVector array<double>, "
                                                "deviationScore double, ruleStatus string")
    row = ingest.validate_summary(df).first()
    assert (set(row.errors), row.accepted) == (fields, not fields)


def test_decode(spark):
    messages = [json.dumps(GOOD | {"capturedAt": "2026-01-01T00:00:00Z"}), "{oops", json.dumps(GOOD | {"deviationScore": "0.8"}),
                json.dumps(GOOD | {"featureVector": [1, "x"]}), json.dumps({"other": 1}), "[1]", "", None]
    df = ingest.decode_events(spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "seq int, value string"))
    rows = df.orderBy("seq").collect()
    assert [r.decoded for r in rows] == [True, False, True, True, True, False, False, False]
    assert rows[0].features == [0.1, 0.2, 0.3] and sec(rows[0].capturedAt) == 0
    assert rows[2].deviationScore is None and rows[2].sessionId == "s" and rows[3].features is None
    assert ingest.accepted_only(df).count() == 4 and ingest.undecodable(df).count() == 4


def capture(**fields):
    return {c: "" for c in pilot.ALL_COLUMNS} | {
        "capture_id": "c1", "participant_code": "P01", "started_at": "2026-01-01T00:00:00.250Z", "elapsed_ms": "100.4",
        "delta_head_gap": "0.1", "delta_offset": "0.2", "delta_tilt": "0.3", "rule_score": "0.5"} | fields


def write_csv(path, rows):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.DictWriter(f, [*pilot.ALL_COLUMNS, "extra"])
        w.writeheader()
        w.writerows([r | {"extra": "x"} for r in rows])


def test_capture_files(spark, tmp_path):
    one = [capture(activity="first", sample_index="3.0", pose_detected="1", landmarks_json='{"a": [1, "b"]}'),
           capture(activity="second", pose_detected=" 1 ", target_sample_hz="25")]
    write_csv(tmp_path / "1.csv", one)
    write_csv(tmp_path / "2.csv", [capture(capture_id="c2", participant_code="P02", pose_detected="0", rule_score="",
                                           rule_prediction="deviation")])
    rows = files.read_captures(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")])
    typed = pilot.type_rows(rows).orderBy("seq").collect()
    assert len(pilot.ALL_COLUMNS) == 55
    assert [r.pose_detected for r in typed] == [True, True, False]
    assert (typed[0].sample_index, typed[0].landmarks_json, typed[0].width) == (3, '{"a": [1, "b"]}', None)
    meta = {r.capture_id: (r.activity, r.sample_count) for r in pilot.pilot_sessions(rows).collect()}
    assert meta == {"c1": ("first", 2), "c2": (None, 1)}
    x = pilot.pilot_to_summary(rows).orderBy("seq").collect()
    assert [(r.deviationScore, r.ruleStatus, r.sampleRateHz, round(sec(r.capturedAt), 3)) for r in x] == [
        (0.5, "NORMAL", 10.0, 0.35), (0.5, "NORMAL", 25.0, 0.35), (0.0, "COLLAPSED", 10.0, 0.35)]
    assert pilot.first_sessions(rows, 1).count() == 2
    files.write_captures(rows.drop("extra"), str(tmp_path / "copy"))
    again = files.read_captures(spark, str(tmp_path / "copy"))
    order = ["capture_id", "activity"]
    assert (pilot.type_rows(again).drop("seq").orderBy(*order).collect()
            == pilot.type_rows(rows).drop("seq").orderBy(*order).collect())


def test_upserts_of_captures(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, pilot.replace_rows(old, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, pilot.insert_absent(old, new, "k").collect())) == [("a", 1), ("b", 2), ("c", 4)]
    assert [tuple(r) for r in sessions.orphans(new, old, "k").collect()] == [("c", 1)]


def test_rebase(spark):
    df = spark.createDataFrame(
        [("s1", "2026-01-01T00:00:00.123Z", "n/a"), ("s2", "2026-01-01T00:00:05Z", "2026-01-01T00:00:04.5Z"), ("s1", "", "")],
        "sessionId string, capturedAt string, endedAt string")
    to = F.lit("2026-06-01 00:00:00").cast("timestamp")
    got = timeshift.rebase_time(df, to).collect()
    assert [(r.capturedAt, r.endedAt) for r in got] == [
        ("2026-05-31T23:59:55.123Z", "n/a"), ("2026-06-01T00:00:00Z", "2026-05-31T23:59:59.5Z"), ("", "")]
    assert got[0].sessionId == got[2].sessionId != got[1].sessionId and len(got[0].sessionId) == 36
    other = df.withColumnRenamed("capturedAt", "when").drop("endedAt")
    assert timeshift.time_columns(other) == ["when"]


def test_replicate(spark):
    df = spark.createDataFrame([tuple(capture(head_gap=g).values()) + (i,) for i, g in enumerate(["1.5", "", "x"])],
                               [*pilot.ALL_COLUMNS, "seq"])
    for block in (1000, 2):
        x = timeshift.replicate_sessions(df, 5, ["P1", "P2"], jitter=0.01, gap_seconds=120, block=block)
        rows = x.orderBy("copy", "seq").collect()
        assert len(rows) == 15 and len({r.capture_id for r in rows}) == 5
        assert [r.participant_code for r in rows[::3]] == ["P1", "P2", "P1", "P2", "P1"]
        assert [r.started_at for r in rows[::3]][:2] == ["2026-01-01T00:00:00.250Z", "2026-01-01T00:02:00.250Z"]
        gaps = [float(r.head_gap) for r in rows[::3]]
        assert all(abs(g - 1.5) <= 0.01 for g in gaps) and len(set(gaps)) == 5
        assert [rows[1].head_gap, rows[2].head_gap] == ["", "x"]


def test_partition_pruning_and_pushdown(spark, tmp_path):
    df = frame(spark, parse("s1 W0 W3.5 N4 N7.5")).unionByName(
        frame(spark, [("s2", "N", 90_000)]))
    path = str(tmp_path / "landed")
    files.write_by_date(df, path, rebalance=True)
    back = files.read_by_date(spark, path, first="2026-01-02")
    assert back.count() == 1
    plan = files.session_lookup(back, "s2")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(sessionId), EqualTo(sessionId,s2)]" in plan
    assert "eventDate" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files.check_roundtrip(ingest.with_event_date(df), files.read_by_date(spark, path))
    with pytest.raises(ValueError):
        files.check_roundtrip(ingest.with_event_date(df.limit(2)), files.read_by_date(spark, path))


def states(spark, text, as_of):
    x = state_view.session_states(frame(spark, parse(text)), as_of=BASE + timedelta(seconds=as_of))
    return [(r.state, r.alertCount, None if r.since is None else sec(r.since)) for r in x.collect()]


def test_states(spark):
    assert states(spark, "s W0", 1) == [("SUSPECT", 0, 0)]
    assert states(spark, "s W0 W3.5", 4) == [("BAD", 1, 0)]
    assert states(spark, "s W0 W3.5 W63.6 N64", 65) == [("RECOVERING", 2, 64)]
    assert states(spark, "s W0 W3.5 N4 N7.5", 8) == []
    assert states(spark, "s W0 W3.5", 1000) == []
    assert state_view.state_changes(frame(spark, [("s", "N", i / 10) for i in range(100)])).isEmpty()


def test_restore_only_fresh_state_of_the_same_session(spark):
    stored = state_view.session_state(frame(spark, parse("s1 W0 W3.5")), as_of=BASE + timedelta(seconds=5))
    def look(session, user, t):
        first = spark.createDataFrame([(session, user, BASE + timedelta(seconds=t))],
                                      "sessionId string, userId string, capturedAt timestamp")
        r = state_view.restore(stored, first, 300).first()
        return r.restored, r.discarded, r.alertCount
    assert look("s1", "u-s1", 303.5) == (True, False, 1)
    assert look("s1", "u-s1", 303.6) == (False, True, None)
    assert look("s2", "u-s1", 6) == (False, True, None)
    assert look("s2", "u-s2", 6) == (False, False, None)


def test_recent_and_active(spark):
    rows = [(f"s{k}", m, t + 100 * k) for k in range(5) for _, m, t in parse("x W0 W3.5 N4 N7.5")]
    eps = E.episodes(frame(spark, rows), as_of=BASE)
    assert [r.sessionId for r in E.episodes_recent(eps, 3).collect()] == ["s2", "s3", "s4"]
    assert len(E.episodes_recent(eps, 0).collect()) == 1 and E.episodes_active(eps).isEmpty()


def test_expiry(spark):
    rows = [("stale", "W", 0), ("stale", "W", 3.5), ("fresh", "N", 390)]
    got = E.session_expiry(frame(spark, rows), as_of=BASE + timedelta(seconds=400)).collect()
    assert [(r.sessionId, sec(r.lastSeenAt), sec(r.episodeStartedAt)) for r in got] == [("stale", 3.5, 0)]
    assert E.session_expiry(frame(spark, [("s", "N", 0)]), as_of=BASE + timedelta(seconds=100)).isEmpty()
