"""Reports of loads and streams, referential checks of splits, and one parse per message."""

import json
import os

from pyspark.sql import functions as F

from tests.test_episodes import BASE, COLUMNS, frame
from tidewatch.operators import ingest, scoring, sessions
from tidewatch.schemas import SUMMARY_MESSAGE, EpisodeParams
from tidewatch.sources import loads
from tidewatch.streaming.episodes_stream import outcome_stream

TEXTS = ['{"sessionId":"a"}', "{}", "[]", "[1]", '[{"sessionId":"a"}]', "null", "5", '"x"', "", "  ", ' {"sessionId":"b"} ', '{"sessionId":"a"',
         '{"deviationScore":"0.5","sessionId":"c"}', '{"featureVector":5}', '{"sessionId":{"a":1}}', "{a:1}", "{'sessionId':'q'}", '{"sessionId":"a"} trailing',
         '{"sessionId":"a"}{"x":1}', None, '{"sessionId":"a",}', '{"deviationScore":NaN}', '﻿{"sessionId":"a"}', '{"schemaVersion":1.5,"userId":"u"}']


def test_decoded_as_by_a_parse_of_its_own(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, value string")
    want = df.withColumn("_m", F.from_json("value", SUMMARY_MESSAGE)).select("i", "value", F.json_object_keys("value").isNotNull().alias("decoded"), "_m.*")
    got = ingest.decode(df, SUMMARY_MESSAGE)
    assert got.columns == want.columns
    for a, b in zip(got.orderBy("i").collect(), want.orderBy("i").collect(), strict=True):
        assert a.decoded == b.decoded and (a == b or not a.decoded), a.value


def test_load_report(spark, tmp_path):
    report = loads.LoadReport(spark)
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    assert report.run("all", df, lambda rows: rows.write.parquet(str(tmp_path / "a"))) == 1000
    assert report.run("none", df.where("x > 9"), lambda rows: rows.write.parquet(str(tmp_path / "b"))) == 0
    rows = report.table().collect()
    assert [(r.step, r.rows) for r in rows] == [("all", 1000), ("none", 0), ("total", 1000)]
    assert all(r.seconds > 0 and abs(r.rowsPerSecond * r.seconds - r.rows) < 1e-6 for r in rows)
    assert report.table(None).count() == 2 and spark.read.parquet(str(tmp_path / "a")).count() == 1000


def test_stream_totals_per_micro_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    marks = [[("s", "WARNING", 0), ("s", "WARNING", 4), ("t", "WARNING", 4)], [("s", "NORMAL", 5), ("s", "NORMAL", 9), ("t", "WARNING", 9)], [("z", "NORMAL", 900)]]
    n = 0
    for k, rows in enumerate(marks):
        lines = []
        for s, label, t in rows:
            lines.append(json.dumps({"sessionId": s, "userId": "u", "capturedAt": f"{BASE.date()}T00:{t // 60:02d}:{t % 60:02d}Z", "seq": n, "inferredStatus": label}))
            n += 1
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k,) * 2)
    raw = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = loads.RunMetrics()
    spark.streams.addListener(seen)
    try:
        out = loads.with_outcome_totals(outcome_stream(raw, EpisodeParams(), delay="0 seconds"))
        run = (out.writeStream.queryName("totals").format("parquet").option("path", str(tmp_path / "out"))
               .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        run.awaitTermination()
        assert seen.wait_for(run.runId)
        rows = seen.table(spark).where("query = 'totals'").collect()
    finally:
        spark.streams.removeListener(seen)
    by_batch = {r.batch: (r.rows, r.started, r.recovered, r.finalisedEpisodes) for r in rows}
    assert by_batch[0] == (3, 1, 0, 0) and by_batch[1] == (3, 1, 1, 0)
    assert sum(r.rows for r in rows) == 7 and sum(r.finalisedEpisodes for r in rows) == 1
    assert all(r.seconds > 0 for r in rows)


def test_splits_of_unknown_captures(spark):
    rows = frame(spark, [("a", "N", 0), ("b", "N", 0), ("b", "N", 1)])
    splits = scoring.dataset_splits(rows, "sessionId")
    known = spark.createDataFrame([("a",)], "captureId string")
    assert [tuple(r) for r in sessions.orphans(splits, known, "captureId").collect()] == [("b", 1)]
