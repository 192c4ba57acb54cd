"""One query per operator over the given tables; names match ``oracle.sql()``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import adapters as A
from tidewatch.catalog.adapters import MID, PARAMS, fixed_model
from tidewatch.functions import instants
from tidewatch.operators import episodes as E
from tidewatch.operators import ingest, marts, pilot, scoring, sessions, state_view, timeshift
from tidewatch.session import scratch_path
from tidewatch.sources import files, loads, tables
from tidewatch.streaming.episodes_stream import outcome_stream, stored_state
from tidewatch.streaming.landing import land, land_all, landed, rejected
from tidewatch.streaming.live import live_outcomes
from tidewatch.streaming.scoring_stream import score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: A.plain(fn(spark, sf_dir))
    return fn


def mid():
    return F.lit(MID).cast("timestamp")


# --- ingest -------------------------------------------------------------------------------------

@query
def decode_events(spark, sf):
    x = ingest.decode_events(A.messages(A.samples(spark, sf)))
    return x.select("seq", "decoded", "schemaVersion", "sessionId", "userId", "capturedAt",
                    "serverReceivedAt", "deviationScore", "ruleStatus", "sampleRateHz",
                    F.get("features", F.lit(0)).alias("f0"), F.get("features", F.lit(2)).alias("f2"),
                    F.size("featureVector").alias("elements"))


@query
def events_by_date(spark, sf):
    return ingest.with_event_date(A.samples(spark, sf)).groupBy("eventDate").agg(
        F.count(F.lit(1)).alias("n"), F.max("seq").alias("lastSeq"))


@query
def normalise_summary(spark, sf):
    x = A.samples(spark, sf)
    received = F.col("serverReceivedAt")
    x = x.withColumn("capturedAt", F.when(F.col("event_type") != "click", F.col("capturedAt")))
    return ingest.normalise_summary(x, received).select(
        "seq", "schemaVersion", "sessionId", "capturedAt", "serverReceivedAt")


@query
def inference_view(spark, sf):
    x = A.labelled(spark, sf)
    body = F.to_json(F.struct(
        F.when(F.col("event_type") != "view", F.col("sessionId")).alias("sessionId"), "userId",
        "inferredStatus", A.iso_micros(F.col("capturedAt")).alias("capturedAt"),
        "model", F.create_map(F.lit("NORMAL"), F.lit(0.5)).alias("probabilities")))
    return ingest.inference_view(x.select("seq", body.alias("value"))).drop("value")


@query
def inference_messages(spark, sf):
    x = scoring.score_samples(A.samples(spark, sf)).withColumn(
        "userId", F.when(F.col("inferredStatus") == "BAD", "").otherwise(F.col("userId")))
    m = ingest.inference_messages(x)
    read = F.from_json("value", "sessionId string, userId string, inferredStatus string, deviationScore double,"
                                " capturedAt string, windowBuffered int, probabilities map<string,double>")
    return m.select("key", read.alias("m")).select(
        "key", "m.sessionId", "m.userId", "m.inferredStatus", "m.deviationScore", "m.capturedAt", "m.windowBuffered",
        F.col("m.probabilities").isNull().alias("noProbabilities"))


@query
def summary_messages(spark, sf):
    ok = ingest.validate_summary(A.requests(spark, sf)).where(F.col("accepted"))
    m = ingest.summary_messages(ingest.normalise_summary(ok, F.col("serverReceivedAt")))
    read = F.from_json("value", "userId string, capturedAt string, deviationScore double, featureVector array<double>")
    return m.select("key", "status", "topic", "receivedAtMillis", read.alias("m")).select(
        "key", "status", "topic", "receivedAtMillis", "m.userId", "m.capturedAt", "m.deviationScore",
        F.col("m.featureVector")[0].alias("f0"))


@query
def validate_summary(spark, sf):
    return ingest.validate_summary(A.requests(spark, sf)).select(
        "seq", "accepted", F.size("errors").alias("nErrors"))


@query
def validation_errors(spark, sf):
    return ingest.validation_errors(A.requests(spark, sf)).select("seq", "field", "message")


@query
def parse_instants(spark, sf):
    return ingest.with_instants(A.instant_texts(spark, sf))


@query
def format_instants(spark, sf):
    at = F.col("capturedAt")
    whole = F.when(F.col("event_type") == "view", F.date_trunc("second", at)).otherwise(at)
    like = F.when(F.col("event_type") == "click", "2024-01-01T00:00:00.123456789Z").when(
        F.col("event_type") == "view", "2024-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00.12Z")
    return A.samples(spark, sf).select(
        "seq", instants.sql_text(whole).alias("sqlText"), instants.iso_millis(at).alias("isoMillis"),
        instants.iso_like(at, like).alias("isoLike"))


# --- capture files ------------------------------------------------------------------------------

@query
def csv_pilot_load(spark, sf):
    path = scratch_path(spark, "captures")
    files.write_captures(A.captures(spark, sf).where(F.col("manual_label") == "BAD"), path + "/bad")
    files.write_captures(A.captures(spark, sf).where(F.col("manual_label") != "BAD"), path + "/rest")
    x = pilot.type_rows(files.read_captures(spark, [path + "/bad", path + "/rest"]))
    return x.select("capture_id", "participant_code", "started_at", "target_sample_hz", "repetition", "width",
                    "pose_training_eligible", "sample_index", "elapsed_ms", "manual_label", "measurement_quality",
                    "head_gap", "shoulder_tilt", "rule_score", "rule_prediction", "pose_detected", "landmarks_json",
                    "world_landmarks_json")


@query
def pilot_samples(spark, sf):
    return pilot.pilot_samples(A.captures(spark, sf)).select(
        "capture_id", "sample_index", "elapsed_ms", "gap_ms", "segment_id", "manual_label", "head_gap",
        "lateral_offset", "shoulder_tilt", "delta_tilt", "rule_score", "rule_prediction", "pose_detected",
        "landmark_count", "landmarks_json", "visibility")


@query
def pilot_sessions(spark, sf):
    return pilot.pilot_sessions(A.captures(spark, sf)).select(
        "capture_id", "participant_code", "schema_version", "started_at", "activity", "target_sample_hz",
        "planned_seconds", "repetition", "width", "height", "pose_training_eligible", "camera_view", "sample_count")


@query
def pilot_participants(spark, sf):
    known = pilot.pilot_participants(A.captures(spark, sf).where(F.col("activity") == "click"))
    return pilot.insert_absent(known, pilot.pilot_participants(A.captures(spark, sf)), "participant_code")


@query
def pilot_to_summary(spark, sf):
    x = pilot.pilot_to_summary(A.captures(spark, sf))
    return x.select("seq", "sessionId", "userId", "capturedAt", "deviationScore", "ruleStatus", "sampleRateHz",
                    F.col("featureVector")[1].alias("f1"))


@query
def capture_episodes(spark, sf):
    """A capture file from reading to episodes: summaries in file order, scored and judged."""
    path = scratch_path(spark, "capture")
    files.write_captures(A.captures(spark, sf), path)
    return E.episodes(scoring.score_samples(pilot.pilot_to_summary(files.read_captures(spark, path))), PARAMS)


@query
def orphan_samples(spark, sf):
    known = A.table(spark, sf, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey")).alias("capture_id"))
    return sessions.orphans(pilot.pilot_samples(A.captures(spark, sf)), known, "capture_id")


@query
def load_report(spark, sf):
    """Rows of each step of a capture load; times differ from run to run, so only their being there is shown."""
    path = scratch_path(spark, "load")
    report = loads.load_captures(A.captures(spark, sf), lambda name, df: df.write.parquet(f"{path}/{name}"))
    return report.select("step", "rows", (F.col("seconds") > 0).alias("timed"), (F.col("rowsPerSecond") > 0).alias("rated"))


@query
def run_metrics(spark, sf):
    """Totals of a stream's run, counted per micro-batch while its outcomes are written."""
    path, seen = scratch_path(spark, "metrics"), loads.RunMetrics()
    spark.streams.addListener(seen)
    try:
        out = loads.with_outcome_totals(outcome_stream(scoring.label_by_rule(stream_of_events(spark, sf)), PARAMS, delay="0 seconds"))
        run = (out.writeStream.format("parquet").option("path", path + "/rows").option("checkpointLocation", path + "/checkpoint")
               .trigger(availableNow=True).start())
        run.awaitTermination()
        seen.wait_for(run.runId)
        table = seen.table(spark).where(F.col("query") == str(run.id))
    finally:
        spark.streams.removeListener(seen)
    return table.agg(*[F.sum(c).alias(c) for c in ("rows", "started", "recovered", "finalisedEpisodes")])


@query
def orphan_splits(spark, sf):
    """Captures that were dealt to a data set but are not in the list of captures, here the suppliers' numbers."""
    splits = scoring.dataset_splits(A.captures(spark, sf), "capture_id")
    known = A.table(spark, sf, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey")).alias("captureId"))
    return sessions.orphans(splits, known, "captureId")


@query
def orphan_captures(spark, sf):
    """Captures whose participant is not on the list, here one of the nations outside region 1."""
    listed = A.table(spark, sf, "nation").where("n_regionkey <> 1").select(F.concat(F.lit("P"), "n_nationkey").alias("participant_code"))
    return sessions.orphans(pilot.pilot_sessions(A.captures(spark, sf)), listed, "participant_code")


@query
def pilot_sessions_upsert(spark, sf):
    """Capture sessions of even samples replaced by those of odd ones, where a session has any."""
    rows = A.captures(spark, sf)
    odd = F.col("seq") % 2 == 1
    before, after = pilot.pilot_sessions(rows.where(~odd)), pilot.pilot_sessions(rows.where(odd))
    return pilot.replace_rows(before, after, "capture_id").select("capture_id", "participant_code", "sample_count")


@query
def first_sessions(spark, sf):
    return pilot.first_sessions(A.captures(spark, sf), 12).select("capture_id", "seq")


@query
def session_sequences(spark, sf):
    return E.session_sequences(A.labelled(spark, sf))


# --- labels and scores --------------------------------------------------------------------------

@query
def rule_label(spark, sf):
    x = A.samples(spark, sf)
    score = (F.when((F.col("event_type") == "view") & (F.col("value") > 90), F.lit(float("nan")))
              .when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("deviationScore")))
    status = F.when((F.col("event_type") == "error") & (F.col("value") < 20), F.lit(None)).otherwise(F.col("ruleStatus"))
    x = scoring.label_by_rule(x.withColumns({"deviationScore": score, "ruleStatus": status}))
    return x.select("seq", "receivedRuleStatus", "inferredStatus", "bad")


@query
def feature_windows(spark, sf):
    x = scoring.feature_windows(A.mixed_vectors(spark, sf))
    w = F.when(F.col("windowed"), F.col("window"))
    return x.select("seq", "windowKey", "windowed", "windowBuffered", "windowSize",
                    F.get(F.get(w, F.lit(0)), F.lit(0)).alias("firstHead"),
                    F.get(F.element_at(w, -1), F.lit(2)).alias("lastTilt"),
                    F.aggregate(w, F.lit(0).cast("long"), lambda a, v: a + F.size(v)).alias("numbers"))


@query
def softmax_label(spark, sf):
    x = scoring.softmax_label(A.samples(spark, sf), F.col("featureVector"))
    return x.select("seq", "inferredStatus", *[F.col("probabilities")[c].alias("p" + c.title())
                                               for c in scoring.CLASS_NAMES])


@query
def scored_samples(spark, sf):
    x = scoring.score_samples(A.mixed_vectors(spark, sf))
    return x.select("seq", "sessionId", "userId", "receivedRuleStatus", "inferredStatus", "deviationScore",
                    "model", "windowBuffered", "windowSize")


@query
def model_scored_samples(spark, sf):
    x = scoring.score_samples(A.mixed_vectors(spark, sf), fixed_model(2))
    return x.select("seq", "sessionId", "inferredStatus", "model", "windowBuffered",
                    *[F.col("probabilities")[c].alias("p" + c.title()) for c in scoring.CLASS_NAMES])


@query
def inference_recent(spark, sf):
    return scoring.inference_recent(A.samples(spark, sf), 80).select("seq", "sessionId", "inferredStatus", "windowBuffered")


@query
def training_windows(spark, sf):
    rows = A.samples(spark, sf).withColumn(
        "manualLabel", F.when(F.col("value") >= 50, "BAD").when(F.col("value") >= 5, "NORMAL"))
    x = scoring.training_windows(rows)
    return x.select("captureId", "seq", "label", F.size("window").alias("steps"),
                    F.col("window")[0][0].alias("first"), F.col("window")[9][2].alias("last"))


@query
def dataset_splits(spark, sf):
    return scoring.dataset_splits(A.captures(spark, sf), "capture_id")


@query
def label_accuracy(spark, sf):
    x = A.labelled(spark, sf).withColumn(
        "manualLabel", F.when(F.col("k") >= 50, "BAD").when(F.col("k") >= 5, "NORMAL"))
    return scoring.label_accuracy(x, "inferredStatus", "manualLabel", ["event_type"])


@query
def label_accuracy_by_version(spark, sf):
    x = A.labelled(spark, sf).withColumns({
        "modelVersion": F.concat(F.lit("v"), F.col("seq") % 3),
        "manualLabel": F.when(F.col("k") >= 50, "BAD").when(F.col("k") >= 5, "NORMAL")})
    return scoring.label_accuracy(x, "inferredStatus", "manualLabel", ["modelVersion"])


# --- episodes -----------------------------------------------------------------------------------

@query
def episodes(spark, sf):
    return E.episodes(A.labelled(spark, sf), PARAMS)


@query
def label_runs(spark, sf):
    return E.label_runs(A.labelled(spark, sf), PARAMS)


@query
def sample_gaps(spark, sf):
    return E.sample_gaps(A.labelled(spark, sf))


@query
def episode_alerts(spark, sf):
    return E.episode_alerts(A.labelled(spark, sf), PARAMS)


@query
def episode_outcomes(spark, sf):
    return E.episode_outcomes(A.labelled(spark, sf), PARAMS)


@query
def episodes_active(spark, sf):
    return E.episodes_active(episodes(spark, sf))


@query
def episodes_recent(spark, sf):
    return E.episodes_recent(episodes(spark, sf), 20)


@query
def episode_json(spark, sf):
    x = E.episode_json(episodes(spark, sf))
    def field(name):
        return F.get_json_object("value", "$." + name)
    return x.select("sessionId", "startedAt", field("startedAt").alias("startedText"), field("endedAt").alias("endedText"),
                    field("durationSeconds").cast("double").alias("durationSeconds"),
                    field("alertCount").cast("int").alias("alertCount"), field("ongoing").cast("boolean").alias("ongoing"),
                    F.size(F.json_object_keys("value")).alias("fields"))


@query
def session_expiry(spark, sf):
    return E.session_expiry(A.labelled(spark, sf), PARAMS)


@query
def state_changes(spark, sf):
    return state_view.state_changes(A.labelled(spark, sf), PARAMS)


@query
def session_state(spark, sf):
    return state_view.session_state(A.labelled(spark, sf), PARAMS, ttl_seconds=A.DAY)


@query
def state_hash_roundtrip(spark, sf):
    h = state_view.to_hash(state_view.session_state(A.labelled(spark, sf), PARAMS, ttl_seconds=None))
    # Users whose number ends in 7 get an unreadable time, those ending in 3 an alert count of 0.
    digit = F.substring("stateKey", -1, 1)
    changed = F.when(digit == "7", F.map_from_arrays(F.array(F.lit("lastSeen")), F.array(F.lit("soon")))).when(
        digit == "3", F.map_from_arrays(F.array(F.lit("alertCount")), F.array(F.lit("0"))))
    kept = F.map_filter("hash", lambda k, v: ~F.coalesce(F.map_contains_key(changed, k), F.lit(False)))
    broken = F.when(changed.isNotNull(), F.map_concat(kept, changed)).otherwise(F.col("hash"))
    return state_view.from_hash(h.withColumn("hash", broken))


@query
def state_restore(spark, sf):
    x = A.labelled(spark, sf)
    stored = state_view.session_state(x.where(F.col("capturedAt") < mid()), PARAMS, as_of=mid(), ttl_seconds=None)
    first = x.where(F.col("capturedAt") >= mid()).groupBy("sessionId").agg(
        F.min_by("userId", "seq").alias("userId"), F.min("capturedAt").alias("capturedAt"))
    return state_view.restore(stored, first, PARAMS.timeout_seconds)


@query
def expired_state_keys(spark, sf):
    return state_view.expired_state_keys(A.split_by_kind(spark, sf), A.DAY)


# --- tables -------------------------------------------------------------------------------------

@query
def sessions_rollup(spark, sf):
    x = A.samples(spark, sf)
    return sessions.sessions_rollup(x.withColumn("sessionId", F.when(F.col("user_id") % 11 != 0, F.col("sessionId"))))


@query
def sessions_upsert(spark, sf):
    x = A.samples(spark, sf)
    table = sessions.sessions_rollup(x.where(F.col("capturedAt") < mid()))
    table = table.withColumn("status", F.when(F.col("sample_count") < 30, "ENDED").otherwise(F.col("status")))
    return sessions.upsert_sessions(table, x.where(F.col("capturedAt") >= mid()))


@query
def sessions_status(spark, sf):
    x = A.samples(spark, sf)
    now = x.agg(F.max("capturedAt")).scalar()
    return sessions.expire_sessions(sessions.sessions_rollup(x), now, PARAMS.timeout_seconds)


@query
def episodes_upsert(spark, sf):
    log = episode_outcomes(spark, sf)
    table = sessions.last_outcomes(log.where(F.col("at") < mid()))
    return sessions.upsert_episodes(table, log.where(F.col("at") >= mid()))


@query
def expiry_report(spark, sf):
    x = A.labelled(spark, sf)
    before = sessions.sessions_rollup(x)
    after = sessions.expire_sessions(before, x.agg(F.max("capturedAt")).scalar(), PARAMS.timeout_seconds)
    return sessions.expiry_report(before, after, E.session_expiry(x, PARAMS))


@query
def session_lookup(spark, sf):
    events = A.table(spark, sf, "events").withColumnRenamed("user_id", "sessionId")
    return files.session_lookup(events, 5).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("firstAt"), F.max("ts").alias("lastAt"))


@query
def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "landed")
    x = A.samples(spark, sf).select("sessionId", "userId", "capturedAt", "seq", "deviationScore", "ruleStatus")
    files.write_by_date(x, path, rebalance=True)
    back = files.read_by_date(spark, path)
    files.check_roundtrip(ingest.with_event_date(x), back)
    lowest = back.groupBy("eventDate").agg(F.count(F.lit(1)).alias("rows"), F.min("deviationScore").alias("lowest"))
    return lowest.orderBy("lowest", "eventDate")


# --- marts --------------------------------------------------------------------------------------

@query
def latency_summary(spark, sf):
    x = marts.latency_summary(A.table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], 60.0)
    return x.select("l_returnflag", "n", "max", "perSecond", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p95", "p99")])


@query
def status_counts(spark, sf):
    return marts.status_counts(A.table(spark, sf, "lineitem"), "l_returnflag", "N")


@query
def status_totals(spark, sf):
    return marts.ok_totals(A.table(spark, sf, "lineitem"), "l_returnflag", "N")


@query
def lag_summary(spark, sf):
    return marts.lag_summary(A.metrics(spark, sf), r"^stream\.(click|view|error)")


@query
def max_lag(spark, sf):
    return marts.max_lag(marts.lag_summary(A.metrics(spark, sf), r"^stream\."))


@query
def period_stats(spark, sf):
    return marts.period_stats(A.labelled(spark, sf), PARAMS)


# --- time shift ---------------------------------------------------------------------------------

@query
def rebase_time(spark, sf):
    x = A.samples(spark, sf).select(
        "seq", "sessionId", A.iso_micros(F.col("capturedAt")).alias("capturedAt"),
        F.when(F.col("event_type") == "view", "").otherwise(
            F.date_format("capturedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("startedAt"))
    return timeshift.rebase_time(x, F.lit("2026-01-01 00:00:00").cast("timestamp"))


@query
def replicate_sessions(spark, sf):
    x = timeshift.replicate_sessions(A.captures(spark, sf), 3, ["P01", "P02"], jitter=0.01)
    return x.select("copy", "seq", "capture_id", "participant_code", "started_at",
                    F.round(F.col("head_gap").cast("double"), 9).alias("head_gap"),
                    F.round(F.nullif("rule_score", F.lit("")).cast("double"), 9).alias("rule_score"))


# --- streams over the table files ---------------------------------------------------------------

def stream_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = A.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return A.event_rows(raw)


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now into Parquet and read that."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    (stream.writeStream.format("parquet").option("path", path + "/rows")
     .option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path + "/rows")


@query
def stream_parquet_sink(spark, sf):
    path = scratch_path(spark, "sink")
    land(A.messages(stream_of_events(spark, sf)), path + "/rows", path + "/checkpoint", every=None).awaitTermination()
    return files.read_by_date(spark, path + "/rows").groupBy("eventDate").agg(
        F.count(F.lit(1)).alias("rows"), F.count("featureVector").alias("numericVectors"),
        F.count("deviationScore").alias("scores"))


@query
def landing_rejects(spark, sf):
    """Messages landed by one stream with two outputs: per day those that decode, and those that do not."""
    path = scratch_path(spark, "rejects")
    land_all(A.messages(stream_of_events(spark, sf)), path + "/rows", path + "/bad", path + "/checkpoint", every=None).awaitTermination()
    good = landed(spark, path + "/rows").groupBy("eventDate").agg(F.count(F.lit(1)).alias("rows"))
    bad = rejected(spark, path + "/bad").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(None).cast("date").alias("eventDate"), "rows")
    return good.unionByName(bad)


@query
def episodes_stream(spark, sf):
    labelled = scoring.label_by_rule(stream_of_events(spark, sf))
    return run_to_files(outcome_stream(labelled, PARAMS, delay="0 seconds"), "outcomes")


@query
def live_path(spark, sf):
    """Messages decoded, scored and judged in one stream; each of five spans of time is a micro-batch and a restart."""
    path, x = scratch_path(spark, "live"), A.samples(spark, sf)
    week = F.least(F.lit(4), F.floor((F.dayofmonth("capturedAt") - 1) / 7))
    for k in range(5):
        A.messages(x.where(week == k)).write.mode("append").parquet(path + "/in")
        arrived = spark.readStream.schema("seq long, value binary").parquet(path + "/in")
        out = live_outcomes(arrived, PARAMS, delay="0 seconds")
        (out.writeStream.format("parquet").option("path", path + "/rows").option("checkpointLocation", path + "/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out.schema).parquet(path + "/rows")


@query
def state_handover(spark, sf):
    """Outcomes of two streams: the second takes over the state that the first has left in its store half-way."""
    path, outcomes = scratch_path(spark, "handover"), []
    for part, half in (("first", F.col("capturedAt") < mid()), ("second", F.col("capturedAt") >= mid())):
        initial = stored_state(spark, path + "/checkpoint-first") if part == "second" else None
        out = outcome_stream(scoring.label_by_rule(stream_of_events(spark, sf)).where(half), PARAMS, delay="0 seconds", initial=initial)
        (out.writeStream.format("parquet").option("path", f"{path}/rows-{part}").option("checkpointLocation", f"{path}/checkpoint-{part}")
         .trigger(availableNow=True).start().awaitTermination())
        outcomes.append(spark.read.schema(out.schema).parquet(f"{path}/rows-{part}"))
    return outcomes[0].unionByName(outcomes[1])


@query
def scored_stream(spark, sf):
    x = score_stream(stream_of_events(spark, sf).withColumn("featureVector", F.col("featureVector").cast("array<string>")))
    return run_to_files(x, "scored").select("seq", "sessionId", "inferredStatus", "model", "windowBuffered", "windowSize")


@query
def tables_stream(spark, sf):
    """Outcomes upserted into the episodes table by micro-batches and read back."""
    path = scratch_path(spark, "tables")
    target = tables.episodes_table(spark, path + "/episodes")
    labelled = scoring.label_by_rule(stream_of_events(spark, sf))
    (outcome_stream(labelled, PARAMS, delay="0 seconds").writeStream.foreachBatch(tables.record_outcomes(target))
     .option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return target.read()
