"""SQL for DuckDB that gives the rows of the queries of the same name.

The episode statements do not reuse the library's formulation: runs come from numbered islands,
alerts from a recursive query, and the judgment state is written out per sample and compared with
the sample before it.
"""

from __future__ import annotations

import string

from tidewatch.catalog.adapters import fixed_model

HOUR = 3_600_000
FIXED = {"persist": 6 * HOUR, "recovery": 6 * HOUR, "realert": 12 * HOUR, "timeout": 48 * HOUR,
         "mid": "TIMESTAMP '2024-01-16 00:00:00'"}


def fill(text: str, **more) -> str:
    return string.Template(text).substitute(FIXED | more)


SAMPLES = """
s AS (SELECT 'u' || user_id AS sid, CAST(user_id AS VARCHAR) AS uid, ts, epoch_us(ts) // 1000 AS ms, event_id AS seq,
             least(1.0, value / 100) AS score, value, event_type, user_id,
             CASE WHEN event_type = 'error' THEN 'COLLAPSED' ELSE 'NORMAL' END AS rule,
             value / 100 AS f0, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, (event_id % 7) / 10 AS f2
      FROM events)"""

LABEL = "CASE WHEN score >= 0.7 THEN 'BAD' WHEN score >= 0.4 THEN 'WARNING' ELSE 'NORMAL' END"

JUDGED = "SELECT sid, uid, seq, ts, ms, score >= 0.4 AS bad FROM s"

# Runs of equal labels inside segments, numbered per session.
RUNS = SAMPLES + """,
j AS (""" + JUDGED + """ $where),
la AS (SELECT *, lag(ms) OVER w AS pms, lag(bad) OVER w AS pbad, lag(uid) OVER w AS puid FROM j
       WINDOW w AS (PARTITION BY sid ORDER BY ts, seq)),
fl AS (SELECT *, (pms IS NULL OR ms - pms >= $timeout) AS seg0 FROM la),
nu AS (SELECT *, sum(CAST(seg0 AS INT)) OVER w AS seg, sum(CAST(seg0 OR bad <> pbad AS INT)) OVER w AS run FROM fl
       WINDOW w AS (PARTITION BY sid ORDER BY ts, seq)),
st AS (SELECT *, first_value(ms) OVER w AS rs, row_number() OVER w AS rn FROM nu
       WINDOW w AS (PARTITION BY sid, run ORDER BY ts, seq)),
r AS (SELECT sid, seg, run, any_value(bad) AS bad, min(rs) AS rs, max(ms) AS lastms, count(*) AS n,
             bool_or(seg0) AS seg0, arg_min(uid, seq) AS uid,
             min(ms) FILTER (rn > 1 AND ms - rs >= CASE WHEN bad THEN $persist ELSE $recovery END) AS confirm
      FROM st GROUP BY sid, seg, run)"""

EPISODES = RUNS + """,
nw AS (SELECT $asof AS now),
q AS (SELECT *, lag(bad) OVER (PARTITION BY sid, seg ORDER BY run) AS qb FROM r WHERE confirm IS NOT NULL),
q2 AS (SELECT *, lead(confirm) OVER w AS goodms, lead(run) OVER w AS goodrun FROM q WHERE qb IS NULL OR qb <> bad
       WINDOW w AS (PARTITION BY sid, seg ORDER BY run)),
sg AS (SELECT sid, seg, max(lastms) AS seglast, lead(seg) OVER (PARTITION BY sid ORDER BY seg) AS nextseg
       FROM r GROUP BY sid, seg),
ep AS (SELECT q2.sid, q2.uid, q2.seg, q2.run, q2.rs, q2.confirm, q2.goodms, coalesce(q2.goodrun, 9999999999) AS endrun,
              sg.seglast,
              CASE WHEN goodms IS NOT NULL THEN goodms
                   WHEN nextseg IS NOT NULL OR now - seglast >= $timeout THEN seglast END AS endms
       FROM q2 JOIN sg USING (sid, seg), nw WHERE q2.bad),
al AS (SELECT sid, seg, run, endrun, 1 AS n, confirm AS ams FROM ep
       UNION ALL
       SELECT al.sid, al.seg, al.run, al.endrun, al.n + 1, min(b.ms)
       FROM al JOIN st b ON b.sid = al.sid AND b.seg = al.seg AND b.bad AND b.run >= al.run AND b.run < al.endrun
            AND b.ms >= al.ams + $realert
       GROUP BY al.sid, al.seg, al.run, al.endrun, al.n),
e AS (SELECT ep.*, na, la FROM ep JOIN
      (SELECT sid, run, max(n) AS na, max(ams) AS la FROM al GROUP BY sid, run) USING (sid, run))"""

MAX_MS = "(SELECT epoch_us(max(ts)) // 1000 FROM events)"

STATES = EPISODES + """,
x AS (SELECT st.*, e.run AS erun, e.rs AS ers, e.confirm AS econfirm FROM st LEFT JOIN e
      ON e.sid = st.sid AND e.seg = st.seg AND st.run >= e.run AND st.run <= e.endrun AND st.ms >= e.confirm
      AND (e.goodms IS NULL OR st.ms < e.goodms)),
am AS (SELECT x.sid, x.seq, max(al.n) AS n, max(al.ams) AS ams FROM x JOIN al
       ON al.sid = x.sid AND al.run = x.erun AND al.ams <= x.ms GROUP BY x.sid, x.seq),
y AS (SELECT x.sid, x.uid, x.seg, x.run, x.seg0, x.ts, x.seq, x.ms,
             CASE WHEN bad AND (erun IS NULL OR erun = run) THEN rs END AS cand,
             CASE WHEN NOT bad AND erun IS NOT NULL THEN rs END AS rec,
             ers AS ep0, am.ams AS lasta, coalesce(am.n, 0) AS na
      FROM x LEFT JOIN am USING (sid, seq)),
z AS (SELECT *, CASE WHEN ep0 IS NOT NULL THEN CASE WHEN rec IS NOT NULL THEN 'RECOVERING' ELSE 'BAD' END
                     WHEN cand IS NOT NULL THEN 'SUSPECT' ELSE 'NORMAL' END AS state,
             CASE WHEN seg0 THEN cand IS NOT NULL OR rec IS NOT NULL OR ep0 IS NOT NULL
                  ELSE (cand IS DISTINCT FROM lag(cand) OVER w OR rec IS DISTINCT FROM lag(rec) OVER w
                        OR ep0 IS DISTINCT FROM lag(ep0) OVER w OR lasta IS DISTINCT FROM lag(lasta) OVER w
                        OR na IS DISTINCT FROM lag(na) OVER w) END AS changed
      FROM y WINDOW w AS (PARTITION BY sid ORDER BY ts, seq)),
v AS (SELECT *, CASE state WHEN 'SUSPECT' THEN cand WHEN 'BAD' THEN ep0 WHEN 'RECOVERING' THEN rec END AS since FROM z),
lv AS (SELECT sid, arg_max(v, (ts, seq)) AS b, max(ms) AS seen, max(ms) FILTER (changed) AS written FROM v GROUP BY sid),
live AS (SELECT lv.*, b.uid AS uid FROM lv, nw WHERE now - seen < $timeout AND b.state <> 'NORMAL' $ttl)"""


def at(ms: str) -> str:
    return f"make_timestamp(1000 * ({ms}))"


def episodes_cte(where: str = "", asof: str = MAX_MS) -> str:
    return "WITH RECURSIVE " + fill(EPISODES, where=where, asof=asof)


def states_cte(where: str = "", asof: str = MAX_MS, ttl: str = "") -> str:
    return "WITH RECURSIVE " + fill(STATES, where=where, asof=asof, ttl=ttl)


EPISODE_ROWS = f"""
SELECT sid AS "sessionId", uid AS "userId", {at('rs')} AS "startedAt", {at('confirm')} AS "confirmedAt",
       {at('endms')} AS "endedAt", (endms - rs) / 1000.0 AS "durationSeconds", CAST(na AS INT) AS "alertCount",
       {at('la')} AS "lastAlertAt", goodms IS NOT NULL AS recovered, endms IS NULL AS ongoing FROM e"""

OUTCOME_ROWS = f"""
SELECT CASE WHEN n = 1 THEN 'EVENT_STARTED' ELSE 'RE_ALERT' END AS type, sid AS "sessionId", e.uid AS "userId",
       {at('e.rs')} AS "startedAt", {at('al.ams')} AS "at", CAST(NULL AS TIMESTAMP) AS "endedAt",
       CAST(NULL AS DOUBLE) AS "durationSeconds", CAST(n AS INT) AS "alertCount", {at('al.ams')} AS "lastAlertAt",
       false AS recovered, true AS ongoing
FROM al JOIN e USING (sid, run)
UNION ALL
SELECT 'EVENT_ENDED', sid, uid, {at('rs')}, {at('endms')}, {at('endms')}, (endms - rs) / 1000.0, CAST(na AS INT),
       {at('la')}, goodms IS NOT NULL, false FROM e WHERE endms IS NOT NULL"""

EPISODE_TABLE = f"""
SELECT sid AS session_id, uid AS user_id, {at('rs')} AS started_at, {at('endms')} AS ended_at,
       (endms - rs) / 1000.0 AS duration_seconds, CAST(na AS INT) AS alert_count, {at('la')} AS last_alert_at,
       goodms IS NOT NULL AS recovered, endms IS NULL AS ongoing FROM e"""

STATE_FIELDS = f"""b.sid AS "sessionId", b.uid AS "userId", {at('b.cand')} AS "candidateSince",
       {at('b.rec')} AS "recoverySince", {at('b.ep0')} AS "episodeStartedAt", {at('b.lasta')} AS "lastAlertAt",
       CAST(b.na AS INT) AS "alertCount", {at('seen')} AS "lastSeen", b.state AS state, {at('b.since')} AS since"""

# Samples as ingest requests with one rule broken per event type.
REQUESTS = SAMPLES + """,
rq AS (SELECT seq, ts, CASE WHEN event_type = 'view' AND value < 50 THEN '  ' ELSE sid END AS sid,
              CASE WHEN event_type = 'view' AND value < 10 THEN NULL ELSE uid END AS uid,
              event_type = 'purchase' AND value < 20 AS nofeatures, f0,
              CASE WHEN event_type = 'signup' THEN value / 100
                   WHEN event_type = 'click' AND value < 5 THEN NULL ELSE score END AS score,
              CASE WHEN event_type = 'error' AND value > 30 THEN 'UNKNOWN' ELSE rule END AS rule FROM s),
er AS (SELECT seq, 'sessionId' AS field, 'must not be blank' AS message FROM rq WHERE trim(sid) = ''
       UNION ALL SELECT seq, 'userId', 'must not be blank' FROM rq WHERE uid IS NULL
       UNION ALL SELECT seq, 'featureVector', 'must not be empty' FROM rq WHERE nofeatures
       UNION ALL SELECT seq, 'deviationScore', CASE WHEN score IS NULL THEN 'must not be null' ELSE 'must be between 0 and 1' END
       FROM rq WHERE score IS NULL OR score < 0 OR score > 1
       UNION ALL SELECT seq, 'ruleStatus', 'must be NORMAL or COLLAPSED' FROM rq WHERE rule NOT IN ('NORMAL', 'COLLAPSED'))"""

# Samples as rows of a capture file, already typed.
CAPTURES = SAMPLES + """,
c AS (SELECT sid AS capture_id, 'P' || (user_id % 20) AS participant_code, TIMESTAMP '2024-01-01 00:00:00' AS started_at,
             event_type AS activity, CASE WHEN event_type <> 'view' THEN 12.5::DOUBLE END AS target_sample_hz,
             CAST(user_id % 3 + 1 AS INT) AS repetition, user_id % 2 = 0 AS eligible, seq, ts,
             CAST(seq AS INT) AS sample_index, CAST(ms - epoch_us(TIMESTAMP '2024-01-01 00:00:00') // 1000 AS DOUBLE) AS elapsed_ms,
             's' || day(ts) AS segment_id, CASE WHEN value >= 50 THEN 'BAD' WHEN value >= 5 THEN 'NORMAL' END AS manual_label,
             value AS head_gap, k AS lateral_offset, CASE WHEN value < 90 THEN value / 2 END AS shoulder_tilt,
             f2 AS delta_tilt, k / 100 AS delta_offset, CASE WHEN event_type <> 'signup' THEN value / 80 END AS rule_score,
             CASE WHEN value >= 40 THEN 'deviation' ELSE 'normal' END AS rule_prediction,
             CASE WHEN event_type <> 'view' THEN event_type = 'click' END AS pose_detected,
             '{"k": ' || CAST(k AS INT) || ', "t": "a,b"}' AS landmarks_json FROM s)"""

# Vectors are not numeric for signups and empty for some views.
WINDOWS = SAMPLES + """,
m AS (SELECT *, event_type <> 'signup' AS ok, event_type = 'view' AND value < 20 AS empty FROM s),
cnt AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY sid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS c FROM m),
vw AS (SELECT seq, first_value(CASE WHEN NOT empty THEN f0 END) OVER w AS fh, CASE WHEN NOT empty THEN f2 END AS lt,
              sum(CASE WHEN empty THEN 0 ELSE 3 END) OVER w AS numbers FROM cnt WHERE ok
       WINDOW w AS (PARTITION BY sid ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""

ROLLUP = """SELECT 'u' || user_id AS session_id, CAST(user_id AS VARCHAR) AS user_id, min(ts) AS started_at,
       max(ts) AS last_seen_at, count(*) AS sample_count"""

METRICS = SAMPLES + """,
lg AS (SELECT date_trunc('hour', ts) AS h, event_type, CASE WHEN value >= 10 THEN CAST(floor(value) AS BIGINT) END AS lag,
              CAST(k AS BIGINT) AS consumed, user_id % 4 <> 0 AS member FROM s)"""


def two_unit_model(steps: int = 10) -> str:
    """CTEs from ``fw`` (seq and the lists x0, x1, x2 of its window) to ``pr``: class probabilities of a recurrent model of two units."""
    m = fixed_model(2)

    def gate(row: int, step: int) -> str:
        terms = [f"({float(w)!r}::DOUBLE) * x{i}[{step}]" for i, w in enumerate(m.w_input[row])]
        return " + ".join([*terms, *(f"({float(w)!r}::DOUBLE) * h{i}" for i, w in enumerate(m.w_hidden[row])), f"({float(m.bias[row])!r}::DOUBLE)"])

    out, before = [], "(SELECT *, 0.0::DOUBLE AS h0, 0.0::DOUBLE AS h1, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1 FROM fw)"
    for step in range(1, steps + 1):
        # Rows of the weights: input, forget, cell and output gates of both units.
        cells = ", ".join(f"c{u} / (1 + exp(-({gate(2 + u, step)}))) + tanh({gate(4 + u, step)}) / (1 + exp(-({gate(u, step)}))) AS n{u}, {gate(6 + u, step)} AS o{u}" for u in (0, 1))
        out.append(f"""s{step} AS (SELECT seq, x0, x1, x2, n0 AS c0, n1 AS c1, tanh(n0) / (1 + exp(-o0)) AS h0, tanh(n1) / (1 + exp(-o1)) AS h1
  FROM (SELECT seq, x0, x1, x2, {cells} FROM {before}))""")
        before = f"s{step}"
    logits = [" + ".join(f"({float(w)!r}::DOUBLE) * h{i}" for i, w in enumerate(row)) for row in m.w_class]
    out.append(f"pr AS (SELECT seq, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM (SELECT seq, exp({logits[0]}) AS a, exp({logits[1]}) AS b, exp({logits[2]}) AS c FROM s{steps}))")
    return ",\n".join(out)


def uuid(text: str) -> str:
    h = f"sha256({text})"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def noise(column: str) -> str:
    h = f"substr(sha256('42:' || copy || ':' || seq || ':{column}'), 1, 12)"
    return f"((CAST('0x' || {h} AS BIGINT) / 281474976710656.0 * 2 - 1) * 0.01)"


def sql() -> dict[str, str]:
    s, runs = "WITH " + SAMPLES, "WITH " + fill(RUNS, where="")
    ep, asof_mid = episodes_cte(), "epoch_us(TIMESTAMP '2024-01-16 00:00:00') // 1000"
    q: dict[str, str] = {}

    q["decode_events"] = s + """
SELECT seq, event_type <> 'signup' AS decoded, CASE WHEN d THEN 1 END AS "schemaVersion", CASE WHEN d THEN sid END AS "sessionId",
       CASE WHEN d THEN uid END AS "userId", CASE WHEN d THEN ts END AS "capturedAt",
       CASE WHEN d THEN ts + INTERVAL 1 SECOND END AS "serverReceivedAt",
       CASE WHEN d AND event_type <> 'error' THEN score END AS "deviationScore", CASE WHEN d THEN rule END AS "ruleStatus",
       CASE WHEN d THEN 10.0::DOUBLE END AS "sampleRateHz", CASE WHEN d AND event_type <> 'view' THEN f0 END AS f0,
       CASE WHEN d AND event_type <> 'view' THEN f2 END AS f2,
       CASE WHEN d THEN CASE WHEN event_type = 'view' THEN 2 ELSE 3 END END AS elements
FROM (SELECT *, event_type <> 'signup' AS d FROM s)"""
    q["events_by_date"] = """SELECT CAST(ts AS DATE) AS "eventDate", count(*) AS n, max(event_id) AS "lastSeq"
FROM events GROUP BY 1"""
    q["normalise_summary"] = s + """
SELECT seq, 1 AS "schemaVersion", sid AS "sessionId",
       CASE WHEN event_type = 'click' THEN ts + INTERVAL 1 SECOND ELSE ts END AS "capturedAt",
       ts + INTERVAL 1 SECOND AS "serverReceivedAt" FROM s"""
    q["inference_view"] = s + f"""
SELECT seq, true AS decoded, CASE WHEN event_type <> 'view' THEN sid END AS "sessionId", uid AS "userId",
       {LABEL} AS "inferredStatus", strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "capturedAt" FROM s"""
    q["inference_messages"] = s + f"""
SELECT CASE WHEN label = 'BAD' THEN sid ELSE uid END AS key, sid AS "sessionId",
       CASE WHEN label = 'BAD' THEN '' ELSE uid END AS "userId", label AS "inferredStatus", score AS "deviationScore",
       strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 'Z' AS "capturedAt",
       CAST(least(10, row_number() OVER (PARTITION BY sid ORDER BY ts, seq)) AS INT) AS "windowBuffered",
       true AS "noProbabilities" FROM (SELECT *, {LABEL} AS label FROM s)"""
    rq = "WITH " + REQUESTS
    q["validate_summary"] = rq + """
SELECT seq, count(field) = 0 AS accepted, CAST(count(field) AS INT) AS "nErrors" FROM rq LEFT JOIN er USING (seq) GROUP BY seq"""
    q["validation_errors"] = rq + " SELECT seq, field, message FROM er"
    q["summary_messages"] = rq + """
SELECT sid AS key, 'ACCEPTED' AS status, 'summary' AS topic, (epoch_us(ts) // 1000) + 1000 AS "receivedAtMillis", uid AS "userId",
       strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS "capturedAt",
       score AS "deviationScore", f0 FROM rq WHERE seq NOT IN (SELECT seq FROM er)"""
    q["parse_instants"] = """
SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN ts ELSE date_trunc('second', ts) - INTERVAL 9 HOUR END AS "capturedAt"
FROM events WHERE event_type IN ('click', 'purchase')"""
    q["format_instants"] = """
SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                             WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                             ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS "sqlText",
       substr(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 1, 23) || 'Z' AS "isoMillis",
       CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z'
                       WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
                       ELSE substr(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 1, 22) || 'Z' END AS "isoLike" FROM events"""

    c = "WITH " + CAPTURES
    q["csv_pilot_load"] = c + """
SELECT capture_id, participant_code, started_at, target_sample_hz, repetition, CAST(640 AS INT) AS width,
       eligible AS pose_training_eligible, sample_index, elapsed_ms, manual_label, 'ok, "good"' AS measurement_quality,
       head_gap, shoulder_tilt, rule_score, rule_prediction, pose_detected, landmarks_json,
       CAST(NULL AS VARCHAR) AS world_landmarks_json FROM c"""
    q["pilot_samples"] = c + """
SELECT capture_id, sample_index, elapsed_ms, 100.0::DOUBLE AS gap_ms, segment_id, manual_label, head_gap, lateral_offset,
       shoulder_tilt, delta_tilt, rule_score, rule_prediction, pose_detected, CAST(33 AS INT) AS landmark_count,
       landmarks_json, CAST(NULL AS DOUBLE) AS visibility FROM c"""
    q["pilot_sessions"] = c + """
SELECT capture_id, any_value(participant_code) AS participant_code, '2' AS schema_version, any_value(started_at) AS started_at,
       arg_min(activity, seq) AS activity, CASE WHEN arg_min(activity, seq) <> 'view' THEN 12.5::DOUBLE END AS target_sample_hz,
       60.0::DOUBLE AS planned_seconds, any_value(repetition) AS repetition, CAST(640 AS INT) AS width, CAST(480 AS INT) AS height,
       any_value(eligible) AS pose_training_eligible, CAST(NULL AS VARCHAR) AS camera_view, count(*) AS sample_count
FROM c GROUP BY capture_id"""
    q["pilot_participants"] = c + " SELECT DISTINCT participant_code FROM c"
    q["pilot_to_summary"] = c + f"""
SELECT seq, capture_id AS "sessionId", participant_code AS "userId", {at('(epoch_us(ts) // 1000)')} AS "capturedAt",
       round(least(1.0, coalesce(rule_score, 0.0)), 6) AS "deviationScore",
       CASE WHEN rule_prediction = 'deviation' THEN 'COLLAPSED' ELSE 'NORMAL' END AS "ruleStatus",
       coalesce(target_sample_hz, 10.0)::DOUBLE AS "sampleRateHz", delta_offset AS f1 FROM c"""
    captured = episodes_cte().replace(JUDGED, """SELECT sid, 'P' || (user_id % 20) AS uid, seq, ts, ms,
      round(least(1.0, coalesce(CASE WHEN event_type <> 'signup' THEN value / 80 END, 0.0)), 6) >= 0.4 AS bad FROM s""")
    q["capture_episodes"] = captured + EPISODE_ROWS
    q["orphan_samples"] = """SELECT 'u' || user_id AS capture_id, count(*) AS rows FROM events
WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id"""
    q["load_report"] = c + """,
st AS (SELECT 'participants' AS step, count(DISTINCT participant_code) AS rows FROM c UNION ALL
       SELECT 'sessions', count(DISTINCT capture_id) FROM c UNION ALL SELECT 'samples', count(*) FROM c)
SELECT step, rows, true AS timed, true AS rated FROM st UNION ALL SELECT 'total', CAST(sum(rows) AS BIGINT), true, true FROM st"""
    q["run_metrics"] = ep + f""" SELECT (SELECT count(*) FROM events) AS rows, count(*) FILTER (type = 'EVENT_STARTED') AS started,
count(*) FILTER (type = 'EVENT_ENDED' AND recovered) AS recovered, count(*) FILTER (type = 'EVENT_ENDED' AND NOT recovered) AS "finalisedEpisodes"
FROM ({OUTCOME_ROWS})"""
    q["orphan_splits"] = """SELECT DISTINCT 'u' || user_id AS "captureId", 1::BIGINT AS rows FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)"""
    q["orphan_captures"] = c + """ SELECT participant_code, count(DISTINCT capture_id) AS rows FROM c
WHERE participant_code NOT IN (SELECT 'P' || n_nationkey FROM nation WHERE n_regionkey <> 1) GROUP BY participant_code"""
    q["pilot_sessions_upsert"] = c + """, n AS (
  SELECT capture_id, any_value(participant_code) AS participant_code, count(*) FILTER (seq % 2 = 1) AS odd,
         count(*) FILTER (seq % 2 = 0) AS even FROM c GROUP BY capture_id)
SELECT capture_id, participant_code, CASE WHEN odd > 0 THEN odd ELSE even END AS sample_count FROM n"""
    q["first_sessions"] = """SELECT 'u' || user_id AS capture_id, event_id AS seq FROM events WHERE user_id IN
(SELECT user_id FROM events GROUP BY user_id ORDER BY min(event_id) LIMIT 12)"""
    q["session_sequences"] = s + """
SELECT sid AS "sessionId", seq, row_number() OVER (PARTITION BY sid ORDER BY ts, seq) AS position FROM s"""

    q["rule_label"] = s + """
SELECT seq, received AS "receivedRuleStatus", label AS "inferredStatus", label NOT IN ('NORMAL', 'UNKNOWN') AS bad FROM (
  SELECT seq, received, CASE WHEN event_type = 'error' THEN received WHEN event_type = 'view' AND value > 90 THEN 'NORMAL'
                             WHEN score >= 0.7 THEN 'BAD' WHEN score >= 0.4 THEN 'WARNING' ELSE 'NORMAL' END AS label
  FROM (SELECT *, CASE WHEN event_type = 'error' AND value < 20 THEN 'UNKNOWN' ELSE rule END AS received FROM s))"""
    w = "WITH " + WINDOWS
    q["feature_windows"] = w + """
SELECT cnt.seq, sid AS "windowKey", ok AS windowed, CAST(least(10, c) AS INT) AS "windowBuffered", CAST(10 AS INT) AS "windowSize",
       fh AS "firstHead", lt AS "lastTilt", CAST(numbers AS BIGINT) AS numbers FROM cnt LEFT JOIN vw USING (seq)"""
    q["softmax_label"] = s + """
SELECT seq, CASE WHEN a >= b AND a >= c THEN 'NORMAL' WHEN b >= c THEN 'WARNING' ELSE 'BAD' END AS "inferredStatus",
       round(a / (a + b + c), 4) AS "pNormal", round(b / (a + b + c), 4) AS "pWarning", round(c / (a + b + c), 4) AS "pBad"
FROM (SELECT seq, exp(f0 - t) AS a, exp(k / 100 - t) AS b, exp(f2 - t) AS c FROM (SELECT *, greatest(f0, k / 100, f2) AS t FROM s))"""
    scored = f"""sid AS "sessionId", {LABEL} AS "inferredStatus", 'rule-based-skeleton-v0' AS model"""
    q["scored_samples"] = w + f"""
SELECT seq, {scored}, uid AS "userId", rule AS "receivedRuleStatus", score AS "deviationScore",
       CAST(least(10, c) AS INT) AS "windowBuffered", CAST(10 AS INT) AS "windowSize" FROM cnt"""
    parts = ", ".join(f"list(CASE WHEN empty THEN 0.0::DOUBLE ELSE {f} END) OVER w AS x{i}" for i, f in enumerate(("f0", "k / 100", "f2")))
    q["model_scored_samples"] = w + f""",
wd AS (SELECT seq, {parts} FROM cnt WHERE ok WINDOW w AS (PARTITION BY sid ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
fw AS (SELECT * FROM wd WHERE len(x0) = 10),
{two_unit_model()}
SELECT cnt.seq, sid AS "sessionId", CASE WHEN a IS NULL THEN {LABEL} WHEN a >= b AND a >= c_ THEN 'NORMAL' WHEN b >= c_ THEN 'WARNING' ELSE 'BAD' END AS "inferredStatus",
       CASE WHEN a IS NULL THEN 'rule-based-skeleton-v0' ELSE 'fixed-lstm' END AS model, CASE WHEN a IS NULL THEN CAST(least(10, cnt.c) AS INT) END AS "windowBuffered",
       round(a, 4) AS "pNormal", round(b, 4) AS "pWarning", round(c_, 4) AS "pBad"
FROM cnt LEFT JOIN (SELECT seq, a, b, c AS c_ FROM pr) USING (seq)"""
    position = "row_number() OVER (PARTITION BY sid ORDER BY ts, seq)"
    q["scored_stream"] = s + f"""
SELECT seq, {scored}, CAST(least(10, {position}) AS INT) AS "windowBuffered", CAST(10 AS INT) AS "windowSize" FROM s"""
    q["inference_recent"] = s + f"""
SELECT * FROM (SELECT seq, sid AS "sessionId", {LABEL} AS "inferredStatus", CAST(least(10, {position}) AS INT) AS "windowBuffered"
FROM s) ORDER BY seq DESC LIMIT 50"""
    q["training_windows"] = s + f"""
SELECT sid AS "captureId", seq, CASE WHEN value >= 50 THEN 'BAD' ELSE 'NORMAL' END AS label, CAST(10 AS INT) AS steps,
       f9 AS first, f2 AS last
FROM (SELECT *, lag(f0, 9) OVER (PARTITION BY sid ORDER BY ts, seq) AS f9 FROM s) WHERE f9 IS NOT NULL AND value >= 5"""
    q["dataset_splits"] = s + """
SELECT sid AS "captureId", CASE WHEN b < 8 THEN 'train' WHEN b < 9 THEN 'val' ELSE 'test' END AS split
FROM (SELECT DISTINCT sid, CAST('0x' || substr(md5(sid), 1, 8) AS BIGINT) % 10 AS b FROM s)"""
    q["label_accuracy"] = s + f"""
SELECT event_type, count(*) AS samples, avg(CAST(label = truth AS INT)) AS "metricValue", 'accuracy' AS "metricName"
FROM (SELECT event_type, {LABEL} AS label, CASE WHEN k >= 50 THEN 'BAD' WHEN k >= 5 THEN 'NORMAL' END AS truth FROM s)
WHERE truth IS NOT NULL GROUP BY event_type"""

    q["label_accuracy_by_version"] = s + f"""
SELECT 'v' || (seq % 3) AS "modelVersion", count(*) AS samples, avg(CAST(label = truth AS INT)) AS "metricValue", 'accuracy' AS "metricName"
FROM (SELECT seq, {LABEL} AS label, CASE WHEN k >= 50 THEN 'BAD' WHEN k >= 5 THEN 'NORMAL' END AS truth FROM s)
WHERE truth IS NOT NULL GROUP BY 1"""

    q["episodes"] = ep + EPISODE_ROWS
    q["label_runs"] = runs + f"""
SELECT sid AS "sessionId", bad, {at('rs')} AS "startedAt", {at('lastms')} AS "lastAt", n AS samples, seg0 AS "segmentStart",
       {at('confirm')} AS "confirmedAt" FROM r"""
    q["sample_gaps"] = runs + """ SELECT sid AS "sessionId", seq, greatest(0, ms - pms) AS "gapMs" FROM la"""
    q["sample_gaps"] = q["sample_gaps"].replace('greatest(0, ms - pms)', 'CASE WHEN pms IS NOT NULL THEN greatest(0, ms - pms) END')
    q["episode_alerts"] = ep + f"""
SELECT sid AS "sessionId", e.uid AS "userId", {at('e.rs')} AS "startedAt", CAST(n AS INT) AS "alertNumber", {at('al.ams')} AS "alertAt"
FROM al JOIN e USING (sid, run)"""
    q["episode_outcomes"] = ep + OUTCOME_ROWS
    q["episodes_active"] = ep + EPISODE_ROWS + " WHERE endms IS NULL"
    q["episodes_recent"] = ep + f"""
SELECT * FROM ({EPISODE_ROWS} WHERE endms IS NOT NULL) ORDER BY "endedAt" DESC, "sessionId" DESC, "startedAt" DESC LIMIT 20"""
    iso = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')"
    q["episode_json"] = ep + f"""
SELECT sid AS "sessionId", {at('rs')} AS "startedAt", {iso.format(at('rs'))} AS "startedText", {iso.format(at('endms'))} AS "endedText",
       (endms - rs) / 1000.0 AS "durationSeconds", CAST(na AS INT) AS "alertCount", endms IS NULL AS ongoing, CAST(9 AS INT) AS fields FROM e"""
    q["session_expiry"] = ep + f"""
SELECT l.sid AS "sessionId", {at('lm')} AS "lastSeenAt", {at('e.rs')} AS "episodeStartedAt", CAST(e.na AS INT) AS "episodeAlertCount"
FROM (SELECT sid, max(ms) AS lm FROM j GROUP BY sid) l LEFT JOIN e ON e.sid = l.sid AND e.goodms IS NULL AND e.endms = l.lm
WHERE (SELECT now FROM nw) - lm >= {FIXED['timeout']}"""
    q["state_changes"] = states_cte() + f"""
SELECT sid AS "sessionId", uid AS "userId", {at('cand')} AS "candidateSince", {at('rec')} AS "recoverySince",
       {at('ep0')} AS "episodeStartedAt", {at('lasta')} AS "lastAlertAt", CAST(na AS INT) AS "alertCount", {at('ms')} AS "at",
       state, {at('since')} AS since FROM v WHERE changed"""
    q["session_state"] = states_cte(ttl="AND now - written < 86400000") + f"""
SELECT uid AS "stateKey", {STATE_FIELDS} FROM live"""
    q["state_hash_roundtrip"] = states_cte() + f"""
SELECT * REPLACE (CASE WHEN right("stateKey", 1) = '3' THEN CASE WHEN "episodeStartedAt" IS NOT NULL THEN 1 ELSE 0 END
                       ELSE "alertCount" END AS "alertCount")
FROM (SELECT uid AS "stateKey", {STATE_FIELDS} FROM live) WHERE right("stateKey", 1) <> '7'"""
    q["state_restore"] = states_cte(where=fill("WHERE ts < $mid"), asof=asof_mid) + fill(f""",
i AS (SELECT 'u' || user_id AS sid, CAST(user_id AS VARCHAR) AS uid, min(ts) AS ts FROM events WHERE ts >= $mid GROUP BY user_id),
h AS (SELECT i.sid AS isid, i.uid AS iuid, live.b AS b, coalesce(epoch_us(i.ts) // 1000 - live.seen <= $timeout, false) AS used,
             live.uid IS NOT NULL AS found FROM i LEFT JOIN live ON live.uid = i.uid)
SELECT isid AS "sessionId", iuid AS "stateKey", used AS restored, found AND NOT used AS discarded,
       CASE WHEN used THEN {at('b.cand')} END AS "candidateSince", CASE WHEN used THEN {at('b.rec')} END AS "recoverySince",
       CASE WHEN used THEN {at('b.ep0')} END AS "episodeStartedAt", CASE WHEN used THEN {at('b.lasta')} END AS "lastAlertAt",
       CASE WHEN used THEN CAST(b.na AS INT) END AS "alertCount" FROM h""")
    q["expired_state_keys"] = """
WITH l AS (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL),
o AS (SELECT *, epoch_us((SELECT max(ts) FROM events)) // 1000 - epoch_us(last) // 1000 >= 86400000 AS stale FROM l)
SELECT CAST(user_id AS VARCHAR) AS "stateKey" FROM o GROUP BY user_id HAVING bool_and(stale)"""

    q["sessions_rollup"] = ROLLUP + ", 'ACTIVE' AS status FROM events WHERE user_id % 11 <> 0 GROUP BY events.user_id"
    q["sessions_upsert"] = ROLLUP + fill(""",
       CASE WHEN count(*) FILTER (ts < $mid) BETWEEN 1 AND 29 THEN 'ENDED' ELSE 'ACTIVE' END AS status
FROM events GROUP BY events.user_id""")
    q["sessions_status"] = ROLLUP + """,
       CASE WHEN max(ts) < (SELECT max(ts) FROM events) - INTERVAL 48 HOUR THEN 'ENDED' ELSE 'ACTIVE' END AS status
FROM events GROUP BY events.user_id"""
    q["episodes_upsert"] = ep + EPISODE_TABLE
    q["expiry_report"] = ep + f"""
SELECT (SELECT count(*) FROM e JOIN (SELECT sid, max(ms) AS lm FROM j GROUP BY sid) l ON l.sid = e.sid AND e.endms = lm
        WHERE goodms IS NULL AND (SELECT now FROM nw) - lm >= {FIXED['timeout']}) AS "finalisedEpisodes",
       (SELECT count(*) FROM (SELECT max(ts) AS m FROM s GROUP BY sid)
        WHERE m < (SELECT max(ts) FROM s) - INTERVAL 48 HOUR) AS "endedSessions\""""
    q["session_lookup"] = """SELECT count(*) AS n, min(ts) AS "firstAt", max(ts) AS "lastAt" FROM events WHERE user_id = 5"""
    q["parquet_roundtrip"] = """SELECT CAST(ts AS DATE) AS "eventDate", count(*) AS rows, min(least(1.0, value / 100)) AS lowest
FROM events GROUP BY 1"""

    q["latency_summary"] = """
SELECT l_returnflag, count(*) AS n, max(l_extendedprice) AS max, count(*) / 60.0 AS "perSecond", round(avg(l_extendedprice), 4) AS mean,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
       round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY l_returnflag"""
    q["status_counts"] = """SELECT l_returnflag AS status, count(*) AS n, l_returnflag = 'N' AS ok FROM lineitem GROUP BY l_returnflag"""
    q["status_totals"] = """SELECT count(*) FILTER (l_returnflag = 'N') AS ok, count(*) FILTER (l_returnflag <> 'N') AS failed FROM lineitem"""
    m = "WITH " + METRICS
    q["lag_summary"] = m + """
SELECT h AS "sampledAt", CAST(coalesce(sum(lag), 0) AS BIGINT) AS "totalLag", CAST(coalesce(sum(consumed), 0) AS BIGINT) AS "totalConsumed",
       count(*) FILTER (member) AS members FROM lg WHERE event_type IN ('click', 'view', 'error') GROUP BY h"""
    q["max_lag"] = m + """
SELECT CAST(max(t) AS BIGINT) AS "maxLag" FROM (SELECT coalesce(sum(lag), 0) AS t FROM lg GROUP BY h)"""
    q["period_stats"] = ep + f""",
wt AS (SELECT puid AS uid, date_trunc('day', {at('pms')}) AS d, CAST(sum(ms - pms) AS BIGINT) AS v,
              CAST(coalesce(sum(ms - pms) FILTER (NOT pbad), 0) AS BIGINT) AS g
       FROM fl WHERE NOT seg0 GROUP BY 1, 2),
en AS (SELECT uid, date_trunc('day', {at('rs')}) AS d, count(*) AS n, count(endms) AS ended, CAST(sum(endms - rs) AS BIGINT) AS dur,
              quantile_cont((endms - rs) / 1000.0, 0.5) AS med FROM e GROUP BY 1, 2)
SELECT uid AS "userId", CAST(d AS TIMESTAMP) AS "periodStart", CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AS "periodEnd",
       coalesce(v, 0) / 1000.0 AS "validSeconds",
       CASE WHEN v > 0 THEN g / v END AS "normalRatio", CAST(coalesce(n, 0) AS INT) AS "collapseCount",
       CASE WHEN v > 0 THEN coalesce(n, 0) * 3600.0::DOUBLE / (v / 1000.0) END AS "collapsePerHour",
       CASE WHEN ended > 0 THEN dur / (ended * 1000.0) END AS "avgDurationSeconds", med AS "medianDurationSeconds"
FROM wt FULL JOIN en USING (uid, d)"""

    moved = "+ (epoch_us(TIMESTAMP '2026-01-01 00:00:00') - (SELECT epoch_us(max(ts)) FROM events))"
    q["rebase_time"] = s + f"""
SELECT seq, {uuid("'0:' || sid")} AS "sessionId", strftime(make_timestamp(epoch_us(ts) {moved}), '%Y-%m-%dT%H:%M:%S.%fZ') AS "capturedAt",
       CASE WHEN event_type = 'view' THEN ''
            ELSE strftime(make_timestamp(epoch_us(date_trunc('second', ts)) {moved}), '%Y-%m-%dT%H:%M:%SZ') END AS "startedAt" FROM s"""
    q["replicate_sessions"] = c + f"""
SELECT CAST(copy AS INT) AS copy, seq, {uuid("'42:' || copy")} AS capture_id, CASE WHEN copy % 2 = 0 THEN 'P01' ELSE 'P02' END AS participant_code,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(120 * copy), '%Y-%m-%dT%H:%M:%S.000Z') AS started_at,
       round(head_gap + {noise('head_gap')}, 9) AS head_gap, round(rule_score + {noise('rule_score')}, 9) AS rule_score
FROM c, (SELECT unnest([0, 1, 2]) AS copy)"""

    q["stream_parquet_sink"] = """SELECT CAST(ts AS DATE) AS "eventDate", count(*) AS rows, count(*) FILTER (event_type <> 'view') AS "numericVectors",
       count(*) FILTER (event_type <> 'error') AS scores FROM events WHERE event_type <> 'signup' GROUP BY 1"""
    q["landing_rejects"] = """SELECT CASE WHEN event_type <> 'signup' THEN CAST(ts AS DATE) END AS "eventDate", count(*) AS rows FROM events GROUP BY 1"""
    q["episodes_stream"] = q["state_handover"] = q["episode_outcomes"]
    q["tables_stream"] = q["episodes_upsert"]
    # Signups do not decode, and errors have no number as score, so their status is the label.
    arrived = episodes_cte("WHERE event_type <> 'signup'", MAX_MS.replace("FROM events", "FROM events WHERE event_type <> 'signup'"))
    q["live_path"] = arrived.replace("score >= 0.4 AS bad", "event_type = 'error' OR score >= 0.4 AS bad") + OUTCOME_ROWS
    return q
