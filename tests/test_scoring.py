import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_episodes import BASE
from tidewatch.catalog.queries import fixed_model
from tidewatch.functions import labels, vectors
from tidewatch.operators import scoring

COLUMNS = ("sessionId string, userId string, seq long, capturedAt timestamp, serverReceivedAt timestamp, "
           "featureVector array<string>, deviationScore double, ruleStatus string")


def samples(spark, vectors_of, session="s"):
    return spark.createDataFrame(
        [(session, "u", i, BASE + timedelta(seconds=i), BASE, [str(x) for x in v], 0.5, "NORMAL")
         for i, v in enumerate(vectors_of)], COLUMNS)


@pytest.mark.parametrize("score,status,expected", [
    (0.72, "NORMAL", "BAD"), (0.5, "NORMAL", "WARNING"), (0.1, "COLLAPSED", "NORMAL"), (0.7, None, "BAD"),
    (0.4, None, "WARNING"), (None, "COLLAPSED", "COLLAPSED"), (None, None, "UNKNOWN"), (math.nan, "COLLAPSED", "NORMAL")])
def test_rule_label(spark, score, status, expected):
    df = spark.createDataFrame([(score, status)], "s double, r string")
    assert df.select(labels.rule_label(F.col("s"), F.col("r"))).first()[0] == expected


def test_state_key(spark):
    df = spark.createDataFrame([("P01", "s-1"), (None, "s-1"), ("", "s-1"), ("  ", "s-1"), (None, None), ("", "")],
                               "u string, s string")
    got = [r[0] for r in df.select(labels.state_key(F.col("u"), F.col("s"))).collect()]
    assert got == ["P01", "s-1", "s-1", "s-1", None, None]


def test_vectors(spark):
    df = spark.createDataFrame([(["1", " 2.5"],), (["1", "x"],), ([],), (None,), (["1", None],)], "v array<string>")
    assert [r[0] for r in df.select(vectors.to_doubles(F.col("v"))).collect()] == [[1.0, 2.5], None, [], [], None]
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.fit(F.col("v"), 3)).collect()] == [[1.0, 0.0, 0.0], [1.0, 2.0, 3.0]]


def test_first_vector_takes_the_rule(spark):
    row = scoring.score_samples(samples(spark, [[1, 2, 3]]), fixed_model()).first()
    assert (row.model, row.windowBuffered, row.windowSize) == (labels.RULE_MODEL, 1, 10)
    assert row.inferredStatus == "WARNING" and row.probabilities is None


def lstm_by_hand(m, window):
    """One window, one unit at a time."""
    hidden = len(m.w_hidden[0])
    h, c = [0.0] * hidden, [0.0] * hidden
    for x in window:
        pre = [sum(w * v for w, v in zip(m.w_input[j], x)) + sum(w * v for w, v in zip(m.w_hidden[j], h)) + m.bias[j]
               for j in range(4 * hidden)]
        i, f, g, o = (pre[k * hidden:(k + 1) * hidden] for k in range(4))
        s = lambda v: 1 / (1 + math.exp(-v))
        c = [s(f[k]) * c[k] + s(i[k]) * math.tanh(g[k]) for k in range(hidden)]
        h = [s(o[k]) * math.tanh(c[k]) for k in range(hidden)]
    logits = [sum(w * v for w, v in zip(row, h)) + b for row, b in zip(m.w_class, m.b_class)]
    e = [math.exp(v) for v in logits]
    return [v / sum(e) for v in e]


def test_model_scores_full_windows(spark):
    m = fixed_model()
    data = [[i / 10, -i / 7] if i % 3 else [i / 5, 1, 2, 9] for i in range(14)]    # short and long vectors
    got = scoring.score_samples(samples(spark, data), m).orderBy("seq").collect()
    assert [r.model for r in got] == [labels.RULE_MODEL] * 9 + [m.name] * 5
    for i in range(9, 14):
        window = [(list(v) + [0.0] * 3)[:3] for v in data[i - 9:i + 1]]
        p = lstm_by_hand(m, window)
        assert got[i].inferredStatus == scoring.CLASS_NAMES[int(np.argmax(p))]
        assert [got[i].probabilities[c] for c in scoring.CLASS_NAMES] == pytest.approx(p, abs=5.1e-5)
        assert got[i].windowBuffered is None


def test_missing_weights_mean_the_rule(tmp_path):
    assert scoring.SequenceModel.load(str(tmp_path / "none.npz"), "x") is None
    m, path = fixed_model(), tmp_path / "w.npz"
    np.savez(path, **{k: getattr(m, k) for k in ("w_input", "w_hidden", "bias", "w_class", "b_class")})
    loaded = scoring.SequenceModel.load(str(path), "x")
    x = np.ones((2, 10, 3))
    assert np.allclose(loaded.logits(x), m.logits(x))


def test_splits_keep_captures_whole(spark):
    df = spark.range(2000).select(F.concat(F.lit("c"), F.col("id") % 500).alias("captureId"))
    got = scoring.dataset_splits(df).collect()
    assert len(got) == 500 and {r.split for r in got} == {"train", "val", "test"}
