"""Scoring: the threshold rule, sliding feature windows, model scores, training examples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import labels, vectors
from tidewatch.plans.ordered import ROWS_PER_PART, Split, plan_split
from tidewatch.schemas import CLASS_NAMES, UNKNOWN, UNKNOWN_SESSION

# Vectors per window and numbers per vector.
WINDOW_SIZE = 10
VECTOR_SIZE = 3


def label_by_rule(samples: DataFrame) -> DataFrame:
    """Rule label, the status that came with the sample, and whether the label counts as bad."""
    label = labels.rule_label(F.col("deviationScore"), F.col("ruleStatus"))
    return samples.withColumns({
        "receivedRuleStatus": F.coalesce("ruleStatus", F.lit(UNKNOWN)),
        "inferredStatus": label, "bad": labels.is_bad(label), "model": F.lit(labels.RULE_MODEL)})


def numeric_vector(width: int | None) -> Column:
    """The sample's vector as doubles, fitted to ``width`` once if a model will read it."""
    vector = vectors.to_doubles(F.col("featureVector"))
    return vector if width is None else vectors.fit(vector, width)


def feature_windows(samples: DataFrame, size: int = WINDOW_SIZE, rows_per_part: int = ROWS_PER_PART,
                    width: int | None = None) -> DataFrame:
    """Each sample with the last ``size`` valid vectors of its session, its own included.

    ``featureVector`` may hold doubles or text. A sample with a non-numeric element is not windowed
    (``windowed`` false) and does not enter later windows; an empty vector does. Samples without a time come before those
    with one, in order of ``seq``; only the episode rules leave them out.
    """
    keyed, split = _keyed(samples, rows_per_part, width)
    windows = split.last_n(split.assign(keyed), "window", F.col("vector"), size)
    if split.hot:
        windows = windows.drop("_part")
    return windows.withColumns({
        "windowed": F.col("vector").isNotNull(), "windowBuffered": F.size("window"),
        "windowSize": F.lit(size)})


def window_key() -> Column:
    return F.coalesce(F.nullif("sessionId", F.lit("")), F.lit(UNKNOWN_SESSION))


def _keyed(samples: DataFrame, rows_per_part: int, width: int | None) -> tuple[DataFrame, Split]:
    keyed = samples.withColumns({"windowKey": window_key(), "vector": numeric_vector(width)})
    return keyed, plan_split(keyed, "windowKey", ("capturedAt", "seq"), rows_per_part)


@dataclass(frozen=True)
class SequenceModel:
    """Weights of a one-layer LSTM classifier over a window, gates in the order i, f, g, o."""

    name: str
    w_input: np.ndarray       # (4 * hidden, vector size)
    w_hidden: np.ndarray      # (4 * hidden, hidden)
    bias: np.ndarray          # (4 * hidden,)
    w_class: np.ndarray       # (classes, hidden)
    b_class: np.ndarray       # (classes,)

    @classmethod
    def load(cls, path: str, name: str) -> SequenceModel | None:
        """Read an ``.npz`` of the five arrays; None when it is missing or unusable."""
        try:
            with np.load(path) as z:
                model = cls(name, *[z[k].astype(np.float64) for k in
                                    ("w_input", "w_hidden", "bias", "w_class", "b_class")])
            model.logits(np.zeros((1, WINDOW_SIZE, model.w_input.shape[1])))
            return model
        except (OSError, KeyError, ValueError):
            return None

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """(n, steps, vector size) -> (n, classes), one step of all windows at a time."""
        def sigmoid(x):
            return 1.0 / (1.0 + np.exp(-x))
        hidden = np.zeros((len(windows), self.w_hidden.shape[1]))
        cell = np.zeros_like(hidden)
        for step in range(windows.shape[1]):
            gates = windows[:, step] @ self.w_input.T + hidden @ self.w_hidden.T + self.bias
            i, f, g, o = np.split(gates, 4, axis=1)
            cell = sigmoid(f) * cell + sigmoid(i) * np.tanh(g)
            hidden = sigmoid(o) * np.tanh(cell)
        return hidden @ self.w_class.T + self.b_class

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self.logits(windows)
        powers = np.exp(logits - logits.max(axis=1, keepdims=True))
        return powers / powers.sum(axis=1, keepdims=True)


class WindowScorer:
    """Vectors of one session in their order -> how many its window holds at each, and the class probabilities of full windows.

    Keeps the last ``size`` vectors, so a session may come in pieces. Windows are strided views of the vectors.
    """

    def __init__(self, model: SequenceModel, size: int, recent: np.ndarray | None = None):
        self.model, self.size = model, size
        self.recent = np.empty((0, model.w_input.shape[1])) if recent is None or not len(recent) else recent

    def score(self, matrix: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, list[np.ndarray | None]]:
        """``matrix`` holds the vectors of the ``valid`` samples; the others see the window as it is and change nothing."""
        every = np.concatenate([self.recent, matrix])
        held = np.minimum(self.size, len(self.recent) + np.cumsum(valid))
        out: list[np.ndarray | None] = [None] * len(valid)
        full = np.flatnonzero(valid & (held == self.size))
        if len(full):
            windows = np.lib.stride_tricks.sliding_window_view(every, self.size, axis=0).transpose(0, 2, 1)
            for i, p in zip(full.tolist(), self.model.probabilities(windows[len(windows) - len(full):]), strict=True):
                out[i] = p
        self.recent = every[max(0, len(every) - self.size):]
        return held, out


def _score_sorted(batches: Iterator[pa.RecordBatch], model: SequenceModel, size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by session, time and seq, with windowBuffered and _p; a session may go on in the next batch."""
    name, scorer = None, None
    for batch in batches:
        keys = batch.column("windowKey").to_pylist()
        vectors_ = batch.column("vector")
        valid = vectors_.is_valid().to_numpy(zero_copy_only=False)
        numbers = vectors_.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, model.w_input.shape[1])
        before = np.append(0, np.cumsum(valid))
        held, found, start = np.zeros(len(keys), np.int32), [], 0
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for end in [*cuts, len(keys)]:
            if end > start:
                if scorer is None or keys[start] != name:
                    name, scorer = keys[start], WindowScorer(model, size)
                held[start:end], p = scorer.score(numbers[before[start]:before[end]], valid[start:end])
                found += p
                start = end
        keep = [c for c in batch.schema.names if c != "vector"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(held), pa.array(found, pa.list_(pa.float64()))],
                                         [*keep, "windowBuffered", "_p"])


def _scored_by_model(keyed: DataFrame, model: SequenceModel, size: int) -> DataFrame:
    """One exchange by session and one Arrow pass over the sorted rows; a vector is sent once, not once per window."""
    rows = keyed.repartition("windowKey").sortWithinPartitions("windowKey", "capturedAt", "seq")
    schema = rows.drop("vector").select("*", F.lit(0).alias("windowBuffered"), F.lit(None).cast("array<double>").alias("_p")).schema

    def run(batches):
        return _score_sorted(batches, model, size)

    return rows.mapInArrow(run, schema)


def class_scores(model: SequenceModel):
    """Column function: flat array of window numbers -> class probabilities, in Arrow batches."""
    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            full = batch.is_valid().to_numpy(zero_copy_only=False)
            numbers = batch.drop_null().flatten().to_numpy(zero_copy_only=False)
            n = int(full.sum())
            p = model.probabilities(numbers.reshape(n, -1, model.w_input.shape[1])) if n else np.empty((0, 0))
            ends = np.cumsum(np.where(full, len(model.b_class), 0))
            yield pa.ListArray.from_arrays(
                pa.array(np.append(0, ends), pa.int32()), pa.array(p.ravel()), mask=pa.array(~full))
    return score


def score_samples(samples: DataFrame, model: SequenceModel | None = None, size: int = WINDOW_SIZE,
                  rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Label by the model where a sample completes a full window, else by the rule.

    Without a model only the number of vectors in the window is needed, a running count. With one, sessions are scored in one
    Arrow pass over their sorted rows; only where a session has to be cut do rows carry their window.
    """
    keyed, split = _keyed(samples, rows_per_part, width_of(model))
    if model is None:
        x = split.running_count(split.assign(keyed), "_held", F.col("vector").isNotNull())
        x = x.withColumns({"windowBuffered": F.least(F.col("_held"), F.lit(size)).cast("int"), "_p": F.lit(None).cast("array<double>")})
    elif split.hot:
        x = split.last_n(split.assign(keyed), "window", F.col("vector"), size).withColumn("windowBuffered", F.size("window"))
        full = F.col("vector").isNotNull() & (F.col("windowBuffered") == size)
        x = x.withColumn("_p", class_scores(model)(F.when(full, F.flatten("window"))))
    else:
        x = _scored_by_model(keyed, model, size)
    return choose_label(x, model, size)


def width_of(model: SequenceModel | None) -> int | None:
    return None if model is None else model.w_input.shape[1]


def choose_label(scored: DataFrame, model: SequenceModel | None, size: int = WINDOW_SIZE, keep: Sequence[str] = ()) -> DataFrame:
    """The label of samples that carry windowBuffered and, where their window was scored, its class probabilities ``_p``.

    Also used on the stream, where keyed state holds the windows.
    """
    x = label_by_rule(scored)
    by_model = F.col("_p").isNotNull()
    return x.select(
        F.when(by_model, F.col("windowKey")).otherwise(F.col("sessionId")).alias("sessionId"),
        "userId", "seq", "receivedRuleStatus",
        F.when(by_model, labels.first_max_class(F.col("_p"))).otherwise(F.col("inferredStatus")).alias("inferredStatus"),
        F.when(by_model, labels.class_probabilities(F.col("_p"))).alias("probabilities"),
        "deviationScore", "capturedAt", "serverReceivedAt",
        F.when(by_model, model.name if model else None).otherwise(F.col("model")).alias("model"),
        F.when(~by_model, F.col("windowBuffered")).alias("windowBuffered"), F.lit(size).alias("windowSize"), *keep)


def softmax_label(df: DataFrame, logits: Column) -> DataFrame:
    """Class and rounded probabilities from an array of logits."""
    x = df.withColumn("_p", labels.softmax(logits))
    return x.withColumns({"inferredStatus": labels.first_max_class(F.col("_p")),
                          "probabilities": labels.class_probabilities(F.col("_p"))}).drop("_p")


def training_windows(samples: DataFrame, label: str = "manualLabel", size: int = WINDOW_SIZE,
                     rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Full windows of fitted vectors with the label of their last sample."""
    x = feature_windows(samples, size, rows_per_part)
    full = F.col("windowed") & (F.col("windowBuffered") == size) & F.col(label).isNotNull()
    return x.where(full).select(
        F.col("windowKey").alias("captureId"), "seq",
        F.transform("window", lambda v: vectors.fit(v, VECTOR_SIZE)).alias("window"),
        F.col(label).alias("label"))


def split_of(capture_id: Column, train: int = 8, val: int = 1) -> Column:
    """train / val / test by a hash of the capture, in tenths, so a capture is never divided."""
    bucket = F.conv(F.substring(F.md5(capture_id), 1, 8), 16, 10).cast("long") % 10
    return F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("test")


def dataset_splits(captures: DataFrame, capture_id: str = "captureId") -> DataFrame:
    return (captures.select(F.col(capture_id).alias("captureId")).distinct()
                    .withColumn("split", split_of(F.col("captureId"))))


def label_accuracy(predictions: DataFrame, predicted: str, actual: str, by: list[str]) -> DataFrame:
    """Share of rows whose prediction equals the label, per group, as metric rows."""
    hit = F.sum(F.when(F.col(predicted) == F.col(actual), 1).otherwise(0))
    return (predictions.where(F.col(actual).isNotNull()).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("samples"), (hit / F.count(F.lit(1))).alias("metricValue"))
            .withColumn("metricName", F.lit("accuracy")))


def inference_recent(samples: DataFrame, limit: int = 20, model: SequenceModel | None = None, size: int = WINDOW_SIZE) -> DataFrame:
    """The last ``limit`` samples (1..50) with their scores, oldest first.

    The newest samples are found first; only their sessions (at most 50) are scored.
    """
    n = min(50, max(1, limit))
    newest = samples.orderBy(F.desc("seq")).limit(n).select(window_key().alias("_key")).distinct()
    kept = samples.join(F.broadcast(newest), window_key().eqNullSafe(F.col("_key")), "left_semi")
    return score_samples(kept, model, size).orderBy(F.desc("seq")).limit(n).orderBy("seq")


__all__ = ["CLASS_NAMES", "SequenceModel", "dataset_splits", "feature_windows", "inference_recent",
           "label_accuracy", "label_by_rule", "score_samples", "softmax_label", "split_of",
           "training_windows"]
