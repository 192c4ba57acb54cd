"""Loads and runs that report themselves: rows, seconds and rows per second, and totals counted while rows pass."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewatch.operators import pilot
from tidewatch.schemas import EVENT_ENDED

REPORT = "step string, rows long, seconds double, rowsPerSecond double"


class LoadReport:
    """Writes that are counted as they run. Rows are counted by the write itself, so a frame is computed once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.steps = spark, []

    def run(self, step: str, rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
        seen = Observation()
        start = time.perf_counter()
        write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
        seconds = time.perf_counter() - start
        n = seen.get["rows"]
        self.steps.append((step, n, seconds))
        return n

    def table(self, total: str | None = "total") -> DataFrame:
        """One row per step and, unless ``total`` is None, one for all of them."""
        rows = [*self.steps]
        if total is not None:
            rows.append((total, sum(n for _, n, _ in rows), sum(s for *_, s in rows)))
        return self.spark.createDataFrame([(step, n, s, n / s if s > 0 else None) for step, n, s in rows], REPORT)


def load_captures(rows: DataFrame, write: Callable[[str, DataFrame], None]) -> DataFrame:
    """Capture rows to the participants, sessions and samples tables in the order of their keys; gives the report.

    ``write`` takes the name of a table and its rows, such as a Parquet or a JDBC append.
    """
    report = LoadReport(rows.sparkSession)
    for step, frame in (("participants", pilot.pilot_participants(rows)), ("sessions", pilot.pilot_sessions(rows)), ("samples", pilot.pilot_samples(rows))):
        report.run(step, frame, lambda df, step=step: write(step, df))
    return report.table()


# --- streams ----------------------------------------------------------------------------------------

OUTCOME_TOTALS = "outcomeTotals"


def with_outcome_totals(outcomes: DataFrame) -> DataFrame:
    """Outcomes that are counted per micro-batch on their way to the sink, as the totals of an expiry run are in a batch."""
    ended = F.col("type") == EVENT_ENDED

    def count(condition: Column) -> Column:
        return F.coalesce(F.count_if(condition), F.lit(0).cast("long"))

    return outcomes.observe(OUTCOME_TOTALS, count(F.col("type") == "EVENT_STARTED").alias("started"), count(ended & F.col("recovered")).alias("recovered"),
                            count(ended & ~F.col("recovered")).alias("finalisedEpisodes"))


RUNS = "query string, batch long, rows long, seconds double, rowsPerSecond double, started long, recovered long, finalisedEpisodes long"


class RunMetrics(StreamingQueryListener):
    """A row per micro-batch of all queries of the session, the last ``keep`` of them, from the queries' own progress."""

    def __init__(self, keep: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=keep)
        self.ended: set[str] = set()
        self.change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seconds = p.durationMs.get("triggerExecution", 0) / 1000
        totals = p.observedMetrics.get(OUTCOME_TOTALS)
        counts = tuple(totals[c] for c in ("started", "recovered", "finalisedEpisodes")) if totals is not None else (None,) * 3
        with self.change:
            self.rows.append((p.name or str(p.id), p.batchId, p.numInputRows, seconds, p.numInputRows / seconds if seconds else None, *counts))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.ended.add(str(event.runId))
            self.change.notify_all()

    def wait_for(self, run_id: str, seconds: float = 30) -> bool:
        """Progress arrives on a thread of its own: wait until a query's end has been reported."""
        with self.change:
            return self.change.wait_for(lambda: str(run_id) in self.ended, seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        with self.change:
            return spark.createDataFrame(list(self.rows), RUNS)
