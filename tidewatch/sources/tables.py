"""Sessions and episodes tables that micro-batches add to, as folders of batches that are reduced by key when read.

A batch is reduced to one row per key and written to its own folder, named by writer and batch id; a retried batch replaces
its folder, so each counts once. Nothing is read or rewritten by a write. The row of a key is an aggregate over its rows in all
batches (first user, last time, sum of counts, ...), which does not depend on the order in which batches arrive, so any
number of writers work side by side and a late batch counts as well as any other.

``fold`` is a scheduled job of one writer: it reduces the writer's batches up to the newest one to a folder of its own. Readers
take the newest fold of each writer and the batches after it. Folders that a fold has taken in are no longer read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.sessions import last_outcomes, sessions_rollup
from tidewatch.schemas import ACTIVE, ENDED, EPISODES_TABLE, SESSIONS_TABLE

FOLDERS = "writer string, batch long"


class BatchTable:
    """``reduce`` makes one row per key from rows of the stored form; ``show`` gives the table's columns."""

    def __init__(self, spark: SparkSession, path: str, stored: T.StructType, reduce: Callable[[DataFrame], DataFrame], show: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.stored, self.reduce, self.show = spark, path.rstrip("/"), stored, reduce, show
        for folder in ("batches", "folds"):    # so that both can be read before anything is written
            spark.createDataFrame([], self._schema()).write.mode("ignore").partitionBy("writer", "batch").parquet(f"{self.path}/{folder}")

    def _schema(self) -> T.StructType:
        return T.StructType([*self.stored.fields, T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())])

    def _rows(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(f"{self.path}/{folder}")

    def _put(self, rows: DataFrame, folder: str, writer: str, batch: int) -> None:
        (rows.select(*self.stored.names, F.lit(writer).alias("writer"), F.lit(batch).cast("long").alias("batch"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("writer", "batch").parquet(f"{self.path}/{folder}"))

    def write(self, writer: str, batch: int, rows: DataFrame) -> None:
        """Rows of the stored form as this batch of this writer; a writer's ids grow."""
        self._put(self.reduce(rows), "batches", writer, batch)

    def _folded(self) -> dict[str, int]:
        """The newest fold of each writer; only names of folders are read."""
        return {r.writer: r.batch for r in self._rows("folds").groupBy("writer").agg(F.max("batch").alias("batch")).collect()}

    def _current(self) -> DataFrame:
        folds, batches = self._rows("folds"), self._rows("batches")
        newest, later = F.lit(False), F.lit(True)
        for writer, batch in self._folded().items():
            newest = newest | ((F.col("writer") == writer) & (F.col("batch") == batch))
            later = later & ((F.col("writer") != writer) | (F.col("batch") > batch))
        return batches.where(later).unionByName(folds.where(newest))

    def read(self) -> DataFrame:
        return self.show(self.reduce(self._current()))

    def fold(self, writer: str) -> int | None:
        """Reduce all batches of a writer that are there now to one; gives the id of the newest one it holds."""
        last = self._rows("batches").where(F.col("writer") == writer).agg(F.max("batch")).first()[0]
        if last is not None and self._folded().get(writer, -1) < last:
            rows = self._current().where((F.col("writer") == writer) & (F.col("batch") <= last))
            self._put(self.reduce(rows), "folds", writer, last)
        return last


def _first(value: str) -> Column:
    return F.min_by(value, "first").alias(value)


def sessions_table(spark: SparkSession, path: str, order: str = "bigint") -> BatchTable:
    """``order`` is the type of the samples' ``seq``."""
    place = f"struct<batch:bigint,writer:string,seq:{order}>"
    stored = T.StructType.fromDDL(f"session_id string, user_id string, started_at timestamp, first {place}, last_seen_at timestamp, last {place}, "
                                  "sample_count long, ended boolean")

    def reduce(rows: DataFrame) -> DataFrame:
        return rows.groupBy("session_id").agg(
            _first("user_id"), _first("started_at"), F.min("first").alias("first"), F.max_by("last_seen_at", "last").alias("last_seen_at"),
            F.max("last").alias("last"), F.sum("sample_count").alias("sample_count"), F.bool_or("ended").alias("ended"))

    def show(rows: DataFrame) -> DataFrame:
        # A mark on a session that no sample has named is no session.
        status = F.when(F.col("ended"), ENDED).otherwise(ACTIVE)
        return rows.where("sample_count > 0").withColumn("status", status).select(*SESSIONS_TABLE.names)

    return BatchTable(spark, path, stored, reduce, show)


def episodes_table(spark: SparkSession, path: str) -> BatchTable:
    stored = T.StructType.fromDDL("session_id string, started_at timestamp, user_id string, first struct<alert_count:int,ended:boolean>, "
                                  "last struct<alert_count:int,ended:boolean>, row struct<ended_at:timestamp,duration_seconds:double,"
                                  "alert_count:int,last_alert_at:timestamp,recovered:boolean,ongoing:boolean>")

    def reduce(rows: DataFrame) -> DataFrame:
        return rows.groupBy("session_id", "started_at").agg(
            _first("user_id"), F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("row", "last").alias("row"))

    return BatchTable(spark, path, stored, reduce, lambda rows: rows.select("*", "row.*").select(*EPISODES_TABLE.names))


def record_samples(table: BatchTable, writer: str = "samples"):
    """``foreachBatch`` writer: the sessions of the batch's samples."""
    def write(batch: DataFrame, batch_id: int) -> None:
        def place(seq):
            return F.struct(F.lit(batch_id).cast("long").alias("batch"), F.lit(writer).alias("writer"), F.col(seq).alias("seq"))
        x = sessions_rollup(batch, order=True)
        table.write(writer, batch_id, x.select(
            "session_id", "user_id", "started_at", place("first_seq").alias("first"), "last_seen_at", place("last_seq").alias("last"),
            "sample_count", F.lit(False).alias("ended")))
    return write


def record_outcomes(table: BatchTable, writer: str = "outcomes"):
    """``foreachBatch`` writer: the last outcome of each episode in the batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        place = F.struct("alert_count", (~F.col("ongoing")).alias("ended"))
        row = F.struct("ended_at", "duration_seconds", "alert_count", "last_alert_at", "recovered", "ongoing")
        table.write(writer, batch_id, last_outcomes(batch).select(
            "session_id", "started_at", "user_id", place.alias("first"), place.alias("last"), row.alias("row")))
    return write


def record_expiry(table: BatchTable, expired: DataFrame, batch_id: int, writer: str = "expiry") -> None:
    """Mark sessions (session_id) ENDED; a later sample does not make them ACTIVE again."""
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.stored.fields if f.name not in ("session_id", "sample_count", "ended")]
    table.write(writer, batch_id, expired.select("session_id", *nothing, F.lit(0).cast("long").alias("sample_count"), F.lit(True).alias("ended")))
