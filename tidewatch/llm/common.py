"""Helpers the operators share: column picking, white space, filters by row key, Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all operators: space and the control characters 9 to 13.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word is a run of other characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of at most 64 bytes that a join may broadcast after they have been counted (about 64 MB).
BROADCAST_ROWS = 1_000_000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns (new name = old name). The first column with exactly that name is meant, so other columns
    may repeat a name or differ from it only in case."""
    names = df.columns
    inner = [f"__c{i}" for i in range(len(names))]
    return df.toDF(*inner).select(*(F.col(inner[names.index(old)]).alias(new) for new, old in columns.items()))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that tell rows apart: the id, and a hash of the text in case an id repeats or is null."""
    return [doc_id.alias("__id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__raw")]


def without_rows(df: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the rows whose ``row_key`` is in ``dropped`` (columns __id, __raw); all columns stay as they are.

    The keys are broadcast if there are at most BROADCAST_ROWS of them; else both sides are shuffled by the key.
    """
    names = df.columns
    inner = [f"__c{i}" for i in range(len(names))]
    rows = df.toDF(*inner)
    here = row_key(F.col(inner[names.index(doc_id)]), F.col(inner[names.index(text)]))
    rows = rows.select("*", *here)
    gone = dropped.select(F.col("__id").alias("__gone"), F.col("__raw").alias("__gone_raw")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    same = F.col("__id").eqNullSafe(F.col("__gone")) & (F.col("__raw") == F.col("__gone_raw"))
    return rows.join(gone, same, "left_anti").select(*inner).toDF(*names)


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, with A-Z in lower case. bytes.lower and bytes.split know exactly ASCII letters and spaces."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most_bytes`` of text, or one row."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
            if size and size + (n or 0) > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def collapse_repeats(df: DataFrame, repeated: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``df`` with one row for each id in ``repeated`` (column __id), which only rows that may stand for each other share."""
    if repeated.isEmpty():
        return df
    names = df.columns
    inner = [f"__c{i}" for i in range(len(names))]
    rows = df.toDF(*inner).join(repeated.select(F.col("__id").alias("__twice"), F.lit(True).alias("__hit")).distinct(),
                                F.col(inner[names.index(doc_id)]).eqNullSafe(F.col("__twice")), "left")
    one = rows.filter("__hit").dropDuplicates(["__twice"])
    return rows.filter("__hit is null").select(*inner).unionByName(one.select(*inner)).toDF(*names)


def bounded_batches(spark: SparkSession, rows: int = 4000, most_bytes: int = 4 << 20) -> None:
    """Rows and bytes per Arrow batch (or one row): a batch of whole texts is held in memory at once, on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))
