"""Partitioned Parquet, capture CSV files, and batched table writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.ingest import with_event_date


def write_by_date(events: DataFrame, path: str, mode: str = "overwrite", rebalance: bool = False) -> None:
    """Parquet partitioned by event date.

    With ``rebalance`` the rows are shuffled by date first, so that files have about
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``: large dates are split, small ones put together. Files are sorted
    by session, which lets a session lookup skip most row groups.
    """
    dated = with_event_date(events) if "eventDate" not in events.columns else events
    if rebalance:
        dated = dated.hint("rebalance", "eventDate").sortWithinPartitions("eventDate", "sessionId")
    dated.write.mode(mode).partitionBy("eventDate").parquet(path)


def read_by_date(spark: SparkSession, path: str, first: str | None = None,
                 last: str | None = None) -> DataFrame:
    """Landed events, optionally only the given dates (pruned before any file is opened)."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("eventDate") >= F.lit(first).cast("date"))
    if last is not None:
        df = df.where(F.col("eventDate") <= F.lit(last).cast("date"))
    return df


def compare_partitions(written: DataFrame, read: DataFrame) -> DataFrame:
    """Rows written and read per event date."""
    def counts(df, name):
        return df.groupBy("eventDate").agg(F.count(F.lit(1)).alias(name))
    return counts(written, "rowsWritten").join(counts(read, "rowsRead"), "eventDate", "full_outer").select(
        "eventDate", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rowsWritten", "rowsRead")])


def check_roundtrip(written: DataFrame, read: DataFrame) -> None:
    """Fail when any event date has a different number of rows on disk."""
    bad = compare_partitions(written, read).where(F.col("rowsWritten") != F.col("rowsRead"))
    if not bad.isEmpty():
        raise ValueError("rows written and rows read differ")


def session_lookup(events: DataFrame, session_id: str | Column) -> DataFrame:
    return events.where(F.col("sessionId") == session_id)


def file_order() -> Column:
    """Position of a row: its file, the block of the file, and the row within the reading task."""
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"), in_task.alias("row"))


def read_captures(spark: SparkSession, paths: str | list[str], *, multi_line: bool = False) -> DataFrame:
    """Capture CSV files with a header, all text, plus ``seq`` in file order.

    Quotes inside a field are doubled; a UTF-8 byte order mark is skipped. Fields that hold newlines need ``multi_line``,
    which reads each file in one task. Without it, a row of the wrong width (such as half a row) is an error.
    """
    rows = (spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
            .option("multiLine", multi_line).option("mode", "FAILFAST").option("emptyValue", "").option("nullValue", "").csv(paths))
    return rows.select("*", file_order().alias("seq"))


def write_captures(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    (rows.drop("seq").write.mode(mode).option("header", True).option("escape", '"')
         .option("emptyValue", "").csv(path))


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], *,
               batch_rows: int = 200, mode: str = "append"):
    """Append to a database table in statements of ``batch_rows`` rows. A task that is retried appends its rows again, so the
    table needs a key, or the caller a staging table."""
    return (df.write.mode(mode).option("batchsize", batch_rows).option("isolationLevel", "NONE")
            .jdbc(url, table, properties=properties))
