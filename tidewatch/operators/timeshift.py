"""Moving recorded sessions in time, and multiplying a template session for load tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import instants

# Column names taken as timestamps, and the columns that get noise.
TIME_NAMES = {"capturedat", "serverreceivedat", "startedat", "endedat", "timestamp"}
JITTER_COLUMNS = ["head_gap", "lateral_offset", "shoulder_tilt", "delta_head_gap", "delta_offset",
                  "delta_tilt", "rule_score"]


def time_columns(df: DataFrame) -> list[str]:
    """Text columns holding instants: by name, else those whose every non-empty value parses."""
    named = [c for c in df.columns if c.lower() in TIME_NAMES]
    if named:
        return named
    texts = [name for name, kind in df.dtypes if kind == "string"]
    if not texts:
        return []
    def all_parse(c):
        value = F.nullif(F.trim(F.col(c)), F.lit(""))
        return (F.count(value) > 0) & (F.count(value) == F.count(instants.parse_lenient(value)))
    found = df.agg(*[all_parse(c).alias(c) for c in texts]).first()
    return [c for c in texts if found[c]]


def uuid_like(text: Column) -> Column:
    """The first 32 hex digits of ``text`` in the grouping of a UUID."""
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(text, start, n) for start, n in cuts])


def rebase_time(df: DataFrame, to: datetime | Column, columns: list[str] | None = None,
                session_column: str | None = "sessionId", seed: str = "0") -> DataFrame:
    """Shift the text instants so that the latest becomes ``to``; gaps and formats are kept.

    Session ids are replaced one-to-one by a hash of seed and id, so a rerun gives the same ids.
    Values that do not parse stay as they are.
    """
    columns = time_columns(df) if columns is None else columns
    if not columns:
        raise ValueError("no timestamp column found")
    parsed = {c: F.unix_micros(instants.parse_lenient(F.col(c))) for c in columns}
    latest = df.agg(F.max(F.greatest(*parsed.values()) if len(columns) > 1 else parsed[columns[0]])).scalar()
    target = F.unix_micros(to if isinstance(to, Column) else F.lit(to).cast("timestamp"))
    shifted = {c: F.coalesce(instants.iso_like(F.timestamp_micros(us + (target - latest)), F.col(c)), F.col(c))
               for c, us in parsed.items()}
    if session_column and session_column in df.columns:
        shifted[session_column] = uuid_like(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(session_column, F.lit(""))), 256))
    return df.withColumns(shifted)


def noise(seed: int, width: float, *parts: Column) -> Column:
    """A repeatable number spread evenly over -width..width, from a hash of ``parts``."""
    unit = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256), 1, 12), 16, 10)
    return (unit.cast("double") / F.lit(float(1 << 48)) * 2 - 1) * F.lit(float(width))


def replicate_sessions(template: DataFrame, n: int, participants: list[str], *, jitter: float = 0.01,
                       gap_seconds: float = 120.0, seed: int = 42, block: int = 100) -> DataFrame:
    """``n`` copies of a template session: new ids, participants in turn, starts ``gap_seconds`` apart.

    ``template`` has text columns and a ``seq``. Copies are numbered in two steps, blocks and copies
    within a block, with a shuffle between, so that a small template still feeds many tasks.
    """
    blocks = -(-n // block)
    x = template.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    x = x.repartition("_block", "seq")
    first = F.col("_block") * block
    x = x.withColumn("copy", F.explode(F.sequence(first, F.least(first + block, F.lit(n)) - 1)))
    base = template.agg(F.min_by("started_at", "seq")).scalar()
    start_us = F.unix_micros(instants.parse_lenient(base)) + F.col("copy") * F.lit(round(gap_seconds * 1e6))
    names = F.array(*[F.lit(p) for p in participants])
    columns = {
        "capture_id": uuid_like(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("copy").cast("string")), 256)),
        "participant_code": F.get(names, F.col("copy") % len(participants)),
        "started_at": instants.iso_millis(F.timestamp_micros(start_us))}
    if jitter > 0:
        for c in JITTER_COLUMNS:
            number = F.nullif(F.col(c), F.lit("")).try_cast("double")
            noisy = number + noise(seed, jitter, F.col("copy").cast("string"), F.col("seq").cast("string"), F.lit(c))
            columns[c] = F.when(number.isNotNull(), noisy.cast("string")).otherwise(F.col(c))
    return x.withColumns(columns).drop("_block")
