"""Ordered per-key work that survives a hot key.

A window partitioned by session puts a whole session into one task. That is the right plan while
every session is of ordinary size, and the wrong one when a single key holds a large share of the
table. ``plan_split`` looks at the size of the largest key (a map-side combined count over the key column). When
it is no larger than ``rows_per_part`` nothing changes: windows partition by the key alone and need
one exchange. Otherwise the rows go through one range exchange on (key, order), which spreads every key over as many tasks
as it needs, and get their position in their key by prefix sums over one row per task and key. Positions cut each large key
into *parts* of exactly ``rows_per_part`` rows. Windows run per (key, part), and what a part has to know about the
earlier ones is the last value of some column before it: an associative summary, one row per part, scanned over the parts.

Nothing depends on where the range exchange cuts, and no list of cut points is sent to any row; results do not depend on
where the parts end.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.session import durable

PART = "_part"

ROWS_PER_PART = 2_000_000
BROADCAST_ROWS = 100_000   # rows of a written summary that a join may broadcast; others are shuffled


@dataclass(frozen=True)
class Split:
    """How the rows of one frame are grouped (``key``), ordered (``order``) and, if needed, cut."""

    key: str
    order: tuple[str, ...]
    rows_per_part: int | None = None    # None: no key has to be cut

    def ordered_by(self, *order: str) -> Split:
        """The same parts for a frame derived from the first one, with order columns of its own."""
        return replace(self, order=order)

    @property
    def hot(self) -> bool:
        return self.rows_per_part is not None

    @property
    def keys(self) -> list[str]:
        return [self.key, PART] if self.hot else [self.key]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the part number of every row of a large key (null for all other keys); written once."""
        if not self.hot:
            return df
        order = [self.key, *self.order]
        # After the sort the id counts the rows of a task from the task's number on.
        rows = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
        tasks = rows.groupBy(F.col(self.key).alias("_key"), F.shiftright("_id", 33).alias("_task")).agg(
            F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_here"))
        of_key = Window.partitionBy("_key")
        before = F.sum("_here").over(of_key.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
        tasks = tasks.withColumns({"_before": F.coalesce(before, F.lit(0).cast("long")), "_all": F.sum("_here").over(of_key)})
        # One row per task of a large key.
        large = durable(tasks.where(F.col("_all") > self.rows_per_part).drop("_here", "_all"))
        same = F.col(self.key).eqNullSafe(F.col("_key")) & (F.shiftright("_id", 33) == F.col("_task"))
        position = F.col("_before") + F.col("_id") - F.col("_first")
        return (rows.join(checked(large), same, "left")
                    .withColumn(PART, F.floor(position / self.rows_per_part).cast("int"))
                    .drop("_id", "_key", "_task", "_first", "_before"))

    def last_before(self, df: DataFrame, out: str, value: Column, *,
                    inclusive: bool = False) -> DataFrame:
        """``out`` = the last non-null ``value`` of the key before (or at) each row."""
        upto = 0 if inclusive else -1
        df = df.withColumn("_v", value)
        near = F.last("_v", ignorenulls=True).over(
            self.window().rowsBetween(Window.unboundedPreceding, upto))
        if not self.hot:
            return df.withColumn(out, near).drop("_v")
        at = F.when(F.col("_v").isNotNull(), F.struct(*self.order))
        tails = (df.where(F.col(PART).isNotNull())
                   .groupBy(*self.keys).agg(F.max_by("_v", at).alias("_tail")))
        return (df.withColumn("_near", near)
                  .join(self._earlier(tails), self.keys, "left")
                  .withColumn(out, F.coalesce("_near", "_carry"))
                  .drop("_v", "_near", "_carry"))

    def _earlier(self, tails: DataFrame) -> DataFrame:
        """Per part, the last tail among the earlier parts of its key ."""
        w = Window.partitionBy(self.key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        return tails.select(
            *self.keys, F.last("_tail", ignorenulls=True).over(w).alias("_carry"))

    def running_count(self, df: DataFrame, out: str, flag: Column) -> DataFrame:
        """``out`` = how many rows of the key up to and including each row satisfy ``flag``."""
        w = self.window().rowsBetween(Window.unboundedPreceding, 0)
        hit = F.when(flag, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        df = df.withColumn("_hit", hit)
        near = F.sum("_hit").over(w)
        if not self.hot:
            return df.withColumn(out, near).drop("_hit")
        totals = (df.where(F.col(PART).isNotNull())
                    .groupBy(*self.keys).agg(F.sum("_hit").alias("_total")))
        w_parts = Window.partitionBy(self.key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(*self.keys, F.sum("_total").over(w_parts).alias("_carry"))
        return (df.withColumn("_near", near)
                  .join(carry, self.keys, "left")
                  .withColumn(out, F.col("_near") + F.coalesce("_carry", F.lit(0).cast("long")))
                  .drop("_hit", "_near", "_carry"))

    def last_n(self, df: DataFrame, out: str, value: Column, n: int) -> DataFrame:
        """``out`` = array of the last ``n`` non-null ``value`` up to and including each row."""
        # Rows without a value do not take a place, so the frame counts values, not rows.
        w = self.window()
        df = df.withColumn("_v", value)
        df = df.withColumn("_nth", F.count("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        by_value = (Window.partitionBy(*self.keys).orderBy("_nth")
                    .rangeBetween(-(n - 1), Window.currentRow))
        # Among rows of one count only the first holds the value; the others are null and skipped.
        df = df.withColumn(out, F.when(
            F.col("_nth") > 0, F.collect_list("_v").over(by_value)).otherwise(F.array()))
        if not self.hot:
            return df.drop("_v", "_nth")
        tails = (df.where(F.col(PART).isNotNull())
                   .groupBy(*self.keys)
                   .agg(F.max_by(out, F.when(F.col("_v").isNotNull(), F.struct(*self.order)))
                         .alias("_tail")))
        w_parts = Window.partitionBy(self.key).orderBy(PART)
        last_tails = (Window.partitionBy(self.key).orderBy("_nth_tail")
                      .rangeBetween(-(n - 1), Window.currentRow))
        # Every tail holds a value, so n of them are enough.
        carry = (tails
                 .withColumn("_nth_tail", F.count("_tail").over(
                     w_parts.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("_upto", F.flatten(F.collect_list("_tail").over(last_tails)))
                 .select(*self.keys, F.lag("_upto").over(w_parts).alias("_earlier")))
        joined = F.when(F.col("_earlier").isNull(), F.col(out)).otherwise(F.concat("_earlier", out))
        return (df.join(carry, self.keys, "left")
                  .withColumn(out, F.when(F.size(joined) > n, F.slice(joined, -n, n)).otherwise(joined))
                  .drop("_v", "_nth", "_earlier"))


def plan_split(df: DataFrame, key: str, order: tuple[str, ...],
               rows_per_part: int = ROWS_PER_PART) -> Split:
    """Decide by the size of the largest key of ``df`` whether keys have to be cut."""
    most = df.groupBy(key).count().agg(F.max("count")).first()[0]
    return Split(key, order, rows_per_part if most and most > rows_per_part else None)


def checked(df: DataFrame) -> DataFrame:
    """A written frame, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
