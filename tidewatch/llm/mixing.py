"""Mixing sources to target weights: hash-random order, distributed prefix sums, cut at each source's budget.

Only DataFrame functions. Every row gets a hash-random key. Inside a source the key's range is divided into equal slices, so
many of them that none holds more than about ``rows_per_slice`` rows. Sizes are summed per slice (combined before the
shuffle), the slice sums are accumulated per source, and inside a slice rows are sorted and accumulated. No task sees a
whole source, however hot it is; the only window over a source runs over its slices.

A source with target T and size S gives ``floor(T) div S`` whole repetitions, and of one further pass the first
``floor(T) mod S`` words in key order. The document on the cut gives only the words still missing (``cut="exact"``), or
all of its words if at least half of them fit and none otherwise (``cut="whole"``).

Null texts have size 0 and are taken 0 times. A null source is a source of its own, after all others. Rows that repeat both
id and text have the same key and follow each other; which of them is on the cut makes no difference to the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_ROWS, WORD, pick
from tidewatch.session import durable

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2
ROWS_PER_SLICE = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Per source (columns source, source_size): its target.

    Sources in code-point order, null last, weigh ``weights`` in turn and divide ``share`` of all words. A target stops at
    ``most_epochs`` times its source, and the rest is divided anew by weight until no target is above its limit. That fixed
    point is ``min(limit, weight * level)``: with sources sorted by limit per weight, the level is the first
    (words - limits so far) / (weights not yet limited) that the next source can bear.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("turn") + 1))
    rows = rows.withColumn("most", F.lit(most_epochs) * F.col("source_size"))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("source", "source_size", "weight", "most", F.row_number().over(order).alias("place"),
                       ((F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(below), F.lit(0)))
                        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))).alias("level"))
    able = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("place"))
    rows = rows.withColumn("level", F.min_by("level", able).over(every))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0)))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
        share: float = SHARE, most_epochs: int = MOST_EPOCHS, cut: str = "exact", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One row per document: __id, __raw (hash of the text), __source, size, source_size, target, taken (words, repeats counted)."""
    body = pick(docs, id=doc_id, text=text, source=source)
    rows = body.select(F.col("id").alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__raw"), "source", n_words(F.col("text")).alias("size"),
                       F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))).alias("key"))
    rows = durable(rows)
    known = F.coalesce("source", F.lit(""))
    rows = rows.select("*", known.alias("s"), F.col("source").isNull().alias("no_s")).drop("source")
    sources = rows.groupBy("s", "no_s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = targets(sources.select(F.when(~F.col("no_s"), F.col("s")).alias("source"), "source_size"), weights, share, most_epochs)
    goal = goal.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_s"), "target")
    goal = sources.join(goal, ["s", "no_s"]).select("*", F.ceil(F.col("n") / rows_per_slice).cast("long").alias("slices"))
    goal = durable(goal)  # one row per source: broadcast if a count shows that there are few
    if goal.count() <= BROADCAST_ROWS:
        goal = F.broadcast(goal)
    place = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")  # 28 bits
    rows = rows.join(goal.drop("n"), ["s", "no_s"]).withColumn("slice", F.floor(place * F.col("slices") / F.lit(float(1 << 28))))
    part = ["s", "no_s", "slice"]
    sums = rows.groupBy(*part).agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("s", "no_s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*part, F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("slice_before"))
    inside = Window.partitionBy(*part).orderBy("key", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, part)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col("slice_before") - F.col("before")
    if cut == "exact":
        more = F.greatest(F.lit(0), F.least(F.col("size"), left))
    elif cut == "whole":
        more = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    else:
        raise ValueError(f"cut must be exact or whole, not {cut!r}")
    return rows.select("__id", "__raw", F.when(~F.col("no_s"), F.col("s")).alias("__source"), "size", "source_size", "target", (epochs * F.col("size") + more).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: each document as many times as it is taken (0, 1, 2, ...), whole, with all its columns."""
    taken = mix(docs, doc_id, text, source, cut="whole", **how).filter("size > 0")
    times = taken.select(F.col("__id").alias("__mix_id"), F.col("__raw").alias("__mix_raw"), F.col("__source").alias("__mix_source"), (F.col("taken") / F.col("size")).cast("int").alias("__times"))
    names = docs.columns
    inner = [f"__c{i}" for i in range(len(names))]
    body = docs.toDF(*inner)
    i, t, o = inner[names.index(doc_id)], inner[names.index(text)], inner[names.index(source)]
    # Rows that repeat id, text and source share a key: their counts are added up and given to one of them.
    named = ["__mix_id", "__mix_raw", "__mix_source"]
    times = times.groupBy(*named).agg(F.sum("__times").alias("__times"), F.count(F.lit(1)).alias("__rows"))
    times = durable(times.filter("__times > 0"))
    plain, rare = times.filter("__rows = 1"), times.filter("__rows > 1")
    key = (F.col(i).eqNullSafe(F.col("__mix_id")) & (F.xxhash64(F.coalesce(F.col(t), F.lit(""))) == F.col("__mix_raw"))
           & F.col(o).eqNullSafe(F.col("__mix_source")))
    if times.count() <= BROADCAST_ROWS:
        plain = F.broadcast(plain)
    out = body.join(plain, key).select(*inner, "__times")
    if not rare.isEmpty():
        out = out.unionByName(body.join(rare, key).dropDuplicates(named).select(*inner, "__times"))
    return out.withColumn("__n", F.explode(F.array_repeat(F.lit(1), F.col("__times").cast("int")))).select(*inner).toDF(*names)
