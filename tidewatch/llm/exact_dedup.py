"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of everything.

Only DataFrame functions. Two texts are equal if they are identical once white space is removed. Rows leave the search as
soon as a cheap key proves them unique: first by normalised length, then by length and prefix hash. Only what is left is
compared by full hash (SHA-256). All shuffled rows are narrow (id, lengths, hashes), counts are combined before they are
shuffled, and a group that holds a third of all rows is one row of counts, joined back with skew splitting (AQE).

Null texts count as empty, and all empty texts are one group. A null id comes after all others. Rows that repeat both id
and text form a group; the report marks all of them as kept, the filter lets one of them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_ROWS, SPACES, pick, row_key, without_rows
from tidewatch.session import durable

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def facts(docs: DataFrame, doc_id: str, text: str, full: bool) -> DataFrame:
    """A narrow row per document, written once: id, raw hash, code points, normalised length, prefix hash (and full hash)."""
    body = pick(docs, id=doc_id, text=text).select(*row_key(F.col("id"), F.col("text")),
                                                    F.length(F.coalesce("text", F.lit(""))).alias("points"), normalised(F.col("text")).alias("norm"))
    out = body.select("__id", "__raw", "points", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("head"),
                      *([F.sha2("norm", 256).alias("sha")] if full else []))
    return durable(out)


def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur more than once."""
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(again, keys, "left_semi")


def candidates(rows: DataFrame) -> DataFrame:
    """What lengths and prefixes cannot tell apart."""
    return shared(shared(rows, ["len"]), ["len", "head"])


def keepers(rows: DataFrame) -> DataFrame:
    """Per (len, sha): the id that stays and the size of the group."""
    longest = rows.groupBy("len", "sha", "points").agg(F.min("__id").alias("id"), F.count(F.lit(1)).alias("n"))
    return longest.groupBy("len", "sha").agg(F.max_by("id", "points").alias("keep_id"), F.sum("n").alias("group_size"), F.max("points").alias("most"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: __id, __raw, keep_id, group_size, kept, sha (of every document, wanted for the report).

    The full hash of every row is taken in the one scan, because it is asked for; the search itself reads it only for rows
    that length and prefix have left.
    """
    rows = facts(docs, doc_id, text, full=True)
    totals = keepers(candidates(rows)).filter("group_size > 1")
    out = rows.join(totals, ["len", "sha"], "left")
    alone = F.col("group_size").isNull()
    return out.select("__id", "__raw", F.when(alone, F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      (alone | (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most")))).alias("kept"), "sha")


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged.

    The text is read a second time, and hashed in full, only for rows that share length and prefix hash with another row.
    """
    rows = facts(docs, doc_id, text, full=False)
    left = durable(candidates(rows))
    body = pick(docs, id=doc_id, text=text)
    body = body.select(*row_key(F.col("id"), F.col("text")), "text")
    keys = left.select(F.col("__id").alias("i"), F.col("__raw").alias("r"), "points", "len").distinct()
    if left.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    full = body.join(keys, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__raw") == F.col("r")))
    full = durable(full.select("__id", "__raw", "points", "len", F.sha2(normalised(F.col("text")), 256).alias("sha")))
    totals = keepers(full)
    marked = full.join(totals, ["len", "sha"])
    stays = F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))
    out = without_rows(docs, marked.filter(~stays).select("__id", "__raw"), doc_id, text)
    # Rows that stay more than once repeat both id and normalised text; they are few, so only they are told apart by content.
    again = durable(marked.filter(stays).groupBy("__id", "len", "sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    if again.isEmpty():
        return out
    names = out.columns
    inner = [f"__c{i}" for i in range(len(names))]
    i, t = names.index(doc_id), names.index(text)
    hit = again.select(F.col("__id").alias("__twice"), "sha").distinct()
    tagged = out.toDF(*inner).withColumn("__sha", F.sha2(normalised(F.col(f"__c{t}")), 256)).join(
        hit, F.col(f"__c{i}").eqNullSafe(F.col("__twice")) & (F.col("sha") == F.col("__sha")), "left")
    one = tagged.filter("sha is not null").dropDuplicates(["__twice", "sha"])
    return tagged.filter("sha is null").select(*inner).unionByName(one.select(*inner)).toDF(*names)
