"""Sharding by extendible hashing: a directory over the leading bits of a hash, in which only oversized buckets split.

A bucket is a bit prefix. Starting from one bucket of depth 0, a bucket whose bytes exceed the limit splits on its next bit,
others stay; shards are the buckets of that directory. The directory is computed from byte counts of *cells* (prefixes of
``cell_bits`` bits) that are summed before any shuffle, so it takes two small aggregations whatever the depth: a cell's
shard is its shortest prefix that fits. Cells that are still too large are counted again with more bits, so only hot
places are ever looked at more closely.

A document larger than the limit fills a shard alone as soon as its hash tells it from its neighbours. Rows whose whole
hash is equal (the same id and the same text) cannot be split by bits; if they exceed the limit together, they are cut
into parts by running size. Null texts count as empty, null ids hash as an empty id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import pick
from tidewatch.session import durable

BITS = 60
MAX_BYTES = 16 << 20


def hash_bits(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5 over id and text, as a non-negative long."""
    whole = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(whole, 1, BITS // 4), 16, 10).cast("long")


def directory(rows: DataFrame, max_bytes: int, cell_bits: int) -> DataFrame:
    """Cells (lo, bits) with the shard each belongs to (depth, prefix), from rows of (h, bytes)."""
    level, found = min(cell_bits, BITS), None
    todo, above = rows.select("h", "bytes"), 0
    while True:
        cells = durable(todo.groupBy(F.expr(f"shiftright(h, {BITS - level})").alias("cell")).agg(F.sum("bytes").alias("bytes")))
        depths = F.explode(F.sequence(F.lit(above), F.lit(level))).alias("depth")
        sums = cells.select(depths, "cell", "bytes").groupBy("depth", F.expr(f"shiftright(cell, {level} - depth)").alias("prefix")).agg(F.sum("bytes").alias("total"))
        fits = sums.filter((F.col("total") <= max_bytes) | (F.col("depth") == BITS))
        own = cells.select("cell", depths).withColumn("prefix", F.expr(f"shiftright(cell, {level} - depth)"))
        shards = own.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        shards = shards.select(F.lit(level).alias("bits"), "cell", "depth", F.expr(f"shiftright(cell, {level} - depth)").alias("prefix"))
        shards = durable(shards)
        found = shards if found is None else found.unionByName(shards)
        if level == BITS:
            return found
        large = cells.join(shards, "cell", "left_anti").select("cell")
        if large.isEmpty():
            return found
        todo = todo.withColumn("cell", F.expr(f"shiftright(h, {BITS - level})")).join(large, "cell", "left_semi").drop("cell")
        above, level = level + 1, min(level + 12, BITS)


def shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES, cell_bits: int | None = None) -> DataFrame:
    """One row per document: __id, h, bytes, depth, part (0 unless equal hashes had to be cut), shard (its bits), shard_bytes."""
    body = pick(docs, id=doc_id, text=text)
    rows = durable(body.select(F.col("id").alias("__id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
                               hash_bits(F.col("id"), F.col("text")).alias("h")))
    if cell_bits is None:  # about 64 cells for each shard that the limit asks for
        total = rows.agg(F.sum("bytes")).first()[0] or 0
        cell_bits = min(30, max(6, (64 * total // max_bytes).bit_length()))
    found = directory(rows, max_bytes, cell_bits)
    out = None
    levels = [r[0] for r in found.select("bits").distinct().collect()]  # at most five
    for bits in levels:
        cells = found.filter(F.col("bits") == bits).drop("bits")
        part = rows.withColumn("cell", F.expr(f"shiftright(h, {BITS - bits})")).join(cells, "cell").drop("cell")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.withColumn("depth", F.lit(0)).withColumn("prefix", F.lit(0).cast("long"))
    run = Window.partitionBy("h").orderBy("__id", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    equal = out.filter(F.col("depth") == BITS).withColumn("part", F.floor(F.coalesce(F.sum("bytes").over(run), F.lit(0)) / max_bytes))
    out = out.filter(F.col("depth") < BITS).withColumn("part", F.lit(0).cast("long")).unionByName(equal)
    name = F.concat(F.substring(F.lpad(F.bin(F.col("prefix")), BITS, "0"), F.lit(BITS + 1) - F.col("depth"), F.col("depth")),
                    F.when(F.col("part") > 0, F.concat(F.lit("-"), F.col("part").cast("string"))).otherwise(F.lit("")))
    out = out.select("__id", "h", "bytes", "depth", "part", name.alias("shard"))
    sizes = out.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"))
    return out.join(sizes, "shard")


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES) -> None:
    """Write ``docs`` as Parquet, one folder ``shard_bits=<bits>`` for each shard; other columns stay as they are.

    Rows of equal hash that the directory cuts into parts are one folder of several files here.
    """
    plan = shards(docs, doc_id, text, max_bytes).select("h", F.element_at(F.split("shard", "-"), 1).alias("shard_bits")).distinct()
    names = docs.columns
    inner = [f"__c{i}" for i in range(len(names))]
    body = docs.toDF(*inner)
    h = hash_bits(F.col(inner[names.index(doc_id)]), F.col(inner[names.index(text)]))
    out = body.withColumn("h", h).join(durable(plan), "h").drop("h").repartition("shard_bits")
    out.toDF(*names, "shard_bits").write.partitionBy("shard_bits").parquet(path)
