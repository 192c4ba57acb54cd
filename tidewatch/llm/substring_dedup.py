"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash (shift and add of a random number per byte) runs over the UTF-8 bytes of each whole text. Its bit 15 and those
below depend on the last 16 bytes only, so a chunk ends wherever CUT_BITS of them are zero, whatever stands before: after an
insertion the same chunks follow. Chunks are not forced to a least or greatest size, which would undo that.

Chunks are compared by a 64-bit digest. Digests that occur more than once are counted with map-side combination, and chunks
are joined with those; a chunk that a third of all rows hold is one combined row on one side and split by AQE on the other.
Neighbouring repeated chunks of a document form spans, and spans of at least ``min_chars`` characters are given out: single
chunks of common words do not count. The first document (smallest id) that has a chunk keeps it, there the first place.

A document is an id and a text (a hash of it), so texts that share an id, and texts without one, are told apart. Rows that
repeat both are one document: their spans are given once, and they are no repeats of each other. A document without an id owns a
chunk only if none with an id has it. Null and empty texts have no chunks; an empty table has no spans. Digests of chunks are
written once, so texts are read and cut once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_ROWS, pick, row_key, small_batches, texts
from tidewatch.session import durable

WINDOW = 16
CUT_BITS = 5  # one cut in 32 bytes
MIN_CHARS = 80
GEAR = np.random.default_rng(7).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum over the last 16 bytes of GEAR[byte] << distance, in 16 bits."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):  # windows of 2, 4, 8 and 16 bytes
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint16(step)
        h = longer
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks; never inside a character, and the last is the end of the text."""
    ends = np.flatnonzero(gear(data) < np.uint16(1 << (16 - CUT_BITS))) + 1
    ends = ends[ends < len(data)]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    return np.append(ends, len(data))


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk of each row: id, raw (hash of the text), digest, start and end in characters."""
    rows = pick(docs, id=doc_id, text=text)
    rows = rows.select(*(c.alias(n) for c, n in zip(row_key(F.col("id"), F.col("text")), ("id", "raw"), strict=True)), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            index, digests, starts, ends = [], [], [], []
            for i, t in enumerate(texts(batch)):
                if not t:
                    continue
                raw = t.encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                end = cuts(data)
                places = end.tolist()
                digests += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip([0, *places], places, strict=False)]
                if len(raw) != len(t):
                    end = np.cumsum((data & 0xC0) != 0x80)[end - 1]
                index.append(np.full(len(end), i))
                ends.append(end)
                starts.append(np.concatenate([[0], end[:-1]]))
            if index:
                of = pa.array(np.concatenate(index))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(of), batch.column("raw").take(of), pa.array(np.array(digests, np.uint64).view(np.int64)),
                                                  pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32))], ["id", "raw", "digest", "start", "end"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, raw long, digest long, start int, end int")


def of_documents(every: DataFrame) -> DataFrame:
    """Chunks of each document once, where several rows repeat its id and text."""
    twice = every.filter("start = 0").groupBy("id", "raw").count().filter("count > 1")
    twice = durable(twice.select(F.col("id").alias("twice"), F.col("raw").alias("twice_raw")))
    n = twice.count()
    if not n:
        return every
    same = F.col("id").eqNullSafe(F.col("twice")) & (F.col("raw") == F.col("twice_raw"))
    marked = every.join(F.broadcast(twice) if n <= BROADCAST_ROWS else twice, same, "left")
    plain = marked.filter("twice_raw is null").select(*every.columns)
    return plain.unionByName(marked.filter("twice_raw is not null").select(*every.columns).distinct())


def repeated_chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Chunks that stand more than once: id, raw, start, end, first_id, removed (kept by another document, or earlier in this one)."""
    every = of_documents(durable(chunks(docs, doc_id, text)))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "raw")).alias("first")
    again = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1").drop("n")
    hits = every.join(durable(again), "digest")
    turn = F.row_number().over(Window.partitionBy("id", "raw", "digest").orderBy("start"))
    here = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("raw") == F.col("first.raw"))
    return hits.select("id", "raw", "start", "end", F.col("first.id").alias("first_id"), (~here | (turn > 1)).alias("removed"))


def spans_of(hits: DataFrame, min_chars: int, alike: bool) -> DataFrame:
    """Runs of neighbouring chunks of a document of at least ``min_chars``; with ``alike``, all removed or all kept."""
    order = Window.partitionBy("id", "raw").orderBy("start", "end")
    fresh = F.lag("end").over(order) != F.col("start")
    if alike:
        fresh = fresh | (F.lag("removed").over(order) != F.col("removed"))
    runs = hits.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lost = F.sum(F.when(F.col("removed"), F.col("end") - F.col("start")).otherwise(F.lit(0)))
    spans = runs.groupBy("id", "raw", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_id").alias("first_id"), lost.alias("n_removed"))
    spans = spans.withColumn("n_chars", F.col("end") - F.col("start")).filter(F.col("n_chars") >= min_chars)
    return spans.select("id", "raw", "start", "end", "n_chars", "first_id", (2 * F.col("n_removed") > F.col("n_chars")).alias("removed"))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per span that also stands elsewhere: id, raw, start, end (characters), n_chars, first_id, removed.

    first_id is the smallest document that keeps some of it; removed: most of its characters are kept in another place.
    """
    return spans_of(repeated_chunks(docs, doc_id, text), min_chars, alike=False)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without runs of chunks that are all kept elsewhere; other columns and all rows stay."""
    spans = spans_of(repeated_chunks(docs, doc_id, text), min_chars, alike=True).filter("removed")
    spans = spans.groupBy("id", "raw").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    spans = spans.select(F.col("id").alias("__key"), F.col("raw").alias("__key_raw"), "__cut")
    names = docs.columns
    inner = [f"__c{i}" for i in range(len(names))]
    rows = docs.toDF(*inner)
    i, t = inner[names.index(doc_id)], inner[names.index(text)]
    same = F.col(i).eqNullSafe(F.col("__key")) & (F.xxhash64(F.coalesce(F.col(t), F.lit(""))) == F.col("__key_raw"))
    rows = rows.join(spans, same, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, cut in zip(batch.column(t).to_pylist(), batch.column("__cut").to_pylist(), strict=True):
                for span in reversed(cut or []):
                    body = body[:span["start"]] + body[span["end"]:]
                out.append(body)
            columns = [pa.array(out, pa.string()) if name == t else batch.column(name) for name in inner]
            yield pa.RecordBatch.from_arrays(columns, inner)

    return rows.select(*inner, "__cut").mapInArrow(run, docs.toDF(*inner).schema).toDF(*names)
