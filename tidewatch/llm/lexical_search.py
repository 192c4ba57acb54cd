"""Ranked lexical search: the best documents of each query by term weights, found best-first over document intervals.

The index is a table of blocks. A block holds consecutive documents (their ids and lengths) and a posting list per term: the
documents' places in the block and how often they hold it. Tasks write it in one pass over the texts, without a shuffle. Only
terms that some query asks for are kept, as long as there are at most ``VOCABULARY`` of them, else all terms.

Queries go to all blocks, in chunks of at most about ``CHUNK_TERMS`` terms, so what a task is sent is bounded. In a block each
term's impacts (its share of a document's score) get a sparse table that gives the document with the largest impact of any
interval of the list in one look-up. The sum of these maxima over the query's terms bounds the scores in an interval of
documents. The search keeps intervals by that bound, always takes the best ones, splits each at the document whose single impact is
the largest there, scores that document (an interval of one) and puts both sides back with their own bounds. It ends when no
bound reaches the k-th best score, which tasks carry on from block to block. What a task returns is k documents per query; Spark
ranks those.

All counts are over whole texts and all documents. A null or empty text has no term; such a document is counted nowhere. Rows
that repeat an id are documents of their own. Equal scores are ordered by id (null last). A query without terms, or whose terms
no document holds, has no result; queries that repeat id and text are asked once. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import pick
from tidewatch.session import durable

BEST = 20
#: Distinct terms of all queries up to which the index holds these only (about 10 MB in a task).
VOCABULARY = 200_000
#: Terms of the queries that go to the blocks at once.
CHUNK_TERMS = 50_000
#: A block ends at so many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 32_768, 1 << 20
#: Intervals taken from the heap at once: the first time, and at most.
FIRST_STEP, MOST_STEP = 4, 256
# Fixed values of the score.
UNIT, LENGTH_SHARE = 1_000_000_000, 25

#: Bytes that part terms become spaces; A-Z become a-z; all else (digits, letters, bytes above 127) stays.
FOLD = bytes(c if chr(c).isalnum() else 32 for c in bytes(range(128)).lower()) + bytes(range(128, 256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, size: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """A term's share of the score of documents with ``size`` terms that hold it ``tf`` times; whole numbers."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * size * n_docs) // max(total, 1)
    return w * ((UNIT * tf) // (1000 * tf + 12 * m))


# --- index ------------------------------------------------------------------------------------------

def index(docs: DataFrame, vocabulary: frozenset[bytes] | None, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS,
          block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Blocks (ids, sizes, n_docs, total, terms, lengths, places, tfs), written once.

    ``places`` and ``tfs`` hold the posting lists of ``terms`` one after the other, each in order of place; ``lengths`` says how
    long they are. ``n_docs`` counts documents with a term, ``total`` their terms.
    """
    rows = pick(docs, id=doc_id, text=text).select("id", F.col("text").cast("binary").alias("text"))
    kind = dict(rows.dtypes)["id"]

    def block(ids: list[pa.Array], sizes: list[int], postings: dict[bytes, tuple[list[int], list[int]]]) -> pa.RecordBatch:
        names, lists = sorted(postings), [postings[t] for t in sorted(postings)]
        all_ids = pa.concat_arrays(ids)
        one = lambda data, kind: pa.array([data], kind)
        flat = lambda i: np.fromiter((x for p in lists for x in p[i]), "<i4")
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids), one(np.array(sizes, "<i8").tobytes(), pa.binary()),
            one(sum(n > 0 for n in sizes), pa.int64()), one(sum(sizes), pa.int64()), one(names, pa.list_(pa.binary())),
            one(np.array([len(p[0]) for p in lists], "<i8").tobytes(), pa.binary()), one(flat(0).tobytes(), pa.binary()), one(flat(1).tobytes(), pa.binary())],
            ["ids", "sizes", "n_docs", "total", "terms", "lengths", "places", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        sizes: list[int] = []
        postings: dict[bytes, tuple[list[int], list[int]]] = {}
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                found = terms_of(batch.column("text")[i].as_py())
                for t, tf in Counter(found if vocabulary is None else filter(vocabulary.__contains__, found)).items():
                    own = postings.setdefault(t, ([], []))
                    own[0].append(len(sizes))
                    own[1].append(tf)
                    held += 1
                ids.append(batch.column("id").slice(i, 1))
                sizes.append(len(found))
                if len(sizes) >= block_docs or held >= block_postings:
                    yield block(ids, sizes, postings)
                    ids, sizes, postings, held = [], [], {}, 0
        if ids:
            yield block(ids, sizes, postings)

    return durable(rows.mapInArrow(run, f"ids array<{kind}>, sizes binary, n_docs long, total long, terms array<binary>, lengths binary, places binary, tfs binary"))


# --- search in a block ------------------------------------------------------------------------------

class Lists(NamedTuple):
    """Posting lists of a block, one after the other: where each begins, documents, impacts, and the sparse tables over them.

    ``key`` is list * span + place, increasing over all lists, so one search finds the same interval of documents in many
    lists. ``best[j][i]`` is the posting with the largest impact among the 2^j from i on (the first of equal ones).
    """

    span: int
    key: np.ndarray
    impact: np.ndarray
    best: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray, places: np.ndarray, impact: np.ndarray, span: int) -> Lists:
        key = np.repeat(np.arange(len(lengths)), lengths) * span + places
        best = [np.arange(len(impact), dtype=np.int32)]
        for j in range(int(lengths.max(initial=1)).bit_length() - 1):
            left, right = best[-1], np.minimum(np.arange(len(impact)) + (1 << j), len(impact) - 1)
            right = left[right]
            best.append(np.where(impact[left] >= impact[right], left, right))
        return cls(span, key, impact, np.stack(best))

    def largest(self, lists: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each list (rows) and interval of documents (columns): the largest impact (0 for none) and its posting."""
        start = np.searchsorted(self.key, lists[:, None] * self.span + low[None])
        end = np.searchsorted(self.key, lists[:, None] * self.span + high[None])
        n = end - start
        j = np.frexp(np.maximum(n, 1))[1] - 1    # floor(log2)
        a = self.best[j, np.minimum(start, len(self.impact) - 1)]
        b = self.best[j, np.maximum(end - (1 << j.astype(np.int64)), 0)]
        at = np.where(self.impact[a] >= self.impact[b], a, b)
        return np.where(n > 0, self.impact[at], 0), at


def best_first(lists: Lists, wanted: np.ndarray, times: np.ndarray, floor: int, best: int) -> tuple[list[tuple[int, int]], int]:
    """The places and scores of the ``best`` documents with a score of at least ``floor`` (all that tie with the last of
    them), and how many documents were scored. ``wanted`` are the query's lists, ``times`` how often it names each."""
    found: list[tuple[int, int]] = []
    top: list[int] = []    # a heap of the best scores
    scored, step = 0, FIRST_STEP

    def bounds(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value, at = lists.largest(wanted, low, high)
        value = value * times[:, None]
        return value.sum(0), lists.key[at[np.argmax(value, 0), np.arange(len(low))]] % lists.span

    bound, split = bounds(np.array([0]), np.array([lists.span]))
    heap = [(-int(bound[0]), 0, lists.span, int(split[0]))] if bound[0] > 0 else []
    while heap:
        taken = []
        while heap and len(taken) < step and -heap[0][0] >= floor:
            taken.append(heapq.heappop(heap))
        if not taken:
            break
        step = min(2 * step, MOST_STEP)
        _, low, high, split = (np.array(x, np.int64) for x in zip(*taken, strict=True))
        value, at = lists.largest(wanted, split, split + 1)
        scored += len(taken)
        for place, score in zip(split.tolist(), (value * times[:, None]).sum(0).tolist(), strict=True):
            if score >= floor:
                found.append((place, score))
                if len(top) < best:
                    heapq.heappush(top, score)
                else:
                    heapq.heappushpop(top, score)
                if len(top) == best:
                    floor = max(floor, top[0])
        low, high = np.concatenate([low, split + 1]), np.concatenate([split, high])
        some = low < high
        low, high = low[some], high[some]
        if len(low):
            bound, split = bounds(low, high)
            for x in zip((-bound).tolist(), low.tolist(), high.tolist(), split.tolist(), strict=True):
                if -x[0] >= max(floor, 1):
                    heapq.heappush(heap, x)
    return [f for f in found if f[1] >= floor], scored


class Query(NamedTuple):
    number: int
    terms: dict[bytes, int]


def searched(blocks: Iterator[pa.RecordBatch], queries: list[Query], weights: dict[bytes, int], n_docs: int, total: int, best: int) -> Iterator[pa.RecordBatch]:
    """The best documents of each query in these blocks: query, doc_id, score."""
    top: dict[int, list[tuple[int, bool, object]]] = {q.number: [] for q in queries}
    kind = None
    for batch in blocks:
        kind = batch.schema.field("ids").type.value_type
        for i in range(batch.num_rows):
            terms = batch.column("terms")[i].as_py()
            read = {c: np.frombuffer(batch.column(c)[i].as_py(), t).astype(np.int64) for c, t in (("sizes", "<i8"), ("lengths", "<i8"), ("places", "<i4"), ("tfs", "<i4"))}
            lengths = read["lengths"]
            if not len(lengths):
                continue
            w = np.repeat(np.array([weights.get(t, 0) for t in terms], np.int64), lengths)
            keep = w > 0    # terms of other chunks, or of no weight
            lengths = np.where([weights.get(t, 0) > 0 for t in terms], lengths, 0)
            places, tf = read["places"][keep], read["tfs"][keep]
            if not len(places):
                continue
            lists = Lists.of(lengths, places, impacts(w[keep], tf, read["sizes"][places], n_docs, total), len(read["sizes"]))
            number = {t: j for j, t in enumerate(terms) if lengths[j]}
            ids = batch.column("ids")[i].values
            for q in queries:
                own = [(number[t], n) for t, n in q.terms.items() if t in number]
                if not own:
                    continue
                held = top[q.number]
                floor = held[-1][0] if len(held) == best else 1
                found, _ = best_first(lists, np.array([x[0] for x in own]), np.array([x[1] for x in own]), floor, best)
                for place, score in found:
                    value = ids[place].as_py()
                    held.append((score, value is None, value))
                held.sort(key=lambda x: (-x[0], x[1], 0 if x[1] else x[2]))
                del held[best:]
    rows = [(q, value, score) for q, held in top.items() for score, _, value in held]
    if rows:
        q, value, score = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(value, kind), pa.array(score, pa.int64())], ["query", "doc_id", "score"])


# --- search -----------------------------------------------------------------------------------------

def asked(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """Written queries: query (a number), item_id, text."""
    rows = pick(queries, item_id=query_id, text=text).distinct()
    return durable(rows.select(F.monotonically_increasing_id().alias("query"), "item_id", F.col("text").cast("binary").alias("text")))


def query_terms(queries: DataFrame) -> DataFrame:
    """query, term, times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, text in zip(batch.column("query").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = Counter(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()),
                                                  pa.array(list(counts.values()), pa.int64())], ["query", "term", "times"])

    return durable(queries.select("query", "text").mapInArrow(run, "query long, term binary, times long"))


def search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", best: int = BEST,
           vocabulary: int = VOCABULARY, chunk_terms: int = CHUNK_TERMS, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: the ``best`` documents of each query."""
    spark = docs.sparkSession
    named = asked(queries, query_id, query_text)
    wanted = query_terms(named)
    distinct = durable(wanted.select("term").distinct())
    few = distinct.count() <= vocabulary
    own = frozenset(r[0] for r in distinct.collect()) if few else None    # bounded by the count
    blocks = index(docs, own, doc_id, text, block_docs, block_postings)
    sums = blocks.agg(F.sum("n_docs"), F.sum("total")).first()
    n_docs, total = sums[0] or 0, sums[1] or 0

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, n in zip(batch.column("terms").to_pylist(), batch.column("lengths").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(np.frombuffer(n, "<i8"))], ["term", "n"])

    df = blocks.select("terms", "lengths").mapInArrow(lengths, "term binary, n long").groupBy("term").agg(F.sum("n").alias("df"))
    wanted = durable(wanted.join(durable(df), "term"))
    chunks = max(1, -(-wanted.count() // chunk_terms))
    kind = dict(blocks.dtypes)["ids"][len("array<"):-1]
    result = f"query long, doc_id {kind}, score long"
    found = spark.createDataFrame([], result)
    for chunk in range(chunks):
        rows = wanted.filter(F.pmod(F.xxhash64("query"), chunks) == chunk).collect()    # about CHUNK_TERMS rows
        weights = {bytes(r.term): weight(n_docs, r.df) for r in rows}
        terms: dict[int, dict[bytes, int]] = {}
        for r in rows:
            terms.setdefault(r.query, {})[bytes(r.term)] = r.times
        some = [Query(q, t) for q, t in sorted(terms.items())]

        def run(batches, some=some, weights=weights):
            return searched(batches, some, weights, n_docs, total, best)

        if some:
            found = found.unionByName(blocks.mapInArrow(run, result))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # The rank limit is applied by each task before rows are shuffled.
    ranked = durable(found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.join(named.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
