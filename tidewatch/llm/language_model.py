"""Scoring texts with a bigram model kept as an Elias-Fano trie in shards.

The model interpolates bigrams with unigrams by absolute discounting: p(w|h) = max(c(h,w) - D, 0) / c(h) + D t(h) / c(h) p(w),
t(h) being the number of different words after h, and p(w) = (c(w) - D) / N, or D V / N for all unknown words together.

1. Tasks write blocks of documents once: per block its distinct words as sorted 64-bit hashes, and every token as an index
   into them. Texts are read and split into words only here.
2. Every block sends its distinct words, with training counts, to shards by range of hash. A shard adds up the counts
   and answers each block's words with them; answers and questions are in the same order, so only counts travel back.
3. Likewise for the distinct bigrams of a block. A shard builds the trie of its contexts from the counts, with quantised
   probabilities, and answers by search in it. Contexts that are frequent everywhere are divided among all shards by the
   word that follows; their c(h) is the unigram count. Each shard reports how many different words follow them there, and
   the sum over the shards is their exact t(h), which blocks use for every such context, whichever shard was asked.
4. Blocks meet their answers and add up the scores of their documents.

Questions are distinct per block, so a word or bigram that a third of all tokens are costs one entry per block. Nothing of
the model is sent to all tasks but the list of frequent contexts and their t(h), at most 4 per shard. The number of shards follows the
number of tokens, so what a shard holds stays the same.

Null and empty texts have one token, the end. A null id counts as the empty string when training rows are chosen. Rows that
repeat are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import pick, small_batches, texts
from tidewatch.llm.elias_fano import PROBABILITY, Trie, quantise
from tidewatch.llm.tokens import words
from tidewatch.session import durable

BLOCK_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 21
DISCOUNT = 0.75
ADDED = 0.1
END = np.uint64(0x6E5A1C0F3B7D2941)  # stands for the end of a text among word hashes
START = np.uint64(0xC3A5C85C97CB3127)  # the context of a first word
SUCCESSOR_BITS = 32


# --- blocks -----------------------------------------------------------------------------------------

def packed(index: np.ndarray, n_words: int) -> bytes:
    """Indices into so many words in three bytes each, or in four where a text has more distinct words than those can tell apart."""
    data = np.ascontiguousarray(index.astype("<u4"))
    return data.tobytes() if n_words > 1 << 24 else np.ascontiguousarray(data.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def unpacked(data: bytes, n_words: int) -> np.ndarray:
    if n_words > 1 << 24:
        return np.frombuffer(data, "<u4").astype(np.int64)
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of (block, ids, held_out, lengths, tokens, words, n_train), written once."""
    rows = pick(docs, id=doc_id, text=text)
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = rows.select("id", held.alias("held_out"), "text")
    kind = dict(rows.dtypes)["id"]
    names = ["block", "ids", "held_out", "lengths", "tokens", "words", "n_train"]

    def row(number: int, ids: list[pa.Array], held: list[np.ndarray], lengths: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        all_ids, all_held, all_lengths = pa.concat_arrays(ids), np.concatenate(held), np.concatenate(lengths)
        names_, index = np.unique(np.concatenate(hashes), return_inverse=True)
        n_train = int(all_lengths[~all_held].sum())
        one = lambda data, kind: pa.array([data], kind)
        return pa.RecordBatch.from_arrays(
            [one((TaskContext.get().partitionId() << 32) + number, pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
             one(all_held.tobytes(), pa.binary()), one(all_lengths.astype("<i4").tobytes(), pa.binary()), one(packed(index, len(names_)), pa.binary()),
             one(names_.tobytes(), pa.binary()), one(n_train, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, lengths, hashes, size, number = [], [], [], [], 0, 0
        for batch in small_batches(batches):
            found = words(pc.ascii_lower(pa.array(texts(batch), pa.large_string())).to_pylist())
            distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, found.distinct), np.uint64, len(found.distinct))
            n = np.diff(found.offsets)
            tokens = np.empty(len(found.codes) + len(n), np.uint64)
            ends = np.cumsum(n + 1) - 1
            tokens[ends] = END
            inner = np.ones(len(tokens), bool)
            inner[ends] = False
            tokens[inner] = distinct[found.codes] if len(found.codes) else 0
            ids.append(batch.column("id"))
            held.append(batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool))
            lengths.append(n + 1)
            hashes.append(tokens)
            size += len(tokens)
            if size >= BLOCK_TOKENS:
                yield row(number, ids, held, lengths, hashes)
                ids, held, lengths, hashes, size, number = [], [], [], [], 0, number + 1
        if ids:
            yield row(number, ids, held, lengths, hashes)

    return durable(rows.mapInArrow(run, f"block long, ids array<{kind}>, held_out binary, lengths binary, tokens binary, words binary, n_train long"))


class Block(NamedTuple):
    words: np.ndarray
    tokens: np.ndarray
    train: np.ndarray  # of each token
    starts: np.ndarray  # of each document

    @classmethod
    def read(cls, words: bytes, tokens: bytes, held_out: bytes, lengths: bytes) -> Block:
        n = np.frombuffer(lengths, "<i4").astype(np.int64)
        return cls(np.frombuffer(words, np.uint64), unpacked(tokens, len(words) // 8), np.repeat(~np.frombuffer(held_out, bool), n), np.cumsum(n) - n)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Every token's (context, word) as one number; a first word's context is the number of words."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = len(self.words)
        return (before << 32) + self.tokens


def shard_bits(shards: int) -> np.uint64:
    return np.uint64(64 - (shards - 1).bit_length())


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash, so a sorted list falls into runs."""
    return (h >> shard_bits(shards)).astype(np.int64) if shards > 1 else np.zeros(len(h), np.int64)


def runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first, last) of a sorted list."""
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(shard)).tolist(), strict=True):
        if b > a:
            yield int(shard[a]), a, b


# --- level 1: words ---------------------------------------------------------------------------------

QUESTION = "shard int, block long, part_a binary, part_b binary, counts binary"
ANSWER = "block long, level int, shard int, part_a binary, part_b binary, n_words long, frequent binary"
_QUESTION = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("part_a", pa.binary()), ("part_b", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("shard", pa.int32()), ("part_a", pa.binary()), ("part_b", pa.binary()), ("n_words", pa.int64()), ("frequent", pa.binary())])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def per_shard(fn, **fixed):
    def run(key, rows):  # without type hints, which Spark would read
        return fn(key, rows, **fixed)

    return run


def ask_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for x in rows_of(batches):
        b = Block.read(x["words"], x["tokens"], x["held_out"], x["lengths"])
        counts = np.bincount(b.tokens[b.train], minlength=len(b.words)).astype("<u4")
        out = [(s, x["block"], b.words[i:j].tobytes(), None, counts[i:j].tobytes()) for s, i, j in runs(shard_of(b.words, shards))]
        yield from table(out, _QUESTION).to_batches()


def answer_words(key: tuple, rows: pa.Table, frequent: float) -> pa.Table:
    blobs = [np.frombuffer(x, np.uint64) for x in rows.column("part_a").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("counts").to_pylist()])
    names, back = np.unique(np.concatenate(blobs), return_inverse=True)
    total = np.bincount(back, counts, len(names)).astype(np.int64)
    ends = np.cumsum([len(x) for x in blobs])
    hot = total >= frequent
    side = np.stack([names[hot], total[hot].astype(np.uint64)]).tobytes()
    shard = int(key[0].as_py())
    out = [(block, 1, shard, total[back[b - len(x):b]].astype("<i8").tobytes(), None, int((total > 0).sum()) if i == 0 else 0, side if i == 0 else None)
           for i, (block, x, b) in enumerate(zip(rows.column("block").to_pylist(), blobs, ends.tolist(), strict=True))]
    return table(out, _ANSWER)


# --- level 2: bigrams -------------------------------------------------------------------------------

class Frequent(NamedTuple):
    """Contexts divided among all shards: sorted hashes and their counts."""

    words: np.ndarray
    counts: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash in the list, and whether it is there."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h


def distinct_bigrams(b: Block, shards: int, frequent: Frequent) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams in the order in which they are sent: number, training count, shard, context hash, successor bits."""
    number, back = np.unique(b.bigrams(), return_inverse=True)
    counts = np.bincount(back[b.train], minlength=len(number)).astype("<u4")
    hashes = np.append(b.words, START)
    before, word = number >> 32, number & 0xFFFFFFFF
    hot = frequent.find(hashes)[1][before]
    shard = np.where(hot, shard_of(hashes, shards)[word], shard_of(hashes, shards)[before])
    below = hashes << (np.uint64(64) - shard_bits(shards) if shards > 1 else np.uint64(0))
    successor = np.where(hot, below[word], hashes[word]) >> np.uint64(64 - SUCCESSOR_BITS)
    order = np.argsort(shard, kind="stable")
    return number[order], counts[order], shard[order], hashes[before[order]], successor[order].astype("<u4")


def ask_bigrams(batches: Iterator[pa.RecordBatch], shards: int, frequent: Frequent) -> Iterator[pa.RecordBatch]:
    for x in rows_of(batches):
        b = Block.read(x["words"], x["tokens"], x["held_out"], x["lengths"])
        _, counts, shard, context, successor = distinct_bigrams(b, shards, frequent)
        out = []
        for s, i, j in runs(shard):
            # A context once, with the number of bigrams it begins.
            first = np.append(0, np.flatnonzero(np.diff(context[i:j])) + 1)
            head = np.concatenate([context[i:j][first], np.diff(np.append(first, j - i)).astype(np.uint64)])
            out.append((s, x["block"], head.tobytes(), successor[i:j].tobytes(), counts[i:j].tobytes()))
        yield from table(out, _QUESTION).to_batches()


def build(context: np.ndarray, successor: np.ndarray, counts: np.ndarray, frequent: Frequent) -> Trie:
    """The trie of one shard from its distinct bigrams in order; those that training has not seen are left out.

    Frequent contexts get no backoff here, since the shard holds only some of their successors.
    """
    seen = counts > 0
    context, successor, counts = context[seen], successor[seen], counts[seen].astype(np.float64)
    names, first = np.unique(context, return_index=True)
    kinds = np.diff(np.append(first, len(context)))
    total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
    if len(frequent.words):
        at, hot = frequent.find(names)
        total = np.where(hot, frequent.counts[at], total)
        kinds = np.where(hot, 0, kinds)
    values = quantise((counts - DISCOUNT) / np.repeat(total, np.diff(np.append(first, len(context)))))
    return Trie.build(context, successor.astype(np.uint64), values, quantise(DISCOUNT * kinds / total), 1 << SUCCESSOR_BITS)


def answer_bigrams(key: tuple, rows: pa.Table, frequent: Frequent) -> pa.Table:
    heads = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in rows.column("part_a").to_pylist()]
    context = np.concatenate([np.repeat(h[0], h[1].astype(np.int64)) for h in heads])
    tails = [np.frombuffer(x, "<u4") for x in rows.column("part_b").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("counts").to_pylist()])
    names, rank = np.unique(context, return_inverse=True)
    pair, back = np.unique((rank.astype(np.uint64) << np.uint64(32)) + np.concatenate(tails), return_inverse=True)
    total = np.bincount(back, counts, len(pair))
    names, successor = names[(pair >> np.uint64(32)).astype(np.int64)], pair & np.uint64(0xFFFFFFFF)
    followed, kinds = np.unique(names[total > 0], return_counts=True)
    hot = frequent.find(followed)[1]
    side = np.stack([followed[hot], kinds[hot].astype(np.uint64)]).tobytes()
    trie = Trie.from_buffer(build(names, successor, total, frequent).to_bytes())
    value, backoff = trie.search(names, successor)
    value, backoff = value[back], backoff[back]
    ends = np.cumsum([len(x) for x in tails]).tolist()
    out = [(block, 2, int(key[0].as_py()), value[e - len(x):e].tobytes(), backoff[e - len(x):e].tobytes(), 0, side if i == 0 else None)
           for i, (block, x, e) in enumerate(zip(rows.column("block").to_pylist(), tails, ends, strict=True))]
    return table(out, _ANSWER)


def frequent_kinds(pairs: DataFrame, frequent: Frequent) -> np.ndarray:
    """t(h) of every frequent context: its different successors in training, added up over the shards, which share none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("frequent").to_pylist():
                side = np.frombuffer(x, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(side[0]), pa.array(side[1])], ["h", "t"])

    # One row per frequent context, at most 4 per shard.
    sums = pairs.filter("frequent is not null").select("frequent").mapInArrow(run, "h long, t long").groupBy("h").agg(F.sum("t").alias("t")).collect()
    out = np.zeros(len(frequent.words))
    out[frequent.find(np.array([r.h for r in sums], np.int64).view(np.uint64))[0]] = [r.t for r in sums]
    return out


# --- scores -----------------------------------------------------------------------------------------

def score_block(left: pa.Table, right: pa.Table, shards: int, frequent: Frequent, kinds: np.ndarray, n: int, v: int, kind: pa.DataType) -> pa.Table:
    x = left.to_pylist()[0]
    b = Block.read(x["words"], x["tokens"], x["held_out"], x["lengths"])
    levels: dict[int, list[dict]] = {1: [], 2: []}
    for r in right.select(["level", "shard", "part_a", "part_b"]).to_pylist():
        levels[r["level"]].append(r)
    ordered = {k: sorted(rows, key=lambda r: r["shard"]) for k, rows in levels.items()}
    counts = np.frombuffer(b"".join(r["part_a"] for r in ordered[1]), "<i8")
    p1 = np.where(counts > 0, (counts - DISCOUNT) / max(n, 1), DISCOUNT * v / max(n, 1)) if n else np.ones(len(counts))
    number, _, _, context, _ = distinct_bigrams(b, shards, frequent)
    value = PROBABILITY[np.frombuffer(b"".join(r["part_a"] for r in ordered[2]), np.uint8)]
    backoff = np.frombuffer(b"".join(r["part_b"] for r in ordered[2]), np.uint8)
    place, hot = frequent.find(context)
    backoff = np.where(hot, quantise(DISCOUNT * kinds / frequent.counts)[place], backoff)
    share = np.where(backoff > 0, PROBABILITY[backoff], 1.0)  # an unseen context leaves all to the unigrams
    log_p = np.log10(value + share * p1[number & 0xFFFFFFFF])
    order = np.argsort(number)
    at = order[np.searchsorted(number, b.bigrams(), sorter=order)]
    base = np.log10((counts + ADDED) / (n + ADDED * (v + 1)))
    total = lambda a: np.add.reduceat(a, b.starts)
    n_tokens = np.frombuffer(x["lengths"], "<i4").astype(np.int64)
    return pa.table({
        "id": pa.array(x["ids"], kind), "held_out": np.frombuffer(x["held_out"], bool), "n_tokens": n_tokens,
        "n_known": total((counts > 0)[b.tokens].astype(np.int64)), "train_tokens": np.full(len(n_tokens), n),
        "base_score": total(base[b.tokens]), "score": total(log_p[at])})


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    parts = blocks(docs, doc_id, text)
    sums = parts.agg(F.sum("n_train"), F.sum(F.octet_length("tokens"))).first()
    n, tokens = sums[0] or 0, (sums[1] or 0) // 3
    shards = 1 << max(3, (tokens // SHARD_TOKENS).bit_length())
    id_kind = dict(parts.dtypes)["ids"][len("array<"):-1]
    result = f"id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked = parts.mapInArrow(partial(ask_words, shards=shards), QUESTION)
    limit = max(1.0, n / (4 * shards))  # at most 4 contexts a shard are more frequent
    words_ = durable(asked.groupBy("shard").applyInArrow(per_shard(answer_words, frequent=limit), ANSWER))
    v = words_.agg(F.sum("n_words")).first()[0] or 0
    found = [np.frombuffer(r[0], np.uint64).reshape(2, -1) for r in words_.filter("frequent is not null").select("frequent").collect()]
    hot = np.concatenate([*found, np.array([[START], [max(1, n)]], np.uint64)], axis=1)
    hot[1, -1] = max(1, _train_documents(parts))  # how often a text starts
    hot = hot[:, np.argsort(hot[0])]
    frequent = Frequent(hot[0], hot[1].astype(np.float64))
    asked = parts.mapInArrow(partial(ask_bigrams, shards=shards, frequent=frequent), QUESTION)
    pairs = durable(asked.groupBy("shard").applyInArrow(per_shard(answer_bigrams, frequent=frequent), ANSWER))
    kinds = frequent_kinds(pairs, frequent)
    answers = words_.unionByName(pairs).drop("n_words", "frequent")
    kind = pa.from_numpy_dtype(np.int64) if id_kind == "bigint" else None

    def run(left, right):
        return score_block(left, right, shards, frequent, kinds, n, v, kind or left.schema.field("ids").type.value_type)

    return parts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, result)


def _train_documents(parts: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int((~np.frombuffer(x, bool)).sum()) for x in batch.column("held_out").to_pylist()], pa.int64())], ["k"])

    return parts.select("held_out").mapInArrow(run, "k long").agg(F.sum("k")).first()[0] or 0
