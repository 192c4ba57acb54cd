"""Near-duplicate detection by a chosen-path set similarity join.

1. Every document's shingle set is hashed from its whole text. Documents with equal sets form a class; only classes go on.
2. A class gets minwise values (its smallest token under each of 96 hash functions). In each tree a node chooses a few of
   the functions, and every member goes to the child of its smallest token under each chosen function, so similar sets keep
   meeting and others part. Nodes that are small are compared exhaustively; larger ones branch again. A pair at the
   threshold is lost in one tree with probability at most 1/16 (two choices, 0.8); TREES independent trees make that 1/65536.
3. Large nodes branch in Spark, by joins with the list of large nodes; a node that fits a task goes on branching there.
   What does not part after LEVELS levels is a dense node, nearly always a group of near copies. It is dealt out in chunks
   that share a few pivots, so it has no largest size.
4. Of a node only a spanning forest of likely links is given out (by the estimate of the minwise values, best first), never
   all pairs. Links are confirmed on the full sets, made again from both whole texts. Then components are formed, and what is
   left to compare in a node are members of different components; in a last round these bring their full sets into the node,
   where each likely pair is settled at once, and only links that unite components leave it.

Members outside a dense node's largest component are compared with all its chunks, so no link is lost to chunking. A node over
LEAF that does not part gives all its members to the later rounds, also those that match no pivot, and the last round compares
each of them outside the node's largest component with all of the node.

Documents without words (null, empty, blank) have no set and are linked with nothing. Null ids come after all others.
Rows that repeat id and text are in one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import shingles
from tidewatch.llm.common import BROADCAST_ROWS, collapse_repeats, pick, row_key, small_batches, texts, without_rows
from tidewatch.llm.graph import components
from tidewatch.session import durable

WORDS, PER_CENT = 5, 80
TREES, CHOICES, LEVELS = 4, 2, 4
#: Members of a node that one task takes, and of one that is compared exhaustively.
NODE, LEAF = 4096, 96
PIVOTS = 16
FOREST_ROUNDS = 2
#: Sets up to this size go with their members into the last round (at most 128 MB in a node); pairs of larger ones are confirmed by a join.
SET_BYTES = 1 << 15
N = shingles.COORDINATES


def least_matches(per_cent: int) -> int:
    """Equal minwise values below which a pair is not confirmed: 4 standard deviations under the threshold's mean."""
    p = per_cent / 100
    return max(1, int(N * p - 4 * (N * p * (1 - p)) ** 0.5))


# --- sets and classes -------------------------------------------------------------------------------

def hashed(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """One row per document: __id, __raw, n_shingles, digest of the set (null if empty), sig. Written once."""
    rows = pick(docs, id=doc_id, text=text)
    rows = rows.select(*row_key(F.col("id"), F.col("text")), "text")
    names = ["__id", "__raw", "n_shingles", "digest", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most_bytes=4 << 20):
            h, starts = shingles.shingle_hashes(texts(batch), k)
            some = np.flatnonzero(np.diff(starts))
            sigs = shingles.signatures(h, np.append(starts[some], starts[-1])) if len(some) else np.zeros((0, N), np.uint16)
            counts, digests, sig = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for row, i in zip(sigs, some.tolist(), strict=True):
                own = np.unique(h[starts[i]:starts[i + 1]])
                counts[i], digests[i], sig[i] = len(own), xxhash.xxh3_128_digest(own.tobytes()), row.tobytes() + len(own).to_bytes(4, "little")
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__raw"), pa.array(counts, pa.int64()),
                                              pa.array(digests, pa.binary()), pa.array(sig, pa.binary())], names)

    return durable(rows.mapInArrow(run, f"__id {dict(rows.dtypes)['__id']}, __raw long, n_shingles long, digest binary, sig binary"))


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per distinct set: c (a number), digest, sig, and id and hash of its first document. Written once."""
    first = F.min(F.struct(F.col("__id").isNull().alias("no"), "__id", "__raw")).alias("doc")
    found = rows.filter("digest is not null").groupBy("digest").agg(first, F.first("sig").alias("sig"))
    return durable(found.select(F.monotonically_increasing_id().alias("c"), "digest", "sig", F.col("doc.__id").alias("__id"), F.col("doc.__raw").alias("__raw")))


# --- trees ------------------------------------------------------------------------------------------

def chosen(node: np.ndarray) -> list[np.ndarray]:
    """The hash functions that each node chooses: CHOICES different ones."""
    first = shingles.mix(node)
    step = shingles.mix(first + np.uint64(1)) % np.uint64((N - 1) // 2) + np.uint64(1)
    return [((first + np.uint64(i) * step) % np.uint64(N)).astype(np.int64) for i in range(CHOICES)]


def children(node: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
    """For each choice the child that each member goes to."""
    at = np.arange(len(node))
    return [shingles.mix(node * np.uint64(0xA0761D6478BD642F) + (c.astype(np.uint64) << np.uint64(17)) + sig[at, c]) for c in chosen(node)]


def signature_rows(column: pa.Array) -> np.ndarray:
    """N minwise values and, in the last two columns, the size of the set."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, N + 2)


def sizes(sig: np.ndarray) -> np.ndarray:
    return sig[:, N] + (sig[:, N + 1].astype(np.int64) << 16)


def branch(batches: Iterator[pa.RecordBatch], roots: bool) -> Iterator[pa.RecordBatch]:
    """Members (node, c, sig) to their children; from classes to the children of every tree's root."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = signature_rows(batch.column("sig"))
        parents = [np.full(batch.num_rows, 1 + t, np.uint64) for t in range(TREES)] if roots else [batch.column("node").to_numpy().view(np.uint64)]
        for parent in parents:
            for child in children(parent, sig):
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("c"), batch.column("sig")], ["node", "c", "sig"])


MEMBERS = "node long, c long, sig binary"


def checked(df: DataFrame) -> DataFrame:
    """A broadcast of a written frame if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def leaves(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Members of the nodes that fit a task, and members of dense nodes (with n, their size), if there are any."""
    now = classes.select("c", "sig").mapInArrow(partial(branch, roots=True), MEMBERS)
    found = None
    for level in range(LEVELS):
        large = durable(now.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NODE))
        if large.isEmpty():
            return now if found is None else found.unionByName(now), None
        large = checked(large)
        small = now.join(large, "node", "left_anti")
        found = small if found is None else found.unionByName(small)
        now = now.join(large, "node")
        if level < LEVELS - 1:
            now = durable(now.drop("n").mapInArrow(partial(branch, roots=False), MEMBERS).distinct())
    return found, durable(now)


def chunked(dense: DataFrame, everywhere: DataFrame) -> DataFrame:
    """Members of dense nodes dealt out in chunks of about NODE; the members in ``everywhere`` (node, c) go to every chunk."""
    chunks = F.ceil(F.col("n") / NODE).cast("int")
    rows = dense.join(everywhere.select("node", "c", F.lit(True).alias("all")), ["node", "c"], "left")
    where = F.when(F.col("all"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("c"), chunks).cast("int")))
    return rows.select("node", "c", "sig", F.explode(where).alias("chunk")).select(F.xxhash64("node", "chunk").alias("node"), "c", "sig")


# --- inside a node ----------------------------------------------------------------------------------

class Forest:
    """Union-find over the members of one node; members of one component start united."""

    def __init__(self, comp: np.ndarray):
        _, first, back = np.unique(comp, return_index=True, return_inverse=True)
        self.up = first[back].tolist()

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def matches(a: np.ndarray, b: np.ndarray, per_cent: int) -> np.ndarray:
    """Equal minwise values of every row of a with every row of b; 0 where the sizes alone rule out that they are similar."""
    if len(a) * len(b) <= 2048:
        out = (a[:, None, :N] == b[None, :, :N]).sum(2, dtype=np.int16)
    else:
        out = np.zeros((len(a), len(b)), np.int16)
        for i in range(N):
            out += a[:, i, None] == b[None, :, i]
    n, m = sizes(a)[:, None], sizes(b)[None]
    return np.where(100 * np.minimum(n, m) >= per_cent * np.maximum(n, m), out, 0)


def likely_forest(sig: np.ndarray, comp: np.ndarray, per_cent: int, seed: int) -> np.ndarray:
    """A spanning forest of likely links (rows of two members) between components, the likeliest first. Large nodes: to random pivots."""
    forest, m, least = Forest(comp), len(sig), least_matches(per_cent)
    out: list[tuple[int, int]] = []
    if m <= LEAF:
        est = np.triu(matches(sig, sig, per_cent), 1)
        i, j = np.nonzero(est >= least)
        order = np.argsort(-est[i, j], kind="stable")
        out = [(a, b) for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True) if forest.join(a, b)]
        return np.array(out, np.int64).reshape(-1, 2)
    rng, left = np.random.default_rng(seed), np.arange(m)
    while len(left) > 1:
        pivots = rng.choice(left, min(PIVOTS, len(left)), replace=False)
        est = matches(sig[left], sig[pivots], per_cent)
        est[left[:, None] == pivots[None]] = -1
        i, j = np.nonzero(est >= least)
        order = np.argsort(-est[i, j], kind="stable")
        for a, b in zip(left[i[order]].tolist(), pivots[j[order]].tolist(), strict=True):
            if forest.join(a, b):
                out.append((a, b))
        rest = left[(est < least).all(1) & ~np.isin(left, pivots)]
        left = rest if len(rest) < len(left) else rest[:0]
    return np.array(out, np.int64).reshape(-1, 2)


def similar(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    """Whether two sorted sets are similar."""
    if min(len(a), len(b)) * 100 < per_cent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")    # merges the two runs
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= per_cent * (len(both) - same)


def settled_node(sig: np.ndarray, comp: np.ndarray, sets: pa.Array, per_cent: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links between members of different components: those found on the full sets (a spanning forest of them), and the likely
    pairs of members that came without their set. Every likely pair with a member outside the largest component is looked at,
    unless links have united its two sides before."""
    names, counts = np.unique(comp, return_counts=True)
    forest, sure, unsure = Forest(comp), [], []
    known: dict[int, np.ndarray | None] = {}

    def whole(i: int) -> np.ndarray | None:
        if i not in known:
            known[i] = np.frombuffer(sets[i].as_buffer(), np.uint64) if sets[i].is_valid else None
        return known[i]

    rest = np.flatnonzero(comp != names[np.argmax(counts)])
    for start in range(0, len(rest), 256):
        part = rest[start:start + 256]
        est = matches(sig[part], sig, per_cent)
        i, j = np.nonzero((est >= least_matches(per_cent)) & (comp[part][:, None] != comp[None]))
        order = np.argsort(-est[i, j], kind="stable")
        for u, v in zip(part[i[order]].tolist(), j[order].tolist(), strict=True):
            if forest.top(u) == forest.top(v):
                continue
            x, y = whole(u), whole(v)
            if x is None or y is None:
                unsure.append((u, v))
            elif similar(x, y, per_cent):
                forest.join(u, v)
                sure.append((u, v))
    return sure, unsure


SETTLED = "a long, b long, sure boolean"


def settle(batches: Iterator[pa.RecordBatch], per_cent: int) -> Iterator[pa.RecordBatch]:
    """The last round over members (node, c, sig, comp, set) of nodes: links (sure), and pairs still to be confirmed."""
    for _, at, table in nodes_of(batches):
        rows = table.slice(at[0], len(at))
        own, first = np.unique(rows.column("c").to_numpy(), return_index=True)
        comp = rows.column("comp").to_numpy()[first]
        if (comp == comp[0]).all():
            continue
        found = settled_node(signature_rows(rows.column("sig"))[first], comp, rows.column("set").take(pa.array(first)), per_cent)
        for pairs, sure in zip(found, (True, False), strict=True):
            if pairs:
                both = np.sort(own[np.array(pairs)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([sure] * len(both))], ["a", "b", "sure"])


def small_nodes(node: int, sig: np.ndarray, at: np.ndarray, depth: int = 0) -> Iterator[np.ndarray]:
    """Branch a node (members ``at``) until its nodes are small, or do not part any more."""
    if len(at) <= LEAF or depth == 8:
        if len(at) > 1:
            yield at
        return
    parts = []
    for child in children(np.full(len(at), node, np.uint64), sig[at]):
        order = np.argsort(child, kind="stable")
        cuts = np.flatnonzero(np.diff(child[order])) + 1
        parts += [(int(child[p[0]]), at[p]) for p in np.split(order, cuts)]
    if max(len(p) for _, p in parts) > 0.7 * len(at):
        yield at
        return
    for name, part in parts:
        yield from small_nodes(name, sig, part, depth + 1)


def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Node, row numbers and rows of each node with two members or more, from batches in order of node."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
        name = table.column("node").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(name)) + 1, [len(name)]])
        for i in np.flatnonzero(np.diff(cuts) > 1).tolist():
            yield int(name[cuts[i]]), np.arange(cuts[i], cuts[i + 1]), table

    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column("node")[-1].as_py()
        name = batch.column("node").to_numpy()
        first = int(np.searchsorted(name, last))
        if first:
            done = pa.Table.from_batches([*held, batch.slice(0, first)]).combine_chunks().to_batches()[0]
            yield from cut(done)
            held = []
        elif held and held[-1].column("node")[-1].as_py() != last:
            yield from cut(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held = []
        held.append(batch.slice(first))
    if held:
        yield from cut(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


PAIRS = "a long, b long, node long, sig binary"
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("node", pa.int64()), ("sig", pa.binary())])


def pair_rows(pairs: list[np.ndarray]) -> pa.RecordBatch:
    """Each pair once, the smaller number first."""
    both = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64()), pa.nulls(len(both), pa.binary())], schema=_PAIRS)


def member_rows(c: np.ndarray, node: int, sig: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c), pa.nulls(len(c), pa.int64()), pa.array(np.full(len(c), node)), pa.array([x.tobytes() for x in sig], pa.binary())], schema=_PAIRS)


def compare(batches: Iterator[pa.RecordBatch], per_cent: int, split: bool, seed: int) -> Iterator[pa.RecordBatch]:
    """Likely links (a, b) of the nodes in a partition; with ``split`` also the members (a, node, sig) of nodes that may hold more."""
    held, n = [], 0
    for node, at, table in nodes_of(batches):
        own = table.column("c").to_numpy()[at]
        if (own == own[0]).all():
            continue
        rows = table.slice(at[0], len(at))
        sig = signature_rows(rows.column("sig"))
        comp = own if split else rows.column("comp").to_numpy()
        name, every = np.uint64(node % (1 << 64)), np.arange(len(at))
        for number, part in enumerate(small_nodes(name, sig, every) if split else [every]):
            part = part[np.unique(own[part], return_index=True)[1]]
            pairs = likely_forest(sig[part], comp[part], per_cent, seed)
            # A component of three may hold links that the forest leaves out; of a part compared only with pivots, any two members may.
            if split and (len(part) > LEAF or len(pairs) > 1):
                more = part if len(part) > LEAF else part[np.unique(pairs)]
                inner = int(shingles.mix(np.array([name + np.uint64(number)], np.uint64)).view(np.int64)[0])
                yield member_rows(own[more], inner, sig[more])
            if not len(pairs):
                continue
            held.append(own[part][pairs])
            n += len(pairs)
            if n > 50_000:
                yield pair_rows(held)
                held, n = [], 0
    if held:
        yield pair_rows(held)


def dealt(members: DataFrame) -> DataFrame:
    return members.repartition("node").sortWithinPartitions("node")


# --- confirmation -----------------------------------------------------------------------------------

def class_texts(named: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The whole text of the first document of the classes in ``named`` (c): c, text."""
    wanted = durable(classes.join(named, "c").select("c", F.col("__id").alias("i"), F.col("__raw").alias("r")))
    body = pick(docs, id=doc_id, text=text)
    body = body.select(*row_key(F.col("id"), F.col("text")), "text")
    return body.join(checked(wanted), F.col("__id").eqNullSafe(F.col("i")) & (F.col("__raw") == F.col("r"))).select("c", "text")


def class_sets(named: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """The full shingle set of each of these classes (c, set); null where it takes more than SET_BYTES. Written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most_bytes=4 << 20):
            found = [x.tobytes() if x.nbytes <= SET_BYTES else None for x in shingles.sets(texts(batch), k)]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(found, pa.binary())], ["c", "set"])

    # Rows that repeat a class's id and text have the same set.
    return durable(class_texts(named, classes, docs, doc_id, text).dropDuplicates(["c"]).mapInArrow(run, "c long, set binary"))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar, each set made from the whole text of one document."""
    pairs = durable(pairs.distinct())
    ends = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    body = class_texts(ends, classes, docs, doc_id, text)
    both = pairs.join(body.select(F.col("c").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(body.select(F.col("c").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 100) for i in range(0, whole.num_rows, 100)):
                left, right = texts(batch, "text_a"), texts(batch, "text_b")
                distinct = list({*left, *right})
                known = dict(zip(distinct, shingles.sets(distinct, k), strict=True))
                keep = []
                for x, y in zip(left, right, strict=True):
                    a, b = known[x], known[y]
                    same = len(a) + len(b) - len(np.union1d(a, b)) if min(len(a), len(b)) * 100 >= per_cent * max(len(a), len(b)) else 0
                    keep.append(100 * same >= per_cent * (len(a) + len(b) - same))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return durable(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))


def links(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, k: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links that connect all similar classes (not all links), and the components they form (c, root)."""
    members, dense = leaves(classes)
    if dense is not None:  # round 1: the chunks of a dense node share a few pivots
        pivots = dense.groupBy("node", F.pmod(F.xxhash64("c"), F.lit(PIVOTS))).agg(F.min("c").alias("c")).select("node", "c")
        members = members.unionByName(chunked(dense, pivots))
    first = durable(dealt(members).mapInArrow(partial(compare, per_cent=per_cent, split=True, seed=0), PAIRS))
    tried = first.filter("b is not null").select("a", "b")
    found = confirmed(tried, classes, docs, doc_id, text, k, per_cent)
    rest = first.filter("b is null").select("node", F.col("a").alias("c"), "sig")
    comps = components(found)
    for turn in range(1, FOREST_ROUNDS + 1):
        named = durable(rest.join(comps, "c", "left").select("node", "c", "sig", F.coalesce("root", "c").alias("comp")))
        several = named.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("node")
        members = named.join(several, "node", "left_semi")
        if dense is not None:
            own = durable(dense.join(comps, "c", "left").select("node", "c", "sig", "n", F.coalesce("root", "c").alias("comp")))
            held = own.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("k"))
            main = held.groupBy("node").agg(F.max_by("comp", "k").alias("main"))
            outside = own.join(main, "node").filter("comp <> main").select("node", "c")
            parts = chunked(own, outside).join(own.select("c", "comp").distinct(), "c").select("node", "c", "sig", "comp")
            members = members.unionByName(parts)
        if turn < FOREST_ROUNDS:
            more = dealt(members).mapInArrow(partial(compare, per_cent=per_cent, split=False, seed=turn), PAIRS).select("a", "b").distinct()
            more, sure = durable(more.join(tried, ["a", "b"], "left_anti")), None
        else:
            # What is left is settled where the members meet, on their full sets, so no list of pairs is made.
            members = durable(members)
            sets = class_sets(members.select("c").distinct(), classes, docs, doc_id, text, k)
            last = durable(dealt(members.join(sets, "c")).mapInArrow(partial(settle, per_cent=per_cent), SETTLED))
            more, sure = durable(last.filter("not sure").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")), last.filter("sure").select("a", "b").distinct()
        if more.isEmpty() and (sure is None or sure.isEmpty()):
            continue
        tried = tried.unionByName(more)
        new = confirmed(more, classes, docs, doc_id, text, k, per_cent)
        new = new if sure is None else new.unionByName(sure)
        found = found.unionByName(new)
        # What is known of components stands for the links that formed them.
        comps = components(comps.select(F.col("c").alias("a"), F.col("root").alias("b")).unionByName(new))
    return found, comps


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """One row per document: __id, __raw, n_shingles, component_id (smallest id reachable), kept."""
    rows = hashed(docs, doc_id, text, k)
    classes = classes_of(rows)
    _, comps = links(docs, classes, doc_id, text, k, per_cent)
    named = classes.join(comps, "c", "left").select("digest", "__id", F.coalesce("root", "c").alias("root"))
    least = named.groupBy("root").agg(F.min("__id").alias("component_id"))
    named = named.join(least, "root").select("digest", "component_id")
    out = rows.drop("sig").join(named, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("__id")).otherwise(F.col("component_id")))
    return out.select("__id", "__raw", "n_shingles", "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns unchanged. Documents without words stay."""
    groups = durable(near_groups(docs, doc_id, text, k, per_cent))
    out = without_rows(docs, groups.filter(~F.col("kept")).select("__id", "__raw"), doc_id, text)
    again = groups.filter("kept and n_shingles > 0").groupBy("__id").agg(F.count(F.lit(1)).alias("n"), F.min("__raw").alias("__raw")).filter("n > 1")
    return collapse_repeats(out, durable(again.select("__id")), doc_id)
