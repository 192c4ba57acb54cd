"""Merkle manifest of a dataset: a hash tree per group of rows, a tree over their roots, and proofs for every row.

Leaves of a group are ordered by key, every two neighbours become one node (the last may be alone), level by level, until one
is left. The roots of the groups, ordered by group, are the leaves of the tree above them, whose top is the root.

Places come from a range exchange on (group, key): a task numbers the rows of its range, and prefix sums over one row per
range and group give the rest, so no group has to fit a task. Trees grow in rounds over aligned blocks of ``2 ** BLOCK``
nodes: a block makes its own nodes of the next BLOCK levels, and only its top goes to the next round.

Proofs are an octopus multiproof. A leaf partition (the wanted leaves of one block) computes the smallest set of nodes that its
leaves cannot derive themselves, in its own tree and in the one above, together with the two published roots; these
coordinates are fetched once for the whole partition, by one join with the stored nodes; interiors that several leaves share
are derived once, and the proof of every leaf is put together from them in the task. The nodes of the upper levels, which many
partitions ask for, are broadcast as long as there are at most ``TOP_NODES`` of them; the others have few askers.

Null values have their own encoding; a null group comes first, a null key is the first in its group. Rows with equal keys are
ordered by their digest; equal rows hold neighbouring places, and which holds which makes no difference. Extra columns are left
out. An empty table has no rows and so no proofs. Texts of any length are hashed in the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import BROADCAST_ROWS, pick
from tidewatch.session import durable

#: Levels that one round builds; a block holds up to 2 ** BLOCK nodes (about 1 MB of digests).
BLOCK = 12
#: Nodes (about 100 bytes each) of the upper levels that are broadcast.
TOP_NODES = 100_000
#: Number of the tree over the groups' roots.
ABOVE = -1


def encoded(values: Sequence[Column]) -> Column:
    """Values one after the other: ``-`` for null, else the number of bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(encoded(values), 256)


def node_digest(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def size_at(n: int, level: int) -> int:
    """Nodes at ``level`` of a tree with n leaves."""
    return -(-n >> level)


def top_level(n: int) -> int:
    return max(n - 1, 0).bit_length()


def placed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Rows of a written table with ``pos``, their place in their tree from 0, and ``n``, the rows of that tree."""
    schema = rows.select("*", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place")).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, place = object(), 0
        for batch in batches:
            places = []
            for name, run in groupby(batch.column(tree).to_pylist()):
                start = place if name == last else 0
                last, place = name, start + sum(1 for _ in run)
                places.extend(range(start, place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())],
                                             names=[*batch.schema.names, "part", "place"])

    rows = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    rows = durable(rows.mapInArrow(number, schema))
    parts = rows.groupBy(F.col(tree).alias("__tree"), F.col("part").alias("__part")).agg(F.count(F.lit(1)).alias("here"))
    of_tree = Window.partitionBy("__tree")
    before = of_tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = durable(parts.select("__tree", "__part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(of_tree).alias("n")))
    if parts.count() <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    rows = rows.join(parts, F.col(tree).eqNullSafe(F.col("__tree")) & (F.col("part") == F.col("__part")))
    return rows.withColumn("pos", F.col("before") + F.col("place")).drop("__tree", "__part", "part", "place", "before")


NODE = "tree long, level int, pos long, digest string"


def _raised(base: int):
    def blocks(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        digests = [d.encode() for d in table.column("digest").to_pylist()]
        tree, pos, n = (table.column(c)[0].as_py() for c in ("tree", "pos", "n"))
        levels, places, nodes = [], [], []
        for level in range(base + 1, base + BLOCK + 1):
            if size_at(n, level - 1) <= 1:
                break
            digests = [node_digest(digests[i:i + 2]) for i in range(0, len(digests), 2)]
            pos >>= 1
            levels += [level] * len(digests)
            places += range(pos, pos + len(digests))
            nodes += digests
        return pa.table({"tree": pa.array([tree] * len(nodes), pa.int64()), "level": pa.array(levels, pa.int32()),
                         "pos": pa.array(places, pa.int64()), "digest": pa.array([d.decode() for d in nodes], pa.string())})
    return blocks


def grown(leaves: DataFrame) -> DataFrame:
    """All nodes (tree, level, pos, digest) over written leaves (tree, pos, n, digest), the leaves themselves at level 0."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select("tree", F.lit(0).alias("level"), "pos", "digest")
    now = leaves.select("tree", "pos", "n", "digest")
    sizes = leaves.filter("pos = 0").select("tree", "n")    # one row per tree
    for base in range(0, top_level(most), BLOCK):
        block = F.expr(f"shiftright(pos, {BLOCK})").alias("block")
        level = durable(now.filter(F.col("n") > F.lit(1 << base)).groupBy("tree", block).applyInArrow(_raised(base), NODE))
        nodes = nodes.unionByName(level)
        now = level.filter(F.col("level") == base + BLOCK).join(sizes, "tree").select("tree", "pos", "n", "digest")
    return nodes


def tops(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """The top digest of each tree: tree, digest."""
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    heights = leaves.filter("pos = 0").select("tree", height.cast("int").alias("level"))
    return nodes.filter("pos = 0").join(heights, ["tree", "level"]).select("tree", "digest")


def missing_nodes(places: Sequence[int], n: int) -> list[tuple[int, int]]:
    """The smallest set of nodes (level, place) that proofs of these leaves need besides what the leaves give."""
    out, here = [], set(places)
    for level in range(top_level(n)):
        size = size_at(n, level)
        out += [(level, p ^ 1) for p in sorted(here) if p ^ 1 not in here and p ^ 1 < size]
        here = {p >> 1 for p in here}
    return out


ASKED = "tree long, block long, node_tree long, level int, pos long"


def _ask(table: pa.Table) -> pa.Table:
    tree, block, n, trees = (table.column(c)[0].as_py() for c in ("tree", "block", "n", "trees"))
    coordinates = [(tree, *x) for x in missing_nodes(table.column("pos").to_pylist(), n)] + [(ABOVE, *x) for x in missing_nodes([tree], trees)]
    coordinates += [(tree, top_level(n), 0), (ABOVE, top_level(trees), 0)]    # the published roots
    node_tree, level, pos = zip(*coordinates, strict=True)
    return pa.table({"tree": pa.array([tree] * len(pos), pa.int64()), "block": pa.array([block] * len(pos), pa.int64()),
                     "node_tree": pa.array(node_tree, pa.int64()), "level": pa.array(level, pa.int32()), "pos": pa.array(pos, pa.int64())})


def fetched(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """The asked coordinates with their digests."""
    nodes = nodes.select(F.col("tree").alias("node_tree"), "level", "pos", "digest")
    sizes = sorted(nodes.groupBy((F.col("node_tree") == ABOVE).alias("above"), "level").count().collect(), key=lambda r: (-r["above"], -r["level"]))
    top, total = F.lit(False), 0
    for r in sizes:    # at most about 60 levels
        if total + r["count"] > TOP_NODES:
            break
        total += r["count"]
        top = top | (((F.col("node_tree") == ABOVE) == F.lit(r["above"])) & (F.col("level") == r["level"]))
    key = ["node_tree", "level", "pos"]
    out = asked.filter(top).join(F.broadcast(nodes.filter(top)), key)
    rest = asked.filter(~top)
    if not rest.isEmpty():
        out = out.unionByName(rest.join(nodes.filter(~top), key))
    return out


def _derived(known: dict[int, dict[int, bytes]], places: set[int], n: int) -> None:
    """Adds the nodes above ``places``, level by level; each is derived once."""
    for level in range(top_level(n)):
        here, above = known[level], known.setdefault(level + 1, {})
        places = {p >> 1 for p in places}
        for p in places:
            above[p] = node_digest([here[c] for c in (2 * p, 2 * p + 1) if c in here])


class _Paths:
    """Sibling digests from a node to the top of its tree, shared by all leaves below it."""

    def __init__(self, known: dict[int, dict[int, bytes]], n: int, tail: tuple[tuple[bytes, bool], ...] = ()):
        self.known, self.height, self.tail, self.seen = known, top_level(n), tail, {}

    def of(self, level: int, pos: int) -> tuple[tuple[bytes | None, bool], ...]:
        """(sibling or None where the node is alone, whether the sibling is on the left) per level."""
        if level == self.height:
            return self.tail
        if (level, pos) not in self.seen:
            self.seen[level, pos] = ((self.known[level].get(pos ^ 1), bool(pos & 1)), *self.of(level + 1, pos >> 1))
        return self.seen[level, pos]


def folded(digest: bytes, path: Sequence[tuple[bytes | None, bool]]) -> bytes:
    """The root that a leaf and its proof give."""
    for sibling, left in path:
        digest = node_digest([digest] if sibling is None else [sibling, digest] if left else [digest, sibling])
    return digest


PROVED = "subroot string, root string, proof_sha256 string, folded_root string"
PROOF = "proof array<struct<level: int, digest: string, left: boolean>>"


def _expand(keep: Sequence[str], whole: bool):
    def block(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        tree, n, trees = (leaves.column(c)[0].as_py() for c in ("tree", "n", "trees"))
        own: dict[int, dict[int, bytes]] = {0: {}}
        above: dict[int, dict[int, bytes]] = {0: {}}
        for node_tree, level, pos, digest in zip(*(nodes.column(c).to_pylist() for c in ("node_tree", "level", "pos", "digest")), strict=True):
            (above if node_tree == ABOVE else own).setdefault(level, {})[pos] = digest.encode()
        subroot, root = own[top_level(n)][0], above[top_level(trees)][0]
        places = leaves.column("pos").to_pylist()
        digests = [d.encode() for d in leaves.column("digest").to_pylist()]
        own[0].update(zip(places, digests, strict=True))
        _derived(own, set(places), n)
        above[0][tree] = own[top_level(n)][0]
        _derived(above, {tree}, trees)
        paths = _Paths(own, n, _Paths(above, trees).of(0, tree))
        proofs = [paths.of(0, p) for p in places]
        shown = [None if c is None else c.encode() for c in leaves.column("changed").to_pylist()]
        out = {c: leaves.column(c) for c in keep}
        out["subroot"] = pa.array([subroot.decode()] * len(places), pa.string())
        out["root"] = pa.array([root.decode()] * len(places), pa.string())
        out["proof_sha256"] = pa.array([node_digest([s for s, _ in p if s is not None]).decode() for p in proofs], pa.string())
        top = above[top_level(trees)][0].decode()    # what the unchanged leaves give together
        out["folded_root"] = pa.array([top if c is None or c == d else folded(c, p).decode() for c, d, p in zip(shown, digests, proofs, strict=True)], pa.string())
        if whole:
            kind = pa.list_(pa.struct([("level", pa.int32()), ("digest", pa.string()), ("left", pa.bool_())]))
            out["proof"] = pa.array([[{"level": i, "digest": s and s.decode(), "left": left} for i, (s, left) in enumerate(p)] for p in proofs], kind)
        return pa.table(out)
    return block


def proved(wanted: DataFrame, nodes: DataFrame, whole: bool = False) -> DataFrame:
    """Proofs of ``wanted`` (rows of ``Manifest.leaves``, all or some): their id and digest, the two roots, the hash of the proof,
    and the root that ``changed`` (where not null, else the leaf itself) gives with it; with ``whole`` also the proof."""
    blocks = wanted.select("id", "digest", "changed", "tree", "pos", "n", "trees", F.expr(f"shiftright(pos, {BLOCK})").alias("block"))
    asked = durable(blocks.select("tree", "block", "pos", "n", "trees").groupBy("tree", "block").applyInArrow(_ask, ASKED))
    here = durable(fetched(asked, nodes))
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}
    schema = f"id {kinds['id']}, digest string, {PROVED}" + (f", {PROOF}" if whole else "")
    return blocks.groupBy("tree", "block").cogroup(here.groupBy("tree", "block")).applyInArrow(_expand(("id", "digest"), whole), schema)


class Manifest:
    """Written leaves (id, group, digest, changed, tree, pos, n, trees) and nodes (tree, level, pos, digest) of a table."""

    def __init__(self, leaves: DataFrame, nodes: DataFrame):
        self.leaves, self.nodes = leaves, nodes

    def proofs(self, wanted: DataFrame | None = None, whole: bool = False) -> DataFrame:
        return proved(self.leaves if wanted is None else wanted, self.nodes, whole)


def manifest(rows: DataFrame) -> Manifest:
    """Rows: id, group (string), digest, changed (a digest to be tested in place of the leaf, or null)."""
    salt = F.xxhash64(F.monotonically_increasing_id())    # parts runs of equal rows; written with them
    rows = durable(rows.select("id", "group", "digest", "changed", salt.alias("salt")))
    rows = placed(rows, "group", ["id", "digest", "salt"]).drop("salt")
    rows = durable(rows)
    groups = durable(rows.filter("pos = 0").select(F.lit("").alias("one"), F.col("group").alias("__group")))
    groups = placed(groups, "one", ["__group"]).select("__group", F.col("pos").alias("tree"), F.col("n").alias("trees"))
    groups = durable(groups)
    few = groups.count() <= BROADCAST_ROWS
    leaves = rows.join(F.broadcast(groups) if few else groups, F.col("group").eqNullSafe(F.col("__group"))).drop("__group")
    leaves = durable(leaves)
    nodes = grown(leaves)
    roots = tops(leaves, nodes).withColumnRenamed("tree", "pos").join(groups.select(F.col("tree").alias("pos"), F.col("trees").alias("n")), "pos")
    roots = durable(roots.select(F.lit(ABOVE).cast("long").alias("tree"), "pos", "n", "digest"))
    return Manifest(leaves, nodes.unionByName(grown(roots)))


def document_leaves(docs: DataFrame, key: str = "doc_id", group: str = "lang", text: str = "text", source: str = "source", size: str = "n_chars",
                    tampered: Column | None = None) -> DataFrame:
    """Leaves of a documents table. ``tampered`` (a condition on __id) tells for which rows ``changed`` counts one character more."""
    rows = pick(docs, __id=key, source=source, lang=group, size=size, text=text)
    name, rest = F.col("__id"), F.col("size").cast("long")
    if tampered is None:
        tampered = F.lit(False)
    changed = F.when(tampered, leaf_digest([name, F.col("source"), F.col("lang"), rest + 1, F.col("text")]))
    leaf = leaf_digest([name, F.col("source"), F.col("lang"), rest, F.col("text")])
    return rows.select(F.col("__id").alias("id"), F.col("lang").alias("group"), leaf.alias("digest"), changed.alias("changed"))


def proofs_of_documents(docs: DataFrame, **columns: str) -> DataFrame:
    """Every row proved against the manifest of the whole table, those whose id's checksum 7 divides with a tampered count."""
    tampered = F.crc32(F.col("__id").cast("string")) % 7 == 0
    out = manifest(document_leaves(docs, tampered=F.coalesce(tampered, F.lit(False)), **columns)).proofs()
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
