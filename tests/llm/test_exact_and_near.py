import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import awkward, clashing, frame, prose
from tidewatch.llm import exact_dedup, near_dedup, shingles, substring_dedup

SPACE = re.compile("[\x20\x09-\x0d]")
WORD = re.compile("[^\x20\x09-\x0d]+")


def test_exact_groups(spark):
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(frame(spark)).drop("__raw").select("__id", "keep_id", "group_size", "kept", "sha").collect())
    groups = defaultdict(list)
    for doc_id, text, *_ in awkward():
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = Counter()
    for norm, rows in groups.items():
        best = min(rows)
        for row in rows:
            want[row[3], best[3], len(rows), row == best, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert got == want


def test_exact_filter_keeps_one_row_of_a_group(spark):
    df = clashing(spark)
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns
    kept = [SPACE.sub("", r[1] or "") for r in out.collect()]
    assert len(kept) == len(set(kept)) == len({SPACE.sub("", r[1] or "") for r in awkward()})


@pytest.mark.parametrize("operator", [exact_dedup.exact_groups, exact_dedup.drop_exact_copies, near_dedup.near_groups, near_dedup.keep_one, substring_dedup.repeated_spans])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def sets(rows, k):
    out = []
    for doc_id, text, *_ in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        out.append((doc_id, frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows, k):
    """Component ids by comparing all pairs."""
    found = sets(rows, k)
    up = list(range(len(found)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(found):
        for j, (_, b) in enumerate(found[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc_id, _) in enumerate(found):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return Counter((doc_id, len(s), least.get(top(i)) if s else doc_id) for i, (doc_id, s) in enumerate(found))


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups(spark, k):
    got = near_dedup.near_groups(frame(spark), k=k)
    assert Counter(tuple(r) for r in got.select("__id", "n_shingles", "component_id").collect()) == brute(awkward(), k)


def chains():
    """Groups in which many members are similar to few others, and one large group; plus unrelated texts."""
    rows, n = [], 100
    for group in range(3):
        words = prose(group + 50, 150).split(" ")
        for step in range(120 if group == 0 else 12):
            at = (step * 7) % 150
            words = [*words[:at], f"w{group}x{step}", *words[at + 1:]]
            rows.append((n := n + 1, " ".join(words)))
    return rows + [(n + i, prose(900 + i, 60)) for i in range(1, 60)]


def test_dense_nodes_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 25)
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    rows = chains()
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    assert Counter(tuple(r) for r in got.select("__id", "n_shingles", "component_id").collect()) == brute(rows, 2)


def test_link_of_a_member_that_matches_no_pivot():
    """A node that does not part: 120 near copies of a text, u similar to them in part, and v similar to u only."""
    r = np.random.default_rng(5)
    copies = np.tile(r.integers(0, 1 << 16, near_dedup.N), (122, 1))
    u, v = 120, 121
    copies[u, 65:] = r.integers(0, 1 << 16, near_dedup.N - 65)
    copies[v] = copies[u]
    copies[v, 55:65] = r.integers(0, 1 << 16, 10)
    sig = [row.astype("<u2").tobytes() + (100).to_bytes(4, "little") for row in copies]
    for node in range(40):
        batch = pa.RecordBatch.from_arrays([pa.array(np.full(122, node)), pa.array(np.arange(122)), pa.array(sig, pa.binary())], ["node", "c", "sig"])
        first = pa.Table.from_batches(near_dedup.compare(iter([batch]), 80, split=True, seed=node)).to_pylist()
        pairs = {(x["a"], x["b"]) for x in first if x["b"] is not None}
        members = sorted((x["node"], x["a"], x["sig"]) for x in first if x["b"] is None)
        # The links to the copies are likely ones that the whole sets do not confirm, so u and v stay alone.
        comp = [x[1] if x[1] in (u, v) else 0 for x in members]
        sets = [np.arange(1000 if x[1] in (u, v) else 0, 1100 if x[1] in (u, v) else 100, dtype=np.uint64).tobytes() for x in members]
        for given in (sets, [None] * len(sets)):
            again = pa.RecordBatch.from_arrays([*map(pa.array, zip(*members, strict=True)), pa.array(comp), pa.array(given, pa.binary())], ["node", "c", "sig", "comp", "set"])
            last = [x for b in near_dedup.settle(iter([again]), 80) for x in b.to_pylist()]
            links = {(x["a"], x["b"]) for x in last if x["sure"]}
            assert links == ({(u, v)} if given is sets else set()), node
            assert given is sets or (u, v) in pairs | {(x["a"], x["b"]) for x in last}, node


def test_settled_links_equal_all_pairs():
    """A node of sets around the threshold: the components that its links form are those of all similar pairs."""
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 60, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(400) < keep], r.integers(0, 1 << 60, 30, dtype=np.uint64)])) for keep in r.uniform(0.8, 1.0, 90)]
    starts = np.cumsum([0, *map(len, sets)])
    sig = np.concatenate([shingles.signatures(np.concatenate(sets), starts), np.array([[len(x), 0] for x in sets], np.uint16)], axis=1)
    comp = np.arange(90) // 3 * 3    # some are united already
    sure, unsure = near_dedup.settled_node(sig, comp, pa.array([x.tobytes() for x in sets], pa.binary()), 80)
    assert unsure == [] and 0 < len(sure) < 30
    got, want = near_dedup.Forest(comp), near_dedup.Forest(comp)
    for a, b in sure:
        assert near_dedup.similar(sets[a], sets[b], 80)
        got.join(a, b)
    for a in range(90):
        for b in range(a):
            same = len(np.intersect1d(sets[a], sets[b]))
            if comp[a] != comp[b] and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                want.join(a, b)
    assert [got.top(i) for i in range(90)] == [want.top(i) for i in range(90)]


def test_near_filter_keeps_one_of_a_group(spark):
    df = clashing(spark)
    out = near_dedup.keep_one(df, k=2)
    assert out.columns == df.columns
    kept = Counter(r[0] for r in out.collect())
    empty = Counter(r[0] for r in awkward() if not WORD.search(r[1] or ""))
    assert all(kept[i] == n for i, n in empty.items())
    assert kept[1] == 1 and not kept[2] and not kept[3] and not kept[4] and kept[15] == 0 and kept[14] == 1 and kept[8] == 1 and kept[9] == 0


def test_repeated_passages_are_found_whatever_stands_before(spark):
    passage = prose(77, 55)
    rows = [(i, f"{prose(i, 20 + i)} {passage} {prose(1000 + i, 30)}") for i in range(1, 6)] + [(i, prose(i, 200)) for i in range(20, 40)]
    spans = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    assert {s.id for s in spans} == {1, 2, 3, 4, 5}
    assert all(text[s.id][s.start:s.end] in passage for s in spans)
    assert {s.id for s in spans if not s.removed} == {1}


def plain_spans(rows, raws, min_chars=80):
    """(id, start, end, n_chars, first_id, removed) of each document by counting chunks of bytes."""
    docs = sorted({(doc_id is None, doc_id or 0, raws[text], doc_id, text) for doc_id, text in rows if text}, key=lambda x: x[:3])
    places = defaultdict(list)
    for k, (*_, text) in enumerate(docs):
        raw = text.encode()
        ends = substring_dedup.cuts(np.frombuffer(raw, np.uint8)).tolist()
        for a, b in zip([0, *ends], ends, strict=False):
            places[raw[a:b]].append((k, len(raw[:a].decode()), len(raw[:b].decode())))
    hits = defaultdict(list)
    for found in places.values():
        if len(found) > 1:    # the first document keeps it, at its first place
            seen = set()
            for k, a, b in found:
                hits[k].append((a, b, docs[found[0][0]][3], k != found[0][0] or k in seen))
                seen.add(k)
    out = []
    for k, own in hits.items():
        runs = []
        for hit in sorted(own):
            if runs and runs[-1][-1][1] == hit[0]:
                runs[-1].append(hit)
            else:
                runs.append([hit])
        for run in runs:
            start, end = run[0][0], run[-1][1]
            if end - start >= min_chars:
                firsts = [x[2] for x in run if x[2] is not None]
                out.append((docs[k][3], start, end, end - start, min(firsts) if firsts else None, 2 * sum(b - a for a, b, _, gone in run if gone) > end - start))
    return sorted(out, key=repr)


def test_spans_equal_a_plain_count(spark):
    from pyspark.sql import functions as F
    shared = prose(91, 60)
    rows = [r[:2] for r in awkward()]
    rows += [(7, f"{prose(i, 20)} {shared} {prose(i + 50, 15)} é{shared}") for i in (200, 201)] + [(None, f"{shared} {prose(5, 200)}"), (None, prose(5, 200)), (None, None), (7, None)]
    rows += [(300, prose(92, 300))] * 3 + [(301, prose(93, 40) + prose(92, 300))] + [(302, prose(94, 200))] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    raws = {r.text: r.raw for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw")).collect()}
    want = plain_spans(rows, raws)
    got = sorted((tuple(r) for r in substring_dedup.repeated_spans(df).drop("raw").collect()), key=repr)
    assert len(want) > 10 and got == want
    assert not any(r[0] == 302 for r in got)    # a row given twice is no repeat of itself


def test_cut_text_of_repeated_and_missing_ids(spark):
    unique, passage = prose(95, 200), prose(96, 150)
    rows = [(1, passage), (7, unique), (7, passage), (7, None), (None, passage), (None, unique[::-1]), (2, ""), (2, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __cut string")
    out = substring_dedup.without_repeats(df)
    assert out.columns == df.columns
    texts = Counter((r[0], r[1]) for r in out.collect())
    assert texts[1, passage] == texts[7, unique] == texts[None, unique[::-1]] == texts[7, None] == 1 and texts[2, ""] == 2
    assert sum(len(t or "") for _, t in texts.elements()) < sum(len(t or "") for _, t in rows) - 1.5 * len(passage)
    assert substring_dedup.without_repeats(spark.createDataFrame([], df.schema)).count() == 0


def test_cut_text(spark):
    passage = prose(78, 80)
    df = spark.createDataFrame([(1, passage, "x"), (2, f"{prose(1, 30)} {passage} {prose(2, 30)}", "y"), (3, None, "z")], "doc_id long, text string, id string")
    out = {r.doc_id: r.text for r in substring_dedup.without_repeats(df).collect()}
    assert out[1] == passage and out[3] is None
    assert len(out[2]) < len(prose(1, 30)) + len(prose(2, 30)) + 0.3 * len(passage)
