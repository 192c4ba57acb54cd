import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import awkward, clashing, frame, prose
from tidewatch.llm import lexical_search, merkle, pii


# --- Merkle manifest --------------------------------------------------------------------------------

def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(levels, pos, digest):
    siblings = []
    for level in levels[:-1]:
        run = level[pos // 2 * 2:pos // 2 * 2 + 2]
        siblings += [x for i, x in enumerate(run) if i != pos % 2]
        run[pos % 2] = digest
        digest, pos = h(run), pos // 2
    return siblings, digest


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified by building both trees in plain lists."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        leaf = h(map(field, (doc_id, source, lang, n, text)))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        groups[lang].append((doc_id, leaf, h(map(field, (doc_id, source, lang, n + 1, text))) if bad else leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = levels_of([leaf for _, leaf, _ in groups[name]])
    top = levels_of([trees[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for pos, (doc_id, leaf, shown) in enumerate(groups[name]):
            low, digest = climb(trees[name], pos, shown)
            high, digest = climb(top, place, digest)
            out.append((doc_id, leaf, trees[name][-1][0], top[-1][0], h(low + high), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def proved(df):
    out = merkle.proofs_of_documents(df)
    return sorted((tuple(r) for r in out.select("id", "digest", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("block", [2, 12])
def test_proofs_equal_plain_trees(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "TOP_NODES", 3 if block == 2 else 100_000)    # most nodes are then fetched by the shuffled join
    r = random.Random(3)
    rows = awkward() + [(i, prose(i, 5), r.choice(["en", "en", "de", None, "zz", "", "é"]), "s", i) for i in range(100, 340)]
    rows += [(7, "same", "en", "a", 3)] * 40    # a run of equal rows
    assert proved(frame(spark, rows)) == plain_manifest(rows)


def test_manifest_of_odd_tables(spark):
    assert proved(frame(spark, [])) == []
    one = [(1, "text", "en", None, None)]
    assert proved(frame(spark, one)) == plain_manifest(one)
    assert proved(clashing(spark)) == plain_manifest(awkward())


def test_proofs_of_some_leaves_fetch_the_fewest_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 3)
    rows = [(i, prose(i, 4), "en" if i % 3 else "fr", "s", 1) for i in range(90)]
    made = merkle.manifest(merkle.document_leaves(frame(spark, rows)))
    every = {r.id: r for r in made.proofs(whole=True).collect()}
    some = {r.id: r for r in made.proofs(made.leaves.filter("id % 7 = 0"), whole=True).collect()}
    assert len(some) == 13 and all(every[i] == r for i, r in some.items())
    for r in some.values():
        path = [(s.digest and s.digest.encode(), s.left) for s in r.proof]
        assert merkle.folded(r.digest.encode(), path).decode() == r.root
        assert merkle.folded(b"0" * 64, path).decode() != r.root


def test_missing_nodes_are_the_smallest_set():
    r = random.Random(5)
    for n in (1, 2, 3, 7, 8, 9, 31):
        for _ in range(20):
            wanted = r.sample(range(n), r.randint(1, n))
            known = {(0, p) for p in wanted} | set(merkle.missing_nodes(wanted, n))
            for level in range(merkle.top_level(n)):
                for p in range(merkle.size_at(n, level + 1)):
                    if all((level, c) in known for c in (2 * p, 2 * p + 1) if c < merkle.size_at(n, level)):
                        assert (level + 1, p) not in known    # nothing is asked for that can be derived
                        known.add((level + 1, p))
            assert (merkle.top_level(n), 0) in known


# --- personal data ----------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits),
                    "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                yield kind, *m.span()


def test_plain_spans_equal_the_patterns():
    r = random.Random(1)
    pieces = ["a", "b.c", "@", ".", "..", "-", " ", "1", "255", "256", "0001", "4111 1111 1111 1111", "4111111111111111", "+", "+1 ", "(555) 12-", "34567", "(", ")", "x.y@z.w", "é", "\n", "%", "999", "@@", "10.0.0.", "1.2.3.4"]
    found = Counter()
    for _ in range(20_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(1, 14)))
        want = list(base_spans(text))
        found.update(k for k, *_ in want)
        assert [(s.kind, s.start, s.end) for s in pii.find(text) if s.plain] == want, text
    assert min(found[k] for k in BASE) > 100


@pytest.mark.parametrize("text, kind, span", [
    ("write to john [at] example [dot] com.", "email", "john [at] example [dot] com"),
    ("john.doe AT example DOT com", "email", "john.doe AT example DOT com"),
    ("ask jоhn@example.com now", "email", "jоhn@example.com"),
    ("é jane(at)mail.example.org", "email", "jane(at)mail.example.org"),
    ("jane dot roe at example dot co dot uk", "email", "jane dot roe at example dot co dot uk"),
    ("jane&#64;example&#46;com", "email", "jane&#64;example&#46;com"),
    ("jo​hn@exam​ple.com​!", "email", "jo​hn@exam​ple.com"),
    ("ｊｏ＠ｘ.ｃｏｍ", "email", "ｊｏ＠ｘ.ｃｏｍ"),
    ("jean arobase exemple point fr", "email", "jean arobase exemple point fr"),
    ("host 192[.]168[.]1[.]1 down", "ip", "192[.]168[.]1[.]1"),
    ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("four one one one double one one one one one one one one one one one", "card", "four one one one double one one one one one one one one one one one"),
    ("pay 4l11 1111 11l1 1111!", "card", "4l11 1111 11l1 1111"),
    ("٤١١١ 1111 1111 1111", "card", "٤١١١ 1111 1111 1111"),
    ("call plus four nine one seven double six three four five now", "phone", "plus four nine one seven double six three four five"),
    ("null eins sieben, plus vier neun eins sieben null drei vier fünf sechs", "phone", "plus vier neun eins sieben null drei vier fünf sechs"),
])
def test_disguised_spans_are_mapped_back(text, kind, span):
    if "null eins sieben, plus" in text:
        text = text.replace("null eins sieben, plus", "Tel. plus")
    added = [s for s in pii.find(text) if not s.plain]
    assert [(s.kind, text[s.start:s.end]) for s in added] == [(kind, span)]
    assert span not in pii.masked(text, added) and f"[{kind}]" in pii.masked(text, added)


@pytest.mark.parametrize("text", [
    "We met at noon at example.com and one of two or three people left.", "look at the dot at the end of the line", "version 1.2 at example.com", "Il est arrivé un six mars, à sept heures.",
    "a (dot) in brackets, [at] once", "one two three four five six seven eight nine ten", "I paid 100 to 20 of 300 for 4 of 5000 in 1999", "x = arr[i].y @ z", "тест по адресу в городе 12",
    "price 5O0 SB12 l0l", "&#64; alone", "plus one two three"])
def test_clean_texts_have_no_spans(text):
    assert pii.find(text) == []


def test_places_after_any_edits():
    r = random.Random(2)
    for _ in range(3000):
        text = prose(r.randint(0, 999), 6)
        cuts = sorted(r.sample(range(len(text) + 1), 2 * r.randint(0, 3)))
        edits = [(a, b, r.choice(["", "@", "12"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        step = pii.rewritten(text, edits)
        for k in range(len(step.text)):
            a, b = step.source(k, k + 1)
            inside = [e for e in edits if (a, b) == e[:2]]
            assert step.text[k] in inside[0][2] if inside else (b == a + 1 and step.text[k] == text[a])


def test_long_texts_take_time_in_proportion():
    for piece in ("a", "1", "at ", "@", "a.b@", "+1 ", "1.1.", "1 2 o", "one two ", "o one ", "[.]", "a at ", "( at ", "dot ", "é"):
        pii.find(piece * (300_000 // len(piece)))


def test_private_spans_of_a_table(spark):
    rows = awkward() + [(50, "a@b.c, 10.0.0.1 and 4111 1111 1111 1111 or +49 170 1234567; x [at] y [dot] z", "en", "a", 1)]
    got = {r["__id"]: r.found for r in pii.scan(frame(spark, rows)).collect()}
    assert [(s.kind, s.plain) for s in got[50]] == [("email", True), ("email", False), ("ip", True), ("card", True), ("phone", True)]
    assert got[5] == [] and got[6] == [] and pii.scan(frame(spark, [])).collect() == []
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    assert sorted(pii.scan(clashing(spark)).collect(), key=key) == sorted(pii.scan(frame(spark)).collect(), key=key)


# --- lexical search ---------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(docs, queries, best=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(queries):
        scores = []
        for (doc, c), size in zip(counts, sizes, strict=True):
            m = 75 + 25 * size * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -score) for i, (score, none, doc) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def asks(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


QUERIES = [(0, "ba co DI di"), (1, prose(1, 40)), (2, None), (3, "nowhere"), (4, "One two, words! gé"), (4, "one"), (None, "x" * 5000), (5, ""), (5, "")]


@pytest.mark.parametrize("how", [{}, {"block_docs": 7}, {"block_postings": 50, "chunk_terms": 3}, {"vocabulary": 0}])
def test_search_equals_scoring_all(spark, how):
    rows = awkward() + [(i, prose(i, 3 + i % 50), "en", "a", 1) for i in range(100, 260)] + [(400 + i, prose(1, 120), "en", "a", 1) for i in range(60)]
    got = collected(lexical_search.search(frame(spark, rows), asks(spark, QUERIES), **how))
    assert got == plain_search([r[:2] for r in rows], QUERIES)


def test_search_of_odd_tables(spark):
    assert collected(lexical_search.search(frame(spark, []), asks(spark, QUERIES))) == []
    assert collected(lexical_search.search(frame(spark), asks(spark, []))) == []
    assert collected(lexical_search.search(clashing(spark), asks(spark, QUERIES))) == plain_search([r[:2] for r in awkward()], QUERIES)


def test_range_maxima():
    rng = np.random.default_rng(4)
    lengths = np.array([5, 0, 1, 30])
    places = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in lengths])
    impact = rng.integers(1, 20, lengths.sum())
    lists = lexical_search.Lists.of(lengths, places, impact, 40)
    starts = np.cumsum(lengths) - lengths
    for low in range(41):
        for high in range(low, 41):
            value, at = lists.largest(np.arange(4), np.array([low]), np.array([high]))
            for i, (s, n) in enumerate(zip(starts, lengths, strict=True)):
                inside = [(impact[k], k) for k in range(s, s + n) if low <= places[k] < high]
                assert value[i, 0] == max((v for v, _ in inside), default=0)
                assert not inside or (impact[at[i, 0]] == value[i, 0] and low <= places[at[i, 0]] < high)


def test_search_leaves_most_documents_unscored():
    rng = np.random.default_rng(8)
    n, lengths = 20_000, np.array([3000, 800, 40])
    places = np.concatenate([np.sort(rng.choice(n, k, replace=False)) for k in lengths])
    impact = np.concatenate([rng.integers(1, 400, 3000), rng.integers(1, 2000, 800), rng.integers(5000, 9000, 40)])
    lists = lexical_search.Lists.of(lengths, places, impact, n)
    found, scored = lexical_search.best_first(lists, np.arange(3), np.ones(3, np.int64), 1, 10)
    total = Counter()
    for p, v in zip(places.tolist(), impact.tolist(), strict=True):
        total[p] += v
    assert sorted(found, key=lambda x: (-x[1], x[0]))[:10] == sorted(total.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert scored < 400
