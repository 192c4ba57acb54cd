import base64
import math
import pathlib
import random
import re
import string
import textwrap
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import awkward, clashing, frame, prose
from tidewatch.llm import elias_fano, html_text, language_model, licenses, quality

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = "The cat sat on the mat and the dog was in the house with all of its friends for a day that no one of them would forget."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain &amp; short", "plain & short"),
    (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>&copy; x</footer>", f"Title {LONG} Short."),
    (f"<article><p>{LONG}</p><div class='ad'>Buy</div><ul class=\"share-links\"><li>Tweet</ul><section id=comments><p>{LONG} No!</p></section></article>", LONG),
    (f"<article><p>a&lt;b&#233; {LONG}<br>x<script>var a='</p><p>no</p>'</script></p><!-- <p>no</p> --></article>", f"a<bé {LONG} x"),
    (f"<main><p>{LONG}</p><form><p>Name</p></form></main><aside>{LONG}</aside>", LONG),
    (f"<div class='cookie-notice'>{LONG}</div><article><p>Only this.", "Only this."),
    (f"<div><a href=x>{LONG}</a></div><div><p>{LONG} {LONG}</p><p>And so.</p></div><div><a href=y>more</a></div>", f"{LONG} {LONG} And so."),
    ("<article><p>" + "x " * 50_000, " ".join(["x"] * 50_000)),
    ("<article><p title='a>b'>one <b>two</b> three</p></article", "one two three"),
])
def test_main_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("paragraph", [
    LONG,  # 70 to 200 characters
    "Когда комитет снова собрался весной, большинство его членов уже решили, что старый мост придётся заменить. " * 2,
    "Quando il comitato si riunì di nuovo in primavera, la maggior parte dei membri aveva già deciso di sostituire il ponte. " * 2,
    "委員会が春に再び開かれたとき、大半の委員はすでに古い橋を架け替えなければならないと決めていた。"])
def test_main_text_of_unmarked_pages(paragraph):
    menu, end = "<nav><a href=x>Home</a> and more</nav>", f"<div class=footer>{paragraph}</div>"
    for first, last in (("", ""), (menu, end)):
        text = html_text.main_text(f"{first}<h1>Title</h1><p>{paragraph}</p><p>{paragraph}</p><p>Short.</p>{last}")
        # The short block is as near to the footer as to good text, and good comes first.
        assert text == f"Title {paragraph.strip()} {paragraph.strip()} Short."


ARTICLE = " ".join(f"<p>{LONG}</p>" for _ in range(5))


@pytest.mark.parametrize("page", [
    *(f"<body><nav><a href=x>Home</a></nav><div class='{name}'>{{}}</div></body>" for name in
      ("wrap has-sidebar", "container no-sidebar", "layout-with-nav", "post social-share-enabled", "page nav-open cookie-bar-shown")),
    "<section class='form-wide'>{}</section>", "<form id=aspnetForm action=x><div>{}</div></form>", "<nav><a href=x>Home</a><li>More{}"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_wrappers_do_not_spoil_the_article(page, tag):
    if tag == "div" and page.startswith("<nav>"):
        return    # nothing says where the menu ends
    body = f"<{tag}>{ARTICLE}</{tag}><div class=comments><p>{LONG} No!</p></div><div class='share-links'>Tweet</div>"
    assert html_text.main_text(page.format(body)) == " ".join([LONG] * 5)


def test_generated_pages(spark):
    """Articles of known text between known chrome, with marked and unmarked articles and wrapped in odd names."""
    r = random.Random(12)
    rows, want = [], {}
    for i in range(120):
        paragraphs = [" ".join([LONG] * r.randint(1, 3)) + f" {i}." for _ in range(r.randint(2, 6))]
        tag = r.choice(["article", "main", "div class=post", "div class='entry no-sidebar'"])
        inner = "".join(f"<p>{p}</p>" for p in paragraphs)
        extra = [f"<aside><p>{LONG} Aside.</p></aside>", f"<div id=comments><article><p>{LONG} Comment.</p></article></div>", "<div class='newsletter-box'><p>Join us</p></div>",
                 f"<footer><p>{LONG} Footer.</p></footer>", f"<div class='cookie-banner'>{LONG}</div>", "<form><label>Name</label><input></form>"]
        after = "".join(r.sample(extra, r.randint(0, 4)))
        wrap = r.choice(["", "wrapper has-nav", "site with-ads"])
        rows.append((i, f"u{i}", f"<html><body><header><a href=/>Site</a></header><nav><a href=x>A</a><a href=y>B</a></nav><div class='{wrap}'><{tag}>{inner}</{tag.split()[0]}>{after}</div></body></html>"))
        want[i] = " ".join(paragraphs)
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_formulas_stay_in_their_paragraph():
    page = f"<article><p>{LONG} Here <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>"
    assert html_text.main_text(page) == f"{LONG} Here x=1 holds."


def test_near_good_blocks_between_bad_ones_are_dropped():
    page = f"<p>{LONG} {LONG}</p><p>{LONG}</p><div class=ad>x</div><p>{LONG} No!</p><div class=ad>y</div>"
    assert html_text.main_text(page) == f"{LONG} {LONG} {LONG}"


def test_odd_markup_takes_no_time():
    for page in ("<" * 20_000, "<a '" * 5_000, "<p a=\"" * 5_000, "<!--" * 5_000, "<script" * 5_000, "&" * 20_000):
        html_text.main_text(page)


def test_extract(spark):
    rows = [(1, "u", f"<article><p>{LONG}</article>"), (None, None, None), (2, "u", ""), (2, "u", "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    out = Counter(tuple(r) for r in html_text.extract(df).collect())
    assert out == Counter({(1, "u", LONG, len(LONG)): 1, (None, None, "", 0): 1, (2, "u", "", 0): 2})
    assert html_text.extract(df.limit(0)).count() == 0


def base_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + d for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for d in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit),
            len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_base_counts(spark):
    rows = [*awkward(), (30, "a b c d e f " * 3 + "g h\n#1 $2\n#1 $2\n", "en", "a", 1), (31, LONG, "en", "a", 1), (32, " a b " * 12, None, "a", 1)]
    got = Counter(tuple(r)[:7] for r in quality.measure(frame(spark, rows)).collect())
    assert got == Counter((r[0], *base_counts(r[1])) for r in rows)
    kept = {r.doc_id for r in quality.measure(frame(spark, rows)).collect() if r.kept}
    assert 31 in kept and 30 not in kept and 5 not in kept


def test_bands_reject_what_tokenises_badly(spark):
    rows = [(1, " ".join(chr(0x1F900 + i) for i in range(60)), "en", "a", 1),
            (2, " ".join(chr(0x12000 + i) * 4 for i in range(80)), "en", "a", 1), (3, LONG, "en", "a", 1)]
    kept = {r.doc_id: (r.kept, r.byte_share) for r in quality.measure(frame(spark, rows)).collect()}
    assert kept[3][0] and not kept[2][0] and kept[2][1] > 0.5


def test_bands_reject_random_strings_and_keep_prose(spark):
    r = random.Random(4)
    strings = lambda kind, n: " ".join("".join(r.choice(kind) for _ in range(r.randint(3, 9))) for _ in range(n))
    junk = [strings(string.ascii_lowercase, 150), strings("bcdfghjklmnpqrstvwxz", 150), strings(string.punctuation, 150),
            " ".join(base64.b64encode(r.randbytes(45)).decode() for _ in range(15))]
    prose_of = {
        "en": LONG, "de": "Als sich der Ausschuss im Frühjahr wieder traf, hatten die meisten Mitglieder bereits beschlossen, dass die alte Brücke ersetzt werden müsse.",
        "fr": "Lorsque le comité s'est réuni de nouveau au printemps, la plupart de ses membres avaient déjà décidé que le vieux pont devait être remplacé.",
        "es": "Cuando el comité volvió a reunirse en primavera, la mayoría de sus miembros ya había decidido que el viejo puente debía ser reemplazado.",
        "it": "Quando il comitato si riunì di nuovo in primavera, la maggior parte dei suoi membri aveva già deciso che il vecchio ponte doveva essere sostituito.",
        "vi": "Khi ủy ban họp lại vào mùa xuân, hầu hết các thành viên đã quyết định rằng cây cầu cũ sẽ phải được thay thế.",
        "ru": "Когда комитет снова собрался весной, большинство его членов уже решили, что старый мост придётся заменить, хотя никто не мог сказать, когда.",
        "am": "ኮሚቴው በፀደይ ወቅት እንደገና ሲሰበሰብ አብዛኞቹ አባላቱ አሮጌው ድልድይ መተካት እንዳለበት አስቀድመው ወስነው ነበር"}
    rows = [(i * 10 + j, text, lang, "a", 1) for i, text in enumerate(junk) for j, lang in enumerate(["en", "de", "fr", "es", None])]
    rows += [(100 + i, text, lang, "a", 1) for i, (lang, text) in enumerate(prose_of.items())]
    got = {x.doc_id: (x.base_failed, x.kept) for x in quality.measure(frame(spark, rows)).collect()}
    assert all(got[i] == (False, i >= 100) for i in got)


def test_quality_filter_keeps_columns(spark):
    df = clashing(spark)
    out = quality.keep_good(df)
    assert out.columns == df.columns
    good = Counter(r.doc_id for r in quality.measure(frame(spark)).collect() if r.kept)
    assert Counter(r[0] for r in out.collect()) == good
    assert quality.keep_good(frame(spark, [])).count() == 0 and quality.measure(frame(spark, [])).count() == 0


def test_search_decodes_nothing():
    """Bits per n-gram of a large trie, and what a search takes besides: a bound that does not grow with the trie."""
    r = np.random.default_rng(4)
    pairs = np.unique(np.stack([r.integers(0, 20_000, 1_000_000), r.integers(0, 1 << 32, 1_000_000)]), axis=1).astype(np.uint64)
    codes = r.integers(1, 256, pairs.shape[1]).astype(np.uint8)
    trie = elias_fano.Trie.from_buffer(elias_fano.Trie.build(pairs[0], pairs[1], codes, np.full(len(np.unique(pairs[0])), 9, np.uint8), 1 << 32).to_bytes())
    assert sum(x.nbytes() for x in (trie.contexts, trie.pointers, trie.successors)) < 4.6 * pairs.shape[1]
    asked = r.integers(0, pairs.shape[1], 1000)
    tracemalloc.start()
    value, _ = trie.search(pairs[0][asked], pairs[1][asked])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (value == codes[asked]).all() and most < 4_000_000


def test_elias_fano_round_trip(tmp_path):
    r = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 0), (5, 3), (1000, 1 << 40), (1000, 200)):
        values = np.sort(r.integers(0, top + 1, n, dtype=np.uint64))
        kept = elias_fano.EliasFano.of(values)
        assert (kept.decode() == values).all()
        wanted = np.unique(np.concatenate([values, values + np.uint64(1), values[:50] // np.uint64(3), r.integers(0, top + 2, 60, dtype=np.uint64)]))
        at, hit = kept.find(wanted)
        assert (hit == np.isin(wanted, values)).all() and (values[at[hit]] == wanted[hit]).all()
        if n:
            first = np.searchsorted(values, wanted) + 1    # where the search may not look
            assert not (kept.find(wanted, first, np.full(len(wanted), n))[1] & (np.searchsorted(values, wanted, "right") <= first)).any()
    pairs = np.unique(np.stack([r.integers(0, 50, 900), r.integers(0, 1 << 32, 900)]), axis=1).astype(np.uint64)
    codes = r.integers(1, 256, pairs.shape[1]).astype(np.uint8)
    backoff = np.arange(1, len(np.unique(pairs[0])) + 1).astype(np.uint8)
    trie = elias_fano.Trie.build(pairs[0], pairs[1], codes, backoff, 1 << 32)
    (tmp_path / "trie").write_bytes(trie.to_bytes())
    mapped = elias_fano.Trie.open(str(tmp_path / "trie"))
    value, back = mapped.search(pairs[0], pairs[1])
    assert (value == codes).all() and (back == backoff[np.searchsorted(np.unique(pairs[0]), pairs[0])]).all()
    value, back = mapped.search(np.array([7, 99], np.uint64), np.array([1, 1], np.uint64))
    assert value.tolist() == [0, 0] and back[1] == 0
    assert sum(x.nbytes for x in (trie.successors.lows, trie.successors.highs)) < pairs.shape[1] * 6


@pytest.mark.parametrize("block, shard", [(1 << 22, 1 << 22), (300, 2000)])
def test_scores(spark, monkeypatch, block, shard):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", block)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", shard)
    rows = [*awkward(), *((100 + i, prose(i, 150) + " " + LONG, None, None, 1) for i in range(40))]
    got = language_model.score(frame(spark, rows)).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    tokens = [(i, [w.encode().lower() for w in WORD.findall(t or "")] + [None]) for i, t, *_ in rows]
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    pairs = Counter((a, b) for i, t in tokens if not held(i) for a, b in zip(["^", *t], t, strict=False))
    seen, kinds = Counter(), Counter(a for a, _ in pairs)
    for (a, _), k in pairs.items():
        seen[a] += k
    n, v = c.total(), len(c)

    def p(a, b):
        one = (c[b] - 0.75) / n if c[b] else 0.75 * v / n
        return one if not seen[a] else max(pairs[a, b] - 0.75, 0) / seen[a] + 0.75 * kinds[a] / seen[a] * one

    want = Counter((i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for i, t in tokens)
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    model = sorted(sum(math.log10(p(a, b)) for a, b in zip(["^", *t], t, strict=False)) / len(t) for _, t in tokens)
    assert np.allclose(model, sorted(r.score / r.n_tokens for r in got), atol=0.12)
    out = [(r.score, r.base_score) for r in got if r.held_out and r.n_tokens > 50]
    assert sum(a for a, _ in out) > sum(b for _, b in out)


def test_scores_of_many_shards_equal_the_plain_model(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 500)
    # The words of a large group of copies are frequent contexts with fewer successors than there are shards.
    rows = [*awkward(), *((100 + i, f"{LONG} {prose(i, 8)} {LONG if i % 3 else ' '.join(reversed(LONG.split()))}", None, None, 1) for i in range(90))]
    rows += [(i, " ".join(f"{w} {rare}" for w, rare in zip(LONG.split(), prose(i, 40).split(), strict=False)), None, None, 1) for i in range(200, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = {r.id: r.score for r in language_model.score(frame(spark, rows)).collect() if r.id is not None and r.id >= 100}
    tokens = [(i, ["^", *(w.encode().lower() for w in WORD.findall(t or "")), None]) for i, t, *_ in rows]
    train = [t for i, t in tokens if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    c, pairs = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:], strict=False))
    n, v, kinds, seen = c.total(), len(c), Counter(a for a, _ in pairs), Counter(a for t in train for a in t[:-1])

    def p(a, b):
        one = (c[b] - 0.75) / n if c[b] else 0.75 * v / n
        return one if not seen[a] else max(pairs[a, b] - 0.75, 0) / seen[a] + 0.75 * kinds[a] / seen[a] * one

    for i, t in tokens:
        if i in got:
            assert abs(got[i] - sum(math.log10(p(a, b)) for a, b in zip(t, t[1:], strict=False))) < 0.02 * len(t)


def test_scores_of_nothing(spark):
    assert language_model.score(frame(spark, [])).count() == 0


def test_licenses(spark):
    mit = licenses.TEXTS[0][1]
    changed = "Copyright (c) 2020 A. Body\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ,")
    rows = [(1, mit), (2, changed), (3, mit + " more"), (4, f"x\nreleased under the MIT  licence\n{LONG}\nLicensed under CC BY 4.0.\nLicensed under CC BY 4.0"), (5, None), (None, ""), (6, "Released under the MIT License.")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {r["__id"]: (r.license, r.notices) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "CC-BY-4.0,MIT"), 5: (None, ""), None: (None, ""), 6: ("MIT", "MIT")}
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(clashing(spark)).count() == len(awkward())


def test_licenses_by_other_wrapping_wording_and_longer_texts(spark):
    lines = lambda text, width: "\n".join(textwrap.wrap(text, width))
    bsd = dict(licenses.TEXTS)["BSD-3-Clause"].replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")
    rows = [(i, "Copyright (c) 2020 A. Body\n" + lines(bsd, width), "BSD-3-Clause", "") for i, width in enumerate(range(40, 90))]
    rows += [(100, "# SPDX-License-Identifier: Apache-2.0", None, "Apache-2.0"), (101, "x\n// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\ny", None, "GPL-2.0-only,MIT"),
             (102, 'y\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not', None, "Apache-2.0")]
    for i, (name, file) in enumerate([("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")]):
        path = pathlib.Path("/usr/share/common-licenses", file)
        if path.exists():
            rows.append((200 + i, path.read_text().replace("\n", " \n  "), name, None))
    got = {r["__id"]: (r.license, r.notices) for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, _, name, notices in rows:
        assert got[i][0] == name and notices in (None, got[i][1]), (i, got[i])


def test_labels_of_other_scripts_do_not_choose_the_band():
    pieces = quality.tokens.piece_words(quality.tokens.vocabulary_path(quality.VOCABULARY))
    r = random.Random(3)
    junk = [" ".join("".join(r.choices(string.ascii_lowercase, k=8)) for _ in range(80)), base64.b64encode(r.randbytes(900)).decode().replace("A", " "),
            " ".join("".join(r.choices(string.punctuation, k=6)) for _ in range(80))]
    for text in junk:
        assert {quality.judge([text], [lang], pieces)[0][6] for lang in (None, "en", "other", "han", "cyrillic", "xx")} == {False}
    russian = "Когда комитет снова собрался весной, большинство его членов уже решили, что старый мост придётся заменить. " * 2
    assert {quality.judge([russian + str(i)], [lang], pieces)[0][-1] for i, lang in enumerate(("en", "ru", None))} == {"cyrillic"}
    assert quality.judge([LONG], ["fr"], pieces)[0][-1] == "fr"
