"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks by what they are made of: blocks inside menus, page
headers, footers, sidebars, notices, adverts, forms and reader comments are bad, so are blocks with many linked characters;
long blocks are good when enough of their words are stop words, and bad when too few are; blocks of middling length or density
are near-good; short blocks stay open. Stop words are those of English, German, French and Spanish: a page whose longer blocks hold
few of them is taken to be in another language, and its blocks are judged by length and links alone. If a page
marks its article (<article> or <main>), blocks outside it are bad, and long blocks inside need no stop words. What holds the
first <main>, or else the first <article>, is never bad, nor is a form, or an element with a bad word in a compound name, that holds
more than half of the page's text. On a page without good or near-good blocks the open ones that are no headings are good. Pass two
makes near-good blocks bad between two bad ones, but keeps them all on a page without a good block, and then
gives each open block the label of the nearest decided block (a heading: of the next one); in a marked article without a
decided block the open ones are good.

A null or empty page gives an empty text. Whole pages are read, whatever their length; unclosed tags, comments and quotes
end where a browser would at the latest end them. One page is one row, so a page that repeats gives its text twice.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import pick, small_batches

# Element names of HTML by their role on a page.
RAW = "script style noscript template textarea title iframe"
BAD_TAGS = frozenset("nav footer aside form menu dialog button fieldset select svg object canvas audio video".split())
CONTAINERS = BAD_TAGS | frozenset("div section article main header hgroup ul ol dl table figure details center body".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption thead tbody tfoot blockquote pre address figcaption summary hr html option legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role attributes that mark what is not the article.
BAD_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar
navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal
overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment
comments commentlist respond reply replies disqus discussion widget search searchform copyright legal pagination pager skip
contentinfo complementary search form""".split())
# Frequent function words of four languages.
STOP_WORDS = frozenset("""
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were
all her she there would their we him been has when who will no if out so what up said about than into them can only some
der die das und in zu den von mit ist des sich nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer
um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde im für auf dem
le la les de des du et en un une que qui dans pour par sur pas au ce il est plus ne se sont avec son aux ou mais comme nous
vous elle été cette ses on leur sa ont même si être
el los las y en un una que por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre
también me hasta hay donde quien desde todo nos durante es no se del""".split())

SHORT, LONG = 70, 200
MOST_LINKED, STOP_LOW, STOP_HIGH = 0.2, 0.15, 0.25
#: Stop words of a page's longer blocks below which its language is none of the four.
STOP_COVERED = 0.2
UNSPACED = 3  # Chinese and Japanese characters count as so many

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW.split()) + r")(?=[\s/>])[^>]*+>?.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_MARKS = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=>/]|$)|display\s*+:\s*+none", re.I)


class Block:
    __slots__ = ("pieces", "linked", "bad", "main", "heading", "label", "near", "text")

    def __init__(self, bad: bool, main: bool, heading: bool):
        self.pieces, self.linked, self.bad, self.main, self.heading = [], 0, bad, main, heading
        self.label, self.near, self.text = None, False, ""


def marked_bad(attrs: str) -> tuple[bool, bool]:
    """Whether the attributes mark what is not the article: hidden or by a name of its own, and by a part of a compound name."""
    if "=" not in attrs and "hidden" not in attrs:
        return False, False
    names = {name for m in _MARKS.finditer(attrs) for name in (m[1] or m[2] or m[3] or "").lower().split()}
    whole = bool(_HIDDEN.search(attrs)) or not names.isdisjoint(BAD_NAMES)
    return whole, not whole and any(part in BAD_NAMES for name in names for part in _PARTS.split(name))


def wrappers(found: list[re.Match], page: str) -> tuple[set[int], set[int]]:
    """Places in ``found`` of the containers that hold the main article's beginning, and of those that hold most of the text."""
    open_, sizes, holds, most, total, at = [], {}, set(), set(), 0, 0
    wanted = "main" if any(m["name"] and not m["end"] and m["name"].lower() == "main" for m in found) else "article"
    seen = False

    def close(first: int) -> None:
        for place, _, before, _ in open_[first:]:
            sizes[place] = total - before
        del open_[first:]

    for i, m in enumerate(found):
        total += len(page[at:m.start()].strip())
        at = m.end()
        name = (m["name"] or "").lower()
        if name not in CONTAINERS:
            continue
        if m["end"]:
            at_open = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][1] == name), None)
            if at_open is not None:
                close(at_open)
            continue
        whole = marked_bad(m["attrs"])[0] or name in ("aside", "footer", "menu")
        # An article inside an element that is bad by its own name (a reader's comment, a teaser) is not the page's.
        if name == wanted and not seen and (name == "main" or not (whole or any(x[3] for x in open_))):
            seen = True
            holds = {x[0] for x in open_}
        open_.append((i, name, total, whole))
    total += len(page[at:].strip())
    close(0)
    return holds, {place for place, size in sizes.items() if 2 * size > total}


def blocks(page: str) -> Iterator[Block]:
    """Blocks in page order that hold any text."""
    open_tags: list[tuple[str, bool, bool]] = []  # of containers: name, bad from here on, inside the article
    bad = main = linked = False
    block, at = Block(False, False, False), 0

    def cut(bad: bool, heading: bool) -> Block | None:
        nonlocal block
        done, block = block, Block(bad, main, heading)
        done.text = " ".join(html.unescape("".join(done.pieces)).split())
        return done if done.text else None

    found = list(_TOKEN.finditer(page))
    holds, most = wrappers(found, page)
    for i, m in enumerate(found):
        if m.start() > at:
            piece = page[at:m.start()]
            block.pieces.append(piece)
            if linked:
                block.linked += len(" ".join(html.unescape(piece).split()))
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                block.pieces.append(" ")
            continue
        name = name.lower()
        if name == "a":
            linked = not m["end"]
            continue
        if name not in BREAKS:
            if name in ("br", "img", "wbr", "input"):
                block.pieces.append("" if name == "wbr" else " ")
            continue
        if name in CONTAINERS:
            if m["end"]:
                at_open = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == name), None)
                if at_open is not None:
                    del open_tags[at_open:]
            else:
                inside = main or name in ("article", "main")
                whole, part = marked_bad(m["attrs"]) if name not in ("body", "article", "main") else (False, False)
                part = (part or name == "form") and i not in most
                own = i not in holds and (whole or part or (name in BAD_TAGS and name != "form") or (name == "header" and not main))
                open_tags.append((name, bad or own, inside))
            _, bad, main = open_tags[-1] if open_tags else ("", False, False)
            linked = False
        own = bad or (name not in CONTAINERS and not m["end"] and any(marked_bad(m["attrs"])))
        if done := cut(own, name in HEADINGS and not m["end"]):
            yield done
    if at < len(page):
        block.pieces.append(page[at:])
    if done := cut(False, False):
        yield done


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(1, len(words))


def length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + (UNSPACED - 1) * len(_UNSPACED.findall(text))


def covered(found: list[Block]) -> bool:
    """Whether the longer blocks that may be text hold enough stop words for one of their languages."""
    return stop_density(" ".join(b.text for b in found if not b.bad and b.linked <= MOST_LINKED * len(b.text) and length(b.text) >= SHORT)) >= STOP_COVERED


def decide(block: Block, marked: bool, by_words: bool) -> None:
    n = len(block.text)
    if block.bad or (marked and not block.main) or block.linked > MOST_LINKED * n:
        block.label = False
    elif marked:
        block.label = True if n >= SHORT else None
    elif length(block.text) < SHORT:
        block.label = False if block.linked else None
    else:
        density = stop_density(block.text) if by_words else 1.0
        block.label = False if density < STOP_LOW else True if density >= STOP_HIGH and length(block.text) > LONG else None
        block.near = block.label is None


def settle(found: list[Block]) -> None:
    """Near-good blocks are good, but between two bad ones bad, if the page has any good block."""
    some = any(b.label for b in found)
    before, last = [], None
    for b in found:
        before.append(last)
        last = last if b.label is None else b.label
    last = None
    for b, left in zip(reversed(found), reversed(before), strict=True):
        if b.near:
            b.label = not (some and left is False and last is False)
        elif b.label is not None:
            last = b.label


def inherit(found: list[Block], marked: bool) -> None:
    """Open blocks take the label of the nearest decided block; headings look ahead only."""
    before: list[tuple[int, bool] | None] = []
    last = None
    for i, b in enumerate(found):
        last = (i, b.label) if b.label is not None else last
        before.append(last)
    last = None
    for i in range(len(found) - 1, -1, -1):
        b = found[i]
        if b.label is not None:
            last = (i, b.label)
            continue
        # In a marked article what stands outside it says nothing about it.
        near = [x for x in ([last] if b.heading and last else [before[i], last]) if x and (not marked or found[x[0]].main and not found[x[0]].bad)]
        near.sort(key=lambda x: (abs(x[0] - i), not x[1]))
        b.text = b.text if (near[0][1] if near else marked) else ""


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = list(blocks(page))
    marked = any(b.main and not b.bad for b in found)
    by_words = marked or covered(found)
    for b in found:
        decide(b, marked, by_words)
    settle(found)
    if not marked and not any(b.label for b in found):
        for b in found:
            b.label = True if b.label is None and not b.heading else b.label
    inherit(found, marked)
    return " ".join(b.text for b in found if b.text and b.label is not False)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. A scan without a shuffle."""
    rows = pick(pages, page_id=page_id, url=url, html=source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            out = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
