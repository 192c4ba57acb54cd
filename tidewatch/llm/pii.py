"""Personal data in texts, also where it is disguised, with the places in the source text.

Plain identifiers (mail addresses, IP addresses, card and phone numbers) are found in the text as it stands. Disguised ones are
found by transducers, each of which rewrites a text and keeps, for every character it writes, the source characters it stands for:

1. ``homoglyphs``: letters, digits and signs that only look like ASCII (full-width and mathematical forms, Cyrillic and Greek
   look-alikes, digits of other scripts, dashes, odd spaces) become ASCII, and characters without width go;
2. ``at_dot``: entities, bracketed and spelled forms of ``@`` and ``.`` become these signs;
3. ``digits``: spelled digits of four languages (also "double" and "triple"), "plus" and "point" between them become digits and
   signs, and letters that stand for digits inside long numbers become digits.

The detectors then run on the rewritten text, and a span found there is mapped back: from the first source character of its
first written one to the last of its last. Spans inside a plain span of the same kind are left out; plain ones always stay.

One pass in Arrow batches bounded in bytes, no shuffle, no state between rows. Every rule looks at characters once or a bounded
number of times, so long texts (one word of 50 MB, too) take time in proportion. Null texts are empty and have no spans. Rows that
repeat give the same answer each; null ids and extra columns of any name are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import pick, small_batches, texts

KINDS = ("email", "ip", "card", "phone")


# --- detectors --------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` with a domain, back over the characters of a name, so that long words are read once."""
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _BEFORE_AT:
            start -= 1
        if start < m.start():
            end = m.end()
            yield start, end


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m.group().split("."))):
            yield m.span()


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _count(text: str, start: int, end: int) -> int:
    return sum(text.count(d, start, end) for d in "0123456789")


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= _count(text, *m.span()) <= 19 and passes_luhn(re.sub("[^0-9]", "", m.group())):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= _count(text, *m.span()) <= 15:
            yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}
#: A sign that every match holds.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


# --- transducers ------------------------------------------------------------------------------------

class Written(NamedTuple):
    """A rewritten text. Edit i wrote ``sizes[i]`` characters from place ``at[i]`` on for the source ``starts[i]:ends[i]``."""

    text: str
    at: list[int]
    sizes: list[int]
    starts: list[int]
    ends: list[int]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source characters of the written ones from ``start`` to ``end``; an edit counts as a whole."""
        return self._place(start)[0], self._place(end - 1)[1]

    def _place(self, k: int) -> tuple[int, int]:
        i = bisect_right(self.at, k) - 1
        if i < 0:
            return k, k + 1
        if k < self.at[i] + self.sizes[i]:
            return self.starts[i], self.ends[i]
        k += self.ends[i] - self.at[i] - self.sizes[i]
        return k, k + 1


def rewritten(text: str, edits: list[tuple[int, int, str]]) -> Written:
    """``text`` with the edits (start, end, written), which are in order and do not overlap."""
    parts, at, last, size = [], [], 0, 0
    for start, end, new in edits:
        parts += [text[last:start], new]
        size += start - last
        at.append(size)
        size += len(new)
        last = end
    parts.append(text[last:])
    return Written("".join(parts), at, [len(e[2]) for e in edits], [e[0] for e in edits], [e[1] for e in edits])


# Letters of other scripts that look like these Latin ones.
LOOK_ALIKES = (
    ("а", "a"), ("в", "b"), ("с", "c"), ("ԁ", "d"), ("е", "e"), ("һ", "h"), ("і", "i"), ("ј", "j"), ("к", "k"), ("м", "m"), ("о", "o"), ("р", "p"),
    ("ԛ", "q"), ("ѕ", "s"), ("т", "t"), ("у", "y"), ("х", "x"), ("ԝ", "w"), ("А", "A"), ("В", "B"), ("С", "C"), ("Е", "E"), ("Н", "H"), ("І", "I"),
    ("Ј", "J"), ("К", "K"), ("М", "M"), ("О", "O"), ("Р", "P"), ("Ѕ", "S"), ("Т", "T"), ("У", "Y"), ("Х", "X"), ("α", "a"), ("ε", "e"), ("ι", "i"),
    ("κ", "k"), ("ν", "v"), ("ο", "o"), ("ρ", "p"), ("τ", "t"), ("υ", "u"), ("χ", "x"), ("ϲ", "c"), ("Α", "A"), ("Β", "B"), ("Ε", "E"), ("Ζ", "Z"),
    ("Η", "H"), ("Ι", "I"), ("Κ", "K"), ("Μ", "M"), ("Ν", "N"), ("Ο", "O"), ("Ρ", "P"), ("Τ", "T"), ("Υ", "Y"), ("Χ", "X"), ("ı", "i"), ("ɡ", "g"),
    ("օ", "o"), ("ս", "u"), ("հ", "h"), ("ո", "n"), ("․", "."), ("。", "."), ("｡", "."), ("∙", "."), ("‗", "_"), ("−", "-"), ("⁃", "-"))
#: Characters without width.
NO_WIDTH = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"
ASKED_FOR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.@+-_%()[]{}<>#& ")


@functools.cache
def glyphs() -> dict[str, str]:
    """What each character that looks like an ASCII one stands for."""
    table = dict.fromkeys(NO_WIDTH, "") | dict(LOOK_ALIKES)
    for code in range(0x80, 0x20000):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Nd":
            table[c] = str(unicodedata.decimal(c))
        elif kind == "Pd":
            table[c] = "-"
        elif kind == "Zs":
            table[c] = " "
        elif unicodedata.decomposition(c).startswith(("<wide>", "<font>", "<small>")) and (plain := unicodedata.normalize("NFKC", c)) in ASKED_FOR:
            table[c] = plain
    return table


def homoglyphs(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    table = glyphs()
    here = table.keys() & set(text)
    return [(m.start(), m.end(), table[m.group()]) for m in re.finditer("[" + "".join(map(re.escape, sorted(here))) + "]", text)] if here else []


# Words for the two signs, in the languages of the digits below.
AT_WORDS = ("at", "ät", "arobase", "arroba", "klammeraffe")
DOT_WORDS = ("dot", "point", "punkt", "punto", "period")
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_DOTTED = rf"(?:\.|\s{{0,3}}{_OPEN}\s{{0,2}}(?:{_DOT}|\.)\s{{0,2}}{_SHUT}\s{{0,3}}|(?:\s{{1,3}}|[-_])(?:{_DOT})(?:\s{{1,3}}|[-_])|\s\.\s)"
_SPELLED = rf"(?:(?:\s{{1,3}}|[-_])(?:{_DOT})(?:\s{{1,3}}|[-_])|\s{{0,3}}{_OPEN}\s{{0,2}}(?:{_DOT}|\.)\s{{0,2}}{_SHUT}\s{{0,3}})"
_LABEL = r"[A-Za-z0-9]++(?:-(?!dot-|at-)[A-Za-z0-9]++)*+"
_ENTITY = re.compile(r"&(?:#0{0,5}64|#[xX]0{0,5}40|commat);|%40|&(?:#0{0,5}46|#[xX]0{0,5}2[eE]|period);")
_BRACKET_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])\s{{0,3}}{_OPEN}\s{{0,2}}(?:{_AT}|a|@)\s{{0,2}}{_SHUT}\s{{0,3}}(?={_LABEL}{_DOTTED}[A-Za-z0-9])", re.IGNORECASE)
_BRACKET_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s{{0,3}}{_OPEN}\s{{0,2}}(?:{_DOT}|\.)\s{{0,2}}{_SHUT}\s{{0,3}}(?=[A-Za-z0-9])", re.IGNORECASE)
# Words that no host's name begins with after a bare "at".
ARTICLES = ("the", "a", "an", "this", "that", "each", "every", "any", "le", "la", "les", "un", "une", "der", "die", "das", "dem", "den", "el", "los", "las")
_NOT_HOST = rf"(?!(?:{'|'.join(ARTICLES)})\b)"
# Bare words: "at" counts where the domain has a spelled dot, or where the name before it looks like one of an address.
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:\s{{1,3}}|[-_])(?:{_AT})(?:\s{{1,3}}|[-_])(?={_NOT_HOST}{_LABEL}(?:\.{_LABEL})*+{_SPELLED}[A-Za-z])", re.IGNORECASE)
_NAMED_AT = re.compile(rf"(?<=[A-Za-z0-9])\s{{1,3}}(?:{_AT})\s{{1,3}}(?={_LABEL}\.[A-Za-z])", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9%+-]*[._+][A-Za-z0-9._%+-]*[A-Za-z0-9]\Z")
_SPACED_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:\s{{1,3}}@\s{{0,3}}|@\s{{1,3}})(?={_LABEL}{_DOTTED}[A-Za-z])", re.IGNORECASE)
_BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:(?:\s{{1,3}}|[-_])(?:{_DOT})(?:\s{{1,3}}|[-_])|\s\.\s)(?=[A-Za-z0-9])", re.IGNORECASE)
#: Characters before a bare "at" in which its name is looked for; names of addresses have at most 64.
NAME_SIZE = 64


def words_of(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]+", text.lower()))


def entities(text: str) -> list[tuple[int, int, str]]:
    if "&" not in text and "%" not in text:
        return []
    return [(m.start(), m.end(), "@" if m.group() in ("%40", "&commat;") or m.group().lower().rstrip(";").endswith(("64", "x40", "040")) else ".")
            for m in _ENTITY.finditer(text)]


def at_dot(text: str) -> list[tuple[int, int, str]]:
    """Signs for their spelled and bracketed forms. Bare dots count only after a sign or word for ``@``, label by label, and in the name before it."""
    words = words_of(text)
    brackets, at_words, dot_words = any(c in text for c in "[({<"), not words.isdisjoint(AT_WORDS), not words.isdisjoint(DOT_WORDS)
    found = {m.start(): (m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(text)} if brackets else {}
    ats = []
    for pattern, possible in ((_BRACKET_AT, brackets), (_BARE_AT, at_words and (dot_words or brackets)), (_NAMED_AT, at_words), (_SPACED_AT, "@" in text)):
        for m in pattern.finditer(text) if possible else ():
            name = _NAME.search(text, max(0, m.start() - NAME_SIZE), m.start()) if pattern is _NAMED_AT else None
            if pattern is not _NAMED_AT or name and re.search("[A-Za-z]", name.group()):
                found[m.start()] = (m.start(), m.end(), "@")
                ats.append(m.span())
    if dot_words and "@" in text:
        ats += [m.span() for m in _PLAIN_AT.finditer(text)]
    for start, end in ats:
        at = end
        while label := _LABEL_AT.match(text, at):
            at = label.end()
            if dot := _BARE_DOT.match(text, at):
                found[at] = (at, dot.end(), ".")
                at = dot.end()
            elif bracket := _BRACKET_DOT.match(text, at):
                at = bracket.end()
            elif text.startswith(".", at):
                at += 1
            else:
                break
        # "john dot doe at ...": the words of the name, from the right.
        at = start
        while m := _NAME_DOT.search(text, max(0, at - NAME_SIZE), at):
            found[m.start(1)] = (m.start(1), m.end(1), ".")
            at = m.start(1)
    out, last = [], 0
    for start, end, sign in sorted(found.values()):
        if start >= last:
            out.append((start, end, sign))
            last = end
    return out


_PLAIN_AT = re.compile(r"(?<=[A-Za-z0-9])@(?=[A-Za-z0-9])")
_LABEL_AT = re.compile(_LABEL, re.IGNORECASE)
_NAME_DOT = re.compile(rf"(?<=[A-Za-z0-9])((?:\s{{1,3}}|[-_])(?:{_DOT})(?:\s{{1,3}}|[-_]))[A-Za-z0-9]+\Z", re.IGNORECASE)


# The digits' names in English, German, French and Spanish.
DIGIT_WORDS = (
    ("zero", "0"), ("oh", "0"), ("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5"), ("six", "6"), ("seven", "7"), ("eight", "8"), ("nine", "9"),
    ("null", "0"), ("eins", "1"), ("zwei", "2"), ("zwo", "2"), ("drei", "3"), ("vier", "4"), ("fünf", "5"), ("fuenf", "5"), ("sechs", "6"), ("sieben", "7"), ("acht", "8"), ("neun", "9"),
    ("zéro", "0"), ("un", "1"), ("deux", "2"), ("trois", "3"), ("quatre", "4"), ("cinq", "5"), ("sept", "7"), ("huit", "8"), ("neuf", "9"),
    ("cero", "0"), ("uno", "1"), ("dos", "2"), ("tres", "3"), ("cuatro", "4"), ("cinco", "5"), ("seis", "6"), ("siete", "7"), ("ocho", "8"), ("nueve", "9"))
_DIGIT = dict(DIGIT_WORDS)
_TIMES = {"double": 2, "triple": 3}
_NAMES = "|".join(sorted(_DIGIT, key=lambda w: (-len(w), w)))
_UNIT = rf"(?:(?:(?:double|triple)[\s-]{{1,2}})?(?:{_NAMES})(?![^\W_])|[0-9]++(?![^\W_]))"
_BETWEEN = rf"(?:[\s,;()-]{{1,3}}(?:(?:{_DOT})[\s,;-]{{1,3}})?|\.)"
_CHAIN = re.compile(rf"(?<![^\W_])(?:(?:plus[\s-]{{1,2}}|\+\s?)(?={_UNIT}))?{_UNIT}(?:{_BETWEEN}{_UNIT})++", re.IGNORECASE)
_PIECE = re.compile(rf"(?P<plus>plus)|(?P<times>double|triple)|(?P<name>{_NAMES})(?![^\W_])|(?P<number>[0-9]+)|(?P<dot>{_DOT}|\.)|(?P<sign>\+)", re.IGNORECASE)
_NAMED = re.compile(rf"(?<![^\W_])(?:{_NAMES})(?![^\W_])", re.IGNORECASE)
#: Spelled digits in a chain below which it is left alone.
LEAST_SPELLED = 3
# Letters that stand for digits.
_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1", "S": "5", "B": "8"}
_GROUP = r"[0-9OoIlSB|]"
_MIXED = re.compile(rf"(?<![A-Za-z0-9|])\+?(?={_GROUP}*?[0-9]){_GROUP}++(?![A-Za-z0-9|])(?:[\x20.()-]{{1,2}}{_GROUP}++(?![A-Za-z0-9|]))*+")


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    out = []
    if words_of(text).isdisjoint(_DIGIT):
        return out
    for m in _CHAIN.finditer(text):
        if len(_NAMED.findall(m.group())) >= LEAST_SPELLED:
            new, times = [], 1
            for p in _PIECE.finditer(m.group()):
                word = p.group().lower()
                if p.lastgroup == "times":
                    times = _TIMES[word]
                else:
                    new.append({"plus": "+", "sign": "+", "dot": "."}.get(p.lastgroup) or _DIGIT.get(word, word) * times)
                    times = 1
            out.append((m.start(), m.end(), "".join(new)))
    return out


def letter_digits(text: str) -> list[tuple[int, int, str]]:
    """Letters inside groups that hold digits, in numbers of which at least seven tenths are digits."""
    out = []
    for m in _MIXED.finditer(text):
        number = m.group()
        digits = _count(number, 0, len(number))
        letters = [(i, c) for i, c in enumerate(number) if c in _LETTERS]
        if letters and digits >= 4 and 7 * len(letters) <= 3 * digits and all(any(c.isdigit() for c in g) for g in re.split(r"[^0-9A-Za-z|]+", number) if g):
            out += [(m.start() + i, m.start() + i + 1, _LETTERS[c]) for i, c in letters]
    return out


TRANSDUCERS: tuple[Callable[[str], list[tuple[int, int, str]]], ...] = (homoglyphs, entities, at_dot, spelled_digits, letter_digits)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    plain: bool


def find(text: str) -> list[Span]:
    """All spans by kind, then start; places are code points of ``text``, the end is exclusive."""
    plain = {kind: list(detect(text)) if NEEDS[kind] in text else [] for kind, detect in DETECTORS.items()}
    steps, now = [], text
    for transducer in TRANSDUCERS:
        if edits := transducer(now):
            steps.append(rewritten(now, edits))
            now = steps[-1].text
    out = []
    for kind, detect in DETECTORS.items():
        spans = {s: True for s in plain[kind]}
        for start, end in detect(now) if steps and NEEDS[kind] in now else ():
            for step in reversed(steps):
                start, end = step.source(start, end)
            i = bisect_right(plain[kind], (start, len(text) + 1)) - 1
            if i < 0 or end > plain[kind][i][1]:    # not inside a plain one
                spans.setdefault((start, end), False)
        out += [Span(kind, *s, is_plain) for s, is_plain in sorted(spans.items())]
    return out


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: __id and found, an array of (kind, start, end, plain)."""
    rows = pick(docs, __id=doc_id, text=text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [[s._asdict() for s in find(t)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(found, kind)], ["__id", "found"])

    return rows.mapInArrow(run, f"__id {dict(rows.dtypes)['__id']}, found array<struct<kind: string, start: long, end: long, plain: boolean>>")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span (joined where they overlap) replaced by its kind in brackets."""
    edits: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if edits and s.start < edits[-1][1]:
            edits[-1] = (edits[-1][0], max(edits[-1][1], s.end), edits[-1][2])
        else:
            edits.append((s.start, s.end, f"[{s.kind}]"))
    return rewritten(text, edits).text


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(written_out(spans).encode()).hexdigest()
