"""Quality rules by tokeniser fertility, with plain counts as a base.

A public SentencePiece vocabulary with byte fallback is held against each text: characters per token, the share of tokens
that are single fallback bytes, and the entropy of the token distribution in bits. Each language (or, where the language has
no band of its own, or the text is not in its script, the script that most letters belong to) has a band for the three; a text
outside is rejected. A label that is no known language says nothing. Short
texts are not judged by entropy, which a few tokens cannot reach.

The base counts are exact and of the whole text. A null or empty text has no words and fails. Each row is judged alone, so
ties and repeated rows do not matter. The language column may be null or missing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import tokens
from tidewatch.llm.common import pick, small_batches, texts

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of words
ENTROPY_TOKENS = 64


class Band(NamedTuple):
    least_chars_per_token: float
    most_chars_per_token: float
    most_byte_share: float
    least_entropy: float
    most_entropy: float


#: Languages first, then scripts. Entropy is in bits per token and has a floor only for texts of ENTROPY_TOKENS tokens.
#: The bands follow the spread of the three over all documents of sf0.1 that pass the base counts (characters per token from the
#: 0.1 % quantile to the largest: en 1.79 to 3.53, de 1.40 to 2.60, fr 1.60 to 2.54, es 1.56 to 2.42; no fallback bytes) and over
#: common prose (en 4.1, de, fr, es, it 2.6 to 2.7, ru, uk 2.1, vi 1.1, zh, ja, ko 0.7 to 0.8; bytes at most 0.19, am 0.84).
#: Words of random letters have 1.44 to 1.74 characters per token (1.60 at most from 40 words on), consonants up to 1.53, base64 1.27,
#: punctuation 1.42 and random Cyrillic 1.12; the floors of these scripts lie between them and prose.
LANGUAGES = {
    "en": Band(1.75, 6.0, 0.05, 4.0, 11.0),
    "de": Band(1.75, 5.0, 0.05, 4.0, 11.0),
    "fr": Band(1.65, 5.0, 0.05, 4.0, 11.0),
    "es": Band(1.59, 5.0, 0.05, 4.0, 11.0),
}
SCRIPTS = {
    "latin": Band(1.65, 6.0, 0.10, 4.0, 11.5),
    "accented": Band(0.90, 5.0, 0.20, 3.5, 11.5),
    "greek": Band(0.6, 4.0, 0.15, 3.0, 11.5),
    "cyrillic": Band(1.2, 5.0, 0.10, 3.5, 11.5),
    "han": Band(0.4, 3.0, 0.50, 3.5, 12.0),
    "other": Band(0.3, 5.0, 0.90, 3.0, 12.0),
}
LATIN = ("latin", "accented")  # the scripts that the languages above are written in
ACCENTED = 10  # per cent of a text's Latin letters, from which on it is written in syllables of its own (Vietnamese, Yoruba)
# First code points of Unicode ranges, with the script of what follows.
SCRIPT_STARTS = ((0x00, "other"), (0x41, "latin"), (0x5B, "other"), (0x61, "latin"), (0x7B, "other"), (0xC0, "latin"), (0x250, "other"),
                 (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
                 (0x3040, "han"), (0xA000, "other"), (0xAC00, "han"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"))
_STARTS = np.array([s for s, _ in SCRIPT_STARTS], np.uint32)
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

#: Columns that the rules give, in order.
COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
           "chars_per_token double, byte_share double, token_entropy double, band string")


def script(text: str) -> str:
    """The script of most letters; Latin ones with many accents count as one of their own."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(np.searchsorted(_STARTS, points, "right") - 1, minlength=len(_STARTS))
    votes: Counter[str] = Counter()
    for (_, name), n in zip(SCRIPT_STARTS, counts.tolist(), strict=True):
        votes[name] += n if name != "other" else 0
    most = votes.most_common(1)[0][0] if votes.total() else "other"
    marks = int(((points >= 0xC0) & (points < 0x250) | (points >= 0x300) & (points < 0x370) | (points >= 0x1E00) & (points < 0x1F00)).sum())
    return "accented" if most == "latin" and 100 * marks >= ACCENTED * votes["latin"] else most


def repeated_words(words: tokens.Coded) -> np.ndarray:
    """Per text: its words inside windows of WINDOW words that it holds at least twice."""
    codes, offsets = words.codes, words.offsets
    texts = len(offsets) - 1
    n = len(codes) - WINDOW + 1
    if n < 2:
        return np.zeros(texts, np.int64)
    owner = np.repeat(np.arange(texts, dtype=np.uint64), np.diff(offsets))
    windows = owner[:n] * _FACTORS[0]
    for i in range(WINDOW):
        windows = (windows ^ (windows >> np.uint64(29))) * _FACTORS[i] + codes[i:i + n].astype(np.uint64)
    windows = (windows ^ (windows >> np.uint64(31))) * _FACTORS[0]
    starts = np.flatnonzero(owner[:n] == owner[WINDOW - 1:])  # windows inside one text
    starts = starts[np.argsort(windows[starts])]
    same = np.diff(windows[starts]) == 0
    hit = np.unique(np.concatenate([starts[1:][same], starts[:-1][same]]))
    edges = np.bincount(hit, minlength=len(codes) + 1) - np.bincount(hit + WINDOW, minlength=len(codes) + 1)[:len(codes) + 1]
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
    return np.diff(covered[offsets])


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(_SPACES)] if "\n" in text else []
    return len(lines) - len(set(lines))


def fertility(ids: np.ndarray, word_chars: int, byte_ids: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, share of fallback bytes, entropy in bits."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    counts = np.bincount(ids)
    fallback = int(counts[byte_ids[byte_ids < len(counts)]].sum())
    p = counts[counts > 0] / n
    return word_chars / n, fallback / n, float(-(p * np.log2(p)).sum())


def judge(texts: list[str], langs: list[str | None], pieces: tokens.PieceWords) -> list[tuple]:
    """A row of COLUMNS for each text."""
    words = tokens.words(texts)
    ids, ends = pieces.look_up(words.distinct).gather(words.codes)
    out = []
    for text, lang, first, last, repeated in zip(texts, langs, words.offsets[:-1].tolist(), words.offsets[1:].tolist(), repeated_words(words).tolist(), strict=True):
        n, word_chars = last - first, len(text) - sum(map(text.count, _SPACES))
        failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
        name = script(text)
        if lang in LANGUAGES and name in LATIN:
            name = lang
        band = LANGUAGES.get(name) or SCRIPTS[name]
        own = ids[ends[first]:ends[last]]
        chars, share, entropy = fertility(own, word_chars, pieces.byte_ids)
        inside = (band.least_chars_per_token <= chars <= band.most_chars_per_token and share <= band.most_byte_share and entropy <= band.most_entropy
                  and (len(own) < ENTROPY_TOKENS or entropy >= band.least_entropy))
        out.append((n, word_chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed, not failed and inside, chars, share, entropy, name))
    return out


def _columns(spec: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    return [(name, kinds[kind]) for name, kind in (x.split() for x in spec.split(", "))]


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id and COLUMNS. A scan without a shuffle."""
    path = vocabulary or tokens.vocabulary_path(VOCABULARY)
    has_lang = lang in docs.columns
    rows = pick(docs, doc_id=doc_id, text=text, **({"lang": lang} if has_lang else {}))
    fields = _columns(COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tokens.piece_words(path)
        for batch in small_batches(batches):
            langs = batch.column("lang").to_pylist() if has_lang else [None] * batch.num_rows
            out = judge(texts(batch), langs, pieces)
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *(name for name, _ in fields)])
        del pieces
        tokens.forget()

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {COLUMNS}")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str | None = None) -> DataFrame:
    """The documents that the rules keep, all columns unchanged. A scan without a shuffle."""
    path = vocabulary or tokens.vocabulary_path(VOCABULARY)
    names = docs.columns
    inner = [f"__c{i}" for i in range(len(names))]
    body = docs.toDF(*inner)
    t, lang_at = inner[names.index(text)], inner[names.index(lang)] if lang in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tokens.piece_words(path)
        for batch in small_batches(batches, t):
            langs = batch.column(lang_at).to_pylist() if lang_at else [None] * batch.num_rows
            keep = [row[6] for row in judge(texts(batch, t), langs, pieces)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        del pieces
        tokens.forget()

    return body.mapInArrow(run, body.schema).select(*map(F.col, inner)).toDF(*names)
