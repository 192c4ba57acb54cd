"""Public tokenizers in tasks: token ids of whole texts, with a bounded cache of units that repeat."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
import json
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units kept per task; later ones are encoded each time (about 150 bytes a unit).
CACHE_UNITS = 400_000
#: Units longer than this go to the tokenizers library, whose merge does not slow down with length.
LONG_UNIT = 2_000

_UNIT = re.compile(r" (?=\S)")
_IRREGULAR = re.compile(r" (?:\s|\Z)")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Coded(NamedTuple):
    """Units of a batch of texts as codes of distinct units; unit i of text t is ``distinct[codes[offsets[t] + i]]``."""

    codes: np.ndarray
    offsets: np.ndarray
    distinct: list[str]


def coded(parts: pa.Array) -> Coded:
    """Of an Arrow array of lists of strings."""
    flat = parts.flatten().dictionary_encode()
    lengths = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return Coded(flat.indices.to_numpy(), np.concatenate([[0], np.cumsum(lengths)]), flat.dictionary.to_pylist())


def words(texts: list[str]) -> Coded:
    """Runs of other characters than space and the control characters 9 to 13."""
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    found = coded(parts)
    if "" not in found.distinct:
        return found
    keep = found.codes != found.distinct.index("")
    return Coded(found.codes[keep], np.concatenate([[0], np.cumsum(keep)])[found.offsets], found.distinct)


class Ragged(NamedTuple):
    """Token ids of units: unit i has ``ids[starts[i]:starts[i + 1]]``."""

    ids: np.ndarray
    starts: np.ndarray

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these units in a row, and where each begins (one more entry than units)."""
        n = np.diff(self.starts)[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.arange(ends[-1]) + np.repeat(self.starts[codes] - ends[:-1], n)], ends


class Units(dict):
    """Ids, as bytes, of units of text. The first CACHE_UNITS that come along are remembered."""

    kind = "<u4"

    def encode_all(self, units: list[str]) -> list[bytes]:
        raise NotImplementedError

    def look_up(self, units: list[str]) -> Ragged:
        found = list(map(self.get, units))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, self.encode_all([units[i] for i in new]), strict=True):
            found[i] = ids
        if len(self) < CACHE_UNITS:
            self.update((units[i], found[i]) for i in new if len(units[i]) <= 64)
        width = np.dtype(self.kind).itemsize
        return Ragged(np.frombuffer(b"".join(found), self.kind), np.concatenate([[0], np.cumsum(list(map(len, found)), dtype=np.int64) // width]))


def slices(data: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The pieces of an array that end at ``ends``, as bytes."""
    raw, width = data.tobytes(), data.itemsize
    cuts = [0, *(ends * width).tolist()]
    return [raw[a:b] for a, b in itertools.pairwise(cuts)]


class ByteBpe(Units):
    """Ids of a byte-level BPE vocabulary file (JSON) as little-endian 32-bit bytes; special tokens in a text are ordinary text.

    A text is cut before each space that a visible character follows. The vocabulary's pattern always starts a token there,
    so the ids of a text are those of its units in a row, and units repeat. Each distinct unit of a batch is encoded once:
    short ones by tiktoken with the file's own vocabulary, four times as fast as the tokenizers library and with the same
    ids (tested against it), long ones and texts with other runs of spaces by the tokenizers library. The dict knows units
    that follow a space, without that space.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        super().__init__()
        self.path = path
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = byte_of_char()
        special = {i for token, i in vocab.items() if token.startswith("<|") and token.endswith("|>")}
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if i not in special}
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        self.quick = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def slow(self):
        """The tokenizers library's form of the vocabulary, read when a long unit needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def unit(self, text: str) -> bytes:
        ids = self.slow.encode(text, add_special_tokens=False).ids if len(text) > LONG_UNIT else self.quick.encode_ordinary(text)
        return np.asarray(ids, self.kind).tobytes()

    def encode_all(self, units: list[str]) -> list[bytes]:
        """Short units are one text to the encoder: a token never crosses the space before a unit."""
        short = [u for u in units if len(u) < LONG_UNIT]
        out: list[bytes] = []
        for start in range(0, len(short), 10_000):
            text = " " + " ".join(short[start:start + 10_000])
            ids = np.asarray(self.quick.encode_ordinary(text), self.kind)
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
            out.extend(slices(ids, np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1))
        if len(short) == len(units):
            return out
        made = iter(out)
        return [next(made) if len(u) < LONG_UNIT else self.unit(" " + u) for u in units]

    def ids(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if _IRREGULAR.search(t):
                first, *rest = _UNIT.split(t)
                out[i] = self.unit(first) + b"".join(self.unit(" " + u) for u in rest)
            elif t:
                plain.append(i)
        if plain:
            found = coded(pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " "))
            ids, ends = self.look_up(found.distinct).gather(found.codes)
            raw, first = ids.tobytes(), ends[found.offsets[:-1] + 1].tolist()
            for i, start, stop in zip(plain, first, ends[found.offsets[1:]].tolist(), strict=True):
                head = texts[i].split(" ", 1)[0]  # follows no space
                out[i] = (self.unit(head) if head else b"") + raw[4 * start:4 * stop]
        return out


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    """One per Python worker, until ``forget``."""
    return ByteBpe(path)


class PieceWords(Units):
    """Ids of single words in a SentencePiece vocabulary of at most 65,536 pieces, as little-endian 16-bit bytes.

    Words of more than LONG_UNIT characters are encoded in parts of that length, so that memory stays bounded.
    """

    kind = "<u2"

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids = np.array([i for i in range(self.model.vocab_size()) if self.model.IsByte(i)], np.int64)

    def encode_all(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for start in range(0, len(units), 10_000):
            part = units[start:start + 10_000]
            ids = self.model.encode([u[:LONG_UNIT] for u in part], num_threads=1)
            for i, u in enumerate(part):
                for at in range(LONG_UNIT, len(u), LONG_UNIT):
                    ids[i] = ids[i] + self.model.encode(u[at:at + LONG_UNIT])
            ends = np.cumsum(list(map(len, ids)), dtype=np.int64)
            out.extend(slices(np.fromiter(itertools.chain.from_iterable(ids), self.kind, int(ends[-1])), ends))
        return out


@functools.cache
def piece_words(path: str) -> PieceWords:
    """One per Python worker, until ``forget``."""
    return PieceWords(path)


def forget() -> None:
    """At the end of a task: workers are used again for other stages, which should find their memory free. A vocabulary is read
    again by the next task that needs it."""
    byte_bpe.cache_clear()
    piece_words.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):    # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)
