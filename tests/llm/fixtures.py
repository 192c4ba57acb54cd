"""Small tables with the awkward rows: nulls, empty and long texts, ties, repeats, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "co", "di", "fu", "gé", "ha", "jo"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def awkward() -> list[tuple]:
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [(1, base, "en", "a"), (2, near, "en", "a"), (3, base.replace(" ", "\n"), "de", "b"), (4, base.replace(" ", "  ") + " ", None, "b"),
            (5, None, None, None), (6, "", "en", "a"), (7, " \t\n\x0b\x0c\r", "en", None), (None, prose(2, 80), "fr", "c"), (None, prose(3, 90), "xx", None),
            (8, "one", "en", "c"), (9, "one", "en", "c"), (9, "one", "en", "c"), (10, "two Words", "en", "c"), (10, "TWO words", "en", "c"),
            (11, prose(4, 6000), "es", "a"), (12, "x" * 5000, "en", "b"), (13, "<|endoftext|> a 'S  b c 　 d\x1c e\n\n f ", "en", "b"),
            (14, prose(5, 200), "en", "a"), (15, prose(5, 200), "en", "a"), (15, prose(5, 200), "en", "a"), (16, "ba\nba\nba\n\n" + prose(6, 30), "en", "a")]
    return [(*r, None if r[0] == 3 else 1) for r in rows]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def clashing(spark):
    """The same rows with columns that operators might also use, one of which differs from ``text`` only in case."""
    extra = ["kept", "size", "__id", "digest", "Text", "key", "shard"]
    rows = [(*r, *["other"] * len(extra)) for r in awkward()]
    plain = [f"c{i}" for i in range(5 + len(extra))]
    kinds = [x.split(" ")[1] for x in SCHEMA.split(", ")] + ["string"] * len(extra)
    df = spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(plain, kinds, strict=True)))
    return df.toDF("doc_id", "text", "lang", "source", "n_chars", *extra)
