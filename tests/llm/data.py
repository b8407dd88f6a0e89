"""Tables with the odd cases, and columns whose names clash with those used inside."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, n int, node string, tkey string, part int, key string"
WORDS = "the of and with letter copy small number river stone under light every other house garden winter summer green seven forty people".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing", str(rng.randrange(50))]) for _ in range(n))


def near(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
    return " ".join(words)


def texts(seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(30, 200)) for _ in range(25)]
    out: list[str | None] = [None, "", " \n\t ", "one", "one two", "one two", "Ünïcode wörds 東京 and é́ 😀 here", "x" * 3000, "12 34 !!", sentence(rng, 9000)]
    out += base
    for b in base[:8]:
        out += [b, b.upper(), near(rng, b, 1), near(rng, b, 3)]
    shared = sentence(rng, 70)
    out += [sentence(rng, 60) + "\n" + shared + "\n" + sentence(rng, 50) for _ in range(6)]
    out += [base[0] + " " + base[1], "line\n" * 40]
    return out


def documents(spark, rows=None, partitions: int = 3):
    if rows is None:
        rows = [(i, t, [None, "en", "de"][i % 3], [None, "", "a", "b", "a"][i % 5]) for i, t in enumerate(texts())]
        rows += [rows[12], (None, "a null id with some words in it", "en", "a"), (None, None, None, None)]
    full = [(i, t, lang, source, None, 7, "s", 1, "x", "k", 0, None) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
