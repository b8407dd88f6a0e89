r"""License scans: fuzzy search for short notices.

Texts are normalized to lower-cased words joined by single blanks. Base phrases are found
exactly. A notice may have k edits: it is split into k + 1 pieces, one of which must then
occur unchanged (pigeonhole). Occurrences of pieces give the candidate windows, and
bounded-error matching by the regex library verifies each, counts its edits and gives its
span.

Defined results: a null text is an empty text, with no words, labels or places and score
0. Repeated rows are scanned each; an empty table gives no rows. Texts are scanned whole.
Only the columns named are read.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices that the scan adds, with labels of their own.
NOTICES = (
    ("general public license", "gpl-like"),
    ("all rights reserved", "reserved-like"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("creative commons attribution", "cc-attribution"),
    ("released into the public domain", "public-domain"),
    ("this program is free software you can redistribute it", "free-software"),
    ("spdx license identifier", "spdx"),
)
#: One edit for so many characters of a notice.
PER_EDIT = 11

#: A-Z to lower case; what is outside a word to a blank. Words are 0-9, a-z and all beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass
class Notice:
    """A notice, its label, its edits, and its k + 1 pieces with their offsets."""

    text: str
    label: str
    edits: int
    pieces: list[tuple[int, bytes]]
    pattern: regex.Pattern


def compile_notice(text: str, label: str, per_edit: int = PER_EDIT) -> Notice:
    k = len(text) // per_edit
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    pieces = [(a, text[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
    return Notice(text, label, k, pieces, regex.compile(rf"(?b)(?:{regex.escape(text, special_only=True)}){{e<={k}}}"))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def _windows(joined: bytes, notice: Notice) -> list[tuple[int, int]]:
    """Merged byte ranges in which the notice may stand."""
    found = set()
    for offset, piece in notice.pieces:
        at = joined.find(piece)
        while at >= 0:
            found.add((max(0, at - offset - 4 * notice.edits), at - offset + len(notice.text) + 4 * notice.edits))
            at = joined.find(piece, at + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _places(part: str, notice: Notice) -> list[regex.Match]:
    """Matches that don't overlap, in order: the best one of the whole, and those of the parts before and behind it."""
    found, parts = [], [(0, len(part))]
    while parts:
        a, b = parts.pop()
        m = notice.pattern.search(part, a, b) if b - a >= len(notice.text) - notice.edits else None
        if m:
            found.append(m)
            parts += [(a, m.start()), (m.end(), b)]
    return sorted(found, key=lambda m: m.start())


def search(joined: bytes, notice: Notice) -> Iterator[tuple[int, int, int]]:
    """(start, end, edits) in ``joined`` of the notice's verified places, in bytes."""
    for a, b in _windows(joined, notice):
        part = joined[a:b].decode("utf-8", "ignore")
        head = a + len(joined[a:b]) - len(joined[a:b].lstrip(bytes(range(128, 192))))
        for m in _places(part, notice):
            yield head + len(part[: m.start()].encode()), head + len(part[: m.end()].encode()), sum(m.fuzzy_counts)


def scan(text: str, base: tuple[tuple[str, str], ...], notices: list[Notice]) -> dict:
    ws = words(text)
    joined = b" " + b" ".join(ws) + b" "
    ends = list(itertools.accumulate(len(w) + 1 for w in ws))  # where each word's blank stands
    starts, base_labels = [], set()
    for phrase, label in base:
        needle = b" " + phrase.encode() + b" "
        at = joined.find(needle)
        while at >= 0:
            starts.append(bisect.bisect_left(ends, at + 1))
            base_labels.add(label)
            at = joined.find(needle, at + 1)
    hits, score = [], 1.0 if starts else 0.0
    for n in notices:
        for s, e, edits in search(joined, n):
            last = bisect.bisect_left(ends, max(e - 1, 1))
            hits.append({"label": n.label, "first_word": bisect.bisect_left(ends, s + (joined[s : s + 1] == b" ")), "last_word": last, "edits": edits})
            score = max(score, 1 - edits / len(n.text))
    return {
        "n_words": len(ws), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": sorted(base_labels), "labels": sorted(base_labels | {h["label"] for h in hits}), "score": score, "notices": hits,
    }


_ROW = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
    ("notices", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())]))),
])


def scan_licenses(
    docs: DataFrame, *, base: tuple[tuple[str, str], ...] = BASE, notices: tuple[tuple[str, str], ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices (label, word span, edits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [compile_notice(*n) for n in notices]
        for b in slices(batches, 500):
            rows = pa.array([scan(t or "", base, compiled) for t in b.column(1).to_pylist()], _ROW)
            yield pa.RecordBatch.from_arrays([b.column(0), *rows.flatten()], ["id", *(f.name for f in _ROW)])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    item = "struct<label:string,first_word:bigint,last_word:bigint,edits:bigint>"
    return src.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, notices array<{item}>")
