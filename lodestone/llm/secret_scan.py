r"""Secret scans by a trigram index.

A Boolean query over trigrams is derived from each rule's regular expression: a text that
the rule matches must satisfy it. Every block of documents gets an inverted index of the
trigrams that the queries name (postings are bit sets over the block); the queries are
answered by intersecting and uniting postings, and only the documents left are searched
with the rule itself. A rule without a mandatory trigram scans every document.

Defined results: a null text is an empty text and has no spans. Matches are leftmost and
do not overlap within a kind; kinds may overlap. Offsets are code points, ends exclusive.
Repeated rows are scanned each; an empty table gives no rows. Texts are scanned whole.
Only the columns named are read.
"""

from __future__ import annotations

import functools
import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices

BLOCK, CHUNK = 256, 1 << 20
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of a group (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules.
BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Rules that the scan adds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^/\s:@]{1,100}:[^/\s:@]{1,100}@"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: True (any text), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple


def _both(op: str, parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if op == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """Any of the strings occurs, case apart; one under three bytes tells nothing."""
    raw = [s.encode("utf-8").lower() for s in sorted(strings)]
    return _both("or", [_both("and", [r[i : i + 3] for i in range(len(r) - 2)]) for r in raw])


class _Parts:
    """Derives a query while reading a pattern from left to right.

    ``run`` is the set of strings that the part since the last gap can be; at a gap, what
    the run says becomes a condition and the next run begins.
    """

    def __init__(self) -> None:
        self.run: set[str] = {""}
        self.conditions: list[Query] = []

    def gap(self, *conditions: Query) -> None:
        self.conditions += [_of_strings(self.run), *conditions]
        self.run = {""}

    def add(self, strings: set[str]) -> None:
        joined = {a + b for a in self.run for b in strings}
        if len(joined) > MOST_STRINGS:
            self.gap()
            joined = set(strings)
        self.run = joined

    def query(self) -> Query:
        return _both("and", [*self.conditions, _of_strings(self.run)])


def _strings(items: list) -> set[str] | None:
    """All strings that a small pattern can match, or None."""
    parts = _Parts()
    _read(items, parts)
    return parts.run if not parts.conditions else None


def _read(items: list, parts: _Parts) -> None:
    for op, arg in items:
        if op is sre.LITERAL:
            parts.add({chr(arg)})
        elif op is sre.IN:
            chars = {chr(c) for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], min(a[1], a[0] + 9) + 1) if o is sre.RANGE else range(99))}
            parts.add(chars) if len(chars) <= 8 else parts.gap()
        elif op is sre.SUBPATTERN:
            _read(list(arg[3]), parts)
        elif op is sre.BRANCH:
            sets = [_strings(list(b)) for b in arg[1]]
            if None not in sets and len(every := set().union(*sets)) <= MOST_STRINGS:
                parts.add(every)
            else:
                parts.gap(_both("or", [derive(list(b)) for b in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = arg
            strings = _strings(list(inner))
            if strings is not None and len(strings) <= 8 and most == 1:
                parts.add(strings | {""} if least == 0 else strings)
            elif strings is not None and len(strings) == 1 and 0 < least <= 16:
                parts.add({next(iter(strings)) * int(least)})
                parts.gap() if most > least else None
            else:
                parts.gap(*([derive(list(inner))] if least else []))
        elif op is sre.AT:
            continue
        else:  # any character, negated sets, references, look-around: nothing is known
            parts.gap()


def derive(pattern: str | list) -> Query:
    """The Boolean trigram query of a pattern, over text with A-Z in lower case."""
    parts = _Parts()
    _read(list(sre_parse.parse(pattern)) if isinstance(pattern, str) else pattern, parts)
    return parts.query()


def trigrams(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(trigrams, query[1])) if isinstance(query, tuple) else set()


def answer(query: Query, postings: dict[bytes, int], every: int) -> int:
    """The documents, as a bit set, that satisfy the query."""
    if query is True:
        return every
    if isinstance(query, bytes):
        return postings.get(query, 0)
    out = every if query[0] == "and" else 0
    for q in query[1]:
        got = answer(q, postings, every)
        out = out & got if query[0] == "and" else out | got
    return out


@functools.lru_cache(maxsize=4)
def _table(wanted: frozenset[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the 2^24 trigrams are wanted, and the wanted ones' codes in order."""
    codes = np.array(sorted(int.from_bytes(t, "big") for t in wanted), np.uint32)
    named = np.zeros(1 << 24, bool)
    named[codes] = True
    return named, codes


def index(raws: list[bytes], wanted: set[bytes]) -> dict[bytes, int]:
    """Postings of the wanted trigrams over a block of lower-cased texts: each text's trigrams in one pass over its bytes."""
    named, codes = _table(frozenset(wanted))
    postings = dict.fromkeys(wanted, 0)
    whole = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    for at in range(0, max(0, len(whole) - 2), CHUNK):
        part = whole[at : at + CHUNK + 2].astype(np.uint32)
        code = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        hit = np.flatnonzero(named[code])
        text = np.searchsorted(ends, hit + at, "right")
        inside = hit + at + 2 < ends[text]
        pairs = np.unique((np.searchsorted(codes, code[hit[inside]]).astype(np.int64) << 32) | text[inside])
        for k, i in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
            postings[int(codes[k]).to_bytes(3, "big")] |= 1 << i
    return postings


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(i, r, re.compile(r.pattern), derive(r.pattern)) for i, r in enumerate(rules)]
        self.wanted = set().union(*(trigrams(q) for *_, q in self.rules))

    def block(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each text's secrets, in order."""
        postings = index([t.encode("utf-8", "surrogatepass").lower() for t in texts], self.wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, rule, pattern, query in self.rules:
            left = answer(query, postings, (1 << len(texts)) - 1)
            while left:
                at = (left & -left).bit_length() - 1
                left &= left - 1
                found[at] += [(m.start(), i, m.end()) for m in pattern.finditer(texts[at]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [sorted(f) for f in found]


def _scanning(rules: tuple[Rule, ...], out: Callable[[list[str], list], list[pa.Array]], names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in slices(batches, BLOCK):
            column = b.column(b.num_columns - 1)
            texts = [t or "" for t in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out(texts, scanner.block(texts), column)], [*b.schema.names[:-1], *names])

    return run


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (array of kind, start, end by start, then kind as listed) for every row."""
    kinds = [r.kind for r in rules]
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def spans(texts: list[str], found: list, _: pa.Array) -> list[pa.Array]:
        return [pa.array([[{"kind": kinds[k], "start": s, "end": e} for s, k, e in f] for f in found], pa.list_(item))]

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_scanning(rules, spans, ["spans"]), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """The rows with each secret replaced by its kind in angle brackets; of overlapping ones the first by start.

    Null texts stay null; the columns and their order stay.
    """
    kinds = [r.kind for r in rules]

    def clean(texts: list[str], found: list, column: pa.Array) -> list[pa.Array]:
        out = []
        for t, f, old in zip(texts, found, column, strict=True):
            pieces, at = [], 0
            for s, k, e in f:
                if s >= at:
                    pieces += [t[at:s], f"<{kinds[k]}>"]
                    at = e
                elif e > at:  # what an overlapping secret has beyond the first
                    at = e
            out.append("".join([*pieces, t[at:]]) if old.is_valid else None)
        return [pa.array(out, pa.string())]

    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).cast("string").alias(text_col))
    return src.mapInArrow(_scanning(rules, clean, [text_col]), src.schema).select(*[F.col(f"`{c}`") for c in docs.columns])
