"""Packing documents into windows of tokens.

A document's ids are cut into full windows and one rest. The histogram of the lengths
(at most one bin per length, whatever the corpus) goes to the driver, which enumerates
shallow combinations of lengths that fill a window, solves for their repeat counts by
non-negative least squares, rounds them down to what the histogram holds, and packs what
is left greedily. The resulting slots are keyed by (length, rank within that length); the
pieces get their ranks from a distributed sort by (length, id, start).

Defined results: a null or empty text is the closing id alone. A null id is an id like
any other. Repeated rows are packed each. An empty table gives no rows. Texts are
tokenized whole. Only the columns named are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm.batches import slices
from lodestone.session import cut, stored

CACHE = 300_000
#: How the vocabulary's tokenizer cuts lower-cased text into words.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Byte-level vocabularies write bytes that have no visible character as those from U+0100 on, in order.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_tokenizers: dict[str, tuple] = {}


class _Encoder:
    """Ids of whole texts as little-endian bytes.

    The tokenizer drops white space and never merges across it, so that a text's ids are
    those of its blank-separated chunks in turn. Chunks repeat; their ids are kept in two
    generations of a bounded size. A chunk of Latin-1 characters is in normal form but for
    its case, so its words go to the tokenizer's model at once; any other goes through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old, self.pieces = Tokenizer.from_file(path), {}, {}, {}
        self.model = self.tokenizer.model

    def chunk(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if raw.isascii() or max(text) < "\u0100":
            if "<|" not in text:
                low, get = text.lower(), self.pieces.get
                if low.isalpha():
                    return get(low) or self.piece(low)
                if low[:-1].isalpha() and low[-1] in ".,;:!?|":
                    return (get(low[:-1]) or self.piece(low[:-1])) + (get(low[-1]) or self.piece(low[-1]))
                return b"".join([get(p) or self.piece(p) for p in _PIECES.findall(low)])
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))
        ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if len(self.pieces) > CACHE:
            self.pieces = {}
        self.pieces[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        raw = text.encode("utf-8", "replace")
        # case matters to special tokens, and to characters that combine with a letter
        chunks = (raw if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split()
        young, old = self.young, self.old
        for c in set(chunks).difference(young):
            young[c] = old[c] if c in old else self.chunk(c)
        out = b"".join(map(young.__getitem__, chunks))
        if len(young) > CACHE:
            self.young, self.old = {}, young
        return out


def _encoder(path: str) -> _Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = _Encoder(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, tokenizer: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary: little-endian unsigned 32-bit ids, the closing id last)."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in slices(batches, 500):
            ids = [(enc.encode(t) if t else b"") + end for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, ids binary")


def _pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in slices(batches):
            texts, row, start, length, crc, total = b.column(1), [], [], [], [], []
            for i in range(b.num_rows):
                t = texts[i].as_py()
                ids = memoryview((enc.encode(t) if t else b"") + end)
                n = len(ids) // 4
                for s in range(0, n, window):
                    e = min(n, s + window)
                    row.append(i), start.append(s), length.append(e - s), crc.append(zlib.crc32(ids[4 * s : 4 * e])), total.append(n)
            cols = [b.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "ids_crc32", "doc_tokens"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def nnls_repeats(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with least |A x - h|, where column j of A counts the lengths in combos[j] (0: none).

    Multiplicative updates, x *= A'h / A'Ax; they keep x non-negative and lower the error each time.
    """
    h = histogram.astype(float)
    used = (combos > 0).astype(float)
    x = np.where(combos > 0, h[combos], np.inf).min(axis=1) / 3 + 1e-9
    top = np.maximum((h[combos] * used).sum(axis=1), 1e-12)
    for _ in range(rounds):
        ax = np.bincount(combos.ravel(), weights=(x[:, None] * used).ravel(), minlength=len(h))
        x = x * top / np.maximum((ax[combos] * used).sum(axis=1), 1e-12)
    return x


def shallow_combinations(histogram: np.ndarray, window: int, triples_per_length: int = 4) -> np.ndarray:
    """Pairs, and a few triples of each length, of lengths present that fill the window exactly."""
    have = np.flatnonzero(histogram)
    have = have[have < window]
    a = have[have * 2 <= window]
    pairs = np.stack([a, window - a, 0 * a], axis=1)
    rows = [pairs[histogram[pairs[:, 1]] > 0]] if len(a) else []
    for i in range(triples_per_length if len(have) else 0):
        b = have[(np.arange(len(have)) * (2 * i + 3) + i) % len(have)]
        c = window - have - b
        ok = c > 0
        t = np.sort(np.stack([have[ok], b[ok], c[ok]], axis=1), axis=1)
        rows.append(t[histogram[t[:, 2]] > 0])
    return np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 3), int)


def plan_windows(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a window, how many such windows), using up the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], times: int) -> None:
        if times > 0:
            plan.append((lengths, times))
            for v in lengths:
                left[v] -= times

    use((window,), int(left[window]))
    combos = shallow_combinations(left, window)
    if len(combos):
        x = np.rint(nnls_repeats(combos, left)).astype(np.int64)
        for j in np.argsort(-x, kind="stable"):
            lengths = tuple(int(v) for v in combos[j] if v)
            need = {v: lengths.count(v) for v in lengths}
            use(lengths, min(int(x[j]), *(int(left[v]) // k for v, k in need.items())))
    while (have := np.flatnonzero(left)).size:  # each turn uses up a length at least
        room, need = window, {}
        while True:
            fit = [v for v in have[: np.searchsorted(have, room, "right")][::-1] if left[v] > need.get(int(v), 0)]
            if not fit:
                break
            v = int(fit[0])
            k = min(room // v, int(left[v]) - need.get(v, 0))
            need[v] = need.get(v, 0) + k
            room -= k * v
        use(tuple(v for v, k in need.items() for _ in range(k)), min(int(left[v]) // k for v, k in need.items()))
    return plan


def pack_documents(
    docs: DataFrame, tokenizer: str, *, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    ``padded_to`` is the window, or the sequence's own length where that is a power of two.
    """
    pieces = stored(_pieces(docs, tokenizer, window, end_id, id_col, text_col), "pieces")
    order = ["length", "id", "start", "ids_crc32", "doc_tokens"]
    ordered = cut(pieces.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ordered.withColumn("part", F.spark_partition_id())
    # range-sorted by length: partitions + window rows at most
    counts = placed.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = np.zeros(window + 1, np.int64)
    offsets: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r["part"], r["length"])):
        offsets[r["part"], r["length"]] = int(histogram[r["length"]])
        histogram[r["length"]] += r["n"]

    slots, sequence, taken = [], 0, np.zeros(window + 1, np.int64)
    for lengths, times in plan_windows(histogram, window):
        total, offset = sum(lengths), 0
        for v in lengths:
            slots.append((v, int(taken[v]), sequence, offset, total))
            taken[v] += times
            offset += v
        sequence += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) | table[:, 1]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        for b in batches:
            if b.empty:
                continue
            length = b["length"].to_numpy()
            rank = b.groupby("length").cumcount().to_numpy().astype(np.int64)
            for v, n in zip(*np.unique(length, return_counts=True), strict=True):
                rank[length == v] += seen.setdefault(int(v), offsets[int(b["part"].iloc[0]), int(v)])
                seen[int(v)] += int(n)
            s = table[np.searchsorted(keys, (length << 44) | rank, "right") - 1]
            total = s[:, 4]
            yield b.drop(columns="part").assign(
                sequence_id=s[:, 2] + rank - s[:, 1], offset=s[:, 3], padded_to=np.where(total & (total - 1) == 0, total, window)
            )

    added = [StructField(c, LongType()) for c in ("sequence_id", "offset", "padded_to")]
    return placed.mapInPandas(place, StructType([*ordered.schema.fields, *added]))
