"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary classifier over hashed byte n-grams
predicts each bit; a text's language is that of the codeword with the least logistic
loss, bits weighted by how well their classifier does on sample rows that it was not
fitted to. The sample is bounded: ``per_language`` rows a language, ``most`` in all.

Defined results: a null text, and one without a letter, is ``und`` with score 0. If no
row has a language to learn, every text is ``und``. With one language, every text with a
letter gets it with score 1. Ties go to the language first by code point. Rows that
repeat are predicted each; an empty table gives no rows. Texts are read whole. Only the
columns named are read, so extra columns can't clash.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import slices

BUCKETS = 1 << 14
#: One sample row in so many is left out of the fit, to weigh the bits.
APART = 5
#: Rows of the sample that the fit unpacks at once.
BLOCK = 64
CHUNK = 1 << 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_lower = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\r\x0b\x0c0123456789|.,;:!?\"'()[]{}<>#*%&/=-_+@" else b for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass
class Model:
    """languages; their codewords (+1, -1); weights of each bit's classifier by n-gram bucket; bias; bit weights."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: all different splits for up to 5 languages, else random rows far apart."""
    if k <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=k) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T.reshape(k, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(k)))
    for _ in range(50):
        c = rng.choice((-1.0, 1.0), (k, length))
        apart = min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) if k <= 200 else 0
        if apart > far:
            best, far = c, apart
    return best


def _features(data: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of 1 to 4 bytes that start at each byte."""
    a = np.concatenate([data, np.full(3, 32, np.uint8)]).astype(np.uint32)
    n = len(data)
    out, code = np.empty((4, n), np.uint16), np.zeros(n, np.uint32)
    for k in range(4):
        code = (code ^ (a[k : k + n] + np.uint32(k * 257 + 1))) * np.uint32(0x9E3779B1)
        out[k] = (code >> np.uint32(18)).astype(np.uint16)
    return out


def _chunks(text: str) -> Iterator[np.ndarray]:
    raw = text.encode("utf-8", "replace").translate(_lower)
    for at in range(0, len(raw), CHUNK):
        yield np.frombuffer(raw, np.uint8, min(CHUNK, len(raw) - at), at)


def _counts(text: str) -> tuple[np.ndarray, int]:
    """How often each n-gram bucket is in a whole text, and their sum."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for c in _chunks(text):
        f = _features(c)
        total += np.bincount(f.ravel(), minlength=BUCKETS)
        n += f.size
    return total, n


def frequencies(text: str) -> np.ndarray:
    """Shares of the n-gram buckets in a whole text."""
    total, n = _counts(text)
    return total / max(n, 1)


class _Roots:
    """Square roots of the bucket shares of many texts, a block of rows at once.

    Counts are held, in the narrowest type that has room for a block's largest: half of what
    the roots take or less. The roots are taken anew whenever they are needed.
    """

    def __init__(self, texts: list[str]):
        self.blocks, self.scale = [], np.empty(len(texts), np.float32)
        for at in range(0, len(texts), BLOCK):
            block = np.empty((min(BLOCK, len(texts) - at), BUCKETS), np.int64)
            for i in range(len(block)):
                block[i], n = _counts(texts[at + i])
                self.scale[at + i] = 1 / np.sqrt(max(n, 1))
            self.blocks.append(block.astype(np.min_scalar_type(int(block.max()))))
        self._room = np.empty((BLOCK, BUCKETS), np.float32)

    def __iter__(self) -> Iterator[tuple[slice, np.ndarray]]:
        """(rows, their roots); the array is used again for the next block."""
        for k, block in enumerate(self.blocks):
            rows = slice(k * BLOCK, k * BLOCK + len(block))
            x = self._room[: len(block)]
            np.sqrt(block, out=x, dtype=np.float32, casting="unsafe")
            x *= self.scale[rows, None]
            yield rows, x


def fit(texts: list[str], langs: list[str], *, rounds: int = 250, rate: float = 1.0, penalty: float = 1e-5) -> Model | None:
    """Logistic classifiers, one for each bit, by full-batch gradient steps over the sample.

    One row in ``APART`` is not fitted: it tells how far each bit can be trusted.
    """
    if not texts:
        return None
    languages = sorted(set(langs))
    code = codewords(len(languages))
    if not code.shape[1]:
        return Model(languages, code, np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0))
    of = np.array([languages.index(v) for v in langs])
    y = code[of].astype(np.float32)
    nth = np.empty(len(of), np.int64)  # of its language
    for k in range(len(languages)):
        nth[of == k] = np.arange((of == k).sum())
    apart = nth % APART == APART - 1
    use = np.flatnonzero(~apart)
    each = (1 / np.bincount(of[use], minlength=len(languages)))[of[use]].astype(np.float32)[:, None] / len(languages)
    seen, want = _Roots([texts[i] for i in use]), y[use]
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        slope, lean = penalty * w, np.zeros_like(b)
        for rows, x in seen:
            g = -want[rows] / (1 + np.exp(np.clip(want[rows] * (x @ w + b), -30, 30))) * each[rows]
            slope += x.T @ g
            lean += g.sum(axis=0)
        for p, grad, i in ((w, slope, 0), (b, lean, 1)):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad**2
            p -= rate * 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
    tried, hits = np.flatnonzero(apart), np.zeros(len(b))
    for rows, x in _Roots([texts[i] for i in tried]):
        hits += ((x @ w + b) * y[tried[rows]] > 0).sum(axis=0)
    right = hits / len(tried) if len(tried) else np.ones(len(b))
    return Model(languages, code, w.astype(float), b.astype(float), np.maximum(right - 0.5, 0.01))


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language index, score and gap to the second language for rows of bit margins."""
    if len(model.languages) == 1:
        n = len(margins)
        return np.zeros(n, int), np.ones(n), np.ones(n)
    z = np.clip(margins, -30, 30)
    loss = (np.log1p(np.exp(-z[:, None, :] * model.code[None])) * model.trust).sum(axis=2) / model.trust.sum()
    best = loss.argmin(axis=1)
    p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    top = np.sort(p, axis=1)
    return best, top[:, -1], top[:, -1] - top[:, -2]


def sample(docs: DataFrame, usable: Column, *, per_language: int, most: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """(text, language) of at most ``per_language`` rows of each language and ``most`` in all, those of least hash.

    The rows of each language are counted; a hash bound by that count leaves about a quarter
    more than are wanted, wherever they are, and only those are ranked. Repeated rows count once.
    """
    rows = docs.where(usable).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("lang is not null and text is not null").withColumn("h", F.xxhash64("id", "text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language, as the model has
    if not counts:
        return []
    per = max(1, min(per_language, most // len(counts)))
    bounds = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 32, -(-(per * 5 // 4 + 50) * (1 << 32) // r["n"]))) for r in counts], "l string, bound long")
    near = rows.join(F.broadcast(bounds), F.col("lang") == F.col("l")).where(F.pmod("h", F.lit(1 << 32)) < F.col("bound")).dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 32)), "h"))
    chosen = near.withColumn("place", place).where(F.col("place") <= per).select("lang", "place", "text").collect()
    return [(r["text"], r["lang"]) for r in sorted(chosen, key=lambda r: (r["lang"], r["place"])) if has_letter(r["text"])]


def learn(docs: DataFrame, *, per_language: int, most: int, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """The model of a bounded sample of the rows outside the held-out fold."""
    rows = sample(docs, ~held_out(id_col), per_language=per_language, most=most, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return fit([t for t, _ in rows], [v for _, v in rows])


def _classify(m: Model | None, texts: pa.Array, ambiguous_below: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is ambiguous, for each text."""
    n = len(texts)
    lang, score, gap = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
    known, margins = [], []
    for i, t in enumerate(texts if m is not None else ()):
        t = t.as_py()
        if has_letter(t):
            known.append(i)
            margins.append(m.bias + (np.sqrt(frequencies(t)) @ m.weights if m.weights.shape[1] else 0))
    if known:
        best, score[known], gap[known] = decode(np.stack(margins), m)
        for i, j in zip(known, best, strict=True):
            lang[i] = m.languages[j]
    return lang, score, gap < ambiguous_below


def predict(docs: DataFrame, model: Model | None, *, ambiguous_below: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, ambiguous for every row, from the text alone."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and the code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score, unsure = _classify(shared.value, b.column(1), ambiguous_below)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["id", "lang_pred", "score", "ambiguous"])

    return src.mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean")


def keep_identified(
    docs: DataFrame, *, per_language: int = 500, most: int = 4000, ambiguous_below: float = 0.2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The rows, whole, whose text is in one of the learned languages without ambiguity."""
    model = learn(docs, per_language=per_language, most=most, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, _, unsure = _classify(shared.value, b.column(at), ambiguous_below)
            yield b.take(pa.array(np.flatnonzero(~unsure & (np.array(lang, object) != UNKNOWN))))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(
    docs: DataFrame, *, per_language: int = 500, most: int = 4000, ambiguous_below: float = 0.2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """id, held_out, lang_pred, score, ambiguous. Learns from rows outside the held-out fold."""
    model = learn(docs, per_language=per_language, most=most, id_col=id_col, text_col=text_col, lang_col=lang_col)
    out = predict(docs, model, ambiguous_below=ambiguous_below, id_col=id_col, text_col=text_col)
    return out.withColumn("held_out", held_out("id"))
