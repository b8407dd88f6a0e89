r"""Suffix dedup by longest-previous-factor arrays over content-dealt suffixes.

A byte string of ``length`` bytes that starts at two places, in one document or in two, is
a repeat. To find all of them without one suffix array over the corpus, the suffixes are
dealt out by content: in each window of ``length`` bytes the ``GRAM``-gram of least hash
(the leftmost of equals) is the window's anchor, and equal windows have equal anchors at
equal places. The windows that share an anchor are a run. Anchors are counted over all
documents; only the runs of those that occur twice are written, with their bytes once a
task (a bitmap that grows with the count, up to 128 MB, tells them apart; beyond that it
lets others through, which changes nothing but the work). Runs with equal bytes (by a
128-bit hash) are a class, and a class of several runs repeats whole.

The classes of an anchor are laid end to end, in the order of their first occurrence, in
blocks. Their suffixes are sorted up to ``length`` bytes, with the common prefixes of
neighbours; the previous and next smaller positions in that order give each suffix's
longest previous factor. A factor of ``length`` is a later copy. Read from the other end
the same arrays give the longest next factor, and a suffix with either has a copy.

An anchor with more classes than ``group`` is dealt out over several blocks; windows that
are first in their block are then compared across blocks by a 128-bit hash.

``keep="first"`` removes later copies and keeps the first, by (id, hash of the text,
position); ``keep="none"`` removes every copy. What is removed is each byte that a removed
window covers.

Passages of over 50 words can be shorter than ``length``. They are counted, not removed:
of each ``passage`` words in a row (between blanks, A-Z in lower case) the shingle of
``SHINGLE`` words with the least hash is looked up in all documents. So of every run of
``passage`` words that another document has too a shingle is found, and no run of fewer
than ``SHINGLE`` words gives one.

Defined results: a null text is an empty one. Texts under ``length`` bytes lose nothing.
Matches never cross documents. Repeated rows are copies of each other; with
``keep="first"`` rows of equal id and text share their fate. To passages rows of equal id
and text are one document. An empty table gives no rows. Texts are read whole, long ones
in overlapping segments; only the columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices, small
from lodestone.llm.ngram_join import _CODES, CHUNK, _powers, mix, word_hashes
from lodestone.session import stored

GRAM, SHINGLE, SEGMENT = 32, 26, 1 << 19
#: Bytes of a task's block, and of the part of it that is sorted at once (whole anchors, so that arrays stay in the cache).
BLOCK_BYTES, SORT_BYTES = 1 << 20, 1 << 16
GROUP, BUCKET_WINDOWS, SEEN = 1500, 400_000, 100_000
#: Keys with more rows than this, and than one in ``MOST_HOT`` of all rows, meet their one partner by broadcast.
HOT, MOST_HOT = 10_000, 50_000
_AT = np.uint64((1 << 24) - 1)


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from minima up to and from block borders."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def _rolled(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the runs of ``gram`` codes."""
    up, down = _powers(max(CHUNK, 1 << len(codes).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * down[: len(codes) - gram + 1])


def anchors(codes: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, position, first window, windows) of the runs of windows that share an anchor."""
    gram = min(gram, length)
    for at in range(0, len(codes) - length + 1, SEGMENT):
        h = _rolled(codes[at : at + SEGMENT + length - 1], gram)
        least = _sliding_least((h & ~_AT) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        p = (least & _AT).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        yield h[p[lo]], p[lo] + at, lo + at, np.diff(np.append(lo, len(p)))


def _chains(data: np.ndarray, h: np.ndarray, p: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int, marked: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first run, runs) of the stretches of marked runs with equal windows: where a text repeats at once, they are one row."""
    like = (h[1:] == h[:-1]) & (n[1:] == n[:-1]) & ((p - lo)[1:] == (p - lo)[:-1])
    begin = np.flatnonzero(np.concatenate([[True], ~like]))
    end_of = np.append(begin[1:], len(h))
    some = np.flatnonzero(marked[begin])
    for s, e in zip(begin[some].tolist(), end_of[some].tolist(), strict=True):
        if e - s == 1:
            yield s, 1
            continue
        a, step, end = lo[s], n[s], lo[e - 1] + n[e - 1] + length - 1
        if (data[a : end - step] == data[a + step : end]).all():
            yield s, e - s
        else:
            for k in range(s, e):
                yield k, 1


def _raw(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer(x.as_buffer() or b"", np.uint8)


def _words_of(data: np.ndarray) -> np.ndarray:
    return word_hashes(data, np.array([0, len(data)]))[0]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (a hash of the text), text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("id", F.xxhash64("text").alias("key"), "text")


def _counts(src: DataFrame, length: int) -> DataFrame:
    """(anchor, c) of the anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in slices(batches):
            for data in _raw(b.column(0).cast(pa.large_binary())):
                held += [h for h, *_ in anchors(_CODES[data], length, GRAM)] if len(data) >= length else []
            if len(held) >= 5000:
                yield out(held)
        if held:
            yield out(held)

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["anchor", "c"])

    return src.select("text").mapInArrow(run, "anchor long, c long").groupBy("anchor").agg(F.sum("c").alias("c")).where("c > 1")


def _bitmap(anchors: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap in which the anchors' bits are set: eight bits or more an anchor, 2^30 at most."""
    bits = int(np.clip(3 + int(anchors.count()).bit_length(), 18, 30))
    bit = F.pmod(F.col("anchor"), F.lit(1 << bits))
    pages = (
        anchors.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("page"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits")).collect()
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in pages:  # of 32768 bits; the first is page 1
        out[(r["page"] - 1) * 4096 : r["page"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out, bits


def _runs(src: DataFrame, anchored: tuple[np.ndarray, int], length: int) -> DataFrame:
    """The runs of repeated anchors: id, key, lo, n windows, times, anchor, k1 and k2 (the class), ctx (its bytes, once a task)."""
    shared = src.sparkSession.sparkContext.broadcast(anchored)
    kind = src.schema["id"].dataType.simpleString()
    names = ["id", "key", "lo", "n", "times", "anchor", "k1", "k2", "ctx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = shared.value
        low = np.uint64((1 << bits) - 1)
        seen: set[bytes] = set()
        for b in slices(batches):
            held, digests, ctx = [], [], []
            for row, data in enumerate(_raw(b.column(2).cast(pa.large_binary()))):
                for h, p, lo, n in anchors(_CODES[data], length, GRAM) if len(data) >= length else ():
                    where = h & low
                    marked = bitmap[where >> np.uint64(3)] >> (where & np.uint64(7)).astype(np.uint8) & 1
                    for k, times in _chains(data, h, p, lo, n, length, marked):
                        at, many = int(lo[k]), int(n[k])
                        body = data[at : at + many + length - 1].tobytes()
                        digest = hashlib.blake2b(body, digest_size=16, key=int(p[k] - at).to_bytes(4, "little")).digest()
                        digests.append(digest)
                        held.append((row, at, many, times, h[k].view(np.int64)))
                        ctx.append(None if digest in seen else body)
                        seen.add(digest)
                if len(held) >= 20_000:
                    yield out(b, held, digests, ctx)
                    held, digests, ctx = [], [], []
            if held:
                yield out(b, held, digests, ctx)
            if len(seen) > SEEN:
                seen.clear()

    def out(b: pa.RecordBatch, held: list[tuple], digests: list[bytes], ctx: list[bytes | None]) -> pa.RecordBatch:
        row, *rest = zip(*held, strict=True)
        k1, k2 = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
        at = pa.array(row, pa.int32())
        return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(x, pa.int64()) for x in rest), pa.array(k1.copy()), pa.array(k2.copy()), pa.array(ctx, pa.binary())], names)

    return src.mapInArrow(run, f"id {kind}, key long, lo long, n long, times long, anchor long, k1 long, k2 long, ctx binary")


def _met(rows: DataFrame, single: DataFrame, on: dict[str, str], count: str) -> DataFrame:
    """``rows`` joined with the one row of ``single`` (stored) for its key; ``count`` says for how many.

    Keys of very many rows are broadcast, so that their rows stay where they are: at most
    ``MOST_HOT`` keys, as each has more than that share of the rows.
    """
    total = single.agg(F.sum(count).alias("n")).first()["n"] or 0
    bound = max(HOT, total // MOST_HOT)
    same = [F.col(a) == F.col(b) for a, b in on.items()]
    hot = single.where(F.col(count) > bound)
    if hot.isEmpty():
        return rows.join(single, same)
    cold = rows.join(F.broadcast(hot.select(*on.values())), same, "left_anti").join(single.where(F.col(count) <= bound), same)
    return rows.join(F.broadcast(hot), same).unionByName(cold)


# suffix order and factors of a block


def suffix_ranks(text: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(step, dense ranks of the suffixes cut to ``step`` bytes) for doubling steps up to ``length``; the text's end sorts first."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text.astype(np.uint64) + np.uint64(1)
    levels = [(1, padded[:n].astype(np.int64))]
    if length >= 4:
        packed = (((padded[:n] << np.uint64(27)) | (padded[1 : n + 1] << np.uint64(18))) | (padded[2 : n + 2] << np.uint64(9))) | padded[3 : n + 3]
        levels.append((4, np.unique(packed, return_inverse=True)[1]))
    while levels[-1][0] < length:
        step, rank = levels[-1]
        by = min(step, length - step)
        second = np.zeros(n, np.uint64)
        second[: max(0, n - by)] = rank[by:].astype(np.uint64) + np.uint64(1)
        levels.append((step + by, np.unique((rank.astype(np.uint64) << np.uint64(32)) | second, return_inverse=True)[1]))
    return levels


def _common(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and at b, cut to the last level's step."""
    length, rank = levels[-1]
    same = rank[a] == rank[b]
    out = np.where(same, length, 0)
    rest = np.flatnonzero(~same)
    x, y, got = a[rest], b[rest], np.zeros(len(rest), np.int64)
    for step, ranks in levels[-2::-1]:
        for _ in range(3 if step == 1 else 1):
            inside = (np.maximum(x, y) + got < len(ranks)) & (got + step <= length)
            at = np.minimum(got, len(ranks) - 1 - np.maximum(x, y))
            got = np.where(inside & (ranks[x + at] == ranks[y + at]), got + step, got)
    out[rest] = got
    return out


def _nearest_smaller(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place of a suffix order, the common prefix with the nearest place before it that has a smaller position; 0 without one.

    ``common[k]`` is that of the places k - 1 and k. All places between k and its pointer
    have larger positions, so where the pointer's position is larger too, the pointer moves
    on to that place's own pointer: all places at once, until none moves.
    """
    n = len(order)
    to, least = np.arange(-1, n - 1), common.copy()
    moving = np.arange(1, n)
    while len(moving):
        moving = moving[to[moving] >= 0]
        moving = moving[order[to[moving]] > order[moving]]
        by = to[moving]
        least[moving] = np.minimum(least[moving], least[by])
        to[moving] = to[by]
    return np.where(to >= 0, least, 0)


def longest_previous_factors(levels: list[tuple[int, np.ndarray]], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending ``starts``, the longest common prefix with an earlier and with a later one, cut to the last level's step."""
    order = np.argsort(levels[-1][1][starts], kind="stable")  # ties by position
    common = np.zeros(len(starts), np.int64)
    common[1:] = _common(levels, starts[order[:-1]], starts[order[1:]])
    back = np.append(common[1:], 0)[::-1]  # the same order read from its end
    before, behind = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    before[order] = np.maximum(_nearest_smaller(order, common), _nearest_smaller(order[::-1], back)[::-1])
    behind[order] = np.maximum(_nearest_smaller(-order, common), _nearest_smaller(-order[::-1], back)[::-1])
    return before, behind


def block_factors(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of the contexts, in turn: whether it has a copy, whether an earlier one, and where it starts in the block."""
    sizes = np.array([len(c) for c in contexts])
    levels = suffix_ranks(np.frombuffer(b"".join(contexts), np.uint8), length)
    windows = sizes - length + 1
    own = np.repeat(np.arange(len(contexts)), windows)
    starts = np.concatenate([[0], np.cumsum(sizes)])[own] + np.arange(len(own)) - np.concatenate([[0], np.cumsum(windows)])[own]
    before, behind = longest_previous_factors(levels, starts)
    return (before >= length) | (behind >= length), before >= length, starts


def _packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes() if flags.any() else b""


def _parts(sizes: list[int], anchors: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of contexts in anchor order, of ``SORT_BYTES`` or somewhat more, that split no anchor."""
    begin, held = 0, 0
    for i, (size, anchor) in enumerate(zip(sizes, anchors, strict=True)):
        if held >= SORT_BYTES and anchor != anchors[i - 1]:
            yield begin, i
            begin, held = i, 0
        held += size
    if sizes:
        yield begin, len(sizes)


_KEYS = "k1 long, k2 long"
_LISTS = "k1s array<long>, k2s array<long>, places array<long>"
_MASKS = f"{_KEYS}, matched binary, earlier binary, bucket int, windows binary, {_LISTS}"
#: One window that is first in its block: a 128-bit hash, its class in the row's lists, its place.
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("cls", "<i4"), ("w", "<i4")])


def _factor_blocks(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """A mask of each class's windows; for anchors over several blocks also the windows that are first in their block, packed by hash bucket.

    rows: block, salt, anchor, k1, k2, place (the class's number in order), split, ctx.
    """

    def run(table: pa.Table) -> pa.Table:
        seen, picked = set(), []
        for i, k in enumerate(zip(table.column("k1").to_pylist(), table.column("k2").to_pylist(), strict=True)):
            if k not in seen:
                seen.add(k)
                picked.append(i)
        t = table.take(pa.array(picked)).sort_by([("anchor", "ascending"), ("place", "ascending"), ("k1", "ascending"), ("k2", "ascending")])
        ctx, split = t.column("ctx").to_pylist(), t.column("split").to_pylist()
        masks, packed = ([], []), []
        for begin, end in _parts([len(c) for c in ctx], t.column("anchor").to_pylist()):
            part = ctx[begin:end]
            matched, earlier, starts = block_factors(part, length)
            whole, at = b"".join(part), 0
            for i, c in enumerate(part, begin):
                n = len(c) - length + 1
                m, e = matched[at : at + n], earlier[at : at + n]
                masks[0].append(_packed(m))
                masks[1].append(_packed(e))
                if split[i]:
                    first = np.flatnonzero(~e)
                    w = np.zeros(len(first), _WINDOW)
                    hashes = b"".join(hashlib.blake2b(whole[s : s + length], digest_size=16).digest() for s in starts[at + first])
                    w["a"], w["b"] = np.frombuffer(hashes, "<u8").reshape(-1, 2).T
                    w["cls"], w["w"] = i, first
                    packed.append(w)
                at += n
        keys = {k: t.column(k).to_pylist() for k in ("k1", "k2", "place")}
        nothing = [None] * len(ctx)
        out = {k: list(keys[k]) for k in ("k1", "k2")} | {"matched": masks[0], "earlier": masks[1], "bucket": nothing[:], "windows": nothing[:]}
        lists = {"k1s": nothing[:], "k2s": nothing[:], "places": nothing[:]}
        if packed:
            windows = np.concatenate(packed)
            of = (windows["a"] % np.uint64(buckets)).astype(int)
            for k in np.unique(of):
                part = windows[of == k]
                used, part["cls"] = np.unique(part["cls"], return_inverse=True)
                for name in ("k1", "k2", "matched", "earlier"):
                    out[name].append(None)
                out["bucket"].append(int(k))
                out["windows"].append(part.tobytes())
                for name, source in zip(lists, keys, strict=True):
                    lists[name].append([keys[source][i] for i in used])
        kinds = {"matched": pa.binary(), "earlier": pa.binary(), "bucket": pa.int32(), "windows": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()} | {k: pa.array(v, pa.list_(pa.int64())) for k, v in lists.items()})

    return rows.groupBy("block", "salt").applyInArrow(run, _MASKS)


def _across_blocks(packed: DataFrame) -> DataFrame:
    """(x1, x2, also, also_late): windows of a class that other blocks have too, and those of them that have them earlier."""

    def run(table: pa.Table) -> pa.Table:
        parts, classes = [], []
        for r in table.to_pylist():
            w = np.frombuffer(r["windows"], _WINDOW).copy()
            w["cls"] += len(classes)
            parts.append(w)
            classes += zip(r["k1s"], r["k2s"], r["places"], strict=True)
        w = np.concatenate(parts)
        keys = np.array(classes, np.int64)
        order = np.lexsort((w["w"], keys[w["cls"], 2], w["b"], w["a"]))
        w = w[order]
        new = np.concatenate([[True], (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1])])
        many = np.repeat(np.diff(np.append(np.flatnonzero(new), len(w))) > 1, np.diff(np.append(np.flatnonzero(new), len(w))))
        also: dict[int, tuple[list[int], list[int]]] = {}
        for i in np.flatnonzero(many):
            here = also.setdefault(int(w["cls"][i]), ([], []))
            here[0].append(int(w["w"][i]))
            if not new[i]:
                here[1].append(int(w["w"][i]))
        columns = {k: pa.array([classes[c][j] for c in also], pa.int64()) for j, k in enumerate(("k1", "k2"))}
        lists = {k: pa.array([x[j] for x in also.values()], pa.list_(pa.int64())) for j, k in enumerate(("also", "also_late"))}
        return pa.table(columns | lists)

    found = packed.groupBy("bucket").applyInArrow(run, f"{_KEYS}, also array<long>, also_late array<long>")
    return found.groupBy(F.col("k1").alias("x1"), F.col("k2").alias("x2")).agg(F.flatten(F.collect_list("also")).alias("also"), F.flatten(F.collect_list("also_late")).alias("also_late"))


def _placed(classes: DataFrame) -> DataFrame:
    """``classes`` with place: their number in the order of first occurrence (ranges of the order, numbered in turn)."""
    order = [F.col("first.id").asc_nulls_first(), "first.key", "first.lo", "k1", "k2"]
    return stored(classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed-classes")


def repeated_windows(src: DataFrame, length: int, keep: str, group: int = GROUP) -> DataFrame:
    """(id, key, lo, n, times, mask, extra, whole): for runs of n windows from lo, ``times`` of them, which have copies. src: id, key, text."""
    with small(src.sparkSession):
        runs = stored(_runs(src, _bitmap(stored(_counts(src, length), "anchors")), length), "runs")
    aggregates = [F.sum("times").alias("c"), F.count(F.lit(1)).alias("rows"), F.min("anchor").alias("anchor")]
    if keep == "first":
        classes = _placed(runs.groupBy("k1", "k2").agg(*aggregates, F.min(F.struct("id", "key", "lo")).alias("first")))
    else:  # the order doesn't matter
        classes = stored(runs.groupBy("k1", "k2").agg(*aggregates).withColumn("place", F.lit(0).cast("long")), "run-classes")
    many = stored(classes.groupBy(F.col("anchor").alias("m")).agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "crowded-anchors")
    named = _met(classes.select("anchor", "k1", "k2", "place", "rows"), many, {"anchor": "m"}, "k").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "place", "k")
    total = runs.agg(F.sum(F.octet_length("ctx")).alias("n")).first()["n"] or 0
    crowded = many.where(F.col("k") > group).agg(F.sum("k").alias("n")).first()["n"] or 0
    blocks = max(1, int(total // BLOCK_BYTES))
    shares = F.ceil(F.col("k") / F.lit(group)).cast("long")
    rows = runs.where("ctx is not null").select("anchor", "k1", "k2", "ctx").join(named, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2"))).select(
        F.pmod("anchor", F.lit(blocks)).alias("block"), F.when(shares > 1, F.concat_ws(":", "anchor", F.pmod(F.xxhash64("k1"), shares))).otherwise("").alias("salt"),
        "anchor", "k1", "k2", "place", (shares > 1).alias("split"), "ctx",
    )
    found = stored(_factor_blocks(rows, length, 1 + crowded * length // BUCKET_WINDOWS), "factors")
    side, extra = ("matched", "also") if keep == "none" else ("earlier", "also_late")
    more = _across_blocks(found.where("bucket is not null").select("bucket", "windows", *[f.split()[0] for f in _LISTS.split(", ")]))
    masks = found.where("bucket is null").join(more, (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2")), "left").where(f"length({side}) > 0 or {extra} is not null")
    masks = masks.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col(side).alias("mask"), F.col(extra).alias("extra"))
    decided = classes.join(masks, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left").where("c > 1 or m1 is not null")
    first = [F.col("first")] if keep == "first" else []
    decided = stored(decided.select(F.col("k1").alias("d1"), F.col("k2").alias("d2"), "rows", "mask", "extra", (F.col("c") > 1).alias("whole"), *first), "decided")
    fields = ["id", "key", "lo", "n", "times", "mask", "extra", "whole"]
    joined = _met(runs.drop("ctx", "anchor"), decided, {"k1": "d1", "k2": "d2"}, "rows")
    if keep == "none":
        return joined.withColumn("mask", F.when(~F.col("whole"), F.col("mask"))).withColumn("extra", F.when(~F.col("whole"), F.col("extra"))).select(fields)
    here = F.struct("id", "key", "lo").eqNullSafe(F.col("first"))
    own = joined.withColumn("whole", F.col("whole") & ~here).withColumn("mask", F.when(~F.col("whole"), F.col("mask"))).withColumn("extra", F.when(~F.col("whole"), F.col("extra")))
    # of a first occurrence that repeats at once, the windows behind the first run are later copies
    nothing = {"lo": F.col("lo") + F.col("n"), "times": F.col("times") - 1, "mask": F.lit(None).cast("binary"), "extra": F.lit(None).cast("array<long>"), "whole": F.lit(True)}
    behind = joined.where(here & (F.col("times") > 1)).withColumns(nothing)
    return own.withColumn("times", F.when(here, F.lit(1)).otherwise(F.col("times"))).select(fields).unionAll(behind.select(fields))


def shared_passages(src: DataFrame, passage: int) -> DataFrame:
    """(id, key, starts): the places, in words, of the shingles looked up that another document has. src: id, key, text."""
    size = min(SHINGLE, passage)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, at, shingle = [], [], []
            for i, data in enumerate(_raw(b.column(2).cast(pa.large_binary()))):
                words = _words_of(data)
                for h, p, _, _ in anchors(words, passage, size) if len(words) >= passage else ():
                    fresh = np.concatenate([[True], h[1:] != h[:-1]])  # where a text repeats at once, the first place
                    row.append(np.full(int(fresh.sum()), i, np.int32)), at.append(p[fresh]), shingle.append(h[fresh].view(np.int64))
            if row:
                rows = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.concatenate(at)), pa.array(np.concatenate(shingle))], ["id", "key", "start", "shingle"])

    with small(src.sparkSession):
        rows = stored(src.mapInArrow(run, f"id {kind}, key long, start long, shingle long"), "shingles")
    doc = F.xxhash64("id", "key")
    shared = rows.groupBy(F.col("shingle").alias("s")).agg(F.min(doc).alias("a"), F.max(doc).alias("b"), F.count(F.lit(1)).alias("many")).where("a <> b").select("s", "many")
    return _met(rows, stored(shared, "shared-shingles"), {"shingle": "s"}, "many").groupBy("id", "key").agg(F.collect_list("start").alias("starts"))


def _covered(size: int, marks: list[dict], length: int) -> np.ndarray:
    """Which of ``size`` bytes the marked windows of ``length`` bytes cover."""
    steps = np.zeros(size + 1, np.int64)
    for m in marks:
        if m["whole"]:
            steps[m["lo"]] += 1
            steps[m["lo"] + m["n"] * m["times"] + length - 1] -= 1
            continue
        bits = np.unpackbits(np.frombuffer(m["mask"] or bytes(-(-m["n"] // 8)), np.uint8), count=m["n"]).astype(bool)
        bits[m["extra"] or []] = True
        w = m["lo"] + np.flatnonzero(bits)
        w = (w[None, :] + m["n"] * np.arange(m["times"])[:, None]).ravel()
        steps[w] += 1
        steps[w + length] -= 1
    return np.cumsum(steps)[:-1] > 0


def _union(starts: list[int], size: int) -> int:
    """How much the ranges of ``size`` from the starts cover."""
    at = np.unique(np.array(starts, np.int64))
    return int(np.minimum(np.diff(at), size).sum() + size) if len(at) else 0


def remove_repeats(
    docs: DataFrame, *, length: int = 400, keep: str = "first", group: int = GROUP, passage: int = 51, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, kept (binary: the bytes that stay), spans (array of start, end in bytes of the removed runs), n_bytes, shared_words.

    ``shared_words``: words in the shingles, looked up of each ``passage`` words, that another document has.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is first or none")
    src = _texts(docs, id_col, text_col)
    fields = ["lo", "n", "times", "mask", "extra", "whole"]
    marks = repeated_windows(src, length, keep, group).groupBy("id", "key").agg(F.collect_list(F.struct(*fields)).alias("marks"))
    both = marks.select(F.struct("id").alias("of"), F.col("key").alias("of_key"), "marks").join(
        shared_passages(src, passage).select(F.struct("id").alias("of"), F.col("key").alias("of_key"), "starts"), ["of", "of_key"], "full"
    )
    joined = src.join(both, (F.struct("id") == F.col("of")) & (F.col("key") == F.col("of_key")), "left").select("id", "text", "marks", "starts")
    kind = src.schema["id"].dataType.simpleString()
    span, size = pa.struct([("start", pa.int64()), ("end", pa.int64())]), min(SHINGLE, passage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            kept, spans, sizes = [], [], []
            for data, marks in zip(_raw(b.column(1).cast(pa.large_binary())), b.column(2), strict=True):
                gone = _covered(len(data), marks.as_py() or [], length)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
                kept.append(data[~gone].tobytes())
                sizes.append(len(data))
            shared = [_union(x or [], size) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(span)), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())], ["id", "kept", "spans", "n_bytes", "shared_words"]
            )

    return joined.mapInArrow(run, f"id {kind}, kept binary, spans array<struct<start:bigint,end:bigint>>, n_bytes long, shared_words long")


def digest_columns(removed: DataFrame) -> list[Column]:
    """The columns n_bytes, n_removed, n_spans and kept_sha256 of what remove_repeats returns, and its shared_words."""
    return [
        F.col("n_bytes"), (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("shared_words"),
    ]
