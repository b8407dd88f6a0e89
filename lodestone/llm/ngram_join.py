r"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct word shingles, as 64-bit hashes (two different
shingles share one with a chance of about 2^-64). All documents order their tokens alike:
by frequency class, then by hash. Two sets with a Jaccard similarity of t or more share
their i-th common token within the first d + i tokens of either, where a set of n has
d = n - ceil(t n). So with rare classes first:

* if the first common token is rare, a single-token index over the first d + 1 finds it;
* if it is frequent, so are all later ones, and the first two common tokens stand within
  the first d + 2: an index of two-token combinations finds the pair;
* above ``combine_up_to`` tokens, frequent tokens are indexed singly too; sets near that
  size are indexed both ways, since two similar sets can lie on either side.

Frequencies come from a count sketch of fixed size over all documents; a class taken too
high by a collision changes the order for all sets alike, and so loses no pair. Pairs that
an index entry proposes must share ``EXTRA`` of their first d + ``EXTRA`` tokens before
their whole sets are read.

Equal sets are one class. Within an index entry, first every member is verified against
leaders, and components of the verified links are formed; then members of different
components are verified with each other, until all that share an entry are either in one
component or known to be unlike. Verification compares whole sets.

A component is named by its smallest id.

Defined results: a null or empty text, or one without words, has no tokens and links with
nothing. A row with a null id has a null component and links with nothing. Rows are joined
by their text: rows of one id and one text are one document. An empty table gives no rows.
Texts are read whole; only the columns named are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices, small
from lodestone.llm.components import connected_components
from lodestone.session import lent, stored, unused

SKETCH_BITS, BITMAP_BITS, PAGE = 24, 26, 1 << 18
#: Tokens kept beyond the first d of the common order; two similar sets share so many of them.
EXTRA = 8
CHUNK, FAN = 1 << 20, 64
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93

#: A-Z to lower case; which bytes are blank.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.full(n, _BASE, np.uint64))
    return up, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of concatenated texts, and each word's text. begins: where texts begin, and the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    edge[n] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    size = max(CHUNK, 1 << int(n - 1).bit_length())
    up, down = _powers(size)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_CODES[_FOLD[data]] * up[:n], out=sums[1:])
    h = mix((sums[e + 1] - sums[s]) * down[s] + (e - s + 1).astype(np.uint64) * _STEP)
    return h, np.searchsorted(begins, s, "right") - 1


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its shingles) for every row; one shingle of all words if there are fewer than ``width``."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        h, row = word_hashes(whole[offsets[at] : offsets[to]], offsets[at:to] - offsets[at])
        begins = np.searchsorted(row, np.arange(to - at + 1))
        rolled = np.zeros(len(h), np.uint64)
        for j in range(width):
            if len(h) > j:
                rolled[: len(h) - j] = rolled[: len(h) - j] * _STEP + h[j:]
        rolled = mix(rolled)
        for i in range(to - at):
            a, b = begins[i], begins[i + 1]
            if b - a >= width:
                yield at + i, np.unique(rolled[a : b - width + 1])
            elif b > a:
                code = np.array([b - a], np.uint64)
                for x in h[a:b]:
                    code = mix(code * _STEP + x)
                yield at + i, code
            else:
                yield at + i, np.zeros(0, np.uint64)
        at = to


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def frequency_classes(docs: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Class of every sketch cell, by ascending count, and the first class of frequent tokens. 16 MB at any size.

    Each partition sums into one sketch and sends it in pages; pages are summed in a tree of fan-in ``FAN``.
    Classes are quantiles of the cells' counts, and above the usual load steps of a logarithm,
    so that a token that is more frequent than others stands out from its cell's noise.
    """
    cells = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(cells, np.uint32), []

        def flush() -> None:
            if held:
                cell, n = np.unique(np.concatenate(held), return_counts=True)
                total[cell] += n.astype(np.uint32)
                held.clear()

        for b in slices(batches):
            for _, s in shingle_sets(b.column(1), width):
                held.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                if len(held) >= 2000:
                    flush()
        flush()
        if total.any():
            pages = [zstandard.compress(total[i : i + PAGE].tobytes(), 1) for i in range(0, cells, PAGE)]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int32()), pa.array([part] * len(pages), pa.int32()), pa.array(pages, pa.binary())], ["page", "part", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.decompress(x), np.uint32).astype(np.uint64) for x in pdf["sums"])
        sums = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
        return pd.DataFrame({"page": pdf["page"].iloc[:1], "part": pdf["part"].iloc[:1], "sums": [zstandard.compress(sums, 1)]})

    schema = "page int, part int, sums binary"
    src = _source(docs, "id", "text")
    parts, n = src.mapInArrow(count, schema), src.rdd.getNumPartitions()
    while n > 1:  # at most FAN sums of a page at once, whatever the number of partitions
        n = -(-n // FAN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(n))).groupBy("page", "part").applyInPandas(add, schema)
    sums = {r["page"]: bytes(r["sums"]) for r in parts.collect()}  # they stay compressed: the driver unpacks one at a time

    def unpacked() -> Iterator[np.ndarray]:
        for page in range(cells // PAGE):
            yield np.frombuffer(zstandard.decompress(sums[page]), np.uint32) if page in sums else np.zeros(PAGE, np.uint32)

    total, some = 0, []
    for page in unpacked():
        total += int(page.sum(dtype=np.uint64))
        some.append(page[:: max(1, cells >> 18)].copy())
    usual, some = max(16.0, 3.0 * total / cells), np.concatenate(some)
    low = np.unique(np.quantile(some[some <= usual], np.linspace(0, 1, 150)).astype(np.uint32)) if (some <= usual).any() else np.zeros(1, np.uint32)
    levels = np.concatenate([low[low < usual], np.unique((usual * 2 ** (np.arange(90) / 4)).clip(0, 2**32 - 1).astype(np.uint32))])
    classes = np.empty(cells, np.uint8)
    for i, page in enumerate(unpacked()):
        classes[i * PAGE : (i + 1) * PAGE] = np.searchsorted(levels, page)
    return classes, int(np.searchsorted(levels, int(usual))) + 1


def _slack(n: Column | int, num: int, den: int) -> Column | int:
    """How many tokens of a set of n a similar set can lack."""
    need = F.ceil((n * num) / F.lit(den)) if isinstance(n, Column) else -(-n * num // den)
    return n - need


def _prefixes(docs: DataFrame, shared: Broadcast, frequent: int, width: int, num: int, den: int) -> DataFrame:
    """id, n, digest, prefix (the first d + EXTRA tokens in the common order), rare (how many of them are rare). shared: the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in slices(batches):
            n, digest, prefix, rare = [], [], [], []
            for _, s in shingle_sets(b.column(1), width):
                k = len(s)
                cls = table[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort((cls.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")[: _slack(k, num, den) + EXTRA]
                n.append(k)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                prefix.append(s[order].view(np.int64))
                rare.append(int((cls[order] < frequent).sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(rare, pa.int32())],
                ["id", "n", "digest", "prefix", "rare"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, digest binary, prefix array<long>, rare int")


def index_entries(reps: DataFrame, num: int, den: int, combine_up_to: int) -> DataFrame:
    """(sig, node, n, pos) of the single tokens and combinations that two sets at least have; pos: the first token's place."""
    d = _slack(F.col("n"), num, den).cast("int")
    tokens = reps.select("node", "n", d.alias("d"), "rare", F.posexplode(F.slice("prefix", F.lit(1), d + 2)).alias("pos", "token"))
    often = tokens.groupBy(F.col("token").alias("t")).agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("t")
    held = stored(tokens.join(often, F.col("token") == F.col("t")).select("node", "n", "d", (F.col("pos") < F.col("rare")).alias("is_rare"), "pos", "token"), "tokens")
    small = F.col("n") * num <= F.lit(combine_up_to) * den
    large = F.col("n") * den >= F.lit(combine_up_to) * num
    singles = held.where((F.col("pos") <= F.col("d")) & (F.col("is_rare") | large | (F.col("n") < 2))).select(F.col("token").alias("sig"), "node", "n", "pos")
    mine = held.where(small & (F.col("n") >= 2)).groupBy("node", "n", "d").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "is_rare"))).alias("ts")).where("exists(ts, x -> not x.is_rare)")
    combos = mine.select(
        "node", "n", F.explode(F.expr("flatten(transform(filter(ts, x -> not x.is_rare and x.pos <= d), x -> transform(filter(ts, y -> y.pos > x.pos), y -> struct(xxhash64(x.token, y.token) as sig, x.pos as pos))))")).alias("e")
    ).select("e.sig", "node", "n", "e.pos")
    entries = stored(singles.unionAll(combos), "entries")
    # an entry counts if two of its sets can be similar by their sizes
    busy = entries.groupBy(F.col("sig").alias("s")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("s")
    return entries.join(busy, F.col("sig") == F.col("s")).select("sig", "node", "n", "pos")


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of the nodes (node, id, digest). A bitmap of fixed size, built from their ids, spares most other texts the work."""
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << BITMAP_BITS))
    pages = (
        nodes.select("id").withColumn("bit", bit)
        .groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits")).collect()
    )
    bitmap = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in pages:  # of 32768 bits; the first is page 1
        bitmap[(r["page"] - 1) * 4096 : r["page"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in slices(batches):
            where = b.column(2).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(table[where >> 3] >> (where & 7).astype(np.uint8) & 1)
            part = b.take(pa.array(hit))
            digest, tokens = [], []
            for _, s in shingle_sets(part.column(1), width):
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                tokens.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], ["id", "digest", "tokens"])

    kind = docs.schema["id"].dataType.simpleString()
    with lent(docs.sparkSession, bitmap) as shared:  # 8 MB
        flagged = docs.where(F.col("id").isNotNull()).select("id", "text", bit.alias("bit")).mapInArrow(run, f"id {kind}, digest binary, tokens array<long>")
        found = flagged.join(nodes, ["id", "digest"])
        return stored(found.groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs whose sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(den * both >= num * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def _likely(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that share as many of their first tokens as similar sets must: EXTRA, or all that must be common."""
    left, right = (reps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}")) for x in "ab")
    need = F.least(F.lit(EXTRA), F.ceil(F.greatest("na", "nb") * num / F.lit(den)))
    return pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("pa", "pb")) >= need).select("a", "b")


def _can(num: int, den: int) -> Column:
    """Whether (node, n, pos) and (to, to_n, to_pos) can link, the entry's first token being their first common one.

    What is common is then among the tokens from there on. A pair whose first common token
    is another is judged at the entry of that one.
    """
    need = num * (F.col("n") + F.col("to_n"))
    reach = F.least(F.col("n") - F.col("pos"), F.col("to_n") - F.col("to_pos")) * (num + den)
    return (F.col("node") != F.col("to")) & (den * F.least("n", "to_n") >= num * F.greatest("n", "to_n")) & (reach >= need)


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()


def jaccard_components(
    docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, combine_up_to: int = 1000, block: int = 2000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, n_shingles, component_id for every row. Sets link where den * intersection >= num * union, which must be over 1/2.

    ``block``: members of an entry that a task compares with as many others at most.
    """
    if 2 * num <= den:
        raise ValueError("a similarity over 1/2 is needed: the index takes two common tokens for granted")
    src = _source(docs, id_col, text_col)
    with small(docs.sparkSession):
        classes, frequent = frequency_classes(src, width)
        with lent(docs.sparkSession, classes) as shared:
            base = stored(_prefixes(src, shared, frequent, width, num, den), "prefixes")
        del classes, shared  # 16 MB that the driver needs no more
    able = base.where(F.col("id").isNotNull() & (F.col("n") > 0))
    # a node is a class, not an id: rows of one id can have different texts. Numbers last, as the table is read from its files
    equal = able.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("rare").alias("rare"))
    reps = stored(equal.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = stored(index_entries(reps, num, den, combine_up_to), "index")

    def linked(pairs: DataFrame) -> DataFrame:
        likely = stored(_likely(pairs, reps, num, den), "pairs")
        nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        members = stored(nodes.join(reps.select("node", "id", "digest"), "node"), "members")
        with small(docs.sparkSession):
            sets = _sets_of(src, members, width)
        return stored(_verified(likely, sets, num, den), "links")

    # leaders: of each entry the set with the fewest tokens before the shared one (what edits made of
    # it comes first in the order, so the others are likely its edits), and the one with the smallest number
    lead = entries.groupBy(F.col("sig").alias("s")).agg(F.min(F.struct("pos", "node", "n")).alias("near"), F.min(F.struct("node", "n", "pos")).alias("low"))
    heads = lead.select("s", F.explode(F.array_distinct(F.array(F.struct("near.node", "near.n", "near.pos"), "low"))).alias("to")).select("s", F.col("to.node").alias("to"), F.col("to.n").alias("to_n"), F.col("to.pos").alias("to_pos"))
    tried = stored(_pairs(entries.join(heads, (F.col("sig") == F.col("s")) & _can(num, den))), "tried")
    links = linked(tried)
    parts = connected_components(links)

    # the rest: members of one entry that are still in different components
    label = parts.select(F.col("node").alias("p"), F.col("component").alias("c"))
    named = entries.join(label, F.col("node") == F.col("p"), "left").select("sig", "node", "n", "pos", F.coalesce("c", "node").alias("c"))
    mixed = named.groupBy(F.col("sig").alias("s")).agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi and k > 2").select("s", "k")
    rest = stored(named.join(mixed, F.col("sig") == F.col("s")).select("sig", "node", "n", "pos", "c", F.ceil(F.col("k") / block).cast("int").alias("blocks")), "rest")
    # an entry of many sets is dealt over blocks; every two blocks, and each with itself, meet in a task of their own
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    left = rest.withColumn("i", home).withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1)))
    right = rest.withColumn("j2", home).withColumn("i2", F.explode(F.sequence(F.lit(0), "j2")))
    other = right.select(F.col("sig").alias("s2"), "i2", "j2", F.col("node").alias("to"), F.col("n").alias("to_n"), F.col("pos").alias("to_pos"), F.col("c").alias("c2"))
    met = (F.col("sig") == F.col("s2")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2"))
    crossed = left.join(other, met & ((F.col("i") < F.col("j")) | (F.col("node") < F.col("to"))) & (F.col("c") != F.col("c2")) & _can(num, den))
    more = stored(_pairs(crossed).join(tried, ["a", "b"], "left_anti"), "more")
    final = connected_components(links.unionAll(linked(more))) if not more.isEmpty() else parts

    label = final.select(F.col("node").alias("p"), F.col("component").alias("c"))
    placed = reps.select(F.col("digest").alias("k"), "node", F.col("id").alias("i")).join(label, F.col("node") == F.col("p"), "left").select("k", "i", F.coalesce("c", "node").alias("c"))
    least = placed.groupBy("c").agg(F.min("i").alias("component"))
    classes = placed.join(least, "c").select("k", "component")
    out = base.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("digest")).alias("digest"))
    return out.join(classes, F.col("digest") == F.col("k"), "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, whole, without near-duplicates: of each component the document with the smallest id.

    Rows with a null id, and those without words, stay. Equal rows of one id are one
    document; rows of one id and different texts stay or go together.
    """
    joined = jaccard_components(docs, width=width, num=num, den=den, id_col=id_col, text_col=text_col)
    stays, digest = unused(docs, "stays", "digest")
    stay = joined.where(F.col("id") == F.col("component_id")).select(F.col("id").alias(stays)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(stay, F.col(id_col) == F.col(stays), "left_semi")
    once = named.withColumn(digest, F.md5(F.col(text_col).cast("string"))).dropDuplicates([id_col, digest])
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col(id_col).isNull()))
