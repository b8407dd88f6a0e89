"""Near-duplicates, WARC bundles, repeats and mixing against brute force and round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import catalog, components, mixing, multi_index, ngram_join, suffix_dedup, warc
from tests.llm.data import documents, empty, near, sentence

SF = "/root/testdata/sf0.001"


class Groups:
    def __init__(self):
        self.of = {}

    def find(self, x):
        while self.of.setdefault(x, x) != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.of[b] = a


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    g = Groups()
    for a, b in links:
        g.join(a, b)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: g.find(x) for x in list(g.of) if g.find(x) != x}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# n-gram Jaccard join


def _shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def _jaccard(rows, width, num, den):
    sets = [(i, _shingles(t, width)) for i, t in rows]
    g = Groups()
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if i is not None and j is not None and s and t and den * len(s & t) >= num * len(s | t):
                g.join(i, j)
    return Counter((i, len(s), None if i is None else g.find(i)) for i, s in sets)


@pytest.mark.parametrize(("width", "num", "up_to"), [(3, 90, 1000), (5, 80, 1000), (3, 90, 40)])
def test_jaccard_components(spark, width, num, up_to):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = ngram_join.jaccard_components(docs, width=width, num=num, combine_up_to=up_to).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == _jaccard(rows, width, num, 100)


def test_jaccard_frequent_tokens(spark, monkeypatch):
    """With all tokens frequent, combinations alone must find every link."""
    whole = ngram_join.frequency_classes
    monkeypatch.setattr(ngram_join, "frequency_classes", lambda docs, width: (whole(docs, width)[0], 0))
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = ngram_join.jaccard_components(docs, width=3, num=90).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == _jaccard(rows, 3, 90, 100)


def test_jaccard_of_one_id_with_two_texts(spark):
    rng = random.Random(9)
    a, b, c, d = (sentence(rng, 150) for _ in range(4))
    like = lambda t: near(rng, t, 1)
    rows = [(1, a), (1, b), (2, like(a)), (3, like(b)), (5, c), (5, d), (4, like(c)), (6, like(d)), (7, "of itself")]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    got = Counter((r["id"], r["component_id"]) for r in ngram_join.jaccard_components(docs, width=5, num=80).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (5, 4), (4, 4), (5, 5), (6, 5), (7, 7)])


def test_jaccard_edges(spark):
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    docs = documents(spark)
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in _jaccard([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100) if i == c}
    assert {r["doc_id"] for r in kept.collect()} == want | {None}
    assert kept.where("doc_id is not null").count() == len(want - {None})


# embeddings


def _vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(60):
        x = rng.normal(size=16)
        for k in range(int(rng.integers(1, 7))):
            y = x + rng.normal(size=16) * 0.08 * k
            rows.append((len(rows), [float(v) for v in y * rng.uniform(0.5, 2)], c % 3))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(5)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [1.0, None] * 8, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [float("inf")] * 16, 0), (n + 6, [], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, id int, node string").repartition(3)


@pytest.mark.parametrize("block", [2000, 3])
def test_near_vectors(spark, block):
    rows, frame = _vectors(spark)
    sound = [(i, np.array(v), c) for i, v, c in rows if i is not None and v and c is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    g, links, pairs = Groups(), Counter(), 0
    for k, (i, v, c) in enumerate(sound):
        for j, w, d in sound[:k]:
            if c == d and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                g.join(i, j)
                links.update([i, j])
                pairs += 1
    got = {r["id"]: r for r in multi_index.near_duplicates(frame, block=block, per_cell=2).collect()}
    assert len(got) == len(rows) and sum(r["n_links"] for r in got.values()) >= 0.9 * 2 * pairs
    assert all(r["n_links"] <= links[i] for i, r in got.items())
    missed = sum(r["component_id"] != g.find(i) for i, r in got.items() if i is not None)
    assert missed <= 0.05 * len(rows) and all(r["kept"] == (i is not None and r["component_id"] == i) for i, r in got.items())
    for i, v, c in rows:
        if i is not None and (c is None or not v or None in v):
            assert (got[i]["n_links"], got[i]["component_id"]) == (0, i)


def test_blocks_count_every_pair_once():
    rng = np.random.default_rng(0)
    x = multi_index.units(np.concatenate([rng.normal(size=(5, 8)) + 3] * 4 + [rng.normal(size=(10, 8))]))
    m = rng.integers(1, 4, len(x))
    r, q, forest = multi_index.link_block(x[:12], m[:12], x[12:], m[12:], 0.93)
    hit = x @ x.T >= 0.93
    np.fill_diagonal(hit, False)
    hit[12:, 12:] = False
    assert (np.concatenate([r, q]) == hit @ m).all()
    assert len(forest) <= len(x) - 1


def test_traversal_is_in_order():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.sort(rng.random(rng.integers(1, 9))) for _ in range(2))
        margin = float(rng.random())
        got = list(multi_index.traverse(a.tolist(), b.tolist(), margin))
        sums = [a[i] + b[j] for i, j in got]
        assert sums == sorted(sums)
        assert set(got) == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= a[0] + b[0] + margin}


@pytest.mark.parametrize("kind", ["isotropic", "half", "subspace"])
def test_recall_of_pairs_at_the_threshold(spark, kind):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3000, 64)) if kind != "subspace" else rng.normal(size=(3000, 8)) @ rng.normal(size=(8, 64))
    x = multi_index.units(base)
    away = rng.normal(size=x.shape) if kind != "subspace" else multi_index.units(base[rng.permutation(3000)])
    away[:, 32:] *= kind != "half"
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.sqrt((away**2).sum(axis=1, keepdims=True))
    every = np.concatenate([x, 0.932 * x + np.sqrt(1 - 0.932**2) * away])
    want = np.zeros(len(every), np.int64)
    for at in range(0, len(every), 1000):
        want[at : at + 1000] = (every[at : at + 1000] @ every.T >= 0.93).sum(axis=1) - 1
    assert want.sum() >= 2 * 1000
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["id"]: r["n_links"] for r in multi_index.near_duplicates(frame).collect()}
    assert all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.9 * want.sum()


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.1], 0), (1, [0.0, 1.0, 0.2, 0.0], 0), (2, [1.0, 0.0, 0.0, 0.12], 0), (3, [0.0, 1.0, 0.22, 0.0], 0), (4, [0.0, 0.0, 1.0, -1.0], 0)]
    got = sorted((r["id"], r["n_links"]) for r in multi_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 0)]


def test_no_vectors(spark):
    assert multi_index.near_duplicates(_vectors(spark)[1].limit(0)).count() == 0


# WARC


PAGES = [(1, "http://a", "x"), (2, "http://b", "x"), (3, "http://c", None), (4, "http://d\n e", ""), (5, None, "é" * 300_000), (7, "http://f", "\r\n\r\nWARC/1.1\r\n"), (6, "http://g", "x"), (None, "http://h", "x"), (8, "http://i", "y"), (8, "http://i", "y")]


def _pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, sha string, n int").repartition(2)


@pytest.mark.parametrize("least", [0, 1])
def test_warc_round_trip(spark, least):
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(_pages(spark), least_bytes=least).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        first = min(j for j, _, x in PAGES if (x or "") == (h or "") and j is not None) if len(raw) >= least else i
        revisit = first != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_bundles_seek(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "page %d " % i * (i % 90)) for i in range(400)]
    index = warc.write_bundles(_pages(spark, rows), str(tmp_path)).persist()
    assert index.count() == 400 and index.agg(F.max("frame")).first()[0] >= 1
    some = index.where("cast(id as int) % 37 = 0")
    got = {int(r["page_id"]): r["payload"] for r in warc.fetch(some, str(tmp_path), with_payload=True).collect()}
    assert got == {i: h for i, _, h in rows if i % 37 == 0 and not (i and h == "")} | {i: None for i, _, h in rows if i % 37 == 0 and i and h == ""}
    import zstandard

    records = 0
    for path in tmp_path.glob("*.warc.zst"):
        with path.open("rb") as f:  # an ordinary decoder reads all frames and skips the table
            records += zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().count(b"WARC/1.1\r\n")
    assert records == len(rows) and not list(tmp_path.glob(".part*"))


def test_no_pages(spark):
    assert warc.round_trip(_pages(spark).limit(0)).count() == 0


# repeats


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def _repeats(rows, length, keep):
    where = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        for s in range(len(raw) - length + 1):
            where[raw[s : s + length]].append(((i is not None, i or 0), _signed(xxhash.xxh64(raw, seed=42).intdigest()), s, k))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for places in where.values():
        first = min(places)[:3]
        for p in places:
            if len(places) > 1 and (keep == "none" or p[:3] != first):
                gone[p[3]][p[2] : p[2] + length] = True
    out = []
    for (i, t), g in zip(rows, gone, strict=True):
        kept = bytes(np.frombuffer((t or "").encode(), np.uint8)[~g])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]])))
        out.append((i, kept, tuple(map(tuple, edge.reshape(-1, 2).tolist()))))
    return Counter(out)


def passages_hold(rows, found, passage, size):
    """Words in shingles looked up: at least one of every run of ``passage`` words of another document, none that no other has."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    where = defaultdict(set)
    for (i, t), w in zip(rows, words, strict=True):
        for k in (size, passage):
            for s in range(len(w) - k + 1):
                where[tuple(w[s : s + k])].add((i, t))
    left = Counter(found)
    for (i, _), w in zip(rows, words, strict=True):
        runs = any(len(where[tuple(w[s : s + passage])]) > 1 for s in range(len(w) - passage + 1))
        most = len({j for s in range(len(w) - size + 1) if len(where[tuple(w[s : s + size])]) > 1 for j in range(s, s + size)})
        fit = [n for (k, n), c in left.items() if k == i and c and (n >= size if runs else n == 0 or n >= size) and n <= most]
        assert fit, (i, runs, most, [n for (k, n) in found if k == i])
        left[i, fit[0]] -= 1
    assert not +left


@pytest.mark.parametrize(("length", "keep", "group"), [(60, "none", 1500), (60, "first", 1500), (60, "none", 2), (60, "first", 2), (20, "none", 1500)])
def test_remove_repeats(spark, length, keep, group):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = suffix_dedup.remove_repeats(docs, length=length, keep=keep, group=group, passage=12).collect()
    assert Counter((r["id"], bytes(r["kept"]), tuple((s["start"], s["end"]) for s in r["spans"])) for r in got) == _repeats(rows, length, keep)
    passages_hold(rows, [(r["id"], r["shared_words"]) for r in got], 12, 12)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeats_of_hot_classes_and_periodic_texts(spark, monkeypatch, keep):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "SHINGLE", 5)
    rng = random.Random(3)
    base = [sentence(rng, 60) for _ in range(4)]
    texts = ["x" * 900, "ab" * 400 + base[0], base[0] + "x" * 500, "abc " * 300, *base * 5, *[base[1] + sentence(rng, 3) + base[2] for _ in range(6)], sentence(rng, 400)]
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = suffix_dedup.remove_repeats(docs, length=60, keep=keep, group=3, passage=12).collect()
    rows = list(enumerate(texts))
    assert Counter((r["id"], bytes(r["kept"]), tuple((s["start"], s["end"]) for s in r["spans"])) for r in got) == _repeats(rows, 60, keep)
    passages_hold(rows, [(r["id"], r["shared_words"]) for r in got], 12, 5)


def test_repeats_edges(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="keep"):
        suffix_dedup.remove_repeats(empty(spark), keep="last")


def test_previous_factors():
    rng = random.Random(1)
    for _ in range(100):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 40)))
        length = rng.choice([1, 2, 3, 5, 9, 16, 30])
        common = lambda i, j: next((k for k in range(len(t) - max(i, j)) if t[i + k] != t[j + k]), len(t) - max(i, j))  # noqa: B023, E731
        starts = np.arange(len(t))
        before, behind = suffix_dedup.longest_previous_factors(suffix_dedup.suffix_ranks(np.frombuffer(t, np.uint8), length), starts)
        assert before.tolist() == [min(length, max((common(i, j) for j in range(i)), default=0)) for i in starts]
        assert behind.tolist() == [min(length, max((common(i, j) for j in range(i + 1, len(t))), default=0)) for i in starts]
        if len(t) >= 5:
            matched, earlier, _ = suffix_dedup.block_factors([t], 5)
            n = len(t) - 4
            assert earlier.tolist() == [any(t[i : i + 5] == t[j : j + 5] for j in range(i)) for i in range(n)]
            assert matched.tolist() == [sum(t[i : i + 5] == t[j : j + 5] for j in range(n)) > 1 for i in range(n)]


# mixing


def test_targets():
    rng = random.Random(8)
    for _ in range(200):
        totals = [(f"s{k}", rng.randrange(0, 1000) if rng.random() < 0.8 else 0) for k in range(rng.randrange(1, 8))] + [(None, 5)]
        got = mixing.targets(totals)
        order = sorted(s for s, _ in totals if s is not None) + [None]
        weight, size = {s: i % 3 + 1 for i, s in enumerate(order)}, dict(totals)
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(weight[s] * mid, 3 * size[s]) for s in order) < sum(size.values()) else (low, mid)
        assert all(got[s] == pytest.approx(min(weight[s] * high, 3 * size[s]), abs=1e-3) for s in order)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_mix(spark):
    docs = documents(spark)
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(documents(spark, partitions=7)).collect()
    assert Counter(rows) == Counter(again) and len(rows) == docs.count()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(taken[s] == int(target[s]) for s in target)
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    words = Counter()
    for r in made.collect():
        words[r["source"]] += len(re.findall(mixing.WORD, r["text"]))
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix_sources(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


# pipeline


def test_pipeline(spark):
    docs = documents(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF).persist()
        assert made.columns == columns or name == "packing"
        sizes.append(made.count())
        if name == "language_id":
            assert {r["doc_id"] for r in made.collect()} == {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
        if name == "ngram_jaccard_join":
            want = {i for i, _, c in _jaccard([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100) if i == c}
            assert {r["doc_id"] for r in made.collect()} - {None} == want - {None}
        if name == "secret_scans":
            assert sizes[-1] == sizes[-2]
        docs = made
    assert all(sizes)
    none = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


def test_query_names():
    names = catalog.queries()
    assert [k.split("_")[0] for k in names] == [f"op{n}" for n in range(1, 11)]
    assert set(catalog.oracle_sql()) <= set(names)


def test_frequency_classes_take_little_of_the_driver(spark):
    """One page of counts is unpacked at a time; the classes are those of all counts at once."""
    rng = random.Random(9)
    rows = [(i, "many words that all have " + sentence(rng, 400), None, None) for i in range(300)]
    docs = documents(spark, rows)
    src = ngram_join._source(docs, "doc_id", "text")
    tracemalloc.start()
    try:
        classes, frequent = ngram_join.frequency_classes(src, 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    cells = 1 << ngram_join.SKETCH_BITS
    assert peak < 3 * cells  # the counts alone took 4 bytes a cell before

    counts = np.zeros(cells, np.uint32)
    for _, s in ngram_join.shingle_sets(pa.array([t for _, t, _, _ in rows]), 2):
        counts[(s >> np.uint64(64 - ngram_join.SKETCH_BITS)).astype(np.int64)] += 1
    assert (counts > 16).any() and ((classes >= frequent) == (counts > 16)).all()
    seen = [(int(classes[counts == n].min()), int(classes[counts == n].max())) for n in np.unique(counts)]
    assert all(a == b for a, b in seen) and seen == sorted(seen)


def test_join_drops_its_broadcasts(spark, monkeypatch):
    made, gone = [], []
    kind = type(spark.sparkContext.broadcast(None))
    begin, end = kind.__init__, kind.destroy
    monkeypatch.setattr(kind, "__init__", lambda self, *a, **b: (begin(self, *a, **b), made.append(self._jbroadcast.id()))[0])
    monkeypatch.setattr(kind, "destroy", lambda self, *a, **b: (gone.append(self._jbroadcast.id()), end(self, *a, **b))[1])
    assert ngram_join.jaccard_components(documents(spark)).count() == documents(spark).count()
    assert made and sorted(made) == sorted(gone)
