"""The queries opN_<name> as they are registered, and the pipeline's stages, against brute force over whole tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lodestone.llm import catalog, langid, license_scan, mixing, ngram_join, secret_scan, suffix_dedup
from tests.llm.data import documents, near, sentence
from tests.llm.test_pair_operators import Groups, _jaccard, passages_hold
from tests.llm.test_text_operators import _alike, _base, _fingerprint, _secrets, packed, unpacked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r["text"] for r in catalog.documents(spark, SF).collect()}


def got(spark, name):
    return entry.queries()[name](spark, SF).collect()


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op1(spark, rows):
    order = sorted(rows, reverse=True)
    found = {r["doc_id"]: r for r in got(spark, "op1_fingerprints")}
    assert found.keys() == rows.keys()
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        mine, following = rows[i] or "", rows[j] or ""
        k = len(mine) // 3
        edited = mine[: len(mine) - k] + following[:k]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(mine), sha(edited.encode()), _fingerprint(mine), _fingerprint(edited))
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(_alike(mine, edited)), pytest.approx(_alike(mine, following)))


def test_op2(spark, rows):
    found = got(spark, "op2_packing")
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == unpacked(rows.items())
    assert packed(found) > 0.97


def test_op3(spark, rows):
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    found = {r["doc_id"]: r for r in got(spark, "op3_secrets")}
    assert found.keys() == rows.keys()
    for i, t in rows.items():
        spans = _secrets(t or "", secret_scan.RULES)
        base = [s for s in spans if s[0] in kinds]
        text = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
        want = (*[sum(s[0] == k for s in base) for k in kinds], sha(text(base).encode()), text(spans))
        assert tuple(found[i][c] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")) == want


def test_op4(spark, rows):
    import regex

    found = {r["doc_id"]: r for r in got(spark, "op4_licenses")}
    assert found.keys() == rows.keys()
    notices = [license_scan.compile_notice(*n) for n in license_scan.NOTICES]
    for i, t in rows.items():
        n_words, n_base, first, last, base = _base(t or "")
        joined = b" " + b" ".join(license_scan.words(t or "")) + b" "
        # without seeds, which takes long: texts of a usual size
        fuzzy = {n.label for n in notices if regex.search(rf"(?:{regex.escape(n.text, special_only=True)}){{e<={n.edits}}}", joined.decode())} if len(joined) < 500 else None
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n_words, n_base, first, last, ",".join(base))
        assert fuzzy is None or r["labels"] == ",".join(sorted({*base, *fuzzy}))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_op5(spark, rows):
    langs = {r["doc_id"]: r["lang"] for r in catalog.documents(spark, SF).collect()}
    found = got(spark, "op5_language_id")
    assert sorted(r["doc_id"] for r in found) == sorted(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and langs[r["doc_id"]]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)
    again = {r["doc_id"]: r["score"] for r in got(spark, "op5_language_id")}
    assert all(again[r["doc_id"]] == r["score"] for r in found)


def test_op6(spark):
    vectors = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    sound = [(i, np.array(v, float), c) for i, v, c in vectors if v is not None and c is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit, label = np.array([v / np.sqrt(v @ v) for _, v, _ in sound]), np.array([c for *_, c in sound])
    hit = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    want = dict.fromkeys([i for i, *_ in vectors], 0) | {i: int(n) for (i, *_), n in zip(sound, hit.sum(axis=1), strict=True)}
    found = {r["vec_id"]: r for r in got(spark, "op6_embedding_dedup")}
    assert found.keys() == want.keys() and all(r["n_links"] <= want[i] for i, r in found.items())
    assert sum(r["n_links"] for r in found.values()) >= 0.9 * sum(want.values())
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


def test_op7(spark, rows):
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got(spark, "op7_ngram_join"))
    assert found == _jaccard(list(rows.items()), 3, 90, 100)


@pytest.mark.parametrize("name", ["op8_warc", "op10_mixing"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert Counter(tuple(r[c] for c in names) for r in got(spark, name)) == Counter(want.fetchall())


def _removed(texts, length):
    """By brute force: flags of the bytes covered by strings that start anywhere else."""
    where = defaultdict(list)
    raws = [(t or "").encode() for t in texts]
    for k, raw in enumerate(raws):
        for s in range(len(raw) - length + 1):
            where[hashlib.blake2b(raw[s : s + length], digest_size=16).digest()].append((k, s))
    steps = [np.zeros(len(raw) + 1, np.int64) for raw in raws]
    for places in where.values():
        if len(places) > 1:
            for k, s in places:
                steps[k][s] += 1
                steps[k][s + length] -= 1
    return [(raw, np.cumsum(s)[:-1] > 0) for raw, s in zip(raws, steps, strict=True)]


def _digests(raw, gone):
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    return len(raw), int(gone.sum()), len(edge) // 2, sha(bytes(np.frombuffer(raw, np.uint8)[~gone]))


def test_op9(spark, rows):
    want = Counter((i, *_digests(*x)) for i, x in zip(rows, _removed(rows.values(), 400), strict=True))
    found = got(spark, "op9_suffix_dedup")
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == want
    passages_hold(list(rows.items()), [(r["doc_id"], r["shared_words"]) for r in found], 51, suffix_dedup.SHINGLE)


def test_texts_over_the_chunk_sizes(spark):
    """Repeats, shingles and n-gram counts across the borders of segments and chunks."""
    rng = random.Random(4)
    long = sentence(rng, 190_000)
    assert len(long) > ngram_join.CHUNK > suffix_dedup.SEGMENT
    border = long[suffix_dedup.SEGMENT - 700 : suffix_dedup.SEGMENT + 500]
    texts = [long, "before " + border + " behind", near(rng, long, 50), sentence(rng, 100)]
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    removed = suffix_dedup.remove_repeats(docs, length=400, keep="none")
    found = {r["id"]: r for r in removed.select("id", *suffix_dedup.digest_columns(removed)).collect()}
    for i, x in enumerate(_removed(texts, 400)):
        assert tuple(found[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == _digests(*x)
    joined = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect())
    assert joined == _jaccard(list(enumerate(texts)), 5, 80, 100)
    whole = langid.frequencies(long)
    assert whole.sum() == pytest.approx(1) and np.abs(whole - langid.frequencies(long[:500_000])).max() < 0.01


CLASHES = "size n k of takens taken stays digest __size __k __id __text __n".split()


def test_clashing_columns(spark):
    """Columns named like those used inside come through as they were."""
    docs = documents(spark)
    rich = docs
    for c in CLASHES:
        rich = rich.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for stage in (langid.keep_identified, ngram_join.keep_one_of_each, secret_scan.redact, mixing.mixed_documents):
        some = rich.withColumn("lang", F.lit("xx"))
        plain = docs.withColumn("lang", F.lit("xx"))
        out = stage(some)
        assert out.columns == some.columns
        rows = out.collect()
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in stage(plain).collect())
        assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in CLASHES)


def test_the_join_refuses_low_thresholds(spark):
    with pytest.raises(ValueError, match="over 1/2"):
        ngram_join.jaccard_components(documents(spark), num=50, den=100)


def test_crowded_entries_are_split(spark, monkeypatch):
    """Blocks of two members at most, all tokens frequent, unlike texts around one passage: the same links."""
    whole = ngram_join.frequency_classes
    monkeypatch.setattr(ngram_join, "frequency_classes", lambda docs, width: (whole(docs, width)[0], 0))
    rng = random.Random(12)
    shared = sentence(rng, 60)
    texts = [f"{sentence(rng, 3)} {shared} {sentence(rng, rng.randrange(1, 9))}" for _ in range(30)] + [sentence(rng, 40) for _ in range(5)]
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    found = Counter((r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, width=3, num=85, block=2).collect())
    assert found == _jaccard(list(enumerate(texts)), 3, 85, 100)


# the pipeline


def test_pipeline_stages_are_brute_force(spark):
    docs = catalog.documents(spark, SF)
    made, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).persist()
        made[name] = kept.collect()
    whole = {r["doc_id"]: r for r in docs.collect()}
    letters = {i for i, r in whole.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    first = {r["doc_id"] for r in made["language_id"]}
    assert first <= letters and len(first) >= 0.97 * len(letters)
    second = [(r["doc_id"], r["text"]) for r in made["ngram_jaccard_join"]]
    assert {i for i, _ in second} == {i for i, _, c in _jaccard([(i, whole[i]["text"]) for i in first], 5, 80, 100) if i == c}

    third = {r["doc_id"]: r["text"] for r in made["secret_scans"]}
    for i, t in second:
        out, at = [], 0
        for kind, s, e in _secrets(t, secret_scan.RULES):
            out += [t[at:s], f"<{kind}>"] if s >= at else []
            at = max(at, e)
        assert third[i] == "".join([*out, t[at:]])

    words = lambda t: re.findall(mixing.WORD, t or "")
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame([(i, t, whole[i]["source"]) for i, t in third.items()], "doc_id long, text string, source string").toPandas())
    plan = {i: (size, taken) for i, size, _, _, taken in con.execute(mixing.SQL).fetchall()}
    fourth = defaultdict(list)
    for r in made["mixing"]:
        fourth[r["doc_id"]].append(r["text"])
    assert set(fourth) == {i for i, (_, taken) in plan.items() if taken}
    for i, (size, taken) in plan.items():
        texts = sorted(fourth.get(i, []), key=len, reverse=True)
        assert texts[: taken // size if size else 0] == [third[i]] * (taken // size if size else 0)
        assert sum(len(words(t)) for t in texts) == taken and all(third[i].startswith(t) for t in texts)

    fifth = made["packing"]
    assert Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in fifth) == Counter(k[1:] for k in unpacked([(r["doc_id"], r["text"]) for r in made["mixing"]]).elements())
    assert packed(fifth) > 0.97


def test_components_are_named_by_their_least():
    g = Groups()
    g.join(5, 3), g.join(3, 4)
    assert {g.find(x) for x in (3, 4, 5)} == {3}
