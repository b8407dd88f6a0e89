"""Fingerprints, packing, secrets, licenses and language ID against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import catalog, fingerprint, langid, license_scan, packing, secret_scan
from tests.llm.data import documents, empty

SF = "/root/testdata/sf0.001"


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# fingerprints


def _fingerprint(text):
    paras = [hashlib.sha256(p.encode()).hexdigest()[:32] for p in text.split("\n")]
    marked = "".join(d + ("|" if d[-1] < "4" else "") for d in paras)
    sects = [hashlib.sha256(s.encode()).hexdigest()[:32] for s in marked.split("|") if s]
    return hashlib.sha256("".join(sects).encode()).hexdigest() + ":" + "".join(sects)


def _leaves(text):
    """Cut character by character, by the rule in words."""
    marked = lambda c: (33 < ord(c) < 127 and ord(c) % 2 == 0) or "\x80" <= c <= "\uffff"
    other = lambda c: 32 < ord(c) < 127 and ord(c) % 2 == 1
    blank = " \t\n\x0b\x0c\r"
    out = Counter()
    for line in text.split("\n"):
        at = 0
        for i in range(1, len(line) + 1):
            before = line[max(0, i - 24) : i]
            word = len(before) > 1 and before[-1] in blank and marked(before[-2])
            run = len(before) == 24 and not set(before) & set(blank) and all(33 < ord(c) < 127 and ord(c) % 2 == m for c, m in zip(before[20:], (0, 1, 0, 0), strict=True) if m == 0) and other(before[21])
            if i - at == 96 or (i - at >= 8 and (word or run or before[-1] in "\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f")):
                out[line[at:i]] += 1
                at = i
        if at < len(line):
            out[line[at:]] += 1
    return out


def _alike(a, b):
    if a == b:
        return 1.0
    size = lambda c: sum(len(p) * n for p, n in c.items())
    x, y = _leaves(a), _leaves(b)
    return 2 * size(x & y) / (size(x) + size(y)) if x or y else 0.0


@pytest.mark.parametrize("source", ["odd", "table"])
def test_fingerprints(spark, source):
    docs = documents(spark).dropDuplicates(["doc_id"]) if source == "odd" else catalog.documents(spark, SF)
    text = {i: t or "" for i, t in rows_of(docs)}
    order = sorted(text, key=lambda i: (i is None, -(i or 0)))
    got = {r["id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}
    assert got.keys() == text.keys()
    for at, i in enumerate(order):
        mine, following = text[i], text[order[(at + 1) % len(order)]]
        k = len(mine) // 3
        edited = mine[: len(mine) - k] + following[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(mine), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (_fingerprint(mine), _fingerprint(edited))
        assert r["near_edited"] == pytest.approx(_alike(mine, edited)) and r["near_next"] == pytest.approx(_alike(mine, following))


def test_fingerprints_of_repeated_rows_and_none(spark):
    docs = documents(spark, [(1, "a b", None, None), (1, "a b", None, None), (1, "c", None, None), (2, "long text", None, None)])
    got = sorted((r["id"], r["edited_sha256"]) for r in fingerprint.edited_fingerprints(docs).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, sha("a l")), (1, sha("a l")), (1, sha("c")), (2, sha("long ta b"))])
    assert fingerprint.edited_fingerprints(empty(spark)).count() == 0


def test_differing_branches_locate_edits(spark):
    lines = [f"paragraph {i} of the text" for i in range(60)]
    left = {1: "a\nb\nc\nd", 2: "a\nb", 3: "a\na\na", 4: "same\ntext", 5: "\n".join(lines), 6: "\n".join(lines), None: "x\ny"}
    right = {1: "a\nb\nX\nd", 2: "b\na", 3: "a\na", 4: "same\ntext", 5: "\n".join([*lines[:30], "one more", *lines[30:]]), 6: "\n".join([*lines[:10], *lines[11:]]), None: "x\nz"}
    trees = [fingerprint.tree(documents(spark, [(i, t, None, None) for i, t in side.items()])) for side in (left, right)]
    got = sorted(((r["id"], r["side"], r["paragraph"], r["kind"]) for r in fingerprint.locate_edits(*trees).collect()), key=str)
    want = [(1, "left", 2, "changed"), (1, "right", 2, "changed"), (2, "left", 0, "moved"), (2, "left", 1, "moved"), (2, "right", 0, "moved"), (2, "right", 1, "moved"), (3, "left", 2, "changed")]
    assert got == sorted([*want, (5, "right", 30, "changed"), (6, "left", 10, "changed"), (None, "left", 1, "changed"), (None, "right", 1, "changed")], key=str)
    none = fingerprint.tree(empty(spark))
    assert fingerprint.locate_edits(none, trees[1]).count() == 0


def test_edits_leave_the_other_pieces_alike(spark):
    rng = random.Random(5)
    words = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(400))  # one line, no clause ends
    run = "".join(rng.choices("abcdefghijklmnop", k=3000))  # no blanks either
    docs = documents(spark, [(1, "y " * 900, None, None), (2, words, None, None), (3, run, None, None), (4, "x" * 3000, None, None)])
    got = {r["id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}
    for i in (2, 3, 4):
        assert 0.5 < got[i]["near_edited"] < 0.9 and got[i]["near_next"] < 0.1
    inserted = documents(spark, [(1, words, None, None), (2, "one more " + words, None, None), (3, run, None, None), (4, "q" + run, None, None)])
    pieces = {r["id"]: (r["pieces"], set(r["pieces"])) for r in fingerprint.tree(inserted).collect()}
    assert all(len(p) == len(s) > 30 for p, s in pieces.values())
    assert len(pieces[1][1] & pieces[2][1]) >= len(pieces[1][0]) - 2 and len(pieces[3][1] & pieces[4][1]) >= len(pieces[3][0]) - 4


# packing


def unpacked(rows):
    """(id, start, length, crc, tokens) of the pieces, straight from the tokenizer."""
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(catalog.tokenizer_path()), Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            part = ids[s : s + 2048]
            want[i, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)] += 1
    return want


def packed(got):
    """Checks that the sequences are gapless and not too long; returns how full they are."""
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(n for p in by.values() for _, n in p) / (2048 * len(by)) if by else 1.0


@pytest.mark.parametrize("source", ["odd", "table", "empty"])
def test_packing(spark, source):
    docs = documents(spark) if source == "odd" else catalog.documents(spark, SF) if source == "table" else empty(spark)
    got = packing.pack_documents(docs, catalog.tokenizer_path()).collect()
    assert Counter((r["id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == unpacked(rows_of(docs))
    assert packed(got) > (0.97 if source == "table" else 0)


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    enc, tok = packing._Encoder(catalog.tokenizer_path()), Tokenizer.from_file(catalog.tokenizer_path())
    for t in ["it's don'T <|endoftext|> A<|ENDOFTEXT|>b ÉÀÿ 12ab3 ...'re ẞ İx H̱ \x1cq\x85z 東京 ''s ßµ ª½² 😀", "\x00a\x7f\x80b", "", "é É"]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_plans_use_up_the_histogram():
    rng = np.random.default_rng(1)
    for _ in range(20):
        h = np.zeros(65, np.int64)
        h[1:] = rng.integers(0, 30, 64) * rng.integers(0, 2, 64)
        used = np.zeros(65, np.int64)
        for lengths, times in packing.plan_windows(h, 64):
            assert sum(lengths) <= 64 and times > 0
            for v in lengths:
                used[v] += times
        assert (used == h).all()
    combos = packing.shallow_combinations(np.array([0, 0, 5, 0, 0, 0, 5, 0, 0]), 8)
    assert [tuple(c) for c in combos] == [(2, 6, 0)] or (2, 6, 0) in {tuple(c) for c in combos}
    assert packing.nnls_repeats(np.array([[2, 6, 0]]), np.array([0, 0, 5, 0, 0, 0, 5, 0, 0]))[0] == pytest.approx(5)


# secrets

SECRETS = [
    "password = hunter22 and TOKEN:'abcdef' api_key=\"A.b/c+d=e\" secret: short", "token=secret=abcdefgh ApiKey: x12345", "AKIA" + "A1B2" * 4 + " AKIASHORT",
    "0123456789abcdef01234567 0123456789abcdef0123456", "é passwd:  'ünï' pass password:abcdefg😀 token : zzzzzz", "ſecret=abcdefgh toKen=abcdefgh Key",
    "-----BEGIN RSA PRIVATE KEY-----\nabc", "ghp_" + "a1" * 20, "https://user:pass@host/x", "eyJhbGciOiJI.eyJzdWIiOiIx.abc-_", "",
]


def _secrets(text, rules):
    out = []
    for k, rule in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [(rules[k].kind, s, e) for s, k, e in sorted(out)]


@pytest.mark.parametrize("source", ["made", "odd", "table", "empty"])
def test_secret_scan_is_a_full_scan(spark, source):
    made = [(i, t, None, None) for i, t in enumerate(SECRETS * 40)]
    docs = {"made": lambda: documents(spark, made), "odd": lambda: documents(spark), "table": lambda: catalog.documents(spark, SF), "empty": lambda: empty(spark)}[source]()
    got = Counter((r["id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in secret_scan.scan_secrets(docs).collect())
    assert got == Counter((i, tuple(_secrets(t or "", secret_scan.RULES))) for i, t in rows_of(docs))


def test_trigram_queries():
    derive = secret_scan.derive
    assert derive("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    assert derive("[0-9a-f]{24,}") is True and derive("ab|[xy]+") is True
    assert derive("x{3}y?") == b"xxx" or secret_scan.trigrams(derive("x{3}y?")) == {b"xxx", b"xxy"}
    assert secret_scan.trigrams(derive("api_?key")) >= {b"api", b"key", b"i_k", b"pik"}
    for rule in secret_scan.RULES:
        query, wanted = derive(rule.pattern), secret_scan.trigrams(derive(rule.pattern))
        for t in SECRETS:
            if re.search(rule.pattern, t):
                assert secret_scan.answer(query, secret_scan.index([t.encode().lower()], wanted), 1) == 1


def test_redaction(spark):
    docs = documents(spark, [(1, "my password=hunter22 ok", None, None), (2, None, None, None), (3, "clean", None, None)])
    got = secret_scan.redact(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "my <assign> ok", 2: None, 3: "clean"}


# licenses


def _base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


@pytest.mark.parametrize("source", ["made", "odd", "table", "empty"])
def test_license_base(spark, source):
    made = ["CC-BY cc by cc", "All rights, reserved! GENERAL  public\nlicense general public license", "über cc by é", "accby cc bye"]
    docs = {"made": lambda: documents(spark, [(i, t, None, None) for i, t in enumerate(made)]), "odd": lambda: documents(spark), "table": lambda: catalog.documents(spark, SF), "empty": lambda: empty(spark)}[source]()
    got = Counter((r["id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], tuple(r["base_labels"])) for r in license_scan.scan_licenses(docs).collect())
    assert got == Counter((i, *_base(t or "")[:4], tuple(_base(t or "")[4])) for i, t in rows_of(docs))


def test_fuzzy_notices(spark):
    text = "some words. Lisensed under the Apache Licence, Version 2.0 (the) and more; GNU General Public Lcense"
    r = license_scan.scan_licenses(documents(spark, [(1, text, None, None)])).first()
    assert r["labels"] == ["apache-2.0", "gpl-like"] and r["base_labels"] == [] and 0.8 < r["score"] < 1
    apache = next(n for n in r["notices"] if n["label"] == "apache-2.0")
    assert (apache["first_word"], apache["last_word"], apache["edits"]) == (2, 9, 2)


def test_edited_places_before_a_better_one(spark):
    rows = [(1, "xx generel publik license yy general public license zz"), (2, "xx general public license yy generel publik license zz"), (3, "a generel public license, general public license, generel publik license")]
    got = {r["id"]: r["notices"] for r in license_scan.scan_licenses(documents(spark, [(i, t, None, None) for i, t in rows])).collect()}
    assert [[(n["first_word"], n["last_word"], n["edits"]) for n in got[i] if n["label"] == "gpl-like"] for i in (1, 2, 3)] == [
        [(1, 3, 2), (5, 7, 0)], [(1, 3, 0), (5, 7, 2)], [(1, 3, 1), (4, 6, 0), (7, 9, 2)],
    ]


def test_pigeonhole_finds_what_matching_finds():
    import regex

    rng, notice = random.Random(5), license_scan.compile_notice("all rights reserved", "x")
    for _ in range(300):
        t = list("all rights reserved")
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [t[k], "q"]])
        joined = " pre " + "".join(t) + " post "
        want = bool(regex.search(rf"(?:all rights reserved){{e<={notice.edits}}}", joined))
        assert bool(list(license_scan.search(joined.encode(), notice))) == want


# language ID


def test_language_id(spark):
    docs = catalog.documents(spark, SF)
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.identify(docs).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["id"] for r in got} == set(langs) and all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)
    assert sum(langs[r["id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_odd_cases(spark):
    docs = documents(spark)
    got = langid.identify(docs).collect()
    text = dict(rows_of(docs))
    assert len(got) == docs.count()
    for r in got:
        t = text[r["id"]]
        if r["id"] is not None:
            assert (r["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t))
    assert langid.identify(empty(spark)).count() == 0
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = langid.identify(docs.withColumn("lang", F.lit("xx"))).collect()
    assert {r["lang_pred"] for r in one} == {"und", "xx"}
    kept = langid.keep_identified(docs.withColumn("lang", F.lit("xx")))
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0


def test_codewords_differ():
    for k in (2, 3, 4, 5, 9, 30):
        c = langid.codewords(k)
        assert len({tuple(x) for x in c}) == k
    model = langid.Model(["a", "b", "c"], langid.codewords(3), None, None, np.ones(3))
    best, score, gap = langid.decode(langid.codewords(3) * 4.0, model)
    assert best.tolist() == [0, 1, 2] and (score > 0.5).all() and (gap > 0).all()


def test_fit_holds_counts_not_roots():
    """The driver holds a sample's counts in few bytes; the model is that of all roots at once."""
    rng = random.Random(5)
    letters = {"a": "abcdefgh", "b": "efghijkl", "c": "ijklmnop"}
    langs = [k for k in letters for _ in range(200)]
    texts = ["".join(rng.choice(letters[v] + " ") for _ in range(120)) for v in langs]
    texts[3], texts[250] = "ab " * 90_000, "x"  # a count that two bytes don't hold
    tracemalloc.start()
    try:
        model = langid.fit(texts, langs, rounds=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < len(texts) * langid.BUCKETS * 4  # of the roots alone; with a copy of those fitted before

    of = np.array([sorted(letters).index(v) for v in langs])
    y = langid.codewords(3)[of]
    fitted = np.arange(len(texts)) % 200 % langid.APART != langid.APART - 1
    x = np.sqrt([langid.frequencies(t) for t in texts])
    slope = x[fitted].T @ (-y[fitted] / 2 / 160 / 3)
    clear = np.abs(slope) > 1e-7
    assert clear.any() and (np.sign(model.weights[clear]) == -np.sign(slope[clear])).all()
    right = ((x[~fitted] @ model.weights + model.bias) * y[~fitted] > 0).mean(axis=0)
    assert model.trust == pytest.approx(np.maximum(right - 0.5, 0.01))
