from __future__ import annotations

import json

import pytest

from lodestone.functions import bounds
from lodestone.operators import output, projection
from lodestone.plans.levelwise import mine
from lodestone.sources.spmf import parse_lines, read_spmf, to_transactions
from tests.golden import HUI_30, ROWS, TEXT


def test_golden_text(spark, tmp_path):
    path = tmp_path / "db.txt"
    path.write_text(TEXT.rstrip("\n"))  # the last line has no newline
    good, bad = read_spmf(spark, str(path))
    assert good.count() == 6 and bad.count() == 0
    tx, declared = to_transactions(good)
    found = mine(tx, 30, declared=declared).found
    assert {tuple(sorted(r["items"])): r["util"] for r in found.collect()} == HUI_30


LINES = [
    ("% header", None), ("@x", None), ("# c", None), ("", None), ("3 5:10:4 6 # note", "good"), ("a b:1:1 1", "not a number"),
    ("3 5:10:4", "items and utilities differ in number"), ("3 5:10:4 -6", "negative number"), ("3 5:99:4 6", "good"), ("3 5", "three parts are needed"),
    ("3\t5:10:4\t6", "good"), ("3,5:10:4,6", "good"), ("3 , 5 : 10 : 4;6", "good"), ("3  5:10:4  6", "good"), ("3,,5:10:4,6", "not a number"), (":1:", "not a number"), ("3 5:x:4 6", "not a number"),
]


def test_lines(spark):
    rows = parse_lines(spark.createDataFrame([(x,) for x, _ in LINES], "value string")).collect()
    got = {r["value"]: r["reason"] or "good" for r in rows}
    assert got == {x.split("#")[0].strip(): why for x, why in LINES if why}
    assert next(r for r in rows if r["tu"] == 99)["items"] == [3, 5]
    assert all((r["items"], r["utils"]) == ([3, 5], [4, 6]) for r in rows if r["reason"] is None)


def test_modes_and_item_zero(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 3:5:2 3\n")
    (tmp_path / "b.txt").write_text("x:1:1\n3 5:99:4 6\n")
    good, bad = read_spmf(spark, str(tmp_path), validate_tu=True)
    assert sorted((r["items"], r["tu"]) for r in good.collect()) == [([3], 5), ([3, 5], 10)]
    assert [r["reason"] for r in bad.collect()] == ["not a number"]
    with pytest.raises(Exception, match="not a number"):
        read_spmf(spark, str(tmp_path), mode="FAILFAST")[0].collect()
    with pytest.raises(ValueError, match="unknown mode"):
        read_spmf(spark, str(tmp_path), mode="odd")


def test_golden_bounds(spark):
    tx = spark.createDataFrame(ROWS, "tid long, item long, u long")
    twu = {r["item"]: r["twu"] for r in bounds.twu(tx).collect()}
    assert twu == {1: 49, 2: 61, 3: 61, 4: 44, 5: 61, 6: 18, 7: 1}
    ranked = bounds.ranks(bounds.promising(bounds.twu(tx), 30))
    names = {r["r"]: r["item"] for r in ranked.collect()}
    assert [names[k] for k in sorted(names)] == [4, 1, 2, 3, 5]
    rows = bounds.revised(tx, ranked)
    assert {names[r["r"]]: r["su"] for r in bounds.first_su(rows).collect()} == {4: 44, 1: 39, 2: 40, 3: 23, 5: 13}
    pairs = {frozenset((names[r["a"]], names[r["b"]])): r["eucs"] for r in bounds.pair_bounds(rows).collect()}
    assert pairs == {frozenset(k): v for k, v in {(4, 1): 31, (4, 5): 31, (4, 3): 31, (4, 2): 31, (1, 5): 34, (1, 3): 47, (1, 2): 34, (5, 3): 46, (5, 2): 59, (3, 2): 46}.items()}
    with pytest.raises(ValueError, match="min_util"):
        bounds.promising(ranked, 0)


def test_merging(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (2, 1, 1), (2, 2, 4), (3, 1, 7), (4, 1, 2)], "tid long, r int, u long")
    merged = projection.merge_equal(projection.project(rows, 1))
    assert sorted((r["pu"], r["n"], [tuple(e) for e in r["rem"]]) for r in merged.collect()) == [(6, 2, [(2, 7)]), (9, 2, [])]


def test_output(spark, tmp_path):
    found = mine(spark.createDataFrame(ROWS, "tid long, item long, u long"), 30).found
    for _ in range(2):  # the second replaces the first
        output.write_lines(found, str(tmp_path / "new/out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "new/out")).collect()) == ["2 3 5 #UTIL: 33", "2 5 #UTIL: 33"]
    row = output.report(found, min_util=30, candidates=8, phases={"build": 0.5}).first()
    assert (row["n_itemsets"], row["total_util"], row["longest"], row["n_candidates"], row["build_s"]) == (2, 66, 3, 8, 0.5)
    made = json.loads(output.report(found, min_util=30, candidates=8, phases={"build": 0.5}, parallelism=4, as_json=True).first()["value"])
    assert made["result"]["n_itemsets"] == 2 and made["statistics"] == {"parallelism": 4, "build_s": 0.5}
