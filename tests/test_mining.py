from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.plans.levelwise import mine
from lodestone.plans.local import DepthFirst, ListSearch
from lodestone.plans.utility_list import mine_lists
from tests.golden import BASKETS, HUI_15, HUI_30, ROWS, brute


def as_sets(found):
    rows = [(tuple(sorted(r["items"])), r["util"]) for r in found.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def table(spark, rows):
    return spark.createDataFrame(rows, "tid long, item long, u long")


def order(baskets, min_util, ties):
    twu = {}
    for b in baskets:
        for i in b:
            twu[i] = twu.get(i, 0) + sum(b.values())
    return sorted((i for i in twu if i >= 1 and twu[i] >= min_util), key=lambda i: (twu[i], ties * i))


def depth_first(baskets, min_util, tighten=True):
    rank = {i: k for k, i in enumerate(order(baskets, min_util, 1))}
    kept = [sorted((rank[i], i, u) for i, u in b.items() if i in rank) for b in baskets]
    extra = np.array([0 if tighten else sum(b.values()) - sum(e[2] for e in k) for b, k in zip(baskets, kept, strict=True)])
    ends = np.cumsum([len(k) for k in kept])
    flat = [e for k in kept for e in k]
    search = DepthFirst(min_util, tighten)
    item, util = np.array([e[1] for e in flat], np.int64), np.array([e[2] for e in flat], np.int64)
    out = dict(search.extend((), item, util, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64), np.zeros(len(kept), np.int64), extra.astype(np.int64), None))
    return {tuple(sorted(k)): v for k, v in out.items()}, search.candidates


def by_lists(baskets, min_util):
    names = order(baskets, min_util, -1)
    at = {i: k for k, i in enumerate(names)}
    lists = {i: [] for i in names}
    pairs = {}
    for t, b in enumerate(baskets):
        kept = sorted((i for i in b if i in at), key=at.get)
        total = left = sum(b[i] for i in kept)
        for k, i in enumerate(kept):
            left -= b[i]
            lists[i].append((t, b[i], left))
            for j in kept[k + 1 :]:
                pairs[min(i, j), max(i, j)] = pairs.get((min(i, j), max(i, j)), 0) + total
    search = ListSearch(min_util, pairs)
    out = dict(search.search((), None, [(i, tuple(np.array(c) for c in zip(*lists[i], strict=True))) for i in names]))
    return {tuple(sorted(k)): v for k, v in out.items()}, search.candidates


@pytest.mark.parametrize(("min_util", "efim", "fhm"), [(30, 8, 27), (31, 8, 27), (15, 31, 78)])
def test_candidate_counts(min_util, efim, fhm):
    want = brute(BASKETS, min_util)
    assert want == (HUI_15 if min_util == 15 else HUI_30)
    assert depth_first(BASKETS, min_util, tighten=False) == (want, efim)
    assert depth_first(BASKETS, min_util)[0] == want
    assert by_lists(BASKETS, min_util) == (want, fhm)


@pytest.mark.parametrize("options", [{}, {"local_elements": 0}, {"local_elements": 3}, {"local_elements": 0, "merging": True}, {"tighten": False}, {"tighten": False, "local_elements": 0}, {"subtree": False}, {"subtree": False, "local_elements": 3}])
@pytest.mark.parametrize("min_util", [15, 33, 34])
def test_plans_agree(spark, options, min_util):
    mined = mine(table(spark, ROWS), min_util, **options)
    assert as_sets(mined.found) == brute(BASKETS, min_util)


@pytest.mark.parametrize("local", [10**6, 3, 0])
def test_published_candidates(spark, local):
    """Level by level, in tasks and both: the same counts."""
    tx = table(spark, ROWS)
    assert [mine(tx, m, tighten=False, local_elements=local).candidates for m in (30, 15)] == [8, 31]
    assert [mine_lists(tx, m, local_elements=local).candidates for m in (30, 15)] == [27, 78]


@pytest.mark.parametrize("local", [10**6, 3, 0])
@pytest.mark.parametrize("min_util", [15, 30, 34])
def test_lists_agree(spark, min_util, local):
    mined = mine_lists(table(spark, ROWS), min_util, local_elements=local)
    assert as_sets(mined.found) == brute(BASKETS, min_util)
    assert set(mined.phases) == set(mined.tasks) == {"twu", "build", "search"} and mined.tasks["build"]["tasks"] > 0


def test_lists_of_transactions_with_other_keys(spark):
    named = spark.createDataFrame([(f"t{t}", i, u) for t, i, u in ROWS], "tid string, item long, u long")
    assert as_sets(mine_lists(named, 15).found) == HUI_15
    assert as_sets(mine_lists(table(spark, []), 5).found) == {}


def test_ranks_are_dense_over_partitions(spark):
    from lodestone.functions import bounds

    rows = spark.createDataFrame([(i, (i * 7) % 13) for i in range(1, 200)], "item long, twu long").repartition(5)
    got = {r["item"]: r["r"] for r in bounds.ranks(rows).collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(1, 200), key=lambda i: ((i * 7) % 13, i)), 1)}


def test_declared_totals_are_trusted(spark):
    declared = spark.createDataFrame([(t, sum(b.values())) for t, b in enumerate(BASKETS, 1)], "tid long, tu long")
    assert as_sets(mine(table(spark, ROWS), 30, declared=declared).found) == HUI_30
    low = spark.createDataFrame([(t, 1) for t in range(1, 7)], "tid long, tu long")
    assert as_sets(mine(table(spark, ROWS), 30, declared=low).found) == {}


def test_edges(spark):
    assert as_sets(mine(table(spark, []), 5).found) == {}
    assert as_sets(mine(table(spark, [(1, 0, 9), (1, 3, 2)]), 2).found) == {(3,): 2}
    with pytest.raises(ValueError, match="min_util"):
        mine(table(spark, ROWS), 0)
    with pytest.raises(ValueError, match="merged"):
        mine(table(spark, ROWS), 1, merging=True, tighten=False)


databases = st.lists(st.dictionaries(st.integers(1, 8), st.integers(0, 9), min_size=1, max_size=6), min_size=1, max_size=8)


@settings(max_examples=200, deadline=None)
@given(databases, st.integers(1, 40))
def test_local_searches_are_brute_force(baskets, min_util):
    want = brute(baskets, min_util)
    assert depth_first(baskets, min_util)[0] == want
    assert depth_first(baskets, min_util, tighten=False)[0] == want
    assert by_lists(baskets, min_util)[0] == want


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(databases, st.integers(1, 40))
def test_plans_are_brute_force(spark, baskets, min_util):
    tx = table(spark, [(t, i, u) for t, b in enumerate(baskets) for i, u in b.items()])
    want = brute(baskets, min_util)
    assert as_sets(mine(tx, min_util, local_elements=2).found) == want
    assert as_sets(mine_lists(tx, min_util).found) == want
    assert as_sets(mine_lists(tx, min_util, local_elements=2).found) == want


def test_a_higher_minimum_finds_a_subset(spark):
    low, high = (as_sets(mine(table(spark, ROWS), m).found) for m in (10, 20))
    assert {k: v for k, v in low.items() if v >= 20} == high
    renamed = table(spark, [(100 - t, i, u) for t, i, u in reversed(ROWS)])
    assert as_sets(mine(renamed, 20).found) == high
