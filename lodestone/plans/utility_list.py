"""The same question by joining utility lists.

State: (pre, l, tid, iu, ru, piu, bound), a row for each transaction of the itemset
pre + [l]: its utility and what remains after it, the utility of pre, and the utility and
rest of its left parent. Lists whose summed bound is under the minimum hold no itemset and
are given up, which is what stopping a join early comes to. Prefixes of at most
``local_elements`` rows finish in tasks, which stop their joins so; larger ones go on
level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.bounds import BROADCAST_ROWS, pair_bounds, promising, ranks, revised, small, twu, utility_lists
from lodestone.plans.levelwise import LOCAL_ELEMENTS, Mined
from lodestone.plans.local import ListSearch, Output, by_prefix
from lodestone.session import Phases, observed, stored


def _code(items: DataFrame) -> DataFrame:
    """Ranks by ascending twu, ties by descending item."""
    return ranks(items.select((-F.col("item")).alias("item"), "twu")).select((-F.col("item")).alias("item"), "twu", "r")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a 64-bit number for each tid, which may be of any kind."""
    if rows.schema["tid"].dataType.typeName() in ("long", "integer", "short", "byte"):
        return rows.withColumn("tid", F.col("tid").cast("long"))
    named = stored(rows.select(F.col("tid").alias("t")).distinct().withColumn("number", F.monotonically_increasing_id()), "numbers")
    return rows.join(named, F.col("tid") == F.col("t")).select(F.col("number").alias("tid"), "r", "u")


def _in_tasks(state: DataFrame, pairs: dict[tuple[int, int], int], min_util: int) -> DataFrame:
    """All itemsets from the lists of each prefix on, and a row (null, candidates) for each prefix."""
    shared = state.sparkSession.sparkContext.broadcast(pairs)  # BROADCAST_ROWS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Output()
        for prefix, t in by_prefix(batches):
            name, tid, iu, ru, piu, bound = (t.column(c).to_numpy() for c in ("l", "tid", "iu", "ru", "piu", "bound"))
            edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1], [True]]))
            lists = [(int(name[s]), (tid[s:e], iu[s:e], ru[s:e])) for s, e in zip(edge, edge[1:], strict=False) if bound[s:e].sum() >= min_util]
            tids, first = np.unique(tid, return_index=True)
            search = ListSearch(min_util, shared.value)
            for found in search.search(prefix, (tids, piu[first]), lists):
                out.add(*found)
            out.add(None, search.candidates)
            if len(out.items) > 20_000:
                yield out.batch()
        yield out.batch()

    spark = state.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = state.select("pre", "l", "tid", "iu", "ru", "piu", "bound").repartition(parts, "pre").sortWithinPartitions("pre", "l", "tid")
    return dealt.mapInArrow(run, "items array<bigint>, util bigint")


def mine_lists(tx: DataFrame, min_util: int, *, declared: DataFrame | None = None, local_elements: int = LOCAL_ELEMENTS, phases: Phases | None = None) -> Mined:
    """All high-utility itemsets; items of ``found`` are in search order."""
    phases = phases or Phases(tx.sparkSession)
    ranked = stored(_code(promising(twu(tx, declared), min_util)), "ranks")
    phases.mark("twu")
    rows = revised(tx, ranked)
    lists = stored(utility_lists(_numbered(rows)).select("r", "tid", "iu", "ru"), "lists")
    pairs, many = observed(pair_bounds(lists.select("tid", "r", F.col("iu").alias("u"))).where(F.col("eucs") >= min_util).select("a", "b", "eucs"), "pairs", n=F.count(F.lit(1)))
    local_elements = local_elements if many["n"] <= BROADCAST_ROWS else 0  # tasks need all pairs
    known = {(r["a"], r["b"]): r["eucs"] for r in pairs.collect()} if local_elements else {}
    beside = F.broadcast(pairs) if many["n"] <= BROADCAST_ROWS else pairs
    phases.mark("build")
    none = F.expr("cast(array() as array<int>)")
    state = lists.select(none.alias("pre"), F.col("r").alias("l"), "tid", "iu", "ru", F.lit(0).cast("long").alias("piu"), (F.col("iu") + F.col("ru")).alias("bound"))
    parts, level, candidates = [], 0, 0
    while True:
        level += 1
        sums = state.groupBy("pre", "l").agg(F.sum("iu").alias("iu"), F.sum("ru").alias("ru"), F.sum("bound").alias("bound"))
        sums, seen = observed((sums.where(F.col("bound") >= min_util) if level > 1 else sums).select("pre", "l", "iu", "ru"), "sums", n=F.count(F.lit(1)))
        candidates += seen["n"]
        parts.append(sums.where(F.col("iu") >= min_util).select(F.array_append("pre", F.col("l")).cast("array<bigint>").alias("p"), F.col("iu").alias("util")))
        can = sums.where(F.col("iu") + F.col("ru") >= min_util).select(F.col("pre").alias("cp"), F.col("l").alias("cl"))
        others = sums.select(F.col("pre").alias("op"), F.col("l").alias("ol"))
        tried = can.join(others, (F.col("cp") == F.col("op")) & (F.col("cl") < F.col("ol"))).join(beside, (F.col("cl") == F.col("a")) & (F.col("ol") == F.col("b")), "left_semi")
        partners = stored(tried.select("cp", "cl", "ol"), "partners")
        candidates += partners.count()
        x = state.join(partners.select("cp", "cl").distinct(), (F.col("pre") == F.col("cp")) & (F.col("l") == F.col("cl")), "left_semi").select(
            F.col("pre").alias("xp"), F.col("l").alias("x"), F.col("tid").alias("xt"), F.col("iu").alias("xi"), F.col("ru").alias("xr"), "piu")
        y = state.join(partners.select("cp", "ol").distinct(), (F.col("pre") == F.col("cp")) & (F.col("l") == F.col("ol")), "left_semi").select(
            F.col("pre").alias("yp"), F.col("l").alias("y"), F.col("tid").alias("yt"), F.col("iu").alias("yi"), F.col("ru").alias("yr"))
        both = x.join(y, (F.col("xt") == F.col("yt")) & (F.col("xp") == F.col("yp")) & (F.col("x") < F.col("y"))).join(beside, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")), "left_semi")
        grown = both.select(
            F.array_append("xp", F.col("x")).alias("pre"), F.col("y").alias("l"), F.col("xt").alias("tid"), (F.col("xi") + F.col("yi") - F.col("piu")).alias("iu"),
            F.col("yr").alias("ru"), F.col("xi").alias("piu"), (F.col("xi") + F.col("xr")).alias("bound"),
        )
        state, seen = observed(grown, "joined", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        if local_elements:
            ready = state
            if seen["n"] > local_elements:
                large = small(state.groupBy(F.col("pre").alias("big")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > local_elements).select("big"))
                ready = state.join(large, F.col("pre") == F.col("big"), "left_anti")
            deep, more = observed(_in_tasks(ready, known, min_util), "deep", n=F.sum(F.when(F.col("items").isNull(), F.col("util"))))
            parts.append(deep.where("items is not null").select(F.col("items").alias("p"), "util"))
            candidates += more["n"]
            if seen["n"] <= local_elements:
                break
            state = state.join(large, F.col("pre") == F.col("big"), "left_semi")
    found = reduce(DataFrame.unionAll, parts)
    names = ranked.select("item", F.col("r").alias("name"))
    opened = found.select("p", "util", F.posexplode("p").alias("pos", "r")).join(small(names), F.col("r") == F.col("name"))
    named = opened.groupBy("p", "util").agg(F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("s"))
    phases.mark("search")
    return Mined(named.select(F.col("s.item").alias("items"), "util"), candidates, level, phases.seconds, phases.tasks)
