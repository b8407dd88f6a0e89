"""High-utility itemset mining over DataFrames: every search node of a level in one job.

State: (p, pu, extra, rem), a row for each transaction of a prefix p with its utility pu
and the remaining elements (item, u, kept). A level aggregates subtree and local utility of each (p, z),
keeps what they allow, and explodes the children. Prefixes whose projected baskets hold at
most ``local_elements`` elements finish depth-first inside tasks; larger ones stay with
the level-wise plan, so that no task has to hold an unbounded database. 0 keeps all
level-wise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.bounds import BROADCAST_ROWS, small, with_total
from lodestone.plans.local import DepthFirst, Output, by_prefix
from lodestone.session import Phases, observed, stored

LOCAL_ELEMENTS = 2_000_000
_FOUND = "items array<bigint>, util bigint"


@dataclass
class Mined:
    """found: (items in search order, util); candidates: itemsets whose extension was tried; levels; seconds and task sums by phase."""

    found: DataFrame
    candidates: int
    levels: int
    phases: dict[str, float] = field(default_factory=dict)
    tasks: dict[str, dict[str, int]] = field(default_factory=dict)


def _depth_first(state: DataFrame, min_util: int, tighten: bool, subtree: bool) -> DataFrame:
    """All itemsets beyond the prefixes of the state, and a row (null, candidates) for each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Output()
        for prefix, t in by_prefix(batches):
            rem = t.column("rem")
            offsets = rem.offsets.to_numpy() - rem.offsets[0].as_py()
            flat = rem.flatten()
            item = np.asarray(flat.field("item"))
            search = DepthFirst(min_util, tighten, subtree)
            keep = None if tighten else np.unique(item[np.asarray(flat.field("kept"))])
            for found in search.extend(prefix, item, np.asarray(flat.field("u")), offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64), t.column("pu").to_numpy(), t.column("extra").to_numpy(), keep):
                out.add(*found)
            out.add(None, search.candidates)
            if len(out.items) > 20_000:
                yield out.batch()
        yield out.batch()

    spark = state.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = state.select("p", "pu", "extra", "rem").where(F.size("rem") > 0)
    return dealt.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(run, _FOUND)


def _sum(elements: Column) -> Column:
    return F.aggregate(elements, F.lit(0).cast("long"), lambda a, e: a + e["u"])


def bounds(state: DataFrame) -> DataFrame:
    """(p, z, su, lu) of every kept later item of every prefix; an element that isn't kept counts for lu alone."""
    rows = state.select("p", "pu", "extra", "rem", F.posexplode("rem").alias("pos", "e")).where("e.kept")
    suffix = _sum(F.filter(F.slice("rem", F.col("pos") + 1, F.size("rem")), lambda e: e["kept"]))
    whole = F.col("pu") + F.col("extra") + _sum(F.col("rem"))
    return rows.groupBy("p", F.col("e.item").alias("z")).agg(F.sum(F.col("pu") + suffix).alias("su"), F.sum(whole).alias("lu"))


def extend(state: DataFrame, limits: DataFrame, min_util: int, tighten: bool = True, subtree: bool = True) -> DataFrame:
    """The children: prefixes by the items to explore, remainders by those to keep (without ``tighten`` the others stay, marked)."""
    able = (F.col("su") >= min_util) | (F.col("lu") >= min_util)
    explored = F.col("su") >= min_util if subtree else able
    sets = limits.where(able).groupBy(F.col("p").alias("q")).agg(
        F.collect_list("z").alias("keep"), F.collect_list(F.when(explored, F.col("z"))).alias("explore")
    ).where(F.size("explore") > 0)
    rem = F.expr("filter(rem, e -> array_contains(keep, e.item))" if tighten else "transform(rem, e -> struct(e.item as item, e.u as u, e.kept and array_contains(keep, e.item) as kept))")
    kept = state.join(sets, F.col("p") == F.col("q")).select("p", "pu", "extra", "explore", rem.alias("rem"))
    rows = kept.select("p", "pu", "extra", "explore", "rem", F.posexplode("rem").alias("pos", "e")).where("e.kept and array_contains(explore, e.item)")
    return rows.select(
        F.array_append("p", F.col("e.item")).alias("p"), (F.col("pu") + F.col("e.u")).alias("pu"), "extra", F.slice("rem", F.col("pos") + 2, F.size("rem")).alias("rem")
    )


def merge(state: DataFrame) -> DataFrame:
    """Rows of one prefix with equal remaining items become one."""
    named = state.withColumn("names", F.col("rem.item"))
    flat = named.select("p", "names", "pu", "extra", F.posexplode_outer("rem").alias("pos", "e"))
    by_place = flat.groupBy("p", "names", "pos").agg(F.sum("pu").alias("pu"), F.sum("extra").alias("extra"), F.first("e.item").alias("item"), F.sum("e.u").alias("u"), F.first("e.kept").alias("kept"))
    out = by_place.groupBy("p", "names").agg(F.first("pu").alias("pu"), F.first("extra").alias("extra"), F.sort_array(F.collect_list(F.struct("pos", F.struct("item", "u", "kept").alias("e")))).alias("s"))
    return out.select("p", "pu", "extra", F.when(F.size("names") > 0, F.col("s.e")).otherwise(F.expr("slice(s.e, 1, 0)")).alias("rem"))


def first_state(tx: DataFrame, min_util: int, declared: DataFrame | None, tighten: bool, subtree: bool, phases: Phases) -> tuple[DataFrame, dict[str, int], int]:
    """The stored state of the single items that may be explored, its elements, and how many items they are."""
    if min_util < 1:
        raise ValueError("min_util must be 1 or more")
    whole = with_total(tx, declared).persist(StorageLevel.MEMORY_AND_DISK)  # dealt by tid: what follows stays in place
    items = small(whole.groupBy("item").agg(F.sum("tu").alias("twu")).where((F.col("item") >= 1) & (F.col("twu") >= min_util)))
    phases.mark("twu")
    rows = whole.join(items, "item")
    later = Window.partitionBy("tid").orderBy(F.col("twu").desc(), F.col("item").desc()).rowsBetween(Window.unboundedPreceding, 0)
    su = rows.withColumn("su", F.sum("u").over(later)).groupBy("item").agg(F.sum("su").alias("su"))
    explore, seen = observed((su.where(F.col("su") >= min_util) if subtree else su).select(F.col("item").alias("x")), "explore", n=F.count(F.lit(1)))
    slack = F.lit(0).cast("long") if tighten else F.max("tu") - F.sum("u")
    baskets = rows.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("twu", "item", "u"))).alias("s"), slack.alias("extra"))
    baskets = baskets.select("extra", F.transform("s", lambda e: F.struct(e["item"].alias("item"), e["u"].alias("u"), F.lit(True).alias("kept"))).alias("rem"))
    opened = baskets.select("extra", "rem", F.posexplode("rem").alias("pos", "e")).join(F.broadcast(explore) if seen["n"] <= BROADCAST_ROWS else explore, F.col("e.item") == F.col("x"))
    state, sizes = observed(opened.select(F.array("x").alias("p"), F.col("e.u").alias("pu"), "extra", F.slice("rem", F.col("pos") + 2, F.size("rem")).alias("rem")), "level", n=F.sum(F.size("rem")))
    whole.unpersist()
    phases.mark("build")
    return state, sizes, seen["n"]


def mine(
    tx: DataFrame, min_util: int, *, declared: DataFrame | None = None, local_elements: int = LOCAL_ELEMENTS, merging: bool = False, tighten: bool = True, subtree: bool = True, phases: Phases | None = None,
) -> Mined:
    """All itemsets of (tid, item, u) whose utility, over the transactions with all their items, reaches ``min_util``.

    ``declared``: (tid, tu), the transaction utilities to trust. ``tighten=False`` keeps the
    published local bound (for equal candidate counts). ``subtree=False`` explores by local
    utility alone. ``phases``: marks to go on with.
    """
    if merging and not tighten:
        raise ValueError("merged baskets don't keep the published bound's elements apart")
    phases = phases or Phases(tx.sparkSession)
    state, seen, candidates = first_state(tx, min_util, declared, tighten, subtree, phases)
    parts, level = [], 0

    def finish(rows: DataFrame) -> None:
        nonlocal candidates
        deep, more = observed(_depth_first(rows, min_util, tighten, subtree), "deep", n=F.sum(F.when(F.col("items").isNull(), F.col("util"))))
        parts.append(deep.where("items is not null"))
        candidates += more["n"]

    able = (F.col("su") >= min_util) | (F.col("lu") >= min_util)
    while True:
        level += 1
        sizes = state.groupBy("p").agg(F.sum("pu").alias("util"), F.sum(F.size("rem")).alias("n"))
        parts.append(sizes.where(F.col("util") >= min_util).select(F.col("p").alias("items"), "util"))
        if local_elements and seen["n"] <= local_elements:
            finish(state)
            break
        if local_elements:
            large = small(sizes.where(F.col("n") > local_elements).select(F.col("p").alias("big")))
            finish(state.join(large, F.col("p") == F.col("big"), "left_anti"))
            state = state.join(large, F.col("p") == F.col("big"), "left_semi")
        state = state.where(F.size("rem") > 0)
        if merging:
            state = stored(merge(state), "merged")
        limits, grown = observed(bounds(state).where(able), "limits", n=F.count(F.when((F.col("su") >= min_util) if subtree else able, 1)))
        candidates += grown["n"]
        if not grown["n"]:
            break
        state, seen = observed(extend(state, limits, min_util, tighten, subtree), "level", n=F.sum(F.size("rem")))
    found = reduce(DataFrame.unionAll, parts)
    phases.mark("search")
    return Mined(found, candidates, level, phases.seconds, phases.tasks)
