"""Projection of baskets on an item, and merging of baskets with equal remainders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def baskets(rows: DataFrame) -> DataFrame:
    """(tid, rem): each transaction's elements (r, u), by rank."""
    return rows.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("r", "u"))).alias("rem"))


def project(rows: DataFrame, r: int) -> DataFrame:
    """(tid, pu, tu, rem) of the transactions with the item: its utility, what remains after it, and its sum."""
    whole = baskets(rows).where(F.exists("rem", lambda e: e["r"] == r))
    rest = F.filter("rem", lambda e: e["r"] > r)
    own = F.filter("rem", lambda e: e["r"] == r)[0]["u"]
    total = F.aggregate(F.col("rest.u"), F.lit(0).cast("long"), lambda a, u: a + u)
    return whole.withColumn("rest", rest).select("tid", own.alias("pu"), total.alias("tu"), F.col("rest").alias("rem"))


def merge_equal(projected: DataFrame, *keys: str) -> DataFrame:
    """Baskets of equal remaining items become one: prefix utilities and, item by item, utilities add up.

    Grouping by the items makes equal remainders meet wherever they are; utilities are
    summed by position through one pass over the exploded elements.
    """
    named = projected.withColumn("items", F.col("rem.r"))
    elements = named.select(*keys, "items", "pu", F.posexplode_outer("rem").alias("pos", "e"))
    summed = elements.groupBy(*keys, "items", "pos").agg(F.sum("pu").alias("pu"), F.sum("e.u").alias("u"), F.count(F.lit(1)).alias("n"), F.first("e.r").alias("r"))
    out = summed.groupBy(*keys, "items").agg(F.max("pu").alias("pu"), F.max("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "u")))).alias("rem"))
    return out.select(*keys, "pu", "n", "rem")


def join_pairs(lists: DataFrame, min_util: int) -> DataFrame:
    """(x, y, tid, iu, ru): utility lists of the pairs x < y, of which x can still be extended to the minimum utility."""
    can = lists.groupBy("r").agg(F.sum(F.col("iu") + F.col("ru")).alias("bound")).where(F.col("bound") >= min_util).select(F.col("r").alias("k"))
    x = lists.join(can, F.col("r") == F.col("k"), "left_semi").select("tid", F.col("r").alias("x"), F.col("iu").alias("xi"))
    y = lists.select(F.col("tid").alias("t2"), F.col("r").alias("y"), F.col("iu").alias("yi"), F.col("ru").alias("yr"))
    return x.join(y, (F.col("tid") == F.col("t2")) & (F.col("x") < F.col("y"))).select("x", "y", "tid", (F.col("xi") + F.col("yi")).alias("iu"), F.col("yr").alias("ru"))
