"""Bounds over transactions (tid, item, u): what can still reach the minimum utility.

tid partitions stay together: when the input is dealt by tid, windows over tid and the
revised baskets need no shuffle of their own. Only per-item tables are joined back; they
are broadcast when their counted size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut, observed

#: Rows of an item or pair table that may be broadcast (some 30 bytes a row).
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, computed and counted once, with a broadcast hint if it has so few rows; else Spark shuffles it."""
    table, seen = observed(df, "items", n=F.count(F.lit(1)))
    return F.broadcast(table) if seen["n"] <= rows else table


def with_total(tx: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Adds tu: the declared transaction utility, or the sum of a transaction's utilities."""
    if declared is not None:
        return tx.join(declared.select("tid", "tu"), "tid")
    return tx.withColumn("tu", F.sum("u").over(Window.partitionBy("tid")))


def twu(tx: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(item, twu): the utility of all transactions with the item."""
    return with_total(tx, declared).groupBy("item").agg(F.sum("tu").alias("twu"))


def promising(items: DataFrame, min_util: int) -> DataFrame:
    """Items from 1 on whose twu reaches the minimum utility."""
    if min_util < 1:
        raise ValueError("min_util must be 1 or more")
    return items.where((F.col("item") >= 1) & (F.col("twu") >= min_util))


def ranks(items: DataFrame) -> DataFrame:
    """(item, twu, r): dense ranks from 1, by ascending twu, ties by ascending item.

    The items are range-sorted; an item's rank is its place in its partition and the items
    of the partitions before, of which there is a row each.
    """
    ordered = cut(items.repartitionByRange("twu", "item").sortWithinPartitions("twu", "item")).withColumn("part", F.spark_partition_id())
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = sizes.select(F.col("part").alias("p"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("twu", "item"))
    return ordered.withColumn("place", place).join(F.broadcast(offsets), F.col("part") == F.col("p")).select("item", "twu", (F.col("place") + F.col("before")).cast("int").alias("r"))


def revised(tx: DataFrame, ranked: DataFrame) -> DataFrame:
    """(tid, r, u): what is left of the transactions, items as ranks."""
    return tx.join(small(ranked.select("item", "r")), "item").select("tid", "r", "u")


def with_remaining(rows: DataFrame, order: str = "r") -> DataFrame:
    """Adds ru: the utility of a transaction's later elements."""
    later = Window.partitionBy("tid").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("ru", F.coalesce(F.sum("u").over(later), F.lit(0)))


def first_su(rows: DataFrame) -> DataFrame:
    """(r, su): subtree utility of the single items of revised transactions."""
    return with_remaining(rows).groupBy("r").agg(F.sum(F.col("u") + F.col("ru")).alias("su"))


def utility_lists(rows: DataFrame) -> DataFrame:
    """(r, tid, iu, ru) of the single items."""
    return with_remaining(rows).select("r", "tid", F.col("u").alias("iu"), "ru")


def summary(lists: DataFrame, *keys: str) -> DataFrame:
    """Σiu, Σru and the number of rows of utility lists."""
    return lists.groupBy(*keys).agg(F.sum("iu").alias("iu"), F.sum("ru").alias("ru"), F.count(F.lit(1)).alias("n"))


def pair_bounds(rows: DataFrame) -> DataFrame:
    """(a, b, eucs), a < b: the kept utility of the transactions with both items."""
    total = rows.withColumn("tu", F.sum("u").over(Window.partitionBy("tid"))).select("tid", "r", "tu")
    other = rows.select(F.col("tid").alias("t2"), F.col("r").alias("b"))
    pairs = total.join(other, (F.col("tid") == F.col("t2")) & (F.col("r") < F.col("b")))
    return pairs.groupBy(F.col("r").alias("a"), "b").agg(F.sum("tu").alias("eucs"))


def extension_bounds(rows: DataFrame, explore: DataFrame) -> DataFrame:
    """(x, z, su, lu) for every explored x and every later z: bounds of the extensions of {x}, later items kept all."""
    lists = with_remaining(rows)
    x = lists.join(small(explore.select(F.col("r").alias("xr"))), F.col("r") == F.col("xr")).select("tid", F.col("r").alias("x"), F.col("u").alias("pu"), F.col("ru").alias("rest"))
    z = lists.select(F.col("tid").alias("t2"), F.col("r").alias("z"), F.col("u").alias("zu"), F.col("ru").alias("zru"))
    pairs = x.join(z, (F.col("tid") == F.col("t2")) & (F.col("x") < F.col("z")))
    return pairs.groupBy("x", "z").agg(F.sum(F.col("pu") + F.col("zu") + F.col("zru")).alias("su"), F.sum(F.col("pu") + F.col("rest")).alias("lu"))
