"""Connected components of a link table, by alternating large and small stars.

Every round is two shuffles of the links and a reliable checkpoint; the number of rounds
grows with the logarithm of the largest component. Nothing is gathered on the driver but
one count and checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` go from larger to smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    named = least.select(F.col("u").alias("c"), "m")
    moved = links.join(named, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that isn't itself the smallest of its component.

    ``links``: pairs of comparable ids; loops, repeats and nulls don't matter.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, before = cut(pairs), None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if (state["n"], state["sum"]) == before or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state["n"], state["sum"]
        now = cut(_small_star(_large_star(now)))
