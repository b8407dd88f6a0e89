"""Running bounds over a stream of text lines.

Both are plain streaming aggregations: state is a row per item, merged map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.spmf import parse_lines


def running_twu(lines: DataFrame) -> DataFrame:
    """(item, twu, n) so far, from lines of the utility format; use update or complete mode."""
    good = parse_lines(lines, tid=F.lit(None).cast("long")).where("reason is null").select("tu", F.explode(F.array_distinct("items")).alias("item"))
    return good.where("item >= 1").groupBy("item").agg(F.sum("tu").alias("twu"), F.count(F.lit(1)).alias("n"))


def running_pairs(lines: DataFrame) -> DataFrame:
    """(a, b, twu), a < b, so far: the declared utility of the baskets with both items."""
    good = parse_lines(lines, tid=F.lit(None).cast("long")).where("reason is null").select("tu", F.array_sort(F.array_distinct("items")).alias("items"))
    left = good.select("tu", "items", F.explode("items").alias("a"))
    both = left.select("tu", "a", F.explode(F.filter("items", lambda i: i > F.col("a"))).alias("b"))
    return both.where("a >= 1").groupBy("a", "b").agg(F.sum("tu").alias("twu"))
