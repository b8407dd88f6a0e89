"""The plain-text utility format: ``items:transaction utility:utilities``, one basket a line.

Numbers stand between single separators: blanks or any other character that is neither a
digit nor the colon, blanks around it allowed. What follows ``%``, ``#`` or
``@`` is a comment; lines that are then empty are skipped. A line that can't be read goes
to the bad rows with a reason (or fails the job in FAILFAST mode). The declared transaction
utility is trusted unless ``validate_tu`` asks for the sum. The last line needs no newline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


NUMBER = r"([+-]?\d+)"
#: Blanks before a number, or one other character that may stand between blanks.
SEPARATOR = r"(?:\s+(?=[+-]?\d)|\s*[^\d\s:]\s*)"


def parse_lines(lines: DataFrame, value: str = "value", tid: Column | None = None) -> DataFrame:
    """tid, value, items, tu, utils, reason (null: good) of every line that isn't empty or a comment.

    ``tid`` names the baskets (default: ids by place in the input, which streams don't have).
    """


    def numbers(part: Column) -> Column:
        """The numbers of a list; where it isn't one, a null among them."""
        found = F.regexp_extract_all(part, F.lit(f"(?:^|{SEPARATOR}){NUMBER}"), F.lit(1))
        return F.when(part.rlike(rf"^{NUMBER}(?:{SEPARATOR}{NUMBER})*$"), F.transform(found, lambda x: x.try_cast("bigint"))).otherwise(F.array(F.lit(None).cast("bigint")))

    blank = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = (
        lines.select((F.monotonically_increasing_id() if tid is None else tid).alias("tid"), blank(F.regexp_replace(F.col(value), r"[%#@].*$", "")).alias("value"))
        .where("value <> ''").withColumn("part", F.split("value", ":"))
        .withColumn("items", numbers(blank(F.get("part", F.lit(0))))).withColumn("tu", blank(F.get("part", F.lit(1))).try_cast("bigint")).withColumn("utils", numbers(blank(F.get("part", F.lit(2)))))
    )
    reason = (
        F.when(F.size("part") != 3, "three parts are needed")
        .when(F.expr("exists(items, x -> x is null) or exists(utils, x -> x is null) or tu is null"), "not a number")
        .when(F.size("items") != F.size("utils"), "items and utilities differ in number")
        .when(F.expr("tu < 0 or exists(items, x -> x < 0) or exists(utils, x -> x < 0)"), "negative number")
    )
    return rows.select("tid", "value", "items", "tu", "utils", reason.alias("reason"))


def read_spmf(spark: SparkSession, path: str | list[str], *, mode: str = "PERMISSIVE", validate_tu: bool = False) -> tuple[DataFrame, DataFrame]:
    """(baskets: tid, items, tu, utils; bad rows: value, reason). Item 0 is never mined and is dropped from the baskets.

    Files are split by Spark's line reader; a directory or several paths are read alike.
    """
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"unknown mode {mode}")
    rows = parse_lines(spark.read.text(path))
    if mode == "FAILFAST":
        rows = rows.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.concat_ws(": ", F.col("reason"), F.col("value")))))
    pairs = F.filter(F.arrays_zip("items", "utils"), lambda p: p["items"] > 0)
    total = F.aggregate("utils", F.lit(0).cast("long"), lambda a, x: a + x)
    good = rows.where("reason is null").withColumn("pairs", pairs)
    good = good.select("tid", F.col("pairs.items").alias("items"), (total if validate_tu else F.col("tu")).alias("tu"), F.col("pairs.utils").alias("utils"))
    return good, rows.where("reason is not null").select("value", "reason")


def to_transactions(baskets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tid, item, u) and (tid, tu) of parsed baskets; repeated items of a basket add up."""
    lines = baskets.select("tid", F.explode(F.arrays_zip("items", "utils")).alias("e")).select("tid", F.col("e.items").alias("item"), F.col("e.utils").alias("u"))
    return lines.groupBy("tid", "item").agg(F.sum("u").alias("u")), baskets.select("tid", "tu")
