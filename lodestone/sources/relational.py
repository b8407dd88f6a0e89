"""Baskets from relational tables: rows (tid, item, u), unique by (tid, item), u >= 0, item >= 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def transactions(rows: DataFrame, tid: Column, item: Column, utility: Column) -> DataFrame:
    """(tid, item, u) with utilities summed. Dealing by tid first lets all later steps of a basket stay in place."""
    lines = rows.select(tid.alias("tid"), item.cast("long").alias("item"), utility.alias("u")).where("tid is not null and item is not null")
    return lines.repartition("tid").groupBy("tid", "item").agg(F.sum("u").cast("long").alias("u")).where("u is not null")


def part_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return transactions(lines, F.col("l_orderkey"), F.col("l_partkey") + 1, F.col("l_quantity"))


def supplier_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return transactions(lines, F.col("l_orderkey"), F.col("l_suppkey") + 1, F.col("l_quantity"))


def brand_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr("cast(substr(p_brand, 7) as int)").alias("brand"))
    return transactions(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), F.col("l_orderkey"), F.col("brand"), F.col("l_quantity"))


#: The event types as items.
EVENT_ITEMS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def event_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basket for each user and day; its id is the pair, so that no global rank is needed."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_type", "value")
    item = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENT_ITEMS.items()])
    return transactions(rows, F.struct("user_id", F.to_date("ts").alias("day")), item, F.round(F.col("value") * 100).cast("long"))


BASKETS = {"part": part_baskets, "supp": supplier_baskets, "brand": brand_baskets, "events": event_baskets}


def statistics(tx: DataFrame) -> DataFrame:
    """One row: n_tx, n_items, max_item, total, avg_len, max_len."""
    per = tx.groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("tu"), F.max("item").alias("top"))
    shape = per.agg(F.count(F.lit(1)).alias("n_tx"), F.max("top").alias("max_item"), F.sum("tu").alias("total"), F.avg("n").alias("avg_len"), F.max("n").alias("max_len"))
    items = tx.select("item").distinct().agg(F.count(F.lit(1)).alias("n_items"))
    return shape.crossJoin(items).select("n_tx", "n_items", "max_item", "total", "avg_len", "max_len")  # one row each


