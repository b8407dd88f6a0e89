"""Itemsets as text lines, and the report of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def itemset_text(found: DataFrame) -> DataFrame:
    """(itemset, util): ids ascending, blanks between."""
    return found.select(F.array_join(F.array_sort("items"), " ").alias("itemset"), "util")


def lines(found: DataFrame) -> DataFrame:
    """(value): ``i1 i2 #UTIL: u`` for every itemset."""
    return itemset_text(found).select(F.concat("itemset", F.lit(" #UTIL: "), F.col("util").cast("string")).alias("value"))


def write_lines(found: DataFrame, path: str) -> None:
    """Writes the lines, in place of what was there; folders are made."""
    lines(found).write.mode("overwrite").text(path)


def report(found: DataFrame, *, min_util: int, candidates: int, phases: dict[str, float] | None = None, tasks: dict[str, dict[str, int]] | None = None, parallelism: int = 0, as_json: bool = False) -> DataFrame:
    """One row: min_util, n_itemsets, total_util, longest, n_candidates, parallelism, phase seconds and phases' task sums; or the same as JSON."""
    seconds = phases or {}
    sums = {f"{phase}_{name}": n for phase, each in (tasks or {}).items() for name, n in each.items()}
    row = found.agg(F.count(F.lit(1)).alias("n_itemsets"), F.sum("util").alias("total_util"), F.max(F.size("items")).alias("longest")).select(
        F.lit(min_util).cast("long").alias("min_util"), "n_itemsets", "total_util", "longest", F.lit(candidates).cast("long").alias("n_candidates"),
        F.lit(parallelism).alias("parallelism"), *[F.lit(float(v)).alias(f"{k}_s") for k, v in seconds.items()],
        *[F.lit(n).cast("long").alias(name) for name, n in sums.items()],
    )
    if not as_json:
        return row
    result = F.struct("min_util", "n_itemsets", "n_candidates", "total_util", "longest")
    statistics = F.struct("parallelism", *[f"{k}_s" for k in seconds], *sums)
    return row.select(F.to_json(F.struct(result.alias("result"), statistics.alias("statistics"))).alias("value"))
