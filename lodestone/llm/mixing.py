"""Mixing sources to target weights.

Every document gets a hash-random key. The rows are range-sorted by (source, key),
distributed prefix sums of the sizes are taken over that order, and each source is cut
at its exact budget: whole epochs first, then the documents before the cut, then a part
of the one document in which the cut falls.

Defined results: a null or empty text has size 0 and takes 0. A null source is a source
of its own and comes last; the empty string is a source. A null id is keyed as the text
``null``. Repeated rows are separate documents; rows with the same key are ordered by id
and size, so that reruns agree whatever the partitions. An empty table gives no rows.
Only the columns named are read, so extra columns can't clash.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm.batches import slices
from lodestone.session import cut, stored, unused

WORD = r"[^\x20\x09-\x0D]+"


def targets(totals: Sequence[tuple[str | None, int]], weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> dict[str | None, float]:
    """Each source's share of all sizes by weight, none above ``cap`` times its size.

    What a cap takes away is shared anew by weight. With a water level w the target is
    min(weight * w, cap * size); the capped sources are those of least size / weight.
    """
    order = sorted((s for s, _ in totals if s is not None)) + [None] * any(s is None for s, _ in totals)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    size = {s: int(n) for s, n in totals}
    total = sum(size.values())
    by_ratio = sorted(order, key=lambda s: (size[s] / weight[s], order.index(s)))
    out: dict[str | None, float] = {}
    open_weight, given = sum(weight.values()), 0.0
    for at, s in enumerate(by_ratio):
        level = (total - given) / open_weight
        if weight[s] * level <= cap * size[s]:
            return out | {s: weight[s] * level for s in by_ratio[at:]}
        out[s] = cap * size[s]
        given += out[s]
        open_weight -= weight[s]
    return out


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per source, the sum of the sizes before each row of a sorted partition."""
    before: dict[str | None, int] = {}
    for b in batches:
        source = b["source"].where(b["source"].notna(), None)
        runs = (source.fillna("") != source.shift().fillna("")) | (source.isna() != source.shift().isna())
        parts = []
        for _, rows in b.groupby(runs.cumsum(), sort=False):
            s = rows["source"].iloc[0]
            s = None if pd.isna(s) else s
            sums = rows["size"].cumsum()
            parts.append(sums - rows["size"] + before.get(s, 0))
            before[s] = before.get(s, 0) + int(sums.iloc[-1])
        if parts:
            b = b.assign(before=pd.concat(parts).astype("int64"))
            yield b[["id", "source", "size", "key", "part", "before"]]


def mix_sources(
    docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes of the document, repeats counted. The
    driver gets one row per source (weights need all of them) and nothing per document.
    """
    spark = docs.sparkSession
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))))),
        "mix-sizes",
    )
    totals = [(r["source"], int(r["n"])) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    target = targets(totals, weights, cap)
    plan = spark.createDataFrame([(s, n, float(target[s])) for s, n in totals], "source string, source_size long, target double")

    ordered = cut(
        sized.repartitionByRange(F.col("source").asc_nulls_last(), "key", "id", "size")
        .sortWithinPartitions(F.col("source").asc_nulls_last(), "key", "id", "size")
    )
    placed = ordered.withColumn("part", F.spark_partition_id())
    local = placed.mapInPandas(_running, StructType([*placed.schema.fields, StructField("before", LongType())]))
    # a row for each partition and source that meet: partitions + sources at most, as the rows are range-sorted
    offsets = (
        placed.groupBy("source", "part").agg(F.sum("size").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("source").alias("o_source"), F.col("part").alias("o_part"), "offset")
    )
    plan = plan.select(F.col("source").alias("p_source"), "source_size", "target")
    budget, n = F.floor("target").cast("long"), F.col("source_size")
    epochs = F.when(n > 0, F.floor(budget / n)).otherwise(0).cast("long")
    return (
        local.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("part") == F.col("o_part")))
        .join(plan, F.col("source").eqNullSafe(F.col("p_source")))
        .withColumn("taken", epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * n - F.col("before") - F.col("offset"))))
        .select("id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
    )


def mixed_documents(
    docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows as the mix takes them: whole copies, and where a cut falls the text up to the cut.

    A row whose words the mix doesn't take goes. Rows of one id and size are interchangeable.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    n_, k_, of_, takens_, taken_, size_ = unused(docs, "n", "k", "of", "takens", "taken", "size")
    mix = mix_sources(docs, weights=weights, cap=cap, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col)
    plan = mix.groupBy(F.col("id").alias(of_), F.col("size").alias(n_)).agg(F.sort_array(F.collect_list("taken")).alias(takens_))
    rows = docs.withColumn(size_, size)
    ranked = rows.withColumn(k_, F.row_number().over(Window.partitionBy(id_col, size_).orderBy(text_col)))
    joined = ranked.join(plan, F.col(id_col).eqNullSafe(F.col(of_)) & (F.col(size_) == F.col(n_)))
    taken = joined.withColumn(taken_, F.element_at(takens_, F.col(k_))).where(F.col(taken_) > 0)
    picked = taken.select(*[F.col(f"`{c}`") for c in docs.columns], size_, taken_)
    at = docs.columns.index(text_col)
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            size, take = (np.asarray(b.column(i)) for i in (b.num_columns - 2, b.num_columns - 1))
            whole = b.select(range(b.num_columns - 2))
            yield whole.take(pa.array(np.repeat(np.arange(b.num_rows), take // size)))
            if len(part := np.flatnonzero(take % size)):
                rows = whole.take(pa.array(part))
                ends = [next(itertools.islice(word.finditer(t), int(k) - 1, None)).end() for t, k in zip(rows.column(at).to_pylist(), (take % size)[part], strict=True)]
                texts = pa.array([t[:e] for t, e in zip(rows.column(at).to_pylist(), ends, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(rows.columns)], schema=whole.schema)

    return picked.mapInArrow(run, docs.schema)


#: The same in SQL; {weights} sources take 1, 2, 3 in turn, the cap is 3.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM w),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
c AS (SELECT *, (SELECT min(k) FROM l WHERE weight * level <= 3.0::DOUBLE * source_size) AS first FROM l),
t AS (SELECT a.source, a.source_size,
             CASE WHEN a.first IS NULL OR a.k < a.first THEN 3.0::DOUBLE * a.source_size ELSE a.weight * b.level END AS target
      FROM c a LEFT JOIN l b ON b.k = a.first),
x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM x
"""
