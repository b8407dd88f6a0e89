"""Registered queries over the test tables and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import bounds
from lodestone.operators import output, projection
from lodestone.plans.levelwise import mine
from lodestone.plans.utility_list import mine_lists
from lodestone.session import shared_dir, stored
from lodestone.sources import relational, spmf

#: Minimum utilities of the queries.
BRAND, PART, SUPP, EVENTS, LOW = 2000, 400, 1600, 4_000_000, 500
#: The rank that the projection queries project on.
RANK = 10

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.itemset_text(mine(relational.part_baskets(spark, sf_dir), 200).found)


def _revised(spark: SparkSession, sf_dir: str, min_util: int = BRAND) -> DataFrame:
    tx = stored(relational.brand_baskets(spark, sf_dir), "baskets")  # read for the bounds, and again
    return bounds.revised(tx, bounds.ranks(bounds.promising(bounds.twu(tx), min_util)))


def tx_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.part_baskets(spark, sf_dir)


def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.statistics(relational.part_baskets(spark, sf_dir))


def twu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.twu(relational.part_baskets(spark, sf_dir))


def items_promising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.promising(bounds.twu(relational.part_baskets(spark, sf_dir)), PART)


def item_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.ranks(bounds.promising(bounds.twu(relational.part_baskets(spark, sf_dir)), PART))


def tx_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _revised(spark, sf_dir)


def first_su(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.first_su(_revised(spark, sf_dir))


def items_explore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.first_su(_revised(spark, sf_dir)).where(F.col("su") >= BRAND)


def utility_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.utility_lists(_revised(spark, sf_dir))


def ul_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bounds.summary(bounds.utility_lists(_revised(spark, sf_dir)), "r")
    return found.withColumn("extendable", F.col("iu") + F.col("ru") >= BRAND)


def eucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.pair_bounds(_revised(spark, sf_dir))


def eucs_promising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.pair_bounds(_revised(spark, sf_dir)).where(F.col("eucs") >= BRAND)


def ul_join_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = projection.join_pairs(bounds.utility_lists(_revised(spark, sf_dir)), BRAND)
    return bounds.summary(pairs, "x", "y")


def project_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.project(_revised(spark, sf_dir), RANK)
    return rows.select("tid", "pu", "tu", F.array_join("rem.r", " ").alias("items"), F.array_join("rem.u", " ").alias("utils"))


def bounds_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _revised(spark, sf_dir)
    limits = bounds.extension_bounds(rows, bounds.first_su(rows).where(F.col("su") >= BRAND))
    return limits.withColumn("explore", F.col("su") >= BRAND).withColumn("keep", (F.col("su") >= BRAND) | (F.col("lu") >= BRAND))


def merge_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = projection.merge_equal(projection.project(_revised(spark, sf_dir), RANK))
    return merged.select("pu", "n", F.array_join("rem.r", " ").alias("items"), F.array_join("rem.u", " ").alias("utils"))


def _mined(baskets: str, min_util: int, **options: object) -> Query:
    return lambda spark, sf_dir: output.itemset_text(mine(relational.BASKETS[baskets](spark, sf_dir), min_util, **options).found)


def hui_fhm_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.itemset_text(mine_lists(relational.brand_baskets(spark, sf_dir), BRAND).found)


def hui_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.lines(mine(relational.supplier_baskets(spark, sf_dir), SUPP).found)


def candidate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Itemsets whose extension was tried: by bounds (with the published local bound), and by lists with the pairs that were joined."""
    tx = stored(relational.brand_baskets(spark, sf_dir), "baskets")
    return spark.createDataFrame([("efim", mine(tx, BRAND, tighten=False).candidates), ("fhm", mine_lists(tx, BRAND).candidates)], "algorithm string, candidates long")


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = mine(relational.brand_baskets(spark, sf_dir), BRAND)
    return output.report(mined.found, min_util=BRAND, candidates=mined.candidates).select("min_util", "n_itemsets", "total_util", "longest")


def spmf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part baskets as text lines, parsed again: (tid, item, u), tid the line's order key."""
    lines = relational.part_baskets(spark, sf_dir).groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("item", "u"))).alias("s"), F.sum("u").alias("tu"))
    text = lines.select("tid", F.concat_ws(":", F.array_join("s.item", " "), F.col("tu").cast("string"), F.array_join("s.u", " ")).alias("value"))
    # the key travels in a comment, as the format has no place for it
    written = stored(text.select(F.concat("value", F.lit(" # "), F.col("tid").cast("string")).alias("value")), "spmf")
    parsed = spmf.parse_lines(written).where("reason is null").select("tid", "tu", F.arrays_zip("items", "utils").alias("z"))
    return parsed.select("tu", F.explode("z").alias("e")).groupBy(F.col("e.items").alias("item")).agg(F.sum("e.utils").alias("u"), F.sum("tu").alias("twu"), F.count(F.lit(1)).alias("n"))


def spmf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part baskets written as a folder of text files, numbers between tabs, and read again: each item's utility, twu and baskets."""
    lines = relational.part_baskets(spark, sf_dir).groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("item", "u"))).alias("s"), F.sum("u").alias("tu"))
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.select(F.concat_ws(":", F.array_join("s.item", "\t"), F.col("tu").cast("string"), F.array_join("s.u", "\t")).alias("value")).write.text(folder)
    tx, declared = spmf.to_transactions(spmf.read_spmf(spark, folder, mode="FAILFAST")[0])
    whole = tx.join(declared, "tid")
    return whole.groupBy("item").agg(F.sum("u").alias("u"), F.sum("tu").alias("twu"), F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return {
        "tx_build": tx_build, "db_stats": db_stats, "twu": twu, "items_promising": items_promising, "item_rank": item_rank, "tx_revised": tx_revised,
        "first_su": first_su, "items_explore": items_explore, "utility_lists": utility_lists, "ul_summary": ul_summary, "eucs": eucs, "eucs_promising": eucs_promising,
        "ul_join_k2": ul_join_k2, "project_x": project_x, "bounds_depth1": bounds_depth1, "merge_suffix": merge_suffix,
        "hui_part": _mined("part", PART), "hui_supp": _mined("supp", SUPP), "hui_brand": _mined("brand", BRAND), "hui_events": _mined("events", EVENTS),
        "hui_brand_levelwise": _mined("brand", BRAND, local_elements=0), "hui_brand_merged": _mined("brand", BRAND, local_elements=0, merging=True),
        "hui_brand_low": _mined("brand", LOW), "hui_fhm_brand": hui_fhm_brand, "hui_text": hui_text, "candidate_count": candidate_count, "run_report": run_report,
        "spmf_parse": spmf_parse, "spmf_file": spmf_file,
    }


_TX = {
    "part": "SELECT l_orderkey AS tid, l_partkey + 1 AS item, CAST(sum(l_quantity) AS BIGINT) AS u FROM lineitem GROUP BY ALL",
    "supp": "SELECT l_orderkey AS tid, l_suppkey + 1 AS item, CAST(sum(l_quantity) AS BIGINT) AS u FROM lineitem GROUP BY ALL",
    "brand": "SELECT l_orderkey AS tid, CAST(substr(p_brand, 7) AS BIGINT) AS item, CAST(sum(l_quantity) AS BIGINT) AS u FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "events": "SELECT dense_rank() OVER (ORDER BY user_id, day) AS tid, item, u FROM (SELECT user_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS item, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS u FROM events GROUP BY ALL) WHERE item IS NOT NULL AND u IS NOT NULL",
}


def _twu(baskets: str, min_util: int = 0) -> str:
    return f"""tx AS ({_TX[baskets]}), tu AS (SELECT tid, CAST(sum(u) AS BIGINT) AS tu FROM tx GROUP BY tid),
tw AS (SELECT item, CAST(sum(tu) AS BIGINT) AS twu FROM tx JOIN tu USING (tid) GROUP BY item HAVING sum(tu) >= {min_util})"""


_RANKED = f"""{_twu("brand", BRAND)}, rk AS (SELECT item, twu, row_number() OVER (ORDER BY twu, item)::INT AS r FROM tw),
rv AS (SELECT tid, r, u FROM tx JOIN rk USING (item)),
ul AS (SELECT r, tid, u AS iu, CAST(coalesce(sum(u) OVER (PARTITION BY tid ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS ru FROM rv),
su AS (SELECT r, CAST(sum(iu + ru) AS BIGINT) AS su FROM ul GROUP BY r)"""
_PROJECTED = f"""{_RANKED}, pr AS (SELECT a.tid, a.iu AS pu, a.ru AS tu, coalesce(string_agg(b.r, ' ' ORDER BY b.r), '') AS items, coalesce(string_agg(b.u, ' ' ORDER BY b.r), '') AS utils, list(b.u ORDER BY b.r) FILTER (b.u IS NOT NULL) AS us
FROM ul a LEFT JOIN rv b ON a.tid = b.tid AND b.r > {RANK} WHERE a.r = {RANK} GROUP BY a.tid, a.iu, a.ru)"""


def _itemsets(baskets: str, min_util: int) -> str:
    """Every subset of every basket, summed: no pruning, so an independent answer."""
    return f"""WITH RECURSIVE tx AS MATERIALIZED ({_TX[baskets]}),
s(tid, last, items, u) AS (SELECT tid, item, [item], u FROM tx UNION ALL
  SELECT s.tid, t.item, list_append(s.items, t.item), s.u + t.u FROM s JOIN tx t ON s.tid = t.tid AND t.item > s.last)
SELECT array_to_string(items, ' ') AS itemset, CAST(sum(u) AS BIGINT) AS util FROM s GROUP BY 1 HAVING sum(u) >= {min_util}"""


_PARSED = f"WITH tx AS ({_TX['part']}), t AS (SELECT tid, sum(u) AS tu FROM tx GROUP BY tid) SELECT item, CAST(sum(u) AS BIGINT) AS u, CAST(sum(tu) AS BIGINT) AS twu, count(*) AS n FROM tx JOIN t USING (tid) GROUP BY item"


def _efim_candidates(min_util: int, depth: int = 9) -> str:
    """Explored itemsets, level by level: kept items by su or lu (of all later elements and the unpromising), explored ones by su.

    ``depth`` levels are written out; the last must be empty, else the count is null.
    """
    out = f"""WITH {_RANKED}, slack AS (SELECT tid, tu.tu - sum(rv.u) AS extra FROM rv JOIN tu USING (tid) GROUP BY tid, tu.tu),
e0 AS (SELECT r AS z FROM su WHERE su >= {min_util}),
s1 AS (SELECT [ul.r] AS p, ul.tid, ul.iu AS pu, ul.r AS last FROM ul JOIN e0 ON ul.r = e0.z),
k1 AS (SELECT DISTINCT s1.p, rk.r AS z FROM (SELECT DISTINCT p, last FROM s1) s1 JOIN rk ON rk.r > s1.last)"""
    for d in range(1, depth):
        out += f""",
x{d} AS (SELECT s.p, s.tid, s.pu, v.r AS z, v.u, k.z IS NOT NULL AS may, sum(CASE WHEN k.z IS NOT NULL THEN v.u ELSE 0 END) OVER (PARTITION BY s.p, s.tid ORDER BY v.r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  sum(v.u) OVER (PARTITION BY s.p, s.tid) AS whole FROM s{d} s JOIN rv v ON v.tid = s.tid AND v.r > s.last LEFT JOIN k{d} k ON k.p = s.p AND k.z = v.r),
b{d} AS (SELECT p, z, sum(pu + rest) AS su, sum(pu + extra + whole) AS lu FROM x{d} JOIN slack USING (tid) WHERE may GROUP BY p, z HAVING sum(pu + rest) >= {min_util} OR sum(pu + extra + whole) >= {min_util}),
e{d} AS (SELECT p, z FROM b{d} WHERE su >= {min_util}),
s{d + 1} AS (SELECT list_append(x.p, x.z) AS p, x.tid, x.pu + x.u AS pu, x.z AS last FROM x{d} x JOIN e{d} e ON e.p = x.p AND e.z = x.z),
k{d + 1} AS (SELECT list_append(e.p, e.z) AS p, b.z FROM e{d} e JOIN b{d} b ON b.p = e.p AND b.z > e.z)"""
    total = " + ".join(f"(SELECT count(*) FROM e{d})" for d in range(depth))
    return f"SELECT * FROM ({out} SELECT 'efim' AS algorithm, CASE WHEN (SELECT count(*) FROM e{depth - 1}) = 0 THEN CAST({total} AS BIGINT) END AS candidates)"


def _fhm_candidates(min_util: int, depth: int = 8) -> str:
    """Lists at every node and surviving pairs of those that can be extended; a list counts if the bound of what its left parent shares with it is enough."""
    out = f"""WITH {_twu("brand", BRAND)}, rk AS (SELECT item, row_number() OVER (ORDER BY twu, item DESC)::INT AS r FROM tw),
rv AS (SELECT tid, r, u FROM tx JOIN rk USING (item)), kept AS (SELECT tid, sum(u) AS tu FROM rv GROUP BY tid),
eu AS (SELECT a.r AS a, b.r AS b FROM rv a JOIN rv b ON a.tid = b.tid AND a.r < b.r JOIN kept ON kept.tid = a.tid GROUP BY a.r, b.r HAVING sum(tu) >= {min_util}),
l1 AS (SELECT CAST([] AS INT[]) AS p, r AS x, tid, u AS iu, coalesce(sum(u) OVER (PARTITION BY tid ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS ru, 0 AS piu FROM rv),
n1 AS (SELECT p, x, sum(iu) AS iu, sum(ru) AS ru FROM l1 GROUP BY p, x)"""
    for d in range(1, depth):
        out += f""",
t{d} AS (SELECT a.p, a.x, b.x AS y FROM n{d} a JOIN n{d} b ON a.p = b.p AND a.x < b.x JOIN eu ON eu.a = a.x AND eu.b = b.x WHERE a.iu + a.ru >= {min_util}),
j{d} AS (SELECT list_append(t.p, t.x) AS p, t.y AS x, i.tid, i.iu + j.iu - i.piu AS iu, j.ru, i.iu AS piu, i.iu + i.ru AS bound
  FROM t{d} t JOIN l{d} i ON i.p = t.p AND i.x = t.x JOIN l{d} j ON j.p = t.p AND j.x = t.y AND j.tid = i.tid),
n{d + 1} AS (SELECT p, x, sum(iu) AS iu, sum(ru) AS ru FROM j{d} GROUP BY p, x HAVING sum(bound) >= {min_util}),
l{d + 1} AS (SELECT j.p, j.x, tid, j.iu, j.ru, piu FROM j{d} j JOIN n{d + 1} n ON n.p = j.p AND n.x = j.x)"""
    total = " + ".join([f"(SELECT count(*) FROM n{d})" for d in range(1, depth + 1)] + [f"(SELECT count(*) FROM t{d})" for d in range(1, depth)])
    return f"SELECT * FROM ({out} SELECT 'fhm' AS algorithm, CASE WHEN (SELECT count(*) FROM n{depth}) = 0 THEN CAST({total} AS BIGINT) END AS candidates)"


def oracle_sql() -> dict[str, str]:
    brand = _itemsets("brand", BRAND)
    return {
        "tx_build": _TX["part"],
        "db_stats": f"WITH tx AS ({_TX['part']}), p AS (SELECT tid, count(*) AS n, sum(u) AS tu, max(item) AS top FROM tx GROUP BY tid) "
        "SELECT count(*) AS n_tx, (SELECT count(DISTINCT item) FROM tx) AS n_items, max(top) AS max_item, CAST(sum(tu) AS BIGINT) AS total, avg(n) AS avg_len, max(n) AS max_len FROM p",
        "twu": f"WITH {_twu('part')} SELECT item, twu FROM tw",
        "items_promising": f"WITH {_twu('part', PART)} SELECT item, twu FROM tw",
        "item_rank": f"WITH {_twu('part', PART)} SELECT item, twu, row_number() OVER (ORDER BY twu, item)::INT AS r FROM tw",
        "tx_revised": f"WITH {_RANKED} SELECT tid, r, u FROM rv",
        "first_su": f"WITH {_RANKED} SELECT r, su FROM su",
        "items_explore": f"WITH {_RANKED} SELECT r, su FROM su WHERE su >= {BRAND}",
        "utility_lists": f"WITH {_RANKED} SELECT r, tid, iu, ru FROM ul",
        "ul_summary": f"WITH {_RANKED} SELECT r, CAST(sum(iu) AS BIGINT) AS iu, CAST(sum(ru) AS BIGINT) AS ru, count(*) AS n, sum(iu + ru) >= {BRAND} AS extendable FROM ul GROUP BY r",
        "eucs": f"WITH {_RANKED}, t AS (SELECT tid, sum(u) AS tu FROM rv GROUP BY tid) SELECT a.r AS a, b.r AS b, CAST(sum(tu) AS BIGINT) AS eucs FROM rv a JOIN rv b ON a.tid = b.tid AND a.r < b.r JOIN t ON t.tid = a.tid GROUP BY ALL",
        "eucs_promising": f"WITH {_RANKED}, t AS (SELECT tid, sum(u) AS tu FROM rv GROUP BY tid) SELECT a.r AS a, b.r AS b, CAST(sum(tu) AS BIGINT) AS eucs FROM rv a JOIN rv b ON a.tid = b.tid AND a.r < b.r JOIN t ON t.tid = a.tid GROUP BY ALL HAVING sum(tu) >= {BRAND}",
        "ul_join_k2": f"WITH {_RANKED} SELECT a.r AS x, b.r AS y, CAST(sum(a.iu + b.iu) AS BIGINT) AS iu, CAST(sum(b.ru) AS BIGINT) AS ru, count(*) AS n FROM ul a JOIN ul b ON a.tid = b.tid AND a.r < b.r WHERE a.r IN (SELECT r FROM ul GROUP BY r HAVING sum(iu + ru) >= {BRAND}) GROUP BY ALL",
        "project_x": f"WITH {_PROJECTED} SELECT tid, pu, tu, items, utils FROM pr",
        "bounds_depth1": f"WITH {_RANKED}, b AS (SELECT a.r AS x, b.r AS z, CAST(sum(a.iu + b.iu + b.ru) AS BIGINT) AS su, CAST(sum(a.iu + a.ru) AS BIGINT) AS lu FROM ul a JOIN su ON su.r = a.r AND su.su >= {BRAND} JOIN ul b ON a.tid = b.tid AND a.r < b.r GROUP BY ALL) SELECT x, z, su, lu, su >= {BRAND} AS explore, su >= {BRAND} OR lu >= {BRAND} AS keep FROM b",
        "merge_suffix": f"WITH {_PROJECTED}, e AS (SELECT items, pos, sum(us[pos]) AS u FROM pr, unnest(range(1, len(us) + 1)) AS t(pos) GROUP BY ALL), f AS (SELECT items, string_agg(CAST(u AS BIGINT), ' ' ORDER BY pos) AS utils FROM e GROUP BY items) SELECT CAST(sum(pu) AS BIGINT) AS pu, count(*) AS n, pr.items, coalesce(any_value(f.utils), '') AS utils FROM pr LEFT JOIN f ON f.items = pr.items GROUP BY pr.items",
        "hui_part": _itemsets("part", PART), "hui_supp": _itemsets("supp", SUPP), "hui_brand": brand, "hui_events": _itemsets("events", EVENTS),
        "hui_brand_levelwise": brand, "hui_brand_merged": brand, "hui_brand_low": _itemsets("brand", LOW), "hui_fhm_brand": brand,
        "hui_text": f"SELECT itemset || ' #UTIL: ' || util AS value FROM ({_itemsets('supp', SUPP)})",
        "run_report": f"SELECT CAST({BRAND} AS BIGINT) AS min_util, count(*) AS n_itemsets, CAST(sum(util) AS BIGINT) AS total_util, CAST(max(len(string_split(itemset, ' '))) AS INT) AS longest FROM ({brand})",
        "candidate_count": _efim_candidates(BRAND) + " UNION ALL " + _fhm_candidates(BRAND),
        "spmf_file": _PARSED,
        "spmf_parse": _PARSED,
    }
