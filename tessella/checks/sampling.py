"""Samples, splits, draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessella.checks.registry import check, table
from tessella.operators import sampling as S

LABEL, KEY = "o_orderpriority", "o_orderkey"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _rank_sql(seed: int, source: str = "orders") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {LABEL} ORDER BY md5(concat_ws('|', '{seed}', {LABEL}, {KEY})), {KEY}) - 1 AS rk FROM {source}"


def _orders(spark, sf):
    return table(spark, sf, "orders").select(KEY, "o_custkey", LABEL, "o_totalprice", "o_orderdate")


@check("stratified_sample", f"SELECT {KEY}, {LABEL}, row_number() OVER (ORDER BY {LABEL}, rk) - 1 AS source_index FROM ({_rank_sql(42)}) q WHERE rk < 100")
def stratified_sample(spark, sf):
    return S.ordered_strata(_orders(spark, sf), LABEL, 100, 42, [KEY]).select(KEY, LABEL, "source_index")


@check("union_parts", f"SELECT {KEY}, {LABEL} FROM ({_rank_sql(5)}) q WHERE rk < CASE WHEN {LABEL} IN ('1-URGENT', '2-HIGH') THEN 30 ELSE 20 END")
def union_parts(spark, sf):
    """Union of per-class samples whose sizes differ."""
    orders = _orders(spark, sf)
    parts = [S.stratified_sample(orders, LABEL, 30 if p < "3" else 20, 5, [KEY], [p]) for p in PRIORITIES]
    return reduce(lambda a, b: a.unionByName(b), parts).select(KEY, LABEL)


@check("holdout_sample", f"""WITH sel AS (SELECT {KEY} FROM ({_rank_sql(42)}) q WHERE rk < 100), rest AS (SELECT * FROM orders ANTI JOIN sel USING ({KEY}))
  SELECT {KEY}, {LABEL} FROM ({_rank_sql(1042, 'rest')}) q WHERE rk < 40""")
def holdout_sample(spark, sf):
    orders = _orders(spark, sf)
    selection = S.stratified_sample(orders, LABEL, 100, 42, [KEY])
    return S.holdout_sample(orders, selection, LABEL, 40, 1042, [KEY]).select(KEY, LABEL)


LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
ORDERED = "l_shipdate {d}, l_partkey {d}, l_suppkey {d}, l_linenumber {d}"


def _dedup_sql(d: str) -> str:
    return f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDERED.format(d=d)}) AS rn FROM lineitem) q WHERE rn = 1"


@check("dedup_first", _dedup_sql("ASC"))
def dedup_first(spark, sf):
    rows = table(spark, sf, "lineitem").select(*LINES)
    return S.keep_first(rows, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"]).drop("l_shipdate")


@check("dedup_last", _dedup_sql("DESC"))
def dedup_last(spark, sf):
    rows = table(spark, sf, "lineitem").select(*LINES)
    return S.keep_last(rows, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"]).drop("l_shipdate")


SPLIT_SQL = """g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5(concat_ws('|', '7', o_custkey)), o_custkey) - 1 AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders) q),
side AS (SELECT o_custkey, CASE WHEN rk < ceil(0.2::DOUBLE * n) THEN 'val' ELSE 'train' END AS split FROM g)"""


@check("group_split", f"WITH {SPLIT_SQL} SELECT o_orderkey, split FROM orders JOIN side USING (o_custkey)")
def group_split(spark, sf):
    return S.group_split(_orders(spark, sf), "o_custkey", 0.2, 7).select(KEY, "split")


@check("split_report", f"WITH {SPLIT_SQL} SELECT split, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups, min(o_custkey) AS first_group, max(o_custkey) AS last_group FROM orders JOIN side USING (o_custkey) GROUP BY split")
def split_report(spark, sf):
    return S.split_report(S.group_split(_orders(spark, sf), "o_custkey", 0.2, 7), "o_custkey")


@check("class_weights", f"SELECT {LABEL}, count(*) AS n, round(1.0::DOUBLE / count(*), 9) AS weight FROM orders GROUP BY {LABEL}")
def class_weights(spark, sf):
    return S.class_weights(_orders(spark, sf), LABEL).withColumn("weight", F.round("weight", 9))


def _unit(part: str) -> str:
    return f"(CAST(concat('0x', substr(md5(concat_ws('|', '42', '{part}', draw)), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@check("weighted_draw", f"""WITH pos AS ({_rank_sql(42)}), cls AS (SELECT {LABEL}, count(*) AS size, row_number() OVER (ORDER BY {LABEL}) - 1 AS c FROM orders GROUP BY {LABEL}),
  drawn AS (SELECT draw, CAST(floor({_unit('class')} * (SELECT count(*) FROM cls)) AS BIGINT) AS c, {_unit('row')} AS u FROM (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS draw) q)
  SELECT draw, {KEY}, {LABEL} FROM drawn JOIN cls USING (c) JOIN pos USING ({LABEL}) WHERE rk = CAST(floor(u * size) AS BIGINT)""")
def weighted_draw(spark, sf):
    return S.weighted_draw(_orders(spark, sf), LABEL, None, 42, [KEY]).select("draw", KEY, LABEL)


@check("head_n", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def head_n(spark, sf):
    return _orders(spark, sf).orderBy("o_orderdate", KEY).limit(25).select(KEY, "o_custkey")


#: Orders of which every third has no label and every customer divisible by five no number.
GAPS_SQL = f"""gaps AS (SELECT {KEY}, CASE WHEN {KEY} % 3 <> 0 THEN {LABEL} END AS {LABEL}, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS o_custkey FROM orders)"""


def _gaps(spark, sf):
    label = F.when(F.col(KEY) % 3 != 0, F.col(LABEL)).alias(LABEL)
    return table(spark, sf, "orders").select(KEY, label, F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"))


@check("stratified_sample_null", f"WITH {GAPS_SQL} SELECT {KEY}, {LABEL}, row_number() OVER (ORDER BY {LABEL} NULLS FIRST, rk) - 1 AS source_index FROM ({_rank_sql(42, 'gaps')}) q WHERE rk < 100")
def stratified_sample_null(spark, sf):
    return S.ordered_strata(_gaps(spark, sf), LABEL, 100, 42, [KEY]).select(KEY, LABEL, "source_index")


@check("ranks_null", f"WITH {GAPS_SQL} SELECT {KEY}, rk AS rank FROM ({_rank_sql(42, 'gaps')}) q")
def ranks_null(spark, sf):
    """Ranks of whole groups, NULL being one."""
    return S.hash_rank(_gaps(spark, sf), S.draw_key(42, LABEL, KEY), by=[LABEL], ties=[KEY]).select(KEY, F.col("rank").cast("bigint").alias("rank"))


@check("group_split_null", f"""WITH {GAPS_SQL}, g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5(concat_ws('|', '7', o_custkey)), o_custkey NULLS FIRST) - 1 AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM gaps) q)
  SELECT {KEY}, CASE WHEN rk < ceil(0.2::DOUBLE * n) THEN 'val' ELSE 'train' END AS split FROM gaps JOIN g ON gaps.o_custkey IS NOT DISTINCT FROM g.o_custkey""")
def group_split_null(spark, sf):
    return S.group_split(_gaps(spark, sf), "o_custkey", 0.2, 7).select(KEY, "split")


@check("weighted_draw_null", f"""WITH {GAPS_SQL}, pos AS ({_rank_sql(42, 'gaps')}), cls AS (SELECT {LABEL}, count(*) AS size, row_number() OVER (ORDER BY {LABEL} NULLS FIRST) - 1 AS c FROM gaps GROUP BY {LABEL}),
  drawn AS (SELECT draw, CAST(floor({_unit('class')} * (SELECT count(*) FROM cls)) AS BIGINT) AS c, {_unit('row')} AS u FROM (SELECT unnest(range(0, (SELECT count(*) FROM gaps))) AS draw) q)
  SELECT draw, {KEY}, pos.{LABEL} FROM drawn JOIN cls USING (c) JOIN pos ON cls.{LABEL} IS NOT DISTINCT FROM pos.{LABEL} WHERE rk = CAST(floor(u * size) AS BIGINT)""")
def weighted_draw_null(spark, sf):
    """As many draws as rows, also from the rows without a label."""
    return S.weighted_draw(_gaps(spark, sf), LABEL, None, 42, [KEY]).select("draw", KEY, LABEL)


@check("positions_null", f"WITH {GAPS_SQL} SELECT {KEY}, row_number() OVER (PARTITION BY o_custkey ORDER BY {KEY}) - 1 AS position FROM gaps")
def positions_null(spark, sf):
    return S.with_position(_gaps(spark, sf), [KEY], by=["o_custkey"]).select(KEY, "position")


@check("split_groups", f"WITH {SPLIT_SQL} SELECT split, o_custkey, count(*) AS n_rows FROM orders JOIN side USING (o_custkey) GROUP BY ALL")
def split_groups(spark, sf):
    return S.split_groups(S.group_split(_orders(spark, sf), "o_custkey", 0.2, 7), "o_custkey")


@check("holdout_overlap", f"""WITH sel AS (SELECT {KEY} FROM ({_rank_sql(42)}) q WHERE rk < 100), rest AS (SELECT * FROM orders ANTI JOIN sel USING ({KEY})), hold AS (SELECT {KEY} FROM ({_rank_sql(1042, 'rest')}) q WHERE rk < 40)
  SELECT (SELECT count(*) FROM sel) AS n_selection, (SELECT count(*) FROM hold) AS n_holdout, (SELECT count(*) FROM hold SEMI JOIN sel USING ({KEY})) AS n_overlap""")
def holdout_overlap(spark, sf):
    orders = _orders(spark, sf)
    selection = S.stratified_sample(orders, LABEL, 100, 42, [KEY])
    return S.holdout_overlap(selection, S.holdout_sample(orders, selection, LABEL, 40, 1042, [KEY]), [KEY])
