"""What comes from settings and goes to summaries: model lists, maps as dictionary literals, a split with its best metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.checks.registry import check, table
from tessella.checks.sampling import SPLIT_SQL
from tessella.functions import coerce
from tessella.operators import joins, sampling
from tessella.session import new_path
from tessella.sources import sinks

LEGACY = "CASE WHEN p_partkey % 5 = 0 THEN 'null' WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 11 <> 0 THEN concat('/l/', CAST(p_partkey AS VARCHAR(20))) END"


@check("model_legacy", f"""WITH legacy AS (SELECT p_brand AS alias, {LEGACY} AS path, p_partkey AS position FROM part)
  SELECT 'no spec' AS given, alias, arg_min(path, position) AS path FROM legacy WHERE path NOT IN ('', 'null') GROUP BY alias
  UNION ALL SELECT 'specs', concat('m', CAST(n_nationkey AS VARCHAR)), concat('/m/', n_name) FROM nation""")
def model_legacy(spark, sf):
    """Without any spec the legacy list counts, with specs it doesn't."""
    legacy = table(spark, sf, "part").select(F.col("p_brand").alias("alias"), F.expr(LEGACY).alias("path"), F.col("p_partkey").alias("position"))
    specs = table(spark, sf, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string"), F.lit("=/m/"), "n_name").alias("spec"))
    cases = [("no spec", specs.where("false")), ("specs", specs)]
    none, given = (joins.models_or_legacy(joins.resolve_models(s), legacy).select(F.lit(name).alias("given"), "alias", "path") for name, s in cases)
    return none.unionByName(given)


@check("dict_map", "SELECT event_id, (event_id % 50)::DOUBLE AS k, 0.5::DOUBLE AS two, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 100.0 END::DOUBLE AS t FROM events")
def dict_map(spark, sf):
    """Maps spelt as dictionary literals."""
    text = F.expr("""concat("{'k': ", event_id % 50, ", 2: .5, 't': ", CASE WHEN event_id % 3 = 0 THEN 'True' ELSE "'1e2'" END, ",}")""")
    found = table(spark, sf, "events").select("event_id", coerce.float_map(text).alias("m"))
    return found.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["2"].alias("two"), F.col("m")["t"].alias("t"))


@check("split_summary", f"""WITH {SPLIT_SQL}, h AS (SELECT avg((o_orderkey * 37 % 1000) / 1000.0::DOUBLE) AS f FROM orders GROUP BY o_orderkey % 24)
  SELECT count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows, count(DISTINCT o_custkey) FILTER (split = 'train') AS train_groups,
  count(DISTINCT o_custkey) FILTER (split = 'val') AS val_groups, (SELECT round(max(f), 6) FROM h) AS best_val_f1 FROM orders JOIN side USING (o_custkey)""")
def split_summary(spark, sf):
    """A split and the best metric of its training history as a JSON document, written and read again."""
    orders = table(spark, sf, "orders")
    history = orders.groupBy((F.col("o_orderkey") % 24).alias("epoch")).agg(F.avg(F.col("o_orderkey") * 37 % 1000 / 1000.0).alias("val_f1"))
    found = sampling.split_summary(sampling.group_split(orders.select("o_orderkey", "o_custkey"), "o_custkey", 0.2, 7), "o_custkey", history)
    path = new_path(spark, "summary")
    sinks.write_summary(found, path)
    return spark.read.schema(found.schema).json(path).withColumn("best_val_f1", F.round("best_val_f1", 6))
