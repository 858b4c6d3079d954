"""The driver's tables as inputs of the operators: features, targets and attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(read) -> DataFrame:
    """lineitem with target 1 for returned lines."""
    return read("lineitem").withColumn("target", (F.col("l_returnflag") == "R").cast("int"))


def orders(read) -> DataFrame:
    return read("orders").withColumn("target", (F.col("o_orderstatus") == "F").cast("int"))


def attributions(read, resamples: int = 5) -> DataFrame:
    """embeddings as attributions: the components as features, the id modulo as resample."""
    e = read("embeddings").select((F.col("vec_id") % resamples).cast("int").alias("resample"), (F.col("vec_id") / resamples).cast("long").alias("sample"), F.col("embedding").alias("v"))
    return e.select("resample", "sample", F.posexplode("v").alias("feature", "phi")).withColumn("phi", F.col("phi").cast("double"))


# -- the same in SQL -----------------------------------------------------------------------
#: The draw of a key, as `functions.rng.draw` makes it with md5.
DRAW_SQL = "('0x' || substr(md5({}), 1, 13))::BIGINT"
LINES_SQL = "SELECT *, (l_returnflag = 'R')::INT AS target FROM lineitem"
ORDERS_SQL = "SELECT *, (o_orderstatus = 'F')::INT AS target FROM orders"
PHI_SQL = "SELECT (vec_id % 5)::INT AS resample, (vec_id // 5)::BIGINT AS sample, f AS feature, embedding[f + 1]::DOUBLE AS phi FROM (SELECT *, unnest(range(len(embedding)))::INT AS f FROM embeddings)"


def long_sql(source: str, features: list[str], target: str = "target") -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS x, {target} AS y FROM ({source})" for f in features)
