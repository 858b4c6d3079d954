"""All named queries of the stability operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import attribution_queries, feature_queries, marginal_queries  # noqa: F401
from plumbline.plans.registry import QUERIES, SQL, Query, rounded


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stability panel of lineitem."""
    return rounded(marginal_queries.panel_summary(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")).drop("run_timestamp"))
