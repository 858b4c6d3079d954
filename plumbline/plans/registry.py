"""How queries and their SQL are named and rounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS decimals, without a negative zero."""
    return df.select(*((F.round(f.name, DIGITS) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


def query(name: str, columns: str, sql: str | None = None) -> Callable:
    """Registers a function of a table reader. columns: the result's, doubles marked by ~.

    The SQL's doubles are rounded as the DataFrame's are.
    """
    names = columns.split()

    def add(function: Callable[..., DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
            return rounded(got.select(*(n.lstrip("~") for n in names)))

        QUERIES[name] = run
        if sql:
            outer = ", ".join(f"round({n[1:]}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS {n[1:]}" if n[0] == "~" else n for n in names)
            SQL[name] = f"SELECT {outer} FROM ({sql}) AS result"
        return function

    return add
