"""CSV in, CSV and JSON out. Wide tables stay distributed; only summaries become single files."""

from __future__ import annotations

import json
import math
import os
from datetime import date, datetime
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, infer: bool = True) -> DataFrame:
    """A CSV file with a header; only `columns` are parsed, if given."""
    df = spark.read.csv(path, header=True, inferSchema=infer, enforceSchema=False)
    return df.select(*columns) if columns else df


def read_csv_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """None where no file is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return read_csv(spark, path, infer=False) if there else None


def read_csv_or_empty(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """As texts; a table without rows (of the named columns) where no file is."""
    found = read_csv_if_there(spark, path)
    if found is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or []]))
    return found.select(*columns) if columns else found


def read_excel(spark: SparkSession, path: str, header: int = 1, drop: tuple[str, ...] = ("ID",)) -> DataFrame:
    """A spreadsheet, where pandas has a reader for it; spreadsheets are small by their format."""
    frame = pd.read_excel(path, header=header).drop(columns=list(drop), errors="ignore")
    return spark.createDataFrame(frame)


def number_of(c: Column | str) -> Column:
    """Text as a number: empty or not numeric gives null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", F.trim(c).try_cast("double"))


def number_or_text(c: Column | str) -> Column:
    """Text as a struct: `number` if it is one, else `text` as it stands; both null for null and for the empty text."""
    c = F.col(c) if isinstance(c, str) else c
    number = number_of(c)
    return F.struct(number.alias("number"), F.when(number.isNull() & (c != ""), c).alias("text"))


def renamed(df: DataFrame) -> DataFrame:
    """Column names in lower case, with _ for spaces."""
    return df.toDF(*(c.strip().lower().replace(" ", "_") for c in df.columns))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """single: one part file, for summaries."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def curve_table(points: DataFrame, fits: DataFrame, extrapolate_to: tuple[int, ...] = (500, 1000)) -> DataFrame:
    """One row per pool size; per metric _mean, _stderr, _floor, _k, _r2, _anomalous and _extrap_N columns."""
    names = sorted(r["metric"] for r in fits.select("metric").distinct().collect())
    met = points.join(fits.select("metric", "floor", "k", "r2", "anomalous", "extrapolations"), "metric")
    cell = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    columns = []
    for m in names:
        columns += [cell(m, F.col(c)).alias(f"{m}_{c}") for c in ("mean", "stderr", "floor", "k", "r2", "anomalous")]
        columns += [cell(m, F.col("extrapolations")[n]).alias(f"{m}_extrap_{n}") for n in extrapolate_to]
    return met.groupBy("pool_size").agg(*columns).orderBy("pool_size")


def write_curves(table: DataFrame, path: str, notes: dict | None = None) -> None:
    """A curve table (a row for each pool) as one local file with `# key: value` lines on top."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as out:
        out.writelines(f"# {k}: {v}\n" for k, v in (notes or {}).items())
        table.toPandas().to_csv(out, index=False)


def plain(value):
    """Python's own types; NaN and infinities as None."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    if isinstance(value, np.generic):
        return plain(value.item())
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def write_json(document: dict, path: str) -> None:
    """One result document as a local file, replaced as a whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(plain(document), indent=2), encoding="utf-8")
    os.replace(part, target)
