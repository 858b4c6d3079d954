"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: the tables; BENCH_CPUS: threads of the local master. Each query is
run once after a small warm-up of the session, and its whole result is written to
the null sink.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.operators.analyzer import StabilityAnalyzer
from plumbline.plans import catalog
from plumbline.plans.tables import LINE_KEY, lines

NAMES = ("truncation_severity", "feature_kind", "woe_quantile_bins", "information_value", "wasserstein_by_nation", "ranking_metrics", "repeated_split", "positional_split", "mann_whitney_u", "attribution_features", "feature_drift", "drift_grade", "reliability_rank", "quadrants", "resample_metrics", "learning_curve_fit")


def panel(spark: SparkSession, sf_dir: str):
    """The stability panel of three features: ten pools, ten resamples."""
    rows = lines(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    return StabilityAnalyzer(n_resamples=10, n_points=10).fit_panel(rows, "target", ["l_quantity", "l_extendedprice", "l_discount"], LINE_KEY).summary


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.local.dir", shared)
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.format("noop").mode("overwrite").save()
    queries = catalog.queries()
    took = {}
    for name in NAMES:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    began = time.perf_counter()
    panel(spark, sf_dir).write.format("noop").mode("overwrite").save()
    took["panel_3_features"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total wall-clock of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
