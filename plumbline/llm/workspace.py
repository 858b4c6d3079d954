"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which the shuffle files of a query go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the tables written inside each open `keep_result`.
_open: list[list[str]] = []
_local: dict[str, str] = {}


def _hadoop_path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, with its scheme. Where that is unset, as
    in tests, a local master gets a folder of its own, and a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        folder = _local[app]
    path, store = _hadoop_path(spark, folder)
    return store.makeQualified(path).toString().rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(folder)
    return folder


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends there,
    and a lost executor costs no more than the tasks that it ran."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def keep_result(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Keeps the table that `make` returns and deletes all others that were kept on the way."""
    _open.append([])
    try:
        df = make()
    finally:
        made = _open.pop()
    out = keep(df, name)
    for folder in made:
        path, store = _hadoop_path(spark, folder)
        store.delete(path, True)
    return out


def in_tasks(work: DataFrame, per_task: int = 16) -> DataFrame:
    """Deals the rows of a kept table evenly over tasks: a task each while they are few,
    `per_task` in a task when they are many. Rows that only name work (ranges, files) are
    so small that Spark would put them all into one task."""
    n, cores = work.count(), work.sparkSession.sparkContext.defaultParallelism
    return work.repartition(max(1, min(n, 4 * cores), -(-n // per_task)))


#: Buckets of ids that `split_near` broadcasts at most.
BUCKETS = 1 << 20


def split_near(df: DataFrame, ids: DataFrame, column: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows that may have one of the values of a column, and rows that have none: a join need
    shuffle the first alone.

    Values are known by one of BUCKETS hash buckets, so what is broadcast is bounded
    whatever their number (beyond about a million values nearly all rows are near);
    a null has none.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    taken = F.broadcast(ids.select(bucket(column).alias("_taken")).distinct())
    marked = F.col("_bucket") == F.col("_taken")
    rows = df.withColumn("_bucket", F.when(F.col(column).isNotNull(), bucket(column)))
    return rows.join(taken, marked, "left_semi").drop("_bucket"), rows.join(taken, marked, "left_anti").drop("_bucket")
