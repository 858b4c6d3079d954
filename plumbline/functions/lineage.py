"""Tables written on the way: plans end there, instead of growing with every step.

A plan over cached tables prints and plans all of what was cached, again for each use,
so a long computation whose steps only call persist() outgrows the driver. A written
table is a scan, whatever made it, and a lost executor costs no more than its tasks.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task holds before it writes them out: several tasks share a heap.
BLOCK = 8 << 20
#: Spark's setting of how small a task of a shuffle's reader may be.
_LEAST = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
#: Spark's setting that the files of a query's shuffles go when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, as in tests, a local master
    gets a folder of its own, and a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        own = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _local[app] = f"file://{own}"
    return _local[app]


class Written:
    """Tables written for one computation; `release` deletes them, and so does the end of the driver."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self.number = 0
        atexit.register(self.release)

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.number}"
        self.number += 1
        # the least size: else a small table is a file or two, and what reads it as many tasks
        meanwhile = {_LEAST: "64k", _CLEANUP: "true"}
        before = {k: self.spark.conf.get(k, None) for k in meanwhile}
        for k, v in meanwhile.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("parquet.block.size", BLOCK).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v else self.spark.conf.unset(k)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        """A place for tables that are written part by part."""
        return f"{self.folder}/{name}"

    def release(self) -> None:
        atexit.unregister(self.release)
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
