"""Storage that driver and executors share: tables that cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it's unset, one of our own, which only a
    session on one machine can share; on a cluster that is an error."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="pqledger-")
        spark.sparkContext.setCheckpointDir(shared_dir.own)
    return f"file://{shared_dir.own}"


class Scratch:
    """Tables that one run keeps in the shared folder for a while: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """df written and read again. An older table of that name is deleted once its successor is written."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for path in [self.paths.pop(n) for n in names if n in self.paths]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of jobs that are done; else they stay until the driver's heap fills."""
        gc.collect()
        self.spark._jvm.System.gc()
