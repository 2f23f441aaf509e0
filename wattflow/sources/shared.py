"""Tables and files that a job keeps for a while in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; only where none is named and all runs in one process (tests) a local one is set."""
    found = spark.conf.get(SETTING, None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{SETTING} has to name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="wattflow-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


class Scratch:
    """A new folder below the shared one. ``save`` writes a table and reads it back, which cuts lineage and survives
    lost executors; ``drop`` deletes tables that nothing will read again."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(conf).delete(at, True)
