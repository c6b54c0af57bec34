"""Intermediate tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests, a laptop) a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="heddle-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Named tables of one operator run, under a folder of its own.

    ``put`` writes a frame as Parquet and returns a frame that reads it back, so what follows is planned on a
    file scan: a lost executor costs a rerun of tasks over those files, never of what made them.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.path = f"{base_dir(spark)}/{operator}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing still to be run reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name).rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def remove(self) -> None:
        """Deletes all tables of this run."""
        self.drop("")
