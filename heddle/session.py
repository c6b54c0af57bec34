"""Session helpers shared by every query."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch, where the session has Spark's own default: rows hold whole texts.
BATCH, _DEFAULT = "4000", "10000"
ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(app: str = "heddle", cpus: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use; an existing session wins."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("HEDDLE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def attach(spark: SparkSession) -> SparkSession:
    """Lets Python workers started for this session import the package from the driver's checkout, and bounds Arrow
    batches.

    A deployment that ships the package with ``--py-files`` needs nothing here; the entry is then redundant.
    """
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, ROOT])
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == _DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
