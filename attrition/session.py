"""Spark session helpers.

The library never creates a session behind the caller's back; these helpers are
for scripts, tests and the bench.  On a cluster the session comes from the
platform and ``spark.checkpoint.dir`` names a shared folder; we only set our own
folder when the session has none and its master is local (laptops and tests).
Without a named folder any other master is an error: a machine-local folder
would leave each executor's files where no other can read them.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "attrition") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("ATTRITION_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder; a local one only for a local master that names none."""

    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not is_local_master(sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {sc.master}")
        current = tempfile.mkdtemp(prefix="attrition-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def is_local_master(master: str) -> bool:
    """One JVM on this machine (``local-cluster`` has executors of its own)."""

    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/attrition-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back.

    A table that later jobs read several times: columnar, so each reads only the
    columns it needs, and a lost executor costs a re-read, not the lineage.
    """

    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
