"""Session helpers: defaults for local runs and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str | int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trailmark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TRAILMARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.openCostInBytes", "256k")
        .config("spark.sql.files.minPartitionNum", str(cores))
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables: the cluster's setting, else a scratch one.

    The setting names storage every executor can reach. Only where it is unset and everything runs in one process
    on one machine (tests, the bench) is a temporary folder made and recorded, so later calls see the same one; on
    a cluster its absence is an error, as executors don't see each other's folders.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not folder:
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local":
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share; it is unset on {master}")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, folder)
    return folder
