"""Cutting lineage with written tables.

A small table that several branches of a job read (per-instance status, a metric dimension) is written
once to the shared checkpoint folder and read back. Lost executors then cost only their own tasks,
nothing is computed twice, and the planner sees the real file size when it decides on a broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from trailmark.session import checkpoint_folder


#: Spark's setting that removes the shuffle files of a query as it ends; else they stay until the driver happens to collect garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go with them: nothing but the written table is read afterwards."""
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_KEY, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under a fresh name in the checkpoint folder and return a scan of it."""
    with _cleaned_up(df.sparkSession):
        return _written(df, name)


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scan = spark.read.schema(df.schema).parquet(path)
    scan._staged_folder = path
    return scan


def staged_together(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """As ``staged`` for tables that don't depend on each other: their jobs run side by side."""
    spark = tables[0][0].sparkSession
    checkpoint_folder(spark)  # recorded once, before the threads ask for it
    with _cleaned_up(spark), ThreadPoolExecutor(len(tables)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda t: _written(*t)), tables))


def unstage(*tables: DataFrame) -> None:
    """Remove the files of tables that ``staged`` returned; no later job may read them or anything derived from them."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table._staged_folder)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
