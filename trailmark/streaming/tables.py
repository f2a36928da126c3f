"""A table per key that micro-batches merge into, cut into buckets by key hash.

A batch reads and writes the buckets of its own keys only. What the table is after a batch is one small manifest (bucket
-> batch that wrote it), written last: a batch without a manifest did not happen, and one with it is not done twice. Files
that neither the newest manifest nor the one before it names are removed, so readers of the last version go on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table; a large one needs as many as keep a bucket well under a task's memory.
BUCKETS = 64


class BucketTable:
    """Rows by ``keys`` under ``path``; the number of buckets is fixed when the table is first written."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), folder

    def versions(self) -> list[int]:
        """Batches with a manifest, oldest first."""
        fs, folder = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        done = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(int(p.getName()[1:]) for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self, version: int) -> dict[int, int]:
        """The batch that wrote each bucket; at most ``buckets`` entries."""
        rows = self.spark.read.schema("bucket int, version bigint").parquet(f"{self.path}/manifest/v{version}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _read(self, parts: dict[int, int]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v{v}/_bucket={b}" for b, v in sorted(parts.items())])

    def read(self) -> DataFrame:
        """The table after its newest batch."""
        done = self.versions()
        return self._read(self.manifest(done[-1]) if done else {})

    def merge(self, batch: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], version: int) -> None:
        """Replace the buckets of the batch's keys by ``fold(their rows, batch)``; a batch that is in already is left alone."""
        done = self.versions()
        if version in done:
            return
        now = self.manifest(done[-1]) if done else {}
        batch = batch.persist()
        try:
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            touched = [r[0] for r in batch.select(bucket).distinct().collect()]
            merged = fold(self._read({b: now[b] for b in touched if b in now}), batch).select(*self.schema.names, bucket.alias("_bucket"))
            data = f"{self.path}/data/v{version}"
            merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(data)
        finally:
            batch.unpersist()
        fs, folder = self._fs(data)
        written = {int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if "=" in s.getPath().getName()}
        after = {b: v for b, v in now.items() if b not in touched} | dict.fromkeys(written, version)
        rows = self.spark.createDataFrame(sorted(after.items()), "bucket int, version bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")
        self._clear(done, now, after)

    def _clear(self, done: list[int], *named: dict[int, int]) -> None:
        """Remove bucket folders that no kept manifest names, and manifests before the last two."""
        kept = {(b, v) for parts in named for b, v in parts.items()}
        for old in done[:-1]:
            for b, v in self.manifest(old).items():
                if (b, v) not in kept:
                    fs, folder = self._fs(f"{self.path}/data/v{v}/_bucket={b}")
                    fs.delete(folder, True)
            fs, folder = self._fs(f"{self.path}/manifest/v{old}")
            fs.delete(folder, True)
