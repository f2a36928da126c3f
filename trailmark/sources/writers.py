"""Writing canonical tables, logs, segments, reports and manifests."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CANONICAL_COLUMNS = ("data_source", "prompt", "reward_model", "extra_info")


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = dst.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{target}.replaced-{uuid.uuid4().hex}")
    had = fs.exists(dst)
    if had and not fs.rename(dst, old):
        raise OSError(f"could not set {target} aside")
    if not fs.rename(src, dst):
        if had:
            fs.rename(old, dst)
        raise OSError(f"could not publish {target}")
    if had:
        fs.delete(old, True)


def _discard(spark: SparkSession, path: str) -> None:
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def write_canonical(df: DataFrame, path: str, expected_rows: int) -> int:
    """Write next to the target, check columns and the observed row count, then publish by rename.

    The count is taken while writing, so the data is read once. An older table is set aside by rename and removed
    only after the new one is in place; a failed write leaves nothing behind.
    """
    missing = sorted(set(CANONICAL_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError("missing canonical columns: " + ", ".join(missing))
    seen = Observation()
    pending = f"{path}.pending-{uuid.uuid4().hex}"
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(pending)
        rows = seen.get["rows"]
        if rows != expected_rows:
            raise ValueError(f"expected {expected_rows} records, received {rows}")
        _rename(df.sparkSession, pending, path)
    except BaseException:
        _discard(df.sparkSession, pending)
        raise
    return rows


def write_reviews(reviews: DataFrame, path: str) -> None:
    """Append review records as JSON lines, one folder per rollout; rows carry their ``line`` order."""
    reviews.write.mode("append").partitionBy("rollout_idx").json(path)


SEGMENT_BUCKETS = 256


def write_segments(messages: DataFrame, path: str, one_folder_each: bool = False) -> None:
    """Messages by question, state prefix and segment.

    The table is written in a fixed number of buckets of its keys, which stay columns, so that the number of files follows
    the buckets and not the segments. ``one_folder_each`` exports the layout with a folder for each segment instead.
    A slice of the message order is part of the distribution, so a long segment becomes several files rather than one task.
    """
    keys = ["question_id", "prefix", "segment"]
    slice_no = F.floor(F.col("seq") / 10000)
    if one_folder_each:
        messages.repartition(*keys, slice_no).sortWithinPartitions(*keys, "seq").write.mode("append").partitionBy(*keys).json(path)
        return
    dealt = messages.withColumn("bucket", F.pmod(F.xxhash64(*keys, slice_no), F.lit(SEGMENT_BUCKETS)).cast("int"))
    dealt.repartition("bucket").sortWithinPartitions("bucket", *keys, "seq").write.mode("append").partitionBy("bucket").json(path)


def report_json(summary: DataFrame, name: str = "report") -> DataFrame:
    """Each summary row as one nested JSON document."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias(name))


def write_report(summary: DataFrame, path: str) -> None:
    report_json(summary, "value").write.mode("overwrite").text(path)


#: Endings of files that the line reader would unpack; such a file is hashed in one piece and must be smaller than 2 GiB.
PACKED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst")
BOM = b"\xef\xbb\xbf"


def fingerprints(spark: SparkSession, *paths: str) -> DataFrame:
    """Length and SHA-256 of every file (path, length, sha256), read in pieces.

    Splits of a file are read by different tasks as raw lines; the lines of a file then stream in order through one task,
    which keeps a running digest only, so memory follows the longest line and not the file. The reader drops line feeds and
    a leading byte order mark; what is missing from the known length tells whether the last line had one and the first the other.
    Spark's readers don't list empty files, so they have no row.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).withColumn("_at", F.col("_metadata.file_path"))
    packed = F.col("path").rlike(rf"\.({'|'.join(PACKED)})$")
    whole = listing.filter(packed).select("path", "length", F.sha2("content", 256).alias("sha256"))
    plain = listing.filter(~packed).select("path", "length", "_at")
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("line"),
    ).filter(~packed)
    kept = lines.groupBy("path").agg((F.min("length") - F.sum(F.length("line") + 1)).alias("missing"))
    heads = kept.select("path", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("seq"), "missing", F.lit(None).cast("binary").alias("line"))
    rows = heads.unionByName(lines.select("path", "at", "seq", F.lit(None).cast("bigint").alias("missing"), "line"))
    digests = rows.repartition("path").sortWithinPartitions("path", "at", "seq").select("path", "missing", "line").mapInArrow(_running_digests, "path string, sha256 string")
    lone = hashlib.sha256(BOM).hexdigest()  # a file without any line holds a byte order mark only
    return plain.join(digests.withColumnRenamed("path", "_at"), "_at", "left").select("path", "length", F.coalesce("sha256", F.lit(lone)).alias("sha256")).unionByName(whole)


def _running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per path from (path, missing, line) in order, the row with ``missing`` first."""
    done: list[tuple[str, str]] = []
    path = digest = None
    between = end = b""

    def close() -> None:
        if path is not None:
            digest.update(end)
            done.append((path, digest.hexdigest()))

    for batch in batches:
        for name, missing, line in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if name != path:
                close()
                path, digest, between = name, hashlib.sha256(), b""
            if line is None:
                digest.update(BOM if missing in (2, 3) else b"")
                end = b"\n" if missing in (0, 3) else b""
            else:
                digest.update(between + line)
                between = b"\n"
    close()
    yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "sha256": pa.array([d for _, d in done], pa.string())})


def manifest(files: DataFrame, rows: DataFrame) -> DataFrame:
    """File fingerprints next to the row count of the table they hold (table, rows)."""
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.withColumn("table", name).join(rows, "table", "left")


def write_rubrics(results: DataFrame, path: str, failures_path: str) -> None:
    """Rubrics and failures of a generation run (question_id, rubrics, error) in two tables."""
    results.filter("error IS NULL").select("question_id", "rubrics").write.mode("overwrite").json(path)
    results.filter("error IS NOT NULL").select("question_id", "error").write.mode("overwrite").json(failures_path)


def rejudge_path(path: str) -> str:
    """Output name next to the input: ``review.jsonl`` becomes ``review.official_judge.jsonl``."""
    head, dot, tail = path.rpartition(".")
    return f"{head}.official_judge{dot}{tail}" if dot and "/" not in tail else f"{path}.official_judge"


def write_rejudged(results: DataFrame, input_path: str, output_path: str | None = None) -> str:
    target = output_path or rejudge_path(input_path)
    if target.rstrip("/") == input_path.rstrip("/"):
        raise ValueError("the output would overwrite its input")
    results.write.mode("append").json(target)
    return target
