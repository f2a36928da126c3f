"""Reading questions, logs and manifests. Explicit schemas; no inference, no driver-side listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions import scalars as S
from trailmark.functions import tables as X
from trailmark.functions import variants as V

# ---- fixed values: log layout -------------------------------------------------------------
ROLLOUT_PATH = r"rollout_(\d+)/"
QUESTION_PATH = r"question_([^/]*)/"
LEGACY_LOG = r"rollout_\d+/review\.jsonl$"
STATE_SEGMENT = r"/(rubric|answer|verify)_t(\d+)_attempt_(\d+)_(\d+)\.jsonl$"
PLAIN_SEGMENT = r"/segment_(\d+)\.jsonl$"
# -------------------------------------------------------------------------------------------

PROMPT = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("role", T.StringType())]))
REWARD = T.StructType([T.StructField("ground_truth", T.ArrayType(T.StringType())), T.StructField("style", T.StringType())])
EXTRA_FIELDS = (
    "id",
    "question",
    "benchmark",
    "split",
    "answer_type",
    "difficulty",
    "domain",
    "sub_domain",
    "language",
    "problem_category",
    "source_query_id",
    "reference_steps",
)
EXTRA = T.StructType(
    [T.StructField("answer", T.ArrayType(T.StringType())), T.StructField("index", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in EXTRA_FIELDS]
    + [T.StructField("judge_metadata", T.MapType(T.StringType(), T.StringType()))]
)
CANONICAL = T.StructType(
    [
        T.StructField("data_source", T.StringType()),
        T.StructField("prompt", PROMPT),
        T.StructField("reward_model", REWARD),
        T.StructField("extra_info", EXTRA),
    ]
)


def questions(canonical: DataFrame, benchmark: str = "browsecomp") -> DataFrame:
    """Runtime view of the canonical table: id, question, truth list, judge metadata map."""
    truth = F.col("reward_model.ground_truth")
    if not isinstance(canonical.select(truth.alias("t")).schema["t"].dataType, T.ArrayType):
        truth = F.array(truth.cast("string"))
    extra = canonical.schema["extra_info"].dataType.fieldNames()
    if "judge_metadata" in extra:
        meta_type = canonical.select("extra_info.judge_metadata").schema["judge_metadata"].dataType
        meta = F.col("extra_info.judge_metadata")
        if isinstance(meta_type, T.StructType):
            meta = F.from_json(F.to_json(meta), "map<string,string>")
        elif not isinstance(meta_type, T.MapType):
            raise ValueError("judge_metadata must be a mapping")
        meta = F.coalesce(meta, F.create_map().cast("map<string,string>"))
    else:
        meta = F.create_map().cast("map<string,string>")
    return canonical.select(
        F.col("extra_info.id").alias("question_id"),
        F.col("extra_info.question").alias("question"),
        truth.alias("ground_truth"),
        F.lit(benchmark).alias("benchmark"),
        meta.alias("judge_metadata"),
    )


def read_canonical(spark: SparkSession, path: str, schema: T.StructType = CANONICAL) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_question_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSONL questions: the id is ``item_id``, there is no judge metadata, a bad line fails the job."""
    extra = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("question", T.StringType())])
    schema = T.StructType(
        [
            T.StructField("extra_info", extra),
            T.StructField("reward_model", T.StructType([T.StructField("ground_truth", T.VariantType())])),
        ]
    )
    raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return raw.select(
        F.col("extra_info.item_id").alias("question_id"),
        F.col("extra_info.question").alias("question"),
        text_list(F.col("reward_model.ground_truth")).alias("ground_truth"),
        F.lit("browsecomp").alias("benchmark"),
        F.create_map().cast("map<string,string>").alias("judge_metadata"),
    )


def text_list(v: Column) -> Column:
    """VARIANT to a list of texts: arrays element-wise, scalars wrapped, null to the empty list."""
    return (
        F.when(V.kind(v).startswith("ARRAY"), v.try_cast("array<string>"))
        .when(V.present(v), F.array(v.try_cast("string")))
        .otherwise(F.array().cast("array<string>"))
    )


def read_questions(spark: SparkSession, path: str, benchmark: str = "browsecomp") -> DataFrame:
    """Pick the reader by file extension."""
    if path.endswith(".jsonl"):
        return read_question_lines(spark, path)
    if path.endswith(".parquet"):
        return questions(spark.read.parquet(path), benchmark)
    raise ValueError(f"Unsupported dataset format: {path}")


def check_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def read_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """CSV with a header, quoted line breaks and an optional byte order mark."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    first = raw.columns[0]
    return check_columns(raw.withColumnRenamed(first, first.lstrip("\ufeff")), required)


def read_gold_folder(spark: SparkSession, path: str) -> DataFrame:
    """One CSV per instance: id from the file name, the whole text, its columns and row count."""
    raw = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1).alias("instance_id"), "value"
    )
    return gold_summary(raw)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Many small documents kept as JSON lines ``{"path", "text"}``: the form for collections whose files would be too many.

    A folder with one file per document costs the driver a listing entry and a task an open for each; packed, both grow
    with the bytes only. A line that is no such record fails the job.
    """
    return spark.read.schema("path string, text string").option("mode", "FAILFAST").json(path)


def write_packed(documents: DataFrame, path: str) -> None:
    """Write (path, text) rows in the form ``read_packed`` reads."""
    documents.select("path", "text").write.option("ignoreNullFields", False).json(path)


def read_packed_gold(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_gold_folder`` for packed CSV files; the id is the file's name."""
    raw = read_packed(spark, path).select(F.regexp_extract("path", r"([^/]*)\.csv$", 1).alias("instance_id"), F.col("text").alias("value"))
    return gold_summary(raw)


def gold_summary(raw: DataFrame) -> DataFrame:
    """Replace the CSV text ``value`` by gold_csv, normalised columns and the number of data rows."""
    keys = [c for c in raw.columns if c != "value"]
    text = raw.select(*keys, F.regexp_replace("value", "^\ufeff", "").alias("gold_csv"))
    records = text.withColumn("_records", X.csv_records(F.col("gold_csv")))
    return records.select(
        *keys,
        "gold_csv",
        F.transform(F.get("_records", F.lit(0)), S.norm_column).alias("columns"),
        (F.size("_records") - 1).alias("rows"),
    )


def tolerant_records(lines: DataFrame) -> DataFrame:
    """Parsed records; blank and malformed lines are skipped."""
    return lines.filter(~S.is_blank("text")).withColumn("record", F.try_parse_json("text")).filter("record IS NOT NULL")


def strict_records(lines: DataFrame) -> DataFrame:
    """Parsed records; the first malformed line fails the job with its file and line."""
    parsed = F.try_parse_json("text")
    place = F.concat(F.lit("Invalid JSON in "), F.col("path"), F.lit(":"), F.col("line").cast("string"))
    return lines.filter(~S.is_blank("text")).withColumn("record", F.coalesce(parsed, F.raise_error(place).cast("variant")))


def numbered_text(raw: DataFrame) -> DataFrame:
    """Lines of a text scan with path and one-based line number; the scan stays splittable.

    A line lies in a split that starts at some byte of its file, at some place in it. The running row ids of one split
    are consecutive, so its first id and the line counts of the splits before give the number; only those counts (one row
    a split) are shuffled, never the text.
    """
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    splits = rows.groupBy("path", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lines"))
    line = F.col("_lines") + F.col("_id") - F.col("_first") + 1
    return rows.join(starts, ["path", "_at"]).select("path", line.cast("bigint").alias("line"), "text")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text lines with file path and one-based line number."""
    return numbered_text(spark.read.option("lineSep", "\n").text(path))


def read_review_lines(spark: SparkSession, root: str) -> DataFrame:
    """Review lines of every rollout below ``root``; the legacy file ranks after the current one."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "review.jsonl").option("lineSep", "\n").text(root)
    return numbered_text(found).select(
        F.regexp_extract("path", ROLLOUT_PATH, 1).try_cast("int").alias("rollout_idx"),
        F.col("path").rlike(LEGACY_LOG).cast("int").alias("file_rank"),
        "line",
        "text",
    ).filter("rollout_idx IS NOT NULL")


def union_logs(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Both log locations as one table, the legacy one ranked last."""
    return current.withColumn("file_rank", F.lit(0)).unionByName(legacy.withColumn("file_rank", F.lit(1)), allowMissingColumns=True)


def segment_keys(df: DataFrame, path_col: str) -> DataFrame:
    """Split trajectory file paths into rollout, question, state, transition, attempt and segment."""
    p = F.col(path_col)
    stated = p.rlike(STATE_SEGMENT)
    num = lambda i: F.when(stated, F.regexp_extract(p, STATE_SEGMENT, i).cast("int"))
    return df.withColumns(
        {
            "rollout_idx": F.regexp_extract(p, ROLLOUT_PATH, 1).try_cast("int"),
            "question_id": F.regexp_extract(p, QUESTION_PATH, 1),
            "state": F.when(stated, F.upper(F.regexp_extract(p, STATE_SEGMENT, 1))),
            "transition": num(2),
            "attempt": num(3),
            "segment": F.when(stated, F.regexp_extract(p, STATE_SEGMENT, 4)).otherwise(F.regexp_extract(p, PLAIN_SEGMENT, 1)).try_cast("int"),
        }
    )


def read_segments(spark: SparkSession, root: str) -> DataFrame:
    """Trajectory messages of all segment files with their key columns; ``seq`` is the line's place from 0."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_[0-9]*.jsonl").option("lineSep", "\n").text(root)
    lines = numbered_text(raw).select("path", (F.col("line") - 1).cast("int").alias("seq"), "text").filter(~S.is_blank("text"))
    return segment_keys(lines, "path").withColumn("message", F.try_parse_json("text"))


def with_position(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with their zero-based position, from file-local row indexes and file offsets.

    Only the per-file counts (one row per file) are ordered; rows themselves are never shuffled.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    counts = rows.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return rows.join(offsets, "_f").withColumn("position", F.col("_o") + F.col("_i")).drop("_f", "_i", "_o")


def number_rows(df: DataFrame, order: Sequence[str], digits: int = 4) -> DataFrame:
    """Zero-based position in the given order without a global window.

    Rows are bucketed by the first hex digits of a uniform text key (a hash), numbered inside the
    bucket, and shifted by the running count of earlier buckets. Null keys come first.
    """
    keyed = df.withColumn("_b", F.coalesce(F.substring(F.col(order[0]), 1, digits), F.lit("")))
    inside = Window.partitionBy("_b").orderBy(*order)
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return (
        keyed.withColumn("_r", F.row_number().over(inside) - 1)
        .join(offsets, "_b")
        .withColumn("position", (F.col("_o") + F.col("_r")).cast("bigint"))
        .drop("_b", "_r", "_o")
    )


def read_id_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, blanks dropped."""
    return spark.read.text(path).select(S.strip("value").alias("question_id")).filter("question_id <> ''").distinct()


def find_review_files(spark: SparkSession, files: Sequence[str] = (), work_dir: str | None = None) -> list[str]:
    """Log files to re-judge: the named ones, then those of a work folder or of its rollouts.

    Each file once, by its qualified path; a missing file is an error. Only names pass the driver.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def listed(pattern: str) -> list[str]:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(conf).globStatus(path) or []
        return [s.getPath().toString() for s in found if s.isFile()]

    out: list[str] = []
    for name in files:
        hit = listed(name)
        if not hit:
            raise FileNotFoundError(f"Review log not found: {name}")
        out += hit
    if work_dir:
        direct = listed(work_dir) or listed(f"{work_dir}/000_review/review.jsonl") + listed(f"{work_dir}/review.jsonl")
        out += direct or sorted(listed(f"{work_dir}/rollout_*/000_review/review.jsonl") + listed(f"{work_dir}/rollout_*/review.jsonl"))
    return list(dict.fromkeys(out))


SNAPSHOT_SCHEMA = "memory_id string, timestamp string, knowledge_graph variant, navigation_state variant, next_step_plan string, task_progress string, structured_summary string, unreadable string"


def read_snapshots(spark: SparkSession, path: str, files: str = "*.json", question: str = r"question_([^/]+)/", folder: str = r"question_[^/]+/(?:(.+)/)?[^/]+$") -> DataFrame:
    """Memory snapshots, one JSON document per file: question_id, folder, stem and the fields of ``SNAPSHOT_SCHEMA``.

    A file that is no JSON object keeps its row, with its text in ``unreadable`` and no fields, since its name still
    counts. ``question`` and ``folder`` say what the path means; the folders are walked to any depth.
    """
    reader = spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", files)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "unreadable").json(path)
    place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return _placed_snapshots(rows, place, question, folder)


def read_packed_snapshots(spark: SparkSession, path: str, question: str = r"question_([^/]+)/", folder: str = r"question_[^/]+/(?:(.+)/)?[^/]+$") -> DataFrame:
    """As ``read_snapshots`` for snapshot files packed as JSON lines (``read_packed``); an empty one keeps its row here too."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"}
    parsed = read_packed(spark, path).withColumn("_s", F.from_json("text", SNAPSHOT_SCHEMA, options))
    rows = parsed.select("_s.*", F.col("path").alias("_path"), F.when(F.col("_s").isNull(), F.col("text")).alias("_bare"))
    rows = rows.withColumn("unreadable", F.coalesce("unreadable", "_bare"))
    return _placed_snapshots(rows.drop("_bare"), F.col("_path"), question, folder).drop("_path")


def _placed_snapshots(rows: DataFrame, place: Column, question: str, folder: str) -> DataFrame:
    return rows.withColumn("_place", place).select(
        F.regexp_extract("_place", question, 1).alias("question_id"),
        F.regexp_extract("_place", folder, 1).alias("folder"),
        F.regexp_extract("_place", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"),
        *[F.col(c) for c in rows.columns if c != "unreadable"],
        # the condition always holds; the reader refuses to give the text of bad files alone
        F.when(F.length(F.coalesce("memory_id", F.lit(""))) >= 0, F.col("unreadable")).alias("unreadable"),
    )
