"""Canonical question tables: alias lookup, record building, selection joins and design checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.functions import variants as V
from trailmark.operators.tablematch import SPEC_SCHEMA
from trailmark.sources.readers import check_columns, text_list

# ---- fixed values: benchmark, verifier, expected rows, recommended judge, aliases ----------
BENCHMARKS = (
    ("browsecomp", "decision", None, None, ("bc", "bc185", "browsecomp_185", "browsecomp_en")),
    ("browsecomp_zh", "decision", None, None, ("bc_zh", "bczh", "bcch")),
    ("gaia_text_103", "decision", 103, None, ("gaia", "gaia_text")),
    ("xbench_2510", "zh_label", 100, None, ("xbench", "xbench_deepsearch_2510")),
    ("deepsearchqa_900", "component", 900, "gemini-2.5-flash", ("dsqa", "deepsearchqa", "deepsearch_qa")),
    ("widesearch_200", "table", 200, "gpt-4.1-2025-04-14", ("widesearch", "wide_search")),
    ("widesearch_v2_1_hard_720", "component", 720, "gemini-2.5-flash", ("widesearch_v2_1", "widesearch_hard_720")),
)
ANSWER_TYPES = ("Single Answer", "Set Answer")
MATCHED_FIELDS = ("question", "domain", "sub_domain", "difficulty", "split")
# -------------------------------------------------------------------------------------------


def benchmark_dimension(spark: SparkSession) -> DataFrame:
    """The supported benchmarks: a fixed handful of rows."""
    rows = [b[:4] for b in BENCHMARKS]
    return spark.createDataFrame(rows, "benchmark string, verifier string, expected_rows bigint, recommended_judge string")


def alias_dimension(spark: SparkSession) -> DataFrame:
    rows = [(a, b[0]) for b in BENCHMARKS for a in (b[0], *b[4])]
    return spark.createDataFrame(rows, "alias string, canonical string")


def alias_key(c: Column | str) -> Column:
    return F.replace(F.lower(S.strip(c)), F.lit("-"), F.lit("_"))


def resolve_benchmarks(rows: DataFrame, name: str = "benchmark") -> DataFrame:
    """Add the canonical benchmark name; null when the name is not supported."""
    aliases = F.broadcast(alias_dimension(rows.sparkSession))  # about thirty fixed rows
    return rows.withColumn("alias", alias_key(name)).join(aliases, "alias", "left").drop("alias")


def read_benchmark(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Canonical table of a benchmark with its columns checked and its row count enforced.

    The count comes from the parquet footers.
    """
    key = name.strip().lower().replace("-", "_")
    found = [b for b in BENCHMARKS if key in (b[0], *b[4].split())]
    if not found:
        raise ValueError(f"Unsupported benchmark {name!r}")
    canonical, _, expected, _, _ = found[0]
    raw = check_columns(spark.read.parquet(path), ["extra_info", "reward_model"])
    if expected is not None and (n := raw.count()) != expected:
        raise ValueError(f"Benchmark {canonical!r} requires exactly {expected} rows, found {n}")
    return raw


def canonical_record(benchmark: Column, question_id: Column, index: Column, question: Column, answer: Column, **meta: Column) -> list[Column]:
    """The four canonical columns for one question with open metadata."""
    extra = [
        question_id.alias("id"), index.cast("bigint").alias("index"), question.alias("question"), F.array(answer).alias("answer"),
        benchmark.alias("benchmark"), *[c.alias(n) for n, c in meta.items()],
    ]
    return [
        benchmark.alias("data_source"),
        F.array(F.struct(question.alias("content"), F.lit("user").alias("role"))).alias("prompt"),
        F.struct(F.array(answer).alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.struct(*extra).alias("extra_info"),
    ]


def from_raw_lines(lines: DataFrame, split: str, id_prefix: str) -> DataFrame:
    """Raw JSON lines (position, text) to canonical rows: defaults filled, answer falls back to truth."""
    r = lines.select("position", F.try_parse_json("text").alias("r"))
    question = F.coalesce(V.text_at("r", "$.extra_info.question"), F.lit(""))
    truth = text_list(V.at("r", "$.reward_model.ground_truth"))
    answer = text_list(V.at("r", "$.extra_info.answer"))
    prompt = V.at("r", "$.prompt").try_cast("array<variant>")
    given = F.transform(
        prompt,
        lambda m: F.struct(
            F.coalesce(V.text_at(m, "$.content"), F.lit("")).alias("content"),
            F.coalesce(V.text_at(m, "$.role"), F.lit("user")).alias("role"),
        ),
    )
    return r.select(
        F.coalesce(V.text_at("r", "$.data_source"), F.lit("")).alias("data_source"),
        F.when(F.coalesce(F.size(given) > 0, F.lit(False)), given)
        .otherwise(F.array(F.struct(question.alias("content"), F.lit("user").alias("role"))))
        .alias("prompt"),
        F.struct(truth.alias("ground_truth"), F.coalesce(V.text_at("r", "$.reward_model.style"), F.lit("rule")).alias("style")).alias("reward_model"),
        F.struct(
            F.when(F.coalesce(F.size(answer) > 0, F.lit(False)), answer).otherwise(truth).alias("answer"),
            F.concat(F.lit(id_prefix + "_"), F.col("position").cast("string")).alias("id"),
            F.col("position").alias("index"),
            question.alias("question"),
            S.first_nonempty(V.text_at("r", "$.extra_info.split"), F.lit(split)).alias("split"),
        ).alias("extra_info"),
    )


def from_numeric_ids(rows: DataFrame) -> DataFrame:
    """(position, query_id, question, answer) to canonical rows with zero-padded ids."""
    qid = F.col("query_id").cast("bigint")
    return rows.select(
        *canonical_record(
            F.lit("gaia_text_103"), F.format_string("gaia_text_%03d", qid), F.col("position"), F.col("question").cast("string"),
            F.col("answer").cast("string"), source_query_id=qid, split=F.lit("validation"),
        )
    )


def from_steps(rows: DataFrame) -> DataFrame:
    """(position, id, question, answer[, reference_steps]) to canonical rows."""
    steps = F.coalesce("reference_steps", F.lit("")) if "reference_steps" in rows.columns else F.lit("")
    sid = F.col("id").cast("string")
    return rows.select(
        *canonical_record(
            F.lit("xbench_2510"), F.concat(F.lit("deepsearch_"), sid), F.col("position"), F.col("question"), F.col("answer"),
            source_query_id=sid, reference_steps=steps,
        )
    )


def from_typed_answers(rows: DataFrame) -> DataFrame:
    """(position, problem, problem_category, answer, answer_type) to canonical rows plus reject_reason."""
    check_columns(rows, ["problem", "problem_category", "answer", "answer_type"])
    q, a, t, c = (S.strip(n) for n in ("problem", "answer", "answer_type", "problem_category"))
    reason = F.when(S.is_blank("problem") | S.is_blank("answer"), F.lit("empty_problem_or_answer")).when(
        ~F.coalesce(t.isin(*ANSWER_TYPES), F.lit(False)), F.lit("unsupported_answer_type")
    )
    meta = F.struct(t.alias("answer_type"), c.alias("problem_category"))
    record = canonical_record(
        F.lit("deepsearchqa_900"), F.format_string("dsqa_%03d", F.col("position").cast("bigint")), F.col("position"), q, a,
        source_query_id=F.col("position"), problem_category=c, answer_type=t, judge_metadata=meta, split=F.lit("eval"),
    )
    return rows.select(*record, reason.alias("reject_reason"))


def from_table_tasks(tasks: DataFrame, gold: DataFrame) -> DataFrame:
    """Table tasks (position, instance_id, query, language, evaluation) with their gold tables
    (instance_id, gold_csv, columns, rows) to canonical rows plus reject_reason."""
    df = tasks.withColumn("_e", F.from_json("evaluation", SPEC_SCHEMA)).join(gold, "instance_id", "left")
    req, uniq, pipe = F.col("_e.required"), F.col("_e.unique_columns"), F.col("_e.eval_pipeline")
    same = F.array_sort(F.array_distinct(req)) == F.array_sort(F.map_keys(pipe))
    reason = (
        F.when(S.is_blank("instance_id") | S.is_blank("query"), F.lit("malformed_row"))
        .when(~F.coalesce(F.col("language").isin("en", "zh"), F.lit(False)), F.lit("unsupported_language"))
        .when(~F.coalesce((F.size(req) > 0) & (F.size(uniq) > 0) & pipe.isNotNull(), F.lit(False)), F.lit("invalid_config"))
        .when(F.size(F.array_except(uniq, req)) > 0, F.lit("key_not_required"))
        .when(~same, F.lit("pipeline_differs"))
        .when(F.exists(F.map_values(pipe), lambda p: F.coalesce(F.size(p["metric"]), F.lit(0)) != 1), F.lit("not_one_metric"))
        .when(F.col("columns").isNull(), F.lit("gold_missing"))
        .when(F.size(F.array_except(req, F.col("columns"))) > 0, F.lit("gold_columns_missing"))
    )
    summary = F.concat(
        F.lit("Reference table with "), F.col("rows").cast("string"), F.lit(" rows and "), F.size(req).cast("string"), F.lit(" required columns")
    )
    meta = F.struct("instance_id", "language", F.col("evaluation").alias("evaluation_json"), "gold_csv")
    record = canonical_record(
        F.lit("widesearch_200"), F.col("instance_id"), F.col("position"), S.strip("query"), summary,
        source_query_id=F.col("instance_id"), language=F.col("language"), judge_metadata=meta, split=F.lit("full"),
    )
    return df.select(*record, reason.alias("reject_reason"))


def duplicated(df: DataFrame, key: Column, flag: str) -> DataFrame:
    """Flag rows whose key occurs more than once.

    The key counts are aggregated first and only repeated keys are joined back, so a group of many
    copies costs one counter, not one task.
    """
    h = F.md5(key)
    repeated = df.groupBy(h.alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_k", F.lit(True).alias(flag))
    return df.withColumn("_k", h).join(repeated, "_k", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_k")


def check_selection(selection: DataFrame) -> DataFrame:
    """First problem of each selected row: missing or repeated id, repeated question, wrong difficulty, split or language."""
    df = duplicated(selection, S.strip("id"), "_dup_id")
    df = duplicated(df, S.fold_key("question"), "_dup_q")
    reason = (
        F.when(S.is_blank("id") | S.is_blank("question"), F.lit("missing_id_or_question"))
        .when(F.col("_dup_id"), F.lit("duplicate_id"))
        .when(F.col("_dup_q"), F.lit("duplicate_question"))
        .when((F.coalesce("difficulty", F.lit("")) != "hard") | (F.coalesce("split", F.lit("")) != "rl_train"), F.lit("not_hard_rl_train"))
        .when(S.strip("language") != S.detect_language("question"), F.lit("language_mismatch"))
    )
    return df.withColumn("reject_reason", reason).drop("_dup_id", "_dup_q")


def join_selection(selection: DataFrame, source: DataFrame) -> DataFrame:
    """Selection joined with its source rows and the first problem of each pair.

    Source columns: id, the matched fields, ground_truth, ground_truth_size.
    """
    src = duplicated(source, F.col("id"), "_dup")
    src = src.select("id", "ground_truth", "ground_truth_size", "_dup", *[F.col(f).alias("_s_" + f) for f in MATCHED_FIELDS])
    joined = selection.join(src, "id", "left")
    reason = F.when(F.col("_dup").isNull(), F.lit("missing_source")).when(F.col("_dup"), F.lit("duplicate_source"))
    for f in MATCHED_FIELDS:
        reason = reason.when(~F.col(f).eqNullSafe(F.col("_s_" + f)), F.lit(f"mismatch_{f}"))
    bad_truth = ~F.coalesce(F.size("ground_truth") > 0, F.lit(False)) | F.exists("ground_truth", S.is_blank)
    reason = reason.when(bad_truth, F.lit("invalid_ground_truth")).when(
        ~F.col("ground_truth_size").eqNullSafe(F.size("ground_truth").cast("bigint")), F.lit("ground_truth_size")
    )
    return joined.withColumns({"reject_reason": reason, "ground_truth": F.transform("ground_truth", S.strip)}).drop(
        "_dup", *["_s_" + f for f in MATCHED_FIELDS]
    )


def from_selection(joined: DataFrame, benchmark: str = "widesearch_v2_1_hard_720") -> DataFrame:
    """Accepted selection rows (with position) as canonical rows of the balanced sample."""
    good = joined.filter("reject_reason IS NULL")
    q = S.strip("question")
    domain = F.col("domain")
    return good.select(
        F.lit(benchmark).alias("data_source"),
        F.array(F.struct(q.alias("content"), F.lit("user").alias("role"))).alias("prompt"),
        F.struct(F.col("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.struct(
            F.col("ground_truth").alias("answer"), F.lit("Set Answer").alias("answer_type"), F.lit(benchmark).alias("benchmark"), F.lit("hard").alias("difficulty"),
            domain.alias("domain"), F.col("id"), F.col("position").alias("index"),
            F.struct(F.lit("Set Answer").alias("answer_type"), domain.alias("problem_category")).alias("judge_metadata"),
            F.col("language"), domain.alias("problem_category"), q.alias("question"), F.col("id").alias("source_query_id"),
            F.lit("rl_train").alias("split"), F.col("sub_domain"),
        ).alias("extra_info"),
    )


def design_check(rows: DataFrame, expected: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Group count and smallest and largest group size for the four groupings of the balanced design.

    ``expected`` maps a grouping to (groups, size) and adds a ``balanced`` flag.
    """
    sets = rows.groupingSets(
        [["domain"], ["domain", "sub_domain"], ["domain", "sub_domain", "language"], ["language"]], "domain", "sub_domain", "language"
    ).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_n"))
    # grouping_id has a bit per column left out: domain 4, sub_domain 2, language 1
    name = F.when(F.col("_g") == 3, F.lit("domain")).when(F.col("_g") == 1, F.lit("subdomain")).when(F.col("_g") == 0, F.lit("stratum")).otherwise(F.lit("language"))
    out = sets.groupBy(name.alias("grouping")).agg(F.count(F.lit(1)).alias("groups"), F.min("_n").alias("smallest"), F.max("_n").alias("largest"))
    if expected is None:
        return out
    ok = F.lit(False)
    for g, (groups, size) in expected.items():
        hit = (F.col("groups") == groups) & (F.col("smallest") == size) & (F.col("largest") == size)
        ok = F.when(F.col("grouping") == g, hit).otherwise(ok)
    return out.withColumn("balanced", ok)


def language_balance(rows: DataFrame, languages: Sequence[str] = ("en", "zh")) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("language") == name).alias(name) for name in languages])
