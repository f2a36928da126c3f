"""Roll-ups of review logs: macro precision/recall/F1, pass@n, avg@n, max@n, coverage, live counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.functions import variants as V
from trailmark.plans.blocks import running_sums
from trailmark.plans.keyed import latest_by

COMPONENT_METRICS = ("precision", "recall", "f1")
TABLE_METRICS = ("row_precision", "row_recall", "row_f1", "item_precision", "item_recall", "item_f1")


def reviews_from_lines(lines: DataFrame) -> DataFrame:
    """Typed review rows from raw log lines; lines that are not usable records are left out.

    Input columns: rollout_idx, file_rank, line, text.
    """
    record = lines.select("rollout_idx", "file_rank", "line", F.try_parse_json("text").alias("r"))
    return record.filter(V.is_object("r") & ~S.is_blank(V.text_at("r", "$.question_id"))).select(
        "rollout_idx",
        "file_rank",
        "line",
        S.strip(V.text_at("r", "$.question_id")).alias("question_id"),
        V.text_at("r", "$.answer").alias("answer"),
        V.text_at("r", "$.judge_complete_status").alias("judge_complete_status"),
        F.to_json(V.at("r", "$.is_correct")).alias("is_correct"),
        F.to_json(V.at("r", "$.num_turns")).alias("num_turns"),
        V.at("r", "$.judge_metrics").alias("judge_metrics"),
    )


def line_quality(lines: DataFrame, by: Sequence[str] = ("rollout_idx",)) -> DataFrame:
    """Lines, records and malformed lines per group; blank lines count as neither."""
    r = F.try_parse_json("text")
    blank = S.is_blank("text")
    good = V.is_object(r) & ~S.is_blank(V.text_at(r, "$.question_id"))
    return lines.groupBy(*by).agg(
        F.count_if(~blank).alias("lines"),
        F.count_if(~blank & good).alias("records"),
        F.count_if(~blank & ~good).alias("malformed_review_lines"),
    )


def scored(reviews: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Narrow each review to flags and numbers before anything is shuffled."""
    m = V.parsed(reviews, "judge_metrics")
    correct = V.strictly_true(F.try_parse_json("is_correct"))
    typed = reviews.withColumn("_m", m).select(
        "rollout_idx",
        S.strip("question_id").alias("question_id"),
        "file_rank",
        "line",
        S.is_blank("answer").alias("empty_answer"),
        F.coalesce(F.col("judge_complete_status") == "SUCCESS", F.lit(False)).alias("judged"),
        correct.alias("correct"),
        F.nullif(S.strip(V.text_at("_m", "$.judge_model")), F.lit("")).alias("judge_model"),
        *[V.finite_number(V.at("_m", f"$.{name}")).alias(name) for name in metrics],
    )
    all_finite = F.lit(True)
    for name in metrics:
        all_finite = all_finite & F.col(name).isNotNull()
    return typed.filter(F.col("question_id") != "").withColumn("valid", F.col("judged") & all_finite)


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last record per question and rollout, in file then line order."""
    return latest_by(reviews, ["rollout_idx", "question_id"], ["file_rank", "line"])


def latest_scored(reviews: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return latest_reviews(scored(reviews, metrics))


def _macro(metrics: Sequence[str], prefix: str, exact: str, rate: str) -> list[Column]:
    total, ok = F.count(F.lit(1)), F.count_if("valid")
    sums = {m: F.sum(F.when(F.col("valid"), F.col(m))) for m in metrics}
    hit = F.count_if(F.col("valid") & F.col("correct"))
    return [
        total.alias("records"),
        ok.alias("successful_judgments"),
        (total - ok).alias("invalid_judgments"),
        F.count_if("empty_answer").alias("empty_model_responses"),
        hit.alias(exact),
        S.ratio(hit, total).alias(rate),
        *[S.ratio(F.coalesce(sums[m], F.lit(0.0)), total).alias(prefix + m) for m in metrics],
        *[S.ratio(F.coalesce(sums[m], F.lit(0.0)), ok).alias(f"valid_only_{prefix}{m}") for m in metrics],
        F.sort_array(F.collect_set("judge_model")).alias("judge_models"),
    ]


def component_summary(latest: DataFrame) -> DataFrame:
    """One row per rollout and one for all (rollout_idx null) over component metrics."""
    return latest.rollup("rollout_idx").agg(*_macro(COMPONENT_METRICS, "macro_", "exact_correct", "all_correct_rate"))


def table_summary(latest: DataFrame) -> DataFrame:
    """One row per rollout and one for all over the six table metrics."""
    return latest.rollup("rollout_idx").agg(*_macro(TABLE_METRICS, "", "exact_successes", "success_rate"))


def with_coverage(summary: DataFrame, expected_rows: int, rollouts: int) -> DataFrame:
    """Add expected and missing records and capped coverage to a summary with a total row."""
    expected = F.when(F.col("rollout_idx").isNull(), F.lit(expected_rows * rollouts)).otherwise(F.lit(expected_rows))
    expected = expected.cast("bigint")
    return summary.withColumns(
        {
            "expected_records": expected,
            "missing_records": F.greatest(expected - F.col("records"), F.lit(0).cast("bigint")),
            "coverage": F.least(S.ratio(F.col("records"), expected), F.lit(1.0)),
        }
    )


def best_of_n(latest: DataFrame, expected_questions: int) -> DataFrame:
    """pass@n and max@n over questions seen, with unique and missing question counts.

    The maxima use every record with a finite value, judged or not.
    """
    per_question = latest.groupBy("question_id").agg(
        F.bool_or("correct").alias("passed"),
        F.max(F.coalesce("row_f1", F.lit(0.0))).alias("row_f1"),
        F.max(F.coalesce("item_f1", F.lit(0.0))).alias("item_f1"),
    )
    seen = F.count(F.lit(1))
    return per_question.agg(
        seen.alias("unique_questions"),
        F.greatest(F.lit(expected_questions) - seen, F.lit(0)).cast("bigint").alias("missing_questions"),
        S.ratio(F.count_if("passed"), seen).alias("pass_at_n_success_rate"),
        F.coalesce(F.avg("row_f1"), F.lit(0.0)).alias("max_at_n_row_f1"),
        F.coalesce(F.avg("item_f1"), F.lit(0.0)).alias("max_at_n_item_f1"),
    )


def table_report(reviews: DataFrame, expected_questions: int, rollouts: int) -> DataFrame:
    """Total table summary next to avg@n, pass@n and max@n: one row."""
    latest = latest_scored(reviews, TABLE_METRICS)
    total = with_coverage(table_summary(latest).filter("rollout_idx IS NULL"), expected_questions, rollouts)
    best = best_of_n(latest, expected_questions)
    averages = {"avg_at_n_success_rate": "success_rate", "avg_at_n_row_f1": "row_f1", "avg_at_n_item_f1": "item_f1"}
    whole = total.drop("rollout_idx").withColumns({name: F.col(c) for name, c in averages.items()})
    # one row each: put side by side by an aggregate
    both = whole.unionByName(best, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def judge_model_usage(latest: DataFrame) -> DataFrame:
    return latest.filter("judge_model IS NOT NULL").groupBy("judge_model").agg(F.count(F.lit(1)).alias("records"))


def live_counters(reviews: DataFrame, expected: int, metrics: Sequence[str] = COMPONENT_METRICS) -> DataFrame:
    """Counters a running evaluation shows: accuracy over judged and over expected, metric means.

    Non-finite metrics count as zero here. Input needs is_correct and judge_metrics; ``tokens`` is
    summed when present.
    """
    m = V.parsed(reviews, "judge_metrics")
    typed = reviews.withColumn("_m", m).select(
        V.strictly_true(F.try_parse_json("is_correct")).alias("correct"),
        (F.col("tokens") if "tokens" in reviews.columns else F.lit(0).cast("bigint")).alias("tokens"),
        *[V.finite_or_zero(V.at("_m", f"$.{name}")).alias(name) for name in metrics],
    )
    judged, hit, bound = F.count(F.lit(1)), F.count_if("correct"), F.lit(max(expected, 1))
    return typed.agg(
        hit.alias("correct"),
        (judged - hit).alias("incorrect"),
        S.ratio(hit, judged).alias("accuracy"),
        S.ratio(hit, bound).alias("accuracy_all"),
        *[S.ratio(F.coalesce(F.sum(n), F.lit(0.0)), judged).alias(n) for n in metrics],
        *[S.ratio(F.coalesce(F.sum(n), F.lit(0.0)), bound).alias(n + "_all") for n in metrics],
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"),
    )


def seed_records(reviews: DataFrame) -> DataFrame:
    """Finished records a resumed run counts: the last one per question and rollout."""
    return latest_by(reviews.filter("question_id IS NOT NULL"), ["question_id", "rollout_idx"], ["file_rank", "line"])


def permutation_key(question_id: Column, seed: str) -> Column:
    """A fixed pseudo-random order of questions as a 60-bit integer."""
    return F.conv(F.substring(F.md5(F.concat(question_id, F.lit(seed))), 1, 15), 16, 10).cast("bigint")


def subset_calibration(results: DataFrame, seed: str) -> DataFrame:
    """Worst deviation from full-set accuracy over runs, for every prefix of a fixed permutation.

    Input: run, question_id (unique per run), correct. The prefix accuracies are running sums over
    blocks of the permutation key, so a run with any number of questions is spread over tasks.
    """
    keyed = results.select("run", F.col("correct").cast("bigint").alias("hit"), permutation_key(F.col("question_id"), seed).alias("pos"))
    prefix = running_sums(keyed, ["run"], "pos", {"subset_size": F.lit(1).cast("bigint"), "hits": F.col("hit")}, width=1 << 40)
    full = keyed.groupBy("run").agg(F.avg("hit").alias("full_accuracy"))
    return (
        prefix.join(full, "run")
        .groupBy("subset_size")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.max(F.abs(F.col("hits") / F.col("subset_size") - F.col("full_accuracy"))).alias("worst_deviation"),
        )
    )


def drop_latest_of(reviews: DataFrame, question_id: Column) -> DataFrame:
    """Retract the latest record of each question the expression names; all other rows stay."""
    order = F.struct("file_rank", "line")
    last = reviews.filter(F.col("question_id").eqNullSafe(question_id)).groupBy("rollout_idx", "question_id").agg(F.max(order).alias("_last"))
    flagged = last.select("rollout_idx", "question_id", F.col("_last.file_rank").alias("file_rank"), F.col("_last.line").alias("line"))
    return reviews.join(flagged, ["rollout_idx", "question_id", "file_rank", "line"], "left_anti")


def drop_last_line(reviews: DataFrame) -> DataFrame:
    """Retract the last line of each log file."""
    last = reviews.groupBy("rollout_idx", "file_rank").agg(F.max("line").alias("line"))
    return reviews.join(last, ["rollout_idx", "file_rank", "line"], "left_anti")
