"""Deciding what is left to run: filters, subsets, rollouts and resume joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.functions import variants as V


def difficulty_reason(min_turns: int, correct_only: bool = False) -> Column:
    """First failing check of a source review row, else ``selected_rows``."""
    turns = V.loose_int(F.try_parse_json("num_turns"))
    reason = F.when(S.is_blank("question_id"), F.lit("skip_missing_question_id"))
    if correct_only:
        right = F.coalesce(V.loose_bool(F.try_parse_json("is_correct")), F.lit(False))
        reason = reason.when(~right, F.lit("skip_incorrect"))
    return (
        reason.when(turns.isNull(), F.lit("skip_missing_num_turns"))
        .when(turns < min_turns, F.lit("skip_below_min_num_turns"))
        .otherwise(F.lit("selected_rows"))
    )


def with_difficulty(reviews: DataFrame, min_turns: int, correct_only: bool = False) -> DataFrame:
    return reviews.withColumn("reason", difficulty_reason(min_turns, correct_only))


def selected_ids(reviews: DataFrame, min_turns: int, correct_only: bool = False) -> DataFrame:
    chosen = with_difficulty(reviews, min_turns, correct_only).filter("reason = 'selected_rows'")
    return chosen.select(S.strip("question_id").alias("question_id")).distinct()


def reason_histogram(reviews: DataFrame, min_turns: int, correct_only: bool = False) -> DataFrame:
    """Rows and unique question ids per reason."""
    return (
        with_difficulty(reviews, min_turns, correct_only)
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(S.strip("question_id")).alias("question_ids"))
    )


def questions_in(questions: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Questions whose id is listed, optionally the first ``limit`` of them by position."""
    kept = questions.join(ids, "question_id", "left_semi")
    return kept if limit is None else kept.orderBy("position").limit(limit)


def positional_subset(rows: DataFrame, ids: DataFrame, prefix: str = "test_") -> DataFrame:
    """Rows named by zero-based position: row n carries the id ``test_n``."""
    return rows.withColumn("question_id", F.concat(F.lit(prefix), F.col("position").cast("string"))).join(
        ids, "question_id", "left_semi"
    )


def work_items(questions: DataFrame, rollouts: int) -> DataFrame:
    """One row per question and rollout, expanded in place."""
    return questions.withColumn("rollout_idx", F.explode(F.sequence(F.lit(0), F.lit(rollouts - 1))))


def completed_pairs(reviews: DataFrame) -> DataFrame:
    return reviews.filter(F.coalesce(F.col("question_id") != "", F.lit(False))).select("question_id", "rollout_idx").distinct()


def pending(work: DataFrame, completed: DataFrame) -> DataFrame:
    """Work items without a finished record."""
    return work.join(completed, ["question_id", "rollout_idx"], "left_anti")


def partial_output(trajectories: DataFrame, completed: DataFrame) -> DataFrame:
    """Question folders with output but no finished record; listed, never deleted."""
    return trajectories.select("question_id", "rollout_idx").distinct().join(completed, ["question_id", "rollout_idx"], "left_anti")


def rejudge_pending(rows: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose (question_id, answer) text pair was not judged yet; ``limit`` applies first."""
    key = lambda df: df.withColumns(
        {"_q": F.coalesce(F.col("question_id"), F.lit("None")), "_a": F.coalesce(F.col("answer"), F.lit("None"))}
    )
    head = rows if limit is None else rows.orderBy("file_rank", "line").limit(limit)
    return key(head).join(key(done).select("_q", "_a"), ["_q", "_a"], "left_anti").drop("_q", "_a")


def without_rubrics(questions: DataFrame, rubrics: DataFrame) -> DataFrame:
    return questions.join(rubrics.select("question_id"), "question_id", "left_anti")


def with_rubrics(questions: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Attach ready rubrics (question_id, rubrics array); the start state follows from their presence."""
    joined = questions.join(rubrics.select("question_id", "rubrics"), "question_id", "left")
    has = F.coalesce(F.size("rubrics") > 0, F.lit(False))
    return joined.withColumn("start_state", F.when(has, F.lit("ANSWER")).otherwise(F.lit("INITIAL")))


def with_shuffle_key(df: DataFrame, key: Column, seed: str) -> DataFrame:
    """Add the hash of the key whose order is a seeded pseudo-random one."""
    return df.withColumn("shuffle_key", F.md5(F.concat(key.cast("string"), F.lit(seed))))


def shuffled(df: DataFrame, key: Column, seed: str) -> DataFrame:
    """Rows in a seeded pseudo-random order: a range-partitioned sort on a hash of the key."""
    return with_shuffle_key(df, key, seed).orderBy("shuffle_key", key)


def missing_ids(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(present, key, "left_anti")
