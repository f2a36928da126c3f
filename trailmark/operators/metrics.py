"""Typed metric samples: accumulation per unit, three-level means, count windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.plans.blocks import row_numbers

SUM_TYPES = ("INT", "FLOAT")
WINDOW_SIZE = 200


def unit_values(samples: DataFrame) -> DataFrame:
    """One value per (question, rollout, metric): sums for INT and FLOAT, averages for RATE and MEAN."""
    unit = samples.groupBy("question_id", "rollout_idx", "metric_name", "metric_type").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return unit.withColumn(
        "value",
        F.when(F.col("metric_type") == "INT", F.col("total").cast("bigint").cast("double"))
        .when(F.col("metric_type") == "FLOAT", F.col("total"))
        .otherwise(F.col("total") / F.col("samples")),
    )


def type_conflicts(samples: DataFrame) -> DataFrame:
    """Metric names logged under more than one type."""
    return (
        samples.groupBy("metric_name")
        .agg(F.sort_array(F.collect_set("metric_type")).alias("types"))
        .filter(F.size("types") > 1)
    )


def question_values(units: DataFrame) -> DataFrame:
    return units.groupBy("question_id", "metric_name", "metric_type").agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("units")
    )


def report(samples: DataFrame) -> DataFrame:
    """Mean over rollouts, then mean over questions, per metric."""
    return (
        question_values(unit_values(samples))
        .groupBy("metric_name", "metric_type")
        .agg(
            F.avg("value").alias("global_mean"),
            F.count(F.lit(1)).alias("num_questions"),
            F.sum("units").alias("num_units"),
        )
    )


def question_view(samples: DataFrame) -> DataFrame:
    """Per question: metric means and the nested rollout values, as maps.

    Samples are reduced to one row per unit first, so a group is bounded by rollouts times metrics.
    """
    units = unit_values(samples)
    rollouts = (
        units.groupBy("question_id", "rollout_idx")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_name", "value")))).alias("metrics"))
        .groupBy("question_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("rollout_idx", "metrics"))).alias("rollouts"))
    )
    means = question_values(units).groupBy("question_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_name", "value")))).alias("means")
    )
    return means.join(rollouts, "question_id")


def tool_samples(calls: DataFrame) -> DataFrame:
    """Call count, error flag and latency samples for every finished tool call.

    Input: question_id, rollout_idx, name, ok, duration_ms.
    """
    sample = lambda prefix, kind, value: F.struct(
        F.concat(F.lit(prefix + "."), F.col("name")).alias("metric_name"),
        F.lit(kind).alias("metric_type"),
        value.cast("double").alias("value"),
    )
    return calls.select(
        "question_id",
        "rollout_idx",
        F.explode(
            F.array(
                sample("tool_calls", "INT", F.lit(1)),
                sample("tool_error_rate", "RATE", ~F.col("ok")),
                sample("tool_latency_ms", "MEAN", F.col("duration_ms")),
            )
        ).alias("s"),
    ).select("question_id", "rollout_idx", "s.*")


def retry_counts(retries: DataFrame) -> DataFrame:
    """Retries per (question, rollout, reason) as INT metric rows."""
    return retries.groupBy("question_id", "rollout_idx", F.concat(F.lit("num_retries."), F.col("reason")).alias("metric_name")).agg(
        F.count(F.lit(1)).alias("retries")
    )


def count_windows(samples: DataFrame, size: int = WINDOW_SIZE) -> DataFrame:
    """Mean, min and max of every full window of ``size`` samples per metric, in seq order."""
    numbered = row_numbers(samples, ["metric_name"], "seq", "_rn")
    return (
        numbered.groupBy("metric_name", F.floor((F.col("_rn") - 1) / size).cast("bigint").alias("window_idx"))
        .agg(
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.count(F.lit(1)).alias("samples"),
        )
        .filter(F.col("samples") == size)
    )
