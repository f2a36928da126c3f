"""Rubric tables: loading, attaching check results, splitting results and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import variants as V

RUBRIC = "array<struct<id:string,description:string>>"


def _accepted(items: Column) -> Column:
    """Entries with a description; a missing id becomes the next ordinal among accepted ones."""
    kept = F.filter(items, lambda e: V.is_object(e) & V.kind(V.at(e, "$.description")).isNotNull())
    return F.transform(
        kept,
        lambda e, i: F.struct(
            F.coalesce(V.text_at(e, "$.id"), (i + 1).cast("string")).alias("id"), V.text_at(e, "$.description").alias("description")
        ),
    ).cast(RUBRIC)


def from_lines(lines: DataFrame) -> DataFrame:
    """JSONL text rows to (question_id, rubrics)."""
    r = lines.select(F.try_parse_json("text").alias("r")).filter(V.is_object("r"))
    return r.select(
        V.text_at("r", "$.question_id").alias("question_id"), _accepted(V.at("r", "$.rubrics").try_cast("array<variant>")).alias("rubrics")
    )


def from_map(documents: DataFrame) -> DataFrame:
    """JSON documents mapping question ids to ``{"rubrics": [...]}`` to (question_id, rubrics)."""
    entries = documents.select(F.explode(F.from_json("text", "map<string,struct<rubrics:array<variant>>>")).alias("question_id", "e"))
    return entries.select("question_id", _accepted(F.col("e.rubrics")).alias("rubrics"))


def usable(rubrics: DataFrame, valid_ids: DataFrame) -> DataFrame:
    """Known questions with at least one rubric."""
    return rubrics.filter(F.coalesce(F.size("rubrics") > 0, F.lit(False))).join(valid_ids, "question_id", "left_semi")


def exploded(rubrics: DataFrame) -> DataFrame:
    return rubrics.select("question_id", F.posexplode("rubrics").alias("pos", "r")).select("question_id", "pos", "r.*")


def with_checks(rubrics: DataFrame, checks: DataFrame) -> DataFrame:
    """Rubric rows with their check result; a rubric nobody checked is not satisfied."""
    joined = rubrics.drop("satisfied").join(checks.select("question_id", "id", "satisfied"), ["question_id", "id"], "left")
    return joined.withColumn("satisfied", F.coalesce("satisfied", F.lit(False)))
