"""Checking tool-call arguments against rule rows, one row per violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import variants as V

# ---- fixed values: tool, parent object, field, allowed JSON types, required, allowed texts, type of array items --
RULES = (
    ("search_api", "$", "query", ("string",), True, None, None),
    ("search_api", "$", "return_n", ("integer",), False, None, None),
    ("link_summary_tool", "$", "question", ("string",), True, None, None),
    ("link_summary_tool", "$", "url", ("string", "array"), True, None, "string"),
    ("read_memory_tool", "$", "memory_id", ("string",), True, None, None),
    ("read_memory_tool", "$", "include_conversation", ("boolean",), False, None, None),
    ("read_memory_tool", "$", "max_messages", ("integer",), False, None, None),
    ("read_memory_tool", "$", "max_chars", ("integer",), False, None, None),
    ("read_memory_tool", "$", "include_structured", ("boolean",), False, None, None),
    ("read_memory_tool", "$", "structured_max_chars", ("integer",), False, None, None),
    ("seal_memory_tool", "$", "knowledge_graph", ("array",), False, None, None),
    ("seal_memory_tool", "$", "navigation_state", ("object",), False, None, None),
    ("seal_memory_tool", "$", "meta_learnings", ("array",), False, None, "string"),
    ("seal_memory_tool", "$", "next_step_plan", ("string",), True, None, None),
    ("seal_memory_tool", "$", "task_progress", ("string",), True, None, None),
    ("seal_memory_tool", "$", "stage", ("string",), False, None, None),
    ("seal_memory_tool", "$", "tags", ("array",), False, None, "string"),
    ("seal_memory_tool", "$", "comment", ("string",), False, None, None),
    ("seal_memory_tool", "$", "structured_summary", ("string",), False, None, None),
    ("seal_memory_tool", "$.knowledge_graph[]", "fact", ("string",), True, None, None),
    ("seal_memory_tool", "$.knowledge_graph[]", "source_url", ("string",), False, None, None),
    ("seal_memory_tool", "$.knowledge_graph[]", "status", ("string",), True, ("verified", "conflicting", "partial"), None),
    ("seal_memory_tool", "$.navigation_state", "visited_summary", ("string",), True, None, None),
    ("seal_memory_tool", "$.navigation_state", "frontier_queue", ("array",), True, None, None),
    ("seal_memory_tool", "$.navigation_state", "dead_ends", ("array",), True, None, "string"),
    ("seal_memory_tool", "$.navigation_state.frontier_queue[]", "target", ("string",), False, None, None),
    ("seal_memory_tool", "$.navigation_state.frontier_queue[]", "reason", ("string",), False, None, None),
)
# -------------------------------------------------------------------------------------------

RULE_SCHEMA = "name string, parent string, field string, types array<string>, required boolean, allowed array<string>, items string"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def json_type(v: Column) -> Column:
    k = V.kind(v)
    return (
        F.when(k == "BIGINT", F.lit("integer"))
        .when(k.rlike(V.NUMERIC_KINDS), F.lit("number"))
        .when(k == "STRING", F.lit("string"))
        .when(k == "BOOLEAN", F.lit("boolean"))
        .when(k == "VOID", F.lit("null"))
        .when(k.startswith("ARRAY"), F.lit("array"))
        .otherwise(F.lit("object"))
    )


def _nodes(v: Column) -> Column:
    """Every object the rules speak about: (parent kind, path, value)."""
    one = lambda parent, path, value: F.array(F.struct(F.lit(parent).alias("parent"), F.lit(path).alias("path"), value.alias("v")))
    items = lambda parent, path, arr: F.coalesce(
        F.transform(
            V.at(v, arr).try_cast("array<variant>"),
            lambda e, i: F.struct(F.lit(parent).alias("parent"), F.concat(F.lit(path + "["), i.cast("string"), F.lit("]")).alias("path"), e.alias("v")),
        ),
        F.array().cast("array<struct<parent:string,path:string,v:variant>>"),
    )
    return F.concat(
        one("$", "$", v),
        one("$.navigation_state", "$.navigation_state", V.at(v, "$.navigation_state")),
        items("$.knowledge_graph[]", "$.knowledge_graph", "$.knowledge_graph"),
        items("$.navigation_state.frontier_queue[]", "$.navigation_state.frontier_queue", "$.navigation_state.frontier_queue"),
    )


def violations(calls: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Required, type, enum and extra-field violations with their path.

    Input: keys, name, arguments (JSON text; absent or blank counts as an empty object). Calls whose tool
    has no rules give no rows.
    """
    text = F.when(F.coalesce(F.btrim("arguments"), F.lit("")) == "", F.lit("{}")).otherwise(F.col("arguments"))
    parsed = calls.select(*keys, "name", F.try_parse_json(text).alias("v"))
    per_node = rules.groupBy("name", "parent").agg(F.collect_list(F.struct("field", "types", "required", "allowed", "items")).alias("rules"))
    nodes = parsed.select(*keys, "name", F.explode(_nodes(F.col("v"))).alias("n")).select(*keys, "name", "n.*")
    nodes = nodes.join(per_node, ["name", "parent"])
    fields = nodes.filter(V.is_object("v") | (F.col("parent") == "$")).withColumn("m", F.col("v").try_cast("map<string,variant>"))
    bad_root = F.when(
        ~V.is_object("v"), F.array(F.struct(F.col("path"), F.lit("type").alias("rule"), F.lit("object").alias("detail")))
    )

    def of_rule(r: Column) -> Column:
        value = F.try_element_at(F.col("m"), r["field"])
        path = F.concat("path", F.lit("."), r["field"])
        return (
            F.when(V.kind(value).isNull() & r["required"], F.struct(F.col("path"), F.lit("required").alias("rule"), r["field"].alias("detail")))
            .when(
                V.kind(value).isNotNull() & ~F.array_contains(r["types"], json_type(value)),
                F.struct(path.alias("path"), F.lit("type").alias("rule"), F.array_join(r["types"], "|").alias("detail")),
            )
            .when(
                V.kind(value).isNotNull() & r["allowed"].isNotNull() & ~F.array_contains(r["allowed"], value.try_cast("string")),
                F.struct(path.alias("path"), F.lit("enum").alias("rule"), F.array_join(r["allowed"], "|").alias("detail")),
            )
        )

    def of_items(r: Column) -> Column:
        """Array elements of the wrong type; for a field with alternatives the field itself is reported."""
        elements = F.try_element_at(F.col("m"), r["field"]).try_cast("array<variant>")
        path = F.concat("path", F.lit("."), r["field"])
        wrong = F.filter(
            F.transform(elements, lambda e, i: F.struct(i.alias("i"), json_type(e).alias("t"))), lambda e: e["t"] != r["items"]
        )
        each = F.transform(
            wrong, lambda e: F.struct(F.concat(path, F.lit("["), e["i"].cast("string"), F.lit("]")).alias("path"), F.lit("type").alias("rule"), r["items"].alias("detail"))
        )
        whole = F.array(F.struct(path.alias("path"), F.lit("oneOf").alias("rule"), F.array_join(r["types"], "|").alias("detail")))
        none = F.array().cast("array<struct<path:string,rule:string,detail:string>>")
        return F.when(r["items"].isNull() | (F.coalesce(F.size(wrong), F.lit(0)) <= 0), none).when(F.size(r["types"]) > 1, whole).otherwise(each)

    # only the root object forbids fields without a rule
    known = F.transform("rules", lambda r: r["field"])
    extra = F.transform(
        F.when(F.col("parent") == "$", F.array_except(F.map_keys("m"), known)).otherwise(F.array().cast("array<string>")),
        lambda f: F.struct(F.col("path"), F.lit("extra").alias("rule"), f.alias("detail")),
    )
    single = F.filter(F.transform("rules", of_rule), lambda e: e.isNotNull())
    found = F.coalesce(bad_root, F.concat(single, F.flatten(F.transform("rules", of_items)), extra))
    return fields.select(*keys, "name", F.explode(found).alias("e")).select(*keys, "name", "e.path", "e.rule", "e.detail")
