"""Tables in answers, column rules, and the rows of both sides made comparable, all instances in one job.

Rows travel as arrays aligned with the required columns of their instance, copies of a row are reduced before every
shuffle, and the rules of an instance join where they are needed. ``tablescore`` scores the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.functions import tables as X
from trailmark.operators.cellplan import CellPlan, cell_plan, rules
from trailmark.plans.keyed import first_by

# ---- fixed values -------------------------------------------------------------------------
NATIVE_METRICS = ("exact_match", "number_near", "date_near", "url_match")
MODEL_METRIC = "llm_judge"
MAPPED_METRICS = ("llm_judge", "exact_match")
SPEC_SCHEMA = (
    "required array<string>, unique_columns array<string>, "
    "eval_pipeline map<string, struct<preprocess: array<string>, metric: array<string>, criterion: variant>>"
)
# -------------------------------------------------------------------------------------------


def extract_tables(responses: DataFrame) -> DataFrame:
    """Add columns (header), lines (cell arrays) and table_error to (instance_id, response)."""
    block = responses.withColumn("_block", X.table_block(F.col("response")))
    parsed = block.withColumn("_lines", X.table_lines(F.col("_block"))).withColumn("_head", F.get("_lines", F.lit(0)))
    parsed = parsed.withColumn("_body", F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(1)))).withColumn(
        "columns", F.transform(F.filter("_head", lambda h: h != ""), S.norm_column)
    )
    error = (
        F.when(S.is_blank("response"), F.lit("empty_response"))
        .when(F.col("_block").isNull(), F.lit("no_table"))
        .when(S.is_blank("_block"), F.lit("empty_table"))
        .when(F.size("_lines") < 2, F.lit("no_data_rows"))
        .when(F.exists("_body", lambda r: F.size(r) > F.size(F.col("_head"))), F.lit("bad_row_width"))
        .when(F.size("columns") == 0, F.lit("no_data_rows"))
    )
    parsed = parsed.withColumn("table_error", error)
    good = F.col("table_error").isNull()
    return parsed.select(
        *responses.columns,
        F.when(good, F.col("columns")).alias("columns"),
        F.when(good, F.col("_head")).alias("header"),
        F.when(good, F.col("_body")).alias("lines"),
        "table_error",
    )


def table_headers(tables: DataFrame) -> DataFrame:
    return tables.select("instance_id", "columns", "table_error")


def table_rows(tables: DataFrame) -> DataFrame:
    """Rows of extracted tables as (instance_id, row_id, cells map)."""
    usable = F.col("table_error").isNull() & (F.size(F.array_distinct("columns")) == F.size("columns"))
    # outer explode: a filter on the parsed columns would be pushed down and repeat the parse
    lines = tables.select("instance_id", "header", F.posexplode_outer(F.when(usable, F.col("lines"))).alias("row_id", "line"))
    lines = lines.filter("line IS NOT NULL")
    named = F.filter(
        F.transform(F.col("header"), lambda h, i: F.struct(S.norm_column(h).alias("k"), F.get(F.col("line"), i).alias("v"))),
        lambda e: e["k"] != "",
    )
    return lines.select("instance_id", F.col("row_id").cast("bigint").alias("row_id"), F.map_from_entries(named).alias("cells"))


def gold_from_csv(gold: DataFrame) -> DataFrame:
    """Turn (instance_id, gold_csv) into the same shape ``extract_tables`` gives."""
    recs = gold.withColumn("_r", X.csv_records(F.col("gold_csv"))).withColumn("header", F.get("_r", F.lit(0)))
    return recs.select(
        "instance_id",
        F.transform("header", S.norm_column).alias("columns"),
        "header",
        F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(1))).alias("lines"),
        F.when(F.size("_r") < 1, F.lit("empty_table"))
        .when(F.exists(F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(1))), lambda r: F.size(r) > F.size("header")), F.lit("bad_row_width"))
        .alias("table_error"),
    )


def rows_from_cells(cells: DataFrame) -> DataFrame:
    """Long cells (instance_id, row_id, column_name, value) to one map per row."""
    return cells.groupBy("instance_id", "row_id").agg(
        F.map_from_entries(F.collect_list(F.struct(S.norm_column("column_name"), F.col("value")))).alias("cells")
    )


def headers_from_rows(rows: DataFrame) -> DataFrame:
    """Header per instance: all column names of its rows, so bounded by the table's width."""
    names = rows.select("instance_id", F.explode_outer(F.map_keys("cells")).alias("name"))
    return names.groupBy("instance_id").agg(
        F.array_sort(F.collect_set("name")).alias("columns"), F.lit(None).cast("string").alias("table_error")
    )


def parse_specs(specs: DataFrame) -> DataFrame:
    """Evaluation JSON to aligned column rules and an error text.

    ``cols`` holds one struct per required column: name, is_key, has_rule, preprocess, metric, criterion.
    """
    # One spec per instance; different ones are an error. The aggregate also keeps later filters from
    # re-inlining the JSON parse, and its partitioning by instance serves the joins that follow.
    p = specs.groupBy("instance_id").agg(
        F.min_by(F.from_json("evaluation", SPEC_SCHEMA), F.coalesce("evaluation", F.lit(""))).alias("p"),
        (F.min(F.coalesce("evaluation", F.lit(""))) != F.max(F.coalesce("evaluation", F.lit("")))).alias("duplicate"),
    ).select("instance_id", "duplicate", "p.*")
    p = p.select(
        "instance_id",
        "duplicate",
        F.transform("required", S.norm_column).alias("required"),
        F.transform("unique_columns", S.norm_column).alias("unique_columns"),
        F.transform(
            F.map_entries("eval_pipeline"), lambda e: F.struct(S.norm_column(e["key"]).alias("name"), e["value"].alias("rule"))
        ).alias("pipeline"),
    )
    empty = F.array().cast("array<string>")

    def column_rule(name: Column) -> Column:
        rule = F.try_element_at(F.filter("pipeline", lambda e: e["name"] == name), F.lit(-1))
        return F.struct(
            name.alias("name"),
            F.array_contains("unique_columns", name).alias("is_key"),
            rule.isNotNull().alias("has_rule"),
            F.coalesce(rule["rule"]["preprocess"], empty).alias("preprocess"),
            F.coalesce(rule["rule"]["metric"], empty).alias("metric"),
            F.try_variant_get(rule["rule"]["criterion"], "$", "double").alias("criterion"),
        )

    known = F.array(*[F.lit(m) for m in (*NATIVE_METRICS, MODEL_METRIC)])
    steps = F.array(*[F.lit(s) for s in S.PREPROCESSORS])
    complete = F.col("required").isNotNull() & F.col("unique_columns").isNotNull() & F.col("pipeline").isNotNull()
    out = p.withColumn("cols", F.when(complete, F.transform("required", column_rule)))
    return out.withColumn(
        "spec_error",
        F.when(F.col("duplicate"), F.lit("duplicate_spec"))
        .when(~complete, F.lit("invalid_spec"))
        .when(F.size(F.array_except("unique_columns", "required")) > 0, F.lit("key_not_required"))
        .when(F.exists("cols", lambda c: ~c["is_key"] & ~c["has_rule"]), F.lit("column_without_rule"))
        .when(
            F.exists("pipeline", lambda e: ~F.array_contains("required", e["name"]) & (F.size(F.coalesce(e["rule"]["preprocess"], empty)) > 0)),
            F.lit("rule_without_column"),
        )
        .when(
            F.exists("cols", lambda c: ~c["is_key"] & F.array_contains(c["metric"], "number_near") & c["criterion"].isNull()),
            F.lit("missing_criterion"),
        ),
    ).withColumn(
        "rule_error",
        F.when(F.exists("cols", lambda c: F.size(F.array_except(c["preprocess"], steps)) > 0), F.lit("unknown_preprocess")).when(
            F.exists("cols", lambda c: ~c["is_key"] & (F.size(F.array_except(c["metric"], known)) > 0)), F.lit("unknown_metric")
        ),
    )


def spec_columns(parsed: DataFrame) -> DataFrame:
    """Parsed specs as one row per required column."""
    return parsed.filter("spec_error IS NULL").select(
        "instance_id", F.posexplode("cols").alias("ordinal", "c")
    ).select("instance_id", "ordinal", "c.*")


def _header_renames(headers: DataFrame, parsed: DataFrame, header_map: DataFrame) -> DataFrame:
    """Usable renames per instance: known origin, required target. Bounded by the table's width."""
    sides = headers.join(parsed.select("instance_id", "required"), "instance_id")
    usable = header_map.join(sides, "instance_id").filter(
        F.array_contains("columns", F.col("origin")) & F.array_contains("required", F.col("transform"))
    )
    return usable.groupBy("instance_id", "origin").agg(F.max("transform").alias("transform")).groupBy("instance_id").agg(
        F.map_from_entries(F.collect_list(F.struct("origin", "transform"))).alias("rename")
    )


def instance_status(
    parsed: DataFrame, pred_headers: DataFrame, gold_headers: DataFrame, header_map: DataFrame | None = None
) -> DataFrame:
    """Per instance: the first failure, and for good ones where each required column comes from."""
    st = parsed.join(pred_headers.select("instance_id", F.col("columns").alias("p_cols"), F.col("table_error").alias("p_err")), "instance_id", "left")
    st = st.join(gold_headers.select("instance_id", F.col("columns").alias("g_cols"), F.col("table_error").alias("g_err")), "instance_id", "left")
    if header_map is not None:
        st = st.join(_header_renames(pred_headers, parsed, header_map), "instance_id", "left")
    else:
        st = st.withColumn("rename", F.lit(None).cast("map<string,string>"))
    same = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    moved = F.transform("p_cols", lambda c: F.coalesce(F.try_element_at(F.col("rename"), c), c))
    st = st.withColumn("mapped", F.when(same(F.col("required"), F.col("p_cols")), F.col("p_cols")).otherwise(moved))
    error = (
        F.when(F.col("spec_error").isNotNull(), F.col("spec_error"))
        .when(F.col("p_err").isNotNull(), F.col("p_err"))
        .when(F.col("p_cols").isNull(), F.lit("empty_response"))
        .when(F.col("g_err").isNotNull() | F.col("g_cols").isNull(), F.lit("gold_unreadable"))
        .when(
            ~same(F.col("required"), F.col("mapped")) | (F.size("mapped") != F.size(F.array_distinct("mapped"))),
            F.lit("predicted_columns_differ"),
        )
        .when(F.size(F.array_except("required", "g_cols")) > 0, F.lit("gold_columns_differ"))
        .otherwise(F.col("rule_error"))
    )
    source = F.transform("required", lambda r: F.get(F.col("p_cols"), (F.array_position("mapped", r) - 1).cast("int")))
    return st.select(
        "instance_id",
        error.alias("error"),
        "required",
        "cols",
        source.alias("source"),
        F.filter(F.transform("cols", lambda c, i: F.when(c["is_key"], i)), lambda i: i.isNotNull()).alias("key_idx"),
        F.size("required").alias("n_required"),
    )


def _aligned(rows: DataFrame, ready: DataFrame, names: str, plan: CellPlan | None = None) -> DataFrame:
    """Row cells in required order, with the rules of their columns and the columns whose values may be mapped."""
    return _lined_up(rows, ready, names, plan or cell_plan(ready)).join(ready.select("instance_id", "cols", _mapped().alias("mapped")), "instance_id")


def _mapped() -> Column:
    """Place and name of the key columns whose metric allows mapping; found once per instance, not per row."""
    allowed = lambda c: c["is_key"] & F.exists(c["metric"], lambda m: m.isin(*MAPPED_METRICS))
    return F.filter(F.transform("cols", lambda c, i: F.when(allowed(c), F.struct(i.alias("ordinal"), c["name"].alias("column_name")))), lambda m: m.isNotNull())


def _lined_up(rows: DataFrame, ready: DataFrame, names: str, plan: CellPlan) -> DataFrame:
    """Row cells (instance_id, row_id, vals) in required order."""
    joined = rows.join(ready.select("instance_id", "n_required", F.col(names).alias("_names")), "instance_id")
    cells = [X.cell_text(F.try_element_at("cells", F.get("_names", F.lit(i)))) for i in range(plan.width)]
    return joined.select("instance_id", "row_id", F.slice(F.array(*cells), 1, F.greatest("n_required", F.lit(0))).alias("vals"))


def _key() -> Column:
    """Values of the key columns, in required order.

    Never null, and by its type: a join on a key that may be null puts a filter below the normalisation, which would then
    run again for each key column.
    """
    return F.coalesce(F.transform("key_idx", lambda i: F.get("vals", i)), F.array().cast("array<string>"))


def _prepared(lined_up: DataFrame, ready: DataFrame, plan: CellPlan) -> DataFrame:
    """Drop later rows with the same raw key, normalise the cells of the others, and count equal rows.

    Only cells travel, each once, those of the key apart from the others; the rules of an instance join again where they are
    needed. Rows are sorted by their first key cell, so neighbours in a shuffled block have much in common.
    """
    keys = ready.select("instance_id", "key_idx")
    is_key = lambda i: F.array_contains("key_idx", F.lit(i))
    rest = F.slice(F.array(*[F.when(~is_key(i), F.get("vals", F.lit(i))) for i in range(plan.width)]), 1, F.size("vals"))
    raw = lined_up.join(keys, "instance_id").select("instance_id", _key().alias("raw_key"), "row_id", rest.alias("rest"))
    kept = first_by(raw.withColumn("lead", F.get("raw_key", F.lit(0))), ["lead", "instance_id", "raw_key"], ["row_id"], hashed=False)
    own = lambda i: F.get("raw_key", (F.array_position("key_idx", F.lit(i)) - 1).cast("int"))
    whole = plan.per_position(lambda i: F.when(is_key(i), own(i)).otherwise(F.get("rest", F.lit(i))))
    ruled = kept.join(rules(ready, plan), "instance_id").withColumn("vals", whole).withColumn("vals", plan.normalised)
    return with_key(ruled.groupBy("instance_id", "vals").agg(F.count(F.lit(1)).alias("copies")), ready)


def with_key(rows: DataFrame, ready: DataFrame) -> DataFrame:
    """Normalised rows with their key, which their cells hold already."""
    return rows.join(ready.select("instance_id", "key_idx"), "instance_id").select("instance_id", _key().alias("key"), "vals", "copies")


def map_vocabulary(aligned: DataFrame, gold: DataFrame, key_map: DataFrame) -> DataFrame:
    """Replace key values by their gold counterpart where the map names one.

    A pair counts only if its origin occurs among predicted and its target among gold values of the
    column, and the column's metric allows mapping.
    """
    cell = lambda m: F.struct(m["ordinal"].alias("ordinal"), m["column_name"].alias("column_name"), F.get("vals", m["ordinal"]).alias("value"))
    # outer explode: the inner one would add a filter that lines the cells up again
    keyed = lambda df: df.select("instance_id", "row_id", F.explode_outer(F.transform("mapped", cell)).alias("e")).filter("e IS NOT NULL").select("instance_id", "row_id", "e.*")
    seen = keyed(aligned)
    targets = keyed(gold).select("instance_id", "column_name", F.col("value").alias("transform")).distinct()
    usable = (
        key_map.join(targets, ["instance_id", "column_name", "transform"], "left_semi")
        .groupBy("instance_id", "column_name", "origin")
        .agg(F.max("transform").alias("transform"))
    )
    hits = (
        seen.join(usable.withColumnRenamed("origin", "value"), ["instance_id", "column_name", "value"])
        .groupBy("instance_id", "row_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "transform"))).alias("_hits"))
    )
    return aligned.join(hits, ["instance_id", "row_id"], "left").withColumn(
        "vals", F.transform("vals", lambda v, i: F.coalesce(F.try_element_at(F.col("_hits"), i), v))
    ).drop("_hits")


def prepare_sides(
    status: DataFrame, gold_rows: DataFrame, pred_rows: DataFrame, key_map: DataFrame | None = None, plan: CellPlan | None = None
) -> tuple[DataFrame, DataFrame]:
    """Deduplicated, normalised gold and predicted rows of the instances that can be scored."""
    ready = status.filter("error IS NULL")
    plan = plan or cell_plan(ready)
    if key_map is None:
        gold, pred = _lined_up(gold_rows, ready, "required", plan), _lined_up(pred_rows, ready, "source", plan)
    else:
        gold, pred = _aligned(gold_rows, ready, "required", plan), _aligned(pred_rows, ready, "source", plan)
        gold, pred = gold.drop("cols", "mapped"), map_vocabulary(pred, gold, key_map).drop("cols", "mapped")
    return _prepared(gold, ready, plan), _prepared(pred, ready, plan)
