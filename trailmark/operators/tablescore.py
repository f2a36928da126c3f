"""Scores of predicted tables against gold tables, all instances in one job.

Equal rows keep a multiplicity instead of being paired one by one, a key that many rows share is scored from the counts
of its values, and only per-instance sums cross the last shuffle, so one large instance or one key that a third of
all rows falls to does not end up in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.operators import tablematch as TM
from trailmark.operators.cellplan import CellPlan, cell_plan, has, pair_columns, rules, typed
from trailmark.plans.blocks import running_sums
from trailmark.plans.staging import staged

# ---- fixed values -------------------------------------------------------------------------
SCORE_NAMES = ("row_precision", "row_recall", "row_f1", "item_precision", "item_recall", "item_f1")
F1_FLOOR = 1e-9
# -------------------------------------------------------------------------------------------


def cell_score(metric: Column, response: Column, target: Column, criterion: Column) -> Column:
    """Native score of one cell; a model-judged cell scores zero here."""
    score = (
        F.when(metric == "exact_match", S.exact_match(response, target))
        .when(metric == "number_near", S.number_near(response, target, criterion))
        .when(metric == "date_near", S.date_near(response, target))
        .when(metric == "url_match", S.url_match(response, target))
    )
    return F.coalesce(score, F.lit(0.0))


def with_types(side: DataFrame, ready: DataFrame, plan: CellPlan, slim: bool = False) -> DataFrame:
    """Add the numbers and days of the cells that are compared as such; ``slim`` leaves out the texts that no native comparison reads."""
    ruled = side.join(rules(ready, plan).select("instance_id", "mask", "n_required"), "instance_id").withColumns(plan.typed_vals)
    if slim:
        ruled = ruled.withColumn("vals", plan.per_position(lambda i: _read_text(plan, i)))
    return ruled.drop("mask", "n_required")


def _read_text(plan: CellPlan, i: int) -> Column:
    """The text of a typed cell where a native comparison reads it, else null."""
    read = F.lit(False)
    for m in (m for at, m in plan.spots if at == i and m != "date_near"):
        read = read | (has("mask", i, m) & (F.get("numbers", F.lit(i)).isNull() if m == "number_near" else F.lit(True)))
    return F.when(read, F.get("vals", F.lit(i)))


def staged_side(side: DataFrame, ready: DataFrame, plan: CellPlan) -> tuple[DataFrame, DataFrame]:
    """Prepared rows (instance_id, key, vals, copies) read back from a written table, and their number per instance.

    What is written has a column per cell, as cells of one column pack well; keys, numbers and days are found again where they are needed.
    """
    cells = [F.get("vals", F.lit(i)).alias(f"c{i}") for i in range(plan.width)]
    kept = staged(side.select("instance_id", "copies", *cells), "side")
    widths = ready.select("instance_id", "n_required")
    whole = kept.join(widths, "instance_id").select("instance_id", "copies", plan.per_position(lambda i: F.col(f"c{i}")).alias("vals"))
    return TM.with_key(whole, ready), kept.groupBy("instance_id").agg(F.sum("copies").alias("rows"))


def matched_rows(gold: DataFrame, pred: DataFrame, on: tuple[str, ...] = ("instance_id", "key")) -> DataFrame:
    """Gold and predicted rows with equal normalised keys; many-to-many by multiplicity.

    Typed cells (``with_types``) come along as g_... and p_...
    """
    names = {"vals": ("target", "response"), "copies": ("_g", "_p"), "numbers": ("g_numbers", "p_numbers"), "days": ("g_days", "p_days")}

    def side(df: DataFrame, which: int) -> DataFrame:
        return df.select(F.hash(*on).alias("_h"), *on, *[F.col(c).alias(n[which]) for c, n in names.items() if c in df.columns])

    pairs = side(gold, 0).join(side(pred, 1), ["_h", *on])
    return pairs.withColumn("weight", F.col("_g") * F.col("_p")).drop("_g", "_p", "_h")


def pair_scores(pairs: DataFrame, ready: DataFrame, cell_scores: DataFrame | None = None, plan: CellPlan | None = None) -> DataFrame:
    """Row score (minimum over cells) and item score (sum over cells) per matched pair."""
    plan = plan or cell_plan(ready)
    scored = pairs.join(rules(ready, plan), "instance_id")
    if "g_numbers" not in pairs.columns:
        scored = scored.withColumns({f"{s}_{n}": c for s, v in (("g", "target"), ("p", "response")) for n, c in typed(plan, v).items()})
    ids = ["instance_id", "key", "target", "response"]
    base = scored.withColumns(pair_columns(plan)).select(*ids, "weight", "row_score", "item_score")
    model = ready.select("instance_id", F.transform("cols", _asks_model).alias("_asks"), F.transform("cols", lambda c: c["name"]).alias("_cols"))
    if cell_scores is None:
        asks = model.select("instance_id", F.exists("_asks", lambda a: a).alias("_model"))
        lost = base.join(asks, "instance_id").withColumn("row_score", F.when(F.col("_model"), F.lit(0.0)).otherwise(F.col("row_score")))
        return lost.drop("_model")
    asked = base.join(model.filter(F.exists("_asks", lambda a: a)), "instance_id").select(*ids, F.posexplode("_asks").alias("i", "_a"), "_cols").filter("_a")
    asked = asked.select(*ids, F.get("_cols", F.col("i")).alias("column_name"), F.get("response", F.col("i")).alias("_r"), F.get("target", F.col("i")).alias("_t"))
    table = cell_scores.select("instance_id", "column_name", F.col("response").alias("_r"), F.col("target").alias("_t"), "score")
    judged = asked.join(table, ["instance_id", "column_name", "_r", "_t"], "left").groupBy(*ids).agg(
        F.min(F.coalesce("score", F.lit(0.0))).alias("_min"), F.sum(F.coalesce("score", F.lit(0.0))).alias("_sum")
    )
    return base.join(judged, ids, "left").select(
        *ids,
        "weight",
        F.least("row_score", F.coalesce("_min", F.lit(1.0))).alias("row_score"),
        (F.col("item_score") + F.coalesce("_sum", F.lit(0.0))).alias("item_score"),
    )


def _asks_model(c: Column) -> Column:
    return ~c["is_key"] & F.array_contains(c["metric"], TM.MODEL_METRIC)


#: Different rows a side up to which the rows of a key are paired; a key with more on both sides is crowded.
FEW = 32


def crowded_keys(gold: DataFrame, pred: DataFrame) -> DataFrame | None:
    """Hashes of keys with more than ``FEW`` different rows on both sides; None if there are none.

    Keys that merely share a hash with one are scored the same way, which changes no result.
    """
    many = lambda df: df.groupBy(F.hash("instance_id", "key").alias("_h")).agg(F.count("*").alias("n")).filter(F.col("n") > FEW).select("_h")
    full = staged(many(gold), "crowded")
    if not full.isEmpty():  # else the other side need not be counted
        full = staged(many(within(pred, full, "left_semi")), "crowded")
    return None if full.isEmpty() else full


def within(side: DataFrame, full: DataFrame, how: str) -> DataFrame:
    return side.join(full, F.hash("instance_id", "key") == F.col("_h"), how)


def _spots(side: DataFrame, ready: DataFrame, plan: CellPlan) -> DataFrame:
    """Counted cells (instance_id, key, i, metric, token, value, criterion, n) of all native comparisons.

    Cells agree if their tokens are equal or, where there is none, their values lie near. A cell without either agrees with none.
    """
    texts, numbers, days = (lambda i, n=n: F.get(n, F.lit(i)) for n in ("vals", "numbers", "days"))

    def token(i: int, m: str) -> Column:
        marked = lambda c: F.concat(F.lit("="), c)
        if m == "exact_match":
            return F.coalesce(marked(F.lower(texts(i))), F.lit(""))
        if m == "url_match":
            return marked(F.array_join(S.url_hosts(texts(i)), "\n"))
        if m == "number_near":
            return F.when(numbers(i).isNull(), F.coalesce(marked(texts(i)), F.lit("")))
        return F.when(days(i).isNull(), F.lit(""))

    def value(i: int, m: str) -> Column:
        found = F.nanvl(numbers(i), F.lit(None)) + F.lit(0.0) if m == "number_near" else days(i).cast("double") if m == "date_near" else F.lit(None)
        return found.cast("double")

    ruled = side.join(rules(ready, plan), "instance_id")
    near = lambda i, m: F.get("criterion", F.lit(i)) if m == "number_near" else F.lit(None)
    cell = lambda i, m: F.struct(F.lit(i).alias("i"), F.lit(m).alias("metric"), token(i, m).alias("token"), value(i, m).alias("value"), near(i, m).cast("double").alias("criterion"))
    cells = F.array(*[F.when(has("mask", i, m), cell(i, m)) for i, m in plan.spots])
    # outer: a filter on the made cells would otherwise be pushed down and make them twice
    each = ruled.select("instance_id", "key", "copies", F.explode_outer(cells).alias("c")).filter("c IS NOT NULL")
    return each.groupBy("instance_id", "key", "c").agg(F.sum("copies").alias("n")).select("instance_id", "key", "c.*", "n")


def _equal_cells(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Agreeing cells by equal tokens (instance_id, item_tp)."""
    on = ["instance_id", "key", "i", "metric", "token"]
    sides = [df.filter("token IS NOT NULL").groupBy(*on).agg(F.sum("n").alias(n)) for df, n in ((gold, "g"), (pred, "p"))]
    return sides[0].join(sides[1], on).select("instance_id", (F.col("g") * F.col("p")).cast("double").alias("item_tp"))


def _near_cells(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Agreeing cells by near values (instance_id, item_tp): how many responses lie in each target's range.

    Responses and range ends of all groups are sorted together once; the running count of responses at the upper end less
    that at the lower end is the number between, whatever precedes the group. An end that is itself near counts responses
    equal to it, so the borders are those of the pairwise comparison.
    """
    t = F.col("value")
    reach = F.when(F.col("metric") == "number_near", F.abs(t) * F.col("criterion")).otherwise(F.lit(float(S.DATE_WINDOW_DAYS)))
    ends = gold.filter("value IS NOT NULL").withColumn("_d", reach).filter((F.col("_d") >= 0) & ~F.isnan("_d"))
    near = lambda e: (F.abs(e - t) <= F.col("_d")) & ~F.isnan(e - t)
    upper, lower = F.nanvl(t + F.col("_d"), F.lit(float("inf"))), F.nanvl(t - F.col("_d"), F.lit(float("-inf")))
    both = F.array(
        F.struct((upper + 0.0).alias("at"), F.when(near(upper), 2).otherwise(0).alias("side"), F.col("n").alias("sign")),
        F.struct((lower + 0.0).alias("at"), F.when(near(lower), 0).otherwise(2).alias("side"), (-F.col("n")).alias("sign")),
    )
    group = ["instance_id", "key", "i", "metric"]
    marks = ends.select(*group, F.explode(both).alias("e"), F.lit(0).cast("bigint").alias("add")).select(*group, "e.*", "add")
    points = pred.filter("value IS NOT NULL").select(*group, t.alias("at"), F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("sign"), F.col("n").alias("add"))
    order = [*group, "at", "side"]
    lined = points.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order)
    lined = staged(lined.select("instance_id", "sign", "add", F.monotonically_increasing_id().alias("seq")), "near-cells")
    summed = running_sums(lined, [], "seq", {"below": F.col("add")})
    return summed.filter("sign <> 0").select("instance_id", (F.col("sign") * F.col("below")).cast("double").alias("item_tp"))


def _model_cells(side: DataFrame, ready: DataFrame) -> DataFrame:
    cells = side.join(ready.select("instance_id", "cols"), "instance_id").select("instance_id", "key", "copies", "vals", F.posexplode("cols").alias("i", "c"))
    asked = cells.filter(_asks_model(F.col("c"))).select("instance_id", "key", F.col("c.name").alias("column_name"), F.get("vals", F.col("i")).alias("text"), "copies")
    return asked.groupBy("instance_id", "key", "column_name", "text").agg(F.sum("copies").alias("n"))


def _met_by(side: DataFrame, ready: DataFrame, plan: CellPlan, cell_scores: DataFrame | None, wild: DataFrame, target: bool) -> DataFrame:
    """Add columns that are equal for any two rows whose row score can be above zero.

    ``_eq`` hashes all tokens, ``_b1`` and ``_b2`` are ranges of the first two near values (a target is in the neighbouring
    ranges too), ``_link`` is the response the model accepts in its first column.
    """
    spots = [(i, m) for i, m in plan.spots]
    numbers, days = (lambda i, n=n: F.get(n, F.lit(i)) for n in ("numbers", "days"))
    token = {
        "exact_match": lambda i: F.lower(F.get("vals", F.lit(i))),
        "url_match": lambda i: F.array_join(S.url_hosts(F.get("vals", F.lit(i))), "\n"),
        "number_near": lambda i: F.when(numbers(i).isNull(), F.concat(F.lit("="), F.get("vals", F.lit(i)))).otherwise(F.lit("number")),
        "date_near": lambda i: F.when(days(i).isNull(), F.lit("none")).otherwise(F.lit("day")),
    }

    def band(i: int, m: str) -> Column:
        if m == "date_near":
            return F.floor(days(i) / (S.DATE_WINDOW_DAYS + 1)) * 2
        x, c = numbers(i), F.get("criterion", F.lit(i))
        width = -F.log(1 - c) * 1.001
        place = F.floor(F.log(F.abs(x)) / width) * 2 + F.when(x < 0, 1).otherwise(0)
        return F.when(c >= 1, F.lit(0)).when(x == 0, F.lit(1 << 60)).when(c <= 0, F.xxhash64(x + 0.0)).otherwise(place).cast("bigint")

    known = lambda i, m: (days(i) if m == "date_near" else F.nanvl(numbers(i), F.lit(None).cast("double"))).isNotNull()
    ruled = side.join(rules(ready, plan).drop("n_required"), "instance_id").join(wild, "instance_id", "left")
    near = [F.when(has("mask", i, m) & known(i, m) & F.col("_wild").isNull(), band(i, m)) for i, m in spots if m in ("number_near", "date_near")]
    bands = F.filter(F.array(*near), lambda b: b.isNotNull()) if near else F.array().cast("array<bigint>")
    tokens = [F.when(has("mask", i, m), F.coalesce(token[m](i), F.lit("null"))) for i, m in spots]
    ruled = ruled.withColumn("_eq", F.xxhash64(*tokens) if tokens else F.lit(0).cast("bigint")).withColumn("_bands", bands)
    for name, at in (("_b1", 0), ("_b2", 1)):
        own = F.get("_bands", F.lit(at))
        ruled = ruled.withColumn(name, F.coalesce(own, F.lit(0))) if not target else ruled.withColumn(
            name, F.explode(F.when(own.isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.array(own - 2, own, own + 2)))
        )
    ruled = ruled.drop("chain", "mask", "criterion", "key_idx", "_bands", "_wild")
    if cell_scores is None:
        return ruled.withColumn("_link", F.lit(""))
    cols = ready.select("instance_id", F.filter(F.transform("cols", lambda c, i: F.when(_asks_model(c), F.struct(i.alias("i"), c["name"].alias("name")))), lambda a: a.isNotNull()).alias("_asked"))
    ruled = ruled.join(cols.select("instance_id", F.get("_asked", F.lit(0)).alias("_first")), "instance_id")
    text = F.get("vals", F.col("_first.i"))
    if not target:
        return ruled.withColumn("_link", F.when(F.col("_first").isNull(), F.lit("")).otherwise(F.coalesce(text, F.lit("")))).drop("_first")
    free = ruled.filter("_first IS NULL").drop("_first").withColumn("_link", F.lit(""))
    accepted = cell_scores.filter("score > 0").select("instance_id", F.col("column_name").alias("_c"), F.col("target").alias("_t"), F.col("response").alias("_link")).distinct()
    asked = ruled.filter("_first IS NOT NULL").withColumns({"_c": F.col("_first.name"), "_t": text}).drop("_first")
    return free.unionByName(asked.join(accepted, ["instance_id", "_c", "_t"]).drop("_c", "_t"))


def counted_scores(gold: DataFrame, pred: DataFrame, ready: DataFrame, plan: CellPlan, cell_scores: DataFrame | None = None) -> DataFrame:
    """Parts (instance_id, row_tp, item_tp) of the sums over all pairs of rows of equal key, without pairing them.

    Item sums come from how often values occur on each side. For row sums only rows meet whose compared cells have equal
    tokens and lie in neighbouring ranges. Typed cells as of ``with_types``.
    """
    none = F.lit(0.0)
    g, p = (staged(_spots(side, ready, plan), "spots") for side in (gold, pred))
    items = _equal_cells(g, p).unionByName(_near_cells(g, p))
    rows_of = lambda df, n: df.groupBy("instance_id", "key").agg(F.sum("copies").alias(n))
    keys = rows_of(gold, "g").join(rows_of(pred, "p"), ["instance_id", "key"]).join(ready.select("instance_id", F.size("key_idx").alias("k")), "instance_id")
    items = items.unionByName(keys.select("instance_id", (F.col("g") * F.col("p") * F.col("k")).cast("double").alias("item_tp")))
    if cell_scores is not None:
        told = cell_scores.select("instance_id", "column_name", "response", "target", "score")
        left = told.join(_model_cells(gold, ready).select("instance_id", "key", "column_name", F.col("text").alias("target"), F.col("n").alias("g")), ["instance_id", "column_name", "target"])
        both = left.join(_model_cells(pred, ready).select("instance_id", "key", "column_name", F.col("text").alias("response"), F.col("n").alias("p")), ["instance_id", "key", "column_name", "response"])
        items = items.unionByName(both.select("instance_id", (F.col("score") * F.col("g") * F.col("p")).alias("item_tp")))
    endless = F.exists("numbers", lambda x: F.abs(x) == float("inf"))  # such a target is near any number
    wild = gold.filter(endless).select("instance_id").unionByName(pred.filter(endless).select("instance_id")).distinct().withColumn("_wild", F.lit(True))
    met = matched_rows(*(_met_by(side, ready, plan, cell_scores, wild, target) for side, target in ((gold, True), (pred, False))), on=("instance_id", "key", "_eq", "_b1", "_b2", "_link"))
    scored = pair_scores(met, ready, cell_scores, plan)
    rows = scored.select("instance_id", (F.col("row_score") * F.col("weight")).alias("row_tp"), none.alias("item_tp"))
    return rows.unionByName(items.select("instance_id", none.alias("row_tp"), "item_tp"))


def score_tables(
    specs: DataFrame,
    gold_headers: DataFrame,
    gold_rows: DataFrame,
    pred_headers: DataFrame,
    pred_rows: DataFrame,
    header_map: DataFrame | None = None,
    key_map: DataFrame | None = None,
    cell_scores: DataFrame | None = None,
) -> DataFrame:
    """Row and item precision, recall and F1 per instance; failed instances score zero.

    Rows meet in pairs only under keys where one side has few rows. Keys that are crowded on both sides are scored by
    ``counted_scores``, which counts agreeing values instead.
    """
    # read by both row sides, the scoring join and the result: computed once
    status = staged(TM.instance_status(TM.parse_specs(specs), pred_headers, gold_headers, header_map), "instance-status")
    ready = status.filter("error IS NULL")
    plan = cell_plan(ready)
    # one side after the other: what the first has shuffled is gone before the second begins
    (gold, gold_sizes), (pred, pred_sizes) = [staged_side(side, ready, plan) for side in TM.prepare_sides(status, gold_rows, pred_rows, key_map, plan)]
    full = crowded_keys(gold, pred)
    if full is not None:
        counted = counted_scores(*(with_types(within(side, full, "left_semi"), ready, plan) for side in (gold, pred)), ready, plan, cell_scores)
        few = within(gold, full, "left_anti"), within(pred, full, "left_anti")
    else:
        counted, few = None, (gold, pred)
    # a model is asked for texts, and its answers are found by them
    pairs = pair_scores(matched_rows(*(with_types(side, ready, plan, slim=cell_scores is None) for side in few)), ready, cell_scores, plan)
    each = pairs.select("instance_id", (F.col("row_score") * F.col("weight")).alias("row_tp"), (F.col("item_score") * F.col("weight")).alias("item_tp"))
    hits = (each if counted is None else each.unionByName(counted)).groupBy("instance_id").agg(F.sum("row_tp").alias("row_tp"), F.sum("item_tp").alias("item_tp"))
    out = (
        status.select("instance_id", "error", "n_required")
        .join(hits, "instance_id", "left")
        .join(gold_sizes.withColumnRenamed("rows", "gold_rows"), "instance_id", "left")
        .join(pred_sizes.withColumnRenamed("rows", "predicted_rows"), "instance_id", "left")
    )
    return _finish(out)


def _finish(df: DataFrame) -> DataFrame:
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0).cast(t))
    df = df.select(
        "instance_id",
        "error",
        zero("row_tp", "double").alias("row_true_positives"),
        zero("item_tp", "double").alias("item_true_positives"),
        zero("predicted_rows", "bigint").alias("predicted_rows"),
        zero("gold_rows", "bigint").alias("gold_rows"),
        "n_required",
    )
    row_tp, item_tp = F.col("row_true_positives"), F.col("item_true_positives")
    df = df.withColumns(
        {
            "row_precision": S.ratio(row_tp, F.col("predicted_rows")),
            "row_recall": S.ratio(row_tp, F.col("gold_rows")),
            "item_precision": S.ratio(item_tp, F.col("predicted_rows") * F.col("n_required")),
            "item_recall": S.ratio(item_tp, F.col("gold_rows") * F.col("n_required")),
        }
    ).withColumns(
        {
            "row_f1": S.harmonic_mean(F.col("row_precision"), F.col("row_recall"), F1_FLOOR),
            "item_f1": S.harmonic_mean(F.col("item_precision"), F.col("item_recall"), F1_FLOOR),
        }
    )
    perfect = F.lit(True)
    for name in SCORE_NAMES:
        perfect = perfect & (F.col(name) == 1.0)
    return df.withColumns(
        {
            "is_correct": F.col("error").isNull() & perfect,
            "complete_status": F.when(F.col("error").isNull(), F.lit("SUCCESS")).otherwise(F.lit("EXTRACTION_FAILED")),
        }
    )
