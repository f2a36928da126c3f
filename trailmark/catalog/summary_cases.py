"""Review roll-ups, metrics and work-list queries."""

from pyspark.sql import functions as F

from trailmark.catalog.base import case, r6
from trailmark.functions import variants as V
from trailmark.operators import metrics as M
from trailmark.operators import summaries as R
from trailmark.operators import worklist as W
from trailmark.sources import readers as IN


def fin(name: str) -> str:
    t = f"try_cast(trim(json_extract_string(judge_metrics, '$.{name}'), @WS) AS DOUBLE)"
    return f"CASE WHEN json_type(judge_metrics, '$.{name}') = 'BOOLEAN' OR isnan({t}) OR isinf({t}) THEN NULL ELSE {t} END"


ALL = R.COMPONENT_METRICS + R.TABLE_METRICS
LATEST = f"""latest AS (SELECT rollout_idx, question_id, coalesce(trim(answer, @WS), '') = '' AS empty_answer, judge_complete_status = 'SUCCESS' AS judged,
  coalesce(is_correct = 'true', false) AS correct, nullif(trim(json_extract_string(judge_metrics, '$.judge_model'), @WS), '') AS judge_model, {', '.join(fin(m) + ' AS ' + m for m in ALL)}
 FROM (SELECT *, row_number() OVER (PARTITION BY rollout_idx, question_id ORDER BY file_rank DESC, line DESC) AS rn FROM fx_reviews WHERE question_id <> '') t WHERE rn = 1)"""


def macro_sql(metrics, prefix, exact, rate):
    valid = "(judged AND " + " AND ".join(f"{m} IS NOT NULL" for m in metrics) + ")"
    out = [
        "count(*) AS records", f"count(*) FILTER ({valid}) AS successful_judgments", f"count(*) FILTER (NOT {valid}) AS invalid_judgments",
        "count(*) FILTER (empty_answer) AS empty_model_responses", f"count(*) FILTER ({valid} AND correct) AS {exact}",
        f"round(count(*) FILTER ({valid} AND correct) / count(*), 6) AS {rate}",
    ]
    out += [f"round(coalesce(sum({m}) FILTER ({valid}), 0) / count(*), 6) AS {prefix}{m}" for m in metrics]
    out += [f"round(coalesce(sum({m}) FILTER ({valid}) / nullif(count(*) FILTER ({valid}), 0), 0), 6) AS valid_only_{prefix}{m}" for m in metrics]
    return ", ".join(out)


def flat(df):
    """Doubles rounded and arrays joined, so both engines print the same values."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append(r6(name).alias(name))
        elif kind == "array<string>":
            out.append(F.array_join(name, "|").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


COMP = macro_sql(R.COMPONENT_METRICS, "macro_", "exact_correct", "all_correct_rate")
TAB = macro_sql(R.TABLE_METRICS, "", "exact_successes", "success_rate")
MODELS = "coalesce(array_to_string(list_sort(list_distinct(list(judge_model) FILTER (judge_model IS NOT NULL))), '|'), '') AS judge_models"


@case("win1_latest_record", f"WITH {LATEST} SELECT rollout_idx, question_id, correct, round(f1, 6) AS f1, judge_model FROM latest")
def _(x):
    return R.latest_scored(x.reviews, ["f1"]).select("rollout_idx", "question_id", "correct", r6("f1").alias("f1"), "judge_model")


@case("agg2_macro_summary", f"WITH {LATEST} SELECT {COMP}, {MODELS} FROM latest")
def _(x):
    return flat(R.component_summary(R.latest_scored(x.reviews, R.COMPONENT_METRICS)).filter("rollout_idx IS NULL").drop("rollout_idx"))


@case("agg3_rollout_summary", f"WITH {LATEST} SELECT rollout_idx, {COMP}, {MODELS} FROM latest GROUP BY ROLLUP (rollout_idx)")
def _(x):
    return flat(R.component_summary(R.latest_scored(x.reviews, R.COMPONENT_METRICS)))


@case(
    "agg4_coverage",
    f"""WITH {LATEST} SELECT rollout_idx, count(*) AS records, CAST(CASE WHEN rollout_idx IS NULL THEN 600 ELSE 200 END AS BIGINT) AS expected_records,
    CAST(greatest(CASE WHEN rollout_idx IS NULL THEN 600 ELSE 200 END - count(*), 0) AS BIGINT) AS missing_records,
    round(least(count(*) / CASE WHEN rollout_idx IS NULL THEN 600.0 ELSE 200.0 END, 1.0), 6)::DOUBLE AS coverage FROM latest GROUP BY ROLLUP (rollout_idx)""",
)
def _(x):
    s = R.with_coverage(R.component_summary(R.latest_scored(x.reviews, R.COMPONENT_METRICS)), 200, 3)
    return flat(s.select("rollout_idx", "records", "expected_records", "missing_records", "coverage"))


@case("agg5_table_summary", f"WITH {LATEST} SELECT rollout_idx, {TAB}, {MODELS} FROM latest GROUP BY ROLLUP (rollout_idx)")
def _(x):
    return flat(R.table_summary(R.latest_scored(x.reviews, R.TABLE_METRICS)))


BEST = f"""WITH {LATEST}, q AS (SELECT question_id, bool_or(correct) AS passed, max(coalesce(row_f1, 0)) AS row_f1, max(coalesce(item_f1, 0)) AS item_f1 FROM latest GROUP BY question_id)
 SELECT count(*) AS unique_questions, CAST(greatest(200 - count(*), 0) AS BIGINT) AS missing_questions, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_at_n_success_rate,
 round(avg(q.row_f1), 6) AS max_at_n_row_f1, round(avg(q.item_f1), 6) AS max_at_n_item_f1"""


@case("agg6_best_of_n", BEST + " FROM q")
def _(x):
    return flat(R.best_of_n(R.latest_scored(x.reviews, R.TABLE_METRICS), 200))


@case("agg6_table_report", BEST + f""", any_value(t.success_rate) AS avg_at_n_success_rate, any_value(t.row_f1) AS avg_at_n_row_f1, any_value(t.item_f1) AS avg_at_n_item_f1
 FROM q CROSS JOIN (SELECT {TAB} FROM latest) t""")
def _(x):
    names = ["unique_questions", "missing_questions", "pass_at_n_success_rate", "max_at_n_row_f1", "max_at_n_item_f1",
             "avg_at_n_success_rate", "avg_at_n_row_f1", "avg_at_n_item_f1"]
    return flat(R.table_report(x.reviews, 200, 3).select(*names))


@case("agg7_question_counts", f"WITH {LATEST} SELECT count(DISTINCT question_id) AS unique_questions, CAST(greatest(175 - count(DISTINCT question_id), 0) AS BIGINT) AS missing_questions FROM latest")
def _(x):
    return R.best_of_n(R.latest_scored(x.reviews, R.TABLE_METRICS), 175).select("unique_questions", "missing_questions")


@case("agg8_judge_models", f"WITH {LATEST} SELECT judge_model, count(*) AS records FROM latest WHERE judge_model IS NOT NULL GROUP BY judge_model")
def _(x):
    return R.judge_model_usage(R.latest_scored(x.reviews, ["f1"]))


REASON = """CASE WHEN trim(question_id, @WS) = '' THEN 'skip_missing_question_id' WHEN coalesce(is_correct, 'false') NOT IN ('true', '"true"') THEN 'skip_incorrect'
 WHEN turns IS NULL THEN 'skip_missing_num_turns' WHEN turns < 20 THEN 'skip_below_min_num_turns' ELSE 'selected_rows' END"""
TURNS = """(SELECT *, CASE WHEN num_turns = 'true' THEN 1 WHEN num_turns LIKE '"%' THEN try_cast(trim(json_extract_string(num_turns, '$'), @WS) AS BIGINT)
    ELSE CAST(trunc(CAST(num_turns AS DOUBLE)) AS BIGINT) END AS turns FROM fx_reviews) t"""


@case("flt1_difficulty_filter", f"SELECT line, {REASON} AS reason FROM {TURNS}")
def _(x):
    return W.with_difficulty(x.reviews, 20, True).select("line", "reason")


@case("agg9_reason_histogram", f"SELECT {REASON} AS reason, count(*) AS rows, count(DISTINCT question_id) AS question_ids FROM {TURNS} GROUP BY 1")
def _(x):
    return W.reason_histogram(x.reviews, 20, True)


LIVE = """count(*) FILTER (is_correct = 'true') AS correct, count(*) FILTER (coalesce(is_correct, '') <> 'true') AS incorrect, round(count(*) FILTER (is_correct = 'true') / count(*), 6) AS accuracy,
 round(count(*) FILTER (is_correct = 'true') / 11000, 6) AS accuracy_all, """ + ", ".join(
    f"round(sum(coalesce({fin(m)}, 0)) / count(*), 6) AS {m}, round(sum(coalesce({fin(m)}, 0)) / 11000, 6) AS {m}_all" for m in R.COMPONENT_METRICS
) + ", CAST(sum(tokens) AS BIGINT) AS tokens"


@case("agg15_live_counters", f"SELECT {LIVE} FROM fx_reviews")
def _(x):
    return flat(R.live_counters(x.reviews, 11000))


@case("agg16_seeded_counters", f"SELECT {LIVE} FROM (SELECT *, row_number() OVER (PARTITION BY rollout_idx, question_id ORDER BY file_rank DESC, line DESC) AS rn FROM fx_reviews) t WHERE rn = 1")
def _(x):
    return flat(R.live_counters(R.seed_records(x.reviews), 11000))


@case(
    "agg21_subset_calibration",
    f"""WITH {LATEST}, p AS (SELECT rollout_idx, CAST(correct AS INTEGER) AS hit, CAST('0x' || substr(md5(question_id || 's1'), 1, 15) AS BIGINT) AS pos FROM latest),
    r AS (SELECT rollout_idx, count(*) OVER w AS subset_size, sum(hit) OVER w AS hits, avg(hit) OVER (PARTITION BY rollout_idx) AS full_accuracy FROM p
      WINDOW w AS (PARTITION BY rollout_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT subset_size, count(*) AS runs, round(max(abs(hits / subset_size - full_accuracy)), 6) AS worst_deviation FROM r GROUP BY subset_size""",
)
def _(x):
    latest = R.latest_scored(x.reviews, ["f1"]).select(F.col("rollout_idx").alias("run"), "question_id", "correct")
    return flat(R.subset_calibration(latest, "s1"))


@case(
    "win2_retract_latest",
    """SELECT line, rollout_idx, question_id FROM (SELECT *, row_number() OVER (PARTITION BY rollout_idx, question_id ORDER BY file_rank DESC, line DESC) AS rn FROM fx_reviews) t WHERE NOT (rn = 1 AND question_id LIKE 'q_%')""",
)
def _(x):
    named = F.when(F.col("question_id").startswith("q_"), F.col("question_id"))
    return R.drop_latest_of(x.reviews.filter("question_id IS NOT NULL"), named).select("line", "rollout_idx", "question_id")


@case("win2_drop_last_line", "SELECT line, rollout_idx, file_rank FROM (SELECT *, max(line) OVER (PARTITION BY rollout_idx, file_rank) AS last FROM fx_reviews) t WHERE line <> last")
def _(x):
    return R.drop_last_line(x.reviews).select("line", "rollout_idx", "file_rank")


# ---- log line scans ----
@case("src8_tolerant_lines", "SELECT line, json_extract_string(text, '$.question_id') AS question_id FROM fx_lines WHERE trim(text, @WS) <> '' AND json_valid(text)")
def _(x):
    return IN.tolerant_records(x.lines).select("line", V.text_at("record", "$.question_id").alias("question_id"))


@case(
    "src9_counting_lines",
    """SELECT rollout_idx, count(*) FILTER (NOT b) AS lines, count(*) FILTER (NOT b AND g) AS records, count(*) FILTER (NOT b AND NOT g) AS malformed_review_lines
     FROM (SELECT rollout_idx, trim(text, @WS) = '' AS b, coalesce(json_valid(text) AND CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' AND trim(json_extract_string(text, '$.question_id'), @WS) <> '' END, false) AS g FROM fx_lines) t GROUP BY rollout_idx""",
)
def _(x):
    return R.line_quality(x.lines)


GOODLINE = "(SELECT * FROM fx_lines WHERE json_valid(text)) j WHERE json_type(text) = 'OBJECT' AND trim(json_extract_string(text, '$.question_id'), @WS) <> ''"


@case(
    "set1_union_of_logs",
    f"""SELECT rollout_idx, question_id, line FROM (SELECT rollout_idx, json_extract_string(text, '$.question_id') AS question_id, line,
    row_number() OVER (PARTITION BY rollout_idx, json_extract_string(text, '$.question_id') ORDER BY file_rank DESC, line DESC) AS rn FROM {GOODLINE}) t WHERE rn = 1""",
)
def _(x):
    new, legacy = x.lines.filter("file_rank = 0"), x.lines.filter("file_rank = 1")
    both = IN.union_logs(new.drop("file_rank"), legacy.drop("file_rank"))
    return R.latest_reviews(R.reviews_from_lines(both)).select("rollout_idx", "question_id", "line")


# ---- metrics ----
UNIT = """unit AS (SELECT *, CASE WHEN metric_type IN ('INT', 'FLOAT') THEN total ELSE total / samples END AS value FROM
 (SELECT question_id, rollout_idx, metric_name, metric_type, count(*) AS samples, sum(m.value) AS total, min(m.value) AS min, max(m.value) AS max
 FROM fx_metrics m GROUP BY question_id, rollout_idx, metric_name, metric_type) g)"""


@case("agg11_metric_units", f"WITH {UNIT} SELECT question_id, rollout_idx, metric_name, metric_type, samples, round(total, 6) AS total, min, max, round(value, 6) AS value FROM unit")
def _(x):
    return flat(M.unit_values(x.metrics))


@case("agg11_type_conflicts", "SELECT metric_name, array_to_string(list_sort(list_distinct(list(metric_type))), '|') AS types FROM (SELECT *  REPLACE (CASE WHEN metric_name IN ('tokens', 'latency') THEN 'cost' ELSE metric_name END AS metric_name) FROM fx_metrics) t GROUP BY 1 HAVING count(DISTINCT metric_type) > 1")
def _(x):
    renamed = F.when(F.col("metric_name").isin("tokens", "latency"), F.lit("cost")).otherwise(F.col("metric_name"))
    return flat(M.type_conflicts(x.metrics.withColumn("metric_name", renamed)))


QVAL = ", q AS (SELECT question_id, metric_name, metric_type, avg(unit.value) AS value, count(*) AS units FROM unit GROUP BY question_id, metric_name, metric_type)"


@case("agg12_metric_report", f"WITH {UNIT}{QVAL} SELECT metric_name, metric_type, round(avg(value), 6) AS global_mean, count(*) AS num_questions, CAST(sum(units) AS BIGINT) AS num_units FROM q GROUP BY ALL")
def _(x):
    return flat(M.report(x.metrics))


@case("agg12_question_view", f"WITH {UNIT}{QVAL} SELECT question_id, count(*) AS metrics, CAST(sum(units) AS BIGINT) AS unit_values, round(sum(value), 6) AS mean_total FROM q GROUP BY question_id")
def _(x):
    v = M.question_view(x.metrics)
    inner = F.aggregate(F.map_values("rollouts"), F.lit(0), lambda a, m: a + F.size(m))
    total = F.aggregate(F.map_values("means"), F.lit(0.0), lambda a, m: a + m)
    return flat(v.select("question_id", F.size("means").cast("bigint").alias("metrics"), inner.cast("bigint").alias("unit_values"), total.alias("mean_total")))


@case(
    "agg13_tool_metrics",
    """WITH s AS (SELECT run, CAST(call_id % 3 AS INT) AS rollout_idx, name, ok, duration_ms FROM fx_tool_calls),
    u AS (SELECT run, rollout_idx, name, CAST(count(*) AS DOUBLE) AS calls, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS errors, avg(duration_ms) AS latency FROM s GROUP BY ALL),
    q AS (SELECT run, name, avg(calls) AS calls, avg(errors) AS errors, avg(latency) AS latency, count(*) AS units FROM u GROUP BY ALL)
    SELECT 'tool_calls.' || name AS metric_name, round(avg(calls), 6) AS global_mean, count(*) AS num_questions, CAST(sum(units) AS BIGINT) AS num_units FROM q GROUP BY name
    UNION ALL SELECT 'tool_error_rate.' || name, round(avg(errors), 6), count(*), CAST(sum(units) AS BIGINT) FROM q GROUP BY name
    UNION ALL SELECT 'tool_latency_ms.' || name, round(avg(latency), 6), count(*), CAST(sum(units) AS BIGINT) FROM q GROUP BY name""",
)
def _(x):
    calls = x.tool_calls.select(F.col("run").alias("question_id"), (F.col("call_id") % 3).cast("int").alias("rollout_idx"), "name", "ok", "duration_ms")
    return flat(M.report(M.tool_samples(calls)).drop("metric_type"))


@case(
    "win9_count_windows",
    """SELECT metric_name, CAST(floor((rn - 1) / 200) AS BIGINT) AS window_idx, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(*) AS samples
    FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY seq) AS rn FROM fx_metrics) t GROUP BY ALL HAVING count(*) = 200""",
)
def _(x):
    return flat(M.count_windows(x.metrics))


# ---- work list ----
DONE = "(SELECT DISTINCT question_id FROM fx_reviews WHERE is_correct = 'true' AND question_id <> '')"


def done_ids(x):
    return W.selected_ids(x.reviews.filter("is_correct = 'true'"), -1).select("question_id")


def users(x):
    """One question per customer; its id matches the review log for customers that appear there."""
    return x.table("customer").select(F.concat(F.lit("q_"), F.col("c_custkey")).alias("question_id"), F.col("c_custkey").alias("position"), "c_mktsegment")


USERS = "(SELECT 'q_' || CAST(c_custkey AS STRING) AS question_id, c_custkey AS position, c_mktsegment FROM customer)"


@case("jn1_question_subset", f"SELECT question_id, c_mktsegment FROM {USERS} u WHERE question_id IN (SELECT question_id FROM fx_reviews WHERE coalesce(is_correct, '') = 'true' AND num_turns IS NOT NULL AND num_turns <> '\"\"')")
def _(x):
    return W.questions_in(users(x), done_ids(x)).select("question_id", "c_mktsegment")


@case("jn1_first_of_subset", f"SELECT question_id, position FROM {USERS} u WHERE question_id IN (SELECT question_id FROM fx_reviews) ORDER BY position LIMIT 20")
def _(x):
    return W.questions_in(users(x), x.reviews.select("question_id"), 20).select("question_id", "position")


@case("jn2_positional_subset", "SELECT doc_id, 'test_' || CAST(doc_id AS STRING) AS question_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(x):
    ids = x.table("labels").filter("quality = 1").select(F.concat(F.lit("test_"), F.col("doc_id")).alias("question_id"))
    rows = IN.with_position(x.spark, x.path("documents")).select("doc_id", "position")
    return W.positional_subset(rows, ids).select("doc_id", "question_id")


@case("jn4_work_items", "SELECT id, CAST(r AS INTEGER) AS rollout_idx FROM fx_qa CROSS JOIN range(3) t(r)")
def _(x):
    return W.work_items(x.qa.select("id"), 3)


@case("jn5_pending", f"SELECT question_id, CAST(r AS INTEGER) AS rollout_idx FROM {USERS} u CROSS JOIN range(3) t(r) WHERE (question_id, r) NOT IN (SELECT question_id, rollout_idx FROM fx_reviews WHERE question_id <> '')")
def _(x):
    return W.pending(W.work_items(users(x).select("question_id"), 3), W.completed_pairs(x.reviews))


@case("jn5_partial_output", "SELECT DISTINCT regexp_extract(path, 'question_([^/]*)/', 1) AS question_id, CAST(regexp_extract(path, 'rollout_([0-9]+)/', 1) AS INTEGER) AS rollout_idx FROM fx_paths WHERE (question_id, rollout_idx) NOT IN (SELECT question_id, rollout_idx FROM fx_reviews WHERE is_correct = 'true' AND answer IS NULL)")
def _(x):
    seen = IN.segment_keys(x.paths, "path")
    return W.partial_output(seen, W.completed_pairs(x.reviews.filter("is_correct = 'true' AND answer IS NULL")))


@case("jn6_rejudge_pending", "SELECT line FROM fx_reviews WHERE question_id || '|' || coalesce(answer, 'None') NOT IN (SELECT question_id || '|' || coalesce(answer, 'None') FROM fx_reviews WHERE is_correct = 'true' AND rollout_idx = 0)")
def _(x):
    return W.rejudge_pending(x.reviews, x.reviews.filter("is_correct = 'true' AND rollout_idx = 0")).select("line")


@case("srt1_limit", "SELECT line, question_id FROM fx_reviews ORDER BY line LIMIT 100")
def _(x):
    return x.reviews.select("line", "question_id").orderBy("line").limit(100)


@case("srt2_seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS STRING) || 'seed'), doc_id) - 1 AS position FROM documents")
def _(x):
    out = W.with_shuffle_key(x.table("documents").select("doc_id"), F.col("doc_id"), "seed")
    return IN.number_rows(out, ["shuffle_key", "doc_id"]).select("doc_id", "position")


@case("srt3_row_position", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents")
def _(x):
    return IN.with_position(x.spark, x.path("documents")).select("doc_id", "position")


@case("set2_missing_ids", "SELECT DISTINCT id FROM fx_selection WHERE id NOT IN (SELECT id FROM fx_qa)")
def _(x):
    return W.missing_ids(x.selection, x.qa.select("id"), "id")
