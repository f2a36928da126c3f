"""Benchmark preparation, rubrics, file sources and sinks, streaming and caller functions."""

import uuid

from pyspark.sql import functions as F

from trailmark.catalog.base import ORACLES, case
from trailmark.catalog.summary_cases import flat
from trailmark.catalog.trajectory_cases import LOOP
from trailmark.functions import scalars as S
from trailmark.operators import benchmarks as B
from trailmark.operators import callables as CA
from trailmark.operators import judging as J
from trailmark.operators import parsing as P
from trailmark.operators import rubrics as RU
from trailmark.operators import summaries as R
from trailmark.operators import worklist as W
from trailmark.plans.keyed import latest_by
from trailmark.session import checkpoint_folder
from trailmark.sources import readers as IN
from trailmark.sources import writers as OUT
from trailmark.streaming import live as L


def scratch(x, name):
    return f"{checkpoint_folder(x.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def record_digest(df):
    """One row per canonical record with the fields that matter as text."""
    q = F.col("extra_info.question")
    return df.select(
        F.col("extra_info.id").alias("id"), "data_source", F.md5(q).alias("question"), F.md5(F.get("prompt", F.lit(0))["content"]).alias("prompt"),
        F.md5(F.array_join("reward_model.ground_truth", "\n")).alias("truth"), F.col("extra_info.index").alias("idx"),
    )


def qa_lines(x):
    """Raw question lines: some without answer, prompt, split or truth list."""
    q = x.qa
    extra = F.struct(
        F.col("question"), F.when(F.col("idx") % 3 == 0, F.array(F.lit("given"))).alias("answer"), F.when(F.col("idx") % 4 == 0, F.lit("")).alias("split")
    )
    prompt = F.when(F.col("idx") % 5 == 0, F.array(F.struct(F.lit("p").alias("content"), F.lit("system").alias("role"))))
    many = F.to_json(F.struct(F.lit("src").alias("data_source"), extra.alias("extra_info"), prompt.alias("prompt"), F.struct(F.col("ground_truth")).alias("reward_model")))
    one = F.to_json(F.struct(extra.alias("extra_info"), prompt.alias("prompt"), F.struct(F.get("ground_truth", F.lit(0)).alias("ground_truth")).alias("reward_model")))
    return q.select(F.col("idx").alias("position"), F.when(F.col("idx") % 2 == 0, many).otherwise(one).alias("text"))


TRUTH1 = "CASE WHEN idx % 2 = 0 THEN array_to_string(ground_truth, chr(10)) ELSE ground_truth[1] END"


@case(
    "prj1_raw_lines",
    f"""SELECT 'test_' || idx AS id, CASE WHEN idx % 2 = 0 THEN 'src' ELSE '' END AS data_source, md5(question) AS question, md5(CASE WHEN idx % 5 = 0 THEN 'p' ELSE question END) AS prompt, md5({TRUTH1}) AS truth, idx,
     md5(CASE WHEN idx % 3 = 0 THEN 'given' ELSE {TRUTH1} END) AS answer, 'test' AS split, 'rule' AS style FROM fx_qa""",
)
def _(x):
    t = B.from_raw_lines(qa_lines(x), "test", "test")
    extra = t.select(F.col("extra_info.id").alias("id"), F.md5(F.array_join("extra_info.answer", "\n")).alias("answer"), "extra_info.split", "reward_model.style")
    return record_digest(t).join(extra, "id")


def qa_canonical(x):
    q = x.qa
    meta = F.when(F.col("idx") % 3 > 0, F.create_map(F.lit("answer_type"), S.strip("answer_type")))
    return q.select(
        *B.canonical_record(F.lit("browsecomp"), F.col("id"), F.col("idx"), F.col("question"), F.array_join("ground_truth", "\n"), judge_metadata=meta)
    )


@case(
    "prj2_canonical_record",
    """SELECT id, 'browsecomp' AS data_source, md5(question) AS question, md5(question) AS prompt, md5(array_to_string(ground_truth, chr(10))) AS truth, idx FROM fx_qa""",
)
def _(x):
    return record_digest(qa_canonical(x))


@case(
    "src1_question_scan",
    """SELECT id AS question_id, md5(question) AS question, md5(array_to_string(ground_truth, chr(10))) AS truth, 'browsecomp' AS benchmark, CASE WHEN idx % 3 > 0 THEN trim(answer_type, @WS) END AS answer_type, CAST(CASE WHEN idx % 3 > 0 THEN 1 ELSE 0 END AS INTEGER) AS meta FROM fx_qa""",
)
def _(x):
    q = IN.questions(qa_canonical(x))
    return q.select(
        "question_id", F.md5("question").alias("question"), F.md5(F.array_join("ground_truth", "\n")).alias("truth"), "benchmark",
        F.try_element_at("judge_metadata", F.lit("answer_type")).alias("answer_type"), F.size("judge_metadata").alias("meta"),
    )


@case(
    "src4_resolve_benchmark",
    """SELECT id, CASE idx % 5 WHEN 0 THEN NULL WHEN 1 THEN 'deepsearchqa_900' WHEN 2 THEN 'widesearch_200' WHEN 3 THEN 'gaia_text_103' END AS canonical FROM fx_qa""",
)
def _(x):
    return B.resolve_benchmarks(x.qa).select("id", "canonical")


@case("prj3_numeric_ids", "SELECT 'gaia_text_' || CASE WHEN idx < 1000 THEN lpad(CAST(idx AS VARCHAR), 3, '0') ELSE CAST(idx AS VARCHAR) END AS id, 'gaia_text_103' AS data_source, md5(question) AS question, md5(question) AS prompt, md5(language) AS truth, idx FROM fx_qa")
def _(x):
    rows = x.qa.select(F.col("idx").alias("position"), F.col("idx").alias("query_id"), "question", F.col("language").alias("answer"))
    return record_digest(B.from_numeric_ids(rows))


@case("prj4_steps_source", "SELECT 'deepsearch_' || idx AS id, 'xbench_2510' AS data_source, md5(question) AS question, md5(question) AS prompt, md5(language) AS truth, idx, CASE WHEN idx % 2 = 0 THEN domain ELSE '' END AS steps FROM fx_qa")
def _(x):
    rows = x.qa.select(F.col("idx").alias("position"), F.col("idx").alias("id"), "question", F.col("language").alias("answer"), F.when(F.col("idx") % 2 == 0, F.col("domain")).alias("reference_steps"))
    t = B.from_steps(rows)
    return record_digest(t).join(t.select(F.col("extra_info.id").alias("id"), F.col("extra_info.reference_steps").alias("steps")), "id")


@case(
    "prj5_typed_answers",
    """SELECT 'dsqa_' || CASE WHEN idx < 1000 THEN lpad(CAST(idx AS VARCHAR), 3, '0') ELSE CAST(idx AS VARCHAR) END AS id, 'deepsearchqa_900' AS data_source, md5(trim(question, @WS)) AS question, md5(trim(question, @WS)) AS prompt, md5(language) AS truth, idx,
     CASE WHEN trim(question, @WS) = '' OR idx % 41 = 0 THEN 'empty_problem_or_answer' WHEN trim(answer_type, @WS) = 'Other' THEN 'unsupported_answer_type' END AS reject_reason FROM fx_qa""".replace("md5(language) AS truth", "md5(CASE WHEN idx % 41 = 0 THEN '' ELSE language END) AS truth"),
)
def _(x):
    rows = x.qa.select(
        F.col("idx").alias("position"), F.col("question").alias("problem"), F.col("domain").alias("problem_category"),
        F.when(F.col("idx") % 41 == 0, F.lit("  ")).otherwise(F.col("language")).alias("answer"), "answer_type",
    )
    t = B.from_typed_answers(rows)
    return record_digest(t).join(t.select(F.col("extra_info.id").alias("id"), "reject_reason"), "id")


@case(
    "prj6_table_tasks",
    """SELECT 'w' || instance_id AS id, CASE WHEN instance_id % 7 = 5 THEN 'unsupported_language' WHEN instance_id = 14 THEN 'pipeline_differs' WHEN instance_id = 16 THEN 'invalid_config' WHEN instance_id = 17 THEN 'key_not_required' WHEN instance_id = 18 THEN 'not_one_metric' WHEN instance_id = 19 THEN 'gold_columns_missing' END AS reject_reason,
     CASE WHEN instance_id <> 16 THEN 'Reference table with ' || n || ' rows and 6 required columns' END AS answer FROM (SELECT instance_id, count(*) AS n FROM fx_rows WHERE side = 'gold' GROUP BY instance_id) t""",
)
def _(x):
    names = F.array(*[F.lit(n) for n in ("Order Key", "line no", "quantity", "ship date", "flag", "price")])
    gold = x.rows.filter("side = 'gold'").groupBy("instance_id").agg(F.count("*").cast("int").alias("rows"))
    gold = gold.select(
        F.concat(F.lit("w"), "instance_id").alias("instance_id"), F.lit("csv").alias("gold_csv"), "rows",
        F.when(F.col("instance_id") == 19, F.slice(names, 1, 5)).otherwise(names).alias("columns"),
    )
    tasks = x.spec.select(
        F.col("instance_id").alias("position"), F.concat(F.lit("w"), "instance_id").alias("instance_id"), F.lit("build it").alias("query"),
        F.when(F.col("instance_id") % 7 == 5, F.lit("fr")).otherwise(F.lit("en")).alias("language"), "evaluation",
    )
    t = B.from_table_tasks(tasks, gold)
    return t.select(F.col("extra_info.id").alias("id"), "reject_reason", F.get("reward_model.ground_truth", F.lit(0)).alias("answer"))


@case("prj6_language_balance", "SELECT count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'zh') AS zh FROM documents")
def _(x):
    return B.language_balance(x.qa, ("en", "fr", "zh"))


PICK = r"""sel AS (SELECT *, count(*) OVER (PARTITION BY trim(id, @WS)) > 1 AS dup_id, count(*) OVER (PARTITION BY md5(lower(regexp_replace(trim(question, @WS), '\s+', ' ', 'g')))) > 1 AS dup_q FROM fx_selection)"""


@case(
    "flt11_selection_checks",
    f"""WITH {PICK} SELECT id, CASE WHEN trim(question, @WS) = '' THEN 'missing_id_or_question' WHEN dup_id THEN 'duplicate_id' WHEN dup_q THEN 'duplicate_question' WHEN difficulty <> 'hard' OR split <> 'rl_train' THEN 'not_hard_rl_train' END AS reject_reason FROM sel""",
)
def _(x):
    return B.check_selection(x.selection).select("id", "reject_reason")


JOINED = """j AS (SELECT s.id, s.idx, s.domain, s.sub_domain, s.language, q.question, q.ground_truth, CASE WHEN q.id IS NULL THEN 'missing_source' WHEN s.domain <> q.domain THEN 'mismatch_domain'
  WHEN len(list_filter(q.ground_truth, lambda g: trim(g, @WS) = '')) > 0 THEN 'invalid_ground_truth' WHEN q.declared_size <> len(q.ground_truth) THEN 'ground_truth_size' END AS reject_reason FROM fx_selection s LEFT JOIN fx_qa q ON s.id = q.id)"""


def joined(x):
    source = x.qa.withColumnRenamed("declared_size", "ground_truth_size")
    return B.join_selection(x.selection.withColumnRenamed("idx", "position"), source)


@case("jn3_selection_join", f"WITH {JOINED} SELECT id, idx, reject_reason FROM j")
def _(x):
    return joined(x).select("id", F.col("position").alias("idx"), "reject_reason")


@case(
    "prj7_balanced_records",
    f"""WITH {JOINED} SELECT id, 'widesearch_v2_1_hard_720' AS data_source, md5(trim(question, @WS)) AS question, md5(trim(question, @WS)) AS prompt, md5(array_to_string(list_transform(ground_truth, lambda g: trim(g, @WS)), chr(10))) AS truth, idx, domain AS category FROM j WHERE reject_reason IS NULL""",
)
def _(x):
    t = B.from_selection(joined(x))
    return record_digest(t).join(t.select(F.col("extra_info.id").alias("id"), F.col("extra_info.problem_category").alias("category")), "id")


@case(
    "agg10_design_check",
    """WITH g AS (SELECT 'domain' AS grouping, count(*) AS n FROM fx_qa GROUP BY domain UNION ALL SELECT 'subdomain', count(*) FROM fx_qa GROUP BY domain, sub_domain UNION ALL SELECT 'stratum', count(*) FROM fx_qa GROUP BY domain, sub_domain, language
     UNION ALL SELECT 'language', count(*) FROM fx_qa GROUP BY language) SELECT grouping, count(*) AS groups, min(n) AS smallest, max(n) AS largest, grouping = 'domain' AND count(*) = 12 AND min(n) = 84 AND max(n) = 84 AS balanced FROM g GROUP BY grouping""",
)
def _(x):
    return B.design_check(x.qa, {"domain": (12, 84)})


# ---- rubrics ----
def rubric_lines(x):
    d = x.table("documents")
    items = F.array(
        F.struct(F.lit(9).alias("id"), F.col("lang").alias("description")), F.struct(F.lit(None).cast("int").alias("id"), F.col("source").alias("description")), F.struct(F.lit(3).alias("id"), F.lit(None).cast("string").alias("description"))
    )
    qid = F.when(F.col("doc_id") % 7 == 0, F.lit("other")).otherwise(F.concat(F.lit("d_"), "doc_id"))
    some = F.when(F.col("doc_id") % 11 == 0, F.slice(items, 3, 1)).otherwise(items)
    return d.select("doc_id", F.to_json(F.struct(qid.alias("question_id"), some.alias("rubrics"))).alias("text"), qid.alias("qid"), some.alias("items"))


LOADED = """(SELECT 'd_' || doc_id AS question_id, 0 AS pos, '9' AS id, lang AS description FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 UNION ALL SELECT 'd_' || doc_id, 1, '2', source FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0)"""


@case("src14_rubric_lines", f"SELECT question_id, pos, id, description FROM {LOADED} t")
def _(x):
    return RU.exploded(RU.usable(RU.from_lines(rubric_lines(x)), x.qa.select(F.col("id").alias("question_id"))))


@case("src14_rubric_map", f"SELECT question_id, pos, id, description FROM {LOADED} t")
def _(x):
    doc = F.to_json(F.create_map(F.col("qid"), F.struct(F.col("items").alias("rubrics"))))
    return RU.exploded(RU.usable(RU.from_map(rubric_lines(x).select(doc.alias("text"))), x.qa.select(F.col("id").alias("question_id"))))


@case("jn7_rubrics_pending", f"SELECT id FROM fx_qa WHERE id NOT IN (SELECT question_id FROM {LOADED} t)")
def _(x):
    qs = x.qa.select(F.col("id").alias("question_id"))
    return W.without_rubrics(qs, RU.usable(RU.from_lines(rubric_lines(x)), qs)).select(F.col("question_id").alias("id"))


@case("jn8_start_state", f"SELECT id AS question_id, CASE WHEN id IN (SELECT question_id FROM {LOADED} t) THEN 'ANSWER' ELSE 'INITIAL' END AS start_state FROM fx_qa")
def _(x):
    qs = x.qa.select(F.col("id").alias("question_id"))
    return W.with_rubrics(qs, RU.usable(RU.from_lines(rubric_lines(x)), qs)).select("question_id", "start_state")


@case("jn11_rubric_checks", f"SELECT question_id, id, coalesce(l.quality = 1, false) AND id = '9' AS satisfied FROM {LOADED} t LEFT JOIN labels l ON t.question_id = 'd_' || l.doc_id")
def _(x):
    rubrics = RU.exploded(RU.usable(RU.from_lines(rubric_lines(x)), x.qa.select(F.col("id").alias("question_id"))))
    checks = x.table("labels").select(F.concat(F.lit("d_"), "doc_id").alias("question_id"), F.lit("9").alias("id"), (F.col("quality") == 1).alias("satisfied"))
    return RU.with_checks(rubrics, checks).select("question_id", "id", "satisfied")


# ---- sinks ----
@case("snk1_canonical_round_trip", "SELECT id, 'browsecomp' AS data_source, md5(question) AS question, md5(question) AS prompt, md5(array_to_string(ground_truth, chr(10))) AS truth, idx FROM fx_qa")
def _(x):
    path, rows = scratch(x, "canonical") + ".parquet", qa_canonical(x)
    OUT.write_canonical(rows, path, x.table("documents").count())
    return record_digest(IN.read_canonical(x.spark, path))


@case("snk2_review_round_trip", "SELECT line, rollout_idx, question_id, answer, is_correct FROM fx_reviews")
def _(x):
    path, rows = scratch(x, "reviews"), x.reviews
    OUT.write_reviews(rows, path)
    return x.spark.read.schema(rows.schema).json(path).select("line", "rollout_idx", "question_id", "answer", "is_correct")


@case("snk3_segment_round_trip", "SELECT run, seq, md5(content) AS content, CAST(coalesce(sum(CAST(is_seal AS INTEGER)) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM fx_messages")
def _(x):
    from trailmark.operators.trajectories import with_segment

    rows = with_segment(x.messages, F.col("is_seal")).select(F.col("run").alias("question_id"), F.lit("answer_t1_attempt_0").alias("prefix"), "segment", "seq", "content")
    path = scratch(x, "segments")
    OUT.write_segments(rows, path)
    back = x.spark.read.schema(rows.schema).json(path)
    return back.select(F.col("question_id").alias("run"), "seq", F.md5("content").alias("content"), "segment")


@case("snk4_report_json")
def _(x):
    """The report written as JSON text and read back field by field."""
    path = scratch(x, "report")
    OUT.write_report(R.table_report(x.reviews, 200, 3), path)
    counts = ["unique_questions", "missing_questions"]
    rates = ["pass_at_n_success_rate", "max_at_n_row_f1", "max_at_n_item_f1", "avg_at_n_success_rate", "avg_at_n_row_f1", "avg_at_n_item_f1"]
    schema = ", ".join([*[f"{c} bigint" for c in counts], *[f"{r} double" for r in rates]])
    back = x.spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")
    return flat(back)


ORACLES["snk4_report_json"] = ORACLES["agg6_table_report"]  # the same report by another way

LABEL_LINE = "CAST(doc_id AS VARCHAR) || ' ' || coalesce(CAST(quality AS VARCHAR), '-') || ' ' || coalesce(CAST(toxic AS VARCHAR), '-') || chr(10)"


@case(
    "snk5_fingerprints",
    f"""SELECT 'labels-' || CAST(doc_id % 16 AS VARCHAR) AS "table", CAST(sum(length({LABEL_LINE})) AS BIGINT) AS length, sha256(string_agg({LABEL_LINE}, '' ORDER BY doc_id)) AS sha256, count(*) AS rows
    FROM labels GROUP BY doc_id % 16""",
)
def _(x):
    """The labels written as sixteen text files whose bytes are known, fingerprinted where they lie."""
    path = scratch(x, "labels")
    labels = x.table("labels")
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "quality", "toxic")]
    dealt = labels.select((F.col("doc_id") % 16).alias("part"), "doc_id", F.concat_ws(" ", *shown).alias("value"))
    dealt.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    table = F.concat(F.lit("labels-"), F.regexp_extract("path", "part=([0-9]+)", 1))
    files = OUT.fingerprints(x.spark, path).withColumn("table", table)
    rows = labels.groupBy((F.col("doc_id") % 16).alias("part")).agg(F.count("*").alias("rows"))
    return files.join(rows.select(F.concat(F.lit("labels-"), F.col("part").cast("string")).alias("table"), "rows"), "table").select("table", "length", "sha256", "rows")


@case("snk6_rubric_round_trip", "SELECT 'd_' || doc_id AS question_id, doc_id % 29 = 0 AS failed FROM documents")
def _(x):
    parsed = P.parse_rubrics(x.rubrics).withColumn("error", F.when(F.size("rubrics") == 0, F.lit("no rubrics")))
    good, bad = scratch(x, "rubrics"), scratch(x, "rubric-errors")
    OUT.write_rubrics(parsed, good, bad)
    ok = x.spark.read.schema("question_id string").json(good).withColumn("failed", F.lit(False))
    return ok.unionByName(x.spark.read.schema("question_id string").json(bad).withColumn("failed", F.lit(True)))


@case("snk7_rejudge_round_trip", "SELECT doc_id FROM fx_verdicts")
def _(x):
    source = scratch(x, "review") + ".jsonl"
    target = OUT.write_rejudged(x.verdicts.select("doc_id", "reply"), source)
    return x.spark.read.schema("doc_id bigint").json(target)


# ---- streaming ----
def replay(x, fx, by, view):
    """A derived input as a log that grows three times; after each time ``view(stream, root)`` goes on where it stopped."""
    path, root = scratch(x, "log"), scratch(x, "stream")
    df = getattr(x, fx)
    low, high = df.agg(F.min(by), F.max(by)).first()
    cuts = [low + (high + 1 - low) * i // 3 for i in range(4)]
    for start, end in zip(cuts, cuts[1:]):
        df.filter((F.col(by) >= start) & (F.col(by) < end)).write.mode("append").parquet(path)
        result = view(L.read_log_stream(x.spark, path, df.schema, "parquet"), root)
    return result


@case("str1_incremental_read", "SELECT line, question_id, rollout_idx FROM fx_reviews")
def _(x):
    return replay(x, "reviews", "line", lambda stream, root: L.collected(stream, root, "rows")).select("line", "question_id", "rollout_idx")


REVIEW_RECALL = "round(sum(coalesce(CASE WHEN isnan(f) THEN NULL ELSE f END, 0)), 6) AS recall"
WITH_RECALL = "SELECT *, try_cast(json_extract_string(judge_metrics, '$.recall') AS DOUBLE) AS f FROM"


@case("str2_live_accuracy", f"SELECT rollout_idx, count(*) AS judged, count(*) FILTER (is_correct = 'true') AS correct, {REVIEW_RECALL} FROM ({WITH_RECALL} fx_reviews) t GROUP BY rollout_idx")
def _(x):
    return flat(replay(x, "reviews", "line", lambda stream, root: L.keep_final(L.live_accuracy(stream, ["recall"]), root, ["rollout_idx"], 4)))


@case("str3_resume", "SELECT line FROM fx_reviews WHERE (question_id, rollout_idx) NOT IN (SELECT question_id, rollout_idx FROM fx_reviews WHERE is_correct = 'true' AND answer IS NULL AND question_id <> '')")
def _(x):
    finished = W.completed_pairs(x.reviews.filter("is_correct = 'true' AND answer IS NULL"))
    return replay(x, "reviews", "line", lambda stream, root: L.skip_finished(stream, finished, root, ["question_id", "rollout_idx"])).select("line")


@case(
    "str3_reseeded_counters",
    f"""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, rollout_idx ORDER BY line DESC) AS rn FROM fx_reviews WHERE answer IS NULL AND question_id <> '') t WHERE rn = 1),
    r AS ({WITH_RECALL} (SELECT * EXCLUDE (rn) FROM d UNION ALL SELECT * FROM fx_reviews WHERE (question_id, rollout_idx) NOT IN (SELECT question_id, rollout_idx FROM d)) u)
    SELECT rollout_idx, count(*) AS judged, count(*) FILTER (is_correct = 'true') AS correct, {REVIEW_RECALL} FROM r GROUP BY rollout_idx""",
)
def _(x):
    finished = latest_by(x.reviews.filter("answer IS NULL AND question_id <> ''"), ["question_id", "rollout_idx"], ["line"])
    return flat(replay(x, "reviews", "line", lambda stream, root: L.resumed_accuracy(stream, finished, root, ["recall"], buckets=4)))


@case("str4_latest_stream", "SELECT line, rollout_idx, question_id FROM (SELECT *, row_number() OVER (PARTITION BY rollout_idx, question_id ORDER BY file_rank DESC, line DESC) AS rn FROM fx_reviews) t WHERE rn = 1")
def _(x):
    view = lambda stream, root: L.latest_records(stream, root, ["rollout_idx", "question_id"], ["file_rank", "line"], buckets=8)
    return replay(x, "reviews", "line", view).select("line", "rollout_idx", "question_id")


@case(
    "str4_retractions",
    """WITH e AS (SELECT *, coalesce(answer = '   ', FALSE) OR line % 4 = 0 AS back FROM fx_reviews),
    s AS (SELECT *, sum(CASE WHEN back THEN -1 ELSE 1 END) OVER (PARTITION BY rollout_idx, question_id ORDER BY line) AS level FROM e),
    m AS (SELECT *, min(level) OVER (PARTITION BY rollout_idx, question_id ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM s)
    SELECT rollout_idx, question_id, max(line) AS line FROM m WHERE NOT back AND level <= low GROUP BY rollout_idx, question_id""",
)
def _(x):
    back = F.coalesce(F.col("answer") == "   ", F.lit(False)) | (F.col("line") % 4 == 0)
    view = lambda stream, root: L.latest_records(stream, root, ["rollout_idx", "question_id"], ["line"], retracts=back, buckets=8)
    return replay(x, "reviews", "line", view).select("rollout_idx", "question_id", "line")


@case("str5_loop_guard", f"WITH {LOOP} SELECT run, seq, segment, cycle FROM c")
def _(x):
    return replay(x, "tool_calls", "turn", L.loop_guard)


@case(
    "str6_count_windows",
    """SELECT metric_name, CAST(floor((rn - 1) / 200) AS BIGINT) AS window_idx, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, count(*) AS samples
    FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY seq) AS rn FROM fx_metrics) t GROUP BY ALL HAVING count(*) = 200""",
)
def _(x):
    return flat(replay(x, "metrics", "seq", L.count_windows))


@case("str7_live_units", "SELECT question_id, rollout_idx, metric_name, metric_type, count(*) AS samples, round(sum(value), 6) AS total, min(value) AS min, max(value) AS max FROM fx_metrics GROUP BY question_id, rollout_idx, metric_name, metric_type")
def _(x):
    unit = ["question_id", "rollout_idx", "metric_name", "metric_type"]
    return flat(replay(x, "metrics", "seq", lambda stream, root: L.keep_final(L.live_units(stream), root, unit, 8)))


# ---- caller functions ----
@case("udf1_callable", "SELECT page_id, CASE WHEN contains(url, 'example.org') THEN NULL ELSE upper(lang) END AS output, CAST(CASE WHEN contains(url, 'example.org') THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN contains(url, 'example.org') THEN 'ValueError: blocked' END AS error FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS lang FROM pages) t")
def _(x):
    # a local function travels to the workers by value, so they need not have this package
    def shout(question, url):
        if "example.org" in url:
            raise ValueError("blocked")
        return question.upper()

    req = x.table("pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("question"))
    return CA.call_function(req, shout, ["question", "url"], 2).select("page_id", "output", "attempts", "error")


@case(
    "udf3_reask",
    """SELECT line, event_type = 'purchase' AS is_correct, CASE WHEN event_type = 'view' THEN 'EXTRACTION_FAILED' ELSE 'SUCCESS' END AS status, CAST(CASE WHEN event_type = 'view' THEN 3 ELSE 1 END AS INTEGER) AS attempts FROM (SELECT event_id AS line, event_type FROM events) t""",
)
def _(x):
    def verdict_of(request):
        return "correct: yes" if "purchase" in request else "no idea" if "view" in request else "correct: no"

    req = x.reviews.select("line", F.concat(F.lit("judge "), "truth").alias("request"))
    asked = CA.ask_until_parseable(req, verdict_of, lambda r: r.startswith("correct:"), 3)
    return asked.withColumn("v", J.labelled_verdict(F.col("reply"))).select("line", "v.is_correct", "v.status", "attempts")


@case("udf4_token_estimator", "SELECT run, CAST(floor(sum(length(content) + coalesce(length(reasoning), 0)) / 4) AS BIGINT) AS tokens FROM fx_messages GROUP BY run")
def _(x):
    # characters of all messages of a run, floored once; any aggregate over a character count fits here
    return x.messages.groupBy("run").agg(S.token_total(F.col("content"), F.col("reasoning")).alias("tokens"))
