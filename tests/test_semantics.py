"""Edge cases that differ from the obvious reading."""

import pytest
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.functions import variants as V
from trailmark.operators import judging as J
from trailmark.operators import metrics as M
from trailmark.operators import parsing as P
from trailmark.operators import search as Q
from trailmark.operators import summaries as R
from trailmark.operators import tablematch as TM
from trailmark.operators import tablescore as TS
from trailmark.operators import trajectories as T
from trailmark.operators import worklist as W
from trailmark.operators.memory import lookup, natural_key


def one(spark, expr, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], names).select(expr.alias("r")).first().r


def text(spark, fn, value):
    return one(spark, fn(F.col("t")), t=("string", value))


@pytest.mark.parametrize(
    "value, want",
    [("2024年1月5日", "2024-01-05"), ("2024年3月", "2024-03-01"), ("March 5", "2000-03-05"), ("5 Mar 2021", "2021-03-05"), ("2019", "2019-01-01"),
     (" 2024/1/5 ", "2024-01-05"), ("soon", "soon"), ("2024-13-40", "2024-13-40")],
)
def test_dates(spark, value, want):
    assert text(spark, S.norm_date, value) == want


@pytest.mark.parametrize("value, want", [("1,234.5 km", "1234.5"), ("-7%", "-7%"), ("none", "NULL"), (".5", ".5")])
def test_first_number(spark, value, want):
    assert text(spark, S.extract_number, value) == want


@pytest.mark.parametrize(
    "r, t, want", [("10%", "0.1", 1.0), ("101", "100", 1.0), ("102", "100", 0.0), ("x", "x", 1.0), ("x", "y", 0.0), ("x", "1", 0.0), ("nan", "nan", 0.0), ("12d", "12d", 1.0)]
)
def test_number_near(spark, r, t, want):
    assert one(spark, S.number_near(F.col("r"), F.col("t"), F.lit(0.01)), r=("string", r), t=("string", t)) == want


def test_date_near_and_url_match(spark):
    near = lambda a, b: one(spark, S.date_near(F.col("r"), F.col("t")), r=("string", a), t=("string", b))
    assert near("2024-01-31", "2024-03-02") == 1.0
    assert near("2024-01-31", "2024-03-03") == 0.0
    assert near("?", "!") == 1.0 and near("?", "2024-01-01") == 0.0
    url = lambda a, b: one(spark, S.url_match(F.col("r"), F.col("t")), r=("string", a), t=("string", b))
    assert url("no link", "none") == 1.0
    assert url("see https://a.org/x and http://b.org", "http://b.org/1 https://a.org") == 1.0
    assert url("https://a.org", "https://b.org") == 0.0


@pytest.mark.parametrize("js, want", [("true", None), ('"NaN"', None), ('" 1.5 "', 1.5), ("2", 2.0), ("1e999", None), ('"12d"', None), ("null", None)])
def test_finite_metric(spark, js, want):
    assert text(spark, lambda c: V.finite_number(F.try_parse_json(c)), js) == want


@pytest.mark.parametrize("js, want", [("true", 1), ("3.9", 3), ("-3.9", -3), ('" 7 "', 7), ('"7.5"', None), ("null", None), ('""', None)])
def test_loose_int(spark, js, want):
    assert text(spark, lambda c: V.loose_int(F.try_parse_json(c)), js) == want


def test_strict_truth(spark):
    strict = lambda js: text(spark, lambda c: V.strictly_true(F.try_parse_json(c)), js)
    assert strict("true") and not strict('"true"') and not strict("1")


def answers(spark, content, reasoning=None, benchmark="browsecomp", strict=False):
    df = spark.createDataFrame([(content, reasoning, benchmark)], "content string, reasoning string, benchmark string")
    return P.parse_answers(df, strict).first().parsed_answer


def test_answers(spark):
    assert answers(spark, "<think>a</think> **Answer:** 42\nmore") == "42\nmore"
    assert answers(spark, "<think>plain</think>") == "<think>plain" and answers(spark, "<think>Answer: 1</think>") == "1"
    assert answers(spark, "<think>Answer: 1</think>", strict=True) is None
    assert answers(spark, "", "Answer: 9") == "9" and answers(spark, "", "Answer: 9", strict=True) is None
    assert answers(spark, "The Answer is Rome. It is old") == "Rome"
    assert answers(spark, "answer: Rome") == "Rome"
    assert answers(spark, "just text") == "just text" and answers(spark, "just text", strict=True) is None
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    assert answers(spark, table + "\nAnswer: see the table above.", benchmark="widesearch_200") == table
    assert answers(spark, "Answer: see table above", benchmark="widesearch_200") is None
    assert answers(spark, "Answer: see table above") == "see table above"


def test_verdicts(spark):
    v = lambda fn, t: text(spark, lambda c: fn(c), t)
    r = v(J.decision_verdict, '{"reasoning": "ok", "decision": true}')
    assert r.is_correct and r.score == 0.0
    assert v(J.decision_verdict, '{"reasoning": "a "b" c", "decision": true}').reasoning == 'a "b" c'
    assert v(J.decision_verdict, '{"reasoning": "no decision"}').status == "EXTRACTION_FAILED"
    assert v(J.labelled_verdict, "reasoning: a\nCORRECT: Yes\n").score == 1.0
    assert v(J.labelled_verdict, "is it correct: yes?").status == "EXTRACTION_FAILED"
    assert v(J.zh_verdict, "解释：好\n结论: 正确").reasoning == "好"


def test_component_scores(spark):
    body = '{"Answer Correctness": {"Explanation": "e", "Correctness Details": %s, "Excessive Answers": %s}}'
    rows = [(1, body % ('{"a": true, "b": false}', '["x"]')), (2, body % ("{}", '["x", "y"]')), (3, body % ("{}", "[]")), (4, body % ('{"a": "true"}', "[]")), (5, "NULL")]
    got = {r.i: r for r in J.component_scores(spark.createDataFrame(rows, "i int, reply string").withColumn("n", F.lit(4)), "n").collect()}
    assert (got[1].precision, got[1].recall, got[1].f1) == (0.5, 0.5, 0.5)
    assert (got[2].status, got[2].f1, got[2].false_positives, got[2].false_negatives) == ("SUCCESS", 0.0, 2, 4)
    assert [got[i].status for i in (3, 4, 5)] == ["EXTRACTION_FAILED"] * 3


def test_decisions(spark):
    df = spark.createDataFrame(
        [("",), ('{"decision": "maybe", "critique": "c"}',), ('{"decision": "PASS"}',), ("REVISE it, do not PASS",)], "content string"
    )
    assert [r.decision for r in P.parse_decisions(df).collect()] == ["REVISE_ANSWER", "REVISE_ANSWER", "PASS", None]


def reviews(spark, rows):
    schema = "rollout_idx int, question_id string, file_rank int, line bigint, answer string, judge_complete_status string, is_correct string, judge_metrics string"
    return spark.createDataFrame(rows, schema)


def test_latest_and_denominators(spark):
    good = '{"precision": 1, "recall": 1, "f1": 1, "judge_model": " m "}'
    df = reviews(
        spark,
        [
            (0, "a", 0, 9, "x", "SUCCESS", "true", good),
            (0, " a ", 1, 1, "x", "SUCCESS", "false", '{"precision": 0.5, "recall": 0.5, "f1": 0.5}'),
            (0, "b", 0, 2, " ", "SUCCESS", '"true"', good),
            (0, "c", 0, 3, "x", "EXTRACTION_FAILED", "true", good),
            (1, "", 0, 4, "x", "SUCCESS", "true", good),
        ],
    )
    s = R.component_summary(R.latest_scored(df, R.COMPONENT_METRICS)).filter("rollout_idx IS NULL").first()
    assert (s.records, s.successful_judgments, s.exact_correct, s.empty_model_responses) == (3, 2, 0, 1)
    assert s.macro_f1 == pytest.approx(0.5) and s.valid_only_macro_f1 == pytest.approx(0.75) and s.judge_models == ["m"]


def test_live_counters_keep_bad_metrics_as_zero(spark):
    df = reviews(spark, [(0, "a", 0, 1, "x", "SUCCESS", "true", '{"f1": 1}'), (0, "b", 0, 2, "x", "SUCCESS", "false", '{"f1": "NaN"}')])
    r = R.live_counters(df, 4, ["f1"]).first()
    assert (r.accuracy, r.accuracy_all, r.f1, r.f1_all) == (0.5, 0.25, 0.5, 0.25)


def test_difficulty_reasons(spark):
    df = spark.createDataFrame([("", "true", "9"), ("a", "false", "9"), ("a", '" YES "', "null"), ("a", "1", "2"), ("a", "true", '"12"')], "question_id string, is_correct string, num_turns string")
    assert [r.reason for r in W.with_difficulty(df, 5, True).collect()] == [
        "skip_missing_question_id", "skip_incorrect", "skip_missing_num_turns", "skip_below_min_num_turns", "selected_rows",
    ]


def test_three_level_mean(spark):
    rows = [("q1", 0, "m", "MEAN", 1.0), ("q1", 0, "m", "MEAN", 3.0), ("q1", 1, "m", "MEAN", 8.0), ("q2", 0, "m", "MEAN", 1.0)]
    r = M.report(spark.createDataFrame(rows, "question_id string, rollout_idx int, metric_name string, metric_type string, value double")).first()
    assert (r.global_mean, r.num_questions, r.num_units) == (3.0, 2, 3)


SPEC = (
    '{"required": ["Key", "Val"], "unique_columns": ["key"], "eval_pipeline": {"Key": {"preprocess": ["norm_str"], "metric": ["exact_match"]},'
    '"val": {"preprocess": [], "metric": ["%s"], "criterion": "about right"}}}'
)


def table_inputs(spark, gold, pred, metric="exact_match"):
    specs = spark.createDataFrame([(1, SPEC % metric)], "instance_id bigint, evaluation string")
    rows = lambda data: spark.createDataFrame([(1, i, {"key": k, "val": v}) for i, (k, v) in enumerate(data)], "instance_id bigint, row_id bigint, cells map<string,string>")
    g, p = rows(gold), rows(pred)
    return specs, TM.headers_from_rows(g), g, TM.headers_from_rows(p), p


def test_many_to_many_may_exceed_one(spark):
    r = TS.score_tables(*table_inputs(spark, [("A", "x"), ("a*", "x")], [("a", "x"), (" a", "x"), ("a", "zz")])).first()
    assert (r.gold_rows, r.predicted_rows, r.row_true_positives, r.row_precision) == (2, 2, 4.0, 2.0)


def test_blank_matches_blank_and_success_needs_all(spark):
    assert TS.score_tables(*table_inputs(spark, [("a", ""), ("b", "1")], [("a", "N/A"), ("b", "1")])).first().is_correct
    assert not TS.score_tables(*table_inputs(spark, [("a", "2")], [("a", "1")])).first().is_correct


def test_empty_match_scores_zero(spark):
    r = TS.score_tables(*table_inputs(spark, [("a", "1")], [("b", "1")])).first()
    assert (r.complete_status, r.row_f1, r.gold_rows) == ("SUCCESS", 0.0, 1)


def test_model_scores_and_key_mapping(spark):
    args = table_inputs(spark, [("rome", "old"), ("oslo", "cold")], [("roma", "aged"), ("oslo", "warm")], "llm_judge")
    key_map = spark.createDataFrame([(1, "key", "roma", "rome"), (1, "key", "oslo", "nowhere")], "instance_id bigint, column_name string, origin string, transform string")
    scores = spark.createDataFrame([(1, "val", "aged", "old", 1.0)], "instance_id bigint, column_name string, response string, target string, score double")
    r = TS.score_tables(*args, key_map=key_map, cell_scores=scores).first()
    assert (r.row_true_positives, r.item_true_positives) == (1.0, 3.0)


def test_table_extraction(spark):
    texts = ["", "no table", "```markdown\n| A b |c|\n|--|--|\n| 1 | x |\n```\n| z | z |", "t | A | B |\n| 1 | 2 |\nend | x", "| only | head | x |", "| a | b |\n| 1 | 2 | 3 |"]
    df = spark.createDataFrame(list(enumerate(texts)), "instance_id bigint, response string")
    got = {r.instance_id: r for r in TM.extract_tables(df).collect()}
    assert [got[i].table_error for i in range(6)] == ["empty_response", "no_table", None, None, "no_data_rows", "bad_row_width"]
    assert got[2].columns == ["ab", "c"] and got[3].columns == ["a", "b"]
    assert {r.instance_id: r.cells for r in TM.table_rows(TM.extract_tables(df)).collect()} == {2: {"ab": "1", "c": "x"}, 3: {"a": "1", "b": "2"}}


def test_gold_csv(spark):
    csv = 'Name,"Sub, total"\n"x ""y""",1\n"two\nlines",2\n'
    rows = TM.table_rows(TM.gold_from_csv(spark.createDataFrame([(1, csv)], "instance_id bigint, gold_csv string"))).collect()
    assert [r.cells for r in rows] == [{"name": 'x "y"', "sub,total": "1"}, {"name": "two\nlines", "sub,total": "2"}]


def test_loop_cycles(spark):
    def cycles(names, seals=(), max_cycle=3):
        rows = [(1, i, i, n, "{}", i in seals) for i, n in enumerate(names)]
        df = spark.createDataFrame(rows, "run bigint, seq bigint, turn bigint, name string, arguments string, is_seal boolean")
        return [r.cycle for r in T.loop_calls(df, max_cycle).orderBy("seq").collect()]

    assert cycles("aaaa") == [None, None, 1, 1]
    assert cycles("abab") == [None, None, None, 2]
    assert cycles("abcabc") == [None] * 5 + [3]
    assert cycles("aaa", seals={1}) == [None, None, None]
    assert cycles("abcabc", max_cycle=2) == [None] * 6 and cycles("aaa", max_cycle=-1) == [None] * 3


def test_signature_folds_case_space_and_key_order(spark):
    sig = lambda a: one(spark, V.call_signature(F.lit("t"), F.col("a")), a=("string", a))
    assert sig('{"q": " A  b", "n": 1}') == sig('{"n": 1, "q": "a B"}')
    assert sig('{"q": "1"}') != sig('{"q": 1}') and sig("{broken  X") == sig("{BROKEN x")


def test_output_limit_prefers_token_count(spark):
    hit = lambda n, f: one(spark, P.hit_output_limit(F.col("n"), F.col("f"), 100, 80), n=("bigint", n), f=("string", f))
    assert hit(None, "length") and not hit(10, "length") and hit(80, "stop") and not hit(None, None)


def test_lookup_priority(spark):
    snaps = spark.createDataFrame(
        [("q", "attempt_10_x/memory", "m-1", "z"), ("q", "attempt_2_x/memory", "other", "m-1"), ("q", "memory", "x-m1", "y"), ("q", "memory", "m-1-old", "w")],
        "question_id string, folder string, stem string, memory_id string",
    )
    got = lookup(spark.createDataFrame([("q", "m-1"), ("q", "z"), ("q", "none")], "question_id string, wanted string"), snaps).collect()
    assert {r.wanted: (r.folder, r.stem, r.match) for r in got} == {"m-1": ("memory", "x-m1", 2), "z": ("attempt_10_x/memory", "m-1", 3)}


def test_natural_order(spark):
    df = spark.createDataFrame([("attempt_10",), ("attempt_9",), ("attempt_1",)], "n string")
    assert [r.n for r in df.orderBy(natural_key(F.col("n"))).collect()] == ["attempt_1", "attempt_9", "attempt_10"]


def test_blocked_hosts(spark):
    items = spark.createDataFrame([("https://a.b.example.net:80/x",), ("http://notexample.net",), ("http://example.net.",), ("no url",)], "url string")
    assert sorted(r.url for r in Q.drop_blocked(items, spark.createDataFrame([("Example.net",)], "domain string")).collect()) == ["http://notexample.net", "no url"]


def test_prompt_language(spark):
    assert text(spark, S.prompt_language, "汉" * 8 + "x" * 500) == "zh"
    assert text(spark, S.prompt_language, "汉" * 4 + "x" * 76) == "zh" and text(spark, S.prompt_language, "汉" * 4 + "x" * 77) == "en"


def test_signatures_fold_nested_texts(spark):
    args = ['{"a":{"Key":" X  y ","n":[" Q "]}}', '{"a":{"Key":"x y","n":["q"]}}', '{"a":{"key":"x y","n":["q"]}}', '{"a":{"Key":"x\\ny","n":["q"]}}', '{"a":{"Key":"x \\" y","n":["q"]}}']
    df = spark.createDataFrame(list(enumerate(args)), "i int, arguments string")
    got = {r.i: r.s for r in df.select("i", V.call_signature(F.lit("t"), F.col("arguments")).alias("s")).collect()}
    assert got[0] == got[1] == got[3] and len(set(got.values())) == 3


def test_table_errors_and_null_scores(spark):
    body = '{"required": ["Key", "Val"], "unique_columns": ["key"], "eval_pipeline": {"val": {"preprocess": [], "metric": ["number_near"]%s}%s}}'
    rows = [
        (1, body % ("", "")),
        (2, body % (', "criterion": 0.1', "")),
        (3, body % (', "criterion": 0.1', ', "other": {"preprocess": ["norm_str"], "metric": []}')),
        (4, body % (', "criterion": 0.1', "")),
        (4, body % (', "criterion": 0.2', "")),
    ]
    parsed = TM.parse_specs(spark.createDataFrame(rows, "instance_id bigint, evaluation string"))
    assert {r.instance_id: r.spec_error for r in parsed.collect()} == {1: "missing_criterion", 2: None, 3: "rule_without_column", 4: "duplicate_spec"}
    cells = spark.createDataFrame([(1, 0, {"a": "1", "b": "2"}), (1, 1, {"a": "1", "c": "2"})], "instance_id bigint, row_id bigint, cells map<string,string>")
    assert TM.headers_from_rows(cells).first().columns == ["a", "b", "c"]
    gold = spark.createDataFrame([(1, "a,b\n1,2,3\n"), (2, "a,b\n1,2\n")], "instance_id bigint, gold_csv string")
    assert {r.instance_id: r.table_error for r in TM.gold_from_csv(gold).collect()} == {1: "bad_row_width", 2: None}
    score = TS.cell_score(F.lit("number_near"), F.lit("1"), F.lit("999"), F.lit(None).cast("double"))
    assert spark.range(1).select(score.alias("s")).first().s == 0.0
