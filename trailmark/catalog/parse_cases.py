"""Parse jobs, verdicts, judge requests and re-judging."""

from pyspark.sql import functions as F

from trailmark.catalog.base import case
from trailmark.catalog.summary_cases import flat
from trailmark.functions import variants as V
from trailmark.operators import judging as J
from trailmark.operators import parsing as P
from trailmark.operators.benchmarks import benchmark_dimension


def art(c):
    return rf"trim(regexp_replace(regexp_replace(trim({c}, @WS), '^```[A-Za-z0-9_-]*\s*', ''), '\s*```\s*$', ''), @WS)"


BR = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"
PIPE_LINE = "(l LIKE '|%' AND l LIKE '%|' AND length(l) - length(replace(l, '|', '')) >= 3)"


def good(lines):
    return rf"(len({lines}) >= 3 AND len(list_filter({lines}, lambda l: regexp_matches(l, '^[|\- :]*$') AND contains(l, '-'))) > 0)"


# runs of pipe lines: number lines, take islands, keep the last good one
TABLES = rf"""ln AS (SELECT doc_id, unnest(string_split_regex(content, {BR})) AS raw, generate_subscripts(string_split_regex(content, {BR}), 1) AS pos FROM fx_texts),
 pl AS (SELECT doc_id, pos, trim(raw, @WS) AS l FROM ln), isl AS (SELECT doc_id, pos, l, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM pl WHERE {PIPE_LINE}),
 runs AS (SELECT doc_id, g, max(pos) AS endpos, list(l ORDER BY pos) AS ls FROM isl GROUP BY doc_id, g),
 bare AS (SELECT doc_id, arg_max(array_to_string(ls, chr(10)), endpos) AS tab FROM runs WHERE {good('ls')} GROUP BY doc_id),
 fen AS (SELECT doc_id, unnest(f) AS body, generate_subscripts(f, 1) AS ord FROM (SELECT doc_id, regexp_extract_all(content, '(?is)```markdown\s*(.*?)\s*```', 1) AS f FROM fx_texts) q),
 fgood AS (SELECT doc_id, arg_max(body, ord) AS body FROM fen WHERE {good(f"list_filter(list_transform(string_split_regex(body, {BR}), lambda x: trim(x, @WS)), lambda l: {PIPE_LINE})")} GROUP BY doc_id),
 tabs AS (SELECT t.doc_id, coalesce('```markdown' || chr(10) || trim(fgood.body, @WS) || chr(10) || '```', bare.tab) AS tab FROM fx_texts t LEFT JOIN fgood ON t.doc_id = fgood.doc_id LEFT JOIN bare ON t.doc_id = bare.doc_id)"""


@case("fn10_strip_fence", f"SELECT doc_id, md5({art('content')}) AS stripped FROM fx_texts")
def _(x):
    return x.texts.select("doc_id", F.md5(P.strip_artifacts(F.col("content"))).alias("stripped"))


@case("fn12_markdown_table", f"WITH {TABLES} SELECT doc_id, md5(tab) AS tab, length(tab) AS chars FROM tabs")
def _(x):
    t = x.texts.withColumn("tab", P.markdown_table(F.col("content")))
    return t.select("doc_id", F.md5("tab").alias("tab"), F.length("tab").cast("bigint").alias("chars"))


@case("win10_pipe_blocks", f"WITH {TABLES} SELECT doc_id, md5(tab) AS tab FROM bare")
def _(x):
    only = x.texts.withColumn("tab", P.markdown_table(F.regexp_replace("content", "(?i)```markdown", "")))
    return only.filter("tab IS NOT NULL").select("doc_id", F.md5("tab").alias("tab"))


def answer_sql(strict: bool) -> str:
    think = (
        "CASE WHEN c NOT LIKE '%</think>%' THEN c WHEN trim(parts[-1], @WS) <> '' THEN trim(parts[-1], @WS) ELSE "
        + ("''" if strict else "trim(parts[1], @WS)") + " END"
    )
    tagged = "CASE WHEN v LIKE '%<answer>%' THEN trim(string_split(string_split(v, '<answer>')[-1], '</answer>')[1], @WS) ELSE v END"
    fallback = "v" if strict else "CASE WHEN v = '' THEN trim(coalesce(reasoning, ''), @WS) ELSE v END"
    phrase = r"(?i)(?:答案[是为:]|answer:|the answer is)\s*(.+)"
    ph = f"trim(string_split(trim(string_split_regex(regexp_extract(v, '{phrase}', 1), {BR})[1], @WS), '。')[1], @WS)"
    cut = rf"CASE WHEN regexp_matches(ph, '(?s)^.*?\.\s+\S') THEN regexp_extract(ph, '(?s)^(.*?)\.\s+\S', 1) ELSE ph END"
    last = "NULL" if strict else art("v")
    return rf"""{TABLES}, a1 AS (SELECT doc_id, benchmark, reasoning, trim(content, @WS) AS c, string_split(trim(content, @WS), '</think>') AS parts FROM fx_texts),
 a2 AS (SELECT *, {think} AS v FROM a1), a3 AS (SELECT * REPLACE ({tagged} AS v) FROM a2), a4 AS (SELECT * REPLACE ({fallback} AS v) FROM a3),
 a5 AS (SELECT *, {art("regexp_extract(v, '(?s)Answer:\\*?\\*?\\s*(.*)', 1)")} AS lab, {ph} AS ph FROM a4), a6 AS (SELECT *, {art(cut)} AS p FROM a5),
 ans AS (SELECT a6.doc_id, CASE WHEN v = '' THEN NULL WHEN benchmark = 'widesearch_200' AND tab IS NOT NULL THEN tab
   WHEN lab <> '' AND benchmark = 'widesearch_200' AND regexp_matches(lab, '(?is)^(?:please\s+)?(?:see|refer\s+to)\s+(?:the\s+)?(?:markdown\s+)?table\s+(?:shown\s+)?above[.!]?$') THEN NULL
   WHEN lab <> '' THEN lab WHEN p <> '' THEN p ELSE {last} END AS answer FROM a6 JOIN tabs ON a6.doc_id = tabs.doc_id)"""


@case("fn11_answers", f"WITH {answer_sql(False)} SELECT doc_id, md5(answer) AS answer, length(answer) AS chars FROM ans")
def _(x):
    t = P.parse_answers(x.texts)
    return t.select("doc_id", F.md5("parsed_answer").alias("answer"), F.length("parsed_answer").cast("bigint").alias("chars"))


@case("fn11_strict_answers", f"WITH {answer_sql(True)} SELECT doc_id, md5(answer) AS answer, length(answer) AS chars FROM ans")
def _(x):
    t = P.parse_answers(x.texts, strict=True)
    return t.select("doc_id", F.md5("parsed_answer").alias("answer"), F.length("parsed_answer").cast("bigint").alias("chars"))


@case(
    "fn13_submitted_answers",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq DESC) AS rn FROM fx_turns), l AS (SELECT * FROM r WHERE rn = 1), p AS (SELECT run, role AS prole, tool_name AS ptool FROM r WHERE rn = 2)
    SELECT l.run, CASE WHEN role = 'tool' AND ok AND prole = 'assistant' AND ptool = 'submit_tool' THEN nullif(trim(json_extract_string(CASE WHEN json_valid(content) THEN content WHEN json_valid(string_split(content, chr(10))[1]) THEN string_split(content, chr(10))[1] ELSE '{}' END, '$.answer'), @WS), '') END AS answer
    FROM l JOIN p ON l.run = p.run""",
)
def _(x):
    return P.submitted_answers(x.turns)


@case(
    "fn13_final_answers",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq DESC) AS rn FROM fx_turns), l AS (SELECT * FROM r WHERE rn = 1), p AS (SELECT run, role AS prole, tool_name AS ptool FROM r WHERE rn = 2)
    SELECT l.run, CASE WHEN l.run % 2 = 0 THEN 'submit' ELSE 'text' END AS mode, CASE WHEN l.run % 2 = 1 THEN nullif(trim(content, @WS), '') WHEN role = 'tool' AND ok AND prole = 'assistant' AND ptool = 'submit_tool' THEN nullif(trim(json_extract_string(CASE WHEN json_valid(content) THEN content WHEN json_valid(string_split(content, chr(10))[1]) THEN string_split(content, chr(10))[1] ELSE '{}' END, '$.answer'), @WS), '') END AS answer
    FROM l JOIN p ON l.run = p.run""",
)
def _(x):
    tools = x.turns.select("run").distinct().withColumn("tools", F.when(F.col("run") % 2 == 0, F.array(F.lit("search_api"), F.lit("submit_tool"))).otherwise(F.array(F.lit("search_api"))))
    return P.final_answers(x.turns, tools)


def reason_sql(c):
    pats = [p.replace("(?is)", "") for p in P.REASON_PATTERNS]
    whens = " ".join(f"WHEN regexp_matches({c}, '(?is){p}') THEN trim(regexp_extract({c}, '(?is){p}', 1), @WS)" for p in pats)
    return f"CASE {whens} END"


@case("fn21_reasons", f"SELECT doc_id, md5({reason_sql('v')}) AS reason FROM (SELECT doc_id, string_split(content, '</think>')[-1] AS v FROM fx_texts) t")
def _(x):
    return P.parse_reasons(x.texts).select("doc_id", F.md5("reason").alias("reason"))


PROBLEM = "CASE WHEN coalesce(trim({c}, @WS), '') = '' THEN 'empty_answer' WHEN lower(trim({c}, @WS)) = 'answer:' THEN 'empty_answer_prefix' " + " ".join(
    "WHEN starts_with(lower(trim({c}, @WS)), '" + p.replace("'", "''") + "') THEN 'refusal_response:" + p[:20].replace("'", "''") + "'" for p in P.REFUSALS
) + " END"


@case("flt4_answer_problem", f"WITH {answer_sql(False)} SELECT doc_id, {PROBLEM.format(c='answer')} AS problem FROM ans")
def _(x):
    return P.parse_answers(x.texts).select("doc_id", P.answer_problem(F.col("parsed_answer")).alias("problem"))


MAL = P.MALFORMED_CALL


@case("flt5_malformed_calls", f"SELECT doc_id, regexp_matches(content || coalesce(reasoning, ''), '{MAL}') AS malformed FROM fx_texts")
def _(x):
    return x.texts.select("doc_id", P.malformed_call(F.concat("content", F.coalesce("reasoning", F.lit("")))).alias("malformed"))


@case(
    "flt6_final_output",
    f"""WITH {answer_sql(True)} SELECT t.doc_id, has_tool_calls OR regexp_matches(content, '{P.FORBIDDEN_FINAL}') AS forbidden,
    NOT (has_tool_calls OR regexp_matches(content, '{P.FORBIDDEN_FINAL}')) AND {PROBLEM.format(c='answer')} IS NULL AS usable FROM fx_texts t JOIN ans ON t.doc_id = ans.doc_id""",
)
def _(x):
    return P.with_final_checks(x.texts).select("doc_id", "forbidden", "usable")


@case(
    "flt7_output_limit",
    """SELECT event_id, CASE WHEN json_extract_string(usage, '$.completion_tokens') IS NOT NULL THEN CAST(json_extract_string(usage, '$.completion_tokens') AS BIGINT) >= 8192 ELSE finish_reason = 'length' END AS cut FROM fx_usage""",
)
def _(x):
    tokens = F.try_variant_get(F.try_parse_json("usage"), "$.completion_tokens", "bigint")
    return x.usage.select("event_id", P.hit_output_limit(tokens, F.col("finish_reason"), 8192, 10000).alias("cut"))


REASONS = rf"""{answer_sql(True)}, rr AS (SELECT t.doc_id, state, CASE WHEN has_tool_calls THEN NULL WHEN regexp_matches(content || coalesce(reasoning, ''), '{MAL}') THEN 'malformed_tool_call'
  WHEN state = 'RUBRIC' AND len(list_filter(string_split_regex(content, {BR}), lambda l: regexp_matches(l, '^\s*(\d+)\.\s*(.+)$'))) = 0 THEN 'fsm_parse.RUBRIC'
  WHEN state = 'ANSWER' AND answer IS NULL THEN 'fsm_parse.ANSWER'
  WHEN state = 'VERIFY' AND content <> '' AND NOT (contains(u, 'REVISE_RUBRIC') OR contains(u, 'REVISE RUBRIC') OR contains(u, 'REVISE_ANSWER') OR contains(u, 'REVISE ANSWER') OR (contains(u, 'PASS') AND NOT contains(u, 'REVISE'))) THEN 'fsm_parse.VERIFY' END AS retry_reason
  FROM (SELECT *, upper(string_split(content, '</think>')[-1]) AS u FROM fx_texts) t JOIN ans ON t.doc_id = ans.doc_id)"""


@case("flt8_turn_retries", f"WITH {REASONS} SELECT doc_id, state, retry_reason FROM rr")
def _(x):
    return P.turn_retry_reason(x.texts).select("doc_id", "state", "retry_reason")


@case("agg14_retry_counts", f"WITH {REASONS} SELECT CAST(doc_id % 10 AS STRING) AS question_id, CAST(doc_id % 3 AS INTEGER) AS rollout_idx, 'num_retries.' || retry_reason AS metric_name, count(*) AS retries FROM rr WHERE retry_reason IS NOT NULL GROUP BY ALL")
def _(x):
    from trailmark.operators.metrics import retry_counts

    # outer explode instead of a filter, which would be pushed down and repeat the parse
    r = P.turn_retry_reason(x.texts).select(
        (F.col("doc_id") % 10).cast("string").alias("question_id"), (F.col("doc_id") % 3).cast("int").alias("rollout_idx"),
        F.explode_outer(F.array("retry_reason")).alias("reason"),
    )
    return retry_counts(r.filter("reason IS NOT NULL"))


ECLASS = """CASE WHEN doc_id % 7 IN (1, 5) THEN 'fatal' WHEN doc_id % 7 IN (0, 6) THEN 'rate_limited' WHEN doc_id % 7 IN (2, 4) THEN 'retryable' ELSE 'other' END"""


@case("flt10_error_class", f"SELECT doc_id, {ECLASS} AS class FROM documents")
def _(x):
    return x.texts.select("doc_id", P.error_class(F.col("error")).alias("class"))


@case("agg19_retry_pressure", "SELECT count(*) AS retries, count(*) FILTER (doc_id % 7 IN (0, 5, 6)) AS rate_limit_hits FROM documents")
def _(x):
    return P.retry_pressure(x.texts)


# ---- verdicts; the oracles know how each reply was derived ----
JUNK = "doc_id % 31 = 0"


@case(
    "fn14_json_object",
    f"""SELECT doc_id, CASE WHEN {JUNK} OR style IN (1, 2, 3, 8) THEN NULL ELSE style IN (4, 5, 6, 0, 7) END AS found FROM fx_verdicts""",
)
def _(x):
    found = V.is_object(P.json_object(F.col("reply")))
    return x.verdicts.select("doc_id", F.when(found, F.lit(True)).alias("found"))


@case(
    "fn15_decision_verdicts",
    f"""SELECT doc_id, CASE WHEN {JUNK} OR style NOT IN (0, 1) THEN false ELSE quality = 1 END AS is_correct, 0.0::DOUBLE AS score,
    CASE WHEN {JUNK} THEN '' WHEN style = 0 THEN 'r' || doc_id WHEN style = 1 THEN 'the "nick" name' ELSE '' END AS reasoning, CASE WHEN {JUNK} OR style NOT IN (0, 1) THEN 'EXTRACTION_FAILED' ELSE 'SUCCESS' END AS status FROM fx_verdicts""",
)
def _(x):
    return x.verdicts.withColumn("out", J.decision_verdict(F.col("reply"))).select("doc_id", "out.*")


@case(
    "fn16_labelled_verdicts",
    f"""SELECT doc_id, NOT {JUNK} AND style = 2 AND quality = 1 AS is_correct, CASE WHEN NOT {JUNK} AND style = 2 AND quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN NOT {JUNK} AND style = 2 THEN 'because' || chr(10) || 'of it' ELSE '' END AS reasoning,
    CASE WHEN NOT {JUNK} AND style = 2 THEN 'SUCCESS' ELSE 'EXTRACTION_FAILED' END AS status, CASE WHEN NOT {JUNK} AND style = 2 THEN (doc_id % 100) || '%' END AS confidence FROM fx_verdicts""",
)
def _(x):
    t = x.verdicts.withColumn("out", J.labelled_verdict(F.col("reply")))
    return t.select("doc_id", "out.*", J.labelled_field(F.col("reply"), "confidence").alias("confidence"))


@case(
    "fn17_zh_verdicts",
    f"""SELECT doc_id, NOT {JUNK} AND style = 3 AND quality = 1 AS is_correct, CASE WHEN NOT {JUNK} AND style = 3 THEN '一致' || doc_id ELSE '' END AS reasoning, CASE WHEN NOT {JUNK} AND style = 3 THEN 'SUCCESS' ELSE 'EXTRACTION_FAILED' END AS status FROM fx_verdicts""",
)
def _(x):
    return x.verdicts.withColumn("out", J.zh_verdict(F.col("reply"))).select("doc_id", "out.is_correct", "out.reasoning", "out.status")


@case("fn17_exact_hits", "SELECT line, coalesce(trim(answer, @WS) IN (trim(truth, @WS), 'none'), false) AS hit FROM fx_reviews")
def _(x):
    return x.reviews.select("line", F.coalesce(J.exact_hit(F.col("answer"), F.array(F.col("truth"), F.lit(" none "))), F.lit(False)).alias("hit"))


@case(
    "fn18_component_payload",
    f"""SELECT doc_id, CASE WHEN {JUNK} THEN NULL WHEN style = 4 THEN 'e' || doc_id WHEN style = 5 THEN 'none' END AS explanation, CAST(CASE WHEN {JUNK} THEN NULL WHEN style = 4 THEN 2 WHEN style = 5 THEN 0 END AS INTEGER) AS details,
    CASE WHEN {JUNK} THEN NULL WHEN style = 4 THEN CASE WHEN toxic = 1 THEN 'x|y' ELSE '' END WHEN style = 5 THEN CASE WHEN quality = 1 THEN 'z' ELSE '' END END AS excessive FROM fx_verdicts""",
)
def _(x):
    p = x.verdicts.withColumn("p", J.component_payload(F.col("reply")))
    return p.select("doc_id", "p.explanation", F.when(F.col("p").isNotNull(), F.size("p.details")).alias("details"), F.array_join("p.excessive", "|").alias("excessive"))


@case(
    "agg1_component_scores",
    f"""SELECT doc_id, tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(tp / nullif(tp + fp, 0), 6) AS p0, CASE WHEN tp IS NULL THEN NULL WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END AS precision,
    CASE WHEN tp IS NULL THEN NULL WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 6) END AS recall, CASE WHEN tp IS NULL THEN NULL WHEN tp = 0 THEN 0 ELSE round(2.0 * tp / (2 * tp + fp + fn), 6) END AS f1, coalesce(style = 4 AND fn = 0 AND fp = 0, false) AS is_correct,
    CASE WHEN tp IS NULL THEN 'EXTRACTION_FAILED' ELSE 'SUCCESS' END AS status FROM (SELECT doc_id, style, CAST(CASE WHEN {JUNK} THEN NULL WHEN style = 4 THEN 1 + quality WHEN style = 5 AND quality = 1 THEN 0 END AS BIGINT) AS tp,
     CAST(CASE WHEN {JUNK} THEN NULL WHEN style = 4 THEN 2 * toxic WHEN style = 5 AND quality = 1 THEN 1 END AS BIGINT) AS fp, CAST(CASE WHEN {JUNK} THEN NULL WHEN style = 4 THEN 1 - quality WHEN style = 5 AND quality = 1 THEN 3 END AS BIGINT) AS fn FROM fx_verdicts) t""",
)
def _(x):
    t = J.component_scores(x.verdicts.withColumn("n", F.lit(3)), "n")
    tp, fp = F.col("true_positives"), F.col("false_positives")
    return flat(t.select("doc_id", "true_positives", "false_positives", "false_negatives", F.try_divide(tp.cast("double"), (tp + fp).cast("double")).alias("p0"), "precision", "recall", "f1", "is_correct", "status"))


@case(
    "fn19_column_scores",
    f"""SELECT doc_id, CAST(i AS INTEGER) AS idx, CASE WHEN {JUNK} OR style <> 7 THEN 0.0::DOUBLE WHEN i = 0 THEN 1.0::DOUBLE WHEN i = 1 AND toxic = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM fx_verdicts CROSS JOIN range(4) r(i)""",
)
def _(x):
    return J.column_scores(x.verdicts.select("doc_id", "reply", F.lit(4).alias("n_items")))


RUB = r"""SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN [] WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN ['1:r' || doc_id || ':f', '2:' || lang || ':f', '7::t'] ELSE ['1:r' || doc_id || ':f', '2:' || lang || ':f'] END
   ELSE list_transform(list_filter(string_split_regex(content, """ + BR + r"""), lambda l: regexp_matches(l, '^\s*(\d+)\.\s*(.+)$')), lambda l: CAST(regexp_extract(l, '^\s*(\d+)\.\s*(.+)$', 1) AS BIGINT) || ':' || trim(regexp_extract(l, '^\s*(\d+)\.\s*(.+)$', 2), @WS) || ':f') END AS rs
   FROM (SELECT f.doc_id, f.content, d.lang FROM fx_rubrics f JOIN documents d ON f.doc_id = d.doc_id) t"""


@case("fn20_rubrics", f"SELECT doc_id, CAST(len(rs) AS INTEGER) AS n, md5(array_to_string(rs, chr(10))) AS body FROM ({RUB}) t")
def _(x):
    t = P.parse_rubrics(x.rubrics)
    body = F.array_join(F.transform("rubrics", lambda r: F.concat(r["id"], F.lit(":"), r["description"], F.when(r["satisfied"], F.lit(":t")).otherwise(F.lit(":f")))), "\n")
    return t.select("doc_id", F.size("rubrics").alias("n"), F.md5(body).alias("body"))


DECIDE = f"""SELECT doc_id, CASE WHEN {JUNK} THEN NULL WHEN style = 6 AND doc_id % 5 <> 0 THEN CASE WHEN quality = 1 THEN 'PASS' WHEN toxic = 1 THEN 'REVISE_ANSWER' ELSE 'REVISE_RUBRIC' END
  WHEN style = 6 THEN CASE WHEN quality = 1 THEN 'PASS' WHEN toxic = 1 THEN NULL ELSE 'REVISE_RUBRIC' END WHEN style = 8 THEN CASE WHEN quality = 1 THEN 'PASS' WHEN toxic = 1 THEN 'REVISE_ANSWER' END END AS decision,
  CASE WHEN style = 6 AND NOT {JUNK} AND doc_id % 5 <> 0 THEN 'c' || doc_id ELSE substr(CASE WHEN contains(reply, '</think>') THEN trim(string_split(reply, '</think>')[-1], @WS) ELSE reply END, 1, 500) END AS critique, CAST(CASE WHEN style = 6 AND NOT {JUNK} AND doc_id % 5 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS checks FROM fx_verdicts"""


@case("fn22_decisions", DECIDE)
def _(x):
    t = P.parse_decisions(x.verdicts.withColumn("content", F.col("reply")))
    return t.select("doc_id", "decision", "critique", F.size("checks").alias("checks"))


KIND = "CASE WHEN style IN (0, 1) THEN 'decision' WHEN style = 2 THEN 'labelled' WHEN style = 3 THEN 'zh_label' ELSE 'component' END"
STATUS = f"CASE WHEN {JUNK} THEN 'EXTRACTION_FAILED' WHEN style < 5 OR (style = 5 AND quality = 1) THEN 'SUCCESS' ELSE 'EXTRACTION_FAILED' END"


def with_kind(x):
    kind = F.when(F.col("style") < 2, F.lit("decision")).when(F.col("style") == 2, F.lit("labelled")).when(F.col("style") == 3, F.lit("zh_label")).otherwise(F.lit("component"))
    return x.verdicts.withColumn("verifier", kind)


NAMED = f"CASE WHEN doc_id % 17 = 0 THEN 'nope' WHEN doc_id % 19 = 0 THEN 'table' WHEN doc_id % 23 = 0 THEN NULL ELSE {KIND} END"


@case(
    "udf2_verifier_choice",
    f"""SELECT doc_id, verifier, CASE WHEN verifier IS NULL OR verifier = 'nope' THEN 'UNKNOWN_VERIFIER' WHEN verifier = 'table' THEN CASE WHEN toxic = 0 THEN 'SUCCESS' ELSE 'EXTRACTION_FAILED' END ELSE {STATUS} END AS status,
    CASE WHEN verifier IS NULL OR verifier = 'nope' THEN false WHEN verifier = 'table' THEN toxic = 0 AND quality = 1 ELSE NOT {JUNK} AND CASE WHEN style < 4 THEN quality = 1 WHEN style = 4 THEN quality = 1 AND toxic = 0 ELSE false END END AS is_correct
    FROM (SELECT *, {NAMED} AS verifier FROM fx_verdicts) v""",
)
def _(x):
    named = F.when(F.col("doc_id") % 17 == 0, F.lit("nope")).when(F.col("doc_id") % 19 == 0, F.lit("table")).when(F.col("doc_id") % 23 == 0, F.lit(None)).otherwise(F.col("verifier"))
    done = F.when(F.col("toxic") == 0, F.lit("SUCCESS")).otherwise(F.lit("EXTRACTION_FAILED"))
    scores = F.struct((F.col("quality") == 1).alias("is_correct"), F.lit(1.0).alias("row_f1"), done.alias("complete_status"))
    rows = with_kind(x).withColumns({"verifier": named, "table_scores": scores})
    return J.parse_verdicts(rows).select("doc_id", "verifier", "verdict.status", "verdict.is_correct")


@case("par1_parse_report", f"SELECT {KIND} AS benchmark, CASE WHEN quality = 1 THEN 'ANSWER' ELSE 'VERIFY' END AS state, {STATUS} AS parse_status, CASE WHEN {STATUS} = 'SUCCESS' THEN 'none' ELSE 'judge_retry' END AS rule, count(*) AS outputs FROM fx_verdicts GROUP BY ALL")
def _(x):
    t = J.parse_verdicts(with_kind(x))
    status = F.col("verdict.status")
    return P.parse_report(
        t.select(
            F.col("verifier").alias("benchmark"),
            F.when(F.col("quality") == 1, F.lit("ANSWER")).otherwise(F.lit("VERIFY")).alias("state"),
            status.alias("parse_status"),
            F.when(status == "SUCCESS", F.lit("none")).otherwise(F.lit("judge_retry")).alias("rule"),
        )
    )


# ---- requests ----
@case(
    "prj21_judge_requests",
    """SELECT line, CASE WHEN line % 4 = 3 AND line % 5 = 0 THEN 'invalid_answer_type' END AS request_error, md5(CASE line % 4
     WHEN 0 THEN 'Decide whether the answer equals the reference.' || nl || nl || 'Question: ' || question || nl || nl || 'Ground truth: ' || truth || ', ' || benchmark || nl || nl || 'User answer: ' || a || nl || nl || 'Reply with JSON: {"reasoning": "...", "decision": true/false}'
     WHEN 1 THEN 'Judge the [response] to the [question] against the [correct_answer].' || nl || nl || '[question]: ' || question || nl || nl || '[response]: ' || a || nl || nl || '[correct_answer]: ' || '["' || truth || '","' || benchmark || '"]' || nl || nl || 'Reply with lines extracted_final_answer:, reasoning:, correct: yes/no, confidence:'
     WHEN 2 THEN '判断[回答]是否正确。' || nl || nl || '[原问题]: ' || question || nl || nl || '[正确答案]: ' || truth || ', ' || benchmark || nl || nl || '[回答]: ' || a || nl || nl || '依次给出：最终答案、解释、结论（正确/错误）。'
     ELSE CASE WHEN line % 5 <> 0 THEN 'Rate each part of the correct answer.' || nl || nl || 'User Prompt:' || nl || '<prompt>' || nl || question || nl || '</prompt>' || nl || nl || 'Prompt Type: Set Answer' || nl || nl || 'Correct Answer:' || nl || '<answer>' || nl || '["' || truth || '","' || benchmark || '"]' || nl || '</answer>' || nl || nl || 'AI Response:' || nl || '<response>' || nl || a || nl || '</response>' || nl || nl || 'Rating:' || nl END END) AS request
     FROM (SELECT *, chr(10) AS nl, coalesce(answer, '') AS a FROM fx_reviews) t""",
)
def _(x):
    m = F.col("line") % 4
    kind = F.when(m == 0, F.lit("decision")).when(m == 1, F.lit("labelled")).when(m == 2, F.lit("zh_label")).otherwise(F.lit("component"))
    rows = x.reviews.withColumns(
        {"verifier": kind, "ground_truth": F.array("truth", "benchmark"), "answer_type": F.when(F.col("line") % 5 == 0, F.lit("Other")).otherwise(F.lit(" Set Answer"))}
    )
    return J.judge_requests(rows).select("line", "request_error", F.md5("request").alias("request"))


@case(
    "prj23_column_requests",
    """SELECT instance_id, column_name, chunk, count(*) AS n_items, md5('Criterion: exact' || chr(10) || 'Cells: {' || string_agg('"idx_' || idx || '":{"response":"' || response || '","target":"' || target || '"}', ',' ORDER BY idx) || '}') AS request
    FROM (SELECT l_suppkey % 20 AS instance_id, 'flag' AS column_name, CAST(floor(l_orderkey / 200) AS BIGINT) AS chunk, l_orderkey * 10 + l_linenumber AS idx, l_returnflag AS response, l_linestatus AS target,
      row_number() OVER (PARTITION BY l_suppkey % 20, l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) t WHERE rn = 1 GROUP BY ALL""",
)
def _(x):
    from trailmark.plans.keyed import first_by

    li = x.table("lineitem").select(
        (F.col("l_suppkey") % 20).alias("instance_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_returnflag").alias("response"), F.col("l_linestatus").alias("target"),
    )
    one = first_by(li, ["instance_id", "l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    cells = one.select("instance_id", F.lit("flag").alias("column_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), "response", "target", F.lit("exact").alias("criterion"))
    return J.column_requests(cells, chunk=2000).withColumn("request", F.md5("request"))


@case(
    "prj23_alignment_vocabulary",
    """SELECT instance_id, 'flag' AS column_name, flag AS value, bool_or(side = 'pred') AS in_response, bool_or(side = 'gold') AS in_reference FROM fx_rows GROUP BY ALL HAVING NOT (bool_or(side = 'pred') AND bool_or(side = 'gold'))""",
)
def _(x):
    return J.alignment_vocabulary(x.rows.select("instance_id", F.lit("flag").alias("column_name"), "side", F.col("flag").alias("value")))


# ---- review rows and re-judging ----
@case(
    "prj8_review_records",
    """SELECT r.line, CASE WHEN coalesce(r.answer, '') = '' THEN 'no answer found' END AS error, CASE WHEN coalesce(r.answer, '') = '' THEN 'EXTRACTION_FAILED' WHEN l.doc_id IS NOT NULL THEN 'SUCCESS' END AS judge_complete_status,
    CASE WHEN coalesce(r.answer, '') = '' THEN false WHEN l.doc_id IS NOT NULL THEN l.quality = 1 END AS is_correct, CASE WHEN coalesce(r.answer, '') = '' THEN 0.0::DOUBLE WHEN l.doc_id IS NOT NULL THEN l.quality::DOUBLE END AS score
    FROM fx_reviews r LEFT JOIN labels l ON r.line = l.doc_id""",
)
def _(x):
    rollouts = x.reviews.select("line", F.col("line").alias("question_id"), "rollout_idx", "answer")
    lab = x.table("labels").select(
        F.col("doc_id").alias("question_id"), (F.col("doc_id") % 3).cast("int").alias("rollout_idx"), (F.col("quality") == 1).alias("is_correct"),
        F.col("quality").cast("double").alias("score"), F.lit("SUCCESS").alias("status"),
    )
    return J.review_records(rollouts, lab).select("line", "error", "judge_complete_status", "is_correct", "score")


@case(
    "prj9_candidate_responses",
    """SELECT line, CASE WHEN line % 4 = 0 THEN 'assistant_response' WHEN line % 6 = 1 THEN 'raw_response' ELSE 'answer' END AS candidate_field,
    CASE WHEN line % 4 = 0 THEN question WHEN line % 6 = 1 THEN truth WHEN answer IS NULL THEN '' ELSE 'Explanation: Final answer extracted from a previous rollout.' || chr(10) || 'Exact Answer: ' || answer || chr(10) || 'Confidence: 100%' END AS candidate FROM fx_reviews""",
)
def _(x):
    rows = x.reviews.withColumns(
        {
            "response": F.lit(""),
            "assistant_response": F.when(F.col("line") % 4 == 0, F.col("question")),
            "raw_response": F.when(F.col("line") % 6 == 1, F.col("truth")).otherwise(F.lit("")),
        }
    )
    return J.candidate_responses(rows).select("line", "candidate_field", "candidate")


@case(
    "prj10_official_results",
    f"""SELECT doc_id, err AS official_judge_error, err IS NULL AND ok AND quality = 1 AS official_is_correct, CASE WHEN err IS NULL AND ok AND quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS official_score,
    CASE WHEN err IS NOT NULL THEN 'ERROR' WHEN ok THEN 'SUCCESS' ELSE 'EXTRACTION_FAILED' END AS official_judge_complete_status, CASE WHEN err IS NULL AND ok THEN 'A' || doc_id END AS official_judge_extracted_final_answer,
    CASE WHEN err IS NULL THEN (toxic = 1) <> (ok AND quality = 1) END AS official_disagrees_with_existing
    FROM (SELECT *, NOT {JUNK} AND style = 2 AS ok, CASE WHEN text = '' THEN 'no question' WHEN doc_id % 10 = 3 THEN 'no ground truth' WHEN doc_id % 10 = 4 THEN 'boom' END AS err FROM fx_verdicts) t""",
)
def _(x):
    rows = x.verdicts.withColumns(
        {
            "is_correct": F.col("toxic") == 1,
            "question": F.col("text"),
            "truth_size": F.when(F.col("doc_id") % 10 == 3, F.lit(0)).otherwise(F.lit(1)),
            "call_error": F.when(F.col("doc_id") % 10 == 4, F.lit("boom")),
        }
    )
    cols = "official_judge_error official_is_correct official_score official_judge_complete_status official_judge_extracted_final_answer official_disagrees_with_existing"
    return J.official_results(rows).select("doc_id", *cols.split())


@case(
    "jn13_recommended_judge",
    """SELECT line, benchmark, CASE benchmark WHEN 'widesearch_200' THEN 'table' WHEN 'deepsearchqa_900' THEN 'component' WHEN 'xbench_2510' THEN 'zh_label' ELSE 'decision' END AS verifier,
     CASE benchmark WHEN 'widesearch_200' THEN line % 2 = 0 WHEN 'deepsearchqa_900' THEN line % 2 = 1 END AS matches_configured_judge FROM fx_reviews""",
)
def _(x):
    model = F.when(F.col("line") % 2 == 0, F.lit("Azure/GPT-4.1-2025-04-14")).otherwise(F.lit("gemini-2.5-Flash"))
    rows = x.reviews.withColumn("judge_model", model)
    return J.with_recommended_judge(rows, benchmark_dimension(x.spark)).select("line", "benchmark", "verifier", "matches_configured_judge")
