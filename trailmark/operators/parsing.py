"""Parsing raw model outputs as table jobs: answers, rubrics, decisions, retry checks.

Each job adds columns to a table of outputs. Steps are separate columns, so a regular expression runs
once per row and later steps refer to its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.functions import tables as X
from trailmark.functions import variants as V
from trailmark.plans.blocks import lagged
from trailmark.plans.keyed import latest_by

# ---- fixed values -------------------------------------------------------------------------
THINK_END = "</think>"
ANSWER_LABEL = r"(?s)Answer:\*?\*?\s*(.*)"
ANSWER_PHRASE = r"(?id)(?:答案[是为:]|answer:|the answer is)\s*(.+)"
TABLE_POINTER = (
    r"(?is)^(?:please\s+)?(?:see|refer\s+to)\s+(?:the\s+)?(?:markdown\s+)?table\s+(?:shown\s+)?above[.!]?$"
)
MARKDOWN_FENCE = r"(?is)```markdown\s*(.*?)\s*```"
JSON_FENCE = r"(?s)```json\s*(.*?)\s*```"
JSON_OBJECT_FENCE = r"(?s)```json\s*(\{.*?\})\s*```"
RUBRIC_LINE = r"^\s*(\d+)\.\s*(.+)$"
REASON_PATTERNS = (
    r"(?is)Reasoning:\s*(.+?)(?:\n\s*\n|\n\s*Answer:)",
    r"(?is)<reasoning>\s*(.+?)\s*</reasoning>",
    r"(?is)Summary:\s*(.+?)(?:\n\s*\n|\n\s*Answer:)",
)
DECISIONS = ("PASS", "REVISE_ANSWER", "REVISE_RUBRIC")
CRITIQUE_CHARS = 500
REFUSALS = (
    "i cannot provide",
    "i'm unable to",
    "i don't have access",
    "i could not find",
    "unable to determine",
    "cannot be determined",
)
MALFORMED_CALL = r"(?i)<parameter=[^>]*>|</?tool_call>|</?function\b[^>]*>|<parameter>[^<]*>"
FORBIDDEN_FINAL = (
    r"(?i)</?tool_call\b[^>]*>|</?function\b[^>]*>|<function\s*=|</?parameter\b[^>]*>|<parameter\s*=|\bsearch_api\b"
    r"|\blink_summary_tool\b|\bseal_memory_tool\b|\bread_memory_tool\b|\btool_calls?\b|\btool\s+calls?\b"
)
RATE_LIMIT_MARKERS = ("qpm limit", "rate limit", "rate_limit", "too many requests", "429", "quota", "throttl")
NO_RETRY_MARKERS = (
    "maximum context length", "context length", "context window", "prompt too long", "too many tokens", "input is too long",
    "request too large", "token limit", "data_inspection_failed", "inappropriate content",
    "input data may contain inappropriate content", "-4316",
)
RETRY_MARKERS = (
    "qpm limit", "quota", "rate limit", "rate_limit", "too many requests", "429", "temporarily unavailable",
    "service unavailable", "503", "502", "504", "500", "connection aborted", "connection reset", "connection refused",
    "connection error", "connection timeout", "timeout", "timed out", "read timeout", "connect timeout", "request timeout",
    "network error", "network unreachable", "ssl error", "eof occurred", "internal server error", "bad gateway",
    "gateway timeout",
)
TABLE_BENCHMARK = "widesearch_200"
# -------------------------------------------------------------------------------------------


def strip_artifacts(c: Column) -> Column:
    """Drop a surrounding code fence."""
    opened = F.regexp_replace(S.strip(c), r"^```[A-Za-z0-9_-]*\s*", "")
    return S.strip(F.regexp_replace(opened, r"\s*```\s*$", ""))


def first_group(text: Column, pattern: str) -> Column:
    """First match's group, null without a match."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0))


def after_thinking(text: Column) -> Column:
    return F.substring_index(text, THINK_END, -1)


def _good_table(lines: Column) -> Column:
    ruled = F.exists(lines, lambda x: x.rlike(X.SEPARATOR_LINE) & F.contains(x, F.lit("-")))
    return (F.size(lines) >= 3) & ruled


def _is_pipe_line(line: Column) -> Column:
    return line.startswith("|") & line.endswith("|") & (X.pipe_count(line) >= 3)


def markdown_table(content: Column) -> Column:
    """Last valid fenced table, else the last valid run of pipe lines; null when there is none."""
    lines_of = lambda text: F.transform(F.split(text, X.LINE_BREAK), S.strip)
    fenced = F.filter(
        F.regexp_extract_all(content, F.lit(MARKDOWN_FENCE), F.lit(1)), lambda t: _good_table(F.filter(lines_of(t), _is_pipe_line))
    )
    last = F.try_element_at(fenced, F.lit(-1))
    marked = F.array_join(
        F.transform(lines_of(content), lambda line: F.when(_is_pipe_line(line), line).otherwise(F.lit("\x00"))), "\n"
    )
    runs = F.transform(F.split(marked, "\x00"), lambda b: F.filter(F.split(b, "\n"), lambda line: line != ""))
    bare = F.array_join(F.try_element_at(F.filter(runs, _good_table), F.lit(-1)), "\n")
    return F.coalesce(F.concat(F.lit("```markdown\n"), S.strip(last), F.lit("\n```")), bare)


def parse_answers(outputs: DataFrame, strict: bool = False, name: str = "parsed_answer") -> DataFrame:
    """Final answer of each output (content, reasoning, benchmark), null when none is found.

    ``strict`` accepts only a visible, labelled answer; otherwise the whole text is the last resort.
    """
    content = S.strip(F.coalesce("content", F.lit("")))
    df = outputs.withColumn("_c", content)
    tail, head = S.strip(after_thinking(F.col("_c"))), S.strip(F.substring_index("_c", THINK_END, 1))
    thinking = F.contains("_c", F.lit(THINK_END))
    visible = F.when(thinking & (tail == ""), F.lit("") if strict else head).when(thinking, tail).otherwise(F.col("_c"))
    df = df.withColumn("_v", visible)
    tagged = S.strip(F.substring_index(F.substring_index("_v", "<answer>", -1), "</answer>", 1))
    df = df.withColumn("_v", F.when(F.contains("_v", F.lit("<answer>")), tagged).otherwise(F.col("_v")))
    if not strict:
        df = df.withColumn("_v", F.when(F.col("_v") == "", S.strip(F.coalesce("reasoning", F.lit("")))).otherwise(F.col("_v")))
    wants_table = F.coalesce(F.col("benchmark") == TABLE_BENCHMARK, F.lit(False))
    df = df.withColumn("_t", F.when(wants_table & F.contains("_v", F.lit("|")), markdown_table(F.col("_v"))))
    df = df.withColumn("_l", strip_artifacts(first_group(F.col("_v"), ANSWER_LABEL)))
    phrase = S.strip(F.get(F.split(first_group(F.col("_v"), ANSWER_PHRASE), X.LINE_BREAK), F.lit(0)))
    phrase = S.strip(F.substring_index(phrase, "。", 1))
    df = df.withColumn("_p", strip_artifacts(F.get(F.split(phrase, r"\.\s+(?=\S)", 2), F.lit(0))))
    labelled = F.coalesce(F.col("_l") != "", F.lit(False))
    pointer = wants_table & F.coalesce(F.col("_l").rlike(TABLE_POINTER), F.lit(False))
    answer = (
        F.when(F.col("_v") == "", F.lit(None))
        .when(F.col("_t").isNotNull(), F.col("_t"))
        .when(labelled & ~pointer, F.col("_l"))
        .when(labelled, F.lit(None))
        .when(F.coalesce(F.col("_p") != "", F.lit(False)), F.col("_p"))
    )
    if not strict:
        answer = answer.otherwise(strip_artifacts(F.col("_v")))
    return df.withColumn(name, answer).drop("_c", "_v", "_t", "_l", "_p")


def parse_reasons(outputs: DataFrame) -> DataFrame:
    visible = outputs.withColumn("_v", after_thinking(F.col("content")))
    reason = F.coalesce(*[S.strip(first_group(F.col("_v"), p)) for p in REASON_PATTERNS])
    return visible.withColumn("reason", reason).drop("_v")


def answer_problem(answer: Column) -> Column:
    """Why an answer is not acceptable; null for a valid one."""
    low = F.lower(S.strip(answer))
    problem = F.when(S.is_blank(answer), F.lit("empty_answer")).when(low == "answer:", F.lit("empty_answer_prefix"))
    for phrase in REFUSALS:
        problem = problem.when(low.startswith(phrase), F.lit(f"refusal_response:{phrase[:20]}"))
    return problem


def malformed_call(text: Column) -> Column:
    return text.rlike(MALFORMED_CALL)


def with_final_checks(outputs: DataFrame) -> DataFrame:
    """Add forbidden and usable flags for an answer given without further tool use."""
    df = parse_answers(outputs, strict=True, name="_strict")
    forbidden = F.col("has_tool_calls") | F.coalesce(F.col("content").rlike(FORBIDDEN_FINAL), F.lit(False))
    return df.withColumn("forbidden", forbidden).withColumn(
        "usable", ~F.col("forbidden") & answer_problem(F.col("_strict")).isNull()
    ).drop("_strict")


def hit_output_limit(completion_tokens: Column, finish_reason: Column, max_tokens: int, cap: int) -> Column:
    """Cut-off test: known token counts decide, the finish reason only stands in for them."""
    return F.when(completion_tokens.isNotNull(), completion_tokens >= min(max_tokens, cap)).otherwise(
        F.coalesce(finish_reason == "length", F.lit(False))
    )


def json_text(content: Column) -> Column:
    """Fenced JSON, else the text from the first to the last brace."""
    opening = F.locate("{", content)
    closing = F.length(content) - F.locate("}", F.reverse(content)) + 1
    outer = F.when(
        (opening > 0) & F.contains(content, F.lit("}")) & (closing > opening), F.substr(content, opening, closing - opening + 1)
    )
    return F.coalesce(first_group(content, JSON_FENCE), outer)


def json_object(content: Column) -> Column:
    """First JSON object among: fenced ones from the last, the whole text, the outermost braces."""
    text = S.strip(content)
    opening = F.locate("{", text)
    closing = F.length(text) - F.locate("}", F.reverse(text)) + 1
    outer = F.when(F.contains(text, F.lit("}")) & (opening > 0) & (closing > opening), F.substr(text, opening, closing - opening + 1))
    fenced = F.reverse(F.regexp_extract_all(content, F.lit(JSON_OBJECT_FENCE), F.lit(1)))
    values = F.transform(F.concat(fenced, F.array(text, outer)), F.try_parse_json)
    return F.get(F.filter(values, V.is_object), F.lit(0))


RUBRIC_TYPE = "array<struct<id:string,description:string,satisfied:boolean>>"


def parse_rubrics(outputs: DataFrame) -> DataFrame:
    """Add the rubrics found in content: a JSON object's list, else numbered lines."""
    df = outputs.withColumn("_j", F.try_parse_json(json_text(F.col("content"))))
    items = V.at("_j", "$.rubrics").try_cast("array<variant>")
    from_json = F.transform(
        F.filter(F.transform(items, lambda v, i: F.struct(v.alias("v"), (i + 1).alias("n"))), lambda e: V.is_object(e["v"])),
        lambda e: F.struct(
            F.coalesce(V.text_at(e["v"], "$.id"), e["n"].cast("string")).alias("id"),
            F.coalesce(V.text_at(e["v"], "$.description"), F.lit("")).alias("description"),
            V.truthy(V.at(e["v"], "$.satisfied")).alias("satisfied"),
        ),
    )
    lines = F.filter(F.split("content", X.LINE_BREAK), lambda line: line.rlike(RUBRIC_LINE))
    from_lines = F.transform(
        lines,
        lambda line: F.struct(
            F.regexp_extract(line, RUBRIC_LINE, 1).cast("bigint").cast("string").alias("id"),
            S.strip(F.regexp_extract(line, RUBRIC_LINE, 2)).alias("description"),
            F.lit(False).alias("satisfied"),
        ),
    )
    return df.withColumn("rubrics", F.coalesce(from_json.cast(RUBRIC_TYPE), from_lines.cast(RUBRIC_TYPE))).drop("_j")


def parse_decisions(outputs: DataFrame) -> DataFrame:
    """Add decision, critique, suggestion and rubric checks of a verification output."""
    visible = F.when(F.contains("content", F.lit(THINK_END)), S.strip(after_thinking(F.col("content")))).otherwise(F.col("content"))
    df = outputs.withColumn("_v", visible).withColumn("_j", F.try_parse_json(json_text(F.col("_v"))))
    df = df.withColumns({"_d": F.upper(V.text_at("_j", "$.decision")), "_c": V.text_at("_j", "$.critique")})
    upper = F.upper("_v")
    has = lambda *words: F.lit(False) if not words else F.contains(upper, F.lit(words[0])) | has(*words[1:])
    from_json = V.is_object("_j") & (F.coalesce("_c", F.lit("")) != "")
    decision = (
        F.when(F.coalesce("content", F.lit("")) == "", F.lit("REVISE_ANSWER"))
        .when(from_json, F.when(F.col("_d").isin(*DECISIONS), F.col("_d")).otherwise(F.lit("REVISE_ANSWER")))
        .when(has("REVISE_RUBRIC", "REVISE RUBRIC"), F.lit("REVISE_RUBRIC"))
        .when(has("REVISE_ANSWER", "REVISE ANSWER"), F.lit("REVISE_ANSWER"))
        .when(has("PASS") & ~has("REVISE"), F.lit("PASS"))
    )
    critique = F.when(F.coalesce("content", F.lit("")) == "", F.lit(None)).when(from_json, F.col("_c")).otherwise(
        F.substring("_v", 1, CRITIQUE_CHARS)
    )
    checks = F.filter(V.at("_j", "$.rubric_checks").try_cast("array<variant>"), lambda c: V.present(V.at(c, "$.id")))
    pairs = F.transform(
        checks,
        lambda c: F.struct(V.text_at(c, "$.id").alias("id"), V.truthy(V.at(c, "$.satisfied")).alias("satisfied")),
    )
    none = F.array().cast("array<struct<id:string,satisfied:boolean>>")
    return df.withColumns(
        {
            "decision": decision,
            "critique": critique,
            "suggestion": F.when(from_json, V.text_at("_j", "$.suggestion")),
            "checks": F.when(from_json, F.coalesce(pairs, none)).otherwise(none),
        }
    ).drop("_v", "_j", "_d", "_c")


def turn_retry_reason(outputs: DataFrame) -> DataFrame:
    """Which turn-level retry an output triggers, by state; null when it is fine.

    Columns used: content, reasoning, benchmark, state, has_tool_calls.
    """
    df = parse_answers(outputs, strict=True, name="_a")
    df = parse_decisions(parse_rubrics(df))
    calls = F.col("has_tool_calls")
    full = F.concat(F.coalesce("content", F.lit("")), F.coalesce("reasoning", F.lit("")))
    reason = (
        F.when(calls, F.lit(None))
        .when(malformed_call(full), F.lit("malformed_tool_call"))
        .when((F.col("state") == "RUBRIC") & (F.size("rubrics") == 0), F.lit("fsm_parse.RUBRIC"))
        .when((F.col("state") == "ANSWER") & F.col("_a").isNull(), F.lit("fsm_parse.ANSWER"))
        .when((F.col("state") == "VERIFY") & F.col("decision").isNull(), F.lit("fsm_parse.VERIFY"))
    )
    return df.withColumn("retry_reason", reason).drop("_a", "rubrics", "decision", "critique", "suggestion", "checks")


def error_class(message: Column) -> Column:
    """``fatal`` (deny list first), ``rate_limited``, ``retryable`` or ``other``."""
    low = F.lower(message)
    any_of = lambda words: low.rlike("|".join(w.replace("-", r"\-") for w in words))
    return (
        F.when(any_of(NO_RETRY_MARKERS), F.lit("fatal"))
        .when(any_of(RATE_LIMIT_MARKERS), F.lit("rate_limited"))
        .when(any_of(RETRY_MARKERS), F.lit("retryable"))
        .otherwise(F.lit("other"))
    )


def retry_pressure(errors: DataFrame) -> DataFrame:
    low = F.lower("error")
    return errors.agg(F.count(F.lit(1)).alias("retries"), F.count_if(low.rlike("|".join(RATE_LIMIT_MARKERS))).alias("rate_limit_hits"))


def submitted_answers(messages: DataFrame, submit_tool: str = "submit_tool") -> DataFrame:
    """Answer of runs that ended with a successful submission: one row per run.

    Input: run, seq, role, content, tool_name (of an assistant's first call), ok (tool messages).
    """
    prev = lagged(messages, ["run"], "seq", F.struct("role", "tool_name"), 1, "_prev")
    last = latest_by(prev, ["run"], ["seq"])
    before = F.get("_prev", F.lit(0))
    ended = (
        (F.col("role") == "tool") & F.coalesce(F.col("ok"), F.lit(False)) & (before["role"] == "assistant") & (before["tool_name"] == submit_tool)
    )
    whole, line1 = F.try_parse_json("content"), F.try_parse_json(F.substring_index("content", "\n", 1))
    payload = F.when(V.is_object(whole), whole).when(V.is_object(line1), line1)
    answer = F.nullif(S.strip(F.coalesce(V.text_at(payload, "$.answer"), F.lit(""))), F.lit(""))
    return last.select("run", F.when(ended, answer).alias("answer"))


def final_answers(messages: DataFrame, tool_sets: DataFrame, submit_tool: str = "submit_tool") -> DataFrame:
    """Answer of each run by its tools (run, tools): what was submitted where the submit tool is among them, else the last text.

    ``messages`` as for `submitted_answers`. A run without messages, or without an answer, has null.
    """
    submits = F.coalesce(F.array_contains("tools", submit_tool), F.lit(False))
    of = lambda mode: messages.join(tool_sets.filter(mode).select("run"), "run", "left_semi")
    last = latest_by(of(~submits), ["run"], ["seq"]).select("run", "content", F.lit(None).cast("string").alias("reasoning"), F.lit("").alias("benchmark"))
    read = submitted_answers(of(submits), submit_tool).unionByName(parse_answers(last, name="answer").select("run", "answer"))
    return tool_sets.select("run", F.when(submits, F.lit("submit")).otherwise(F.lit("text")).alias("mode")).join(read, "run", "left")


def parse_report(parsed: DataFrame) -> DataFrame:
    """Outputs per benchmark, state, parse status and failing rule."""
    return parsed.groupBy("benchmark", "state", "parse_status", "rule").agg(F.count(F.lit(1)).alias("outputs"))
