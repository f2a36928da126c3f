"""Judge replies to verdicts, judge request texts, and re-judging of finished logs."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.functions import variants as V
from trailmark.operators.parsing import first_group, json_object

# ---- fixed values -------------------------------------------------------------------------
FLAT_OBJECT = r"(\{[^{}]*\})"
DECISION_FIELD = r'(?i)"decision"\s*:\s*(true|false)\b'
REASONING_FIELD = r'(?s)"reasoning"\s*:\s*"(.*)"\s*,\s*"decision"\s*:'
LABELS = r"(?im)^\s*(extracted_final_answer|reasoning|correct|confidence)\s*:\s*"
CORRECT_LINE = r"(?im)^\s*correct\s*:\s*(yes|no)\b"
ZH_VERDICT = r"结论\s*[:：]\s*(正确|错误)"
ZH_REASON = r"(?s)解释\s*[:：]\s*(.*?)(?=\n\s*结论\s*[:：]|\z)"
ANSWER_TYPES = ("Single Answer", "Set Answer")
RESPONSE_FIELDS = ("response", "assistant_response", "final_response", "raw_response")
WRAPPED_ANSWER = ("Explanation: Final answer extracted from a previous rollout.\nExact Answer: ", "\nConfidence: 100%")
VERDICT = "struct<is_correct:boolean,score:double,reasoning:string,status:string>"
# -------------------------------------------------------------------------------------------


def _verdict(parsed: Column, correct: Column, score: Column, reasoning: Column) -> Column:
    ok = F.coalesce(parsed, F.lit(False))
    right = ok & F.coalesce(correct, F.lit(False))
    return F.struct(
        right.alias("is_correct"),
        F.when(ok, score).otherwise(F.lit(0.0)).cast("double").alias("score"),
        F.when(ok, F.coalesce(reasoning, F.lit(""))).otherwise(F.lit("")).alias("reasoning"),
        F.when(ok, F.lit("SUCCESS")).otherwise(F.lit("EXTRACTION_FAILED")).alias("status"),
    )


def decision_verdict(reply: Column) -> Column:
    """JSON decision; broken JSON is read by pattern. The score stays zero even when correct."""
    return S.let(first_group(reply, FLAT_OBJECT), lambda obj: S.let(F.struct(obj.alias("t"), F.try_parse_json(obj).alias("v")), _decision_of))


def _decision_of(e: Column) -> Column:
    obj, v = e["t"], e["v"]
    whole = F.coalesce(V.kind(V.at(v, "$.decision")).isNotNull() & V.kind(V.at(v, "$.reasoning")).isNotNull(), F.lit(False))
    loose = F.lower(first_group(obj, DECISION_FIELD))
    correct = F.when(whole, V.truthy(V.at(v, "$.decision"))).otherwise(loose == "true")
    reason = F.when(whole, V.text_at(v, "$.reasoning")).otherwise(first_group(obj, REASONING_FIELD))
    return _verdict(whole | loose.isNotNull(), correct, F.lit(0.0), reason)


def labelled_fields(reply: Column) -> Column:
    """Map of label to text for replies made of ``label: text`` parts; a later part wins."""
    marked = F.regexp_replace(reply, LABELS, "\x00$1\x01")
    parts = F.filter(F.split(marked, "\x00"), lambda p: F.contains(p, F.lit("\x01")))
    entries = F.transform(
        parts,
        lambda p: F.struct(
            F.lower(F.substring_index(p, "\x01", 1)).alias("k"), S.strip(F.substring_index(p, "\x01", -1)).alias("v")
        ),
    )
    return entries


def labelled_field(reply: Column, name: str) -> Column:
    return F.try_element_at(F.filter(labelled_fields(reply), lambda e: e["k"] == name), F.lit(-1))["v"]


def labelled_verdict(reply: Column) -> Column:
    hit = F.lower(first_group(reply, CORRECT_LINE))
    return _verdict(hit.isNotNull(), hit == "yes", (hit == "yes").cast("double"), labelled_field(reply, "reasoning"))


def zh_verdict(reply: Column) -> Column:
    hit = first_group(reply, ZH_VERDICT)
    return _verdict(hit.isNotNull(), hit == "正确", (hit == "正确").cast("double"), S.strip(first_group(reply, ZH_REASON)))


def exact_hit(answer: Column, truths: Column) -> Column:
    """The answer equals one of the truths once trimmed, so no judge is needed."""
    return F.exists(truths, lambda t: S.strip(t) == S.strip(answer))


def component_payload(reply: Column) -> Column:
    """The correctness object of a component reply, shape-checked; empty details are allowed here."""
    return S.let(S.strip(reply), lambda text: F.when(F.upper(text) != "NULL", S.let(_unfenced(text), _payload_of)))


def _unfenced(text: Column) -> Column:
    newline = F.locate("\n", text)
    fence = F.length(text) - F.locate("```", F.reverse(text)) - 1
    inner = S.strip(F.substr(text, newline + 1, fence - newline - 1))
    return F.when(text.startswith("```") & (newline > 0) & (fence > newline), inner).otherwise(text)


def _payload_of(inner: Column) -> Column:
    opening = F.locate("{", inner)
    closing = F.length(inner) - F.locate("}", F.reverse(inner)) + 1
    outer = F.when((opening > 0) & F.contains(inner, F.lit("}")) & (closing > opening), F.substr(inner, opening, closing - opening + 1))
    values = F.filter(F.transform(F.array(inner, outer), F.try_parse_json), V.is_object)
    part = V.at(F.get(values, F.lit(0)), '$["Answer Correctness"]')
    fields = lambda p: F.struct(
        V.is_object(p).alias("ok"),
        V.at(p, "$.Explanation").alias("explanation"),
        V.at(p, '$["Correctness Details"]').alias("details"),
        V.at(p, '$["Excessive Answers"]').alias("excessive"),
    )
    return S.let(part, lambda p: S.let(fields(p), _checked))


def _checked(p: Column) -> Column:
    all_of = lambda values, kind: F.coalesce(F.forall(values, lambda x: V.kind(x) == kind), F.lit(False))
    good = (
        p["ok"]
        & F.coalesce(V.kind(p["explanation"]) == "STRING", F.lit(False))
        & V.is_object(p["details"])
        & all_of(F.map_values(p["details"].try_cast("map<string,variant>")), "BOOLEAN")
        & F.coalesce(V.kind(p["excessive"]).startswith("ARRAY"), F.lit(False))
        & all_of(p["excessive"].try_cast("array<variant>"), "STRING")
    )
    return F.when(
        good,
        F.struct(
            p["explanation"].try_cast("string").alias("explanation"),
            p["details"].try_cast("map<string,boolean>").alias("details"),
            p["excessive"].try_cast("array<string>").alias("excessive"),
        ),
    )


def component_scores(replies: DataFrame, truth_size: str) -> DataFrame:
    """Component precision, recall and F1 per reply.

    True details are true positives, false ones false negatives, excess answers false positives. Empty
    details count only together with excess answers: all zeros, every truth a false negative.
    """
    df = replies.withColumn("_p", component_payload(F.col("reply")))
    found = F.filter(F.map_values("_p.details"), lambda x: x)
    df = df.withColumns({"_n": F.size("_p.details"), "_tp": F.size(found), "_fp": F.size("_p.excessive")})
    scored = F.coalesce(F.col("_p").isNotNull() & ((F.col("_n") > 0) | (F.col("_fp") > 0)), F.lit(False))
    only_excess = scored & (F.col("_n") == 0)
    tp = F.when(scored, F.col("_tp")).cast("bigint")
    fp = F.when(scored, F.col("_fp")).cast("bigint")
    fn = F.when(only_excess, F.col(truth_size)).when(scored, F.col("_n") - F.col("_tp")).cast("bigint")
    df = df.withColumns({"true_positives": tp, "false_positives": fp, "false_negatives": fn})
    df = df.withColumns(
        {
            "precision": F.when(scored, S.ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_positives"))),
            "recall": F.when(scored, S.ratio(F.col("true_positives"), F.col("true_positives") + F.col("false_negatives"))),
        }
    )
    perfect = scored & (F.col("_n") > 0) & (F.col("_tp") == F.col("_n")) & (F.col("_fp") == 0)
    return df.withColumns(
        {
            "f1": F.when(scored, S.harmonic_mean(F.col("precision"), F.col("recall"))),
            "is_correct": perfect,
            "explanation": F.when(scored, F.col("_p.explanation")),
            "status": F.when(scored, F.lit("SUCCESS")).otherwise(F.lit("EXTRACTION_FAILED")),
        }
    ).drop("_p", "_n", "_tp", "_fp")


def component_verdict(reply: Column) -> Column:
    return S.let(component_payload(reply), _component_of)


def _component_of(p: Column) -> Column:
    n = F.size(p["details"])
    right = F.forall(F.map_values(p["details"]), lambda x: x) & (F.size(p["excessive"]) == 0) & (n > 0)
    usable = p.isNotNull() & ((n > 0) | (F.size(p["excessive"]) > 0))
    return _verdict(usable, right, F.coalesce(right, F.lit(False)).cast("double"), p["explanation"])


def table_verdict(table_scores: Column) -> Column:
    """Verdict of a scored table: a row of ``score_tables`` as a struct (is_correct, row_f1, complete_status)."""
    return _verdict(table_scores["complete_status"] == "SUCCESS", table_scores["is_correct"], table_scores["row_f1"], F.lit(""))


#: Verifiers by name. A verifier is a function of columns; its parameters name the columns it reads, out of
#: question, truth, answer, metadata, reply and table_scores.
VERIFIERS: dict[str, Callable[..., Column]] = {
    "decision": decision_verdict,
    "labelled": labelled_verdict,
    "zh_label": zh_verdict,
    "component": component_verdict,
    "table": table_verdict,
}
UNKNOWN_VERIFIER = "UNKNOWN_VERIFIER"


def register_verifier(name: str, verdict: Callable[..., Column]) -> None:
    """Add a verifier: a function from the columns that its parameters name to a verdict struct column."""
    if name in VERIFIERS:
        raise ValueError(f"verifier {name!r} is already registered")
    VERIFIERS[name] = verdict


def parse_verdicts(replies: DataFrame, verifiers: dict[str, Callable[..., Column]] | None = None) -> DataFrame:
    """Add the verdict of each row by its ``verifier`` column; one expression, no dispatch per row in Python.

    An unknown or missing verifier, or one whose columns the table lacks, gives the status UNKNOWN_VERIFIER and is not correct.
    """
    chosen = F.struct(F.lit(False).alias("is_correct"), F.lit(0.0).alias("score"), F.lit("").alias("reasoning"), F.lit(UNKNOWN_VERIFIER).alias("status")).cast(VERDICT)
    for name, fn in (verifiers or VERIFIERS).items():
        reads = list(inspect.signature(fn).parameters)
        if set(reads) <= set(replies.columns):
            chosen = F.when(F.col("verifier") == name, fn(*[F.col(c) for c in reads])).otherwise(chosen)
    return replies.withColumn("verdict", chosen)


def column_scores(replies: DataFrame) -> DataFrame:
    """Scores 0/1 per graded item of a reply: (request keys, n_items, reply) to one row per item.

    Booleans count, any other value and a failed reply score zero.
    """
    keys = [c for c in replies.columns if c not in ("reply", "n_items")]
    df = replies.withColumn("_m", json_object(F.col("reply")).try_cast("map<string,variant>"))
    items = df.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.col("n_items") - 1)).alias("idx"))
    value = F.try_element_at(F.col("_m"), F.concat(F.lit("idx_"), F.col("idx").cast("string")))
    k = V.kind(value)
    number = F.when(k == "BOOLEAN", (value.try_cast("string") == "true").cast("double")).when(
        k.rlike(V.NUMERIC_KINDS), value.try_cast("double")
    )
    return items.select(*keys, "idx", F.when(number == 1.0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("score"))


# ---- request texts ----
DECISION_TEMPLATE = (
    "Decide whether the answer equals the reference.\n\nQuestion: {question}\n\nGround truth: {truth}\n\nUser answer: {answer}\n\n"
    'Reply with JSON: {"reasoning": "...", "decision": true/false}'
)
LABELLED_TEMPLATE = (
    "Judge the [response] to the [question] against the [correct_answer].\n\n[question]: {question}\n\n[response]: {answer}\n\n"
    "[correct_answer]: {truth}\n\nReply with lines extracted_final_answer:, reasoning:, correct: yes/no, confidence:"
)
COMPONENT_TEMPLATE = (
    "Rate each part of the correct answer.\n\nUser Prompt:\n<prompt>\n{question}\n</prompt>\n\nPrompt Type: {type}\n\n"
    "Correct Answer:\n<answer>\n{truth}\n</answer>\n\nAI Response:\n<response>\n{answer}\n</response>\n\nRating:\n"
)
ZH_TEMPLATE = "判断[回答]是否正确。\n\n[原问题]: {question}\n\n[正确答案]: {truth}\n\n[回答]: {answer}\n\n依次给出：最终答案、解释、结论（正确/错误）。"


def fill(template: str, **values: Column) -> Column:
    """A template literal with its placeholders replaced, as one concatenation."""
    parts: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, key = min(hits)
        parts += [F.lit(rest[:at]), F.coalesce(values[key], F.lit(""))]
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts)


def truth_as_json(truths: Column) -> Column:
    """A single truth bare, several as a JSON list."""
    return F.when(F.size(truths) == 1, F.get(truths, F.lit(0))).otherwise(F.to_json(truths))


def judge_requests(rows: DataFrame) -> DataFrame:
    """Request text per answer by ``verifier``; a component request without a valid answer type has none."""
    q, a, t = F.col("question"), F.col("answer"), F.col("ground_truth")
    joined = F.array_join(t, ", ")
    kind = S.strip(F.coalesce("answer_type", F.lit("")))
    v = F.col("verifier")
    text = (
        F.when(v == "decision", fill(DECISION_TEMPLATE, question=q, truth=joined, answer=a))
        .when(v == "labelled", fill(LABELLED_TEMPLATE, question=q, truth=truth_as_json(t), answer=a))
        .when(v == "zh_label", fill(ZH_TEMPLATE, question=q, truth=joined, answer=a))
        .when((v == "component") & kind.isin(*ANSWER_TYPES), fill(COMPONENT_TEMPLATE, question=q, truth=truth_as_json(t), answer=a, type=kind))
    )
    return rows.withColumns(
        {"request": text, "request_error": F.when(text.isNull(), F.lit("invalid_answer_type"))}
    )


def column_requests(pairs: DataFrame, chunk: int = 200) -> DataFrame:
    """Grading requests over matched cells: (instance_id, column_name, idx, response, target, criterion).

    A request holds ``chunk`` cells, so a column of any length becomes many bounded requests.
    """
    numbered = pairs.withColumn("chunk", F.floor(F.col("idx") / chunk).cast("bigint"))
    item = F.struct(F.concat(F.lit("idx_"), F.col("idx").cast("string")).alias("k"), F.struct("response", "target").alias("v"))
    cells = numbered.groupBy("instance_id", "column_name", "chunk", "criterion").agg(
        F.array_sort(F.collect_list(F.struct("idx", item.alias("e")))).alias("_e"), F.count(F.lit(1)).alias("n_items")
    )
    body = F.to_json(F.map_from_entries(F.transform("_e", lambda e: e["e"])))
    return cells.select(
        "instance_id",
        "column_name",
        "chunk",
        "n_items",
        F.concat(F.lit("Criterion: "), F.coalesce("criterion", F.lit("")), F.lit("\nCells: "), body).alias("request"),
    )


def alignment_vocabulary(rows: DataFrame) -> DataFrame:
    """Both vocabularies of a column, one row per distinct value, for key or header alignment.

    Input: instance_id, column_name, side, value. The request stays in rows; a caller who renders one
    text per instance chooses how many values it takes.
    """
    sides = rows.groupBy("instance_id", "column_name", "value").agg(
        F.bool_or(F.col("side") == "pred").alias("in_response"), F.bool_or(F.col("side") == "gold").alias("in_reference")
    )
    return sides.filter(~(F.col("in_response") & F.col("in_reference")))


# ---- review rows and re-judging ----
def review_records(rollouts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Review rows: rollouts with their verdicts; no answer means a failed extraction."""
    joined = rollouts.join(verdicts, ["question_id", "rollout_idx"], "left")
    no_answer = F.coalesce("answer", F.lit("")) == ""
    judged = F.col("is_correct").isNotNull()
    return joined.withColumns(
        {
            "error": F.when(no_answer, F.lit("no answer found")),
            "judge_complete_status": F.when(no_answer, F.lit("EXTRACTION_FAILED")).when(judged, F.col("status")),
            "is_correct": F.when(no_answer, F.lit(False)).when(judged, F.col("is_correct")),
            "score": F.when(no_answer, F.lit(0.0)).when(judged, F.col("score")),
        }
    ).drop("status")


def candidate_responses(rows: DataFrame, field: str | None = None, wrap: bool = True) -> DataFrame:
    """Text to judge and the field it came from."""
    if field is not None:
        return rows.withColumns({"candidate": F.coalesce(F.col(field), F.lit("")), "candidate_field": F.lit(field)})
    text, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in reversed([f for f in RESPONSE_FIELDS if f in rows.columns]):
        has = F.coalesce(F.col(f) != "", F.lit(False))
        text, name = F.when(has, F.col(f)).otherwise(text), F.when(has, F.lit(f)).otherwise(name)
    answer = F.concat(F.lit(WRAPPED_ANSWER[0]), F.col("answer"), F.lit(WRAPPED_ANSWER[1])) if wrap else F.col("answer")
    return rows.withColumns(
        {"candidate": F.coalesce(text, answer, F.lit("")), "candidate_field": F.coalesce(name, F.lit("answer"))}
    )


def official_results(rows: DataFrame) -> DataFrame:
    """Merge labelled replies into review rows: official fields and disagreement, or the error variant.

    Input: review row with is_correct (boolean), question, truth_size, reply and call_error.
    """
    verdict = labelled_verdict(F.col("reply"))
    error = (
        F.when(F.coalesce("question", F.lit("")) == "", F.lit("no question"))
        .when(F.col("truth_size") == 0, F.lit("no ground truth"))
        .otherwise(F.col("call_error"))
    )
    df = rows.withColumns({"_v": verdict, "official_judge_error": error})
    good = F.col("official_judge_error").isNull()
    return df.withColumns(
        {
            "official_is_correct": good & F.col("_v.is_correct"),
            "official_score": F.when(good, F.col("_v.score")).otherwise(F.lit(0.0)),
            "official_judge_reasoning": F.when(good, F.col("_v.reasoning")).otherwise(F.lit("")),
            "official_judge_complete_status": F.when(good, F.col("_v.status")).otherwise(F.lit("ERROR")),
            "official_judge_extracted_final_answer": F.when(good, labelled_field(F.col("reply"), "extracted_final_answer")),
            "official_judge_confidence": F.when(good, labelled_field(F.col("reply"), "confidence")),
            "official_disagrees_with_existing": F.when(
                good & F.col("is_correct").isNotNull(), F.col("is_correct") != F.col("_v.is_correct")
            ),
        }
    ).drop("_v")


def with_recommended_judge(rows: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Attach the recommended judge of the benchmark and whether the used one matches it."""
    joined = rows.join(benchmarks.select("benchmark", "verifier", "recommended_judge"), "benchmark", "left")
    return joined.withColumn(
        "matches_configured_judge",
        F.when(F.col("recommended_judge").isNotNull(), F.contains(F.lower("judge_model"), F.lower("recommended_judge"))),
    )
