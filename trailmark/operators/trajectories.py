"""Trajectory analytics over message, call and state tables.

Running counts and look-backs per run go through ``plans.blocks``, so one very long run is spread over
tasks instead of being one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import scalars as S
from trailmark.functions import variants as V
from trailmark.plans.blocks import lagged, null_safe_join, row_numbers, running_sums
from trailmark.plans.keyed import latest_by

# ---- fixed values -------------------------------------------------------------------------
MAX_CYCLE = 3
MEMORY_TOOLS = ("seal_memory_tool",)
SUBMIT_TOOLS = ("submit_tool",)
RESERVED_TOKENS = 4000
MIN_SEAL_TOKENS = 20000
MAX_SEALS = 5
STATES = ("RUBRIC", "ANSWER", "VERIFY")
# -------------------------------------------------------------------------------------------


def with_segment(messages: DataFrame, seal: Column, name: str = "segment", seq: str = "seq") -> DataFrame:
    """Segment number: seals before this row of the run."""
    return running_sums(messages, ["run"], seq, {name: F.coalesce(seal.cast("bigint"), F.lit(0))}, before=True)


def repeat_cycle(sig: Column, before: list[Column], max_cycle: int = MAX_CYCLE) -> Column:
    """Length of the cycle the history ends on, shortest first; null when there is none."""
    s = [sig, *before]
    same = lambda a, b: F.coalesce(s[a] == s[b], F.lit(False))
    checks = [same(0, 1) & same(1, 2), same(0, 2) & same(1, 3), same(0, 3) & same(1, 4) & same(2, 5)]
    out = F.lit(None).cast("int")
    for n in range(min(max(max_cycle, 0), MAX_CYCLE), 0, -1):
        out = F.when(checks[n - 1], F.lit(n)).otherwise(out)
    return out


def loop_calls(calls: DataFrame, max_cycle: int = MAX_CYCLE) -> DataFrame:
    """Calls with the repeat cycle each one completes.

    Input: run, seq, turn, name, arguments, is_seal. Turns that contain a memory tool are not recorded,
    and the history starts anew after a seal. Blocked calls stay in the history.
    """
    in_turn = Window.partitionBy("run", "turn")
    with_memory = F.bool_or(F.col("name").isin(*MEMORY_TOOLS)).over(in_turn)
    df = with_segment(calls, F.col("is_seal")).withColumn("_mem", with_memory).filter(~F.col("_mem"))
    sig = F.sha2(V.call_signature(F.col("name"), F.coalesce("arguments", F.lit("{}"))), 256)
    df = df.select("run", "seq", "segment", sig.alias("_sig"))
    depth = 2 * MAX_CYCLE - 1
    prev = lagged(df, ["run"], "seq", F.struct("segment", "_sig"), depth, "_prev")
    earlier = [
        F.when(F.get("_prev", F.lit(i))["segment"] == F.col("segment"), F.get("_prev", F.lit(i))["_sig"]) for i in range(depth)
    ]
    return prev.select("run", "seq", "segment", repeat_cycle(F.col("_sig"), earlier, max_cycle).alias("cycle"))


def _counted_states(log: DataFrame) -> DataFrame:
    """State log rows with their transition number, the errors of the run so far and those before the row."""
    error = (F.col("state") == "ERROR").cast("bigint")
    sums = {"transition": F.col("state").isin(*STATES).cast("bigint"), "_errors": error}
    return running_sums(log, ["run"], "seq", sums).withColumn("_before", F.col("_errors") - F.coalesce(error, F.lit(0)))


def state_attempts(log: DataFrame) -> DataFrame:
    """Transition number and attempt number of each state log row (run, seq, state).

    The attempt is the run's errors so far less those before the transition began, so one running pass gives both.
    """
    counted = _counted_states(log)
    start = counted.groupBy("run", "transition").agg(F.min("_before").alias("_start"))
    return null_safe_join(counted, start, ["run", "transition"]).withColumn("attempt", F.col("_errors") - F.col("_start")).drop("_errors", "_before", "_start")


def run_rollup(log: DataFrame, max_verify: int = 3) -> DataFrame:
    """Counters per run; turns of an attempt that ended in an error are rolled back.

    Input: run, seq, state, turns, is_seal. A row's turns belong to the attempt it starts.
    """
    per_step = _counted_states(log).groupBy("run", "transition").agg(
        F.max(F.when(F.col("state") != "ERROR", F.col("state"))).alias("state"),
        F.max_by("turns", "_errors").alias("kept_turns"),
        (F.max("_errors") - F.min("_before")).alias("errors"),
        F.sum(F.col("is_seal").cast("bigint")).alias("seals"),
        F.max(F.struct("seq", F.col("state").alias("s"))).alias("_last"),
    )
    of = lambda state, value: F.coalesce(F.sum(F.when(F.col("state") == state, value)), F.lit(0)).cast("bigint")
    verify = F.count_if(F.col("state") == "VERIFY")
    return per_step.groupBy("run").agg(
        F.max("transition").alias("transition_cnt"),
        of("ANSWER", F.col("kept_turns")).alias("answer_turn_count"),
        F.count_if(F.col("state") == "ANSWER").alias("answer_attempt_count"),
        of("VERIFY", F.col("kept_turns")).alias("verify_turn_count"),
        verify.alias("verify_cnt"),
        F.count_if(F.col("state") == "RUBRIC").alias("rubric_cnt"),
        F.sum("errors").alias("error_cnt"),
        F.sum("seals").alias("seal_count"),
        (verify >= max_verify).alias("verify_limit_reached"),
        F.max("_last")["s"].alias("last_state"),
    )


def run_retry_flags(runs: DataFrame, over_turn: int, over_seal: int) -> DataFrame:
    """Whole-run retry tests. A negative threshold disables a test; turns compare with ``>``, seals with ``>=``.

    Input: answer_turn_count, seal_count, exited, has_tool_calls, strict_answer, cut_by_length, malformed.
    """
    unparsed = F.col("strict_answer").isNull()
    final = F.col("exited") & ~F.col("has_tool_calls") & unparsed
    return runs.withColumns(
        {
            "retry_unparseable": final,
            "retry_lengthy": final & (F.col("cut_by_length") | F.col("malformed")),
            "retry_over_turn": F.lit(over_turn >= 0) & (F.col("answer_turn_count") > over_turn) & unparsed,
            "retry_over_seal": F.lit(over_seal >= 0) & (F.col("seal_count") >= over_seal),
        }
    )


def conversation_tail(messages: DataFrame, max_messages: int, max_chars: int) -> DataFrame:
    """The last messages of each run, oldest first, while their JSON length fits the budget.

    The rank filter is applied per map task before the shuffle, so a long run sends few rows.
    """
    newest = Window.partitionBy("run").orderBy(F.col("seq").desc())
    oldest = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    tail = messages.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= max_messages)
    size = F.length(F.to_json(F.struct("role", "content")))
    return tail.withColumn("chars", F.sum(size).over(oldest)).filter(F.col("chars") <= max_chars).drop("_rn")


def latest_assistant(messages: DataFrame) -> DataFrame:
    return latest_by(messages.filter("role = 'assistant'"), ["run"], ["seq"])


def new_messages(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages past each run's cursor (run, cursor); runs without a cursor start at zero."""
    numbered = row_numbers(messages, ["run"], "seq", "_rn")
    joined = numbered.join(cursors, "run", "left")
    return joined.filter(F.col("_rn") > F.coalesce("cursor", F.lit(0))).drop("_rn", "cursor")


def token_totals(messages: DataFrame) -> DataFrame:
    """Last usage of every segment, summed per run."""
    per_segment = with_segment(messages, F.col("is_seal")).groupBy("run", "segment").agg(F.max_by("total_tokens", "seq").alias("tokens"))
    return per_segment.groupBy("run").agg(F.sum("tokens").alias("total_tokens"), F.count(F.lit(1)).alias("segments"))


def seal_eligibility(messages: DataFrame, min_tokens: int = MIN_SEAL_TOKENS, max_seals: int = MAX_SEALS) -> DataFrame:
    """Why a seal at this message would be refused; null when it is allowed."""
    df = with_segment(messages, F.col("is_seal"), "seals_before")
    reason = F.when(F.lit(min_tokens > 0) & (F.col("total_tokens") < min_tokens), F.lit("too_early")).when(
        F.lit(max_seals > 0) & (F.col("seals_before") >= max_seals), F.lit("max_seals")
    )
    return df.withColumn("seal_refused", reason)


def dispatch_screen(calls: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Why a call is not executed; null when it is."""
    name = S.strip(F.coalesce("name", F.lit("")))
    mixed = F.count(F.lit(1)).over(Window.partitionBy("run", "turn")) > 1
    alone = F.col("name").isin(*MEMORY_TOOLS, *SUBMIT_TOOLS)
    bad_json = ~S.is_blank("arguments") & F.try_parse_json("arguments").isNull()
    reason = (
        F.when(mixed & alone, F.lit("must_be_alone"))
        .when(name == "", F.lit("empty_name"))
        .when(bad_json, F.lit("undecodable_arguments"))
        .when(~name.isin(*allowed), F.lit("unavailable"))
    )
    return calls.withColumn("refused", reason)


def pair_results(calls: DataFrame, results: DataFrame, reason: str = "the turns are used up") -> DataFrame:
    """Each call with its result; a missing one gets a skip stub."""
    stub = F.to_json(
        F.struct(
            F.lit(False).alias("succeed"),
            F.lit(f"Not run: {reason}. Answer with what is already known.").alias("error"),
        )
    )
    joined = calls.join(results.withColumn("_hit", F.lit(True)), ["run", "call_id"], "left")
    return joined.withColumns(
        {
            "content": F.when(F.col("_hit"), F.col("content")).otherwise(stub),
            "ok": F.when(F.col("_hit"), F.col("ok")).otherwise(F.lit(False)),
            "skipped": F.col("_hit").isNull(),
        }
    ).drop("_hit")


def serialize_messages(messages: DataFrame, reasoning_field: str = "reasoning_content", force_reasoning: bool = False) -> DataFrame:
    """Messages as API JSON. Reasoning and tool calls appear on assistant rows only, call ids on tool rows.

    Input: role, content, reasoning; optional tool_calls (array of structs) and tool_call_id.
    """
    assistant = F.lower("role") == "assistant"
    reasoning = F.when(assistant, F.coalesce("reasoning", F.lit("")) if force_reasoning else F.col("reasoning"))
    fields = [F.lower("role").alias("role"), F.coalesce("content", F.lit("")).alias("content"), reasoning.alias(reasoning_field)]
    if "tool_calls" in messages.columns:
        fields.append(F.when(assistant & (F.size("tool_calls") > 0), F.col("tool_calls")).alias("tool_calls"))
    if "tool_call_id" in messages.columns:
        fields.append(F.when(F.lower("role") == "tool", F.nullif("tool_call_id", F.lit(""))).alias("tool_call_id"))
    return messages.withColumn("serialized", F.to_json(F.struct(*fields)))


def role_violations(messages: DataFrame) -> DataFrame:
    """Messages that carry assistant-only fields under another role."""
    return messages.filter((F.lower("role") != "assistant") & F.col("reasoning").isNotNull())


def flatten_calls(raw: DataFrame, name: str = "call") -> DataFrame:
    """Raw call JSON, nested or flat, to call_id, tool_name and arguments.

    Absent or blank arguments become an empty object; undecodable ones keep their raw text.
    """
    v = F.try_parse_json(name)
    df = raw.withColumn("_v", v)
    nested = V.is_object(V.at("_v", "$.function"))
    fn_name = F.when(nested, F.coalesce(F.nullif(V.text_at("_v", "$.function.name"), F.lit("")), V.text_at("_v", "$.name"))).otherwise(V.text_at("_v", "$.name"))
    args = F.when(
        nested & V.kind(V.at("_v", "$.function.arguments")).isNotNull(), V.text_at("_v", "$.function.arguments")
    ).otherwise(V.text_at("_v", "$.arguments"))
    parsed = F.try_parse_json("_a")
    df = df.withColumns({"call_id": F.coalesce(V.text_at("_v", "$.id"), F.lit("")), "tool_name": S.strip(F.coalesce(fn_name, F.lit(""))), "_a": args})
    return df.withColumns(
        {
            "arguments": F.when(S.is_blank("_a"), F.lit("{}")).when(parsed.isNull(), F.col("_a")).otherwise(F.to_json(parsed)),
            "decodable": S.is_blank("_a") | parsed.isNotNull(),
        }
    ).drop("_v", "_a")


def result_content(results: DataFrame, max_tokens: int, max_turns: int) -> DataFrame:
    """Text a tool message carries: output or error JSON, then the token and turn budget lines.

    Input: ok, output, error, tokens_used, turns_used.
    """
    base = F.when(F.col("ok"), F.col("output")).otherwise(
        F.to_json(F.struct(F.lit(False).alias("succeed"), F.col("error").alias("error")))
    )
    total = max(max_tokens - RESERVED_TOKENS, 0)
    line = lambda tag, used, limit: F.concat(
        F.lit(f"<{tag}> Used: "), used.cast("string"), F.lit(f" / Total: {limit}; Remain: "),
        F.greatest(F.lit(limit) - used, F.lit(0)).cast("string"), F.lit(f" </{tag}>"),
    )
    budget = F.concat_ws("\n", line("token_budget", F.col("tokens_used"), total), line("turn_budget", F.col("turns_used"), max_turns))
    return results.withColumn("content", F.when(F.col("ok"), F.concat_ws("\n", base, budget)).otherwise(base))


def flatten_usage(rows: DataFrame, name: str = "usage") -> DataFrame:
    """Token counts of a usage object; reasoning tokens from the first of four places that has them."""
    v = F.try_parse_json(name)
    num = lambda path: F.try_variant_get(F.col("_u"), path, "bigint")
    places = ("reasoning_tokens", "completion_tokens_details.reasoning_tokens", "output_tokens_details.reasoning_tokens", "reasoning_tokens_details.reasoning_tokens")
    return rows.withColumn("_u", v).withColumns(
        {
            "prompt_tokens": num("$.prompt_tokens"),
            "completion_tokens": num("$.completion_tokens"),
            "total_tokens": num("$.total_tokens"),
            "reasoning_tokens": F.coalesce(*[num("$." + p) for p in places]),
        }
    ).drop("_u")
