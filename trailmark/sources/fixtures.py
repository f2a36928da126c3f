"""Input tables derived from the driver's parquet tables.

Each derivation is a pure projection written in the SQL that Spark and DuckDB share, so the query
and its oracle start from the same rows and both grow with the data. ``@K`` stands for the integer
``$.k`` of ``events.props`` and ``@NL`` for a line feed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_S = "CAST({} AS STRING)".format


def _metric(shift: int) -> str:
    """A value 0.00-0.99 derived from k, as text."""
    return f"CAST(CAST((@K * 37 + {shift}) % 100 AS DOUBLE) / 100 AS STRING)"


_METRICS = (
    "'{\"precision\":' || CASE WHEN event_id % 41 = 0 THEN '\"NaN\"' WHEN event_id % 43 = 0 THEN 'true' "
    "WHEN event_id % 37 = 0 THEN '\" 0.5 \"' ELSE " + _metric(0) + " END"
    " || ',\"recall\":' || " + _metric(11) + " || ',\"f1\":' || " + _metric(23)
    + "".join(
        f" || ',\"{n}\":' || " + _metric(s)
        for n, s in (("row_precision", 3), ("row_recall", 7), ("row_f1", 13), ("item_precision", 17), ("item_recall", 19), ("item_f1", 29))
    )
    + " || ',\"judge_model\":\"' || CASE event_id % 3 WHEN 0 THEN 'm-a' WHEN 1 THEN ' m-b ' ELSE '' END || '\"}'"
)

FIXTURES: dict[str, str] = {
    "fx_reviews": f"""
SELECT event_id AS line, CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS file_rank,
  CAST(event_id % 3 AS INT) AS rollout_idx,
  CASE WHEN event_id % 97 = 0 THEN '' ELSE 'q_' || {_S('user_id')} END AS question_id,
  'Q ' || {_S('user_id')} AS question, event_type AS truth,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '   ' ELSE event_type END AS answer,
  CASE WHEN event_id % 17 = 0 THEN 'browsecomp' WHEN event_type = 'view' THEN 'widesearch_200' WHEN event_type = 'purchase' THEN 'deepsearchqa_900'
    WHEN event_type = 'click' THEN 'gaia_text_103' ELSE 'xbench_2510' END AS benchmark,
  CASE WHEN event_type = 'error' THEN 'EXTRACTION_FAILED' ELSE 'SUCCESS' END AS judge_complete_status,
  {_METRICS} AS judge_metrics,
  CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 47 = 0 THEN '"true"' WHEN @K >= 50 THEN 'true' ELSE 'false' END AS is_correct,
  CASE WHEN event_id % 59 = 0 THEN '""' WHEN event_id % 31 = 0 THEN 'true' WHEN event_id % 29 = 0 THEN {_S('value')}
    WHEN event_id % 23 = 0 THEN '" ' || {_S('CAST(floor(value) AS BIGINT)')} || ' "' WHEN event_id % 19 = 0 THEN NULL
    ELSE {_S('CAST(floor(value) AS BIGINT)')} END AS num_turns,
  CAST(floor(value) AS BIGINT) AS tokens
FROM events""",
    "fx_lines": """
SELECT line, rollout_idx, file_rank,
  CASE WHEN line % 71 = 0 THEN '  ' WHEN line % 67 = 0 THEN '[1]' WHEN line % 61 = 0 THEN substr(body, 1, length(body) - 3) ELSE body END AS text
FROM (SELECT line, rollout_idx, file_rank,
  '{"question_id":"' || question_id || '","answer":' || coalesce('"' || answer || '"', 'null') || ',"is_correct":' || coalesce(is_correct, 'null')
  || ',"num_turns":' || coalesce(num_turns, 'null') || ',"judge_complete_status":"' || judge_complete_status || '","judge_metrics":' || judge_metrics || '}' AS body
  FROM fx_reviews) b""",
    "fx_qa": f"""
SELECT 'd_' || {_S('doc_id')} AS id, doc_id AS idx, text AS question, split(text, @NL) AS ground_truth,
  CAST(length(text) - length(replace(text, @NL, '')) + 1 + CASE WHEN doc_id % 89 = 0 THEN 1 ELSE 0 END AS BIGINT) AS declared_size,
  'dom' || {_S('doc_id % 12')} AS domain, 'sub' || {_S('CAST(floor(doc_id / 12) AS BIGINT) % 6')} AS sub_domain, lang AS language,
  CASE WHEN doc_id % 4 <> 0 THEN 'hard' ELSE 'easy' END AS difficulty, CASE WHEN doc_id % 10 <> 0 THEN 'rl_train' ELSE 'dev' END AS split,
  CASE WHEN doc_id % 83 = 0 THEN 'Other' WHEN doc_id % 3 > 0 THEN ' Set Answer' ELSE 'Single Answer ' END AS answer_type,
  CASE doc_id % 5 WHEN 0 THEN 'BC-185' WHEN 1 THEN 'dsqa' WHEN 2 THEN 'WideSearch' WHEN 3 THEN ' Gaia-Text ' ELSE 'unknown' END AS benchmark
FROM documents""",
    # a selection that names every document, one in seven under an id the source lacks
    "fx_selection": f"""
SELECT CASE WHEN idx % 7 = 0 THEN 'x_' || {_S('idx')} ELSE id END AS id, idx, question,
  CASE WHEN idx % 19 = 0 THEN 'dom_other' ELSE domain END AS domain, sub_domain, difficulty, split, 'en' AS language FROM fx_qa""",
    "fx_rows": f"""
SELECT side, instance_id, row_id,
  {_S('l_orderkey')} || CASE WHEN l_suppkey % 3 = 0 THEN '*' ELSE '' END AS orderkey, {_S('l_linenumber')} AS line_no,
  {_S("l_quantity + CASE WHEN side = 'pred' AND l_partkey % 11 = 0 THEN 1 ELSE 0 END")} AS quantity,
  CASE WHEN side = 'pred' AND l_partkey % 13 = 0 THEN {_S('CAST(CAST(l_shipdate AS DATE) + INTERVAL 40 DAY AS DATE)')}
    WHEN side = 'pred' AND l_partkey % 13 < 4 THEN {_S('year(l_shipdate)')} || '年' || {_S('month(l_shipdate)')} || '月' || {_S('day(l_shipdate)')} || '日'
    ELSE {_S('CAST(l_shipdate AS DATE)')} END AS ship_date,
  CASE WHEN side = 'gold' THEN l_returnflag WHEN l_partkey % 5 = 0 THEN '*' || lower(l_returnflag) || '* ' ELSE lower(l_returnflag) END AS flag,
  CASE WHEN side = 'gold' THEN {_S('l_extendedprice')} WHEN l_partkey % 23 = 0 THEN 'n/a' ELSE '$' || {_S('l_extendedprice')} || ' usd' END AS price
FROM (SELECT l.*, @EACH('gold', 'pred') AS side, l_suppkey % 20 AS instance_id,
    l_orderkey * 1000000000 + l_linenumber * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS row_id FROM lineitem l) r
WHERE NOT (side = 'pred' AND l_partkey % 17 = 0)""",
    "fx_spec": """
SELECT instance_id, CASE WHEN instance_id = 16 THEN 'not json'
  WHEN instance_id = 17 THEN replace(body, '"unique_columns":["Order Key"', '"unique_columns":["colour"')
  WHEN instance_id = 18 THEN replace(body, '"metric":["date_near"]', '"metric":["date_near","guess"]')
  WHEN instance_id = 14 THEN replace(body, '"eval_pipeline":{', '"eval_pipeline":{"colour":{"preprocess":["norm_str"],"metric":["exact_match"]},')
  WHEN instance_id = 15 THEN replace(body, ',"criterion":0.01', '') ELSE body END AS evaluation
FROM (SELECT instance_id,
 '{"required":["Order Key","line no","quantity","ship date","flag","price"],"unique_columns":["Order Key","line no"],"eval_pipeline":{'
 || '"Order Key":{"preprocess":["norm_str"],"metric":["exact_match"]},"line no":{"preprocess":[],"metric":["exact_match"]},'
 || '"quantity":{"preprocess":["extract_number"],"metric":["number_near"],"criterion":0.01},"ship date":{"preprocess":["norm_date"],"metric":["date_near"]},'
 || '"flag":{"preprocess":["norm_str"],"metric":["exact_match"]},"price":{"preprocess":["extract_number"],"metric":["number_near"],"criterion":0.001}}}' AS body
 FROM (SELECT DISTINCT l_suppkey % 20 AS instance_id FROM lineitem) d) s""",
    "fx_tool_calls": f"""
SELECT user_id AS run, event_id AS seq, CAST(floor(event_id / 4) AS BIGINT) AS turn, event_id AS call_id,
  CASE WHEN event_id % 101 = 0 THEN ' ' WHEN event_id % 103 = 0 THEN 'shell' WHEN event_type = 'error' THEN 'link_summary_tool'
    WHEN event_type = 'signup' THEN 'seal_memory_tool' ELSE 'search_api' END AS name,
  CASE WHEN event_id % 73 = 0 THEN '{{"query": "A' WHEN event_id % 107 = 0 THEN NULL WHEN event_id % 109 = 0 THEN '  '
    WHEN event_id % 79 = 0 THEN '{{"return_n": 3}}' WHEN event_id % 83 = 0 THEN '{{"query": "b", "extra": 1}}'
    WHEN event_id % 89 = 0 THEN '{{"return_n": "x", "query": 5}}'
    ELSE CASE @K % 4 WHEN 0 THEN '{{"query":"b"}}' WHEN 1 THEN '{{"query":"A"}}' WHEN 2 THEN '{{"query":"  a "}}' ELSE '{{"query":"a"}}' END END AS arguments,
  @K % 10 <> 0 AS ok, value AS duration_ms,
  'out ' || {_S('@K')} AS output, 'failed ' || event_type AS error, event_type = 'signup' AS is_seal
FROM events""",
    # each event as an assistant turn with a call, followed by its tool message
    "fx_turns": """
SELECT user_id AS run, event_id * 2 AS seq, 'assistant' AS role, 'calling' AS content, CASE WHEN @K % 3 = 0 THEN 'search_api' ELSE 'submit_tool' END AS tool_name, CAST(NULL AS BOOLEAN) AS ok FROM events
UNION ALL SELECT user_id AS run, event_id * 2 + 1 AS seq, 'tool' AS role, CASE @K % 4 WHEN 0 THEN '{"answer": "  a' || CAST(event_id AS STRING) || ' "}'
  WHEN 1 THEN '{"answer": "b' || CAST(event_id AS STRING) || '"}' || @NL || '<turn_budget> Used: 1 </turn_budget>' WHEN 2 THEN 'plain' ELSE '{"answer": " "}' END AS content, CAST(NULL AS STRING) AS tool_name, event_type <> 'error' AS ok FROM events""",
    "fx_messages": """
SELECT conv_id AS run, turn AS seq, role, text AS content, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN text END AS reasoning,
  CAST((turn + 1) * 100 + length(text) AS BIGINT) AS total_tokens, role = 'assistant' AND turn % 3 = 0 AS is_seal
FROM conversations""",
    "fx_runs": """
SELECT user_id AS run, event_id AS seq, CASE event_type WHEN 'signup' THEN 'RUBRIC' WHEN 'purchase' THEN 'VERIFY' WHEN 'error' THEN 'ERROR' ELSE 'ANSWER' END AS state,
  @K % 7 AS turns, @K % 13 = 0 AS is_seal FROM events""",
    "fx_texts": f"""
SELECT doc_id, lang, text, CASE doc_id % 16 WHEN 0 THEN text WHEN 1 THEN '<think>' || text || '</think> ' || text WHEN 2 THEN '<think>' || text || '</think>  '
  WHEN 3 THEN '**Answer:** ' || text WHEN 4 THEN 'so <answer> ' || text || ' </answer> end' WHEN 5 THEN 'Well, The answer is ' || text
  WHEN 6 THEN 'Table:' || @NL || '```markdown' || @NL || '| Line | No |' || @NL || '|---|:-:|' || @NL || '| ' || replace(text, @NL, ' | 1 |' || @NL || '| ') || ' | 1 |' || @NL || '```'
  WHEN 7 THEN 'Pipe table' || @NL || '| Line | No |' || @NL || '|---|---|' || @NL || '| ' || replace(text, @NL, ' | 1 |' || @NL || '| ') || ' | 1 |' || @NL || 'done'
  WHEN 8 THEN '| a | b |' || @NL || '|---|---|' || @NL || '| 1 | 2 |' || @NL || text || @NL || 'Answer: See the table above.'
  WHEN 9 THEN '<tool_call>{{"name": "search_api"}} ' || text WHEN 10 THEN 'Answer: I cannot provide ' || text WHEN 11 THEN ''
  WHEN 12 THEN 'Reasoning: ' || text || @NL || @NL || 'Answer: ```text' || @NL || text || @NL || '```' WHEN 13 THEN '答案是 中文答案一二三四五。' || text
  WHEN 14 THEN 'Summary: ' || text || @NL || 'Answer:' ELSE '<reasoning>' || text || '</reasoning> answer: ' || text END AS content,
  CASE WHEN doc_id % 3 = 0 THEN text END AS reasoning,
  CASE WHEN doc_id % 9 = 8 THEN 'widesearch_200' ELSE 'browsecomp' END AS benchmark,
  CASE doc_id % 3 WHEN 0 THEN 'RUBRIC' WHEN 1 THEN 'ANSWER' ELSE 'VERIFY' END AS state,
  CASE doc_id % 7 WHEN 0 THEN 'Error code: 429 - Rate limit reached' WHEN 1 THEN 'maximum context length is 8192' WHEN 2 THEN 'Connection reset by peer'
    WHEN 3 THEN 'invalid api key' WHEN 4 THEN 'Request timed out' WHEN 5 THEN 'quota exceeded, context window full' ELSE 'Throttled: 503' END AS error,
  doc_id % 6 = 0 AS has_tool_calls
FROM documents""",
    "fx_verdicts": """
SELECT v.doc_id, v.quality, v.toxic, v.style, CASE WHEN v.doc_id % 31 = 0 THEN 'NULL' ELSE v.reply END AS reply, d.text
FROM (SELECT doc_id, quality, toxic, doc_id % 9 AS style, CASE doc_id % 9
  WHEN 0 THEN 'Sure: {"reasoning": "r' || CAST(doc_id AS STRING) || '", "decision": ' || CASE WHEN quality = 1 THEN 'true' ELSE 'false' END || '}'
  WHEN 1 THEN '{"reasoning": "the "nick" name", "decision": ' || CASE WHEN quality = 1 THEN 'TRUE' ELSE 'false' END || '}'
  WHEN 2 THEN 'extracted_final_answer: A' || CAST(doc_id AS STRING) || @NL || 'reasoning: because' || @NL || 'of it' || @NL || 'Correct: ' || CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END || @NL || 'confidence: ' || CAST(doc_id % 100 AS STRING) || '%'
  WHEN 3 THEN '最终答案: 五' || @NL || '解释: 一致' || CAST(doc_id AS STRING) || @NL || '结论：' || CASE WHEN quality = 1 THEN '正确' ELSE '错误' END
  WHEN 4 THEN '```json' || @NL || '{"Answer Correctness": {"Explanation": "e' || CAST(doc_id AS STRING) || '", "Correctness Details": {"a": true, "b": ' || CASE WHEN quality = 1 THEN 'true' ELSE 'false' END || '}, "Excessive Answers": [' || CASE WHEN toxic = 1 THEN '"x", "y"' ELSE '' END || ']}}' || @NL || '```'
  WHEN 5 THEN 'text {"Answer Correctness": {"Explanation": "none", "Correctness Details": {}, "Excessive Answers": [' || CASE WHEN quality = 1 THEN '"z"' ELSE '' END || ']}}'
  WHEN 6 THEN 'think </think> ```json' || @NL || '{"decision": "' || CASE WHEN quality = 1 THEN 'pass' WHEN toxic = 1 THEN 'unsure' ELSE 'REVISE_RUBRIC' END || '", "critique": "' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'c' || CAST(doc_id AS STRING) END || '", "suggestion": "s", "rubric_checks": [{"id": 1, "satisfied": true}, {"id": 2, "satisfied": false}]}' || @NL || '```'
  WHEN 7 THEN '```json' || @NL || '{"idx_0": 1, "idx_1": ' || CASE WHEN toxic = 1 THEN '0.5' ELSE 'true' END || ', "idx_2": "1"}' || @NL || '```'
  ELSE CASE WHEN quality = 1 THEN 'I would PASS this' WHEN toxic = 1 THEN 'please revise answer' ELSE 'hmm' END END AS reply
 FROM labels) v JOIN documents d ON d.doc_id = v.doc_id""",
    "fx_rubrics": """
SELECT doc_id, 'd_' || CAST(doc_id AS STRING) AS question_id, CASE WHEN doc_id % 29 = 0 THEN '' WHEN doc_id % 2 = 1 THEN 'Rubrics:' || @NL || '1. ' || replace(text, @NL, @NL || '2.  ')
  ELSE '```json' || @NL || '{"rubrics": [{"id": 1, "description": "r' || CAST(doc_id AS STRING) || '"}, {"description": "' || lang || '"}' || CASE WHEN doc_id % 5 = 0 THEN ', {"id": 7, "satisfied": true}, 3' ELSE '' END || ']}' || @NL || '```' END AS content
FROM documents""",
    "fx_memory": f"""
SELECT 'q_' || {_S('user_id')} AS question_id, 'm-' || {_S('user_id')} || '-' || {_S('event_id')} AS memory_id, event_id AS memory_order, event_id % 4 AS retry_attempt,
  CASE event_id % 4 WHEN 0 THEN 'memory' ELSE 'attempt_' || {_S('event_id % 4 * 5')} || '_x/memory' END AS folder,
  CASE WHEN event_id % 6 = 0 THEN 'snap-m' || {_S('user_id')} || {_S('event_id')} WHEN event_id % 6 = 1 THEN 'other' ELSE 'm-' || {_S('user_id')} || '-' || {_S('event_id')} END AS stem,
  '[{{"' || CASE @K % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'summary' ELSE 'value' END || '":"f' || {_S('@K')} || '","' || CASE @K % 3 WHEN 0 THEN 'source_url' WHEN 1 THEN 'source' ELSE 'url' END || '":"u' || {_S('@K')}
    || '","status":"' || CASE WHEN @K % 7 = 0 THEN 'sure' WHEN @K % 7 < 3 THEN 'verified' ELSE 'conflicting' END || '"}},' || CASE WHEN @K % 2 = 0 THEN '"plain ' || event_type || '"' ELSE '{{"fact":"","value":"v"}}' END || ']' AS knowledge_graph,
  '{{"' || CASE WHEN @K % 2 = 0 THEN 'visited_summary' ELSE 'visited' END || '":"home","frontier_queue":[{{"' || CASE @K % 3 WHEN 0 THEN 'target' WHEN 1 THEN 'url' ELSE 'path' END || '":"t' || {_S('@K')} || '","' || CASE WHEN @K % 2 = 0 THEN 'reason' ELSE 'why' END || '":"w"}},"bare"],"dead_ends":["x' || {_S('@K')} || '",7]}}' AS navigation_state,
  CASE WHEN @K % 5 = 0 THEN NULL ELSE 'plan ' || {_S('@K')} END AS next_step_plan, CASE WHEN @K % 6 = 0 THEN '' ELSE 'done ' || {_S('@K')} END AS task_progress,
  'summary of ' || event_type AS structured_summary, event_id % 9 <> 0 AS in_index
FROM events""",
    "fx_metrics": """
SELECT 'q_' || CAST(user_id AS STRING) AS question_id, CAST(event_id % 3 AS INT) AS rollout_idx, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'tool_calls' WHEN 'view' THEN 'tokens' WHEN 'error' THEN 'error_rate' WHEN 'purchase' THEN 'latency' ELSE 'is_correct' END AS metric_name,
  CASE event_type WHEN 'click' THEN 'INT' WHEN 'view' THEN 'FLOAT' WHEN 'purchase' THEN 'MEAN' ELSE 'RATE' END AS metric_type,
  CASE event_type WHEN 'click' THEN CAST(1 AS DOUBLE) WHEN 'error' THEN CAST(@K % 2 AS DOUBLE) WHEN 'signup' THEN CAST(CASE WHEN @K >= 50 THEN 1 ELSE 0 END AS DOUBLE) ELSE value END AS value
FROM events""",
    "fx_usage": """
SELECT event_id, '{"prompt_tokens":' || CAST(@K AS STRING) || ',"total_tokens":' || CAST(@K * 60 AS STRING)
  || CASE WHEN @K % 9 = 0 THEN '' ELSE ',"completion_tokens":' || CAST(CAST(floor(value) AS BIGINT) * 50 AS STRING) END
  || CASE @K % 5 WHEN 0 THEN ',"reasoning_tokens":' || CAST(@K AS STRING) WHEN 1 THEN ',"completion_tokens_details":{"reasoning_tokens":' || CAST(@K AS STRING) || '}'
     WHEN 2 THEN ',"completion_tokens_details":{},"output_tokens_details":{"reasoning_tokens":' || CAST(@K AS STRING) || '}'
     WHEN 3 THEN ',"output_tokens_details":null,"reasoning_tokens_details":{"reasoning_tokens":' || CAST(@K AS STRING) || '}' ELSE '' END || '}' AS usage,
  CASE event_type WHEN 'error' THEN 'length' WHEN 'view' THEN '' ELSE 'stop' END AS finish_reason FROM events""",
    # every paragraph and every link text of a page is one search result
    "fx_search": """
SELECT page_id, pos, title, CASE WHEN page_id % 9 = 0 THEN '!!' ELSE title END AS query, url, @AT(snippets, pos) AS snippet, query_id
FROM (SELECT *, @EACHN(snippets) AS pos FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, 'site' || CAST(page_id % 5 AS STRING) AS query_id,
  @BOTH(regexp_extract_all(html, '<p>([^<]*)<', 1), regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)) AS snippets FROM pages) a WHERE @LEN(snippets) > 0) b""",
    "fx_paths": """
SELECT event_id, 'rollout_' || CAST(event_id % 3 AS STRING) || '/question_q_' || CAST(user_id AS STRING) || '/' || CASE WHEN event_id % 10 = 0 THEN 'segment_' || CAST(@K % 4 AS STRING) ||'.jsonl'
  ELSE CASE event_type WHEN 'signup' THEN 'rubric' WHEN 'purchase' THEN 'verify' ELSE 'answer' END || '_t' || CAST(@K % 9 AS STRING) || '_attempt_' || CAST(@K % 12 AS STRING) || '_' || CAST(@K % 4 AS STRING) || '.jsonl' END AS path,
  'attempt_' || CAST(@K % 12 AS STRING) AS attempt FROM events""",
}


def duck_text(sql: str) -> str:
    sql = re.sub(r"@EACH\(([^)]*)\)", r"unnest([\1])", sql)
    sql = re.sub(r"@AT\((\w+), (\w+)\)", r"\1[\2]", re.sub(r"@EACHN\((\w+)\)", r"unnest(range(1, len(\1) + 1))", sql)).replace("@BOTH(", "list_concat(").replace("@LEN(", "len(")
    return sql.replace("@K", "CAST(json_extract_string(props, '$.k') AS INTEGER)").replace("@NL", "chr(10)")


def spark_text(sql: str) -> str:
    sql = re.sub(r"@EACH\(([^)]*)\)", r"explode(array(\1))", sql)
    sql = re.sub(r"@AT\((\w+), (\w+)\)", r"element_at(\1, CAST(\2 AS INT))", re.sub(r"@EACHN\((\w+)\)", r"explode(sequence(1L, CAST(size(\1) AS BIGINT)))", sql)).replace("@BOTH(", "concat(").replace("@LEN(", "size(")
    return sql.replace("@K", "CAST(get_json_object(props, '$.k') AS INT)").replace("@NL", "chr(10)")


def needed(sql: str) -> list[str]:
    """Fixtures a text refers to, dependencies first."""
    out: list[str] = []
    for name in dict.fromkeys(re.findall(r"\bfx_[a-z_]+\b", sql)):
        for dep in [*needed(FIXTURES[name]), name]:
            if dep not in out:
                out.append(dep)
    return out


def with_fixtures(sql: str) -> str:
    """Prefix an oracle query with the derivations it refers to."""
    ctes = [f"{name} AS ({duck_text(FIXTURES[name])})" for name in needed(sql)]
    sql = duck_text(sql)
    if not ctes:
        return sql
    head = sql.lstrip()
    if head[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + head[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


class Inputs:
    """Driver tables and derived tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A driver table, split as the session's file settings say."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.fx("fx_" + name)

    def fx(self, name: str) -> DataFrame:
        sql = FIXTURES[name]
        frames = {}
        for token in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", sql)):
            frames[token] = self.fx(token) if token.startswith("fx_") else self.table(token)
        text = spark_text(sql)
        for token, frame in frames.items():
            view = "tm_" + re.sub(r"[^a-z0-9]", "_", self.folder.lower()) + "_" + token
            frame.createOrReplaceTempView(view)
            text = re.sub(rf"\b(FROM|JOIN)\s+{token}\b", rf"\1 {view}", text)
        return self.spark.sql(text)
