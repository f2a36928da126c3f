"""Table extraction, specs and table scoring over all line items."""

from pyspark.sql import functions as F

from trailmark.catalog.base import case
from trailmark.catalog.summary_cases import flat
from trailmark.functions import udtf
from trailmark.operators import tablematch as TM
from trailmark.operators import tablescore as TS
from trailmark.plans.staging import staged

HEAD = {"orderkey": "Order Key", "line_no": "Line No", "quantity": "quantity", "ship_date": "Ship Date", "flag": "flag", "price": "price"}


def side_rows(x, side):
    """Rows of one side as maps; predicted instance 19 lacks its price column."""
    cells = F.create_map(*[c for k, h in HEAD.items() for c in (F.lit(S_NAMES[k]), F.col(k))])
    rows = x.rows.filter(F.col("side") == side)
    if side == "pred":
        cells = F.when(F.col("instance_id") == 19, F.map_filter(cells, lambda k, v: k != "price")).otherwise(cells)
    return rows.select("instance_id", "row_id", cells.alias("cells"))


S_NAMES = {k: h.lower().replace(" ", "") for k, h in HEAD.items()}


def headers(x, side):
    """Header per instance; the derived rows all carry the same columns."""
    full, short = (F.array(*[F.lit(n) for n in names]) for names in (S_NAMES.values(), [n for n in S_NAMES.values() if n != "price"]))
    ids = x.table("lineitem").select((F.col("l_suppkey") % 20).alias("instance_id")).distinct()
    columns = F.when((F.col("instance_id") == 19) & F.lit(side == "pred"), short).otherwise(full)
    return ids.select("instance_id", columns.alias("columns"), F.lit(None).cast("string").alias("table_error"))


def status(x):
    gold, pred = side_rows(x, "gold"), side_rows(x, "pred")
    st = TM.instance_status(TM.parse_specs(x.spec), headers(x, "pred"), headers(x, "gold"))
    return staged(st, "instance-status"), gold, pred


LINES = r"""(SELECT *, list_filter(list_transform(string_split_regex(trim(block, @WS), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), lambda l: trim(l, @WS)),
    lambda l: contains(l, '|') AND NOT regexp_matches(l, '^[|\- :]*$')) AS lines FROM
   (SELECT doc_id, content, CASE WHEN regexp_matches(content, '(?is)```markdown.*?```') THEN regexp_extract(content, '(?is)```markdown(.*?)```', 1)
     WHEN length(content) - length(replace(content, '|', '')) >= 4 THEN regexp_extract(content, '((?:\|.*\n?)+)', 1) END AS block FROM fx_texts) b) t"""


@case(
    "tm1_extract_tables",
    f"""SELECT doc_id, err AS table_error, CASE WHEN err IS NULL THEN array_to_string(list_filter(list_transform(string_split(lines[1], '|'), lambda h: replace(lower(trim(h, @WS)), ' ', '')), lambda h: h <> ''), ',') END AS columns,
     CASE WHEN err IS NULL THEN CAST(len(lines) - 1 AS INTEGER) END AS n_rows,
     CASE WHEN err IS NULL THEN md5(array_to_string(list_transform(lines[2:], lambda l: array_to_string(list_transform(string_split(l, '|'), lambda c: trim(c, @WS)), '|')), chr(10))) END AS body
    FROM (SELECT *, CASE WHEN trim(content, @WS) = '' THEN 'empty_response' WHEN block IS NULL THEN 'no_table' WHEN trim(block, @WS) = '' THEN 'empty_table' WHEN len(lines) < 2 THEN 'no_data_rows'
       WHEN len(list_filter(lines[2:], lambda l: len(string_split(l, '|')) > len(string_split(lines[1], '|')))) > 0 THEN 'bad_row_width'
       WHEN len(list_filter(string_split(lines[1], '|'), lambda h: trim(h, @WS) <> '')) = 0 THEN 'no_data_rows' END AS err FROM {LINES}) e""",
)
def _(x):
    t = TM.extract_tables(x.texts.select("doc_id", F.col("content").alias("response")))
    body = F.array_join(F.transform("lines", lambda r: F.array_join(r, "|")), "\n")
    return t.select(
        "doc_id",
        "table_error",
        F.array_join("columns", ",").alias("columns"),
        F.when(F.col("lines").isNotNull(), F.size("lines")).alias("n_rows"),
        F.md5(body).alias("body"),
    )


SPEC_ROWS = """(SELECT instance_id, unnest([{'o': 0, 'c': 'orderkey', 'k': instance_id <> 17, 'p': 'norm_str', 'm': 'exact_match', 'x': NULL::DOUBLE}, {'o': 1, 'c': 'lineno', 'k': true, 'p': '', 'm': 'exact_match', 'x': NULL},
 {'o': 2, 'c': 'quantity', 'k': false, 'p': 'extract_number', 'm': 'number_near', 'x': 0.01}, {'o': 3, 'c': 'shipdate', 'k': false, 'p': 'norm_date', 'm': CASE WHEN instance_id = 18 THEN 'date_near,guess' ELSE 'date_near' END, 'x': NULL},
 {'o': 4, 'c': 'flag', 'k': false, 'p': 'norm_str', 'm': 'exact_match', 'x': NULL}, {'o': 5, 'c': 'price', 'k': false, 'p': 'extract_number', 'm': 'number_near', 'x': 0.001}]) AS s FROM fx_spec WHERE instance_id NOT IN (14, 15, 16, 17)) t"""


@case("tm2_spec_columns", f"SELECT instance_id, s.o AS ordinal, s.c AS name, s.k AS is_key, true AS has_rule, s.p AS preprocess, s.m AS metric, s.x AS criterion FROM {SPEC_ROWS}")
def _(x):
    t = TM.spec_columns(TM.parse_specs(x.spec))
    return t.withColumns({"preprocess": F.array_join("preprocess", ","), "metric": F.array_join("metric", ",")})


@case(
    "tm3_header_status",
    """SELECT instance_id, CASE instance_id WHEN 14 THEN 'rule_without_column' WHEN 15 THEN 'missing_criterion' WHEN 16 THEN 'invalid_spec' WHEN 17 THEN 'key_not_required' WHEN 18 THEN 'unknown_metric' WHEN 19 THEN 'predicted_columns_differ' END AS error,
     CAST(CASE WHEN instance_id = 16 THEN NULL ELSE 6 END AS INTEGER) AS n_required FROM (SELECT DISTINCT instance_id FROM fx_rows) t""",
)
def _(x):
    return status(x)[0].select("instance_id", "error", F.when(F.col("n_required") >= 0, F.col("n_required")).alias("n_required"))


FIRST = """(SELECT *, row_number() OVER (PARTITION BY side, instance_id, orderkey, line_no ORDER BY row_id) AS rn FROM fx_rows) f"""
NUM = r"'[-+]?\d*\.\d+%?|[-+]?\d+\.?\d*%?'"
NORMED = f"""normed AS (SELECT side, instance_id, row_id, replace(orderkey, '*', '') AS k1, line_no AS k2, coalesce(nullif(regexp_extract(quantity, {NUM}), ''), 'NULL') AS quantity,
  strftime(coalesce(try_strptime(ship_date, '%Y-%m-%d'), try_strptime(ship_date, '%Y年%m月%d日')), '%Y-%m-%d') AS ship_date, replace(replace(trim(lower(flag), @WS), ' ', ''), '*', '') AS flag,
  coalesce(nullif(regexp_extract(price, {NUM}), ''), 'NULL') AS price FROM {FIRST} WHERE rn = 1 AND instance_id < 14)"""


@case("tm4_first_row_per_key", f"SELECT side, instance_id, count(*) AS rows, CAST(sum(row_id) AS DOUBLE) AS id_sum FROM {FIRST} WHERE rn = 1 GROUP BY side, instance_id")
def _(x):
    from trailmark.plans.keyed import first_by

    kept = first_by(x.rows.select("side", "instance_id", "orderkey", "line_no", "row_id"), ["side", "instance_id", "orderkey", "line_no"], ["row_id"])
    # ids are large: their sum leaves 64 bits behind at a few million rows
    return kept.groupBy("side", "instance_id").agg(F.count("*").alias("rows"), F.sum(F.col("row_id").cast("decimal(19,0)")).cast("double").alias("id_sum"))


@case("win3_first_row_per_key", f"SELECT side, instance_id, orderkey, line_no, quantity, price FROM {FIRST} WHERE rn = 1")
def _(x):
    from trailmark.plans.keyed import first_by

    cols = ["side", "instance_id", "orderkey", "line_no", "row_id", "quantity", "price"]
    return first_by(x.rows.select(*cols), ["side", "instance_id", "orderkey", "line_no"], ["row_id"], hashed=False).drop("row_id")


@case("tm5_prepared_rows", f"WITH {NORMED} SELECT side, instance_id, k1 || '|' || k2 AS key, k1 || '|' || k2 || '|' || quantity || '|' || ship_date || '|' || flag || '|' || price AS vals, count(*) AS copies FROM normed GROUP BY ALL")
def _(x):
    st, gold, pred = status(x)
    g, p = TM.prepare_sides(st, gold, pred)
    both = g.withColumn("side", F.lit("gold")).unionByName(p.withColumn("side", F.lit("pred")))
    return both.withColumns({"key": F.array_join("key", "|"), "vals": F.array_join("vals", "|")})


PAIRED = f"""{NORMED}, paired AS (SELECT g.instance_id, g.k1, g.k2, g.quantity || '|' || g.ship_date || '|' || g.flag || '|' || g.price AS target, p.quantity || '|' || p.ship_date || '|' || p.flag || '|' || p.price AS response,
  CASE WHEN abs(CAST(p.quantity AS DOUBLE) - CAST(g.quantity AS DOUBLE)) <= abs(CAST(g.quantity AS DOUBLE)) * 0.01 THEN 1 ELSE 0 END AS s1,
  CASE WHEN abs(date_diff('day', CAST(p.ship_date AS DATE), CAST(g.ship_date AS DATE))) <= 31 THEN 1 ELSE 0 END AS s2, CASE WHEN p.flag = g.flag THEN 1 ELSE 0 END AS s3,
  CASE WHEN abs(coalesce(try_cast(p.price AS DOUBLE), -1e9) - CAST(g.price AS DOUBLE)) <= abs(CAST(g.price AS DOUBLE)) * 0.001 THEN 1 ELSE 0 END AS s4
 FROM normed g JOIN normed p ON g.instance_id = p.instance_id AND g.k1 = p.k1 AND g.k2 = p.k2 WHERE g.side = 'gold' AND p.side = 'pred')"""


@case("jn9_key_join", f"WITH {PAIRED} SELECT instance_id, count(*) AS pairs, count(DISTINCT k1 || '|' || k2) AS keys FROM paired GROUP BY instance_id")
def _(x):
    st, gold, pred = status(x)
    m = TS.matched_rows(*TM.prepare_sides(st, gold, pred))
    per_key = m.groupBy("instance_id", "key").agg(F.sum("weight").alias("w"))
    return per_key.groupBy("instance_id").agg(F.sum("w").alias("pairs"), F.count("*").alias("keys"))


@case("tm6_pair_scores", f"WITH {PAIRED} SELECT instance_id, k1 || '|' || k2 AS key, target, response, count(*) AS weight, CAST(min(least(s1, s2, s3, s4)) AS DOUBLE) AS row_score, CAST(min(2 + s1 + s2 + s3 + s4) AS DOUBLE) AS item_score FROM paired GROUP BY ALL")
def _(x):
    st, gold, pred = status(x)
    s = TS.pair_scores(TS.matched_rows(*TM.prepare_sides(st, gold, pred)), st.filter("error IS NULL"))
    tail = lambda c: F.array_join(F.slice(c, 3, 4), "|")
    return s.withColumns({"key": F.array_join("key", "|"), "target": tail("target"), "response": tail("response")})


FINAL = f"""{PAIRED}, hit AS (SELECT instance_id, sum(least(s1, s2, s3, s4)) AS rtp, sum(2 + s1 + s2 + s3 + s4) AS itp FROM paired GROUP BY instance_id),
 n AS (SELECT instance_id, count(*) FILTER (side = 'gold') AS g, count(*) FILTER (side = 'pred') AS p FROM normed GROUP BY instance_id),
 r AS (SELECT a.instance_id, CASE a.instance_id WHEN 14 THEN 'rule_without_column' WHEN 15 THEN 'missing_criterion' WHEN 16 THEN 'invalid_spec' WHEN 17 THEN 'key_not_required' WHEN 18 THEN 'unknown_metric' WHEN 19 THEN 'predicted_columns_differ' END AS error,
   coalesce(rtp, 0)::DOUBLE AS rtp, coalesce(itp, 0)::DOUBLE AS itp, coalesce(g, 0) AS g, coalesce(p, 0) AS p, coalesce(rtp / p, 0) AS rp, coalesce(rtp / g, 0) AS rr, coalesce(itp / (p * 6), 0) AS ip, coalesce(itp / (g * 6), 0) AS ir
   FROM (SELECT DISTINCT instance_id FROM fx_rows) a LEFT JOIN hit ON a.instance_id = hit.instance_id LEFT JOIN n ON a.instance_id = n.instance_id)"""


@case(
    "tm7_table_scores",
    f"""WITH {FINAL} SELECT instance_id, error, rtp AS row_true_positives, itp AS item_true_positives, p AS predicted_rows, g AS gold_rows,
    round(rp, 6) AS row_precision, round(rr, 6) AS row_recall, round(CASE WHEN rp + rr > 1e-9 THEN 2 * rp * rr / (rp + rr) ELSE 0 END, 6) AS row_f1,
    round(ip, 6) AS item_precision, round(ir, 6) AS item_recall, round(CASE WHEN ip + ir > 1e-9 THEN 2 * ip * ir / (ip + ir) ELSE 0 END, 6) AS item_f1,
    CASE WHEN error IS NULL THEN 'SUCCESS' ELSE 'EXTRACTION_FAILED' END AS complete_status FROM r""",
)
def _(x):
    gold, pred = side_rows(x, "gold"), side_rows(x, "pred")
    out = TS.score_tables(x.spec, headers(x, "gold"), gold, headers(x, "pred"), pred)
    return flat(out.drop("n_required", "is_correct"))


@case(
    "agg20_table_totals",
    f"""WITH {FINAL} SELECT error, count(*) AS instances, round(avg(rp), 6) AS row_precision, round(avg(ir), 6) AS item_recall FROM r GROUP BY error""",
)
def _(x):
    gold, pred = side_rows(x, "gold"), side_rows(x, "pred")
    out = TS.score_tables(x.spec, headers(x, "gold"), gold, headers(x, "pred"), pred)
    return flat(out.groupBy("error").agg(F.count("*").alias("instances"), F.avg("row_precision").alias("row_precision"), F.avg("item_recall").alias("item_recall")))


@case(
    "jn10_vocabulary_mapping",
    """WITH p AS (SELECT instance_id, row_id, orderkey FROM fx_rows WHERE side = 'pred' AND instance_id < 14), g AS (SELECT DISTINCT instance_id, orderkey FROM fx_rows WHERE side = 'gold')
     SELECT p.instance_id, p.row_id, CASE WHEN g.orderkey IS NOT NULL THEN p.orderkey || '*' ELSE p.orderkey END AS orderkey FROM p LEFT JOIN g ON p.instance_id = g.instance_id AND p.orderkey || '*' = g.orderkey""",
)
def _(x):
    st, gold, pred = status(x)
    ready = st.filter("error IS NULL")
    pairs = x.rows.select("instance_id", F.lit("orderkey").alias("column_name"), F.col("orderkey").alias("origin")).distinct()
    key_map = pairs.withColumn("transform", F.concat("origin", F.lit("*")))
    out = TM.map_vocabulary(TM._aligned(pred, ready, "source"), TM._aligned(gold, ready, "required"), key_map)
    return out.select("instance_id", "row_id", F.get("vals", F.lit(0)).alias("orderkey"))


@case(
    "jn10_header_mapping",
    """SELECT instance_id, CASE WHEN instance_id = 14 THEN 'rule_without_column' WHEN instance_id = 15 THEN 'missing_criterion' WHEN instance_id = 16 THEN 'invalid_spec' WHEN instance_id = 17 THEN 'key_not_required' WHEN instance_id = 18 THEN 'unknown_metric' WHEN instance_id % 2 = 1 THEN 'predicted_columns_differ' END AS error
    FROM (SELECT DISTINCT instance_id FROM fx_rows) t""",
)
def _(x):
    gold, pred = side_rows(x, "gold"), side_rows(x, "gold")
    renamed = pred.withColumn("cells", F.transform_keys("cells", lambda k, v: F.when(k == "price", F.lit("cost")).otherwise(k)))
    mapping = x.spec.select("instance_id", F.lit("cost").alias("origin"), F.when(F.col("instance_id") % 2 == 0, F.lit("price")).otherwise(F.lit("total")).alias("transform"))
    st = TM.instance_status(TM.parse_specs(x.spec), TM.headers_from_rows(renamed), TM.headers_from_rows(gold), mapping)
    return st.select("instance_id", "error")


@case(
    "set3_set_equality",
    """SELECT doc_id, list_sort(list_distinct(string_split(text, ' '))) = list_sort(list_distinct(string_split(replace(text, chr(10), ' '), ' '))) AS same FROM documents""",
)
def _(x):
    words = lambda c: F.array_sort(F.array_distinct(F.split(c, " ")))
    t = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return x.table("documents").select("doc_id", (words(F.col("text")) == words(t)).alias("same"))


UDF5 = r"""SELECT doc_id, CAST(count(*) AS BIGINT) AS table_rows FROM (SELECT doc_id, unnest(lines[2:]) AS l, lines FROM """ + LINES + r""") t
  WHERE len(string_split(lines[1], '|')) > 0 AND doc_id NOT IN (SELECT doc_id FROM """ + LINES + r""" WHERE len(list_filter(lines[2:], lambda l: len(string_split(l, '|')) > len(string_split(lines[1], '|')))) > 0
   OR len(list_distinct(list_filter(list_transform(string_split(lines[1], '|'), lambda h: replace(lower(trim(h, @WS)), ' ', '')), lambda h: h <> ''))) <> len(list_filter(string_split(lines[1], '|'), lambda h: trim(h, @WS) <> ''))
   OR len(list_filter(string_split(lines[1], '|'), lambda h: trim(h, @WS) <> '')) = 0) GROUP BY doc_id"""


@case("udf5_table_rows", UDF5)
def _(x):
    t = TM.extract_tables(x.texts.select(F.col("doc_id").alias("instance_id"), F.col("content").alias("response")))
    return TM.table_rows(t).groupBy(F.col("instance_id").alias("doc_id")).agg(F.count("*").alias("table_rows"))


@case("udf5_lateral_rows", UDF5)
def _(x):
    """The same rows by the table function, as a SQL user writes it."""
    udtf.register(x.spark)
    return x.spark.sql("SELECT doc_id, count(*) AS table_rows FROM {texts} t, LATERAL table_rows(t.content) GROUP BY doc_id", texts=x.texts)
