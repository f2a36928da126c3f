"""Scoring by counts gives what scoring by pairs gives, and ends where pairs would not."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from trailmark.catalog.table_cases import headers, side_rows, status
from trailmark.operators import cellplan
from trailmark.operators import tablematch as TM
from trailmark.operators import tablescore as TS
from trailmark.plans import staging
from trailmark.plans.staging import staged, staged_together
from trailmark.sources.fixtures import Inputs

SPEC = (
    '{"required": ["k", "n", "d", "u", "e", "m"], "unique_columns": ["k"], "eval_pipeline": {"k": {"preprocess": ["extract_number"], "metric": ["exact_match"]},'
    '"n": {"preprocess": %s, "metric": ["number_near"], "criterion": %s}, "d": {"preprocess": ["norm_date"], "metric": ["date_near"]},'
    '"u": {"preprocess": [], "metric": ["url_match"]}, "e": {"preprocess": ["norm_str", "norm_str"], "metric": ["exact_match", "exact_match"%s]}, "m": {"preprocess": [], "metric": ["%s"]}}}'
)
NUMBERS = ["1", "1.1", "0.9", "100", "101", "99", "99.999", "0", "-0.0", "0.0", "-1", "-1.1", "5%", "0.05", "n/a", "none", "nan", "inf", "-inf", "1e300", "2", "1.5", "", "110", "90"]
DATES = ["2024-01-01", "2024-02-01", "2024-02-02", "2023-12-01", "1999-05-05", "no date", "", "2024-01-15"]
URLS = ["see https://a.org/x", "https://a.org/y and http://b.org", "http://b.org/1 https://a.org", "none", ""]
WORDS = ["A b", "ab", "c", "C ", "", "d*"]


def inputs(spark, seed, rows=60):
    rng = random.Random(seed)
    specs, gold, pred = [], [], []
    for i, (steps, near, more, model) in enumerate([("[]", "0.1", "", "exact_match"), ("[]", "0", ', "llm_judge"', "llm_judge"), ("[]", "1.5", "", "llm_judge"), ('["extract_number"]', "0.00001", "", "url_match")]):
        specs.append((i, SPEC % (steps, near, more, model)))
        for side in (gold, pred):
            for r in range(rng.randint(rows // 2, rows)):
                key = rng.choice(["x%d" % r, "x%d" % r, "y%d 7" % r, "%d" % r])
                numbers = NUMBERS if i != 0 else [n for n in NUMBERS if "inf" not in n]
                if side is pred and r < 8:
                    side.append((i, r, gold[-1 - r][2]))  # some rows of the other side
                    continue
                side.append((i, r, {"k": key, "n": rng.choice(numbers), "d": rng.choice(DATES), "u": rng.choice(URLS), "e": rng.choice(WORDS), "m": rng.choice(WORDS)}))
    table = lambda data: spark.createDataFrame(data, "instance_id long, row_id long, cells map<string,string>")
    g, p = table(gold), table(pred)
    scores = [(i, c, a, b, rng.choice([0.0, 0.5, 1.0])) for i in range(4) for c in ("e", "m") for a in WORDS[:4] + ["ab", "cb"] for b in set(WORDS) if rng.random() < 0.7]
    told = {(i, c, a, b): s for i, c, a, b, s in scores}
    judged = spark.createDataFrame([(*k, s) for k, s in told.items()], "instance_id long, column_name string, response string, target string, score double")
    return (spark.createDataFrame(specs, "instance_id long, evaluation string"), TM.headers_from_rows(g), g, TM.headers_from_rows(p), p), judged


def results(df):
    return {r.instance_id: (r.error, round(r.row_true_positives, 6), round(r.item_true_positives, 6), r.gold_rows, r.predicted_rows) for r in df.collect()}


@pytest.mark.parametrize("seed,told,few", [(1, False, 0), (2, True, 5)])
def test_counts_equal_pairs(spark, monkeypatch, seed, told, few):
    args, judged = inputs(spark, seed)
    how = {"cell_scores": judged} if told else {}
    monkeypatch.setattr(TS, "FEW", 10**9)
    paired = results(TS.score_tables(*args, **how))
    assert any(r[1] > 0 for r in paired.values()) and all(r[0] is None for r in paired.values())
    monkeypatch.setattr(TS, "FEW", few)
    assert results(TS.score_tables(*args, **how)) == paired


def test_interpreted_chains_equal_written_ones(spark, monkeypatch):
    args, _ = inputs(spark, 3)
    written = results(TS.score_tables(*args))
    monkeypatch.setattr(cellplan, "WRITTEN_OUT", 0)
    assert results(TS.score_tables(*args)) == written


def test_given_tables_by_counts(spark, monkeypatch):
    x = Inputs(spark, "/root/testdata/sf0.001")
    args = (x.spec, headers(x, "gold"), side_rows(x, "gold"), headers(x, "pred"), side_rows(x, "pred"))
    paired = results(TS.score_tables(*args))
    monkeypatch.setattr(TS, "FEW", 0)
    assert results(TS.score_tables(*args)) == paired


def test_one_key_with_all_rows(spark):
    """100,000 rows a side under one key: ten thousand million pairs that nobody makes."""
    spec = '{"required": ["k", "n", "d"], "unique_columns": ["k"], "eval_pipeline": {"k": {"preprocess": ["extract_number"], "metric": ["exact_match"]}, "n": {"preprocess": [], "metric": ["number_near"], "criterion": 0.00001}, "d": {"preprocess": [], "metric": ["date_near"]}}}'
    def side(shift):
        i = F.col("id")
        day = F.date_add(F.lit("2000-01-01").cast("date"), (i % 5000).cast("int")).cast("string")
        cells = F.create_map(F.lit("k"), F.concat(F.lit("key"), F.translate(i.cast("string"), "0123456789", "abcdefghij")), F.lit("n"), (i * 10 + shift).cast("string"), F.lit("d"), day)
        return spark.range(1, 100_001).select(F.lit(1).cast("bigint").alias("instance_id"), i.alias("row_id"), cells.alias("cells"))

    gold, pred = side(0), side(0)
    r = TS.score_tables(spark.createDataFrame([(1, spec)], "instance_id long, evaluation string"), TM.headers_from_rows(gold), gold, TM.headers_from_rows(pred), pred).first()
    n = 100_000
    numbers = sum(min(n, int(i * (1 + 1e-5))) - max(1, -int(-i * (1 - 1e-5) // 1)) + 1 for i in range(1, n + 1))
    days = sum((n // 5000) ** 2 for a in range(5000) for b in range(max(0, a - 31), min(4999, a + 31) + 1))
    assert r.gold_rows == r.predicted_rows == n
    assert r.item_true_positives == n * n + numbers + days
    assert r.row_true_positives >= n


def test_joins_on_keys_normalise_cells_once(spark):
    """A join on the keys must not bring a null check below the normalisation: it ran the rules of all cells again for each key column."""
    x = Inputs(spark, "/root/testdata/sf0.001")
    st, gold, pred = status(x)
    plan = TS.matched_rows(*TM.prepare_sides(st, gold, pred))._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(transform(" not in plan


def test_vocabulary_mapping_lines_cells_up_once_a_scan(spark):
    """Rows are exploded into the key cells that may be mapped, not into all cells with their rules, and without a filter on them."""
    x = Inputs(spark, "/root/testdata/sf0.001")
    st, gold, pred = status(x)
    ready = st.filter("error IS NULL")
    key_map = x.rows.select("instance_id", F.lit("orderkey").alias("column_name"), F.col("orderkey").alias("origin"), F.concat("orderkey", F.lit("*")).alias("transform")).distinct()
    plan = TM.map_vocabulary(TM._aligned(pred, ready, "source"), TM._aligned(gold, ready, "required"), key_map)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with(" not in plan and "isnotnull(transform(" not in plan


def test_cells_of_a_row_travel_once(spark):
    """Equal rows were counted by their key beside the cells that hold it, and the cells of the raw key travelled twice."""
    x = Inputs(spark, "/root/testdata/sf0.001")
    st, gold, pred = status(x)
    plan = TM.prepare_sides(st, gold, pred)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[instance_id#\d+L, vals#\d+\]", plan) and not re.search(r"Aggregate \[[^]]*\bkey#", plan)
    assert not re.search(r"min\(struct\(row_id[^)]*vals", plan)


def test_first_rows_of_keys_at_any_place(spark):
    """The raw key decides which row stays, wherever its columns are; the cells come back in their places."""
    spec = '{"required": ["a", "b", "c"], "unique_columns": ["c", "a"], "eval_pipeline": {"a": {"preprocess": [], "metric": ["exact_match"]}, "b": {"preprocess": ["extract_number"], "metric": ["number_near"], "criterion": 0.1}, "c": {"preprocess": ["norm_str"], "metric": ["exact_match"]}}}'
    rows = [(1, 5, {"a": "x", "b": "no 7", "c": "K"}), (1, 2, {"a": "x", "b": "no 8", "c": "K"}), (1, 3, {"a": "x", "b": "8", "c": "k "}), (1, 4, {"a": "y", "b": "1", "c": "K"}), (1, 6, {"a": "x", "c": "K"})]
    gold = spark.createDataFrame(rows, "instance_id long, row_id long, cells map<string,string>")
    names = TM.headers_from_rows(gold)
    st = TM.instance_status(TM.parse_specs(spark.createDataFrame([(1, spec)], "instance_id long, evaluation string")), names, names)
    got = sorted((tuple(r.key), tuple(r.vals), r.copies) for r in TM.prepare_sides(st, gold, gold)[0].collect())
    assert got == [(("x", "k"), ("x", "8", "k"), 2), (("y", "k"), ("y", "1", "k"), 1)]


def test_shuffle_files_go_with_a_written_table(spark):
    """They stayed beside the written table until the driver happened to collect garbage."""
    files = lambda: {f for _, _, names in os.walk(spark.sparkContext.getConf().get("spark.local.dir")) for f in names if f.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(staging.CLEANUP_KEY)
    counts = [spark.range(1000).groupBy((F.col("id") % n).alias("k")).count() for n in (300, 7, 9)]
    tables = [staged(counts[0], "counts"), *staged_together(*[(c, "counts") for c in counts[1:]])]
    assert not files() - before
    assert [t.count() for t in tables] == [300, 7, 9]
    assert spark.conf.get(staging.CLEANUP_KEY) == setting
