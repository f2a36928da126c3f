"""Ordered computations over blocks agree with plain Python, also when one key holds most rows."""

import random

from pyspark.sql import functions as F

from trailmark.plans.blocks import lagged, row_numbers, running_sums
from trailmark.plans.keyed import first_by, latest_by


def skewed(spark):
    rng = random.Random(7)
    seqs = rng.sample(range(5000), 600)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}", s, rng.randrange(10)) for s in seqs]
    return rows, spark.createDataFrame(rows, "k string, seq bigint, v bigint")


def by_key(rows):
    out = {}
    for k, s, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((s, v))
    return out


def test_running_sums(spark):
    rows, df = skewed(spark)
    got = {(r.k, r.seq): (r.a, r.b) for r in running_sums(df, ["k"], "seq", {"a": F.col("v"), "b": F.lit(1)}, width=16).collect()}
    before = {(r.k, r.seq): r.a for r in running_sums(df, ["k"], "seq", {"a": F.col("v")}, before=True, width=16).collect()}
    assert len(got) == len(rows)
    for k, items in by_key(rows).items():
        total = 0
        for i, (s, v) in enumerate(items, 1):
            assert before[k, s] == total
            total += v
            assert got[k, s] == (total, i)


def test_row_numbers_ignore_block_width(spark):
    _, df = skewed(spark)
    a = row_numbers(df, ["k"], "seq", "n", width=7)
    b = row_numbers(df, ["k"], "seq", "n", width=10**9)
    assert a.exceptAll(b).count() == 0


def test_lagged_crosses_sparse_blocks(spark):
    rows, df = skewed(spark)
    got = {(r.k, r.seq): r.p for r in lagged(df, ["k"], "seq", F.col("v").cast("string"), 5, "p", width=8).collect()}
    for k, items in by_key(rows).items():
        for i, (s, _) in enumerate(items):
            past = [str(v) for _, v in items[max(0, i - 5) : i]][::-1]
            assert got[k, s] == past + [None] * (5 - len(past))


def test_picks(spark):
    rows, df = skewed(spark)
    last = {r.k: (r.seq, r.v) for r in latest_by(df, ["k"], ["seq"]).collect()}
    first = {r.k: (r.seq, r.v) for r in first_by(df, ["k"], ["seq"]).collect()}
    for k, items in by_key(rows).items():
        assert last[k] == items[-1] and first[k] == items[0]


def test_sparse_order_and_nulls(spark):
    """Order values spread over 10^12, null keys and null order values: no row is lost."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", None, "cold"]), s, rng.randrange(10)) for s in rng.sample(range(10**12), 400)]
    nulls = [("hot", None, 5), (None, None, 7)]
    df = spark.createDataFrame(rows + nulls, "k string, seq bigint, v bigint")
    sums = running_sums(df, ["k"], "seq", {"a": F.col("v")}).collect()
    past = lagged(df, ["k"], "seq", F.col("v"), 3, "p").collect()
    assert len(sums) == len(past) == len(df.collect())
    got = {(r.k, r.seq): r.a for r in sums}
    behind = {(r.k, r.seq): r.p for r in past}
    first = {"hot": [5], None: [7]}
    for k, items in by_key(rows).items():
        values = list(first.get(k, []))
        for s, v in items:
            assert behind[k, s] == (values[::-1] + [None] * 3)[:3]
            values.append(v)
            assert got[k, s] == sum(values)
    assert got["hot", None] == 5 and behind[None, None] == [None] * 3


def test_picks_carry_the_order_columns_once(spark):
    """The order column is part of the picked row: a second copy of it was shuffled; columns without an order fall back."""
    df = spark.createDataFrame([(k, i, f"v{i}", {"m": i}) for i, k in enumerate([1, None, 1, 2, None, 2, 2])], "k int, i int, v string, m map<string,int>")
    flat = df.drop("m")
    for hashed in (True, False):
        first, last = first_by(flat, ["k"], ["i"], hashed), latest_by(flat, ["k"], ["i"], hashed)
        assert {tuple(r) for r in first.collect()} == {(1, 0, "v0"), (None, 1, "v1"), (2, 3, "v3")}
        assert {tuple(r) for r in last.collect()} == {(1, 2, "v2"), (None, 4, "v4"), (2, 6, "v6")}
        plan = first._jdf.queryExecution().optimizedPlan().toString()
        assert "min_by" not in plan and ("xxhash64" in plan) == hashed
    assert {(r.k, r.m["m"]) for r in latest_by(df, ["k"], ["i"]).collect()} == {(1, 2), (None, 4), (2, 6)}
    assert {(r.k, r.i) for r in first_by(flat, ["k"], [-F.col("i")]).collect()} == {(1, 2), (None, 4), (2, 6)}


def test_picks_of_rows_with_variants(spark):
    """A variant has no order, also inside a structure or an array, so the row that holds one can't be compared itself."""
    variants = spark.range(6).select((F.col("id") % 2).alias("k"), F.col("id").alias("i"), F.try_parse_json(F.concat(F.lit('{"m": '), F.col("id").cast("string"), F.lit("}"))).alias("v"))
    for shape in (F.col("v"), F.struct("v"), F.array("v")):
        df = variants.withColumn("v", shape)
        last, first = (pick(df, ["k"], ["i"]).select("k", "i", F.to_json(F.struct("v")).alias("v")).collect() for pick in (latest_by, first_by))
        assert {(r.k, r.i) for r in last} == {(0, 4), (1, 5)} and all(f'"m":{r.i}' in r.v for r in last)
        assert {(r.k, r.i) for r in first} == {(0, 0), (1, 1)} and all(f'"m":{r.i}' in r.v for r in first)
