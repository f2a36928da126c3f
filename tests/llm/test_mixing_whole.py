"""Every source is a category of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import mixing


def test_raking_of_a_table_is_the_plain_one(spark):
    cells = [(s, g) for s in "abc" for g in "xy"]
    tokens = [50, 10, 30, 30, 20, 60]
    targets = [{"a": 0.4, "b": 0.6}, {"x": 0.5, "y": 0.5}]
    table = spark.createDataFrame([(*c, t) for c, t in zip(cells, tokens)], "s string, g string, t long")
    wanted = [spark.createDataFrame(list(t.items()), f"{k} string, wanted double") for k, t in zip("sg", targets)]
    found = {(r.s, r.g): r.probability for r in mixing.rake_table(table, ["s", "g"], wanted, 80, 200, rounds=3).collect()}
    plain = mixing.rake(cells, np.array(tokens, float), targets, 80, rounds=3)
    assert [found[c] for c in cells] == pytest.approx(plain.tolist())


def test_many_sources_keep_their_targets(spark):
    rows = [(i, "some words here " * (4 if i % 250 else 40), "en", f"s{i % 250}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"s0": 0.5, "s249": 0.5}}
    plan = mixing.sampling_plan(docs, keep=0.02, topics=1, targets=targets)
    shares = {r.source: r.e for r in plan.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("e")).collect()}
    assert len(shares) == 250 and shares["s249"] > 0 and all(v == 0 for s, v in shares.items() if s not in targets["source"])
    assert shares["s249"] == pytest.approx(48)  # its target is beyond its tokens, so all of it is kept
    assert plan.count() == 1000
