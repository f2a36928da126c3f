"""Views fed in several batches end where the batch job ends, and resume where they stopped."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trailmark.operators import metrics as M
from trailmark.operators import trajectories as T
from trailmark.plans.keyed import latest_by
from trailmark.sources.fixtures import Inputs
from trailmark.streaming import live as L
from trailmark.streaming.tables import BucketTable

DATA = "/root/testdata/sf0.001"


def feed(df, folder, lo, hi):
    df.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(folder)


def test_loop_guard_over_batches(spark, folder):
    calls = Inputs(spark, DATA).tool_calls
    log, root = f"{folder}/log", f"{folder}/view"
    for lo, hi in ((0, 400), (400, 404), (404, 2000)):
        feed(calls, log, lo, hi)
        got = L.loop_guard(L.read_log_stream(spark, log, calls.schema, "parquet"), root)
    want = T.loop_calls(calls)
    assert got.count() == want.count()
    assert got.select(*want.columns).exceptAll(want).count() == 0


def test_guard_keeps_little_and_forgets_at_a_seal(spark, folder):
    """One run over many batches: cycles across batch borders, none across a seal, and a state of a few signatures."""
    schema = "run long, seq long, turn long, name string, arguments string, is_seal boolean"
    calls = [(1, i, i, "search", '{"q": "%s"}' % "abc"[i % 3], False) for i in range(12)]
    calls += [(1, 12, 12, "seal_memory_tool", "{}", True)] + [(1, i, i, "search", '{"q": "a"}', False) for i in range(13, 17)] + [(None, 0, 0, None, None, None)]
    df = spark.createDataFrame(calls, schema)
    log, root = f"{folder}/log", f"{folder}/view"
    for lo in range(0, 18, 2):
        feed(df, log, lo, lo + 2)
        got = L.loop_guard(L.read_log_stream(spark, log, df.schema, "parquet"), root)
    found = {r.seq: (r.segment, r.cycle) for r in got.filter("run = 1").collect()}
    assert found == {i: (0, 3 if i >= 5 else None) for i in range(12)} | {13: (1, None), 14: (1, None), 15: (1, 1), 16: (1, 1)}
    state = spark.read.format("statestore").load(f"{root}/checkpoint").filter("key.run = 1").select("value.groupState.*").collect()
    assert len(state) == 1 and state[0].seals == 1 and len(state[0].signatures) == 4 <= L.HISTORY


def test_count_windows_over_batches(spark, folder):
    samples = Inputs(spark, DATA).metrics
    log, root = f"{folder}/log", f"{folder}/view"
    for lo, hi in ((0, 333), (333, 340), (340, 2000)):
        feed(samples, log, lo, hi)
        got = L.count_windows(L.read_log_stream(spark, log, samples.schema, "parquet"), root, size=20)
    key = lambda rows: sorted((r.metric_name, r.window_idx, round(r.mean, 6), r.min, r.max) for r in rows)
    assert key(got.collect()) == key(M.count_windows(samples, 20).collect())


def test_count_windows_across_batches_with_nulls(spark, folder):
    """A window may take several batches, a batch may bring several windows; nulls count as samples only."""
    rows = [("m", i, None if i % 7 == 0 or 20 <= i < 30 else float(i)) for i in range(47)] + [(None, 0, 1.0)]
    df = spark.createDataFrame(rows, "metric_name string, seq long, value double")
    log, root = f"{folder}/log", f"{folder}/view"
    for lo, hi in ((0, 3), (3, 6), (6, 26), (26, 60)):
        feed(df, log, lo, hi)
        got = L.count_windows(L.read_log_stream(spark, log, df.schema, "parquet"), root, size=10)
    for r in got.collect():
        own = [v for _, i, v in rows[:47] if i // 10 == r.window_idx and v is not None]
        assert (r.metric_name, r.samples, r.mean, r.min, r.max) == ("m", 10, sum(own) / len(own) if own else None, min(own, default=None), max(own, default=None))
    assert sorted(r.window_idx for r in got.collect()) == [0, 1, 2, 3]


def test_latest_and_counters_over_batches(spark, folder):
    reviews = Inputs(spark, DATA).reviews.withColumn("seq", F.col("line"))
    log = f"{folder}/log"
    for lo, hi in ((0, 500), (500, 2000)):
        feed(reviews, log, lo, hi)
        stream = L.read_log_stream(spark, log, reviews.schema, "parquet")
        last = L.latest_records(stream, f"{folder}/last", ["rollout_idx", "question_id"], ["file_rank", "line"], buckets=4)
        live = L.keep_final(L.live_accuracy(stream, ["f1"]), f"{folder}/live", ["rollout_idx"], 4)
    want = latest_by(reviews, ["rollout_idx", "question_id"], ["file_rank", "line"])
    assert last.select("line").exceptAll(want.select("line")).count() == 0 and last.count() == want.count()
    assert live.agg(F.sum("judged")).first()[0] == reviews.count()


def files(root):
    """Data files of a bucketed table with their inode and time."""
    return {str(p): (p.stat().st_ino, p.stat().st_mtime_ns) for p in Path(root).rglob("part-*.parquet") if "/data/" in str(p)}


def test_a_batch_rewrites_its_own_buckets_only(spark, folder):
    df = spark.createDataFrame([(k, i, i) for i, k in enumerate([*range(40), 3, 3, 5, 3])], "k long, v long, seq long")
    log, root, before = f"{folder}/log", f"{folder}/view", {}
    for lo, hi in ((0, 40), (40, 41), (41, 43), (43, 44)):
        feed(df, log, lo, hi)
        got = L.latest_records(L.read_log_stream(spark, log, df.schema, "parquet"), root, ["k"], ["seq"], buckets=8)
        after = files(root)
        if before:
            buckets = lambda names: {n.split("_bucket=")[1].split("/")[0] for n in names}
            assert 1 <= len(buckets(set(after) - set(before))) <= 2  # new files belong to the touched buckets
            assert all(after[n] == before[n] for n in set(after) & set(before)) and len(set(after) & set(before)) >= 6
        before = after
    assert {(r.k, r.v) for r in got.collect()} == {(k, {3: 43, 5: 42}.get(k, k)) for k in range(40)}
    assert len(os.listdir(f"{root}/state/manifest")) == 2  # older versions are gone
    referred = {(b, v) for n in BucketTable(spark, f"{root}/state", df.schema, ["k"], 8).versions() for b, v in BucketTable(spark, f"{root}/state", df.schema, ["k"], 8).manifest(n).items()}
    there = {(int(n.split("_bucket=")[1].split("/")[0]), int(n.split("/data/v")[1].split("/")[0])) for n in files(root)}
    assert there == referred


@pytest.mark.parametrize("cuts", [(0, 400), (0, 7, 13, 60, 61, 200, 400)])
def test_retractions(spark, folder, cuts):
    """A retraction takes back the latest standing record, over any batches; one without a record does nothing."""
    import random

    rng = random.Random(7)
    events = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.random() < 0.45) for i in range(400)]
    stacks = {}
    for k, i, back in events:
        stack = stacks.setdefault(k, [])
        (stack and stack.pop()) if back else stack.append(i)
    df = spark.createDataFrame(events, "k long, seq long, back boolean")
    log, root = f"{folder}/log", f"{folder}/view"
    for lo, hi in zip(cuts, cuts[1:]):
        feed(df, log, lo, hi)
        got = L.latest_records(L.read_log_stream(spark, log, df.schema, "parquet"), root, ["k"], ["seq"], retracts=F.col("back"), buckets=4)
    assert {r.k: r.seq for r in got.collect()} == {k: s[-1] for k, s in stacks.items() if s}


def test_a_replayed_batch_changes_nothing(spark, folder):
    table = BucketTable(spark, folder, spark.createDataFrame([], "k long, n long").schema, ["k"], 4)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    batch = spark.createDataFrame([(1, 1), (2, 1), (1, 1)], "k long, n long")
    for version in (0, 0, 1, 1):
        table.merge(batch, add, version)
    assert {(r.k, r.n) for r in table.read().collect()} == {(1, 4), (2, 2)}
    # a batch that fails leaves the table as it was
    broken = batch.withColumn("n", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception):
        table.merge(broken, add, 2)
    assert {(r.k, r.n) for r in table.read().collect()} == {(1, 4), (2, 2)} and table.versions() == [0, 1]
    table.merge(batch, add, 2)
    assert {(r.k, r.n) for r in table.read().collect()} == {(1, 6), (2, 3)}


def test_counters_go_on_after_a_resumption(spark, folder):
    """Stopped and resumed with the finished records as a start, the counters are those of one run."""
    reviews = Inputs(spark, DATA).reviews.withColumn("seq", F.col("line")).filter("question_id <> ''")
    whole = latest_by(reviews, ["question_id", "rollout_idx"], ["line"])
    first, rest = whole.filter("seq < 500"), whole.filter("seq >= 500")
    log = f"{folder}/log"
    whole.coalesce(1).write.parquet(log)  # the log still holds the finished work, which must not count twice
    for _ in range(2):
        got = L.resumed_accuracy(L.read_log_stream(spark, log, whole.schema, "parquet"), first, f"{folder}/view", ["f1"], buckets=2)
    feed(rest.limit(0), log, 0, 1)
    key = lambda df: sorted((r.rollout_idx, r.judged, r.correct, round(r.f1, 6)) for r in df.collect())
    assert key(got) == key(L.live_accuracy(whole, ["f1"]))
