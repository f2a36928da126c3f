"""Live views over append-only logs with Structured Streaming.

Three kinds of state, each of which costs a batch what the batch touches:

* plain counters are streaming aggregations in update mode; a batch hands on the units it changed;
* views that look back in order (call loops, count windows) keep a few values per key in the engine's state store;
* tables per key (latest record, counters that start from finished records) are ``tables.BucketTable``s, merged by batch.

Every batch writes under its own number, so one that is replayed after a failure replaces its own output only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions import variants as V
from trailmark.operators import trajectories as TR
from trailmark.plans.blocks import null_safe_join, running_sums
from trailmark.plans.keyed import latest_by
from trailmark.streaming.tables import BUCKETS, BucketTable


def read_log_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json", files: str | None = None, per_batch: int | None = None) -> DataFrame:
    """Stream of an append-only log folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(folder)


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything available now, then stop; a later call resumes from the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
    )
    query.awaitTermination()


def collected(stream: DataFrame, root: str, name: str) -> DataFrame:
    """Append what each batch brings to its own folder, and return all of it."""
    out = f"{root}/{name}"
    drain(stream, f"{root}/checkpoint", lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def keep_final(stream: DataFrame, root: str, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Run a streaming aggregation by ``keys`` to the end of the available input and return its present result.

    In update mode a batch brings the keys it changed, whose rows replace the older ones in a bucketed table.
    """
    table = BucketTable(stream.sparkSession, f"{root}/result", stream.schema, keys, buckets)

    def replace(old: DataFrame, new: DataFrame) -> DataFrame:
        named = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return old.join(named, same, "left_anti").unionByName(new)

    drain(stream, f"{root}/checkpoint", lambda df, i: table.merge(df, replace, i), "update")
    return table.read()


def live_accuracy(reviews: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Streaming counters per rollout: judged, correct and metric sums."""
    m = V.parsed(reviews, "judge_metrics")
    typed = reviews.select(
        "rollout_idx", V.strictly_true(F.try_parse_json("is_correct")).alias("correct"), *[V.finite_or_zero(V.at(m, f"$.{n}")).alias(n) for n in metrics]
    )
    return typed.groupBy("rollout_idx").agg(
        F.count(F.lit(1)).alias("judged"), F.count_if("correct").alias("correct"), *[F.sum(n).alias(n) for n in metrics]
    )


def live_units(samples: DataFrame) -> DataFrame:
    """Streaming metric accumulation per unit."""
    return samples.groupBy("question_id", "rollout_idx", "metric_name", "metric_type").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def latest_records(stream: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], retracts: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Latest record per key over everything read so far; only the buckets of a batch's keys are written again.

    ``retracts`` marks rows that take back the latest record of their key, so that the one before it counts again; a
    retraction without a record does nothing. The table then keeps every record that is not taken back, at its level: the
    records of its key below it. Levels come from a running sum over the one integer column ``order`` names, and at each
    level records and retractions take turns, so the last event of a level says whether its record stands. Events of a
    key must arrive in order over the batches.
    """
    spark = stream.sparkSession
    if retracts is None:
        table = BucketTable(spark, f"{root}/state", stream.schema, keys, buckets)
        # reduce the batch first: only one row per key meets the state
        drain(stream, f"{root}/checkpoint", lambda df, i: table.merge(latest_by(df, keys, order), lambda old, new: latest_by(old.unionByName(new), keys, order), i))
        return table.read()
    (seq,) = order
    schema = T.StructType(stream.schema.fields).add("_level", T.LongType())
    table = BucketTable(spark, f"{root}/state", schema, keys, buckets)

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        events = batch.withColumn("_back", F.coalesce(retracts, F.lit(False)))
        summed = running_sums(events, keys, seq, {"_sum": F.when(F.col("_back"), F.lit(-1)).otherwise(F.lit(1)).cast("bigint")})
        top = old.groupBy(*keys).agg(F.max("_level").alias("_top"))
        level = F.coalesce("_top", F.lit(0)) + F.col("_sum") + F.when(F.col("_back"), 1).otherwise(0)
        placed = null_safe_join(summed, top, keys, "left").withColumn("_level", level).drop("_top", "_sum")
        both = placed.unionByName(old.withColumn("_back", F.lit(False)))
        return latest_by(both, [*keys, "_level"], [seq]).filter("NOT _back").drop("_back")

    drain(stream, f"{root}/checkpoint", lambda df, i: table.merge(df, merge, i))
    return latest_by(table.read(), keys, ["_level"]).drop("_level")


def skip_finished(stream: DataFrame, finished: DataFrame, root: str, keys: Sequence[str]) -> DataFrame:
    """Rows of the stream that are not finished yet, each batch joined against the finished table."""
    return collected(stream.join(finished, list(keys), "left_anti"), root, "pending")


def resumed_accuracy(stream: DataFrame, finished: DataFrame, root: str, metrics: Sequence[str], keys: Sequence[str] = ("question_id", "rollout_idx"), buckets: int = BUCKETS) -> DataFrame:
    """Counters per rollout of a run that goes on: they start from the finished records, and finished work is skipped.

    ``finished`` holds one record per finished key and must be the same on every resumption; its counters are version -1
    of the table, so a view that was never started begins with them and one that was goes on with its own.
    """
    start = live_accuracy(finished, metrics)
    table = BucketTable(stream.sparkSession, f"{root}/counters", start.schema, ["rollout_idx"], buckets)
    table.merge(start, lambda old, new: new, -1)
    sums = [c for c in start.columns if c != "rollout_idx"]

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy("rollout_idx").agg(*[F.sum(c).alias(c) for c in sums])

    done = finished.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    drain(stream, f"{root}/checkpoint", lambda df, i: table.merge(live_accuracy(df.join(done, same, "left_anti"), metrics), add, i))
    return table.read()


HISTORY = 2 * TR.MAX_CYCLE - 1


def loop_guard(stream: DataFrame, root: str, max_cycle: int = TR.MAX_CYCLE) -> DataFrame:
    """Call loops per run over a stream of calls (run, seq, turn, name, arguments, is_seal).

    The state store holds, per run, the seals seen and the last ``HISTORY`` signatures since the last seal. A turn is
    assumed to arrive within one batch, and batches in seq order; only signatures travel, never arguments. A batch's rows of one run
    meet in one task, so ``per_batch`` of ``read_log_stream`` is what bounds it.
    """
    sig = F.sha2(V.call_signature(F.col("name"), F.coalesce("arguments", F.lit("{}"))), 256)
    calls = stream.select("run", "seq", "turn", F.col("name").isin(*TR.MEMORY_TOOLS).alias("mem"), F.coalesce("is_seal", F.lit(False)).alias("is_seal"), sig.alias("sig"))

    def guard(key: tuple, chunks: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks)).sort_values("seq")
        segment, history = state.get if state.exists else (0, [])
        history, out = list(history), []
        skipped = set(rows["turn"][rows["mem"].fillna(False).astype(bool)])
        for seq, turn, seal, mark in zip(rows["seq"], rows["turn"], rows["is_seal"], rows["sig"]):
            if turn not in skipped:
                history = [mark, *history[:HISTORY]]
                out.append((key[0], seq, segment, _cycle(history, max_cycle)))
            if seal:
                segment, history = segment + 1, []
        state.update((segment, history[:HISTORY]))
        yield pd.DataFrame(out, columns=["run", "seq", "segment", "cycle"]).astype({"cycle": "Int32"})

    cycles = calls.groupBy("run").applyInPandasWithState(guard, "run bigint, seq bigint, segment bigint, cycle int", "seals bigint, signatures array<string>", "append", "NoTimeout")
    return collected(cycles, root, "cycles")


def _cycle(history: list[str | None], longest: int) -> int | None:
    """As ``trajectories.repeat_cycle`` on a list of signatures, newest first."""
    for n in range(1, min(max(longest, 0), TR.MAX_CYCLE) + 1):
        span = max(2 * n, 3)
        if len(history) >= span and all(history[i] is not None and history[i] == history[i + n] for i in range(span - n)):
            return n
    return None


def count_windows(stream: DataFrame, root: str, size: int = 200) -> DataFrame:
    """Full windows of ``size`` samples per metric over a stream (metric_name, seq, value), batches in seq order.

    The state store holds, per metric, the number of windows sent out and the count, sum, least and largest value of the
    open one; a window is sent out by its last sample. Null values count as samples but not into the figures.
    """

    def windows(key: tuple, chunks: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        values = pd.concat(list(chunks)).sort_values("seq")["value"].astype(float)
        index, samples, open_ = state.get if state.exists else (0, 0, None)
        part = pd.DataFrame({"value": values.to_numpy(), "window": index + (samples + pd.RangeIndex(len(values))) // size})
        got = part.groupby("window")["value"].agg(["size", "count", "sum", "min", "max"]).reset_index()
        if samples:
            _, held, total, low, high = (samples, *open_)
            first = got.index[0]
            got.loc[first, ["size", "count", "sum"]] += [samples, held, total]
            got.loc[first, "min"], got.loc[first, "max"] = pd.Series([got.at[first, "min"], low]).min(), pd.Series([got.at[first, "max"], high]).max()
        full = got[got["size"] == size]
        rest = got[got["size"] < size]
        kept = (int(rest["size"].iloc[0]), (int(rest["count"].iloc[0]), float(rest["sum"].iloc[0]), float(rest["min"].iloc[0]), float(rest["max"].iloc[0]))) if len(rest) else (0, None)
        state.update((index + len(full), *kept))
        mean = (full["sum"] / full["count"]).where(full["count"] > 0)
        yield pd.DataFrame({"metric_name": key[0], "window_idx": full["window"].astype("int64"), "mean": mean, "min": full["min"], "max": full["max"], "samples": full["size"].astype("int64")})

    samples = stream.select("metric_name", "seq", F.col("value").cast("double").alias("value"))
    state = "windows bigint, samples bigint, open struct<n:bigint,total:double,min:double,max:double>"
    ended = samples.groupBy("metric_name").applyInPandasWithState(windows, "metric_name string, window_idx bigint, mean double, min double, max double, samples bigint", state, "append", "NoTimeout")
    return collected(ended, root, "windows")
