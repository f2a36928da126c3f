"""What the operators share: reading tables, the learning split, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.plans.staging import staged, unstage

__all__ = ["components", "held_out", "send_if_small", "staged", "table", "unstage"]

#: Rows of a key table up to which it is sent to all executors; beyond, the join shuffles.
SEND_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables of a folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether labels of this document may not be learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def send_if_small(keys: DataFrame) -> DataFrame:
    """A written table of short keys, marked for broadcast only if it has been counted to be small."""
    return F.broadcast(keys) if keys.count() <= SEND_ROWS else keys


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table ``(a, b)`` of any orderable type.

    Returns ``(node, component)`` for every node that has a smaller node in its component; the
    component is its smallest node, so nodes that are not returned are their own component.

    Distributed union-find by alternating stars: every node first links its larger neighbours and
    then its smaller ones to the smallest node it knows. A round is a few hash joins and a minimum
    per node that combines before the shuffle; no neighbour list is ever gathered. Each round is a
    written table, so a lost executor repeats tasks and not rounds. Null ends are no edges.
    """
    real = edges.filter("a is not null and b is not null and a <> b")
    now = staged(real.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = staged(small.union(low).distinct(), "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]
