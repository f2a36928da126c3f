"""Ordered computations per key, split into blocks of the order column.

A window partitioned by run, question or metric name puts all rows of one key into one task. Here
the integer order column is cut into fixed-width blocks first: the per-row window runs inside
``(key, block)``, and only one summary row per block crosses block borders. The summaries are treated
the same way again, in blocks of blocks, so a sparse order column (time stamps, global ids), which leaves
few rows in each block, doesn't bring a key's summaries together either. Nothing is dropped and
no statistics are needed; a key with few rows has few blocks.

The order column must be unique within its key. A null key is a key like any other. Rows with a null
order value come before all others of their key, in an order of their own that is not fixed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
#: Levels of blocks of blocks above the first; one leaves a key a summary for each 2^32 of its span.
LEVELS = 1


def _blocked(df: DataFrame, seq: str, width: int) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(seq) / F.lit(width)).cast("bigint"))


def null_safe_join(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal names, nulls being equal; the names are returned once."""
    other = right.select(*[F.col(n).alias(f"_k{i}") if n in names else F.col(n) for i, n in enumerate(right.columns)])
    keys = {n: f"_k{i}" for i, n in enumerate(right.columns) if n in names}
    return left.join(other, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(k)) for n, k in keys.items()]), how).drop(*keys.values())


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    sums: dict[str, Column],
    *,
    before: bool = False,
    width: int = BLOCK,
    levels: int = LEVELS,
) -> DataFrame:
    """Add running totals per key in ``seq`` order; ``before=True`` leaves the row itself out."""
    names = list(sums)
    own = [f"_v{levels}_{i}" for i in range(len(names))]
    base = _blocked(df.withColumns(dict(zip(own, sums.values()))), seq, width).withColumnRenamed("_blk", f"_b{levels}")
    block = f"_b{levels}"
    group = [*keys, block]
    totals = base.groupBy(*group).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(own)])
    carried = {f"_c{i}": F.col(f"_t{i}") for i in range(len(names))}
    if levels:
        carry = running_sums(totals, keys, block, carried, before=True, width=width, levels=levels - 1)
    else:
        ahead = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(*group, *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(n) for n, c in carried.items()])
    carry = carry.select(*group, *carried)
    inside = (
        Window.partitionBy(*group).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    )
    return null_safe_join(base, carry, group).select(
        *df.columns,
        *[(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_c{i}")).alias(n) for i, (n, v) in enumerate(zip(names, own))],
    )


def row_numbers(df: DataFrame, keys: Sequence[str], seq: str, name: str, width: int = BLOCK) -> DataFrame:
    """Add a one-based position per key in ``seq`` order."""
    return running_sums(df, keys, seq, {name: F.lit(1).cast("bigint")}, width=width)


def _halo(tails: DataFrame, keys: Sequence[str], depth: int, width: int, levels: int) -> DataFrame:
    """For each block the last ``depth`` values before it, from each block's own last values; nearest first."""
    before = lambda *part: F.flatten(F.collect_list("_tail").over(Window.partitionBy(*part).orderBy(F.col("_blk").desc()).rowsBetween(1, depth)))
    if not levels:
        return tails.select(*keys, "_blk", F.slice(before(*keys), 1, depth).alias("_halo"))
    parts = tails.withColumn("_sup", F.floor(F.col("_blk") / F.lit(width)).cast("bigint"))
    from_end = Window.partitionBy(*keys, "_sup").orderBy(F.col("_blk").desc())
    last = parts.withColumn("_r", F.row_number().over(from_end)).filter(F.col("_r") <= depth)
    sorted_ = F.array_sort(F.collect_list(F.struct("_r", "_tail")))
    whole = last.groupBy(*keys, "_sup").agg(F.slice(F.flatten(F.transform(sorted_, lambda t: t["_tail"])), 1, depth).alias("_tail"))
    outer = _halo(whole.withColumnRenamed("_sup", "_blk"), keys, depth, width, levels - 1).withColumnRenamed("_blk", "_sup")
    near = parts.select(*keys, "_blk", "_sup", before(*keys, "_sup").alias("_near"))
    return null_safe_join(near, outer, [*keys, "_sup"]).select(*keys, "_blk", F.slice(F.concat("_near", "_halo"), 1, depth).alias("_halo"))


def lagged(
    df: DataFrame, keys: Sequence[str], seq: str, value: Column, depth: int, name: str, width: int = BLOCK
) -> DataFrame:
    """Add an array holding the values of the ``depth`` preceding rows of the key, nearest first.

    Each block hands its last ``depth`` values on; since a block has at least one row, the last
    ``depth`` blocks always hold enough of them.
    """
    base = _blocked(df, seq, width).withColumn("_val", value)
    group = [*keys, "_blk"]
    inside = Window.partitionBy(*group).orderBy(seq)
    from_end = Window.partitionBy(*group).orderBy(F.col(seq).desc())
    tails = (
        base.select(*group, seq, "_val", F.row_number().over(from_end).alias("_r"))
        .filter(F.col("_r") <= depth)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_r"), F.col("_val")))).alias("_tail"))
    )
    halo = _halo(tails, keys, depth, width, LEVELS)
    pos = F.row_number().over(inside)
    own = [F.lag(F.struct(F.col("_val").alias("v")), i).over(inside) for i in range(1, depth + 1)]
    joined = null_safe_join(base, halo, group).select(
        *df.columns, "_halo", pos.alias("_pos"), *[c.alias(f"_l{i}") for i, c in enumerate(own, 1)]
    )
    picks = [
        F.when(F.col("_pos") > i, F.col(f"_l{i}")["v"]).otherwise(
            F.get(F.col("_halo"), F.lit(i) - F.col("_pos"))["_val"]
        )
        for i in range(1, depth + 1)
    ]
    return joined.select(*df.columns, F.array(*picks).alias(name))
