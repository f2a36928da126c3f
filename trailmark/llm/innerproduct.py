"""Exact top-k inner products over norm-sorted vectors with rotated partial sums.

Vectors become whole numbers, floor(scale x). They are processed by descending length: the longest make the
first block, which gives every query a k-th best score to beat; by Cauchy-Schwarz a query needs no block
whose longest vector times its own length is below that, and blocks further down are shorter still, so each
query visits a prefix of the blocks. Inside a block, vectors and queries are turned by the right singular
vectors of the whole table, so that the first coordinates hold most of the products: after each group of coordinates the sum so
far plus the product of the lengths of what is left bounds the score, and vectors below the bar are dropped.
Bounds carry a margin for rounding; scores are computed in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import staged
from trailmark.llm.vectors import BLOCK, against, matrix, ranked, usable

#: Coordinates after which the bound is looked at, as shares of all.
STOPS = (0.25, 0.5, 0.75)


def axes(rows: DataFrame, size: int) -> np.ndarray:
    """Right singular vectors of the whole table of vectors, by descending singular value (from its matrix of second moments)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = matrix(batch["vector"], size).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(size * size), pa.int32()), pa.array(total.ravel())], ["cell", "sum"])

    out = np.zeros(size * size)
    for r in rows.select("vector").mapInArrow(moments, "cell int, sum double").groupBy("cell").agg(F.sum("sum").alias("sum")).collect():  # dimension squared
        out[r["cell"]] = r["sum"]
    return np.linalg.eigh(out.reshape(size, size))[1][:, ::-1]


def candidates(query: np.ndarray, vectors: np.ndarray, bar: float, stops: list[int]) -> np.ndarray:
    """Rows of turned ``vectors`` whose product with the turned query can reach the bar."""
    alive = np.arange(len(vectors))
    done, sums = 0, np.zeros(len(vectors))
    for stop in stops:
        sums = sums + vectors[alive, done:stop] @ query[done:stop]
        rest = np.sqrt((query[stop:] ** 2).sum()) * np.sqrt((vectors[alive, stop:] ** 2).sum(axis=1))
        keep = sums + rest >= bar
        alive, sums, done = alive[keep], sums[keep], stop
    return alive


def search(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", *, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k largest inner products of each row whose id is divisible by ``every``: query_id, rank, vec_id, score (whole numbers).

    See `usable` for vectors that take no part. Scores that could pass 64 bits are computed with whole numbers of any size; one
    that does is an error, as are components that don't fit 64 bits after scaling. Zero vectors do take part, with score 0. Rows with the query's own id are no candidates; other repeated ids are candidates row
    by row, and a repeated query id counts once. Other columns are not read. An empty table gives an empty table.
    """
    rows, size = usable(df, id_col, vector)
    whole = F.transform("vector", lambda x: F.floor(x * scale).cast("bigint"))
    most = rows.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0.0
    if most * scale >= 2.0**63:
        raise OverflowError("a scaled component doesn't fit 64 bits")
    wide = size * (most * scale + 1) ** 2 >= 2.0**62
    rows = rows.select("id", whole.alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    rows = staged(rows.withColumn("length", length), "whole")
    count = rows.count()
    blocks = max(1, -(-count // BLOCK))
    sorted_ = staged(rows.repartitionByRange(blocks, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id").withColumn("block", F.spark_partition_id()), "sorted")
    # the longest vector of each block, one number a block; blocks without rows have that of the block before
    longest = {r["block"]: r["top"] for r in sorted_.groupBy("block").agg(F.max("length").alias("top")).collect()}
    start = min(longest, default=0)
    tops = pd.Series(longest, dtype=float).reindex(range(max(longest, default=-1) + 1)).ffill().bfill().to_numpy()
    turn = axes(rows, size) if size else np.zeros((0, 0))
    stops = sorted({max(1, round(size * s)) for s in STOPS})
    schema = "query_id bigint, vec_id bigint, score bigint"

    def found(block: pa.Table, asked: pa.Table) -> pa.Table:
        ids, vectors = block["id"].to_numpy(), matrix(block["vector"], size) if block.num_rows else np.zeros((0, size), np.int64)
        out: tuple[list, list, list] = ([], [], [])
        order = np.argsort(-block["length"].to_numpy(), kind="stable")
        ids, vectors = ids[order], vectors[order]
        exact = vectors.astype(object) if wide else vectors
        lengths = block["length"].to_numpy()[order]
        turned = vectors @ turn
        for own, query, size_, bar in zip(asked["id"].to_pylist(), matrix(asked["vector"], size) if asked.num_rows else (), asked["length"].to_pylist(), asked["bar"].to_pylist()):
            if bar is None or np.isnan(bar):  # the first block sets the bar by its longest vectors
                head = exact[: 4 * k + 64] @ (query.astype(object) if wide else query)
                others = head[ids[: len(head)] != own]
                bar = float(sorted(others)[-k]) if len(others) >= k else -np.inf
            slack = 1e-9 * size_ * (lengths[0] if len(lengths) else 0.0) + 1e-6
            prefix = len(lengths) if bar <= slack else int(np.searchsorted(-lengths * size_, -(bar - slack), side="right"))
            near = candidates(query @ turn, turned[:prefix], bar - slack, stops)
            near = near[ids[near] != own]
            scores = exact[near] @ (query.astype(object) if wide else query)
            if wide:
                if max(map(abs, scores), default=0) >= 1 << 63:
                    raise OverflowError("an inner product doesn't fit 64 bits")
                scores = scores.astype(np.int64)
            for i in np.lexsort((ids[near], -scores))[:k]:
                for column, value in zip(out, (own, int(ids[near[i]]), int(scores[i]))):
                    column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("vector", "length")).alias("v")).select("id", "v.vector", "v.length")
    first = ranked(staged(against(queries.withColumn("bar", F.lit(None).cast("double")), sorted_.filter(F.col("block") == start).withColumn("block", F.lit(0)), 1, found, schema), "first"), k)
    bars = first.groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("n")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("bar").cast("double")).otherwise(float("-inf")).alias("bar"))
    barred = staged(queries.join(bars, "id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf")))), "barred")
    @F.pandas_udf("int")
    def reach(length: pd.Series, bar: pd.Series) -> pd.Series:
        """The number of first blocks whose longest vector can reach the bar; lengths only fall, so they are a prefix."""
        need = np.where(bar <= 0, -np.inf, (bar * (1 - 1e-9) - 1e-6) / np.maximum(length, 1e-300))
        return pd.Series(np.searchsorted(-tops, -need, side="right").astype(np.int32))

    return ranked(against(barred, sorted_, reach(F.col("length"), F.col("bar")), found, schema), k)
