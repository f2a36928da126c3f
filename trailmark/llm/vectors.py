"""What the vector searches share: usable vectors, blocks, and query blocks against vector blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a block and queries of a block; one task holds one of each.
BLOCK, QUERIES = 16_384, 2_048


def usable(df: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """Rows (id, vector as doubles) that can be compared, and the dimension.

    Null ids, null or empty vectors and vectors with a null or non-finite component take no part. Vectors
    must have one length; the most frequent one counts (of equals the smaller), others take no part.
    """
    value = F.col(vector).cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), value.alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(fine, F.lit(False)))
    top = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    size = top[0]["d"] if top else 0
    return rows.filter(F.size("vector") == size), size


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def against(queries: DataFrame, vectors: DataFrame, blocks: Column | int, found: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``found(vectors of a block, queries of a block)`` to each pair of a query block and a vector block.

    ``vectors`` has a column block. ``queries`` go to the blocks from 0 below ``blocks`` (a column may say how many
    a query needs), in query blocks that are hashed by id, so no task holds more than one block of each side.
    """
    count = queries.count()
    parts = max(1, -(-count // QUERIES))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    last = (F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int") - 1
    asked = asked.filter(last >= 0).withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    dealt = vectors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(found, schema)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query: query_id, rank from 1, vec_id, score; ties to the smaller vec_id.

    A query has at most k hits from each block; they are cut to k on the map side, so no more than that travels."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
