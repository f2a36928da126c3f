"""Approximate nearest neighbours by multi-index hashing.

Vectors of length one become binary codes: centred, projected on their principal axes and turned by a
rotation that is learned to bring them near the corners of the cube (iterative quantisation). The codes
are split into substrings of 8 bits. The index is partitioned by vectors: each block keeps, for every
substring, its rows ordered by that substring's value. Codes within Hamming radius r of a query's agree with it up to r_j
bits in some substring j, whenever the r_j + 1 add up to r + 1; probing all values within r_j of the
query's in each substring retrieves them all. What is retrieved is checked by the whole code and ranked by
exact cosine in double precision.

Rotation and radius are learned from at most ``sample`` vectors in order of a hash of their id; every
vector is indexed. The radius is the least that holds ``recall`` of the sample's own nearest neighbours; a
larger table has nearer neighbours, so this errs on the safe side. A block in which fewer than k rows lie within the
radius is probed with a larger one until it gives k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import staged
from trailmark.llm.vectors import BLOCK, against, matrix, ranked, usable

_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


@dataclass
class Coder:
    """Centre and projection of the codes (a multiple of 8 bits), and the search radius."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """Codes of vectors as bytes."""
        unit = rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))
        return np.packbits((unit - self.mean) @ self.axes > 0, axis=1)


def learn(rows: np.ndarray, k: int = 5, recall: float = 0.97, rounds: int = 30, seed: int = 42, asked: int = 500, most_bits: int = 64) -> Coder:
    """Fit rotation and radius on sample rows. Dimensions beyond the code's width only reach it through the principal axes."""
    size = rows.shape[1]
    bits = min(most_bits, -(-size // 8) * 8)
    unit = rows / np.sqrt((rows**2).sum(axis=1, keepdims=True)) if len(rows) else rows
    mean = unit.mean(axis=0) if len(rows) else np.zeros(size)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred) if len(rows) else (None, np.eye(size))
    axes = axes[:, ::-1][:, :bits]
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(axes.shape[1], bits)) if axes.shape[1] >= bits else rng.normal(size=(bits, bits)))[0][: axes.shape[1]]
    shadow = centred @ axes
    for _ in range(rounds if len(rows) and axes.shape[1] == bits else 0):
        corners = np.where(shadow @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(corners.T @ shadow)
        turn = (left @ right).T
    coder = Coder(mean, axes @ turn, bits)
    if len(rows) > k:
        codes = coder.codes(rows)
        some = np.linspace(0, len(rows) - 1, min(asked, len(rows))).astype(int)
        near = unit[some] @ unit.T
        near[np.arange(len(some)), some] = -np.inf
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        apart = np.bitwise_count(codes[some][:, None, :] ^ codes[best]).sum(axis=2)
        coder.radius = int(np.quantile(apart, recall, method="higher"))
    return coder


def budgets(radius: int, parts: int) -> list[int]:
    """Radii of the substrings whose successors add up to radius + 1; -1 means that the substring needs no probe."""
    return [(radius + 1) // parts + (j < (radius + 1) % parts) - 1 for j in range(parts)]


class Index:
    """The substring tables of one block."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.orders = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.orders)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius, by probing."""
        met = np.zeros(len(self.codes), bool)
        for j, own in enumerate(budgets(radius, self.codes.shape[1])):
            starts = self.starts[j]
            for value in np.flatnonzero(_NEAR[code[j]] <= own).tolist() if own >= 0 else ():
                met[self.orders[j][starts[value] : starts[value + 1]]] = True
        rows = np.flatnonzero(met)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def search(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", *, every: int = 50, k: int = 5, sample: int = 20_000, recall: float = 0.97) -> DataFrame:
    """The k nearest rows by cosine of each row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    See `usable` for vectors that take no part; zero vectors take no part either. Rows with the query's own id are
    no candidates; other repeated ids are candidates row by row, and a repeated query id counts once. Fewer than k
    candidates are all returned. Other columns are not read. An empty table gives an empty table.
    """
    rows, size = usable(df, id_col, vector)
    # divided by a power of two near its largest component a vector keeps its digits, and no square overflows or vanishes
    top = F.array_max(F.transform("vector", F.abs))
    scaled = F.transform("vector", lambda x: x / F.col("by"))
    rows = rows.withColumn("by", F.pow(F.lit(2.0), F.floor(F.log2(top)))).filter(top > 0).select("id", scaled.alias("vector"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    count = rows.count()
    blocks = max(1, -(-count // BLOCK))
    some = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(sample).collect()
    coder = learn(np.array([r["vector"] for r in some], float).reshape(-1, max(size, 1)), k, recall)
    schema = "query_id bigint, vec_id bigint, score double"

    def found(block: pa.Table, asked: pa.Table) -> pa.Table:
        ids, vectors = block["id"].to_numpy(), matrix(block["vector"], size)
        out: tuple[list, list, list] = ([], [], [])
        if len(ids):
            index = Index(coder.codes(vectors))
            length = np.sqrt((vectors**2).sum(axis=1))
            queries = matrix(asked["vector"], size)
            for own, query, code in zip(asked["id"].to_pylist(), queries, coder.codes(queries) if len(queries) else ()):
                radius = coder.radius
                while True:
                    near = index.within(code, radius)
                    near = near[ids[near] != own]
                    if len(near) >= k or radius >= 8 * len(code):
                        break
                    radius += 2
                rough = (vectors[near] @ query) / length[near]
                if len(near) > k:
                    bar = np.partition(rough, -k)[-k]
                    near = near[rough >= bar - 1e-9 * max(1.0, abs(bar))]
                score = (vectors[near] * query).sum(axis=1) / (length[near] * np.sqrt((query**2).sum()))
                for i in np.lexsort((ids[near], -score))[:k]:
                    for column, value in zip(out, (own, int(ids[near[i]]), float(score[i]))):
                        column.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    indexed = rows.select("id", "vector", "row").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    return ranked(against(queries, indexed, blocks, found, schema), k)
