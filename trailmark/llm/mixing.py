"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The token totals of the cells are raked: in turn
for each margin, the weights of its categories are scaled so that the weighted tokens meet the target,
with no weight above 1, until all margins hold. A cell's weight is the probability with which each of its
documents is kept, decided by a hash of the document, so the choice is the same on every run and
after every retry.

Every category is kept. The table of cells is counted: up to `DRIVER_CELLS` cells are raked on the driver, more
of them as a Spark table, each step a sum per category joined back, with only the largest change of a weight on
the driver. Tokens are white-space separated words.

Topics come from spherical k-means over all documents: word counts hashed to ``DIMENSIONS`` sums, as
logarithms less their part in the corpus mean. Vectors and sums are whole numbers, so every run adds up to
the same centres whatever the order of the rows.
"""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import send_if_small, staged, unstage

_log = logging.getLogger(__name__)

DIMENSIONS = 64
#: Cells up to which the raking runs on the driver.
DRIVER_CELLS = 100_000
NONE = "(none)"
#: A written row number that `sample` gives its documents.
ROW = "_mixing_row"
_HASHED = 200_000  # words whose hash a worker keeps


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        totals, sizes = [], []
        for text in batch["text"].to_pylist():
            words = Counter((text or "").lower().encode("utf-8", "surrogatepass").split())
            sums = np.zeros(DIMENSIONS)
            for word, n in words.items():
                place = known.get(word)
                if place is None:
                    if len(known) > _HASHED:
                        known.clear()
                    place = known[word] = xxhash.xxh64_intdigest(word) % DIMENSIONS
                sums[place] += n
            size = sum(words.values())
            totals.append(np.rint(1000 * np.log1p(sums * (1000 / max(size, 1)))).astype(np.int32))
            sizes.append(size)
        flat = pa.array(np.concatenate(totals) if totals else np.empty(0, np.int32))
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sizes) * DIMENSIONS + 1, DIMENSIONS, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("row", "id", "source", "lang")], pa.array(sizes, pa.int64()), vectors], ["row", "id", "source", "lang", "tokens", "vector"])


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """row (as given, else numbered), id, source, lang (nulls named), tokens and word vector of every whole document."""
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    named = docs.select(row.alias("row"), F.col(id_col).cast("bigint").alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(n) for c, n in ((source, "source"), (lang, "lang"))], F.col(text).cast("string").alias("text"))
    return named.mapInArrow(_counts, "row bigint, id bigint, source string, lang string, tokens bigint, vector array<int>")


class Topics(NamedTuple):
    mean: np.ndarray
    centres: np.ndarray

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the nearest centre; the first of equals."""
        return np.argmax(np.round((vectors - self.mean) @ self.centres.T, 6), axis=1) if len(vectors) else np.empty(0, np.int64)

    def of(self, vector: Column) -> Column:
        own = self

        @F.pandas_udf("int")
        def topic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                yield pd.Series(own.nearest(np.array(rows.tolist(), float).reshape(-1, DIMENSIONS)).astype(np.int32))

        return topic(vector)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-12)


def learn_topics(vectors: DataFrame, topics: int = 8, rounds: int = 4) -> Topics:
    """Centres after a fixed number of rounds over all rows; the first centres are the rows with the least hashes of distinct vectors."""

    def sums(model: Topics | None) -> dict[int, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                rows = np.array(batch["vector"].to_pylist(), np.int64).reshape(-1, DIMENSIONS)
                near = model.nearest(rows) if model else np.zeros(len(rows), np.int64)
                for t in np.unique(near):
                    part = np.append(rows[near == t].sum(axis=0), (near == t).sum())
                    total[int(t)] = total.get(int(t), 0) + part
            for t, row in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(row), pa.int32()), pa.array(range(len(row)), pa.int32()), pa.array(row.tolist(), pa.int64())], ["topic", "place", "sum"])

        parts = vectors.select("vector").mapInArrow(add, "topic int, place int, sum bigint").groupBy("topic", "place").agg(F.sum("sum").alias("sum"))
        out: dict[int, np.ndarray] = {}
        for r in parts.collect():  # topics times dimensions
            out.setdefault(r["topic"], np.zeros(DIMENSIONS + 1))[r["place"]] = r["sum"]
        return out

    whole = sums(None).get(0, np.ones(DIMENSIONS + 1))
    mean = whole[:-1] / max(whole[-1], 1)
    seeds = vectors.groupBy("vector").agg(F.count("*")).select("vector").orderBy(F.xxhash64("vector"), "vector").limit(topics).collect()
    model = Topics(mean, _unit(np.array([r["vector"] for r in seeds], float).reshape(-1, DIMENSIONS) - mean) if seeds else np.zeros((1, DIMENSIONS)))
    for _ in range(rounds):
        found = sums(model)
        centres = model.centres.copy()
        for t, row in found.items():
            centres[t] = _unit((row[:-1] / row[-1] - mean)[None])[0]
        model = Topics(mean, centres)
    return model


def tempered(totals: Mapping[str, float], power: float) -> dict[str, float]:
    """Target shares between the natural ones (power 1) and equal ones (power 0)."""
    raised = {k: float(v) ** power if v else 0.0 for k, v in totals.items()}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


def rake(cells: list[tuple[str, ...]], tokens: np.ndarray, targets: list[Mapping[str, float]], total: float, rounds: int = 500, close: float = 1e-6) -> np.ndarray:
    """Weights from 0 to 1 of the cells whose weighted tokens have the target shares of ``total`` in every margin.

    Where a category has too few tokens for its target, its weights stay at 1 and the margins are met as nearly as that allows.
    """
    if not cells:
        return np.empty(0)
    weight = np.full(len(cells), min(1.0, total / max(tokens.sum(), 1)))
    sides = []
    for m, target in enumerate(targets):
        names = sorted({c[m] for c in cells})
        places = {n: i for i, n in enumerate(names)}
        sides.append((np.array([places[c[m]] for c in cells], int), np.array([target.get(n, 0.0) * total for n in names])))
    for _ in range(rounds):
        off = 0.0
        for place, wanted in sides:
            have = np.bincount(place, weights=weight * tokens, minlength=len(wanted))
            factor = np.divide(wanted, have, out=np.ones_like(have), where=have > 0)
            moved = np.minimum(1.0, weight * factor[place])
            off = max(off, float(np.abs(moved - weight).max(initial=0.0)))
            weight = moved
        if off < close:
            break
    else:
        _log.warning("raking: weights still moved by %.2g after %d rounds", off, rounds)
    for m, (place, wanted) in enumerate(sides):
        short = np.abs(np.bincount(place, weights=weight * tokens, minlength=len(wanted)) - wanted).max(initial=0.0) / max(total, 1e-12)
        if short > 1e-3:
            _log.warning("raking: margin %d misses its target by up to %.2g of all kept tokens, as weights end at 1", m, short)
    return weight


def rake_table(cells: DataFrame, margins: list[str], targets: list[DataFrame], total: float, whole: float, rounds: int = 500, close: float = 1e-6) -> DataFrame:
    """`rake` of a Spark table of cells (margins, t): the cells with their ``probability``.

    ``targets`` has a table (margin, wanted) for each margin, of shares; absent categories get nothing. Each round is a written table.
    """
    now = staged(cells.withColumns({"probability": F.lit(min(1.0, total / max(whole, 1))), "old": F.lit(0.0)}), "raked")
    for _ in range(rounds):
        step, off = now, 0.0
        for m, target in zip(margins, targets):
            have = step.groupBy(m).agg(F.sum(F.col("probability") * F.col("t")).alias("have"))
            wanted = F.coalesce("wanted", F.lit(0.0)) * F.lit(float(total))
            factor = have.join(target, m, "left").select(m, F.when(F.col("have") > 0, wanted / F.col("have")).otherwise(1.0).alias("factor"))
            before = step.withColumn("old", F.col("probability")).join(factor, m).withColumn("probability", F.least(F.lit(1.0), F.col("probability") * F.col("factor")))
            after = staged(before.drop("factor"), "raked")
            unstage(step)
            step = after
            off = max(off, step.agg(F.max(F.abs(F.col("probability") - F.col("old")))).first()[0] or 0.0)
        now = step
        if off < close:
            break
    else:
        _log.warning("raking: weights still moved by %.2g after %d rounds", off, rounds)
    return now.drop("old")


def sampling_plan(docs: DataFrame, *, keep: float = 0.7, power: float = 0.7, targets: Mapping[str, Mapping[str, float]] | None = None, topics: int = 8, seed: int = 42, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """One row per document: id, source, lang, topic, tokens, probability, kept.

    ``targets`` maps source, lang or topic to target shares of tokens (unnamed categories get nothing); a margin
    that is not given gets its natural shares tempered by ``power``. The expected kept tokens are ``keep`` of
    all, less what the bound of 1 makes impossible. A null source or language is the category "(none)", a
    null text has no tokens and the topic of an empty one. Documents without tokens count as one token, so
    they are sampled like others. A row is drawn by a hash of its id, one whose id is repeated or
    missing by its row number, so such rows are sampled like others too. An empty table gives an empty table.
    """
    rows = staged(measured(docs, id_col, text, source, lang), "measured")
    model = learn_topics(rows, topics)
    topical = staged(rows.select("row", "id", "source", "lang", "tokens", model.of(F.col("vector")).cast("string").alias("topic")), "topical")
    weight = F.greatest("tokens", F.lit(1))
    margins = ("source", "lang", "topic")
    coded, keys = topical.withColumn("size", weight), [f"c_{m}" for m in margins]
    for m in margins:
        coded = coded.withColumn(f"c_{m}", F.col(m))
    found = staged(coded.groupBy(*keys).agg(F.sum("size").alias("t")), "cells")
    row = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    if row["n"] <= DRIVER_CELLS:
        few = sorted(found.collect(), key=lambda r: tuple(r[:3]))
        cells, tokens = [tuple(r[:3]) for r in few], np.array([r["t"] for r in few], float)
        wanted = []
        for i, m in enumerate(margins):
            have: dict[str, float] = {}
            for c, t in zip(cells, tokens.tolist()):
                have[c[i]] = have.get(c[i], 0.0) + t
            wanted.append((targets or {}).get(m) or tempered(have, power))
        weights = rake(cells, tokens, wanted, keep * tokens.sum())
        table = pd.DataFrame([(*c, float(w)) for c, w in zip(cells, weights)], columns=[*keys, "probability"])
        plan = F.broadcast(docs.sparkSession.createDataFrame(table, ", ".join([*[f"{k} string" for k in keys], "probability double"])))
    else:
        wanted = []
        for m, k in zip(margins, keys):
            given = (targets or {}).get(m)
            if given:
                wanted.append(docs.sparkSession.createDataFrame([(n, float(v)) for n, v in given.items()], f"{k} string, wanted double"))
            else:
                raised = staged(found.groupBy(k).agg(F.pow(F.sum("t").cast("double"), F.lit(power)).alias("wanted")), "targets")
                wanted.append(raised.withColumn("wanted", F.col("wanted") / F.lit(raised.agg(F.sum("wanted")).first()[0])))
        plan = send_if_small(rake_table(found, keys, wanted, keep * row["t"], float(row["t"])).drop("t"))
    again = staged(topical.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit(True).alias("again")), "repeated")
    alone = F.when(F.col("id").isNull() | F.col("again").isNotNull(), F.xxhash64(F.lit(seed), F.lit(1), "row")).otherwise(F.xxhash64(F.lit(seed), "id"))
    drawn = F.shiftrightunsigned(alone, 11) / F.lit(float(1 << 53))
    joined = coded.join(plan, keys).join(send_if_small(again), "id", "left")
    return joined.select(*(["row"] if ROW in docs.columns else []), F.col("id").alias(id_col), "source", "lang", F.col("topic").cast("int").alias("topic"), "tokens", "probability", (drawn < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows kept by the plan, with their own columns; each row is decided for itself, whatever its id."""
    numbered = staged(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    kept = sampling_plan(numbered, id_col=id_col, **options).filter("kept").select(F.col("row").alias(ROW))
    return numbered.join(kept, ROW, "left_semi").select(*docs.columns)


__all__ = ["learn_topics", "measured", "rake", "sample", "sampling_plan", "tempered"]
