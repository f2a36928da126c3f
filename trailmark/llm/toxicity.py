"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Vocabulary, inverse document frequencies and examples make an inverted index whose postings lie in
blocks of examples; every block knows its largest weight for each term. A text looks the blocks up in
descending order of the bound these maxima give its cosine and stops when no block left can reach the
k-th best, so the neighbours are exactly those of a full comparison. Their votes, weighted by nearness,
become a probability through a monotone calibration fitted on the examples' own left-out votes.

Learned from labels: the examples, at most ``max_examples`` labelled documents taken in order of a hash of
their id, and the vocabulary, at most ``max_terms`` words whose presence goes with the label among them.
Document frequencies are counted over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import held_out, staged

_WORD = re.compile(r"[^\W_]+")


#: Lengths of the word beginnings that are terms besides whole words.
STEMS = (5, 7)
#: Weight of a term that every text has, in units of a usual term: it makes the cosine tell one passing word from many.
ANCHOR = 3.0


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits of the whole text."""
    return _WORD.findall((text or "").lower())


def terms_of(text: str | None) -> Counter[str]:
    """Terms of the whole text with their counts: words, and beginnings of longer words marked by a star."""
    own = Counter(words(text))
    out = Counter(own)
    for word, n in own.items():
        for size in STEMS:
            if len(word) > size:
                out[word[:size] + "*"] += n
    return out


class Vocabulary:
    """Term numbers, looked up without naming the terms that are not in it."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.words = {t: i for i, t in enumerate(terms) if not t.endswith("*")}
        self.stems = [(size, {t[:-1]: i for i, t in enumerate(terms) if t.endswith("*") and len(t) == size + 1}) for size in STEMS]

    def counts(self, text: str | None) -> Counter[int]:
        """Counts of the terms of `terms_of` that are known."""
        own = Counter(words(text))
        out = Counter({self.words[w]: own[w] for w in own.keys() & self.words.keys()})
        for size, known in self.stems:
            if known:
                for word, n in own.items():
                    if (place := known.get(word[:size])) is not None and len(word) > size:
                        out[place] += n
        return out


class BlockMaxIndex:
    """Exact k nearest examples by inner product over sparse non-negative unit vectors.

    Examples with the same vector are one row. Rows that share their strongest terms lie in the same blocks of
    the postings; a block's part of a term's postings is stored in full width (terms and examples are bounded).
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = 32) -> None:
        """``vectors``: (term numbers ascending, weights), one for each example."""
        same: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (own, weights) in enumerate(vectors):
            if len(own):
                same.setdefault((own.tobytes(), weights.tobytes()), []).append(i)
        members = sorted(same.values(), key=lambda m: ([int(t) for t in vectors[m[0]][0][np.argsort(-vectors[m[0]][1], kind="stable")]], m))
        self.members = members
        blocks = -(-len(members) // block)
        self.postings = np.zeros((terms, blocks, block))
        for row, m in enumerate(members):
            own, weights = vectors[m[0]]
            self.postings[own, row // block, row % block] = weights
        self.largest = self.postings.max(axis=2) if blocks else np.zeros((terms, 0))
        self.block = block

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best (product, example), best first, ties to the smaller example; examples with product 0 are no neighbours."""
        if not len(terms) or not self.members:
            return []
        bound = weights @ self.largest[terms]
        order = np.argsort(-bound, kind="stable")
        at = 3 + k // self.block
        sums = self._products(terms, weights, order[:at])
        best = np.sort(sums)[-k] if len(sums) >= k else 0.0  # the k-th best so far bounds the k-th best of all from below
        rest = order[at:][bound[order[at:]] >= best - 1e-9]
        rest = rest[bound[rest] > 0]
        sums = np.concatenate([sums, self._products(terms, weights, rest)])
        rows = (np.concatenate([order[:at], rest])[:, None] * self.block + np.arange(self.block)).ravel()
        near = np.flatnonzero((sums > 0) & (sums >= best - 1e-9))
        found = [(-round(float(sums[j]), 12), i) for j in near.tolist() for i in self.members[rows[j]][:k]]
        return [(-s, i) for s, i in sorted(found)[:k]]

    def _products(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        return np.tensordot(weights, self.postings[terms[:, None], blocks[None, :]], axes=1).ravel()


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic calibration by pooling: upper ends of the pools and their probabilities, drawn half a case to the mean."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, largest x
    for v, t in zip(x[order], y[order]):
        if pools and pools[-1][2] == v:
            pools[-1] = [pools[-1][0] + t, pools[-1][1] + 1, v]
        else:
            pools.append([t, 1, v])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, top = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, top]
    mean = float(y.mean()) if len(y) else 0.5
    return np.array([p[2] for p in pools]), np.maximum.accumulate(np.array([(p[0] + mean) / (p[1] + 1) for p in pools])) if pools else np.empty(0)


@dataclass
class ToxicityModel:
    """A fitted model; small by construction (see the bounds in the module) and sent to every worker."""

    vocabulary: Vocabulary
    idf: np.ndarray
    ids: list[int]
    labels: np.ndarray
    rows: list[tuple[np.ndarray, np.ndarray]]
    neighbours: int
    ends: np.ndarray
    probabilities: np.ndarray
    without: float
    anchor: float

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit TF-IDF weights of a whole text; empty if it has no term of the vocabulary."""
        return self.weighted(self.vocabulary.counts(text))

    def weighted(self, counts: Counter[int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        weights = np.array([1 + math.log(counts[t]) for t in terms.tolist()]) * self.idf[terms] if len(terms) else np.empty(0)
        terms, weights = np.append(terms, len(self.idf)), np.append(weights, self.anchor)
        return terms, weights / np.sqrt((weights**2).sum())

    def index(self) -> BlockMaxIndex:
        return BlockMaxIndex(self.rows, len(self.idf) + 1)

    def vote(self, found: list[tuple[float, int]]) -> float | None:
        total = sum(s for s, _ in found)
        return sum(s * self.labels[i] for s, i in found) / total if total else None

    def probability(self, vote: float | None) -> float:
        if vote is None or not len(self.ends):
            return self.without
        return float(self.probabilities[min(int(np.searchsorted(self.ends, vote)), len(self.ends) - 1)])

    def calibrate(self) -> None:
        index, votes, none = self.index(), [], []
        for i, (terms, weights) in enumerate(self.rows):
            found = [x for x in index.nearest(terms, weights, self.neighbours + 1) if x[1] != i][: self.neighbours]
            vote = self.vote(found)
            (none if vote is None else votes).append((vote, self.labels[i]))
        mean = float(self.labels.mean()) if len(self.labels) else 0.0
        self.ends, self.probabilities = monotone(np.array([v for v, _ in votes], float), np.array([y for _, y in votes], float))
        self.without = (sum(y for _, y in none) + mean) / (len(none) + 1)

    def score(self, text: Column) -> Column:
        """A struct for each text: score, the neighbours' ids and nearness (best first), and the text's own terms by weight."""
        model = self

        @F.pandas_udf("score double, neighbours array<bigint>, nearness array<double>, terms array<string>")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            index, names, seen = model.index(), model.vocabulary.terms, {}
            for texts in batches:
                out = []
                for text in texts:
                    terms, weights = model.vector(text)
                    key = (terms.tobytes(), weights.tobytes())
                    if key not in seen:
                        if len(seen) > 50_000:
                            seen.clear()
                        found = index.nearest(terms, weights, model.neighbours)
                        strongest = np.argsort(-weights, kind="stable")
                        seen[key] = (model.probability(model.vote(found)), [model.ids[i] for _, i in found], [s for s, _ in found], [names[t] for t in terms[strongest].tolist() if t < len(names)])
                    out.append(seen[key])
                yield pd.DataFrame(out, columns=["score", "neighbours", "nearness", "terms"])

        return of(text)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, labels = [], []
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
            own = terms_of(text).keys()
            terms += own
            labels += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.int32())], ["term", "label"])


def examples(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``most`` labelled documents that may be learned from: id, text, label. Of an id's repeated rows one counts."""
    ids = (
        labels.filter(~held_out(F.col(id_col)) & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "id")
    return staged(texts.groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "examples")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, max_examples: int = 4000, max_terms: int = 1000, neighbours: int = 15, significance: float = 25.0, id_col: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on the labelled documents outside the held-out part.

    A word enters the vocabulary if at least 3 examples hold it and the likelihood ratio of its
    presence against the label is at least ``significance``. With no labels every text scores the mean 0.
    """
    known = examples(docs, labels, label, max_examples, id_col, text)
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    spread = F.col("n") * (total["p"] / max(total["n"], 1))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    held = known.select("text", "label").mapInArrow(_term_rows, "term string, label int").groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    ratio = 2 * (part(F.col("p"), spread) + part(F.col("n") - F.col("p"), F.col("n") - spread) + part(total["p"] - F.col("p"), total["p"] - spread) + part(F.lit(total["n"] - total["p"]) - F.col("n") + F.col("p"), F.lit(total["n"] - total["p"]) - F.col("n") + spread))
    chosen = held.filter("n >= 3").withColumn("g", ratio).filter(F.col("g") >= significance).orderBy(F.desc("g"), "term").limit(max_terms).collect()
    vocabulary = Vocabulary([r["term"] for r in chosen])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(chosen), np.int64), 0
        for batch in batches:
            for x in batch["text"].to_pylist():
                for t in vocabulary.counts(x):
                    seen[t] += 1
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(seen)), -1], pa.int32()), pa.array([*seen.tolist(), rows], pa.int64())], ["term", "n"])

    found = dict(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n")).collect())
    idf = np.array([1 + math.log((1 + found.get(-1, 0)) / (1 + found.get(i, 0))) for i in range(len(chosen))])
    model = ToxicityModel(vocabulary, idf, [], np.empty(0), [], neighbours, np.empty(0), np.empty(0), 0.0, ANCHOR * float(np.median(idf)) if len(idf) else 1.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vocabulary.counts(x) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array([list(c) for c in made], pa.list_(pa.int32())), pa.array([list(c.values()) for c in made], pa.list_(pa.int32()))], ["id", "label", "terms", "counts"])

    coded = sorted(known.select(F.col("id").cast("bigint").alias("id"), "label", "text").mapInArrow(vectors, "id bigint, label int, terms array<int>, counts array<int>").collect(), key=lambda r: r["id"])
    model.ids, model.labels = [r["id"] for r in coded], np.array([r["label"] for r in coded], float)
    model.rows = [model.weighted(Counter(dict(zip(r["terms"], r["counts"])))) for r in coded]
    model.calibrate()
    return model


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "toxicity") -> DataFrame:
    """The documents with a struct column: score (0 to 1), neighbours, nearness and terms.

    Every row is scored by its own whole text; null and empty texts, like any text without a known
    term, get the rate of the label among such examples and no neighbours. Rows are never joined, so
    null or repeated ids and clashing columns don't matter; an existing column ``name`` is replaced.
    """
    return docs.withColumn(name, model.score(F.col(text).cast("string")))
