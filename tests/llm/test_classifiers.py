import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import quality, toxicity
from trailmark.llm.common import held_out, table
from trailmark.llm.queries import op1_discriminant, op5_nearest_labelled

SF = "/root/testdata/sf0.1"


def test_index_is_exact():
    rnd = np.random.default_rng(4)
    vectors = []
    for _ in range(700):
        terms = np.unique(rnd.zipf(1.4, rnd.integers(0, 7)) % 80).astype(np.int64)
        weights = np.round(rnd.random(len(terms)), 1) + 0.1
        vectors.append((terms, weights / np.sqrt((weights**2).sum()) if len(terms) else weights))
    whole = np.zeros((700, 80))
    for i, (t, w) in enumerate(vectors):
        whole[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, 80)
    for i in range(0, 700, 3):
        sims = np.round(whole @ whole[i], 12)
        assert [j for _, j in index.nearest(*vectors[i], 15)] == [j for _, j in sorted((-s, j) for j, s in enumerate(sims) if s > 0)[:15]]
    assert toxicity.BlockMaxIndex([], 3).nearest(np.array([1]), np.array([1.0]), 5) == []


def test_vocabulary_counts_are_those_of_the_terms():
    terms = ["insult", "insul*", "insulti*", "ab", "fünf"]
    vocabulary = toxicity.Vocabulary(terms)
    for text in (None, "", "Insult insulting INSULTS ab insul", "fünf fünfzig _ab_ ab-ab", "x" * 10_000):
        counts = toxicity.terms_of(text)
        assert {terms[i]: n for i, n in vocabulary.counts(text).items()} == {t: counts[t] for t in terms if counts[t]}


def test_calibration_is_monotone():
    rnd = np.random.default_rng(1)
    x = np.round(rnd.random(300), 2)
    ends, p = toxicity.monotone(x, (rnd.random(300) < x).astype(float))
    assert (np.diff(ends) > 0).all() and (np.diff(p) >= 0).all() and 0 < p[0] < 0.3 < 0.7 < p[-1] < 1


def test_held_out_rule(spark):
    got = spark.range(100).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


@pytest.mark.parametrize("query,label,least", [(op1_discriminant, "quality", 0.97), (op5_nearest_labelled, "toxic", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    truth = {r.doc_id: r[label] for r in table(spark, SF, "labels").collect()}
    rows = [r for r in query(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 500
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) >= least
    yes, no = ([r.score for r in rows if truth[r.doc_id] == y] for y in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no]) >= least - 0.03
    assert all(0 <= r.score <= 1 for r in rows)


def test_other_columns_are_no_inputs(spark):
    """Scores stay the same whatever ids, sources, languages and held-out labels say."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(["good", "fine", "calm", "idiot", "moron"] if i % 4 == 0 else ["good", "fine", "calm", "river"], k=12)) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 3 % 2, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    plain = [r.t.score for r in toxicity.scored(docs, toxicity.fit(docs, labels), name="t").orderBy("doc_id").collect()]
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert plain == [r.t.score for r in toxicity.scored(other, toxicity.fit(other, flipped), name="t").orderBy("doc_id").collect()]
    truth = [i % 4 == 0 for i in range(240)]
    assert sum((s >= 0.3) == t for s, t in zip(plain, truth)) >= 235


def test_awkward_documents(awkward, empty, no_labels, spark):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (5, 0, 1), (6, 0, 1), (7, None, None), (None, 1, 1), (77, 1, 1), (77, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, no_labels):
        tox, qual = toxicity.fit(awkward, known), quality.fit(awkward, known)
        out = quality.scored(toxicity.scored(awkward, tox), qual).collect()
        assert len(out) == awkward.count()
        assert all(0 <= r.toxicity.score <= 1 and 0 <= r.quality_score <= 1 for r in out)
        nothing = {(r.toxicity.score, r.quality_score) for r in out if not r.text}
        assert len(nothing) == 1
    tox, qual = toxicity.fit(empty, labels), quality.fit(empty, labels)
    assert toxicity.scored(empty, tox).count() == 0 == quality.scored(empty, qual).count()


def test_statistics_are_finite():
    for text in (None, "", " ", "a", "\n\n", "!!!", "é" * 50_000, "a b " * 50_000):
        values = quality.statistics(text)
        assert len(values) == len(quality.FEATURES) and np.isfinite(values).all()


def test_factors_give_the_mahalanobis_difference():
    rnd = np.random.default_rng(0)
    d = 3
    model = quality.QualityModel(np.zeros(d), np.ones(d), [np.zeros(d), np.ones(d)], [], [], 1.0, 0.0)
    for c in (0, 1):
        a = rnd.normal(size=(d, d))
        cov = a @ a.T + np.eye(d)
        model.factors.append(np.linalg.inv(np.linalg.cholesky(cov)))
        model.offsets.append(-0.5 * np.log(np.linalg.det(cov)))
    x = rnd.normal(size=(5, d))
    dens = []
    for m, f, o in zip(model.means, model.factors, model.offsets):
        inverse = f.T @ f
        dens.append([o - 0.5 * (v - m) @ inverse @ (v - m) for v in x])
    assert np.allclose(model.difference(x), np.subtract(dens[1], dens[0]))
