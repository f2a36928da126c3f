import numpy as np
from pyspark.sql import functions as F

from trailmark.llm import mixing


def test_raking_meets_attainable_margins():
    cells = [(s, g) for s in "abc" for g in "xy"]
    tokens = np.array([50, 10, 30, 30, 20, 60], float)
    targets = [{"a": 0.4, "b": 0.3, "c": 0.3}, {"x": 0.5, "y": 0.5}]
    w = mixing.rake(cells, tokens, targets, 80)
    assert (w >= 0).all() and (w <= 1).all()
    for m, target in enumerate(targets):
        for name, share in target.items():
            assert abs(sum(w[i] * tokens[i] for i, c in enumerate(cells) if c[m] == name) - 80 * share) < 0.01


def test_unattainable_and_absent_categories():
    w = mixing.rake([("a",), ("b",)], np.array([10.0, 90.0]), [{"a": 0.5, "b": 0.5}], 60)
    assert np.allclose(w, [1, 1 / 3])
    assert np.allclose(mixing.rake([("a",), ("b",)], np.array([10.0, 90.0]), [{"b": 1.0}], 45), [0, 0.5])
    assert len(mixing.rake([], np.array([]), [{}], 0)) == 0


def corpus(spark):
    rows = []
    for i in range(1500):
        lang = "en" if i % 3 else "fr"
        words = ("the cat sat on a mat " if i % 2 else "stock price of the bank ") if lang == "en" else "le chat est sur la table "
        rows.append((i, words * (1 + i % 5), lang, f"s{0 if i % 2 else i % 7}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_sample_has_the_targets(spark):
    targets = {"lang": {"en": 0.5, "fr": 0.5}}
    plan = mixing.sampling_plan(corpus(spark), keep=0.5, targets=targets, topics=1).cache()
    assert plan.count() == 1500
    kept = plan.filter("kept").groupBy("lang").agg(F.sum("tokens")).collect()
    total = sum(r[1] for r in kept)
    assert abs(total / plan.agg(F.sum("tokens")).first()[0] - 0.5) < 0.08
    assert all(abs(r[1] / total - 0.5) < 0.08 for r in kept)
    expected = plan.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("e")).collect()
    assert abs(expected[0].e / expected[1].e - 1) < 0.02
    again = mixing.sampling_plan(corpus(spark).repartition(7), keep=0.5, targets=targets, topics=1)
    assert plan.exceptAll(again).count() == 0


def test_topics_part_the_vocabularies(spark):
    plan = mixing.sampling_plan(corpus(spark), topics=3)
    pairs = plan.select("topic", (F.col("doc_id") % 3 == 0).alias("fr"), (F.col("doc_id") % 2).alias("two")).distinct().collect()
    by_topic = {}
    for r in pairs:
        by_topic.setdefault(r.topic, set()).add((r.fr, None if r.fr else r.two))
    assert all(len(v) == 1 for v in by_topic.values()) and len(by_topic) == 3


def test_many_cells_give_the_same_plan(spark, monkeypatch):
    """Raked as a Spark table, through the whole plan."""
    plain = mixing.sampling_plan(corpus(spark), keep=0.5, topics=2)
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    table = mixing.sampling_plan(corpus(spark), keep=0.5, topics=2)
    one, two = ({r.doc_id: r.probability for r in p.collect()} for p in (plain, table))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)


def test_rows_are_drawn_one_by_one(spark):
    """Null and repeated ids meet the target like others, in the plan and in the sample."""
    rows = [(None if i % 3 else 7, "alpha beta gamma", "en", "s", i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int")
    kept = mixing.sample(docs, keep=0.2, topics=1)
    planned = mixing.sampling_plan(docs, keep=0.2, topics=1).filter("kept").count()
    assert kept.columns == docs.columns and 130 < kept.count() < 230 and 130 < planned < 230
    assert 80 < kept.filter("doc_id is null").count() < 160 and kept.select("n").distinct().count() == kept.count()


def test_awkward_documents(awkward, empty):
    plan = mixing.sampling_plan(awkward, topics=2)
    assert plan.count() == awkward.count()
    assert plan.filter("probability is null or probability < 0 or probability > 1 or kept is null").count() == 0
    assert plan.filter("source = '(none)'").count() == 3
    out = mixing.sample(awkward, topics=2)
    assert out.columns == awkward.columns and 0 < out.count() <= awkward.count()
    assert mixing.sampling_plan(empty).count() == 0 == mixing.sample(empty).count()
