import numpy as np
import pytest

from trailmark.llm import innerproduct, multiindex, vectors
from trailmark.llm.common import table

SF = "/root/testdata/sf0.1"


def plain_products(ids, rows, every, k):
    out = set()
    for i in np.flatnonzero(ids % every == 0):
        s = rows @ rows[i]
        out |= {(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate([j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k])}
    return out


def given(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


@pytest.mark.parametrize("block", [16_384, 300])
def test_inner_products_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(innerproduct, "BLOCK", block)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    ids, rows = given(spark)
    found = innerproduct.search(table(spark, SF, "embeddings"))
    assert {tuple(r) for r in found.collect()} == plain_products(ids, np.floor(1024 * rows).astype(np.int64), 100, 10)


def test_inner_products_of_uneven_lengths(spark, monkeypatch):
    monkeypatch.setattr(innerproduct, "BLOCK", 100)
    rnd = np.random.default_rng(2)
    rows = rnd.normal(size=(900, 6)) * rnd.lognormal(0, 2, size=(900, 1))
    rows[100:140] = rows[7]  # ties
    rows[3] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    found = {tuple(r) for r in innerproduct.search(df, every=50, k=10, scale=16).collect()}
    assert found == plain_products(np.arange(900), np.floor(16 * rows).astype(np.int64), 50, 10)


def test_bounds_drop_rows():
    rnd = np.random.default_rng(0)
    rows = rnd.normal(size=(500, 8)) * np.array([9, 5, 1, 1, 0.1, 0.1, 0.1, 0.1])
    query = rows[0]
    scores = rows @ query
    bar = np.sort(scores)[-10]
    near = innerproduct.candidates(query, rows, bar, [2, 4, 6])
    assert set(np.flatnonzero(scores >= bar)) <= set(near) and len(near) < 60


@pytest.mark.parametrize("block", [16_384, 400])
def test_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(multiindex, "BLOCK", block)
    ids, rows = given(spark)
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    found = multiindex.search(table(spark, SF, "embeddings")).collect()
    place = {int(k): i for i, k in enumerate(ids)}
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[i]
        s[i] = -2
        own = sorted((r for r in found if r.query_id == ids[i]), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - s[place[r.vec_id]]) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & set(ids[np.argsort(-s)[:5]].tolist()))
        total += 5
    assert hits / total >= 0.9


def test_probing_retrieves_the_whole_ball():
    rnd = np.random.default_rng(1)
    codes = rnd.integers(0, 256, size=(3000, 4), dtype=np.uint8)
    index = multiindex.Index(codes)
    for radius in (0, 3, 7, 12, 32):
        for code in codes[:20]:
            assert index.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code).sum(axis=1) <= radius).tolist()
    assert all(sum(b + 1 for b in multiindex.budgets(r, 8)) == r + 1 for r in range(65))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7 - 3), 1.0, float(i % 5)], "x") for i in range(120)]
    bad = [(200, None, "x"), (250, [], None), (300, [1.0, nan, 1.0], None), (350, [1.0, None, 1.0], None), (400, [inf, 1.0, 1.0], None), (450, [1.0, 2.0], "y"), (None, [1.0, 1.0, 1.0], None), (500, [0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(good + bad + [good[50]], "vec_id long, embedding array<double>, score string")
    rows = np.array([v for _, v, _ in good])
    found = multiindex.search(df, every=50).collect()
    assert {r.query_id for r in found} == {0, 50, 100} and len(found) == 15
    unit = rows / np.linalg.norm(rows, axis=1)[:, None]
    for q in (0, 100):
        s = unit @ unit[q]
        s[q] = -2
        assert np.allclose(sorted(r.score for r in found if r.query_id == q)[-1], s.max())
    products = innerproduct.search(df, every=50, k=3, scale=1).collect()
    assert {r.query_id for r in products} == {0, 50, 100, 500} and len(products) == 12
    assert all(r.score == 0 for r in products if r.query_id == 500)
    for search in (multiindex.search, innerproduct.search):
        assert search(df.limit(0)).count() == 0
        few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>")
        assert [(r.query_id, r.vec_id) for r in search(few, every=100).orderBy("rank").collect()] == [(0, 1), (0, 50)]


def test_large_and_small_components(spark):
    """Cosines of vectors whose squares leave the range of doubles; inner products beyond the 62nd bit; none is dropped."""
    base = [[1.0, 2.0], [2.0, 1.0], [1.0, 2.1], [-1.0, 0.5], [3.0, 3.0], [0.1, 2.0]]
    want = [(r.vec_id, r.score) for r in multiindex.search(spark.createDataFrame(list(enumerate(base)), "vec_id long, embedding array<double>"), every=50).orderBy("rank").collect()]
    for by in (1e200, 1e-200, 1e307):
        rows = [(i, [x * by for x in v]) for i, v in enumerate(base)]
        got = [(r.vec_id, r.score) for r in multiindex.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).orderBy("rank").collect()]
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    for big in (2.0e6, float(2**19)):
        rows = [(i, [big, float(i)] + [big if i % 2 else -big] * (62 if big < 1e6 else 0)) for i in range(8)]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        whole = [[int(x * 1024) for x in v] for _, v in rows]
        products = sorted(((-sum(a * b for a, b in zip(whole[0], v)), i) for i, v in enumerate(whole) if i), key=lambda p: p)
        if -products[0][0] < 1 << 63:
            assert [(r.vec_id, r.score) for r in innerproduct.search(table, every=100).orderBy("rank").collect()] == [(i, -p) for p, i in products]
        else:
            with pytest.raises(Exception, match="64 bits"):
                innerproduct.search(table, every=100).collect()
