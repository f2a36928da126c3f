"""Codes, errors and codebooks against plain brute force, whatever the bounds skipped."""

import math

import numpy as np
import pytest

from trailmark.llm import codebooks

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, x int"


def brute(rows, parts, entries, rounds, scale=256):
    """rows (vec_id, vector) that take part -> codes and errors in order of the rows, and the books."""
    size = len(rows[0][1])
    width = -(-size // parts)
    cut = lambda v: [(v + [0] * (parts * width - size))[p * width : (p + 1) * width] for p in range(parts)]
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    seeds = sorted(whole, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[cut(v)[p] for _, v in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, piece: min((far(piece, e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[near(p, cut(v)[p])[1] for p in range(parts)] for _, v in whole]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut(v)[p] for (_, v), c in zip(whole, chosen) if c[p] == j]
                if mine:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    best = [[near(p, cut(v)[p]) for p in range(parts)] for _, v in whole]
    return [bytes(j for _, j in b) for b in best], [sum(d for d, _ in b) for b in best], books


def check(spark, rows, **how):
    how = {"parts": 4, "entries": 6, "rounds": 2, "near": 3} | how
    table = spark.createDataFrame([(i, v, k % 2, "c", "e", 1) for k, (i, v) in enumerate(rows)], SCHEMA).repartition(3)
    coded, books = codebooks.compress(table, **how)
    codes, errors, expected = brute(rows, how["parts"], how["entries"], how["rounds"])
    found = sorted((str(r.vec_id), bytes(r.code), r.error) for r in coded.collect())
    assert found == sorted((str(i), c, e) for (i, _), c, e in zip(rows, codes, errors))
    assert books.entries.tolist() == expected
    return coded


@pytest.mark.parametrize("near,rounds", [(1, 2), (3, 0), (6, 4), (40, 1)])
def test_bounds_change_nothing(spark, near, rounds):
    made = np.random.default_rng(near * 10 + rounds)
    groups = made.normal(size=(9, 8))
    rows = [(i, (groups[i % 9] + made.normal(scale=0.2, size=8)).tolist()) for i in range(150)]
    check(spark, rows, near=near, rounds=rounds, entries=20)


def test_ties_and_repeats(spark):
    made = np.random.default_rng(1)
    grid = [(int(i), (made.integers(-1, 2, 8) / 256).tolist()) for i in made.integers(0, 40, 120)]
    check(spark, grid + grid[:50], rounds=3)


def test_long_chunks_and_steady_lists(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "CHUNK", 7)
    made = np.random.default_rng(2)
    check(spark, [(i, made.normal(size=10).tolist()) for i in range(100)], parts=4, entries=12, near=5, rounds=4)


def test_few_rows_null_ids_and_large_components(spark):
    check(spark, [(3, [1.0, 2.0, 3.0, 4.0]), (None, [0.0] * 4), (3, [9.0, 0.5, 0.25, -3.0])])
    check(spark, [(i, [float(i % 5) * 2.0**40, -(2.0**30), 1.5, 0.0]) for i in range(10)], entries=5)
    with pytest.raises(ValueError):
        codebooks.compress(spark.createDataFrame([(1, [2.0**60], 0)], "vec_id long, embedding array<double>, label int"))


def test_rows_that_take_no_part(spark):
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    table = spark.createDataFrame([(i, v, 0, None, None, None) for i, v in enumerate(bad)] + [(9, [1.0, 2.0], None, None, None, None), (10, [0.0, 2.0], None, None, None, None)], SCHEMA)
    coded, books = codebooks.compress(table, parts=2)
    labelled = codebooks.with_label_error(coded).collect()
    assert sorted(r.vec_id for r in labelled) == [9, 10] and {r.label_error for r in labelled} == {0}
    assert books.entries.shape == (2, 2, 1)
    coded, books = codebooks.compress(table.limit(0))
    assert books is None and codebooks.with_label_error(coded).count() == 0


def test_label_errors(spark):
    made = np.random.default_rng(4)
    rows = [(i, made.normal(size=4).tolist(), [None, 1, 2][i % 3]) for i in range(30)]
    found = codebooks.with_label_error(codebooks.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=3)[0]).collect()
    for r in found:
        assert r.label_error == sum(o.error for o in found if o.label == r.label)


def test_lists_shrink_and_skip(spark):
    """Where groups are far apart lists become short and hardly any row measures all entries."""
    made = np.random.default_rng(5)
    x = (made.integers(0, 6, 400)[:, None] * 10_000 + made.integers(-50, 50, (400, 2))).astype(np.int64)[:, None, :]
    books = codebooks.Books(np.array([[[k * 10_000, k * 10_000] for k in range(6)]], np.int64))
    ids, own, low, outer = codebooks.first_lists(books, x[:, 0], 0, 3)
    moved = codebooks.Books(books.entries + 3, books.entries)
    *_, reached, all_ = codebooks.next_lists(moved, x[:, 0], 0, ids, codebooks._half(low).astype(float), codebooks._half(outer).astype(float))
    assert reached == 0 and all_ == 0
