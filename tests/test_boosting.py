from __future__ import annotations

import numpy as np
import pytest

from foldspark.operators import boosting, learning


def rows(n, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.integers(0, 4, n)]).astype(np.float32)
    return x, (rng.random(n) < 0.15 + 0.08 * x[:, 0]).astype(np.int64)


def test_a_round_costs_as_many_rows_as_trees_can_tell_apart(monkeypatch):
    seen, grown = [], boosting.grown
    monkeypatch.setattr(boosting, "grown", lambda bins, edges, g, h, own, *more: seen.append(len(own)) or grown(bins, edges, g, h, own, *more))
    boosting.fit(*rows(20_000), *rows(5_000, 3), rounds=5)
    assert max(seen) <= 9 * 4 * 2


def test_rows_that_count_several_times_are_those_rows():
    (x, t), (xh, th) = rows(3_000), rows(700, 3)
    model = boosting.fit(x, t, xh, th, rounds=20, subsample=1.0, columns=1.0, rate=0.3, min_child=1.0)
    # the first tree by hand: every row on its own, all of them
    edges = [boosting.edges_of(x[:, f]) for f in (0, 1)]
    bins = np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)])
    tree = boosting.grown(bins, edges, 0.5 - t, np.full(len(t), 0.25), np.arange(len(t)), np.arange(2), 5, 0.3, 1.0, 0.2, 0.0, 1.0)
    assert model.trees[0].value == pytest.approx(tree.value) and (model.trees[0].feature == tree.feature).all()
    _, held, truth, times = boosting.distinct(xh, th, edges)
    score, every = model.probability(held), model.probability(xh)
    assert times.sum() == len(xh) and len(held) <= 72
    assert boosting.average_precision(truth, score, times) == pytest.approx(boosting.average_precision(th, every))
    assert boosting.auroc(truth, score, times) == pytest.approx(boosting.auroc(th, every))


def test_draws_are_without_replacement():
    times, rng = np.array([1, 500, 3, 0, 40]), np.random.default_rng(0)
    for _ in range(50):
        got = boosting.drawn(rng, times, 300)
        assert got.sum() == 300 and (got <= times).all()
    assert (boosting.drawn(rng, times, 544) == times).all()


def test_bins_and_counts_of_spark_are_those_of_all_rows(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=5_003), rng.integers(0, 7, 5_003), np.zeros(5_003), rng.integers(-50, 50, 5_003) / 8]).astype(np.float32)
    t = (rng.random(len(x)) < 0.3).astype(np.int64)
    names = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(*map(float, r), int(y)) for r, y in zip(x, t, strict=True)], ", ".join(f"{n} double" for n in names) + ", t int").repartition(5)
    got, truth, times, edges = learning.gathered(rows, names, "t")
    wanted = [boosting.edges_of(x[:, f]) for f in range(4)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(edges, wanted, strict=True))
    bins, _, own, counts = boosting.distinct(x, t, wanted)
    again = boosting.distinct(got, truth, edges, times)
    assert sorted(map(tuple, np.column_stack([bins, own, counts]).tolist())) == sorted(map(tuple, np.column_stack([again[0], again[2], again[3]]).tolist()))


def test_trees_are_fitted_on_more_rows_than_a_million(spark):
    n = 2_000_000
    rows = spark.range(n).selectExpr("CAST(id % 4 AS DOUBLE) AS x", "CAST(id % 4 = 0 AS INT) AS t")
    model, _ = learning.fit_trees(rows, rows.limit(0), ["x"], "t", weight=1.0, rounds=1, depth=1, rate=1.0, subsample=1.0, columns=1.0, lam=1e6)
    # all rows in a leaf: gradients -1/2 where true, 1/2 else, curvature 1/4
    assert model.trees[0].value[1:] == pytest.approx([n / 8 / (n / 16 + 1e6), -3 * n / 8 / (3 * n / 16 + 1e6)])
    found = learning.search(rows, rows, ["x"], "t", trials=1, at_once=1, rounds=2).first()
    assert found["auroc"] == 1.0
    assert (learning.gathered(rows, ["x"], "t")[2] == n // 4).all()
