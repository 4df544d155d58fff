"""Boosting in Spark against small numpy versions that see all rows at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.operators import boosting as B
from waveloom.operators import learn as L


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 600
    x = rng.normal(size=(n, 5))
    y = np.where(x[:, 1] > 0.5, 2, np.where(x[:, 3] * x[:, 0] > 0.1, 1, 0))
    y = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), y)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "key long, y int, x array<double>").repartition(5)
    return x, y, df


def test_boosted_as_numpy(spark, table):
    x, y, df = table
    weights, rounds, depth, rate, l2, bins = {0: 0.7, 1: 1.5, 2: 1.0}, 3, 2, 0.4, 1.0, 12
    model = B.boosted(df, "x", "y", weights, rounds, depth, rate, l2, 1.0, bins)
    b = np.array([[sum(v > e for e in row) for v, row in zip(one, model.limits)] for one in x])
    w = np.array([weights[c] for c in y])
    margins, gain = np.zeros((len(y), 3)), np.zeros(5)
    for _ in range(rounds):
        e = np.exp(margins)
        p = e / e.sum(axis=1, keepdims=True)
        for c in range(3):
            g, h = w * (p[:, c] - (y == c)), w * 2 * p[:, c] * (1 - p[:, c])

            def grow(rows, left):
                total = g[rows].sum() ** 2 / (h[rows].sum() + l2)
                best = (1e-12, None)
                for f in range(5):
                    for cut in range(bins - 1):
                        a, z = rows[b[rows, f] <= cut], rows[b[rows, f] > cut]
                        if left and h[a].sum() >= 1 and h[z].sum() >= 1:
                            value = (g[a].sum() ** 2 / (h[a].sum() + l2) + g[z].sum() ** 2 / (h[z].sum() + l2) - total) / 2
                            if value > best[0] + 1e-9:
                                best = (value, (f, a, z))
                if best[1] is None:
                    margins[rows, c] += -rate * g[rows].sum() / (h[rows].sum() + l2)
                else:
                    gain[best[1][0]] += best[0]
                    grow(best[1][1], left - 1)
                    grow(best[1][2], left - 1)

            grow(np.arange(len(y)), depth)
    assert np.abs(model.margins(b) - margins).max() < 1e-9 and np.abs(model.gain - gain).max() < 1e-6
    assert model.gain.argmax() == 1  # the feature that decides one class alone
    got = {r.key: (r.yhat, r.shares) for r in B.predicted(df, "x", model, ["key"]).collect()}
    e = np.exp(margins)
    assert [got[i][0] for i in range(len(y))] == margins.argmax(axis=1).tolist()
    assert np.abs(np.array([got[i][1] for i in range(len(y))]) - e / e.sum(axis=1, keepdims=True)).max() < 1e-9


def test_additive_finds_planted_pair(spark):
    rng = np.random.default_rng(1)
    n, d = 3000, 6
    x = rng.normal(size=(n, d))
    score = 2.5 * np.sign(x[:, 1] * x[:, 4]) + 0.8 * x[:, 2]
    y = (rng.random(n) < 1 / (1 + np.exp(-score))).astype(int)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "key long, y int, x array<double>")
    df = L.folds(df, F.col("y"), "key", 3)
    model, ranked = B.additive(df, "x", "y", "fold", 3, bins=8, rounds=10, rate=1.0, pairs=1)
    assert ranked[0][:2] == (1, 4) and ranked[0][2] > 5 * ranked[1][2]
    parts = B.explained(df, "x", model, "fold", ["key", "y"])
    assert {r.feat for r in parts.select("feat").distinct().collect()} == {*(f"f{i + 1}" for i in range(d)), "f2 x f5", "intercept"}
    # the parts add up to the held-out score, which tells the classes apart only with the pair
    scores = parts.groupBy("key", "y").agg(F.sum("score").alias("s"), F.sum(F.when(~F.col("feat").contains(" x "), F.col("score"))).alias("single")).collect()
    rate = lambda c: np.mean([(getattr(r, c) > 0) == r.y for r in scores])
    assert rate("s") > 0.85 and rate("single") < 0.7
    fold = {r.key: r.fold for r in df.select("key", "fold").collect()}
    b = np.array([[sum(v > e for e in row) for v, row in zip(one, model.limits)] for one in x])
    want = model.margins(b)[np.arange(n), [fold[i] for i in range(n)]]
    assert max(abs(r.s - want[r.key]) for r in scores) < 1e-9


def test_pair_gain_is_the_best_cut():
    rng = np.random.default_rng(0)
    n, s = rng.integers(0, 9, (6, 6)).astype(float), rng.normal(size=(6, 6))
    best = 0
    for i in range(1, 6):
        for j in range(1, 6):
            parts = [(n[a, b].sum(), s[a, b].sum()) for a in (slice(0, i), slice(i, 6)) for b in (slice(0, j), slice(j, 6))]
            best = max(best, sum(t * t / c for c, t in parts if c))
    assert abs(B.pair_gain(n, s) - best) < 1e-9


def test_shadows_and_binomial_test(spark):
    rng = np.random.default_rng(3)
    n = 900
    x = rng.normal(size=(n, 6))
    y = ((x[:, 2] + 0.8 * x[:, 4] + 0.5 * rng.normal(size=n)) > 0).astype(int)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "key long, y int, x array<double>")
    rows = B.shadowed(df, "x", "y", "key", 1, block=100).collect()
    v = np.array([r.v for r in rows])
    assert v.shape == (n, 12) and sorted(map(tuple, v[:, :6].tolist())) == sorted(map(tuple, x.tolist()))
    for j in range(6):  # each component's values, in another order
        assert np.allclose(np.sort(v[:, j]), np.sort(v[:, 6 + j])) and (v[:, j] != v[:, 6 + j]).mean() > 0.9
    assert sum(B.tails(k, 10)[0] - (B.tails(k + 1, 10)[0] if k < 10 else 0) for k in range(11)) == 1 and B.tails(9, 10)[0] == 11 / 1024 and B.tails(1, 10)[1] == 11 / 1024
    found = B.all_relevant(df, "x", "y", tests=8, rounds=2, depth=2, bins=8)
    assert {i for i, _, d in found if d == "confirmed"} == {3, 5} and all(h < 8 for i, h, _ in found if i not in (3, 5))
