"""Classifiers from sufficient statistics against fits of each one in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.operators import learn as L
from waveloom.operators import sufficient as E


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n, d = 240, 6
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, d)) + 100
    x[:, 0] += 1.2 * y
    x[:, 3] -= 0.9 * (y == 1)
    df = spark.createDataFrame([(i, f"c{c}", v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "key long, y string, x array<double>")
    df = L.folds(df, F.col("y"), "key", 3)
    fold = np.zeros(n, int)
    for r in df.select("key", "fold").collect():
        fold[r.key] = r.fold
    return x, np.array([f"c{c}" for c in y]), fold, df


def fitted(x, y):
    names = sorted(set(y))
    means = np.array([x[y == c].mean(axis=0) for c in names])
    pooled = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in zip(names, means)) / len(x)
    w = means @ np.linalg.pinv(pooled)
    return names, w, -0.5 * (w * means).sum(axis=1) + np.log([(y == c).mean() for c in names])


def predicted(x, model):
    names, w, b = model
    return np.array(names)[(x @ w.T + b).argmax(axis=1)]


def balanced(y, yhat):
    return np.mean([(yhat[y == c] == c).mean() for c in sorted(set(y))])


def held_out(x, y, fold):
    out = np.empty(len(y), y.dtype)
    for f in set(fold):
        out[fold == f] = predicted(x[fold == f], fitted(x[fold != f], y[fold != f]))
    return out


@pytest.mark.parametrize("block", [4096, 50])
def test_permutations_in_one_pass(spark, table, block):
    x, y, fold, df = table
    n = 30
    got = {r.model: r.bacc for r in E.permutation_test(df, "x", "y", 3, n, block=block).collect()}
    # the same permutations one by one: blocks are told by the same hash
    count = max(1, -(-len(y) // block))
    of = {r.key: r.b for r in df.select("key", F.pmod(F.xxhash64("key"), F.lit(count)).alias("b")).collect()}
    labels = np.repeat(y[None, :], n + 1, axis=0)
    for b in set(of.values()):
        at = np.array(sorted(k for k in of if of[k] == b))
        labels[:, at] = E.shuffles(y[at], b, n, 0)
    want = {p: balanced(labels[p], held_out(x, labels[p], fold)) for p in range(n + 1)}
    assert got.keys() == want.keys() and max(abs(got[p] - want[p]) for p in want) < 1e-12
    assert want[0] > max(want[p] for p in range(1, n + 1))  # the classes do differ
    row = E.p_value(spark.createDataFrame(list(got.items()), "model int, bacc double")).first()
    assert row.n_permutations == n and abs(row.p - (1 + sum(want[p] >= want[0] for p in range(1, n + 1))) / (n + 1)) < 1e-12


def test_versions_and_subsets(table):
    x, y, fold, df = table
    got = {r.version: {} for r in E.versions(df, "x", "y", 3).collect()}
    for r in E.versions(df, "x", "y", 3).collect():
        got[r.version][r.y, r.yhat] = r.n
    share = lambda c: np.mean([sum(n for (a, b), n in c.items() if a == b == k) / sum(n for (a, _), n in c.items() if a == k) for k in sorted(set(y))])
    assert abs(share(got["all rows"]) - balanced(y, predicted(x, fitted(x, y)))) < 1e-12
    assert abs(share(got["cross-validated"]) - balanced(y, held_out(x, y, fold))) < 1e-12
    models = [fitted(x[fold != f], y[fold != f]) for f in range(3)]
    mean = (models[0][0], np.mean([m[1] for m in models], axis=0), np.mean([m[2] for m in models], axis=0))
    assert abs(share(got["mean of folds"]) - balanced(y, predicted(x, mean))) < 1e-12
    assert share(got["check on shuffled"]) < 0.5 and len(got) == 5
    sets = [[0], [3], [0, 3], [1, 2, 4, 5], list(range(6))]
    scores = {r.model: r.bacc for r in E.subsets(df, "x", "y", sets, 3).collect()}
    assert all(abs(scores[i] - balanced(y, held_out(x[:, s], y, fold))) < 1e-12 for i, s in enumerate(sets))


def test_smallest_sufficient(table):
    x, y, fold, df = table
    order, steps = [0, 3, 1, 2, 4, 5], [1, 2, 3]
    rows = sorted(E.smallest_sufficient(df, "x", "y", order, steps, 0.03, 0.02, 3).collect(), key=lambda r: r.n_features)
    want = [balanced(y, held_out(x[:, order[:n]], y, fold)) for n in (1, 2, 3, 6)]
    assert [r.n_features for r in rows] == [1, 2, 3, 6] and max(abs(r.bacc - w) for r, w in zip(rows, want)) < 1e-12
    good = [k for k in range(4) if want[k] >= want[-1] - 0.03 and (want[k + 1] if k < 3 else want[k]) - want[k] <= 0.02]
    assert [r.chosen for r in rows] == [k == good[0] for k in range(4)]


def test_dummy_is_the_mean_of_guesses(table):
    _, y, fold, df = table
    got = {r.fold: r.bacc for r in E.dummy(df, "y").collect()}
    for f in range(3):
        assert abs(got[f] - np.mean([(y[fold != f] == c).mean() for c in sorted(set(y[fold == f]))])) < 1e-12


def test_group_folds(spark):
    rng = np.random.default_rng(5)
    rows, key = [], 0
    for g in range(40):
        for c in range(3):
            for _ in range(int(rng.integers(0, 30 if g else 200))):
                rows.append((key, g, c))
                key += 1
    df = spark.createDataFrame(rows, "key long, grp long, y int")
    dealt = {r.grp: r.fold for r in E.group_folds(df, "grp", "y", 4).collect()}
    assert set(dealt) == {r[1] for r in rows} and set(dealt.values()) == {0, 1, 2, 3}
    for c in range(3):
        total = sum(r[2] == c for r in rows)
        most = max(sum(r[1] == g and r[2] == c for r in rows) for g in dealt) / total
        shares = [sum(r[2] == c and dealt[r[1]] == f for r in rows) / total for f in range(4)]
        assert max(abs(s - 0.25) for s in shares) <= most
