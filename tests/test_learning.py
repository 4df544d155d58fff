"""Learning queries without SQL against closed forms in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom import plans
from waveloom.operators import learn as L

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64), np.array([r.label for r in rows])


def discriminant(x, y):
    means = {c: x[y == c].mean(axis=0) for c in sorted(set(y))}
    pooled = sum((x[y == c] - m).T @ (x[y == c] - m) for c, m in means.items()) / len(x)
    inverse = np.linalg.pinv(pooled)
    return {c: (inverse @ m, -0.5 * m @ inverse @ m + np.log((y == c).mean())) for c, m in means.items()}


def predicted(x, model):
    classes = sorted(model)
    return np.array(classes)[np.argmax([x @ model[c][0] + model[c][1] for c in classes], axis=0)]


def balanced(y, yhat):
    return np.mean([(yhat[y == c] == c).mean() for c in sorted(set(y))])


def run(spark, name):
    return plans.QUERIES[name](spark, SF).collect()


def test_principal_components(spark, table):
    keys, x, _ = table
    axis = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]
    got = {r.key: r.first for r in run(spark, "m5_principal_components")}
    want = dict(zip(keys.tolist(), (x @ axis).tolist()))
    sign = np.sign(sum(got[k] * want[k] for k in got))
    assert max(abs(got[k] - sign * want[k]) for k in got) < 1e-4


def test_discriminant(spark, table):
    keys, x, y = table
    want = dict(zip(keys.tolist(), predicted(x, discriminant(x, y)).tolist()))
    got = {r.key: r.yhat for r in run(spark, "m11_discriminant")}
    assert np.mean([got[k] == want[k] for k in want]) > 0.99


def test_across_groups(spark, table):
    _, x, y = table
    for r in run(spark, "m10_across_groups"):
        g = int(r.pattern[-1])
        train, test = y % 3 != g, y % 3 == g
        yhat = predicted(x[test], discriminant(x[train], y[train] % 2))
        value = next(v for k, v in r.asDict().items() if "acc" in k)
        assert value == pytest.approx(balanced(y[test] % 2, yhat), abs=0.02)


def test_variance_inflation(spark, table):
    _, x, _ = table
    want = np.diag(np.linalg.pinv(np.corrcoef(x.T)))
    assert [r.vif for r in sorted(run(spark, "m15_variance_inflation"), key=lambda r: r.feat)] == pytest.approx(want.tolist(), abs=1e-5)


def test_contributions(spark, table):
    _, x, y = table
    model = discriminant(x, y % 2)
    got = {(r["class"], r.feat): r["mean"] for r in run(spark, "m21_contributions")}
    for c, (w, b) in model.items():
        assert [got[c, k + 1] for k in range(x.shape[1])] == pytest.approx((w * x.mean(axis=0)).tolist(), abs=1e-4)


def test_shuffled_labels_are_the_same_labels_elsewhere(spark):
    df = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 2).alias("y"))
    got = L.shuffled(df, "y", 1).collect()
    assert sorted(r.key for r in got) == list(range(2000)) and sum(r.y for r in got) == 1000
    assert 0.4 < np.mean([r.y == r.key % 2 for r in got]) < 0.6
    kinds = {r.kind for r in run(spark, "m9_cross_validated")}
    assert kinds == {"labels", "shuffled"}


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(x), i) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500)))]
    got = L.ranked(spark.createDataFrame(rows, "feat int, x double, key int"), "feat", ["x", "key"], 8).collect()
    for g in range(3):
        own = sorted((r for r in got if r.feat == g), key=lambda r: (r.x, r.key))
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and {r.total for r in own} == {len(own)}


def test_grid_search_stops_early(spark):
    df = spark.range(60).select((F.col("id") * 64).alias("key"), (F.col("id") % 2).alias("y"), F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("v"))
    got = L.grid_search(df, "v", "y", [{"regParam": 0.01}] * 6, 2, 2)
    assert {r.point for r in got.select("point").distinct().collect()} == {0, 1, 2}
