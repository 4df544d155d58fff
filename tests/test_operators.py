"""Golden values and properties of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from waveloom.functions import names as N
from waveloom.operators import intervals as I
from waveloom.operators import learn as L
from waveloom.operators import report as R
from waveloom.operators import stats as S
from waveloom.operators import windows as X


def series(spark, channels, rec=1):
    rows = [(rec, ch, i, float(v)) for ch, vs in channels.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "rec int, ch string, bin long, v double")


def test_full_windows_only(spark):
    df = series(spark, {"a": range(6)})
    got = X.sums(df, ["rec", "ch"], F.col("v"), 4, 2).orderBy("widx").collect()
    assert [(r.widx, r.total) for r in got] == [(0, 6.0), (1, 14.0)]


def test_covariance_golden(spark):
    """Two steps of 20 samples, window 4, skip 2."""
    a, b = [1] * 6 + [0] * 14, [20] * 8 + [0] * 12
    zero = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0)], "rec int, ch string, mean double")
    got = X.covariance(series(spark, {"a": a, "b": b}), "a", "b", zero, 4, 2).orderBy("widx").collect()
    assert [r["cov"] for r in got] == [20, 20, 10, 0, 0, 0, 0, 0, 0]


def test_hjorth_of_a_constant_is_zero(spark):
    got = X.hjorth(series(spark, {"a": [5.0] * 16}), ["rec", "ch"], 8, 4).collect()
    assert len(got) == 3 and all(r.activity == r.mobility == r.complexity == 0 for r in got)


def test_moments_agree_with_direct_variance(spark):
    rnd = random.Random(3)
    v = [1e6 + rnd.random() for _ in range(40)]
    got = {r.widx: r.m2_v for r in X.moments(series(spark, {"a": v}), ["rec", "ch"], ["v"], 8, 2).collect()}
    for k, m2 in got.items():
        w = v[2 * k : 2 * k + 8]
        mean = sum(w) / 8
        assert m2 == pytest.approx(sum((x - mean) ** 2 for x in w), rel=1e-4)
    assert len(got) == 17


def test_interpolation_rules(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 5.0, None])], "rec int, bin long, v double")
    assert [r.v for r in X.interpolated(df, ["rec"]).orderBy("bin").collect()] == [0.0, 2.0, 3.0, 4.0, 5.0, 5.0]


def test_trimmed_mean_leaves_outliers_out(spark):
    rnd = random.Random(1)
    v = [rnd.uniform(-1, 1) for _ in range(300)] + [1e4] * 4
    got = S.trimmed(series(spark, {"a": v}), ["rec", "ch"]).first()
    assert abs(got["mean"]) < 1 and got["std"] < 1
    near = S.trimmed(series(spark, {"a": v}), ["rec", "ch"], approximate=1000).first()
    assert near["mean"] == pytest.approx(got["mean"], abs=0.05)


def test_rescaled_baseline_and_error(spark):
    df = series(spark, {"a": [1, 2, 3, 4]})
    stats = df.groupBy("rec", "ch").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    got = S.rescaled(df, stats, ["rec", "ch"]).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()
    assert got.m == pytest.approx(0) and got.s == pytest.approx(1)
    flat = series(spark, {"a": [2, 2]})
    none = flat.groupBy("rec", "ch").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    with pytest.raises(Exception, match="no spread"):
        S.rescaled(flat, none, ["rec", "ch"]).collect()


def ivals(spark, rows):
    return spark.createDataFrame(rows, "rec int, label string, s double, e double")


@pytest.mark.parametrize("bucket", [0.7, 5.0, 100.0])
def test_overlaps_like_brute_force(spark, bucket):
    rnd = random.Random(5)
    rows = [(rnd.randrange(3), rnd.choice("ab"), s := rnd.uniform(0, 30), s + rnd.uniform(0, 9)) for _ in range(60)]
    a, b = ivals(spark, [r for r in rows if r[1] == "a"]), ivals(spark, [r for r in rows if r[1] == "b"])
    got = sorted((r.rec, r.s, r.s_2) for r in I.overlaps(a, b, bucket).collect())
    want = sorted((x[0], x[2], y[2]) for x in rows if x[1] == "a" for y in rows if y[1] == "b" and x[0] == y[0] and min(x[3], y[3]) - max(x[2], y[2]) > 0.01)
    assert got == want


def test_union_covers_at_most_the_sum(spark):
    df = ivals(spark, [(1, "a", 0.0, 5.0), (1, "a", 1.0, 2.0), (1, "a", 4.0, 7.0), (1, "a", 9.0, 10.0), (2, "a", 0.0, 1.0)])
    assert sorted((r.rec, r.s, r.e) for r in I.union(df, ["rec"]).collect()) == [(1, 0.0, 7.0), (1, 9.0, 10.0), (2, 0.0, 1.0)]
    assert {r.rec: r.covered for r in I.covered(df, ["rec"]).collect()} == {1: 8.0, 2: 1.0}


def test_windows_of_like_rule(spark):
    df = spark.createDataFrame([(1, 5, 17), (1, 0, 3), (1, 90, 99)], "rec int, b0 long, b1 long").withColumn("n", F.lit(23).cast("long"))
    got = {}
    for r in I.windows_of(df, "n", 8, 4).collect():
        got.setdefault((r.b0, r.b1), []).append(r.widx)
    for (b0, b1), found in got.items():
        hit = [k for k in range(23) if 4 * k <= b0 < 4 * k + 8 or 4 * k <= b1 < 4 * k + 8]
        assert sorted(found) == list(range(min(hit), max(hit) + 1))


FEATURES = {
    "bpcorr_tremor_msrcR_9_18_c0,HFO_LFPR01": ("bpcorr", "tremor", "HFO", "msrcR_9_18_c0", "LFPR01", "msrc", "LFP"),
    "H_compl_msrcR_9_58_c0": ("H_compl", None, None, "msrcR_9_58_c0", None, "msrc", None),
    "con_tremor_LFPR01,msrcR_9_38_c0": ("con", "tremor", "tremor", "LFPR01", "msrcR_9_38_c0", "LFP", "msrc"),
    "rbcorr_gamma_msrcR_9_46_c0,gamma_msrcR_9_46_c0": ("rbcorr", "gamma", "gamma", "msrcR_9_46_c0", "msrcR_9_46_c0", "msrc", "msrc"),
}


def test_feature_names_golden(spark):
    df = spark.createDataFrame([(f,) for f in FEATURES], "feat string")
    assert {r[0]: tuple(r[1:]) for r in N.parsed(df).collect()} == FEATURES


def test_source_names(spark):
    df = spark.createDataFrame([("msrcR_9_18_c3",), ("srcL_7_c2",)], "ch string")
    assert [tuple(r.x) for r in df.select(N.source(F.col("ch")).alias("x")).collect()] == [("R", 9, 18, 3), ("L", -1, 7, 2)]


def test_metrics_from_confusion(spark):
    pred = spark.createDataFrame([(0, 0)] * 8 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] * 1, "y int, yhat int")
    m = {r.y: r for r in R.per_class(R.confusion(pred)).collect()}
    assert (m[1].tp, m[1].fn, m[1].fp, m[1].tn) == (3, 1, 2, 8) and m[1].f1 == pytest.approx(6 / 9)
    assert R.balanced_accuracy(R.confusion(pred)).first().bacc == pytest.approx((0.8 + 0.75) / 2)


def test_folds_are_stratified(spark):
    df = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    n = {(r.fold, r.y): r["count"] for r in L.folds(df, F.col("y"), "key", 4).groupBy("fold", "y").count().collect()}
    assert sum(n.values()) == 1000 and all(abs(n[f, 0] - 225) <= 64 and abs(n[f, 1] - 25) <= 64 for f in range(4))


def test_discriminant_separates(spark):
    rnd = random.Random(2)
    rows = [(i, i % 2, [rnd.gauss(3 * (i % 2), 1), rnd.gauss(0, 1)]) for i in range(300)]
    df = spark.createDataFrame(rows, "key int, y int, v array<double>")
    got = L.scored(df, "v", L.discriminant(df, "v", "y"))
    assert got.filter("y = yhat").count() > 270


def test_smoother_does_not_depend_on_chunks(spark):
    from waveloom.operators.smoothing import _smooth, kalman

    rnd = random.Random(8)
    v = [i / 10 + rnd.gauss(0, 1) for i in range(400)]
    whole = _smooth(v, 0.01, 1.0)
    got = [r.v for r in kalman(series(spark, {"a": v}), ["rec", "ch"], 0.01, 1.0, size=64, halo=100).orderBy("bin").collect()]
    assert got == pytest.approx(whole, abs=1e-3)
    rough = sum((a - b) ** 2 for a, b in zip(v[1:], v))
    assert sum((a - b) ** 2 for a, b in zip(whole[1:], whole)) < rough / 10


def test_common_patterns_find_the_loud_channel(spark):
    rnd = random.Random(4)
    rows = [(i, i % 2, [rnd.gauss(0, 5 if i % 2 == 0 else 1), rnd.gauss(0, 1), rnd.gauss(0, 1 if i % 2 == 0 else 5)]) for i in range(400)]
    df = spark.createDataFrame(rows, "key int, y int, v array<double>")
    (low, w0), (high, w1) = L.common_patterns(df, "v", "y", 1)
    assert low < 0.2 and high > 0.8
    assert max(range(3), key=lambda i: abs(w1[i])) == 0 and max(range(3), key=lambda i: abs(w0[i])) == 2
