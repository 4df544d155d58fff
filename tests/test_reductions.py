"""Parcel components, filter banks, iterated histograms, p values, quantiles and carried-over scores against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.operators import filters as X
from waveloom.operators import learn as L
from waveloom.operators import parcels as P
from waveloom.operators import stats as S


def test_parcel_components(spark):
    rng = np.random.default_rng(0)
    n, members = 200, {"a": [0, 1, 2, 3, 4], "b": [5, 6, 7], "c": [8]}
    x = rng.normal(size=(n, 9)) @ rng.normal(size=(9, 9)) + 50
    x[:, 8] = 3.0  # no variance at all
    rec = np.arange(n) % 3
    rows = [(int(rec[i]), c, i, float(x[i, c])) for i in range(n) for c in range(9) if (i, c) != (17, 6)]
    bad = [(int(rec[i]), i) for i in range(0, n, 5)]
    table = spark.createDataFrame([(c, p) for p, cs in members.items() for c in cs], "ch int, parcel string")
    scores, model = P.components(spark.createDataFrame(rows, "rec int, ch int, bin long, v double"), table, 0.9, spark.createDataFrame(bad, "rec int, bin long"))
    models = {r.parcel: r for r in model.collect()}
    got = {(r.parcel, r.bin): r.scores for r in scores.collect()}
    for p, cs in members.items():
        some = x[:, cs]
        fit = some[[i for i in range(n) if i % 5 and not (p == "b" and i == 17)]]
        values, turn = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(len(cs), len(cs)))
        part = values[::-1] / values.sum() if values.sum() > 1e-9 else np.eye(len(cs))[0]
        k = int(np.searchsorted(np.cumsum(part), 0.9 - 1e-12) + 1)
        assert np.abs(np.array(models[p].shares) - part[:k]).max() < 1e-9
        axes = turn[:, ::-1].T[:k]
        axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])[:, None]
        for i in range(n):
            if p == "b" and i == 17:
                assert (p, i) not in got
            else:
                assert np.abs(np.array(got[p, i]) - (some[i] - fit.mean(axis=0)) @ axes.T).max() < 1e-8


@pytest.mark.parametrize("chunk, skip", [(50, 1), (64, 4), (16_384, 3)])
def test_filter_bank_as_whole_convolutions(spark, chunk, skip):
    rng = np.random.default_rng(1)
    data = {0: rng.normal(size=333), 1: rng.normal(size=7)}
    df = spark.createDataFrame([(r, i, float(v)) for r, x in data.items() for i, v in enumerate(x)], "rec int, bin long, v double").repartition(3)
    bands = {"a": (0.05, 0.15), "b": (0.2, 0.4)}
    got = {(r.rec, r.band, r.bin): complex(r.re, r.im) for r in X.envelopes(df, ["rec"], bands, 33, skip, chunk).collect()}
    assert len(got) == 2 * sum(len(range(0, len(x), skip)) for x in data.values())
    for r, x in data.items():
        for name, (a, b) in bands.items():
            whole = np.convolve(x, X.analytic(a, b, 33))[16 : 16 + len(x)]
            assert max(abs(got[r, name, i] - whole[i]) for i in range(0, len(x), skip)) < 1e-9


def test_envelope_of_a_tone(spark):
    tone = 3 * np.cos(2 * math.pi * 0.1 * np.arange(600))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(tone)], "bin long, v double").withColumn("rec", F.lit(1))
    got = {r.band: r.m for r in X.envelopes(df, ["rec"], {"in": (0.06, 0.14), "out": (0.3, 0.4)}, 129).filter("bin BETWEEN 100 AND 500").groupBy("band").agg(F.avg("envelope").alias("m")).collect()}
    assert abs(got["in"] - 3) < 0.05 and got["out"] < 0.05


def iterated(v, bins, rare, take):
    """The rule with numpy's histogram."""
    v = np.array(v)
    short = len(v) / 10 < bins
    bins = int(len(v) / 10) if short else bins
    if bins == 0:
        return None
    limit, first = None, 1.0
    while first > 1 - rare and (short or bins <= len(v) / 10):
        if limit is not None:
            v = v[v < limit]
        n, edges = np.histogram(v, bins=bins)
        shares = np.cumsum(n) / n.sum()
        first, limit = shares[0], edges[min(take, bins)]
        bins *= 2
    return edges[0], edges[np.flatnonzero(shares > 1 - rare)[0]]


def test_iterated_histogram(spark):
    rng = np.random.default_rng(6)
    groups = {
        "plain": rng.exponential(size=3000), "tail": np.append(rng.exponential(size=4000), [1e4, 2e4, 1e6]), "deep": np.append(rng.exponential(size=5000), [1e3, 1e5, 1e7, 1e9]),
        "short": np.append(rng.exponential(size=300), [500.0]), "same": np.full(500, 2.0), "tiny": rng.random(9), "ten": rng.random(10), "whole": rng.integers(0, 30, 2500).astype(float),
    }
    df = spark.createDataFrame([(g, i, float(x)) for g, v in groups.items() for i, x in enumerate(v)] + [("plain", -1, None)], "g string, i int, a double").repartition(4)
    got = {r.g: (r.low, r.high) for r in S.effective_range(df, ["g"], "a", 50, 0.01, 5).collect()}
    assert got.keys() == groups.keys() and got["tiny"] == (None, None)
    for g, v in groups.items():
        want = iterated(v, 50, 0.01, 5)
        assert want is None or np.allclose(got[g], want, rtol=1e-12, atol=0), g
    kept = {(r.g, r.i) for r in S.without_rare(df.filter("g in ('plain', 'tail')"), ["i"], "g", "a", 50, 0.01, 5).collect()}
    gone = {i for g in ("plain", "tail") for i, x in enumerate(groups[g]) if x > got[g][1]}
    assert kept == {(g, i) for g in ("plain", "tail") for i in range(len(groups[g])) if i not in gone} | {("plain", -1)}


def t_tail(t, free):
    """Two-sided p value: the density integrated over the angle, by Gauss and Legendre in pieces."""
    node, weight = np.polynomial.legendre.leggauss(60)

    def area(a, b):
        edges = np.linspace(a, b, 400)
        mid, half = (edges[1:] + edges[:-1]) / 2, (edges[1:] - edges[:-1]) / 2
        return float((half[:, None] * weight * np.exp((free - 1) * np.log(np.cos(mid[:, None] + half[:, None] * node)))).sum())

    return area(math.atan(abs(t) / math.sqrt(free)), math.pi / 2) / area(0, math.pi / 2)


def test_p_value(spark):
    cases = [(t, f) for t in (0.0, 1e-3, 0.5, 1.0, 2.0, 5.0, 12.0, -3.0) for f in (1, 2, 3, 7, 30, 200, 5000, 100_000)]
    df = spark.createDataFrame([(float(t), float(f)) for t, f in cases], "t double, f double")
    got = df.select("t", "f", S.incomplete_beta(F.col("f") / (F.col("f") + F.col("t") * F.col("t")), F.col("t") * F.col("t") / (F.col("f") + F.col("t") * F.col("t")), F.col("f") / 2, F.lit(0.5)).alias("p")).collect()
    for r in got:
        want = t_tail(r.t, r.f)
        assert abs(r.p - want) < 1e-9 * max(want, 1e-3), (r, want)


def test_quantiles_by_ranges(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=20_000), "b": rng.integers(0, 5, 3000).astype(float), "c": np.array([7.0]), "d": np.full(400, -1.5), "e": np.array([1.0, 9.0]), None: rng.normal(size=77)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("f", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.05, 0.25, 0.5, 0.93, 1.0]
    for accuracy, rounds in ((20_000, 1), (100, 1), (100, 2), (50, 3)):
        got = {r.g: r.q for r in S.quantiles(df, ["g"], "v", shares, accuracy, rounds).collect()}
        assert got.keys() == groups.keys()
        assert all(np.allclose(got[g], np.quantile(v, shares), rtol=1e-12, atol=1e-12) for g, v in groups.items())
    for q, upper in ((0.05, None), (0.0, 0.9), (0.2, 0.3)):
        got = {r.g: (r.n, r.mean, r.std) for r in S.trimmed(df, ["g"], "v", q, upper).collect()}
        for g, v in groups.items():
            some = v[(v >= np.quantile(v, q)) & (v <= np.quantile(v, 1 - q if upper is None else upper))]
            # a group of which nothing is within the quantiles has no row
            assert (g in got) == bool(len(some)) and (not len(some) or (got[g][0] == len(some) and np.allclose(got[g][1:], (some.mean(), some.std()), rtol=1e-9, atol=1e-9))), (g, q)


def test_redistributed_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    x[:, 2] = 3 * x[:, 0] - x[:, 1] + 0.01 * rng.normal(size=400)
    x[:, 4] = 0.5 * x[:, 2] + x[:, 3] + 0.02 * rng.normal(size=400)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, x array<double>")
    steps = L.pruned(df, "x", 5.0)
    gone = [bad for bad, _, _ in steps]
    assert len(gone) == 2
    kept = {i + 1: float(rng.normal()) for i in range(6) if i + 1 not in gone}
    want, left = dict(kept), list(range(6))
    for bad, others, _ in steps:
        left.remove(bad - 1)
        assert [i + 1 for i in left] == others
    for bad, others, _ in reversed(steps):
        at = [i - 1 for i in others]
        beta = np.linalg.lstsq(np.column_stack([x[:, at], np.ones(400)]), x[:, bad - 1], rcond=None)[0]
        want[bad] = sum(b * want[i] for b, i in zip(beta, others))
    scores = spark.createDataFrame([(1, i, s) for i, s in kept.items()] + [(2, i, 2 * s) for i, s in kept.items()], "cls int, feat int, score double")
    got = {(r.cls, r.feat): r.score for r in L.redistributed(scores, steps, ["cls"]).collect()}
    assert len(got) == 12 and all(abs(got[c, i] - c * want[i]) < 1e-6 for c in (1, 2) for i in want)
