"""Operators that cut series into chunks give what they give without."""

import random

from waveloom.operators import windows as X


def filled(values):
    known = [i for i, v in enumerate(values) if v is not None]
    out = []
    for i, v in enumerate(values):
        before, after = [k for k in known if k <= i], [k for k in known if k >= i]
        if v is not None:
            out.append(v)
        elif not before:
            out.append(0.0)
        elif not after:
            out.append(values[before[-1]])
        else:
            a, b = before[-1], after[0]
            out.append(values[a] + (values[b] - values[a]) * (i - a) / (b - a))
    return out


def test_interpolation_across_chunks(spark):
    rnd = random.Random(5)
    series = {r: [None if rnd.random() < p else rnd.random() for _ in range(100)] for r, p in enumerate((0.1, 0.5, 0.9, 1.0))}
    rows = [(r, i, v) for r, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "rec int, bin long, v double")
    for chunk in (1, 7, 1000):
        got = {(x.rec, x.bin): x.v for x in X.interpolated(df, ["rec"], chunk).collect()}
        for r, vs in series.items():
            assert all(abs(got[r, i] - w) < 1e-12 for i, w in enumerate(filled(vs)))


def test_windows_do_not_depend_on_chunks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from waveloom.operators import spectral as S

    rnd = random.Random(8)
    rows = [(r, i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for r, n in ((0, 150), (1, 33), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "rec int, bin long, v double, im double").repartition(4)
    series = df.select("rec", "bin", "v")

    def results():
        some = {
            "differences": X.differences(series, ["rec"], 2.0),
            "moments": X.moments(series, ["rec"], ["v"], 12, 4),
            "sums": X.sums(series, ["rec"], F.col("v"), 12, 4),
            "fir": X.fir(series, ["rec"], [0.1, 0.2, 0.4, 0.3, -0.1]),
            "wiener": X.wiener(series, ["rec"], 5),
            "box": X.box_sum(series, ["rec"], F.col("v"), 6, X.CHUNK),
            "numbered": X.numbered(series.filter("bin % 3 > 0"), ["rec"], "i", X.CHUNK),
            "unwrapped": S.unwrapped(df.select("rec", "bin", F.col("v").alias("re"), "im"), ["rec"], "bin"),
        }
        return {k: sorted([tuple(None if x is None else round(x, 9) for x in r) for r in d.collect()], key=str) for k, d in some.items()}

    whole = results()
    assert all(whole.values()) and [r[3] for r in sorted(whole["numbered"]) if r[0] == 0] == list(range(100))
    for chunk in (7, 16):
        monkeypatch.setattr(X, "CHUNK", chunk)
        monkeypatch.setattr(S, "CHUNK", chunk)
        assert results() == whole
