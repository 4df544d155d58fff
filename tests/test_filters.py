"""Filters in chunks against plain loops over whole series."""

import math

import numpy as np
import pytest

from waveloom.operators import filters as X


def loop(x, sections, state=None):
    """Sample by sample, section by section; state: None for rest, else that of a constant first sample."""
    for b0, b1, b2, a1, a2 in sections:
        s1 = s2 = 0.0
        if state is not None and len(x):
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            s2 = (b2 - a2 * gain) * x[0]
            s1 = (b1 - a1 * gain) * x[0] + s2
        out = []
        for v in x:
            y = b0 * v + s1
            s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
            out.append(y)
        x = out
    return np.array(x)


def both_ways(x, sections, state=None):
    return loop(loop(x, sections, state)[::-1], sections, state)[::-1]


SERIES = {0: 300, 1: 1, 2: 64, 3: 129, None: 40}


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    data = {r: rng.normal(size=n).cumsum() for r, n in SERIES.items()}
    rows = [(r, i, float(v)) for r, x in data.items() for i, v in enumerate(x)]
    rng.shuffle(rows)
    return data, spark.createDataFrame([(None if r is None else int(r), int(i), float(v)) for r, i, v in rows], "rec int, bin long, v double")


def collected(df, data):
    out = {r: np.full(len(x), np.nan) for r, x in data.items()}
    for r in df.collect():
        out[r.rec][r.bin] = r.v
    return out


@pytest.mark.parametrize("kind, order, low, high", [("low", 4, 0.1, None), ("high", 5, 0.02, None), ("band", 3, 0.05, 0.2), ("high", 1, 0.3, None)])
def test_magnitude(kind, order, low, high):
    w = lambda f: math.tan(math.pi * f)
    for f in (0.01, 0.07, 0.15, 0.4):
        z, gain = np.exp(-2j * math.pi * f), 1
        for b0, b1, b2, a1, a2 in X.butterworth(kind, order, low, high):
            gain *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
        ratio = {"low": lambda: w(f) / w(low), "high": lambda: w(low) / w(f), "band": lambda: (w(f) ** 2 - w(low) * w(high)) / (w(f) * (w(high) - w(low)))}[kind]()
        assert abs(abs(gain) - 1 / math.sqrt(1 + ratio ** (2 * order))) < 1e-9


@pytest.mark.parametrize("chunk", [64, 37, 65_536])
@pytest.mark.parametrize("steady", [False, True])
def test_recursive_in_chunks(series, chunk, steady):
    data, df = series
    sections = X.butterworth("band", 2, 0.03, 0.2) + X.notch(0.1, 5)
    for zero_phase, whole in ((True, both_ways), (False, loop)):
        got = collected(X.recursive(df, ["rec"], sections, zero_phase, steady, chunk), data)
        for r, x in data.items():
            assert np.abs(got[r] - whole(x.tolist(), sections, 1 if steady else None)).max() < 1e-8


@pytest.mark.parametrize("chunk", [16, 1000])
def test_artifacts_split_series(spark, series, chunk):
    data, df = series
    bad = [(0, 0, 20), (0, 50, 51), (0, 100, 180), (3, 120, 500), (None, 10, 20)]
    sections = X.butterworth("high", 2, 0.05)
    got = collected(X.around_artifacts(df, ["rec"], spark.createDataFrame(bad, "rec int, b0 long, b1 long"), ["rec"], sections, chunk), data)
    for r, x in data.items():
        if r is None:
            continue  # rows without a recording match no artifact
        want, at = x.copy(), 0
        for b0, b1 in [(a, b) for k, a, b in bad if k == r] + [(len(x), len(x))]:
            if b0 > at:
                want[at:b0] = both_ways(x[at:b0].tolist(), sections, 1)
            at = b1
        assert np.abs(got[r] - want).max() < 1e-8


@pytest.mark.parametrize("up, down, chunk", [(2, 3, 1000), (2, 3, 7), (5, 2, 16), (1, 4, 3), (1, 1, 50)])
def test_resampling(series, up, down, chunk):
    data, df = series
    taps = X.resampling_taps(up, down, 4)
    reach = (len(taps) - 1) // 2
    out = {}
    for r in X.resampled(df, ["rec"], up, down, 4, chunk).collect():
        out[r.rec, r.bin] = r.v
    want = {}
    for r, x in data.items():
        for m in range((len(x) - 1) * up // down + 1):
            want[r, m] = sum(taps[m * down - k * up + reach] * v for k, v in enumerate(x) if 0 <= m * down - k * up + reach < len(taps))
    assert out.keys() == want.keys() and max(abs(out[k] - want[k]) for k in want) < 1e-9
