"""Operators that need a recursion along the series, run in chunks with a halo."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from .windows import chunked


def _smooth(v: list[float], process: float, noise: float) -> list[float]:
    """Rauch-Tung-Striebel smoother of a constant-velocity model; unit time steps."""
    x, s, a, b, c = v[0], 0.0, noise, 0.0, noise  # position, speed, and their covariance [[a, b], [b, c]]
    seen = []
    for z in v:
        px, ps = x + s, s
        pa, pb, pc = a + 2 * b + c + process / 4, b + c + process / 2, c + process
        k1, k2 = pa / (pa + noise), pb / (pa + noise)
        x, s = px + k1 * (z - px), ps + k2 * (z - px)
        a, b, c = (1 - k1) * pa, (1 - k1) * pb, pc - k2 * pb
        seen.append((x, s, a, b, c, px, ps, pa, pb, pc))
    out = [x]
    for t in range(len(v) - 2, -1, -1):
        fx, fs, a, b, c, *_ = seen[t]
        px, ps, pa, pb, pc = seen[t + 1][5:]
        det = pa * pc - pb * pb
        ca, cb = a + b, b  # covariance of now with the next step: P * F'
        cc, cd = b + c, c
        g11, g12 = (ca * pc - cb * pb) / det, (cb * pa - ca * pb) / det
        g21, g22 = (cc * pc - cd * pb) / det, (cd * pa - cc * pb) / det
        dx, ds = x - px, s - ps
        x, s = fx + g11 * dx + g12 * ds, fs + g21 * dx + g22 * ds
        out.append(x)
    return out[::-1]


def kalman(df: DataFrame, keys: list[str], process: float, noise: float, size: int = 2048, halo: int = 128) -> DataFrame:
    """v smoothed along bin; the halo must be several times the filter's memory, then chunks don't show."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        rows["v"] = _smooth(rows["v"].tolist(), process, noise)
        return rows.loc[rows["own"], [*keys, "bin", "v"]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in (*keys, "bin", "v"))
    return chunked(df.select(*keys, "bin", "v"), size, halo).groupBy(*keys, "chunk").applyInPandas(work, schema).select(*keys, "bin", "v")
