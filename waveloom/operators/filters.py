"""Recursive filters and resampling along series of any length.

A recursive filter is a linear state machine, so a chunk of a series is an affine map of the state it begins
with: its transition depends on its length only, its offset is the state that it reaches from rest.  Chunks give
their offsets independently, the small maps of a series are put together in order, and the chunks run again from
the states that this gives.  Within a chunk the same holds for short blocks, which makes it matrix products.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a chunk, and of the blocks inside it.
CHUNK, BLOCK = 65_536, 64

Sections = tuple[tuple[float, float, float, float, float], ...]


def butterworth(kind: str, order: int, low: float, high: float | None = None) -> Sections:
    """Second-order sections (b0, b1, b2, a1, a2) of a 'low', 'high' or 'band' pass; edges in cycles per bin, below 1/2.

    The analog prototype's poles are moved to the (prewarped) edges and mapped by the bilinear transform; the gain is 1
    at frequency 0, at half the rate, or at the middle of the band.
    """
    poles = np.exp(1j * math.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    edge = math.tan(math.pi * low)
    if kind == "low":
        poles, zeros, at = poles * edge, [-1.0] * order, 1.0
    elif kind == "high":
        poles, zeros, at = edge / poles, [1.0] * order, -1.0
    elif kind == "band":
        other = math.tan(math.pi * high)
        half, middle = poles * (other - edge) / 2, math.sqrt(edge * other)
        root = np.sqrt(half * half - middle * middle + 0j)
        poles, zeros, at = np.concatenate([half + root, half - root]), [1.0, -1.0] * order, np.exp(2j * math.atan(middle))
    else:
        raise ValueError(kind)
    poles = (1 + poles) / (1 - poles)
    pairs = [(p, p.conjugate()) for p in poles if p.imag > 1e-12]
    real = sorted(p.real for p in poles if abs(p.imag) <= 1e-12)
    pairs += [(a, b) for a, b in zip(real[::2], real[1::2], strict=False)] + ([(real[-1], 0.0)] if len(real) % 2 else [])
    out, left = [], list(zeros)
    for a, b in sorted(pairs, key=lambda p: abs(p[0])):
        own = [left.pop(0) for _ in range(min(2 if b != 0.0 or len(real) % 2 == 0 else 1, len(left)))]
        num = np.real(np.poly(own)) if own else np.ones(1)
        den = np.real(np.poly([a, b]))
        size = abs(np.polyval(num, at) * at ** (2 - (len(num) - 1)) / np.polyval(den, at))
        num = np.append(num, np.zeros(3 - len(num))) / size
        out.append((*num.tolist(), float(den[1]), float(den[2])))
    return tuple(out)


def notch(at: float, quality: float = 30.0) -> Sections:
    """One section with a zero at a frequency (cycles per bin), about at / quality wide."""
    w = 2 * math.pi * at
    gain = 1 / (1 + math.tan(w / quality / 2))
    c = -2 * math.cos(w) * gain
    return ((gain, c, gain, c, 2 * gain - 1),)


class Cascade:
    """Sections in series as one linear machine with two numbers of state a section."""

    def __init__(self, sections: Sections):
        self.sections, self.size = sections, 2 * len(sections)
        unit = np.zeros((BLOCK, self.size + 1))
        unit[0, -1] = 1.0
        out, end, steps = self._steps(unit, np.vstack([np.eye(self.size), np.zeros(self.size)]).T)
        self.watch = out[:, :-1]  # BLOCK x state: what a state gives
        lags = np.arange(BLOCK)[:, None] - np.arange(BLOCK)[None, :]
        self.answer = np.where(lags >= 0, out[np.maximum(lags, 0), -1], 0.0)  # BLOCK x BLOCK: what samples give
        self.step = steps[0][:, :-1]  # one bin's transition
        self.across = end[:, :-1]  # a block's
        self.enter = np.stack([steps[BLOCK - 1 - k][:, -1] for k in range(BLOCK)], axis=1)  # state x BLOCK

    def _steps(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Run columns of samples bin by bin from columns of states: output, last states, all states."""
        state, out, seen = state.copy(), np.empty(x.shape), []
        for t, v in enumerate(x):
            for k, (b0, b1, b2, a1, a2) in enumerate(self.sections):
                y = b0 * v + state[2 * k]
                state[2 * k], state[2 * k + 1] = b1 * v - a1 * y + state[2 * k + 1], b2 * v - a2 * y
                v = y
            out[t] = v
            seen.append(state.copy())
        return out, state, seen

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and last state for one run of samples."""
        whole = len(x) // BLOCK * BLOCK
        blocks = x[:whole].reshape(-1, BLOCK)
        into, out = blocks @ self.enter.T, blocks @ self.answer.T
        starts = np.empty((len(blocks), self.size))
        for k in range(len(blocks)):
            starts[k] = state
            state = self.across @ state + into[k]
        out = (out + starts @ self.watch.T).ravel()
        rest, last, _ = self._steps(x[whole:, None], state[:, None])
        return np.concatenate([out, rest[:, 0]]), last[:, 0]

    def power(self, n: int) -> np.ndarray:
        """The transition of n bins."""
        return np.linalg.matrix_power(self.step, n)

    def steady(self) -> np.ndarray:
        """The state that a constant 1 keeps."""
        return np.linalg.solve(np.eye(self.size) - self.step, self._steps(np.ones((1, 1)), np.zeros((self.size, 1)))[1][:, 0])


@lru_cache(maxsize=16)
def cascade(sections: Sections) -> Cascade:
    return Cascade(sections)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _once(df: DataFrame, keys: list[str], sections: Sections, chunk: int, back: bool, steady: bool) -> DataFrame:
    """One run over every series, from its end to its begin if `back`."""
    rows = df.select(*keys, "bin", "v").withColumn("__c", F.floor(F.col("bin") / chunk))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    sign = -1 if back else 1

    def ordered(table: pa.Table) -> pa.Table:
        return table.take(pa.array(np.argsort(sign * _column(table, "bin"), kind="stable")))

    def offset(table: pa.Table) -> pa.Table:
        """The chunk as an affine map: its length, and the state that it reaches from rest."""
        table = ordered(table)
        v = _column(table, "v").astype(np.float64)
        end = cascade(sections).run(v, np.zeros(2 * len(sections)))[1]
        return table.slice(0, 1).select([*keys, "__c"]).append_column("n", pa.array([len(v)])).append_column("first", pa.array([v[0]])).append_column("state", pa.array([end.tolist()]))

    def begin(table: pa.Table) -> pa.Table:
        """The state with which each chunk of a series begins: one row for every `chunk` samples."""
        machine = cascade(sections)
        table = table.take(pa.array(np.argsort(sign * _column(table, "__c"), kind="stable")))
        state = machine.steady() * table.column("first")[0].as_py() if steady else np.zeros(machine.size)
        powers, states = {}, []
        for n, end in zip(table.column("n").to_pylist(), table.column("state").to_pylist(), strict=True):
            states.append(state.tolist())
            if n not in powers:
                powers[n] = machine.power(n)
            state = powers[n] @ state + np.array(end)
        return table.select([*keys, "__c"]).append_column("state", pa.array(states, pa.list_(pa.float64())))

    def run(table: pa.Table, start: pa.Table) -> pa.Table:
        table = ordered(table)
        v = cascade(sections).run(_column(table, "v").astype(np.float64), np.array(start.column("state")[0].as_py()))[0]
        return table.select([*keys, "bin"]).append_column("v", pa.array(v))

    heads = rows.groupBy(*keys, "__c").applyInArrow(offset, f"{kinds}, __c long, n long, first double, state array<double>")
    starts = heads.groupBy(*keys).applyInArrow(begin, f"{kinds}, __c long, state array<double>")
    return rows.groupBy(*keys, "__c").cogroup(starts.groupBy(*keys, "__c")).applyInArrow(run, f"{kinds}, bin long, v double")


def recursive(df: DataFrame, keys: list[str], sections: Sections, zero_phase: bool = True, steady: bool = False, chunk: int = CHUNK) -> DataFrame:
    """keys.., bin, v filtered by second-order sections, forward or (zero phase) forward and backward.

    A series (without gaps in bin, v not null) begins from rest, or, if `steady`, as if its first value had always been there.
    Chunks of `chunk` bins are the units of work; the results do not depend on it.
    """
    once = _once(df, keys, sections, chunk, False, steady)
    return _once(once, keys, sections, chunk, True, steady) if zero_phase else once


def islands(df: DataFrame, bad: DataFrame, on: list[str], chunk: int = CHUNK) -> DataFrame:
    """Add island: a number that grows along the series and changes at every interval [b0, b1) of `bad` (on.., disjoint); null inside one.

    Intervals meet samples in chunks of bins, so no series is one task's group.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy(*on).orderBy("b0")  # one row an interval
    before = F.coalesce(F.lag("b1").over(order), F.lit(0))
    number = F.row_number().over(order)
    marked = bad.select(*on, "b0", "b1", before.alias("__from"), number.alias("__i"))
    last = bad.groupBy(*on).agg(F.max("b1").alias("__from"), F.count("*").alias("__i"))
    good = marked.select(*on, F.col("__from").alias("__g0"), F.col("b0").alias("__g1"), (F.col("__i") - 1).alias("island"))
    good = good.filter("__g1 > __g0").withColumn("__c", F.explode(F.sequence(F.floor(F.col("__g0") / chunk).cast("long"), F.floor((F.col("__g1") - 1) / chunk).cast("long"))))
    rows = df.withColumn("__c", F.floor(F.col("bin") / chunk))
    hit = rows.join(good, [*on, "__c"]).filter("bin >= __g0 AND bin < __g1").select(*on, "bin", "island").distinct()
    rows = rows.drop("__c").join(hit, [*on, "bin"], "left").join(last, on, "left")
    after = F.when(F.col("__i").isNull(), F.lit(0)).when(F.col("bin") >= F.col("__from"), F.col("__i"))
    return rows.withColumn("island", F.coalesce("island", after).cast("long")).drop("__i", "__from")


def around_artifacts(df: DataFrame, keys: list[str], bad: DataFrame, on: list[str], sections: Sections, chunk: int = CHUNK) -> DataFrame:
    """Zero-phase filter of each stretch between artifacts on its own; samples inside artifacts stay as they are."""
    rows = islands(df.select(*keys, "bin", "v"), bad, on, chunk)
    clean = rows.filter(F.col("island").isNotNull()).select(*keys, "island", "bin", "v")
    done = recursive(clean, [*keys, "island"], sections, steady=True, chunk=chunk).drop("island")
    return done.unionByName(rows.filter(F.col("island").isNull()).select(*keys, "bin", "v"))


def resampled(df: DataFrame, keys: list[str], up: int, down: int, half: int = 10, chunk: int = CHUNK) -> DataFrame:
    """keys.., bin, v at up / down times the rate: a windowed-sinc low pass at every new place, its phases as rows of a table.

    Samples beyond the ends count as 0.  A chunk of new bins gets the old bins that its taps reach.
    """
    taps = resampling_taps(up, down, half)
    reach = (len(taps) - 1) // 2
    # the old bins that touch new bin m stand from (m * down - reach) / up to (m * down + reach) / up
    first = F.floor(F.floor((F.col("bin") * up - reach) / down) / chunk)
    last = F.floor(F.floor((F.col("bin") * up + reach) / down) / chunk)
    rows = df.select(*keys, "bin", "v").withColumn("__c", F.explode(F.sequence(F.greatest(F.lit(0), first).cast("long"), F.greatest(F.lit(0), last).cast("long"))))
    ends = df.groupBy(*keys).agg(F.max("bin").alias("__last"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def run(table: pa.Table) -> pa.Table:
        bins, v, c = _column(table, "bin"), _column(table, "v").astype(np.float64), table.column("__c")[0].as_py()
        new = np.arange(c * chunk, min((c + 1) * chunk, table.column("__last")[0].as_py() * up // down + 1))
        low = bins.min(initial=0)
        dense = np.zeros(int(bins.max(initial=0)) - low + 1)
        dense[bins - low] = v
        width = (len(taps) - 1) // up + 1
        begin = -((reach - new * down) // up)  # the first old bin that a tap reaches
        out = np.zeros(len(new))
        for k in range(width + 1):
            old = begin + k
            tap = new * down - old * up + reach
            good = (tap >= 0) & (tap < len(taps)) & (old >= low) & (old - low < len(dense))
            out[good] += taps[tap[good]] * dense[old[good] - low]
        heads = [pa.array([table.column(x)[0].as_py()] * len(new), table.schema.field(x).type) for x in keys]
        return pa.table([*heads, pa.array(new), pa.array(out)], names=[*keys, "bin", "v"])

    from .stats import joined_back

    return joined_back(rows, ends, keys).groupBy(*keys, "__c").applyInArrow(run, f"{kinds}, bin long, v double")


def resampling_taps(up: int, down: int, half: int = 10) -> np.ndarray:
    from .spectral import lowpass

    most = max(up, down)
    return up * np.array(lowpass(2 * half * most + 1, 0.5 / most))


def analytic(low: float, high: float, width: int) -> np.ndarray:
    """Complex taps of a band (cycles per bin): a windowed low pass of half its width, moved to its middle; twice that of
    positive frequencies alone, so that the absolute value of the output is the band's envelope."""
    from .spectral import lowpass

    turn = np.exp(2j * math.pi * (low + high) / 2 * (np.arange(width) - width // 2))
    return 2 * np.array(lowpass(width, (high - low) / 2)) * turn


def envelopes(df: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]], width: int = 129, skip: int = 1, chunk: int = 16_384) -> DataFrame:
    """keys.., band, bin, re, im, envelope of every `skip`-th bin: all bands' analytic filters in one pass.

    Overlap and save: a chunk and the half filter length around it are transformed once, multiplied by the
    transforms of all bands, and turned back; what the filter length spoils is the halo, so the results are
    those of whole-series convolutions (samples beyond the ends count as 0).  v must not be null: impute artifacts before
    (:func:`imputed`).
    """
    from .windows import chunked

    names = list(bands)
    taps = np.array([analytic(a, b, width) for a, b in bands.values()])
    half, size = width // 2, 1 << (chunk + 2 * (width // 2) + width - 1).bit_length()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    response = np.fft.fft(taps, size, axis=1)

    def run(table: pa.Table) -> pa.Table:
        bins, v, own = _column(table, "bin"), _column(table, "v").astype(np.float64), table.column("own").to_numpy(zero_copy_only=False)
        begin = table.column("chunk")[0].as_py() * chunk - half
        x = np.zeros(chunk + 2 * half)
        x[bins - begin] = v
        out = np.fft.ifft(np.fft.fft(x, size)[None, :] * response, axis=1)
        at = np.sort(bins[own])
        at = at[at % skip == 0]
        z = out[:, at - begin + half]
        n = len(at)
        heads = [pa.array([table.column(k)[0].as_py()] * (n * len(names)), table.schema.field(k).type) for k in keys]
        band = pa.array(np.repeat(np.array(names, object), n), pa.string())
        columns = [*heads, band, pa.array(np.tile(at, len(names))), pa.array(z.real.ravel()), pa.array(z.imag.ravel()), pa.array(np.abs(z).ravel())]
        return pa.table(columns, names=[*keys, "band", "bin", "re", "im", "envelope"])

    rows = chunked(df.select(*keys, "bin", "v"), chunk, half)
    return rows.groupBy(*keys, "chunk").applyInArrow(run, f"{kinds}, band string, bin long, re double, im double, envelope double")


def imputed(df: DataFrame, keys: list[str], bad: DataFrame, on: list[str], chunk: int = CHUNK) -> DataFrame:
    """v with the bins of `bad` (on.., bin) put on the straight line between their neighbours."""
    from .windows import interpolated, masked

    return interpolated(masked(df.select(*keys, "bin", "v"), bad, [*on, "bin"]), keys, chunk)
