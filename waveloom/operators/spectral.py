"""Time-frequency and coupling aggregates over (rec, ch, freq, re, im)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import CHUNK, chunked


def neighbours(tfr: DataFrame) -> DataFrame:
    """rec, ch1, ch2: each channel with the next one of its recording."""
    chans = tfr.select("rec", "ch").distinct()
    return chans.withColumn("ch2", F.lead("ch").over(W.partitionBy("rec").orderBy("ch"))).filter("ch2 is not null").withColumnRenamed("ch", "ch1")


def cross_spectrum(tfr: DataFrame, pairs: DataFrame) -> DataFrame:
    """rec, ch1, ch2, freq, re, im of conj(x1) * x2 for the given pairs."""
    side = lambda n: tfr.select("rec", F.col("ch").alias(f"ch{n}"), "freq", F.col("re").alias(f"re{n}"), F.col("im").alias(f"im{n}"))
    rows = pairs.join(side(1), ["rec", "ch1"]).join(side(2), ["rec", "ch2", "freq"])
    return rows.select(
        "rec", "ch1", "ch2", "freq",
        (F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2")).alias("re"),
        (F.col("re1") * F.col("im2") - F.col("im1") * F.col("re2")).alias("im"),
    )


def band_average(csd: DataFrame, bands: DataFrame, floor: float = 1e-12) -> DataFrame:
    """Mean of log |csd| over the frequencies of each band (inclusive); the bands are a table of fixed size."""
    joined = csd.join(F.broadcast(bands), F.col("freq").between(F.col("lo"), F.col("hi")))
    level = F.log(F.greatest(F.hypot("re", "im"), F.lit(floor)))
    return joined.groupBy("rec", "ch1", "ch2", "band").agg(F.avg(level).alias("level"))


def normalised(tfr: DataFrame) -> DataFrame:
    """(x - complex mean) / std per channel and frequency over all recordings; std of |x - mean|."""
    key = ["ch", "freq"]
    mean = tfr.groupBy(*key).agg(F.avg("re").alias("mr"), F.avg("im").alias("mi"))
    rows = tfr.join(mean, key).select("rec", *key, (F.col("re") - F.col("mr")).alias("re"), (F.col("im") - F.col("mi")).alias("im"))
    std = rows.groupBy(*key).agg(F.sqrt(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("s"))
    return rows.join(std, key).select("rec", *key, F.try_divide("re", "s").alias("re"), F.try_divide("im", "s").alias("im"))


def lowpass(width: int, cut: float) -> list[float]:
    """Taps of a Hamming-windowed low pass; cut as a share of the sampling rate."""
    half = width // 2
    taps = [(2 * cut if k == half else math.sin(2 * math.pi * cut * (k - half)) / (math.pi * (k - half))) * (0.54 - 0.46 * math.cos(2 * math.pi * k / (width - 1))) for k in range(width)]
    total = sum(taps)
    return [t / total for t in taps]


def tapers(freqs: list[float], window: int, cycles: float = 3.0) -> list[tuple[float, int, float, float]]:
    """(freq, k, wre, wim) of one Gaussian taper per frequency (in cycles per bin): kernels of fixed size."""
    out = []
    for f in freqs:
        s = cycles / (2 * math.pi * f)
        w = [math.exp(-((k - (window - 1) / 2) ** 2) / (2 * s * s)) for k in range(window)]
        norm = math.sqrt(sum(x * x for x in w))
        out += [(f, k, x / norm * math.cos(2 * math.pi * f * k), -x / norm * math.sin(2 * math.pi * f * k)) for k, x in enumerate(w)]
    return out


def transform(series: DataFrame, freqs: list[float], window: int, step: int) -> DataFrame:
    """rec, ch, widx, freq, re, im of full windows every `step` bins: each bin goes to the windows over it
    and meets the kernels there, so that a window's sum is one aggregation."""
    spark = series.sparkSession
    kernels = spark.createDataFrame(tapers(freqs, window), "freq double, k int, wre double, wim double")
    last = F.floor(F.col("bin") / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("bin") - window + 1) / step))
    rows = series.withColumn("widx", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("k", (F.col("bin") - F.col("widx") * step).cast("int"))
    rows = rows.join(F.broadcast(kernels), "k")
    made = rows.groupBy("rec", "ch", "widx", "freq").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("wre")).alias("re"), F.sum(F.col("v") * F.col("wim")).alias("im"))
    return made.filter(F.col("n") == window).drop("n")


def unwrapped(series: DataFrame, by: list[str], order: str) -> DataFrame:
    """by.., order, phase, rate, amp of an analytic series (re, im): the phase without jumps of a whole turn, its change
    from one place to the next in turns, and the amplitude."""
    # a series in chunks: steps look one place back, turns are summed within the chunk and shifted by those of the chunks before
    places = W.partitionBy(*by, "chunk").orderBy(order)
    raw = chunked(series, CHUNK, 2, order).withColumn("__raw", F.atan2("im", "re"))
    step = F.coalesce(F.col("__raw") - F.lag("__raw").over(places), F.lit(0.0))
    turn = F.when(F.col("__step") > math.pi, 1).when(F.col("__step") < -math.pi, -1).otherwise(0)
    raw = raw.withColumn("__step", step).withColumn("__turn", turn).withColumn("__earlier", F.lag("__raw").over(places)).filter("own")
    chunks = W.partitionBy(*by).orderBy("chunk")  # one row a chunk
    before = F.coalesce(F.sum("__t").over(chunks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    turns = raw.groupBy(*by, "chunk").agg(F.sum("__turn").alias("__t")).select(*by, "chunk", before.alias("__before"))
    raw = raw.withColumn("__turns", F.sum("__turn").over(places.rowsBetween(W.unboundedPreceding, 0))).join(turns, [*by, "chunk"])
    turned = F.col("__raw") - 2 * math.pi * (F.col("__before") + F.col("__turns"))
    earlier = F.col("__earlier") - 2 * math.pi * (F.col("__before") + F.col("__turns") - F.col("__turn"))
    amp = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return raw.select(*by, order, turned.alias("phase"), ((turned - earlier) / (2 * math.pi)).alias("rate"), amp.alias("amp"))


def spectrogram(samples: DataFrame, window: int, skip: int | None = None) -> DataFrame:
    """rec, ch, win, freq, power: squared Fourier coefficients of windows of `window` bins, one every `skip`.

    Windows that are not full have none.  A window is one group of bounded size; the transform takes all
    windows of a batch at once.
    """
    skip = skip or window
    first = F.greatest(F.lit(0), F.ceil((F.col("bin") - window + 1) / skip))
    placed = samples.withColumn("win", F.explode(F.sequence(first.cast("long"), F.floor(F.col("bin") / skip).cast("long"))))
    blocks = placed.groupBy("rec", "ch", "win").agg(F.sort_array(F.collect_list(F.struct("bin", "v"))).alias("b"))
    full = blocks.filter(F.size("b") == window).select("rec", "ch", "win", F.transform("b", lambda x: x["v"]).alias("v"))

    def run(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            power = np.abs(np.fft.rfft(flat.reshape(-1, window), axis=1)) ** 2
            n, k = power.shape
            columns = [batch.column(c).take(pa.array(np.repeat(np.arange(n), k))) for c in ("rec", "ch", "win")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(power.ravel())], names=["rec", "ch", "win", "freq", "power"])

    kinds = {f.name: f.dataType.simpleString() for f in full.schema.fields}
    return full.mapInArrow(run, f"rec {kinds['rec']}, ch string, win long, freq int, power double")
