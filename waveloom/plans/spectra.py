"""Queries over time-frequency data and couplings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import spectral as S
from ..sources import views as V
from .naming import _BANDS, bands
from .registry import query

_CSD = """pr AS (SELECT rec, ch ch1, lead(ch) OVER (PARTITION BY rec ORDER BY ch) ch2 FROM (SELECT DISTINCT rec, ch FROM fx_tfr)),
  csd AS (SELECT rec, ch1, ch2, a.freq, a.re * b.re + a.im * b.im re, a.re * b.im - a.im * b.re im FROM pr JOIN fx_tfr a USING (rec) JOIN fx_tfr b USING (rec, freq) WHERE a.ch = ch1 AND b.ch = ch2)"""
P8 = lambda c: F.round(c, 8).alias(c)


def _csd(spark, sf_dir):
    tfr = V.tfr(spark, sf_dir)
    return S.cross_spectrum(tfr, S.neighbours(tfr))


@query(f"WITH {_CSD} SELECT rec, ch1, ch2, freq, round(re, 8) re, round(im, 8) im FROM csd")
def a15_cross_spectrum(spark, sf_dir):
    return _csd(spark, sf_dir).select("rec", "ch1", "ch2", "freq", P8("re"), P8("im"))


@query(f"WITH {_CSD} SELECT rec, freq, round(avg(re), 8) re, round(avg(im), 8) im, round(avg(abs(im)), 8) abs_im, count(*) n FROM csd GROUP BY ALL")
def a17_average_coupling(spark, sf_dir):
    m = _csd(spark, sf_dir).groupBy("rec", "freq").agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.avg(F.abs("im")).alias("abs_im"), F.count("*").alias("n"))
    return m.select("rec", "freq", P8("re"), P8("im"), P8("abs_im"), "n")


@query(f"WITH {_CSD}, {_BANDS} SELECT rec, ch1, ch2, band, round(avg(ln(greatest(sqrt(re * re + im * im), 1e-12))), 6) AS level FROM csd JOIN bands ON freq BETWEEN lo AND hi GROUP BY ALL")
def a14_band_average(spark, sf_dir):
    return S.band_average(_csd(spark, sf_dir), bands(spark)).withColumn("level", F.round("level", 6))


@query("""WITH m AS (SELECT ch, freq, avg(re) mr, avg(im) mi FROM fx_tfr GROUP BY ALL), d AS (SELECT rec, t.ch, t.freq, re - mr re, im - mi im FROM fx_tfr t JOIN m USING (ch, freq)),
  s AS (SELECT ch % 20 g, freq, sqrt(avg(re * re + im * im)) s FROM (SELECT ch, freq, re - avg(re) OVER w re, im - avg(im) OVER w im FROM fx_tfr WINDOW w AS (PARTITION BY ch % 20, freq)) GROUP BY ALL)
  SELECT rec, ch, freq, round((re - avg(re) OVER w) / s, 6) re, round((im - avg(im) OVER w) / s, 6) im FROM fx_tfr JOIN s ON s.g = fx_tfr.ch % 20 AND s.freq = fx_tfr.freq WINDOW w AS (PARTITION BY fx_tfr.ch % 20, fx_tfr.freq)""".replace("SELECT rec, ch, freq, round((re", "SELECT rec, fx_tfr.ch, fx_tfr.freq, round((re"))
def a16_normalised_tfr(spark, sf_dir):
    """Twenty channel positions over all recordings: complex mean and spread per position and frequency."""
    rows = V.tfr(spark, sf_dir).withColumn("own", F.col("ch")).withColumn("ch", F.col("ch") % 20)
    done = S.normalised(rows.withColumn("rec", F.struct("rec", "own")))
    return done.select("rec.rec", F.col("rec.own").alias("ch"), "freq", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query("WITH p AS (SELECT rec, ch, freq, ln(greatest(re * re + im * im, 1e-12)) l FROM fx_tfr WHERE freq BETWEEN 11 AND 30) SELECT rec, ch, round(avg(l), 6) beta_power FROM p GROUP BY ALL")
def a45_band_power(spark, sf_dir):
    power = F.log(F.greatest(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.lit(1e-12)))
    return V.tfr(spark, sf_dir).filter("freq BETWEEN 11 AND 30").groupBy("rec", "ch").agg(F.round(F.avg(power), 6).alias("beta_power"))


@query("WITH p AS (SELECT rec, ch, sum((re * re + im * im)) FILTER (freq BETWEEN 3 AND 10) s FROM fx_tfr GROUP BY ALL) SELECT rec, ch, round((s - avg(s) OVER w) / avg(s) OVER w, 6) corrected FROM p WINDOW w AS (PARTITION BY rec)")
def a13_mean_corrected_power(spark, sf_dir):
    inside = F.when(F.col("freq").between(3, 10), F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    p = V.tfr(spark, sf_dir).groupBy("rec", "ch").agg(F.sum(inside).alias("s"))
    mean = F.avg("s").over(W.partitionBy("rec"))
    return p.select("rec", "ch", F.round((F.col("s") - mean) / mean, 6).alias("corrected"))


@query("SELECT rec, ch % 5 AS parcel, freq, round(sum(re), 6) re, round(sum(im), 6) im FROM fx_tfr GROUP BY ALL")
def a18_parcel_sums(spark, sf_dir):
    rows = V.tfr(spark, sf_dir).groupBy("rec", (F.col("ch") % 5).alias("parcel"), "freq").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return rows.select("rec", "parcel", "freq", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query("SELECT rec, ch % 5 AS parcel, freq, round(avg(re), 6) AS mean FROM fx_tfr GROUP BY ALL")
def f5_parcel_means(spark, sf_dir):
    return V.tfr(spark, sf_dir).groupBy("rec", (F.col("ch") % 5).alias("parcel"), "freq").agg(F.round(F.avg("re"), 6).alias("mean"))


@query("SELECT rec, ch, freq, round(atan2(im, re), 6) phase, round(sqrt(re * re + im * im), 8) amplitude, round(coalesce(atan2(im, re) - lag(atan2(im, re)) OVER (PARTITION BY rec, ch ORDER BY freq), 0), 6) step FROM fx_tfr")
def w14_phase_and_amplitude(spark, sf_dir):
    phase = F.atan2("im", "re")
    step = F.coalesce(phase - F.lag(phase).over(W.partitionBy("rec", "ch").orderBy("freq")), F.lit(0.0))
    return V.tfr(spark, sf_dir).select("rec", "ch", "freq", F.round(phase, 6).alias("phase"), F.round(F.hypot("re", "im"), 8).alias("amplitude"), F.round(step, 6).alias("step"))


def _tapers_sql():
    return "k(freq, k, wre, wim) AS (VALUES " + ", ".join(f"({f!r}::DOUBLE, {k}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for f, k, a, b in S.tapers([0.1, 0.25], 16)) + ")"


@query(f"WITH {_tapers_sql()} SELECT rec, ch, w widx, freq, round(sum(v * wre), 5) re, round(sum(v * wim), 5) im FROM fx_samples JOIN k ON true, LATERAL (SELECT (bin - k.k) // 8 AS w) WHERE (bin - k.k) % 8 = 0 AND bin >= k.k AND ch IN ('qty', 'price') GROUP BY ALL HAVING count(*) = 16")
def f3_time_frequency(spark, sf_dir):
    rows = V.samples(spark, sf_dir).filter(F.col("ch").isin("qty", "price"))
    return S.transform(rows, [0.1, 0.25], 16, 8).select("rec", "ch", "widx", "freq", F.round("re", 5).alias("re"), F.round("im", 5).alias("im"))


@query("""WITH p AS (SELECT rec, ch, atan2(im, re) ph FROM fx_tfr WHERE freq = 5), a AS (SELECT rec, ch, sqrt(re * re + im * im) am FROM fx_tfr WHERE freq = 20)
  SELECT rec, round(sqrt(sum(am * cos(ph)) ** 2 + sum(am * sin(ph)) ** 2) / sum(am), 6) coupling FROM p JOIN a USING (rec, ch) GROUP BY rec""")
def f9_phase_amplitude_coupling(spark, sf_dir):
    tfr = V.tfr(spark, sf_dir)
    phase = tfr.filter("freq = 5").select("rec", "ch", F.atan2("im", "re").alias("ph"))
    amp = tfr.filter("freq = 20").select("rec", "ch", F.hypot("re", "im").alias("am"))
    both = phase.join(amp, ["rec", "ch"])
    size = F.hypot(F.sum(F.col("am") * F.cos("ph")), F.sum(F.col("am") * F.sin("ph")))
    return both.groupBy("rec").agg(F.round(size / F.sum("am"), 6).alias("coupling"))


@query(f"WITH {_BANDS}, p AS (SELECT rec, band, sqrt(re * re + im * im) a FROM fx_tfr JOIN bands ON freq BETWEEN lo AND hi), q AS (SELECT rec, band, quantile_cont(a, 0.05) q0, quantile_cont(a, 0.95) q1 FROM p GROUP BY ALL) SELECT rec, band, count(*) n, round(avg(a), 6) mean, round(stddev_pop(a), 6) std FROM p JOIN q USING (rec, band) WHERE a BETWEEN q0 AND q1 GROUP BY ALL")
def a3_band_stats(spark, sf_dir):
    from ..operators.stats import trimmed

    rows = V.tfr(spark, sf_dir).join(F.broadcast(bands(spark)), F.col("freq").between(F.col("lo"), F.col("hi")))
    stats = trimmed(rows.select("rec", "band", F.hypot("re", "im").alias("v")), ["rec", "band"])
    return stats.select("rec", "band", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("WITH p AS (SELECT freq, re * re + im * im a FROM fx_tfr), c AS (SELECT freq, quantile_cont(a, 0.99) cap FROM p GROUP BY freq) SELECT freq, round(min(a), 8) least, round(max(a), 8) most, round(avg(a), 8) mean, count(*) n FROM p JOIN c USING (freq) WHERE a <= cap GROUP BY freq")
def a10_outlier_free_extremes(spark, sf_dir):
    """Minimum, maximum and mean below a percentile cap (in place of iterated histograms)."""
    p = V.tfr(spark, sf_dir).select("freq", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("a"))
    cap = p.groupBy("freq").agg(F.percentile("a", 0.99).alias("cap"))
    rows = p.join(cap, "freq").filter("a <= cap")
    return rows.groupBy("freq").agg(F.round(F.min("a"), 8).alias("least"), F.round(F.max("a"), 8).alias("most"), F.round(F.avg("a"), 8).alias("mean"), F.count("*").alias("n"))


@query(f"WITH {_tapers_sql()}, z AS (SELECT rec, ch, w widx, freq, sqrt(sum(v * wre) ** 2 + sum(v * wim) ** 2) a FROM fx_samples JOIN k ON true, LATERAL (SELECT (bin - k.k) // 8 AS w) WHERE (bin - k.k) % 8 = 0 AND bin >= k.k AND ch = 'price' GROUP BY ALL HAVING count(*) = 16) SELECT rec, freq, count(*) n, round(avg(a), 4) envelope FROM z GROUP BY ALL")
def f2_band_envelope(spark, sf_dir):
    """Amplitude of an analytic filter pair, decimated to its windows."""
    rows = S.transform(V.samples(spark, sf_dir).filter("ch = 'price'"), [0.1, 0.25], 16, 8)
    return rows.groupBy("rec", "freq").agg(F.count("*").alias("n"), F.round(F.avg(F.hypot("re", "im")), 4).alias("envelope"))


@query("SELECT rec, ch, freq, round(re * re + im * im, 8) AS power, round(ln(greatest(re * re + im * im, 1e-12)), 6) log_power FROM fx_tfr")
def x12_complex_power(spark, sf_dir):
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return V.tfr(spark, sf_dir).select("rec", "ch", "freq", F.round(p, 8).alias("power"), F.round(F.log(F.greatest(p, F.lit(1e-12))), 6).alias("log_power"))


def parcels(spark, sf_dir):
    """rec, ch, bin, v of 64 sources (the components of a vector) and the eight parcels that they belong to."""
    rows = V.table(spark, sf_dir, "embeddings").select(F.col("label").alias("rec"), F.col("vec_id").alias("bin"), F.posexplode("embedding").alias("ch", "v"))
    return rows, spark.range(64).select(F.col("id").cast("int").alias("ch"), (F.col("id") % 8).cast("int").alias("parcel"))


@query()
def f5_parcel_components(spark, sf_dir):
    """Leading components of each parcel (nine tenths of its variance), fitted without every seventh bin: their number, shares and spread."""
    from ..operators.parcels import components

    samples, members = parcels(spark, sf_dir)
    scores, model = components(samples, members, 0.9, samples.filter("bin % 7 = 0").select("rec", "bin"))
    spread = scores.groupBy("parcel").agg(F.count("*").alias("n"), F.stddev_pop(F.col("scores")[0]).alias("spread"))
    return model.join(spread, "parcel").select("parcel", F.size("shares").alias("k"), F.round(F.aggregate("shares", F.lit(0.0), lambda a, b: a + b), 8).alias("share"), "n", F.round("spread", 8).alias("spread"))


@query()
def a10_iterated_extremes(spark, sf_dir):
    """Range of power without its rare tail by iterated histograms, and mean inside it, for each frequency."""
    from ..operators import stats as Q

    p = V.tfr(spark, sf_dir).select("freq", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("a"))
    ends = Q.effective_range(p, ["freq"], "a")
    inside = Q.joined_back(p, ends, ["freq"]).filter("a <= high").groupBy("freq").agg(F.avg("a").alias("mean"), F.count("*").alias("n"))
    return Q.joined_back(ends, inside, ["freq"]).select("freq", F.round("low", 10).alias("low"), F.round("high", 10).alias("high"), F.round("mean", 10).alias("mean"), "n")
