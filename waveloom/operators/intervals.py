"""Interval algebra on (rec, s, e) rows; bounds in seconds or bins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _cells(s: Column, e: Column, bucket: float) -> Column:
    return F.sequence(F.floor(s / bucket).cast("long"), F.floor(e / bucket).cast("long"))


def overlaps(left: DataFrame, right: DataFrame, bucket: float, least: float = 0.01, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Pairs of rows of equal keys whose intervals share more than `least`; right's columns get the suffix _2.

    Both sides go to the time buckets that they touch, which makes an equi-join; a pair is kept only
    in the bucket where the later of the two begins, so no pair comes twice.
    """
    a = left.withColumn("__cell", F.explode(_cells(F.col("s"), F.col("e"), bucket)))
    b = right.select(*[F.col(c).alias(c if c in keys else f"{c}_2") for c in right.columns])
    b = b.withColumn("__cell", F.explode(_cells(F.col("s_2"), F.col("e_2"), bucket)))
    joined = a.join(b, [*keys, "__cell"])
    first = F.floor(F.greatest("s", "s_2") / bucket).cast("long") == F.col("__cell")
    return joined.filter(first & (F.least("e", "e_2") - F.greatest("s", "s_2") > least)).drop("__cell")


def union(ivals: DataFrame, keys: list[str], gap: float = 0) -> DataFrame:
    """keys.., s, e: overlapping (or by at most `gap` distant) intervals of a key become one."""
    order = W.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("s") > reach + gap), 1).otherwise(0)
    island = F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = ivals.withColumn("__new", fresh).withColumn("__island", island)
    return rows.groupBy(*keys, "__island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__island")


def intersection(left: DataFrame, right: DataFrame, bucket: float, least: float = 0.01) -> DataFrame:
    """rec, s, e: what both sides cover."""
    both = overlaps(left, right, bucket, least)
    return both.select("rec", F.greatest("s", "s_2").alias("s"), F.least("e", "e_2").alias("e")).distinct()


def windows_of(ivals: DataFrame, n_windows: Column | str, window: int, skip: int) -> DataFrame:
    """Add widx: the windows from the first that holds the interval's begin to the last that holds its end.

    Windows begin at multiples of `skip` and are `window` bins long; b0, b1 are bins.  On a regular grid
    both ends have a closed form, so no join is needed.
    """
    n = F.col(n_windows) if isinstance(n_windows, str) else n_windows
    first = F.greatest(F.lit(0), F.floor((F.col("b0") - window) / skip) + 1)
    last = F.least(n - 1, F.floor(F.col("b1") / skip))
    return ivals.withColumn("__first", first).withColumn("__last", last).filter("__first <= __last").withColumn("widx", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")


def bins_of(ivals: DataFrame) -> DataFrame:
    """Add bin: each bin of [b0, b1)."""
    return ivals.filter("b1 > b0").withColumn("bin", F.explode(F.sequence(F.col("b0"), F.col("b1") - 1)))


def inside(series: DataFrame, ivals: DataFrame, keys: tuple[str, ...] = ("rec",), how: str = "inner") -> DataFrame:
    """Rows of the series joined (`how`) with the intervals [b0, b1) of their keys that hold their bin, and what else these have.

    No interval is exploded into bins, and rows meet by the keys alone, as series in bin order are dealt out already: rows
    stay where they are.  A row is held against all intervals of its keys.  The join is a merge: sizes estimated for
    intervals that come from explode() are too low, and a broadcast for them would bring all intervals to the driver.
    """
    held = ivals.withColumnsRenamed({k: f"__{k}" for k in (*keys, "b0", "b1")}).hint("merge")
    same = reduce(and_, (F.col(k) == F.col(f"__{k}") for k in keys))
    return series.join(held, same & (F.col("bin") >= F.col("__b0")) & (F.col("bin") < F.col("__b1")), how).drop(*[f"__{k}" for k in (*keys, "b0", "b1")])


def covered(ivals: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., covered: length of the union."""
    return union(ivals, keys).groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("covered"))


def total_lengths(ivals: DataFrame, t0: float, t1: float) -> DataFrame:
    """rec, label, total: summed lengths clipped to [t0, t1]; overlaps count twice."""
    length = F.greatest(F.lit(0.0), F.least("e", F.lit(t1)) - F.greatest("s", F.lit(t0)))
    return ivals.groupBy("rec", "label").agg(F.sum(length).alias("total"))


def touching(ivals: DataFrame, label: str, suffix: str, bucket: float) -> DataFrame:
    """Rows of other labels; those that touch an interval of `label` get the suffix."""
    marks = ivals.filter(F.col("label") == label)
    rest = ivals.filter(F.col("label") != label).withColumn("__row", F.xxhash64("rec", "label", "s", "e"))
    hit = overlaps(rest, marks.drop("label"), bucket, -1e-9).select("__row").distinct().withColumn("__hit", F.lit(True))
    return rest.join(hit, "__row", "left").withColumn("label", F.when(F.col("__hit"), F.concat("label", F.lit(suffix))).otherwise(F.col("label"))).drop("__row", "__hit")


def phases(ivals: DataFrame, before: float, inside: float, after: float) -> DataFrame:
    """Explode each interval into prestart, poststart, main, preend, postend; inner parts shrink where they would cross."""
    half = (F.col("e") - F.col("s")) / 2
    inner = F.least(F.lit(inside), half)
    part = lambda name, a, b: F.struct(F.lit(name).alias("phase"), a.alias("ps"), b.alias("pe"))
    s, e = F.col("s"), F.col("e")
    parts = F.array(
        part("prestart", F.greatest(F.lit(0.0), s - before), s),
        part("poststart", s, s + inner),
        part("main", s + inner, e - inner),
        part("preend", e - inner, e),
        part("postend", e, e + after),
    )
    return ivals.withColumn("__p", F.explode(parts)).select(*ivals.columns, "__p.phase", "__p.ps", "__p.pe")


def timeline(lengths: DataFrame, ivals: DataFrame, order: str = "rec") -> DataFrame:
    """Put all recordings on one time line: intervals clipped to their recording and shifted by its offset."""
    offset = F.coalesce(F.sum("length").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    at = lengths.withColumn("offset", offset)  # one row per recording
    rows = ivals.join(at, "rec").withColumn("s", F.greatest("s", F.lit(0.0))).withColumn("e", F.least("e", "length")).filter("e > s")
    return rows.select("rec", "label", (F.col("s") + F.col("offset")).alias("s"), (F.col("e") + F.col("offset")).alias("e"))


def extended(ivals: DataFrame, left: float, right: float) -> DataFrame:
    return ivals.withColumn("s", F.greatest(F.col("s") - left, F.lit(0.0))).withColumn("e", F.col("e") + right)


def around(points: DataFrame, series: DataFrame, before: int, after: int) -> DataFrame:
    """Samples from `before` bins ahead of each point to `after` bins behind it, by offset (an equi-join on the bin)."""
    at = points.withColumn("off", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("bin", F.col("bin") + F.col("off"))
    return at.join(series, ["rec", "bin"])


def active(series: DataFrame, keys: list[str], threshold: float, gap: int, least: int) -> DataFrame:
    """keys.., b0, b1: runs of bins with v >= threshold, glued over gaps of at most `gap` bins, of `least` bins or more."""
    hits = series.filter(F.col("v") >= threshold).select(*keys, F.col("bin").alias("s"), (F.col("bin") + 1).alias("e"))
    return union(hits, keys, gap).filter(F.col("e") - F.col("s") >= least).withColumnsRenamed({"s": "b0", "e": "b1"})


def one_pass_merge(ivals: DataFrame, by: list[str]) -> DataFrame:
    """by.., s, e: intervals in order, each merged with its successor if they overlap and neither is merged yet.

    One pass, so a chain of three overlapping intervals leaves one of two and one of one; see :func:`union`
    for the transitive form.  In a chain of neighbours that overlap, places 2k and 2k + 1 go together.
    """
    order = W.partitionBy(*by).orderBy("s", "e")
    new = F.coalesce(F.col("s") > F.lag("e").over(order), F.lit(True)).cast("int")
    chained = ivals.withColumn("__new", new).withColumn("__chain", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy(*by, "__chain").orderBy("s", "e")) - 1
    pairs = chained.withColumn("__pair", F.floor(place / 2))
    return pairs.groupBy(*by, "__chain", "__pair").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__chain", "__pair")
