"""Robust group statistics and rescaling."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Accuracy of the sketches that give the first ranges, and equal steps into which a range is cut again.
ACCURACY, STEPS = 20_000, 64


def joined_back(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Add the other columns of `found`, one row a group; null keys are equal."""
    own = [f"__k{i}" for i in range(len(keys))]
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)), F.lit(True))
    return df.join(found.withColumnsRenamed(dict(zip(keys, own, strict=True))), same).drop(*own)


def _place(n: Column, share: float) -> Column:
    """The place (from 0) of a quantile among n values, between two of them if it is not whole."""
    return F.lit(share) * (n - 1)


def ranges(df: DataFrame, keys: list[str], x: str, shares: list[float], accuracy: int = ACCURACY, rounds: int = 1) -> DataFrame:
    """keys.., lo0, hi0, lo1, ..: for each share a range of values that holds its quantile in the group.

    A mergeable sketch of each group gives the first ranges: to either side of a quantile the narrowest of a ladder of shares
    that exceeds the sketch's error by two values.  Every further round counts how many values lie below and inside a range,
    cuts it into STEPS equal parts by a sketch of what is inside, and keeps the part that holds the place with a part to
    either side.
    """
    rows = df.select(*keys, x).filter(F.col(x).isNotNull())
    ladder = [2 / accuracy * 4**k for k in range(40) if 2 / accuracy * 4 ** (k - 1) < 1]
    ends = [min(1.0, max(0.0, s + sign * d)) for s in shares for sign in (-1, 1) for d in ladder]
    found = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx(x, ends, accuracy).alias("__e"))
    rung = F.size(F.filter(F.array(*map(F.lit, ladder)), lambda d: (d - 1 / accuracy) * F.col("__n") < 2))
    at = lambda side: F.get("__e", F.lit(side * len(ladder)) + F.least(rung, F.lit(len(ladder) - 1)))
    found = found.select(*keys, *[at(2 * j + i).alias(f"{n}{j}") for j in range(len(shares)) for i, n in enumerate(("lo", "hi"))])
    for _ in range(rounds - 1):
        inside = lambda j: F.when(F.col(x).between(F.col(f"lo{j}"), F.col(f"hi{j}")), F.col(x))
        steps = [i / STEPS for i in range(STEPS + 1)]
        counts = [F.count("*").alias("__n")]
        for j in range(len(shares)):
            counts += [F.count_if(F.col(x) < F.col(f"lo{j}")).alias(f"__b{j}"), F.count(inside(j)).alias(f"__i{j}"), F.percentile_approx(inside(j), steps, 16 * STEPS).alias(f"__e{j}")]
        cut = joined_back(rows, found, keys).groupBy(*keys).agg(*counts)
        part = lambda j, up: ((_place(F.col("__n"), shares[j]) + up - F.col(f"__b{j}")) / F.col(f"__i{j}") * STEPS).cast("int")
        low = lambda j: F.get(f"__e{j}", F.greatest(F.lit(0), part(j, -1) - 1)).alias(f"lo{j}")
        high = lambda j: F.get(f"__e{j}", F.least(F.lit(STEPS), part(j, 1) + 2)).alias(f"hi{j}")
        found = cut.select(*keys, *[f(j) for j in range(len(shares)) for f in (low, high)])
    return found


def _counted(df: DataFrame, keys: list[str], x: str, shares: list[float], accuracy: int, rounds: int, extra: list[Column] = (), merged: list[Column] = ()) -> DataFrame:
    """keys.., __n, q (the quantiles), __c (values inside a range with their numbers): values that are in no range only add to
    counts, equal values inside one are a single entry; `extra` is aggregated over the former, `merged` takes it along."""
    some = range(len(shares))
    rows = joined_back(df.select(*keys, x).filter(F.col(x).isNotNull()), ranges(df, keys, x, shares, accuracy, rounds), keys)
    inside = reduce(or_, (F.col(x).between(F.col(f"lo{j}"), F.col(f"hi{j}")) for j in some))
    below = [F.count_if(F.col(x) < F.col(f"lo{j}")).alias(f"__b{j}") for j in some]
    ends = [F.min(f"{n}{j}").alias(f"{n}{j}") for j in some for n in ("lo", "hi")]
    counts = rows.groupBy(*keys, F.when(inside, F.col(x)).alias("__v")).agg(F.count("*").alias("__n"), *below, *ends, *extra)
    entry = F.when(F.col("__v").isNotNull(), F.struct(F.col("__v").alias("v"), F.col("__n").alias("n")))
    group = counts.groupBy(*keys).agg(
        F.sum("__n").alias("__n"), *[F.sum(f"__b{j}").alias(f"__b{j}") for j in some], *[F.min(f"{n}{j}").alias(f"{n}{j}") for j in some for n in ("lo", "hi")], F.array_sort(F.collect_list(entry)).alias("__c"), *merged
    )

    def at(j: int) -> Column:
        place = _place(F.col("__n"), shares[j])
        below_, above = F.floor(place), F.ceil(place)
        start = F.struct(F.col(f"__b{j}").cast("long").alias("seen"), F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))

        def step(s: Column, e: Column) -> Column:
            seen, v = s["seen"] + e["n"], e["v"].cast("double")
            first = lambda name, p: F.when(s[name].isNull() & (seen > p), v).otherwise(s[name]).alias(name)
            return F.struct(seen.alias("seen"), first("a", below_), first("b", above))

        mine = F.filter("__c", lambda e: (e["v"] >= F.col(f"lo{j}")) & (e["v"] <= F.col(f"hi{j}")))
        missed = F.raise_error(F.lit("the range of a quantile missed it")).cast("double")
        # a range begins at or before its place and ends behind it, else the sketch broke its word
        value = lambda r: F.when(r["b"].isNull() | (F.col(f"__b{j}") > below_), missed).when(r["a"] == r["b"], r["a"]).otherwise((above - place) * r["a"] + (place - below_) * r["b"])
        return F.aggregate(mine, start, step, value)

    return group.withColumn("q", F.array(*[at(j) for j in some]))


def quantiles(df: DataFrame, keys: list[str], x: str, shares: list[float], accuracy: int = ACCURACY, rounds: int = 1) -> DataFrame:
    """keys.., q: the exact, linearly interpolated quantiles of each group's values that are not null.

    Two passes: a sketch that merges before the shuffle gives each quantile a range (:func:`ranges`), then values outside the
    ranges are counted and those inside kept with their numbers.  Of n values of a group 4 to 16 n / accuracy different ones
    (or a few, where n is small) for each quantile meet in a row; each of the `rounds` beyond the first is a pass more and leaves 3 / STEPS of them.
    """
    return _counted(df, keys, x, shares, accuracy, rounds).select(*keys, "q")


def with_quantiles(df: DataFrame, keys: list[str], x: str, shares: list[float], rounds: int = 1) -> DataFrame:
    """Add q, the quantiles of x in each row's group; rows of groups without a value go."""
    return joined_back(df, quantiles(df, keys, x, shares, rounds=rounds), keys)


def trimmed(df: DataFrame, keys: list[str], x: str = "v", q: float = 0.05, upper: float | None = None, approximate: int | None = None, rounds: int = 1) -> DataFrame:
    """keys.., n, mean, std of the values within the [q, upper] quantiles, bounds inclusive (std: population).

    `upper` is 1 - q by default; q = 0 with an upper bound is the one-sided form for positive data.  Quantiles
    are exact, by ranges (:func:`quantiles`); the same second pass aggregates what lies between the two ranges, to
    which the values inside them are added that are within the quantiles.  `approximate` (an accuracy) takes
    the quantiles of Spark's sketch instead.
    """
    upper = 1 - q if upper is None else upper
    if approximate:
        limits = df.groupBy(*keys).agg(F.percentile_approx(x, [q, upper], approximate).alias("__b"))
        rows = joined_back(df, limits, keys).filter((F.col(x) >= F.col("__b")[0]) & (F.col(x) <= F.col("__b")[1]))
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    sure = F.when((F.col(x) > F.col("hi0")) & (F.col(x) < F.col("lo1")), F.col(x))
    extra = [F.count(sure).alias("__s"), F.avg(sure).alias("__m"), F.var_pop(sure).alias("__q")]
    rest = F.when(F.col("__v").isNull(), F.struct("__s", "__m", "__q"))  # one row of a group at most
    found = _counted(df, keys, x, [q, upper], ACCURACY, rounds, extra, [F.max(rest).alias("__r")])
    found = found.withColumn("__c", F.filter("__c", lambda e: e["v"].cast("double").between(F.col("q")[0], F.col("q")[1])))
    zero = lambda c: F.coalesce(F.col(f"__r.{c}"), F.lit(0.0))
    total = lambda f: F.aggregate("__c", F.lit(0.0), lambda s, e: s + e["n"] * f(e["v"]))
    n = (F.coalesce(F.col("__r.__s"), F.lit(0)) + F.aggregate("__c", F.lit(0).cast("long"), lambda s, e: s + e["n"])).alias("n")
    # deviations from the mean of what is sure, or from any value: sums of large squares never meet
    mid = F.coalesce(F.col("__r.__m"), F.get("__c", F.lit(0))["v"].cast("double"))
    found = found.select(*keys, n, mid.alias("__mid"), "__c", "__r").withColumn("__d", F.try_divide(total(lambda v: v - F.col("__mid")), "n"))
    square = F.try_divide(zero("__s") * zero("__q") + total(lambda v: (v - F.col("__mid")) * (v - F.col("__mid"))), "n")
    return found.filter("n > 0").select(*keys, "n", (F.col("__mid") + F.col("__d")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - F.col("__d") * F.col("__d"))).alias("std"))


def rescaled(df: DataFrame, stats: DataFrame, keys: list[str], x: str = "v") -> DataFrame:
    """(x - mean) / std of the row's group; a std of 0 or an absent group is an error."""
    zero = F.raise_error(F.lit("no spread in the baseline")).cast("double")
    return df.join(stats.select(*keys, "mean", "std"), keys).withColumn(x, F.when(F.col("std") > 0, (F.col(x) - F.col("mean")) / F.col("std")).otherwise(zero)).drop("mean", "std")


def with_stats(df: DataFrame, keys: list[str], **stats: Column) -> DataFrame:
    """Add statistics of each row's group: aggregated first and joined back, so that a group of any size is never one
    task's window."""
    return joined_back(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys)


def zscored(df: DataFrame, keys: list[str], x: str = "v", least: float = 1e-19) -> DataFrame:
    """Z-score over the whole series; series without spread stay as they are."""
    rows = with_stats(df, keys, __mean=F.avg(x), __std=F.stddev_pop(x))
    return rows.withColumn(x, F.when(F.col("__std") < least, F.col(x)).otherwise((F.col(x) - F.col("__mean")) / F.col("__std"))).drop("__mean", "__std")


def grouping_sets(df: DataFrame, sets: list[tuple[str, ...]], aggregates: list[Column]) -> DataFrame:
    """Statistics for several groupings in one pass: SQL GROUPING SETS."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*aggregates)


def histogram(df: DataFrame, keys: list[str], x: str, low: float, high: float, bins: int) -> DataFrame:
    """keys.., bucket (0 below, bins + 1 above), n."""
    return df.groupBy(*keys, F.width_bucket(F.col(x), F.lit(low), F.lit(high), F.lit(bins)).alias("bucket")).agg(F.count("*").alias("n"))


def matched(df: DataFrame, reference: str, q: float = 0.05) -> DataFrame:
    """Shift and scale every channel so that its trimmed mean and std are those of the reference recording."""
    s = trimmed(df, ["rec", "ch"], "v", q)
    ref = s.join(s.agg(F.min("rec").alias("rec")), "rec") if reference == "first" else s.filter(F.col("rec") == reference)
    ref = ref.select("ch", F.col("mean").alias("m0"), F.col("std").alias("s0"))
    rows = df.join(s, ["rec", "ch"]).join(ref, "ch")
    return rows.select("rec", "ch", "bin", F.when(F.col("std") > 0, (F.col("v") - F.col("mean")) / F.col("std") * F.col("s0") + F.col("m0")).otherwise(F.col("m0")).alias("v"))


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: eight steps up, then Stirling's series."""
    up = x + 8
    steps = reduce(lambda a, b: a * b, [x + k for k in range(8)])
    series = 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - 1 / (1680 * up**7) + 1 / (1188 * up**9)
    return (up - 0.5) * F.log(up) - up + 0.5 * F.log(F.lit(2 * math.pi)) + series - F.log(steps)


def incomplete_beta(x: Column, rest: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for 0 <= x <= 1 and rest = 1 - x (given apart, as the difference may cancel), as
    an expression: the continued fraction, in the half in which it converges fast, with as many terms as the
    parameters ask for.

    A value that is used more than once is bound to a name first: repeated expressions are computed at each place, in every term.
    """
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    tiny = 1e-300
    some = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def half(v: Column) -> Column:
        """The arguments in the order in which the fraction converges."""
        lower = v["x"] < (v["a"] + 1) / (v["a"] + v["b"] + 2)
        there = F.struct(lower.alias("lower"), v["x"].alias("y"), v["rest"].alias("z"), v["a"].alias("p"), v["b"].alias("q"))
        back = F.struct(lower.alias("lower"), v["rest"].alias("y"), v["x"].alias("z"), v["b"].alias("p"), v["a"].alias("q"))
        return F.when(lower, there).otherwise(back)

    def whole(v: Column) -> Column:
        y, p, q = v["y"], v["p"], v["q"]
        start = F.struct(F.lit(1.0).alias("c"), (1 / some(1 - (p + q) * y / (p + 1))).alias("d"), (1 / some(1 - (p + q) * y / (p + 1))).alias("h"))

        def step(s: Column, k: Column) -> Column:
            """One coefficient of the fraction: k = 2 m for the even, 2 m + 1 for the odd ones."""
            m = F.floor(k / 2).cast("double")
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            next_ = lambda e: F.struct(some(1 + e / s["c"]).alias("c"), (1 / some(1 + e * s["d"])).alias("d"))
            found = let(F.when(k % 2 == 0, even).otherwise(odd), next_)
            return let(found, lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["d"] * n["c"]).alias("h")))

        terms = F.sequence(F.lit(2), 2 * (30 + 3 * F.sqrt(F.greatest(p, q))).cast("int") + 1)
        front = F.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * F.log(y) + q * F.when(y < 0.5, F.log1p(-y)).otherwise(F.log(v["z"]))) / p
        value = F.when(y <= 0, F.lit(0.0)).otherwise(front * F.aggregate(terms, start, step, lambda s: s["h"]))
        return let(value, lambda r: F.when(v["lower"], r).otherwise(1 - r))

    given = F.struct(x.alias("x"), rest.alias("rest"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    return let(let(given, half), whole)


def t_test(df: DataFrame, group: Column, a: object, b: object, x: str, keys: list[str]) -> DataFrame:
    """keys.., t, n, p: two-sample statistic with pooled variance, groups a and b, its rows, and its two-sided p value."""
    side = lambda v: F.when(group == F.lit(v), F.col(x))
    m = df.groupBy(*keys).agg(*[f(side(v)).alias(f"{n}{i}") for i, v in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / (F.col("n0") + F.col("n1") - 2)
    t = (F.col("m0") - F.col("m1")) / F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))
    free = (F.col("n") - 2).cast("double")
    found = m.filter("n0 > 1 and n1 > 1").select(*keys, t.alias("t"), (F.col("n0") + F.col("n1")).alias("n"))
    square = F.col("t") * F.col("t")
    return found.withColumn("p", incomplete_beta(free / (free + square), square / (free + square), free / 2, F.lit(0.5)))


def two_means(df: DataFrame, keys: list[str], x: str = "v", rounds: int = 8) -> DataFrame:
    """keys.., threshold: the middle between two cluster centres (Lloyd rounds from the extremes, one aggregation each)."""
    cut = df.groupBy(*keys).agg(((F.min(x) + F.max(x)) / 2).alias("threshold"))
    for _ in range(rounds):
        low, high = F.avg(F.when(F.col(x) <= F.col("threshold"), F.col(x))), F.avg(F.when(F.col(x) > F.col("threshold"), F.col(x)))
        cut = df.join(cut, keys).groupBy(*keys).agg(((low + F.coalesce(high, low)) / 2).alias("threshold"))
    return cut


def _histogram(df: DataFrame, state: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys.., i, n: equal bins from lo to hi of the group's values below its limit, the last one closed; a value is put by the
    bins' own edges."""
    rows = joined_back(df.filter(F.col(x).isNotNull()), state, keys).filter(F.col("limit").isNull() | (F.col(x) < F.col("limit")))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    edge = lambda i: F.when(i == F.col("bins"), F.col("hi")).otherwise(F.col("lo") + i * width)
    raw = F.least(F.col("bins") - 1, ((F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")).cast("long"))
    i = F.col("__i")
    placed = rows.withColumn("__i", raw).withColumn("__i", F.when(F.col(x) < edge(i), i - 1).when((F.col(x) >= edge(i + 1)) & (i < F.col("bins") - 1), i + 1).otherwise(i))
    return placed.groupBy(*keys, F.col("__i").alias("i")).agg(F.count("*").alias("n"))


def effective_range(df: DataFrame, keys: list[str], x: str, bins: int = 200, rare: float = 0.01, take: int = 20) -> DataFrame:
    """keys.., low, high: the range of non-negative values without their rare tail.

    While the first bin of a group's histogram holds more than 1 - rare of it, what lies at or above bin `take` goes and the rest gets
    twice as many bins (10 values a bin on average at least; a group too small for that at the start has a tenth of its size as bins and goes on).
    high is the lower edge of the first bin with which more than 1 - rare are reached.  Groups of fewer than ten values have nulls.
    One aggregation a round for all groups that are not done; their states are written down, a row a group.
    """
    from pyspark.sql import Window as W

    from ..sources.tables import scratch

    spark = df.sparkSession
    # bounds of the values that are left, as the bins are made; equal values get a bin range of 1 around them
    some = df.filter(F.col(x).isNotNull())
    wide = lambda name, sign: F.when(F.col("a") == F.col("z"), F.col(name) + sign * 0.5).otherwise(F.col(name))
    ends = lambda rows, by: rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(x).cast("double").alias("a"), F.max(x).cast("double").alias("z"))
    small = F.floor(F.col("n") / 10)
    state = ends(some, keys).select(*keys, "n", wide("a", -1).alias("lo"), wide("z", 1).alias("hi"), F.least(F.lit(bins), small).cast("long").alias("bins"), (F.col("n") / 10 < bins).alias("short"), F.lit(None).cast("double").alias("limit"))
    none = state.filter("bins = 0").select(*keys, F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    state, out = state.filter("bins > 0"), none
    while True:
        at = scratch(spark, "ranges-state")
        state.write.parquet(at)
        state = spark.read.schema(state.schema).parquet(at)
        if state.isEmpty():
            return out
        counts = joined_back(_histogram(some, state, keys, x), state.drop("limit").withColumnRenamed("n", "__all"), keys)
        # at most `bins` rows a group
        upto = F.sum("n").over(W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(W.partitionBy(*keys))
        reached = counts.withColumn("__s", upto)
        edge = lambda i: F.col("lo") + i * ((F.col("hi") - F.col("lo")) / F.col("bins"))
        first = reached.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("i") == 0, F.col("__s"))), F.lit(0.0)).alias("__first"), F.min(F.when(F.col("__s") > 1 - rare, F.col("i"))).alias("__at"))
        seen = joined_back(state, first, keys)
        again = (F.col("__first") > 1 - rare) & (F.col("short") | (2 * F.col("bins") <= F.col("n") / 10))
        path = scratch(spark, "ranges-seen")
        seen.withColumn("again", again).write.parquet(path)
        seen = spark.read.parquet(path)
        out = out.unionByName(seen.filter("not again").select(*keys, F.col("lo").alias("low"), edge(F.col("__at")).alias("high")))
        cut = seen.filter("again").select(*keys, (2 * F.col("bins")).alias("bins"), "short", edge(F.least(F.lit(take).cast("long"), F.col("bins"))).alias("limit"))
        left = joined_back(some, cut, keys).filter(F.col(x) < F.col("limit"))
        bounds = ends(left, [*keys]).select(*keys, "n", wide("a", -1).alias("lo"), wide("z", 1).alias("hi"))
        state = joined_back(bounds, cut, keys).select(state.columns)


def without_rare(df: DataFrame, keys: list[str], over: str, x: str, bins: int = 200, rare: float = 0.01, take: int = 20) -> DataFrame:
    """The rows of those keys (a time bin, say) at which the value of every `over` (a frequency) is within its effective range."""
    high = effective_range(df, [over], x, bins, rare, take)
    rows = joined_back(df, high.drop("low"), [over])
    bad = rows.filter(F.col(x) > F.col("high")).select(*keys).distinct()
    return df.join(bad, keys, "left_anti")


def peak_clusters(df: DataFrame, keys: list[str], x: str, splits: int = 25, offset: float = 0.3, margin: float = 0.1, kind: str = "outmost") -> DataFrame:
    """keys.., low, high, n_peaks: two centres from a group's histogram of `splits` equal bins.

    Peaks are bins with more values than both neighbours.  The outmost two (or the two highest, of equal ones the later) give
    their lower edges, moved apart by `offset` of their distance; outmost ones stay a `margin` of it within the extremes,
    highest ones within the extremes.  With fewer than two peaks the centres lie `margin` of the span inside the extremes.
    """
    from pyspark.sql import Window as W

    some = df.filter(F.col(x).isNotNull())
    ends = some.groupBy(*keys).agg(F.min(x).cast("double").alias("__a"), F.max(x).cast("double").alias("__z"))
    wide = lambda name, sign: F.when(F.col("__a") == F.col("__z"), F.col(name) + sign * 0.5).otherwise(F.col(name))
    state = ends.select(*keys, wide("__a", -1).alias("lo"), wide("__z", 1).alias("hi"), F.lit(splits).cast("long").alias("bins"), F.lit(None).cast("double").alias("limit"))
    order = W.partitionBy(*keys).orderBy("i")  # at most `splits` rows a group
    near = lambda f, step: F.when(f("i").over(order) == F.col("i") + step, f("n").over(order)).otherwise(F.lit(0))
    counts = _histogram(some, state, keys, x)
    peaks = counts.withColumns({"__l": F.coalesce(near(F.lag, -1), F.lit(0)), "__r": F.coalesce(near(F.lead, 1), F.lit(0))}).filter("n > __l AND n > __r")
    if kind == "highest":
        top = W.partitionBy(*keys).orderBy(F.desc("n"), F.desc("i"))
        ranked = peaks.withColumn("__k", F.row_number().over(top))
        found = ranked.groupBy(*keys).agg(F.min(F.when(F.col("__k") <= 2, F.col("i"))).alias("__i"), F.max(F.when(F.col("__k") <= 2, F.col("i"))).alias("__j"), F.count("*").alias("n_peaks"))
    else:
        found = peaks.groupBy(*keys).agg(F.min("i").alias("__i"), F.max("i").alias("__j"), F.count("*").alias("n_peaks"))
    own = [f"__q{i}" for i in range(len(keys))]
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)), F.lit(True))
    rows = joined_back(state, ends, keys).join(found.withColumnsRenamed(dict(zip(keys, own, strict=True))), same, "left").drop(*own)
    edge = lambda c: F.col("lo") + F.col(c) * ((F.col("hi") - F.col("lo")) / F.col("bins"))
    apart = edge("__j") - edge("__i")
    inner = margin * apart if kind == "outmost" else F.lit(0.0)
    low, high = F.greatest(F.col("__a") + inner, edge("__i") - offset * apart), F.least(F.col("__z") - inner, edge("__j") + offset * apart)
    span, two = F.col("__z") - F.col("__a"), F.coalesce(F.col("n_peaks"), F.lit(0)) >= 2
    return rows.select(*keys, F.when(two, low).otherwise(F.col("__a") + margin * span).alias("low"), F.when(two, high).otherwise(F.col("__z") - margin * span).alias("high"), F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"))
