"""Sliding windows over sampled series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import inside, union
from .stats import with_stats


#: Bins (or blocks) of a chunk: what one task's window holds of a series at most, besides the halo.
CHUNK = 65_536


def chunked(df: DataFrame, size: int, halo: int, at: str = "bin") -> DataFrame:
    """Add chunk and own: every row goes to its chunk of `size` bins and to the chunks whose halo holds it.

    A series of any length becomes groups of at most size + 2 * halo rows.
    """
    first = F.greatest(F.lit(0), F.floor((F.col(at) - halo) / size))
    cells = F.sequence(first.cast("long"), F.floor((F.col(at) + halo) / size).cast("long"))
    return df.withColumn("chunk", F.explode(cells)).withColumn("own", F.col("chunk") == F.floor(F.col(at) / size))


def numbered(df: DataFrame, keys: list[str], name: str, chunk: int = CHUNK) -> DataFrame:
    """Add `name`: each row's place (from 0) in its series in bin order; chunks are numbered apart and shifted by the sizes of those before."""
    rows = df.withColumn("__c", F.floor(F.col("bin") / chunk))
    order = W.partitionBy(*keys).orderBy("__c")  # one row a chunk
    sizes = rows.groupBy(*keys, "__c").agg(F.count("*").alias("__n"))
    sizes = sizes.select(*keys, "__c", F.coalesce(F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy(*keys, "__c").orderBy("bin")) - 1
    return rows.withColumn("__i", inside).join(sizes, [*keys, "__c"]).withColumn(name, (F.col("__before") + F.col("__i")).cast("long")).drop("__c", "__i", "__before")


def moments(df: DataFrame, keys: list[str], columns: list[str], window: int, skip: int) -> DataFrame:
    """keys.., widx, n, mean_c, m2_c for full windows of `window` bins every `skip` bins (which must divide it).

    Two levels: each block of `skip` bins is aggregated once, then window/skip neighbouring blocks are
    put together (in chunks of blocks), so that no sample is copied into the windows that share it.  Blocks keep
    their mean and squared deviations, and means are taken relative to the chunk's mean: sums of large squares never meet.
    """
    assert window % skip == 0
    blocks = df.groupBy(*keys, F.floor(F.col("bin") / skip).alias("blk"))
    made = blocks.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"a_{c}") for c in columns], *[F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias(f"q_{c}") for c in columns])
    made = chunked(made, CHUNK, window // skip, "blk")
    series = W.partitionBy(*keys, "chunk")
    frame = series.orderBy("blk").rowsBetween(0, window // skip - 1)
    made = made.withColumns({f"r_{c}": F.sum(F.col("n") * F.col(f"a_{c}")).over(series) / F.sum("n").over(series) for c in columns})
    n, d = F.col("n"), {c: F.col(f"a_{c}") - F.col(f"r_{c}") for c in columns}
    sums = {"t": F.sum("n").over(frame)} | {f"s_{c}": F.sum(n * d[c]).over(frame) for c in columns} | {f"p_{c}": F.sum(F.col(f"q_{c}") + n * d[c] * d[c]).over(frame) for c in columns}
    full = made.withColumns(sums).filter(F.col("own") & (F.col("t") == window))
    means = [(F.col(f"r_{c}") + F.col(f"s_{c}") / window).alias(f"mean_{c}") for c in columns]
    spread = [F.greatest(F.lit(0.0), F.col(f"p_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}") / window).alias(f"m2_{c}") for c in columns]
    return full.select(*keys, F.col("blk").alias("widx"), F.col("t").alias("n"), *means, *spread)


def differences(df: DataFrame, keys: list[str], dt: float) -> DataFrame:
    """Add dv and ddv: first and second difference in bin order over dt, the first ones 0."""
    order = W.partitionBy(*keys, "chunk").orderBy("bin")
    step = lambda c: F.coalesce((F.col(c) - F.lag(c).over(order)) / dt, F.lit(0.0))
    return chunked(df, CHUNK, 2).withColumn("dv", step("v")).withColumn("ddv", step("dv")).filter("own").drop("chunk", "own")


def hjorth(df: DataFrame, keys: list[str], window: int, skip: int, dt: float = 1.0, floor: float = 1e-14) -> DataFrame:
    """keys.., widx, activity, mobility, complexity of each full window (sample variances; 0 below the floor)."""
    m = moments(differences(df, keys, dt), keys, ["v", "dv", "ddv"], window, skip)
    var = lambda c: F.col(f"m2_{c}") / (window - 1)
    ratio = lambda a, b: F.when((a > floor) & (b > floor), F.sqrt(a / b)).otherwise(F.lit(0.0))
    mobility, second = ratio(var("dv"), var("v")), ratio(var("ddv"), var("dv"))
    return m.select(*keys, "widx", var("v").alias("activity"), mobility.alias("mobility"), F.when(mobility > floor, second / mobility).otherwise(F.lit(0.0)).alias("complexity"))


def sums(df: DataFrame, keys: list[str], value: Column, window: int, skip: int) -> DataFrame:
    """keys.., widx, total of `value` over full windows, by blocks as in :func:`moments`."""
    made = df.groupBy(*keys, F.floor(F.col("bin") / skip).alias("blk")).agg(F.sum(value).alias("t"), F.count("*").alias("n"))
    frame = W.partitionBy(*keys, "chunk").orderBy("blk").rowsBetween(0, window // skip - 1)
    made = chunked(made, CHUNK, window // skip, "blk")
    out = made.select(*keys, F.col("blk").alias("widx"), "own", F.sum("t").over(frame).alias("total"), F.sum("n").over(frame).alias("n"))
    return out.filter(F.col("own") & (F.col("n") == window)).drop("n", "own")


def paired(df: DataFrame, a: str, b: str, lag: int = 0) -> DataFrame:
    """rec, bin, va, vb: two channels side by side, the second `lag` bins later."""
    left = df.filter(F.col("ch") == a).select("rec", "bin", F.col("v").alias("va"))
    right = df.filter(F.col("ch") == b).select("rec", (F.col("bin") - lag).alias("bin"), F.col("v").alias("vb"))
    return left.join(right, ["rec", "bin"])


def covariance(df: DataFrame, a: str, b: str, means: DataFrame, window: int, skip: int) -> DataFrame:
    """rec, widx, cov: windowed mean of (a - mean a)(b - mean b) around given baseline means (rec, ch, mean)."""
    base = lambda c, name: means.filter(F.col("ch") == c).select("rec", F.col("mean").alias(name))
    rows = paired(df, a, b).join(base(a, "ma"), "rec").join(base(b, "mb"), "rec")
    product = (F.col("va") - F.col("ma")) * (F.col("vb") - F.col("mb"))
    return sums(rows, ["rec"], product, window, skip).select("rec", "widx", (F.col("total") / window).alias("cov"))


def decimated(df: DataFrame, keys: list[str], skip: int) -> DataFrame:
    """keys.., bin, v: means of blocks; the last block has what is left."""
    return df.groupBy(*keys, F.floor(F.col("bin") / skip).alias("bin")).agg(F.avg("v").alias("v"))


def box_sum(df: DataFrame, keys: list[str], value: Column, width: int, chunk: int = CHUNK) -> DataFrame:
    """Add total: the centred sum over `width` bins, in chunks with the bins around them."""
    half = width // 2
    frame = W.partitionBy(*keys, "chunk").orderBy("bin").rowsBetween(-half, width - 1 - half)
    rows = chunked(df.withColumn("__x", value), chunk, width).withColumn("total", F.sum("__x").over(frame))
    return rows.filter("own").drop("__x", "chunk", "own")


def masked(df: DataFrame, bad: DataFrame, on: list[str]) -> DataFrame:
    """v becomes null at the (on..) rows of `bad`."""
    marks = bad.select(*on).distinct().withColumn("__bad", F.lit(True))
    return df.join(marks, on, "left").withColumn("v", F.when(F.col("__bad").isNull(), F.col("v"))).drop("__bad")


def masked_inside(df: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """v becomes null at the bins inside the intervals [b0, b1) of `bad`, which may overlap; none of them is exploded into bins."""
    one = union(bad.filter("b1 > b0").select(*keys, F.col("b0").alias("s"), F.col("b1").alias("e")), keys)  # a bin is in one at most
    marks = one.select(*keys, F.col("s").alias("b0"), F.col("e").alias("b1"), F.lit(True).alias("__bad"))
    return inside(df, marks, tuple(keys), "left").withColumn("v", F.when(F.col("__bad").isNull(), F.col("v"))).select(df.columns)


def interpolated(df: DataFrame, keys: list[str], chunk: int = 65_536) -> DataFrame:
    """Fill null v linearly in time; gaps at the begin become 0, gaps at the end keep the last value.

    Series are cut into chunks of bins.  Within a chunk a window finds the values around a gap; for gaps that
    cross its ends, the values before and after come from one row for each chunk, so that a long series is
    never one task's group.
    """
    known = F.when(F.col("v").isNotNull(), F.struct("bin", "v"))
    rows = df.withColumn("__c", F.floor(F.col("bin") / chunk))
    over = W.partitionBy(*keys).orderBy("__c")
    ends = rows.groupBy(*keys, "__c").agg(F.min(known).alias("__first"), F.max(known).alias("__last"))
    before = F.last("__last", True).over(over.rowsBetween(W.unboundedPreceding, -1)).alias("__before")
    after = F.first("__first", True).over(over.rowsBetween(1, W.unboundedFollowing)).alias("__after")
    ends = ends.select(*keys, "__c", before, after)
    forth = W.partitionBy(*keys, "__c").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__p", F.last(known, True).over(forth))
    # from the other end: a frame that reaches to the end of its group is walked anew for each row
    back = W.partitionBy(*keys, "__c").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__n", F.last(known, True).over(back)).join(ends, [*keys, "__c"])
    rows = rows.withColumns({"__p": F.coalesce("__p", "__before"), "__n": F.coalesce("__n", "__after")})
    between = F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * (F.col("bin") - F.col("__p.bin")) / (F.col("__n.bin") - F.col("__p.bin"))
    v = F.when(F.col("v").isNotNull(), F.col("v")).when(F.col("__p").isNull(), F.lit(0.0)).when(F.col("__n").isNull(), F.col("__p.v")).otherwise(between)
    return rows.withColumn("v", v).select(df.columns)


def wiener(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Local mean plus the part of the deviation that exceeds the noise (the mean of the local variances)."""
    half = width // 2
    frame = W.partitionBy(*keys, "chunk").orderBy("bin").rowsBetween(-half, width - 1 - half)
    rows = chunked(df, CHUNK, width).withColumn("__m", F.avg("v").over(frame)).withColumn("__q", F.var_pop("v").over(frame)).filter("own").drop("chunk", "own")
    rows = with_stats(rows, keys, __noise=F.avg("__q"))
    gain = F.when(F.col("__q") > F.col("__noise"), (F.col("__q") - F.col("__noise")) / F.col("__q")).otherwise(F.lit(0.0))
    return rows.withColumn("v", F.col("__m") + gain * (F.col("v") - F.col("__m"))).drop("__m", "__q", "__noise")


def fir(df: DataFrame, keys: list[str], taps: list[float]) -> DataFrame:
    """v filtered by a centred finite impulse response; samples beyond the ends count as 0."""
    order, half = W.partitionBy(*keys, "chunk").orderBy("bin"), len(taps) // 2
    terms = [F.lit(t) * F.coalesce(F.lag("v", k - half).over(order), F.lit(0.0)) for k, t in enumerate(taps)]
    return chunked(df, CHUNK, len(taps)).withColumn("v", reduce(lambda a, b: a + b, terms)).filter("own").drop("chunk", "own")


def autocorrelation(df: DataFrame, keys: list[str], lags: list[int], x: str = "v") -> DataFrame:
    """keys.., lag, r: the sum of products of deviations from the series' mean at a distance of `lag` bins over the sum of their squares.

    A bin meets those behind it by an equi-join on the bin; sums are taken before anything moves further.
    """
    rows = with_stats(df, keys, __m=F.avg(x)).select(*keys, "bin", (F.col(x) - F.col("__m")).alias("__d"))
    power = rows.groupBy(*keys).agg(F.sum(F.col("__d") * F.col("__d")).alias("__p"))
    later = rows.select(*keys, F.col("bin").alias("__at"), F.col("__d").alias("__e"))
    left = rows.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("__at", F.col("bin") + F.col("lag"))
    sums = left.join(later, [*keys, "__at"]).groupBy(*keys, "lag").agg(F.sum(F.col("__d") * F.col("__e")).alias("__s"))
    return sums.join(power, keys).select(*keys, "lag", F.try_divide("__s", "__p").alias("r"))


def main_component(df: DataFrame, a: str, b: str) -> DataFrame:
    """rec, bin, v: two channels projected on the first principal axis of their deviations, which points to where the first channel grows."""
    both = paired(df, a, b)
    angle = F.atan2(2 * F.covar_samp("va", "vb"), F.var_samp("va") - F.var_samp("vb")) / 2
    rows = with_stats(both, ["rec"], __t=angle, __a=F.avg("va"), __b=F.avg("vb"))
    return rows.select("rec", "bin", ((F.col("va") - F.col("__a")) * F.cos("__t") + (F.col("vb") - F.col("__b")) * F.sin("__t")).alias("v"))
