"""Metrics from predictions and tables over result cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(pred: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys.., y, yhat, n."""
    return pred.groupBy(*(keys or []), "y", "yhat").agg(F.count("*").alias("n"))


def normalised(conf: DataFrame, by: str = "row", keys: list[str] | None = None) -> DataFrame:
    """Add share: of the true class (by='row') or of everything."""
    over = W.partitionBy(*(keys or []), *(["y"] if by == "row" else []))
    return conf.withColumn("share", F.col("n") / F.sum("n").over(over))


def per_class(conf: DataFrame) -> DataFrame:
    """y, tp, fn, fp, tn, sens, spec, prec, f1 of each class against the rest, from a confusion table."""
    total = conf.agg(F.sum("n").alias("total"))
    rows = conf.groupBy("y").agg(F.sum("n").alias("pos"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).alias("tp"))
    cols = conf.groupBy(F.col("yhat").alias("y")).agg(F.sum("n").alias("named"))
    m = rows.join(cols, "y", "left").join(F.broadcast(total)).withColumn("named", F.coalesce("named", F.lit(0)))  # the total is one row
    m = m.select("y", "tp", (F.col("pos") - F.col("tp")).alias("fn"), (F.col("named") - F.col("tp")).alias("fp"), (F.col("total") - F.col("pos") - F.col("named") + F.col("tp")).alias("tn"))
    ratio = lambda a, b: F.try_divide(a, b)
    return m.select(
        "*",
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("sens"),
        ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("spec"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("prec"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def balanced_accuracy(conf: DataFrame, keys: list[str] | None = None, adjusted: bool = False) -> DataFrame:
    """keys.., bacc: mean recall over the classes that occur; adjusted for chance if asked for."""
    keys = keys or []
    recall = conf.groupBy(*keys, "y").agg((F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)) / F.sum("n")).alias("r"))
    out = recall.groupBy(*keys).agg(F.avg("r").alias("bacc"), F.count("*").alias("k"))
    value = F.try_divide(F.col("bacc") - 1 / F.col("k"), 1 - 1 / F.col("k")) if adjusted else F.col("bacc")
    return out.select(*keys, value.alias("bacc"))


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in `order`; aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(*keys, "__x.*")


def gains(df: DataFrame, keys: list[str], name: str, base: object, metric: str) -> DataFrame:
    """Add base and gain (in percent) against the row `base` of the same keys; keys without one go."""
    ref = df.filter(F.col(name) == F.lit(base)).select(*keys, F.col(metric).alias("base"))
    return df.join(ref, keys).withColumn("gain", 100 * (F.col(metric) - F.col("base")) / F.col("base"))


def missing(df: DataFrame, keys: list[str], over: str) -> DataFrame:
    """Combinations of present key tuples with present values of `over` that have no row (both sides are small dimensions)."""
    grid = df.select(*keys).distinct().join(df.select(over).distinct())
    return grid.join(df.select(*keys, over).distinct(), [*keys, over], "left_anti")


def formatted(x: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(100 * x, digits), F.lit("%"))


def confusion_report(conf: DataFrame, order: list, merged: dict | None = None, fold: str | None = None) -> DataFrame:
    """row, col, y, yhat, pct: confusion in per cent of the true class, in a given order of classes; `merged` renames classes (several to
    one) before; with `fold` every fold is normalised on its own and the mean over the folds that have the class is taken."""
    name = lambda c: F.coalesce(F.create_map(*[F.lit(v) for kv in merged.items() for v in kv])[F.col(c)], F.col(c)) if merged else F.col(c)
    keys = [fold] if fold else []
    n = conf.groupBy(*keys, name("y").alias("y"), name("yhat").alias("yhat")).agg(F.sum("n").alias("n"))
    rows = n.groupBy(*keys, "y").agg(F.sum("n").alias("__t"))
    names = F.array(*map(F.lit, order))
    # every pair of classes has a cell: as many rows as pairs
    cells = rows.select(*keys, "y", "__t", F.explode(names).alias("yhat")).join(n, [*keys, "y", "yhat"], "left")
    out = cells.groupBy("y", "yhat").agg((100 * F.avg(F.coalesce("n", F.lit(0)) / F.col("__t"))).alias("pct"))
    place = lambda c: F.array_position(names, F.col(c)).cast("int")
    return out.select(place("y").alias("row"), place("yhat").alias("col"), "y", "yhat", "pct").filter("row > 0")


def detection_rate(report: DataFrame, name: object) -> DataFrame:
    """pct: how much of one class is found."""
    return report.filter((F.col("y") == F.lit(name)) & (F.col("yhat") == F.lit(name))).select("pct")


def chance_level(conf: DataFrame) -> DataFrame:
    """y, yhat, share: what guessing by the shares of the true classes names a row of any class; as many rows as pairs of classes."""
    n = conf.groupBy("y").agg(F.sum("n").alias("n"))
    share = n.select(F.col("y").alias("yhat"), (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))  # one row a class
    return n.select("y").crossJoin(F.broadcast(share))


def balanced_curve(curve: DataFrame, keys: list[str], n: str, level: float) -> DataFrame:
    """Add first: whether a point of a curve (keys.., n, sens, spec) is the first in order of n at which both sens and spec exceed the level."""
    good = F.when(F.least("sens", "spec") > level, F.col(n))
    return curve.withColumn("first", F.coalesce(F.col(n) == F.min(good).over(W.partitionBy(*keys)), F.lit(False)))  # a curve is a few rows
