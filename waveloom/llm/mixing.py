"""Mix sources to target weights with DataFrame operations only.

The words of each source form a stream cut into blocks of fixed length.  Every output shard of many slots
draws by a multinomial draw how many of its slots each source gets; what a source draws beyond the number
of slots that its target asks for goes to the sources that are still short, so that all targets are met to
a block.  The n-th slot of a source takes the block that a pseudorandom permutation of the source's blocks
names, and blocks are joined by index.  A source's blocks are all used once before any is used again, and
never more than `cap` times.

Defined results: a null or empty text has size 0 and nothing taken; a null source is a source of its
own and comes last; repeated rows are rows of their own; all choices come from hashes, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: Words of a block; slots of an output shard; parts in which a running sum of one source is made.
BLOCK, SLOTS, SPREAD = 64, 1024, 1024
#: Cells of the unit interval by which draws and slots find their source.
CELLS = 1024


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """src (rank by code point, null last), source, source_size, weight, target for each source.

    Targets are proportional to the weights up to a level at which they sum to `share` of all words;
    a source whose cap lies below its part of that level stops there.  One row per source: small.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("src", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("src"), F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
    by_level = W.orderBy(F.col("most") / F.col("weight"), "src")
    all_rows = W.partitionBy()
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    wanted = F.lit(share) * F.sum("source_size").over(all_rows)
    levelled = ranked.withColumn("level", (wanted - before) / rest)
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))
    level = F.coalesce(F.max(fits).over(all_rows), F.max(F.col("most") / F.col("weight")).over(all_rows))
    return levelled.select("src", "source", "source_size", "weight", F.least("most", level * F.col("weight")).alias("target"))


def running(df: DataFrame, group: str, value: str, order: list[str], name: str, spread: int = SPREAD) -> DataFrame:
    """Add `name`: the sum of `value` over the rows of the group that come before, in order of a hash part and then `order`.

    Parts of a group are summed first and the parts' totals run over; a group of any size thus never
    stands in one task.
    """
    part = df.withColumn("__part", F.pmod(F.xxhash64(F.col(order[0])), F.lit(spread)).cast("int"))
    ahead = (
        part.groupBy(group, "__part")
        .agg(F.sum(value).alias("__sum"))
        .withColumn("__ahead", F.coalesce(F.sum("__sum").over(W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select(group, "__part", "__ahead")
    )
    inside = F.sum(value).over(W.partitionBy(group, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    rows = part.withColumn("__inside", F.coalesce(inside, F.lit(0)))
    return rows.join(ahead, [group, "__part"]).withColumn(name, F.col("__ahead") + F.col("__inside")).drop("__part", "__ahead", "__inside")


def permuted(x: str, n: str, key: str) -> Column:
    """A pseudorandom permutation of 0..n-1: eight half rounds of a Feistel network over a grid of about
    n cells, walked on where it leaves the range.

    Less than sqrt(n) cells lie outside, so for small n the walk ends for certain, and for large n the chance
    that it does not is below 10^-20; the query would fail then rather than lose a slot."""
    a, b = f"CAST(ceil(sqrt({n})) AS BIGINT)", f"CAST(ceil({n} / ceil(sqrt({n}))) AS BIGINT)"
    rounds = f"""aggregate(sequence(1, 8), named_struct('l', y div {b}, 'r', y % {b}), (s, i) -> named_struct(
        'l', if(i % 2 = 1, pmod(s.l + pmod(xxhash64(s.r, {key}, i), {a}), {a}), s.l),
        'r', if(i % 2 = 0, pmod(s.r + pmod(xxhash64(s.l, {key}, i), {b}), {b}), s.r)), s -> s.l * {b} + s.r)"""
    ended = f"y -> if(y < {n}, y, CAST(raise_error('the walk of a permutation has no end') AS BIGINT))"
    return F.expr(f"CASE WHEN {n} > 0 THEN aggregate(sequence(0, 19), {x}, (y, j) -> if(j = 0 or y >= {n}, {rounds}, y), {ended}) END")


def _uniform(*of: str | Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _placed(points: DataFrame, point: str, ranges: DataFrame, scale: float) -> DataFrame:
    """Join each point with the range [lo, hi) that holds it; equal cells of the scale make it an equi-join."""
    cell = lambda c: F.floor(c / F.lit(scale) * CELLS).cast("long")
    cells = ranges.filter("hi > lo").withColumn("__cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    joined = points.withColumn("__cell", cell(F.col(point))).join(cells, "__cell")
    return joined.filter((F.col(point) >= F.col("lo")) & (F.col(point) < F.col("hi"))).drop("__cell")


def _parts(spark: SparkSession, n: int) -> int:
    """Partitions of at most a million numbers."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(n / 1_000_000))


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    """0..n-1."""
    return spark.range(0, n, 1, _parts(spark, n))


def drawn(spark: SparkSession, plan: DataFrame, total: int, per_shard: int = SLOTS, seed: int = 7) -> DataFrame:
    """shard, src, n: how many slots of each shard each source draws, all of them by chance in proportion to
    `slots` of `plan` (src, slots)."""
    in_order = W.orderBy("src").rowsBetween(W.unboundedPreceding, 0)
    ranges = plan.withColumn("hi", F.sum("slots").over(in_order)).withColumn("lo", F.col("hi") - F.col("slots")).select("src", "lo", "hi")
    draws = _numbers(spark, total).select(F.floor(F.col("id") / per_shard).alias("shard"), (_uniform(F.lit(seed), "id") * F.lit(float(total))).alias("u"))
    return _placed(draws, "u", ranges, float(max(total, 1))).groupBy("shard", "src").agg(F.count("*").alias("n"))


def slots(spark: SparkSession, sources: DataFrame, block: int = BLOCK, per_shard: int = SLOTS, seed: int = 7) -> DataFrame:
    """One row for each slot of the mix: shard, src, block.  `sources` is the stored result of targets()."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    wanted = F.when(F.col("source_size") > 0, F.round(blocks * F.col("target") / F.col("source_size"))).otherwise(0)
    plan = sources.select("src", blocks.alias("blocks"), wanted.cast("long").alias("slots"))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    counts = store(drawn(spark, plan, total, per_shard, seed), "mixing-draws")
    counts = running(counts, "src", "n", ["shard"], "before").join(plan, "src")
    # a source's draws in excess of its slots, in one row of numbers over all shards and sources
    fits = F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.col("before")))
    counts = store(counts.withColumn("fits", fits), "mixing-counts")
    excess = counts.filter("n > fits").select("shard", "src", (F.col("n") - F.col("fits")).alias("n"), F.lit(0).alias("all"))
    excess = running(excess, "all", "n", ["shard", "src"], "at")
    excess = excess.select("shard", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at"))
    # and the slots that other sources still need in another one
    got = counts.groupBy("src").agg(F.sum("fits").alias("got"))
    short = plan.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    short = short.withColumn("hi", F.sum(F.col("slots") - F.col("got")).over(W.orderBy("src").rowsBetween(W.unboundedPreceding, 0)))
    short = short.withColumn("lo", F.col("hi") - F.col("slots") + F.col("got"))
    open_ = short.agg(F.max("hi")).first()[0] or 0
    moved = _placed(excess, "at", short.select("src", "blocks", "got", "lo", "hi"), float(max(open_, 1)))
    moved = moved.select("shard", "src", "blocks", (F.col("got") + F.col("at") - F.col("lo")).alias("nth"))
    # a row stands for up to a shard of slots: few rows make many, so they are spread by the number of slots
    spread = counts.filter("fits > 0").repartition(_parts(spark, total), "shard", "src")
    own = spread.select("shard", "src", "blocks", F.explode(F.sequence("before", F.col("before") + F.col("fits") - 1)).alias("nth"))
    every = own.unionByName(moved)
    return every.withColumn("block", permuted("nth % blocks", "blocks", "src")).select("shard", "src", "block")


def spans(docs: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """What the mix takes of each row of (key.., source, size): src, source_size, target, begin (the row's
    place in its source's stream) and one row for each block it lies in, with `times` it is taken."""
    spark = docs.sparkSession
    sources = store(targets(docs), "mixing-sources")
    known = docs.join(sources.select("src", F.col("source").alias("__source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = running(known, "src", "size", [key[0], "size", *key[1:]], "begin")
    last = F.floor((F.col("begin") + F.col("size") - 1) / block)
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("begin") / block), last))))
    times = slots(spark, sources, block).groupBy("src", "block").agg(F.count("*").alias("times"))
    return pieces.join(times, ["src", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def _overlap(block: int = BLOCK) -> Column:
    ends = F.least((F.col("block") + 1) * block, F.col("begin") + F.col("size"))
    return F.coalesce(ends - F.greatest(F.col("block") * block, F.col("begin")), F.lit(0))


def measured(docs: DataFrame, key: list[str]) -> DataFrame:
    """key.., source, size of each row, stored, so that texts are read once."""
    return store(docs.select(*key, "source", n_words("text").alias("size")), "mixing-sizes")


def contract(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    pieces = spans(measured(docs, ["doc_id"]), ["doc_id"])
    rows = pieces.groupBy("doc_id", "src", "begin", "size", "source_size", "target").agg(F.sum(_overlap() * F.col("times")).alias("taken"), F.count("*").alias("n"))
    # rows without words share their place: each counts
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("size") > 0, 1).otherwise(F.col("n")).cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def apply(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents of the mix: each keeps the words that the mix takes, in order, a block taken twice
    standing twice, white space at the ends dropped; documents of which nothing is taken go.  Other columns
    stay; n_chars, if there, is counted anew."""
    # stored, so that a row keeps its number
    rows = store(docs.withColumn("__row", F.monotonically_increasing_id()), "mixing-rows")
    named = rows.select("doc_id", F.xxhash64("doc_id", text, "source").alias("__digest"), "__row", "source", F.col(text).alias("text"))
    pieces = spans(measured(named, ["doc_id", "__digest", "__row"]), ["doc_id", "__digest", "__row"])
    each = F.sort_array(F.collect_list(F.struct("block", F.col("times").cast("int").alias("times"))))
    taken = pieces.filter(F.col("block").isNotNull()).groupBy("__row", "begin").agg(each.alias("__blocks"), F.sum("times").alias("__any")).filter("__any > 0")
    taken = taken.select("__row", (F.col("begin") % BLOCK).cast("int").alias("__lead"), F.transform("__blocks", lambda b: b["times"]).alias("__times"))
    joined = rows.join(taken, "__row")
    # as many one-letter words in front as the text's first block has of other texts: then each match is a block
    space = r"[\x20\x09-\x0D]"
    aligned = F.concat(F.repeat(F.lit("x "), F.col("__lead")), F.regexp_replace(F.col(text), f"^{space}+", ""), F.lit("\n"))
    cut = F.regexp_extract_all(aligned, F.lit(rf"((?:{WORD}{space}*+){{1,{BLOCK}}}+)"), F.lit(1))
    own = F.transform(cut, lambda c, i: F.when(i == 0, F.substr(c, 2 * F.col("__lead") + 1)).otherwise(c))
    mixed = F.rtrim(F.array_join(F.zip_with(own, "__times", lambda c, n: F.repeat(c, n)), ""), F.lit(" \t\n\x0b\f\r"))
    out = joined.withColumn("__mixed", mixed)
    return out.select(*[F.col("__mixed").alias(c) if c == text else F.length("__mixed").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
