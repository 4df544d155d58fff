"""Queries over labelled feature vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import learn as L
from ..operators import report as R
from ..sources import views as V
from .registry import query

_X = "x AS (SELECT vec_id AS key, label % 2 y, label, f::INT feat, embedding[f]::DOUBLE x FROM embeddings, range(1, 65) r(f))"


def rows(spark, sf_dir):
    """key, y (two classes), label, embedding."""
    return V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), (F.col("label") % 2).alias("y"), "label", "embedding")


def long(spark, sf_dir):
    return L.long(rows(spark, sf_dir), ["key", "y", "label"], "embedding")


@query("SELECT label y, count(*) n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 8) weight FROM embeddings GROUP BY label")
def m7_balanced_weights(spark, sf_dir):
    return L.balanced_weights(V.table(spark, sf_dir, "embeddings").withColumnRenamed("label", "y"), "y").withColumn("weight", F.round("weight", 8))


@query("SELECT vec_id AS key, ((row_number() OVER (PARTITION BY label, vec_id % 64 ORDER BY vec_id) - 1) % 4)::INT fold FROM embeddings")
def m8_stratified_folds(spark, sf_dir):
    return L.folds(rows(spark, sf_dir), F.col("label"), "key", 4).select("key", "fold")


@query("SELECT vec_id AS key, (label % 3)::INT fold, label FROM embeddings")
def m8_group_folds(spark, sf_dir):
    return rows(spark, sf_dir).select("key", (F.col("label") % 3).cast("int").alias("fold"), "label")


@query(f"WITH {_X}, b AS (SELECT feat, y, ntile(8) OVER (PARTITION BY feat ORDER BY x, key) b FROM x), j AS (SELECT feat, b, y, count(*) n FROM b GROUP BY ALL), p AS (SELECT feat, n, sum(n) OVER (PARTITION BY feat) t, sum(n) OVER (PARTITION BY feat, b) nb, sum(n) OVER (PARTITION BY feat, y) ny FROM j) SELECT feat, round(sum(n / t * ln(n * t / (nb * ny))), 8) mi FROM p GROUP BY feat")
def m17_mutual_information(spark, sf_dir):
    return L.mutual_information(long(spark, sf_dir), "y", 8).withColumn("mi", F.round("mi", 8))


@query(f"WITH {_X} SELECT a.feat i, b.feat j, round(corr(a.x, b.x), 6) r FROM x a JOIN x b ON a.key = b.key AND a.feat < b.feat GROUP BY ALL")
def a29_correlations(spark, sf_dir):
    return L.correlations(rows(spark, sf_dir), "embedding").withColumn("r", F.round("r", 6))


@query(f"WITH {_X}, c AS (SELECT a.feat i, b.feat j, round(corr(a.x, b.x), 6) r FROM x a JOIN x b ON a.key = b.key AND a.feat < b.feat GROUP BY ALL) SELECT f feat FROM range(1, 65) t(f) WHERE f NOT IN (SELECT j FROM c WHERE abs(r) > 0.12)")
def a29_non_synonyms(spark, sf_dir):
    """Features that are not the later one of any strongly correlated pair."""
    strong = L.correlations(rows(spark, sf_dir), "embedding").withColumn("r", F.round("r", 6)).filter("abs(r) > 0.12")
    return spark.range(1, 65).withColumnRenamed("id", "feat").join(strong, F.col("feat") == F.col("j"), "left_anti")


@query(f"WITH {_X} SELECT label, feat, round(avg(x), 8) mean FROM x GROUP BY ALL UNION ALL SELECT label, 0, 1.0 FROM (SELECT DISTINCT label FROM x)")
def a27_scores_per_class(spark, sf_dir):
    mean = long(spark, sf_dir).groupBy("label", "feat").agg(F.round(F.avg("x"), 8).alias("mean"))
    return mean.unionByName(rows(spark, sf_dir).select("label").distinct().select("label", F.lit(0).alias("feat"), F.lit(1.0).alias("mean")))


@query(f"WITH {_X}, g AS (SELECT key, label, feat % 8 grp, sum(x) s, sum(abs(x)) a FROM x GROUP BY ALL) SELECT label, grp::INT grp, round(avg(s), 6) mean, round(stddev_pop(s), 6) std, round(max(a), 6) most, round(min(a), 6) least FROM g GROUP BY ALL")
def a28_merged_scores(spark, sf_dir):
    g = long(spark, sf_dir).groupBy("key", "label", (F.col("feat") % 8).alias("grp")).agg(F.sum("x").alias("s"), F.sum(F.abs("x")).alias("a"))
    return g.groupBy("label", "grp").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.stddev_pop("s"), 6).alias("std"), F.round(F.max("a"), 6).alias("most"), F.round(F.min("a"), 6).alias("least"))


@query(f"WITH {_X} SELECT feat, round(avg(abs(x)), 8) AS score FROM x GROUP BY feat ORDER BY avg(abs(x)) DESC, feat LIMIT 10")
def a46_top_features(spark, sf_dir):
    return long(spark, sf_dir).groupBy("feat").agg(F.avg(F.abs("x")).alias("s")).orderBy(F.desc("s"), "feat").limit(10).select("feat", F.round("s", 8).alias("score"))


@query(f"WITH {_X}, q AS (SELECT label, quantile_cont(abs(m), 0.9) q FROM (SELECT label, feat, avg(x) m FROM x GROUP BY ALL) GROUP BY label) SELECT DISTINCT feat FROM (SELECT label, feat, avg(x) m FROM x GROUP BY ALL) JOIN q USING (label) WHERE abs(m) > q")
def t1_best_columns(spark, sf_dir):
    m = long(spark, sf_dir).groupBy("label", "feat").agg(F.avg("x").alias("m"))
    q = m.groupBy("label").agg(F.percentile(F.abs("m"), 0.9).alias("q"))
    return m.join(q, "label").filter("abs(m) > q").select("feat").distinct()


@query(f"WITH {_X}, m AS (SELECT label, feat, avg(x) m FROM x GROUP BY ALL) SELECT label, feat, row_number() OVER (PARTITION BY label ORDER BY abs(m) DESC, feat)::INT AS rank FROM m QUALIFY rank <= 3")
def t2_top_coordinates(spark, sf_dir):
    m = long(spark, sf_dir).groupBy("label", "feat").agg(F.avg("x").alias("m"))
    return m.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc(F.abs("m")), "feat"))).filter("rank <= 3").select("label", "feat", "rank")


@query()
def m5_principal_components(spark, sf_dir):
    return L.components(rows(spark, sf_dir), "embedding", 0.95).select("key", F.size("scores").alias("k"), F.round(F.col("scores")[0], 6).alias("first"))


@query()
def m9_cross_validated(spark, sf_dir):
    """Per fold: balanced accuracy of a model that did not see it, and the same of shuffled labels as a control."""
    df, out = rows(spark, sf_dir), None
    for kind, some in (("labels", df), ("shuffled", L.shuffled(df, "y", 1))):
        pred = L.cross_validated(some, "embedding", "y", 4).withColumn("kind", F.lit(kind))
        out = pred if out is None else out.unionByName(pred)
    return R.balanced_accuracy(R.confusion(out, ["kind", "fold"]), ["kind", "fold"])


@query()
def m11_discriminant(spark, sf_dir):
    df = rows(spark, sf_dir)
    return L.scored(df, "embedding", L.discriminant(df, "embedding", "label")).select("key", "label", "yhat")


@query()
def m12_boosted_trees(spark, sf_dir):
    return L.cross_validated(rows(spark, sf_dir), "embedding", "y", 2, trees=True)


@query()
def m15_variance_inflation(spark, sf_dir):
    df = rows(spark, sf_dir)
    kept = set(L.prune_inflated(df, "embedding", 1.2))
    return spark.createDataFrame([(i + 1, round(v, 6), i + 1 in kept) for i, v in enumerate(L.inflation(df, "embedding"))], "feat int, vif double, kept boolean")


@query()
def m10_across_groups(spark, sf_dir):
    """Train on all groups but one, test on that one."""
    df = rows(spark, sf_dir).withColumn("grp", (F.col("label") % 3).cast("int"))
    out = None
    for g in range(3):
        model = L.discriminant(df.filter(F.col("grp") != g), "embedding", "y")
        part = L.scored(df.filter(F.col("grp") == g), "embedding", model).select("y", "yhat", F.concat_ws("->", F.lit("rest"), F.lit(g)).alias("pattern"))
        out = part if out is None else out.unionByName(part)
    return R.balanced_accuracy(R.confusion(out, ["pattern"]), ["pattern"])


@query(f"WITH {_X}, m AS (SELECT label, feat, avg(x) m FROM x GROUP BY ALL) SELECT x.key, m.label comp, round(sum(m.m * x.x), 6) AS score FROM x JOIN m USING (feat) GROUP BY ALL".replace("SELECT x.key, m.label", "SELECT x.key, m.label"))
def f7_back_projection(spark, sf_dir):
    """Scores of every vector on the class means: inner products inside the row, the means are the model."""
    means: dict[int, dict[int, float]] = {}
    for r in long(spark, sf_dir).groupBy("label", "feat").agg(F.avg("x").alias("m")).collect():  # classes * components
        means.setdefault(r.label, {})[r.feat] = r.m
    model = {c: ([m[k] for k in sorted(m)], 0.0) for c, m in means.items()}
    return L.projected(rows(spark, sf_dir), "embedding", model).select("key", F.col("class").alias("comp"), F.round("score", 6).alias("score"))


@query(f"WITH {_X}, c AS (SELECT a.feat i, b.feat j, round(corr(a.x, b.x), 6) r FROM x a JOIN x b ON a.key = b.key AND a.feat < b.feat GROUP BY ALL) SELECT i feat, count(DISTINCT j % 8)::BIGINT n_band, count(DISTINCT j // 8)::BIGINT n_channel, count(*) n FROM c WHERE abs(r) > 0.08 GROUP BY i")
def a44_synonym_parts(spark, sf_dir):
    """For each feature's strongly correlated partners: how many values their name parts take."""
    strong = L.correlations(rows(spark, sf_dir), "embedding").withColumn("r", F.round("r", 6)).filter("abs(r) > 0.08")
    return strong.groupBy(F.col("i").alias("feat")).agg(F.countDistinct(F.col("j") % 8).alias("n_band"), F.countDistinct(F.floor(F.col("j") / 8)).alias("n_channel"), F.count("*").alias("n"))


@query()
def m21_contributions(spark, sf_dir):
    """Additive parts of the linear scores, averaged by class and feature."""
    df = rows(spark, sf_dir)
    parts = L.contributions(df, "embedding", L.discriminant(df, "embedding", "y"))
    return parts.groupBy("class", "feat").agg(F.round(F.avg("part"), 6).alias("mean"), F.round(F.avg(F.abs("part")), 6).alias("size"))


@query()
def m6_independent_components(spark, sf_dir):
    df = rows(spark, sf_dir)
    un = L.independent(df, "embedding", 3)
    return L.projected(df, "embedding", {i: (w, 0.0) for i, w in enumerate(un)}).select("key", F.col("class").alias("comp"), F.round("score", 6).alias("score"))


@query()
def m16_shadow_features(spark, sf_dir):
    df = rows(spark, sf_dir)
    good = L.beats_shadows(df, "embedding", "y", 3)
    return long(spark, sf_dir).groupBy("feat").agg(F.round(F.avg("x"), 6).alias("mean")).withColumn("kept", F.col("feat").isin(good) if good else F.lit(False))


@query()
def m19_additive_model(spark, sf_dir):
    return L.additive(rows(spark, sf_dir), "embedding", "y").withColumn("value", F.round("value", 8))


@query()
def m18_channel_search(spark, sf_dir):
    """A model on each block of eight components alone and on all others: how much each block is worth."""
    df, out = rows(spark, sf_dir), None
    for b in range(8):
        for kind in ("only", "without"):
            part = F.slice("embedding", 8 * b + 1, 8) if kind == "only" else F.concat(F.slice("embedding", 1, 8 * b), F.slice("embedding", 8 * b + 9, 64))
            some = df.select("key", "y", part.alias("v"))
            one = L.scored(some, "v", L.discriminant(some, "v", "y")).select(F.lit(b).alias("block"), F.lit(kind).alias("kind"), "y", "yhat")
            out = one if out is None else out.unionByName(one)
    return R.balanced_accuracy(R.confusion(out, ["block", "kind"]), ["block", "kind"])


@query()
def m14_sufficient_features(spark, sf_dir):
    """Steps of features by importance, and the balanced accuracy that each reaches."""
    df = rows(spark, sf_dir)
    order = [r.feat for r in long(spark, sf_dir).groupBy("feat").agg(F.abs(F.corr("x", "y")).alias("r")).orderBy(F.desc("r"), "feat").collect()]  # one row a component
    out = None
    for n in (4, 8, 16, 32, 64):
        some = df.select("key", "y", F.array(*[F.col("embedding")[i - 1] for i in order[:n]]).alias("v"))
        one = L.scored(some, "v", L.discriminant(some, "v", "y")).select(F.lit(n).alias("n_features"), "y", "yhat")
        out = one if out is None else out.unionByName(one)
    return R.balanced_accuracy(R.confusion(out, ["n_features"]), ["n_features"])


@query()
def m23_common_patterns(spark, sf_dir):
    """Power of every vector along the filters that tell the classes apart."""
    df = rows(spark, sf_dir)
    filters = L.common_patterns(df, "embedding", "y", 2)
    score = L.projected(df, "embedding", {i: (w, 0.0) for i, (_, w) in enumerate(filters)})
    return score.select("key", F.col("class").alias("comp"), F.round(F.col("score") * F.col("score"), 8).alias("power"))


@query()
def m13_grid_search(spark, sf_dir):
    """Two parameters, with early stopping."""
    grid = [{"regParam": r, "elasticNetParam": e} for r in (0.01, 0.1, 0.3) for e in (0.0, 0.5)]
    pred = L.grid_search(rows(spark, sf_dir), "embedding", "y", grid, 3)
    return R.balanced_accuracy(R.confusion(pred, ["point"]), ["point"])
