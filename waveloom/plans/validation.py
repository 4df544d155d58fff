"""Queries that validate classifiers on rows they have not seen."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import learn as L
from ..operators import report as R
from ..operators import sufficient as E
from .learning import long, rows
from .registry import query


def folded(spark, sf_dir, k=4):
    return L.folds(rows(spark, sf_dir), F.col("y"), "key", k)


@query()
def m9_permutation_test(spark, sf_dir):
    """Balanced accuracy of a cross-validated discriminant, its p value from 100 permutations of the labels, and what guessing reaches."""
    df = folded(spark, sf_dir)
    tested = E.p_value(E.permutation_test(df, "embedding", "y", 4, 100))
    guess = E.dummy(df, "y").agg(F.avg("bacc").alias("dummy"))
    return tested.crossJoin(F.broadcast(guess))  # one row each


@query("""WITH f AS (SELECT label % 2 y, ((row_number() OVER (PARTITION BY label % 2, vec_id % 64 ORDER BY vec_id) - 1) % 4)::INT fold FROM embeddings), n AS (SELECT fold, y, count(*) n FROM f GROUP BY ALL),
  t AS (SELECT y, sum(n) a FROM n GROUP BY y), s AS (SELECT fold, sum(n) own FROM n GROUP BY fold) SELECT fold, round(avg((a - n) / ((SELECT count(*) FROM f) - own)), 8) bacc FROM n JOIN t USING (y) JOIN s USING (fold) GROUP BY fold""")
def m9_stratified_dummy(spark, sf_dir):
    return E.dummy(folded(spark, sf_dir), "y").select("fold", F.round("bacc", 8).alias("bacc"))


@query()
def m11_discriminant_versions(spark, sf_dir):
    """How a discriminant does in five ways of fitting and checking."""
    return R.balanced_accuracy(E.versions(folded(spark, sf_dir), "embedding", "y"), ["version"])


@query()
def m14_smallest_sufficient(spark, sf_dir):
    """The smallest set of leading features whose held-out score has come near that of all and converged."""
    weight = long(spark, sf_dir).groupBy("feat").agg(F.abs(F.corr("x", "y")).alias("r")).collect()  # one row a feature
    order = [r.feat - 1 for r in sorted(weight, key=lambda r: (-(r.r or 0.0), r.feat))]
    return E.smallest_sufficient(folded(spark, sf_dir), "embedding", "y", order, [2, 4, 8, 12, 16, 24, 32, 48])


@query()
def m18_channel_search_held_out(spark, sf_dir):
    """Held-out score of each block of eight features alone and of all others."""
    blocks = [list(range(8 * b, 8 * b + 8)) for b in range(8)]
    features = blocks + [[i for i in range(64) if i not in some] for some in blocks]
    scores = E.subsets(folded(spark, sf_dir), "embedding", "y", features)
    return scores.select((F.col("model") % 8).alias("block"), F.when(F.col("model") < 8, "only").otherwise("without").alias("kind"), "bacc")


@query()
def m8_stratified_group_folds(spark, sf_dir):
    """Whole groups (vec_id modulo 23) dealt to four folds with near equal class shares."""
    df = rows(spark, sf_dir).withColumn("grp", F.col("key") % 23)
    dealt = E.group_folds(df, "grp", "y", 4)
    return df.join(F.broadcast(dealt), "grp").groupBy("fold", "y").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("n_groups"))


@query("""WITH f AS (SELECT vec_id AS key, label % 2 y, ((row_number() OVER (PARTITION BY label % 2, vec_id % 64 ORDER BY vec_id) - 1) % 4)::INT fold FROM embeddings),
  r AS (SELECT key, o.outer_, (row_number() OVER (PARTITION BY o.outer_, y, key % 64 ORDER BY key) - 1) % 4 i FROM f, range(4) o(outer_) WHERE fold <> o.outer_)
  SELECT key, fold AS outer, 'test' AS role FROM f UNION ALL SELECT key, outer_::INT, CASE WHEN i = 0 THEN 'inner test' ELSE 'train' END FROM r""")
def m8_nested_split(spark, sf_dir):
    return E.nested(rows(spark, sf_dir), "y", "key", 4)


@query()
def m12_boosted_classes(spark, sf_dir):
    """Weighted boosting over all classes: how each class of the held-out fifth is named."""
    df = L.folds(rows(spark, sf_dir), F.col("label"), "key", 5)
    train = df.filter("fold <> 0")
    weights = {r["label"]: r["weight"] for r in L.balanced_weights(train, "label").collect()}  # one row a class
    model = B.boosted(train, "embedding", "label", weights, rounds=3, depth=2, bins=16)
    return R.confusion(B.predicted(df.filter("fold = 0"), "embedding", model, ["label"]).withColumnRenamed("label", "y"))


@query()
def m12_importances(spark, sf_dir):
    """Share of the gain of all splits that each feature brings."""
    df = rows(spark, sf_dir)
    model = B.boosted(df, "embedding", "y", rounds=3, depth=2, bins=16)
    total = float(model.gain.sum()) or 1.0
    return spark.createDataFrame([(i + 1, round(float(g) / total, 8)) for i, g in enumerate(model.gain)], "feat int, gain double")  # one row a feature


@query()
def m19_additive_pairs(spark, sf_dir):
    """Mean size of what each feature and chosen pair adds to the held-out score of an additive model."""
    df = folded(spark, sf_dir, 3)
    model, _ = B.additive(df, "embedding", "y", "fold", 3, rounds=4)
    return B.explained(df, "embedding", model, "fold", ["key"]).groupBy("feat").agg(F.round(F.avg(F.abs("score")), 8).alias("size"))


@query()
def m22_additive_explanations(spark, sf_dir):
    """What each feature adds to the held-out score of a row by the additive model, with the intercept; parts of pairs go."""
    df = folded(spark, sf_dir, 3)
    model, _ = B.additive(df, "embedding", "y", "fold", 3, rounds=4)
    return B.explained(df, "embedding", model, "fold", ["key"]).filter(~F.col("feat").contains(" x ")).select("key", "feat", F.round("score", 8).alias("score"))


@query()
def m15_redistributed_scores(spark, sf_dir):
    """Mean of each class as a score of each feature, computed for the features that pruning keeps and carried over to the others."""
    df = rows(spark, sf_dir)
    steps = L.pruned(df, "embedding", 1.2)
    gone = [bad for bad, _, _ in steps]
    kept = long(spark, sf_dir).filter(~F.col("feat").isin(gone) if gone else F.lit(True)).groupBy("label", "feat").agg(F.avg("x").alias("score"))
    return L.redistributed(kept, steps, ["label"]).select("label", "feat", F.round("score", 8).alias("score"))


@query()
def m16_all_relevant(spark, sf_dir):
    """Which features beat their shadows more often than chance would let them, by a binomial test."""
    found = B.all_relevant(rows(spark, sf_dir), "embedding", "y", tests=12, rounds=1, depth=2, bins=16)
    return spark.createDataFrame(found, "feat int, hits int, decision string")  # one row a feature


@query("""WITH r AS (SELECT vec_id AS key, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 i, count(*) OVER (PARTITION BY label) n FROM embeddings), m AS (SELECT max(n) m FROM r)
  SELECT key, label, unnest(range(m // n + CASE WHEN i < m % n THEN 1 ELSE 0 END))::INT copy FROM r, m""")
def m7_oversampled(spark, sf_dir):
    """Rows of the smaller classes repeated until all classes are as large as the largest."""
    return L.oversampled(rows(spark, sf_dir).select("key", "label"), "label", "key").select("key", "label", "copy")
