"""Statistical learning over long feature tables (key.., feat, x)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of the keys in which rows are numbered.
PARTS = 64


def long(vectors: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys.., feat (from 1), x."""
    rows = vectors.select(*keys, F.posexplode(column).alias("feat", "x"))
    return rows.select(*keys, (F.col("feat") + 1).alias("feat"), F.col("x").cast("double").alias("x"))


def folds(df: DataFrame, y: Column, key: str, k: int, seed: int = 0) -> DataFrame:
    """Add fold: stratified, in an order given by the key (and a hash of it for a seed other than 0).

    Rows are numbered within a class and one of `PARTS` parts of the keys, so that no class is one task's
    group; each fold gets an equal share of a class to within one row per part.
    """
    order = F.xxhash64(F.lit(seed), key) if seed else F.col(key)
    return df.withColumn("fold", F.pmod(F.row_number().over(W.partitionBy(y, F.col(key) % PARTS).orderBy(order, key)) - 1, F.lit(k)).cast("int"))


def balanced_weights(df: DataFrame, y: str) -> DataFrame:
    """y, n, weight = total / (classes * n)."""
    n = df.groupBy(y).agg(F.count("*").alias("n"))
    whole = W.partitionBy()  # one row per class
    return n.withColumn("weight", F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")))


def oversampled(df: DataFrame, y: str, key: str) -> DataFrame:
    """Add copy: rows of smaller classes stand as often as it takes for all classes to be as large as the largest; the first ones in
    key order once more where that does not divide evenly.  Rows are numbered in chunks of (whole, not negative) keys."""
    from .windows import numbered

    n = df.groupBy(y).agg(F.count("*").alias("__n"))  # one row a class
    most = n.agg(F.max("__n").alias("__most"))
    rows = numbered(df.withColumn("bin", F.col(key)), [y], "__place").drop("bin").join(F.broadcast(n.crossJoin(F.broadcast(most))), y)  # one row a class
    times = F.floor(F.col("__most") / F.col("__n")) + (F.col("__place") < F.col("__most") % F.col("__n")).cast("int")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), times.cast("int") - 1))).drop("__n", "__most", "__place")


def correlations(rows: DataFrame, column: str) -> DataFrame:
    """i < j, r: Pearson correlations of the components; the d x d result is the size of the model."""
    matrix = Correlation.corr(rows.select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("v")), "v").first()[0].toArray()
    d = matrix.shape[0]
    return rows.sparkSession.createDataFrame([(i + 1, j + 1, float(matrix[i, j])) for i in range(d) for j in range(i + 1, d)], "i int, j int, r double")


def inflation(rows: DataFrame, column: str) -> list[float]:
    """Variance inflation of every component: the diagonal of the inverse correlation matrix, from one pass."""
    matrix = Correlation.corr(rows.select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("v")), "v").first()[0].toArray()
    return np.diag(np.linalg.pinv(matrix)).tolist()


def prune_inflated(rows: DataFrame, column: str, threshold: float) -> list[int]:
    """Components (from 1) left after dropping the worst one while its inflation exceeds the threshold."""
    matrix = Correlation.corr(rows.select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("v")), "v").first()[0].toArray()
    left = list(range(matrix.shape[0]))
    while len(left) > 1:
        vif = np.diag(np.linalg.pinv(matrix[np.ix_(left, left)]))
        if vif.max() <= threshold:
            break
        left.pop(int(vif.argmax()))
    return [i + 1 for i in left]


def pruned(rows: DataFrame, column: str, threshold: float) -> list[tuple[int, list[int], list[float]]]:
    """(component, those left, their coefficients) in the order of pruning, components from 1: each time the one of largest
    inflation above the threshold, with its regression on the ones left then, all from blocks of one covariance matrix."""
    ready = vectors(rows, column)
    std = ready.select(Summarizer.std(F.col("features"))).first()[0].toArray()
    corr = Correlation.corr(ready, "features").first()[0].toArray()
    left, out = list(range(len(std))), []
    while len(left) > 1:
        vif = np.diag(np.linalg.pinv(corr[np.ix_(left, left)]))
        worst = int(vif.argmax())
        if vif[worst] <= threshold:
            break
        bad = left.pop(worst)
        beta = np.linalg.pinv(corr[np.ix_(left, left)]) @ corr[left, bad]
        scale = np.divide(std[bad], std[left], out=np.zeros(len(left)), where=std[left] > 0)
        out.append((bad + 1, [i + 1 for i in left], (beta * scale).tolist()))
    return out


def redistributed(scores: DataFrame, steps: list[tuple[int, list[int], list[float]]], keys: list[str]) -> DataFrame:
    """keys.., feat, score: scores of the kept components, and of the pruned ones what their regressions make of these.

    The last pruned comes first, as the earlier ones were regressed on it.  Each becomes a sum over kept components before any row
    is touched, so the scores (keys.., feat, score) meet one small table of coefficients once.
    """
    made: dict[int, dict[int, float]] = {}
    for bad, left, beta in reversed(steps):
        mine: dict[int, float] = {}
        for i, b in zip(left, beta, strict=True):
            for kept, c in made.get(i, {i: 1.0}).items():
                mine[kept] = mine.get(kept, 0.0) + b * c
        made[bad] = mine
    table = scores.sparkSession.createDataFrame([(k, bad, c) for bad, mine in made.items() for k, c in mine.items()], "feat int, to int, c double")  # components squared at most
    kept = scores.join(F.broadcast(table.select(F.col("to").alias("feat")).distinct()), "feat", "left_anti")
    new = kept.join(F.broadcast(table), "feat").groupBy(*keys, "to").agg(F.sum(F.col("c") * F.col("score")).alias("score"))
    return kept.select(*keys, F.col("feat").cast("int").alias("feat"), "score").unionByName(new.select(*keys, F.col("to").alias("feat"), "score"))


def ranked(rows: DataFrame, group: str, order: list[str], parts: int = 64) -> DataFrame:
    """Add place (from 1) and total of each row of its group in the given order.

    Groups are cut into ranges of the first order column, whose rows are numbered apart and shifted by the
    sizes of the ranges before; so the rows of a group need not meet in one task.
    """
    edges = rows.groupBy(group).agg(F.percentile_approx(order[0], [i / parts for i in range(1, parts)], 1000).alias("__edges"))
    cut = rows.join(edges, group).withColumn("__part", F.size(F.filter("__edges", lambda e: F.col(order[0]) > e))).drop("__edges")
    sizes = cut.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    whole = W.partitionBy(group)
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(group, "__part", before.alias("__before"), F.sum("__n").over(whole).alias("total"))
    inside = F.row_number().over(W.partitionBy(group, "__part").orderBy(*order))
    return cut.withColumn("__inside", inside).join(sizes, [group, "__part"]).withColumn("place", F.col("__before") + F.col("__inside")).drop("__part", "__inside", "__before")


def equal_bins(rows: DataFrame, group: str, order: list[str], bins: int) -> DataFrame:
    """Add b (1..bins): bins of equal numbers of rows, the first ones one larger where they do not divide evenly."""
    small, larger = F.floor(F.col("total") / bins), F.col("total") % bins
    at = F.col("place") - 1
    b = F.when(at < larger * (small + 1), F.floor(at / (small + 1))).otherwise(larger + F.floor((at - larger * (small + 1)) / F.greatest(small, F.lit(1))))
    return ranked(rows, group, order).withColumn("b", (b + 1).cast("int")).drop("place", "total")


def mutual_information(rows: DataFrame, y: str, bins: int) -> DataFrame:
    """feat, mi of each feature (long rows with a class column) and the class, over equally filled bins."""
    joint = equal_bins(rows, "feat", ["x", "key"], bins).groupBy("feat", "b", y).agg(F.count("*").alias("n"))
    whole = lambda *c: F.sum("n").over(W.partitionBy("feat", *c))
    p = joint.select("feat", "n", whole().alias("t"), whole("b").alias("nb"), whole(y).alias("ny"))
    return p.groupBy("feat").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mi"))


def vectors(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def components(df: DataFrame, column: str, share: float) -> DataFrame:
    """Add scores: the leading principal components that hold `share` of the variance."""
    ready = vectors(df, column)
    full = PCA(k=len(ready.select("features").first()[0]), inputCol="features", outputCol="pc").fit(ready)
    k = int(np.searchsorted(np.cumsum(full.explainedVariance.toArray()), share) + 1)
    return full.transform(ready).withColumn("scores", F.slice(vector_to_array("pc"), 1, k)).drop("features", "pc")


def discriminant(df: DataFrame, column: str, y: str) -> dict[int, tuple[list[float], float]]:
    """Linear discriminants (weights, offset) by class: class means, and the pooled covariance from one
    correlation pass; the solve is as large as the model."""
    stats = long(df, [y], column).groupBy(y, "feat").agg(F.avg("x").alias("m"), F.count("*").alias("n")).collect()  # classes * components
    d = max(r["feat"] for r in stats)
    means, counts = {}, {}
    for r in stats:
        means.setdefault(r[y], np.zeros(d))[r["feat"] - 1] = r["m"]
        counts[r[y]] = r["n"]
    total = sum(counts.values())
    ready = vectors(df, column)
    std = ready.select(Summarizer.std(F.col("features"))).first()[0].toArray()
    corr = np.nan_to_num(Correlation.corr(ready, "features").first()[0].toArray())
    middle = sum(counts[c] * m for c, m in means.items()) / total
    between = sum(counts[c] / total * np.outer(m - middle, m - middle) for c, m in means.items())
    inverse = np.linalg.pinv(corr * np.outer(std, std) * (total - 1) / total - between)
    return {int(c): ((inverse @ m).tolist(), float(-0.5 * m @ inverse @ m + np.log(counts[c] / total))) for c, m in means.items()}


def inner(column: str, weights: list[float], offset: float = 0.0) -> Column:
    """offset + the inner product of an array column with fixed weights, inside the row."""
    return F.aggregate(F.zip_with(column, F.array(*map(F.lit, map(float, weights))), lambda a, b: a.cast("double") * b), F.lit(float(offset)), lambda s, v: s + v)


def projected(df: DataFrame, column: str, model: dict[int, tuple[list[float], float]]) -> DataFrame:
    """key, class, score for each class of the model; one row a class, no shuffle."""
    scores = F.array(*[F.struct(F.lit(c).alias("class"), inner(column, w, b).alias("score")) for c, (w, b) in sorted(model.items())])
    return df.select("key", F.inline(scores))


def shuffled(df: DataFrame, y: str, seed: int) -> DataFrame:
    """The same rows with the labels of other rows: rows are numbered in two orders given by hashes, within parts of the keys."""
    at = df.withColumn("__p", F.pmod(F.xxhash64(F.lit(-seed - 1), "key"), F.lit(PARTS)))
    number = lambda k: F.row_number().over(W.partitionBy("__p").orderBy(F.xxhash64(F.lit(k), "key"), "key"))
    labels = at.select("__p", number(2 * seed + 1).alias("__n"), F.col(y).alias("__y"))
    return at.withColumn("__n", number(2 * seed)).join(labels, ["__p", "__n"]).withColumn(y, F.col("__y")).drop("__p", "__n", "__y")


def scored(df: DataFrame, column: str, model: dict[int, tuple[list[float], float]]) -> DataFrame:
    """Add yhat: the class with the largest discriminant; scoring is an inner product in the plan."""
    best = F.array_max(F.array(*[F.struct((inner(column, w) + b).alias("score"), F.lit(c).alias("c")) for c, (w, b) in sorted(model.items())]))
    return df.withColumn("yhat", best["c"])


def cross_validated(df: DataFrame, column: str, y: str, k: int, trees: bool = False) -> DataFrame:
    """key, fold, y, yhat of every row, predicted by a model that did not see its fold."""
    ready = vectors(folds(df, F.col(y), "key", k), column).withColumn("label", F.col(y).cast("double"))
    out = None
    for f in range(k):
        model = (GBTClassifier(maxIter=5, maxDepth=3, seed=1) if trees else LogisticRegression(regParam=1e-2, maxIter=30)).fit(ready.filter(F.col("fold") != f))
        part = model.transform(ready.filter(F.col("fold") == f)).select("key", "fold", y, F.col("prediction").cast("int").alias("yhat"))
        out = part if out is None else out.unionByName(part)
    return out


def contributions(df: DataFrame, column: str, model: dict[int, tuple[list[float], float]]) -> DataFrame:
    """key, class, feat (0: offset), part: exact additive parts of every linear score."""
    spark = df.sparkSession
    rows = [(c, 0, b) for c, (_, b) in model.items()] + [(c, i + 1, v) for c, (w, _) in model.items() for i, v in enumerate(w)]
    weights = spark.createDataFrame(rows, "class int, feat int, w double")  # the size of the model
    x = long(df, ["key"], column).unionByName(df.select("key", F.lit(0).alias("feat"), F.lit(1.0).alias("x")))
    return x.join(F.broadcast(weights), "feat").select("key", "class", "feat", (F.col("w") * F.col("x")).alias("part"))


def independent(df: DataFrame, column: str, k: int, rounds: int = 10) -> list[list[float]]:
    """Unmixing rows of k independent components (FastICA with tanh, symmetric decorrelation).

    Whitening comes from one correlation pass; each round is one aggregation of E[z g(w z)] and E[g'(w z)],
    the k x k algebra is done on the driver.
    """
    ready = vectors(df, column)
    std = ready.select(Summarizer.std(F.col("features"))).first()[0].toArray()
    mean = ready.select(Summarizer.mean(F.col("features"))).first()[0].toArray()
    cov = np.nan_to_num(Correlation.corr(ready, "features").first()[0].toArray()) * np.outer(std, std)
    values, axes = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:k]
    white = (axes[:, top] / np.sqrt(np.maximum(values[top], 1e-12))).T
    dot = lambda v, w, b=0.0: F.aggregate(F.zip_with(v, F.array(*map(F.lit, map(float, w))), lambda a, c: a.cast("double") * c), F.lit(float(b)), lambda s, x: s + x)
    z = df.select(F.array(*[dot(column, w, -(w @ mean)) for w in white]).alias("z"))
    un = np.linalg.qr(np.random.default_rng(0).normal(size=(k, k)))[0]
    for _ in range(rounds):
        g = [F.tanh(dot("z", w)) for w in un]
        one = z.select("z", *[v.alias(f"g{i}") for i, v in enumerate(g)])
        row = one.agg(*[F.avg(F.col(f"g{i}") * F.col("z")[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)], *[F.avg(1 - F.col(f"g{i}") * F.col(f"g{i}")).alias(f"d{i}") for i in range(k)]).first()
        new = np.array([[row[f"m{i}_{j}"] - row[f"d{i}"] * un[i, j] for j in range(k)] for i in range(k)])
        u, _, v = np.linalg.svd(new)
        was, un = un, u @ v
        if np.abs(np.abs((was * un).sum(axis=1)) - 1).max() < 1e-4:
            break
    return (un @ white).tolist()


def beats_shadows(df: DataFrame, column: str, y: str, rounds: int = 3) -> list[int]:
    """Components (from 1) whose importance beats every shadow component in most rounds.

    Shadows are the same values in the order of a hash of the key: each component is permuted by one
    join on row numbers made in parts of the keys.
    """
    from pyspark.ml.classification import RandomForestClassifier

    d = len(df.select(column).first()[0])
    wins = np.zeros(d)
    for r in range(rounds):
        at = df.withColumn("__p", F.pmod(F.xxhash64(F.lit(-r - 1), "key"), F.lit(PARTS)))
        number = lambda seed: F.row_number().over(W.partitionBy("__p").orderBy(F.xxhash64(F.lit(seed), "key"), "key"))
        own = at.withColumn("__n", number(2 * r))
        other = at.select("__p", number(2 * r + 1).alias("__n"), F.col(column).alias("__shadow"))
        both = own.join(other, ["__p", "__n"]).withColumn("v", F.concat(column, "__shadow")).select(F.col(y).cast("double").alias("label"), "v")
        model = RandomForestClassifier(numTrees=10, maxDepth=4, seed=r).fit(vectors(both, "v"))
        score = model.featureImportances.toArray()
        wins += score[:d] > score[d:].max()
    return [i + 1 for i in range(d) if wins[i] > rounds / 2]


def additive(df: DataFrame, column: str, y: str, bins: int = 8, rounds: int = 2, rate: float = 0.5) -> DataFrame:
    """feat, bin, value of a cyclic additive model: in each round every feature's bins take the mean residual, damped.

    The bins of all features are updated from one aggregation a round (all features see the residual of
    the round before).
    """
    x = long(df, ["key", y], column)
    edges = x.groupBy("feat").agg(F.percentile_approx("x", [i / bins for i in range(1, bins)], 1000).alias("e"))
    binned = x.join(F.broadcast(edges), "feat").withColumn("bin", F.size(F.filter("e", lambda e: F.col("x") > e))).select("key", y, "feat", "bin")
    d = edges.count()
    shape = binned.groupBy("feat", "bin").agg(F.lit(0.0).alias("value")).distinct()
    mean = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    for _ in range(rounds):
        fitted = binned.join(F.broadcast(shape), ["feat", "bin"]).groupBy("key").agg(F.sum("value").alias("f"))
        step = binned.join(fitted, "key").groupBy("feat", "bin").agg((F.avg(F.col(y) - F.lit(mean) - F.col("f")) * rate / d).alias("step"))
        shape = shape.join(step, ["feat", "bin"]).select("feat", "bin", (F.col("value") + F.col("step")).alias("value"))
    return shape


def common_patterns(df: DataFrame, column: str, y: str, k: int) -> list[tuple[float, list[float]]]:
    """(share of the first class's power, weights) of the 2k spatial filters that tell two classes best apart."""
    covs = {}
    for c in sorted(r[0] for r in df.select(y).distinct().collect())[:2]:  # two classes
        some = vectors(df.filter(F.col(y) == c), column)
        std = some.select(Summarizer.std(F.col("features"))).first()[0].toArray()
        covs[c] = np.nan_to_num(Correlation.corr(some, "features").first()[0].toArray()) * np.outer(std, std)
    one, two = covs.values()
    values, axes = np.linalg.eigh(one + two)
    white = axes / np.sqrt(np.maximum(values, 1e-12))
    shares, turn = np.linalg.eigh(white.T @ one @ white)
    filters = (white @ turn).T
    picked = [*range(k), *range(len(shares) - k, len(shares))]
    return [(float(shares[i]), filters[i].tolist()) for i in picked]


def grid_search(df: DataFrame, column: str, y: str, grid: list[dict[str, float]], k: int = 3, patience: int = 2) -> DataFrame:
    """point (place in the grid), key, fold, y, yhat: cross-validated predictions of the grid points in turn.

    A point is a dictionary of parameters of the regression.  After `patience` points in a row that are no
    better than the best before, by the share of right predictions, the rest is left out.
    """
    ready = vectors(folds(df, F.col(y), "key", k), column).withColumn("label", F.col(y).cast("double"))
    out, best, waited = None, -1.0, 0
    for n, point in enumerate(grid):
        parts = None
        for f in range(k):
            model = LogisticRegression(maxIter=20, **point).fit(ready.filter(F.col("fold") != f))
            part = model.transform(ready.filter(F.col("fold") == f)).select(F.lit(n).alias("point"), "key", "fold", y, F.col("prediction").cast("int").alias("yhat"))
            parts = part if parts is None else parts.unionByName(part)
        right = parts.agg(F.avg((F.col(y) == F.col("yhat")).cast("double"))).first()[0] or 0.0
        out = parts if out is None else out.unionByName(parts)
        best, waited = (right, 0) if right > best else (best, waited + 1)
        if waited >= patience:
            break
    return out
