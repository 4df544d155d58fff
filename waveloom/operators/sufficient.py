"""Many linear classifiers from one pass of sufficient statistics, and one pass that scores them all.

A linear discriminant needs class counts, class sums and the second moments of all rows.  The latter do not depend
on the labels, so a permutation of the labels costs only another set of class sums; training rows of a fold are
all rows minus the fold; a subset of the features is a part of the same matrices.  What leaves a task are these
sums: folds * permutations * classes * features numbers, however many rows there are.

Labels are permuted within blocks of rows (given by a hash of the key), which keeps the null hypothesis of
exchangeable labels, needs no join and gives the same permutations in every pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a block in which labels are permuted; rows scored at once; bytes of models that go to all tasks at most.
BLOCK, ROWS, MODEL_BYTES = 4096, 1024, 256 << 20


def prepared(df: DataFrame, column: str, y: str, key: str = "key", fold: str = "fold", block: int = BLOCK) -> DataFrame:
    """key, fold, y (place of the class), x and block, the rows of a block together; labels of any type become places in `classes`."""
    n = df.count()
    rows = df.select(F.col(key).alias("key"), F.col(fold).cast("int").alias("fold"), F.col(y).alias("y"), F.transform(column, lambda v: v.cast("double")).alias("x"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n // block)))))
    return rows.repartition("block").sortWithinPartitions("block", "key")


def classes(df: DataFrame, y: str) -> list:
    """The classes in order; as many rows as there are classes."""
    return sorted(r[0] for r in df.select(y).distinct().collect())


def _blocks(batches: Iterable[pa.RecordBatch], names: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, fold, class, vectors) of consecutive rows with one block."""
    held: list[pa.Table] = []

    def done(parts: list[pa.Table]):
        t = pa.concat_tables(parts).combine_chunks()
        x = t.column("x").combine_chunks()
        flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        return t.column("block")[0].as_py(), t.column("fold").to_numpy(), np.searchsorted(names, t.column("y").to_numpy()), flat

    for batch in batches:
        table = pa.Table.from_batches([batch])
        block = table.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b == a:
                continue
            if held and held[0].column("block")[0].as_py() != int(block[a]):
                yield done(held)
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield done(held)


def shuffles(y: np.ndarray, block: int, permutations: int, seed: int) -> np.ndarray:
    """Labels of one block: the real ones first, then each permutation of them."""
    return np.stack([y] + [y[np.random.default_rng([seed, block & ((1 << 63) - 1), p]).permutation(len(y))] for p in range(1, permutations + 1)])


@dataclass
class Statistics:
    """n: folds x permutations x classes; sums: the same x features; moments: folds x features x features (all about `center`)."""

    names: list
    center: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    moments: np.ndarray

    def discriminant(self, permutation: int = 0, without: int | None = None, features: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Weights (classes x features, 0 for those left out) and offsets, trained on all folds but one."""
        keep = [f for f in range(len(self.n)) if f != without]
        n, sums, moments = self.n[keep, permutation].sum(axis=0), self.sums[keep, permutation].sum(axis=0), self.moments[keep].sum(axis=0)
        some = np.arange(len(self.center)) if features is None else np.array(features)
        total = n.sum()
        means = (sums / np.maximum(n, 1)[:, None])[:, some]
        pooled = (moments[np.ix_(some, some)] - (means.T * n) @ means) / total
        inverse = np.linalg.pinv(pooled, hermitian=True)
        w = np.zeros((len(n), len(self.center)))
        w[:, some] = means @ inverse
        with np.errstate(divide="ignore"):
            b = -0.5 * (w[:, some] * means).sum(axis=1) + np.log(n / total)  # a class without rows is never chosen
        return w, b - w @ self.center


def statistics(rows: DataFrame, names: list, folds: int, permutations: int = 0, seed: int = 0) -> Statistics:
    """One pass over the rows of :func:`prepared`."""
    center = rows.select(Summarizer.mean(array_to_vector("x"))).first()[0].toArray()
    d, shape = len(center), (folds, permutations + 1, len(names))

    def run(batches):
        n, sums, moments = np.zeros(shape, np.int64), np.zeros((*shape, d)), np.zeros((folds, d, d))
        for block, fold, y, x in _blocks(batches, names):
            x, labels = x - center, shuffles(y, block, permutations, seed)
            for f in np.unique(fold):
                at = fold == f
                moments[f] += x[at].T @ x[at]
                for c in range(len(names)):
                    mine = labels[:, at] == c
                    n[f, :, c] += mine.sum(axis=1)
                    sums[f, :, c] += mine.astype(np.float64) @ x[at]
        at = [tuple(i) for i in np.argwhere(n > 0)]
        live = [f for f in range(folds) if moments[f].any()]
        heads = [(int(f), int(p), int(c), int(n[f, p, c])) for f, p, c in at] + [(f, -1, -1, 0) for f in live]
        data = [sums[i] for i in at] + [moments[f].ravel() for f in live]
        columns = [pa.array([h[k] for h in heads], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([v.tolist() for v in data], pa.list_(pa.float64()))], names=["fold", "perm", "cls", "n", "vec"])

    parts = rows.mapInArrow(run, "fold int, perm int, cls int, n long, vec array<double>")
    whole = parts.groupBy("fold", "perm", "cls").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec"))
    out = Statistics(names, center, np.zeros(shape, np.int64), np.zeros((*shape, d)), np.zeros((folds, d, d)))
    for r in whole.toLocalIterator():  # the size of the models
        if r["perm"] < 0:
            out.moments[r["fold"]] = np.array(r["vec"]).reshape(d, d)
        else:
            out.n[r["fold"], r["perm"], r["cls"]], out.sums[r["fold"], r["perm"], r["cls"]] = r["n"], r["vec"]
    return out


def confusions(rows: DataFrame, names: list, models: list[list[tuple[np.ndarray, np.ndarray]]], labels: list[int] | None = None, seed: int = 0) -> DataFrame:
    """model, fold, y, yhat, n: every model on all rows in one pass; models[m][f] are the weights and offsets that score the rows of fold f,
    labels[m] the permutation whose labels they are compared with."""
    labels = labels or [0] * len(models)
    w = np.array([[m[0] for m in per_fold] for per_fold in models])  # models x folds x classes x features
    b = np.array([[m[1] for m in per_fold] for per_fold in models])
    if w.nbytes > MODEL_BYTES:
        raise ValueError(f"{w.nbytes} bytes of models; score them in parts")
    sent = rows.sparkSession.sparkContext.broadcast((w, b))
    k, permutations = len(names), max(labels)
    y, kind = rows.schema["y"].dataType.simpleString(), to_arrow_type(rows.schema["y"].dataType)

    def run(batches):
        w, b = sent.value
        count = np.zeros((*w.shape[:2], k, k), np.int64)
        for block, fold, y, x in _blocks(batches, names):
            truth = shuffles(y, block, permutations, seed)[labels]
            for f in np.unique(fold):
                at = np.flatnonzero(fold == f)
                for a in range(0, len(at), ROWS):
                    some = at[a : a + ROWS]
                    best = (np.einsum("nd,mcd->nmc", x[some], w[:, f], optimize=True) + b[:, f]).argmax(axis=2)
                    cell = (np.arange(len(w))[None, :] * k + truth[:, some].T) * k + best
                    count[:, f] += np.bincount(cell.ravel(), minlength=len(w) * k * k).reshape(len(w), k, k)
        at = np.argwhere(count > 0)
        columns = [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32())] + [pa.array([names[i] for i in at[:, j]], kind) for j in (2, 3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(count[tuple(at.T)])], names=["model", "fold", "y", "yhat", "n"])

    return rows.mapInArrow(run, f"model int, fold int, y {y}, yhat {y}, n long").groupBy("model", "fold", "y", "yhat").agg(F.sum("n").alias("n"))


def permutation_test(df: DataFrame, column: str, y: str, folds: int = 4, permutations: int = 100, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """model (0: the real labels, then each permutation), bacc: cross-validated balanced accuracy of all of them; two passes in all."""
    from .report import balanced_accuracy

    names = classes(df, y)
    rows = prepared(df, column, y, block=block)
    stats = statistics(rows, names, folds, permutations, seed)
    models = [[stats.discriminant(p, f) for f in range(folds)] for p in range(permutations + 1)]
    return balanced_accuracy(confusions(rows, names, models, list(range(permutations + 1)), seed).groupBy("model", "y", "yhat").agg(F.sum("n").alias("n")), ["model"])


def p_value(scores: DataFrame, score: str = "bacc") -> DataFrame:
    """score, chance (mean of the permutations), n_permutations, p = (1 + permutations that reach the score) / (1 + permutations)."""
    real = scores.filter("model = 0").select(F.col(score).alias("score"))
    rest = scores.filter("model > 0").crossJoin(F.broadcast(real))  # one row
    out = rest.agg(F.first("score").alias("score"), F.avg(score).alias("chance"), F.count("*").alias("n_permutations"), F.count_if(F.col(score) >= F.col("score") - 1e-12).alias("__up"))
    return out.select("score", "chance", "n_permutations", ((1 + F.col("__up")) / (1 + F.col("n_permutations"))).alias("p"))


def dummy(df: DataFrame, y: str, fold: str = "fold") -> DataFrame:
    """fold, bacc: what guessing by the shares of the classes in the other folds reaches on average, from class counts alone."""
    n = df.groupBy(F.col(fold).alias("fold"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    total = n.groupBy("y").agg(F.sum("n").alias("all"))  # one row a class
    rest = n.join(F.broadcast(total), "y").withColumn("left", F.col("all") - F.col("n"))
    whole = df.agg(F.count("*").alias("rows"))
    sizes = n.groupBy("fold").agg(F.sum("n").alias("own")).crossJoin(F.broadcast(whole))  # one row
    # a class's recall is the chance that its name is drawn; the mean goes over the classes of the fold
    return rest.join(sizes, "fold").groupBy("fold").agg(F.avg(F.col("left") / (F.col("rows") - F.col("own"))).alias("bacc"))


def versions(df: DataFrame, column: str, y: str, folds: int = 4, seed: int = 0) -> DataFrame:
    """version, y, yhat, n of a discriminant: on its own training rows, against shuffled labels, trained on shuffled labels, cross-validated,
    and with the coefficients averaged over the folds."""
    names = classes(df, y)
    rows = prepared(df, column, y)
    stats = statistics(rows, names, folds, 1, seed)
    whole, shuffled = stats.discriminant(0), stats.discriminant(1)
    per_fold = [stats.discriminant(0, f) for f in range(folds)]
    mean = tuple(np.mean([m[i] for m in per_fold], axis=0) for i in (0, 1))
    listed = {"all rows": ([whole] * folds, 0), "check on shuffled": ([whole] * folds, 1), "trained on shuffled": ([shuffled] * folds, 1), "cross-validated": (per_fold, 0), "mean of folds": ([mean] * folds, 0)}
    found = confusions(rows, names, [m for m, _ in listed.values()], [p for _, p in listed.values()], seed)
    name = F.element_at(F.array(*map(F.lit, listed)), F.col("model") + 1).alias("version")
    return found.groupBy(name, "y", "yhat").agg(F.sum("n").alias("n"))


def subsets(df: DataFrame, column: str, y: str, features: list[list[int]], folds: int = 4) -> DataFrame:
    """model (place in `features`), bacc: held-out balanced accuracy of discriminants on subsets of the features (places from 0), all from two passes."""
    from .report import balanced_accuracy

    names = classes(df, y)
    rows = prepared(df, column, y)
    stats = statistics(rows, names, folds)
    found = confusions(rows, names, [[stats.discriminant(0, f, some) for f in range(folds)] for some in features])
    return balanced_accuracy(found.groupBy("model", "y", "yhat").agg(F.sum("n").alias("n")), ["model"])


def smallest_sufficient(df: DataFrame, column: str, y: str, order: list[int], steps: list[int], drop: float = 0.02, converged: float = 0.01, folds: int = 4) -> DataFrame:
    """n_features, bacc, chosen: held-out scores of the first n features in `order` for each step (the last one: all), and the smallest n
    that stays within `drop` of the score with all and from which the next step gains no more than `converged`."""
    sizes = sorted({*(s for s in steps if s < len(order)), len(order)})
    scores = subsets(df, column, y, [order[:n] for n in sizes], folds)
    from pyspark.sql import Window as W

    over = W.orderBy("model")  # one row a step
    found = scores.withColumns({"__full": F.last("bacc").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "__next": F.coalesce(F.lead("bacc").over(over), "bacc")})
    good = (F.col("bacc") >= F.col("__full") - drop) & (F.col("__next") - F.col("bacc") <= converged)
    first = F.min(F.when(good, F.col("model"))).over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return found.select(F.element_at(F.array(*map(F.lit, sizes)), F.col("model") + 1).alias("n_features"), "bacc", (F.col("model") == first).alias("chosen"))


def group_folds(df: DataFrame, group: str, y: str, k: int) -> DataFrame:
    """group, fold: whole groups dealt to folds so that each fold's class counts stay near a k-th of all.

    The histograms of the groups (one row a group and class) are aggregated in Spark; groups go, the most uneven first, to the fold
    that leaves the spread of each class's shares over the folds least.  No share of a class in a fold is
    further from 1 / k than the largest share that one group has of it.
    """
    counts = df.groupBy(F.col(group).alias("g"), F.col(y).alias("y")).agg(F.count("*").alias("n")).collect()
    names = sorted({r["y"] for r in counts})
    groups: dict = {}
    for r in counts:
        groups.setdefault(r["g"], np.zeros(len(names)))[names.index(r["y"])] = r["n"]
    total, held = sum(groups.values()), np.zeros((k, len(names)))
    out = []
    for g, n in sorted(groups.items(), key=lambda x: (-x[1].std(), -x[1].sum(), str(x[0]))):
        spread = []
        for f in range(k):
            held[f] += n
            spread.append((round(float((held / total).std(axis=0).mean()), 12), float(held[f].sum()), f))
            held[f] -= n
        f = min(spread)[2]
        held[f] += n
        out.append((g, f))
    return df.sparkSession.createDataFrame(out, f"{group} {df.schema[group].dataType.simpleString()}, fold int")


def nested(df: DataFrame, y: str, key: str, k: int) -> DataFrame:
    """key, outer, role: for each outer fold its rows ('test') and a stratified k-th of the others ('inner test') apart from the rest ('train')."""
    from .learn import folds

    placed = folds(df.select(key, y), F.col(y), key, k)
    out = placed.select(key, F.col("fold").alias("outer"), F.lit("test").alias("role"))
    for f in range(k):
        rest = folds(placed.filter(F.col("fold") != f).drop("fold"), F.col(y), key, k)
        out = out.unionByName(rest.select(key, F.lit(f).alias("outer"), F.when(F.col("fold") == 0, "inner test").otherwise("train").alias("role")))
    return out
