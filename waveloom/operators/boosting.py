"""Boosting on histograms: multi-class trees, and additive models with pairs of features.

Features are binned once, so a row is a vector of small numbers.  What a task brings back are sums of gradients by
class, node, feature and bin (or by cell of a pair of features): the size of the model, however many rows there
are.  Trees and shape functions live on the driver and go to the tasks; rows are never shuffled between rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that a worker handles at once.
ROWS = 8192


def edges(df: DataFrame, column: str, bins: int) -> np.ndarray:
    """features x (bins - 1) upper edges near the quantiles, from one mergeable sketch a feature; features * bins numbers in all."""
    d = len(df.select(column).first()[0])
    shares = [k / bins for k in range(1, bins)]
    found = df.agg(*[F.percentile_approx(F.col(column)[i].cast("double"), shares, 100 * bins).alias(f"e{i}") for i in range(d)]).first()
    return np.array([list(e) for e in found])


def _cell(x: Column, e: Column) -> Column:
    return F.size(F.filter(e, lambda t: x > t)).cast("int")


def binned(df: DataFrame, column: str, limits: np.ndarray, keep: list[str]) -> DataFrame:
    """keep.., b: the number of edges below each component."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in limits])
    return df.select(*keep, F.zip_with(F.transform(column, lambda v: v.cast("double")), table, _cell).alias("b"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _summed(rows: DataFrame, run, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of the arrays that `run` gives, sent by their first axis; Spark adds them up before the driver sees them."""
    flat = int(np.prod(shape[1:]))

    def send(batches):
        total = run(batches).reshape(shape[0], flat)
        live = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([total[i].tolist() for i in live], pa.list_(pa.float64()))], names=["part", "vec"])

    parts = rows.mapInArrow(send, "part int, vec array<double>")
    out = np.zeros((shape[0], flat))
    for r in parts.groupBy("part").agg(vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("vec")).toLocalIterator():
        out[r["part"]] = r["vec"]
    return out.reshape(shape)


# -- trees ----------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes of a full binary tree by level (children of i: 2i + 1 and 2i + 2): feature (-1: a leaf), last bin that goes left, value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def node(self, b: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row has reached after at most `depth` steps."""
        at = np.zeros(len(b), np.int64)
        for _ in range(depth):
            f = self.feature[at]
            right = b[np.arange(len(b)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class Booster:
    names: list
    limits: np.ndarray
    depth: int
    rate: float
    trees: list[list[Tree]] = field(default_factory=list)  # rounds x classes
    gain: np.ndarray | None = None  # of each feature, summed over all splits

    def margins(self, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(b), len(self.names)))
        for one in self.trees:
            for c, tree in enumerate(one):
                out[:, c] += tree.value[tree.node(b, self.depth)]
        return out


def _shares(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted softmax loss."""
    p = _shares(margins)
    g = w[:, None] * (p - (y[:, None] == np.arange(margins.shape[1])))
    return g, w[:, None] * np.maximum(2 * p * (1 - p), 1e-16)


def best_splits(h: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For histograms (nodes, features, bins, 2) of first and second derivatives: gain, feature and last left bin of each node's best split."""
    left = np.cumsum(h, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + l2)
    gain = (score(left) + score(right) - score(total)) / 2
    gain[(left[..., 1] < least) | (right[..., 1] < least)] = -np.inf
    flat = gain.reshape(len(h), -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(len(h)), best], best // h.shape[2], best % h.shape[2]


def boosted(
    df: DataFrame, column: str, y: str, weights: dict | None = None, rounds: int = 10, depth: int = 3, rate: float = 0.3, l2: float = 1.0, least: float = 1.0, bins: int = 32
) -> Booster:
    """Trees for each class in every round (softmax loss, class weights); one aggregation a level for all classes and nodes at once.

    A node is split where the gain is largest and above 0, if both sides hold second derivatives of `least` or more.
    """
    names = sorted(r[0] for r in df.select(y).distinct().collect())  # one row a class
    limits = edges(df, column, bins)
    rows = binned(df, column, limits, [F.col(y).alias("y")])
    weight = np.array([(weights or {}).get(c, 1.0) for c in names])
    d, k, model = len(limits), len(names), Booster(names, limits, depth, rate)
    model.gain = np.zeros(d)
    for _ in range(rounds):
        grown = [Tree.empty(depth) for _ in names]
        for level in range(depth + 1):
            first, n = 2**level - 1, 2**level
            done = model.trees

            def run(batches, level=level, first=first, n=n, grown=grown, done=done):
                now = Booster(names, limits, depth, rate, done)
                out = np.zeros((k, n, d, bins, 2))
                for batch in _slices(batches):
                    b, truth = _matrix(batch, "b"), np.searchsorted(names, batch.column("y").to_numpy(zero_copy_only=False))
                    g, h = gradients(now.margins(b), truth, weight[truth])
                    for c in range(k):
                        at = grown[c].node(b, level) - first
                        live = np.flatnonzero(at >= 0)
                        cell = ((at[live, None] * d + np.arange(d)) * bins + b[live]).ravel()
                        for j, x in enumerate((g, h)):
                            out[c, ..., j] += np.bincount(cell, np.repeat(x[live, c], d), n * d * bins).reshape(n, d, bins)
                return out

            sums = _summed(rows, run, (k, n, d, bins, 2))
            for c, tree in enumerate(grown):
                total = sums[c, :, 0].sum(axis=1)  # every feature's bins hold all rows of a node
                tree.value[first : first + n] = -rate * total[:, 0] / (total[:, 1] + l2)
                if level == depth:
                    continue
                gain, feature, cut = best_splits(sums[c], l2, least)
                for i in np.flatnonzero((gain > 1e-12) & (total[:, 1] > 0)):
                    tree.feature[first + i], tree.cut[first + i] = feature[i], cut[i]
                    model.gain[feature[i]] += gain[i]
        model.trees = [*model.trees, grown]
    return model


def predicted(df: DataFrame, column: str, model: Booster, keep: list[str]) -> DataFrame:
    """keep.., yhat, shares: the most likely class, and each class's share."""
    kind = df.select(F.lit(model.names[0])).schema[0].dataType
    label = T.LongType() if isinstance(kind, T.IntegerType) else kind
    rows = binned(df, column, model.limits, keep)

    def run(batches):
        for batch in _slices(batches):
            p = _shares(model.margins(_matrix(batch, "b")))
            best = pa.array([model.names[i] for i in p.argmax(axis=1)], to_arrow_type(label))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), best, pa.array(p.tolist(), pa.list_(pa.float64()))], names=[*keep, "yhat", "shares"])

    out = T.StructType([rows.schema[c] for c in keep] + [T.StructField("yhat", label), T.StructField("shares", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, out)


# -- all relevant features ------------------------------------------------------------------------


def shadowed(df: DataFrame, column: str, y: str, key: str, seed: int, block: int = 4096) -> DataFrame:
    """y, v: each vector with its shadow behind it, whose components are permuted among the rows of a block, each on its own."""
    from .sufficient import prepared

    rows = prepared(df.withColumn("__fold", F.lit(0)), column, y, key, "__fold", block)

    def run(batches):
        held, last = [], None

        def done():
            x = np.concatenate([_matrix(b, "x") for b in held])
            other = np.random.default_rng([seed, last & ((1 << 63) - 1)]).permuted(x, axis=0)
            labels = pa.concat_arrays([b.column("y") for b in held])
            flat = pa.array(np.concatenate([x, other], axis=1).ravel())
            ends = pa.array(np.arange(0, 2 * x.size + 1, 2 * x.shape[1], dtype=np.int32))
            return pa.RecordBatch.from_arrays([labels, pa.ListArray.from_arrays(ends, flat)], names=["y", "v"])

        for batch in batches:
            at = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and last != int(at[a]):
                    yield done()
                    held = []
                held.append(batch.slice(a, b - a))
                last = int(at[a])
        if held:
            yield done()

    return rows.mapInArrow(run, T.StructType([rows.schema["y"], T.StructField("v", T.ArrayType(T.DoubleType()))]))


def tails(hits: int, rounds: int) -> tuple[float, float]:
    """Chances of at least and of at most so many hits among fair tosses."""
    from math import comb

    up = sum(comb(rounds, k) for k in range(hits, rounds + 1)) / 2**rounds
    return up, sum(comb(rounds, k) for k in range(hits + 1)) / 2**rounds


def all_relevant(df: DataFrame, column: str, y: str, key: str = "key", tests: int = 12, alpha: float = 0.05, **fit: object) -> list[tuple[int, int, str]]:
    """(feature from 1, hits, decision): in each of `tests` fits a feature hits if its gain exceeds that of every shadow; as many hits
    as chance would give with less than alpha (divided among the features) confirm it, as few reject it, else it stays tentative."""
    hits = None
    for t in range(tests):
        gain = boosted(shadowed(df, column, y, key, t), "v", "y", **fit).gain
        d = len(gain) // 2
        one = gain[:d] > gain[d:].max()
        hits = one.astype(int) if hits is None else hits + one
    out = []
    for i, h in enumerate(hits.tolist()):
        up, down = tails(h, tests)
        out.append((i + 1, h, "confirmed" if up * len(hits) < alpha else "rejected" if down * len(hits) < alpha else "tentative"))
    return out


# -- additive models ------------------------------------------------------------------------------


@dataclass
class Additive:
    """One model a fold: offset, shape functions (features x bins), and a table for each chosen pair of features."""

    limits: np.ndarray
    offset: np.ndarray  # folds
    shapes: np.ndarray  # folds x features x bins
    pairs: list[tuple[int, int]] = field(default_factory=list)
    tables: np.ndarray | None = None  # folds x pairs x bins x bins

    def margins(self, b: np.ndarray) -> np.ndarray:
        """rows x folds."""
        d = b.shape[1]
        out = self.offset[None, :] + self.shapes[:, np.arange(d), b].sum(axis=2).T
        for p, (i, j) in enumerate(self.pairs):
            out = out + self.tables[:, p, b[:, i], b[:, j]].T
        return out

    def parts(self, b: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """rows x (features + pairs): what each adds to the score by the model that did not see the row."""
        rows = np.arange(len(b))
        single = self.shapes[fold[:, None], np.arange(b.shape[1])[None, :], b]
        both = [self.tables[fold, p, b[rows, i], b[rows, j]] for p, (i, j) in enumerate(self.pairs)]
        return np.concatenate([single, np.array(both).T.reshape(len(b), len(self.pairs))], axis=1)


def pair_gain(n: np.ndarray, s: np.ndarray) -> float:
    """Largest share of squared residuals that one cut of each of two features explains: cells of counts and sums, cumulated in both
    directions, give every four-way split."""
    cn, cs = n.cumsum(0).cumsum(1), s.cumsum(0).cumsum(1)
    best = 0.0
    total = lambda a, b: np.divide(a * a, b, out=np.zeros_like(a), where=b > 0)
    for k in range(len(n) - 1):
        quarter = lambda c: (c[k, :-1], c[k, -1] - c[k, :-1], c[-1, :-1] - c[k, :-1], c[-1, -1] - c[-1, :-1] - c[k, -1] + c[k, :-1])  # noqa: E731, B023
        gain = sum(total(a, b) for a, b in zip(quarter(cs), quarter(cn), strict=True))
        best = max(best, float(gain.max(initial=0.0)))
    return best


def additive(df: DataFrame, column: str, y: str, fold: str, folds: int, bins: int = 8, rounds: int = 8, rate: float = 0.5, pairs: int = 3, l2: float = 1.0) -> tuple[Additive, list[tuple[int, int, float]]]:
    """(model, ranked pairs): shape functions of all features and of the `pairs` best pairs, one model without each fold.

    y is 0 or 1 (logistic loss).  A round is one aggregation of gradients by feature and bin for all folds; all features
    see the margins of the round before, so each step is divided among them.  Pairs are ranked by what a cut of
    both features explains of the residuals beyond the single features' own cuts.
    """
    limits = edges(df, column, bins)
    d = len(limits)
    rows = binned(df, column, limits, [F.col(y).cast("int").alias("y"), F.col(fold).cast("int").alias("fold")])
    n = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}  # folds * 2
    ones = np.array([sum(v for (f, c), v in n.items() if f != g and c == 1) for g in range(folds)], float)
    every = np.array([sum(v for (f, _), v in n.items() if f != g) for g in range(folds)], float)
    model = Additive(limits, np.log((ones + 0.5) / (every - ones + 0.5)), np.zeros((folds, d, bins)))

    def seen(batch, now):
        """Bins, residuals and second derivatives by fold's model; 0 where the model leaves the row's fold out."""
        b, truth, own = _matrix(batch, "b"), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        p = 1 / (1 + np.exp(-now.margins(b)))
        use = own[:, None] != np.arange(folds)[None, :]
        return b, (truth[:, None] - p) * use, p * (1 - p) * use

    for _ in range(rounds):
        def singles(batches, now=model):
            out = np.zeros((folds, d, bins, 2))
            for batch in _slices(batches):
                b, *sides = seen(batch, now)
                cell = (np.arange(d) * bins + b).ravel()
                for f in range(folds):
                    for j, x in enumerate(sides):
                        out[f, ..., j] += np.bincount(cell, np.repeat(x[:, f], d), d * bins).reshape(d, bins)
            return out

        sums = _summed(rows, singles, (folds, d, bins, 2))
        model = Additive(limits, model.offset, model.shapes + rate / d * sums[..., 0] / (sums[..., 1] + l2))

    def cells(batches, now=model):
        out = np.zeros((d, d, bins, bins, 2))
        for batch in _slices(batches):
            b, r, _ = seen(batch, now)
            value = r.sum(axis=1) / max(1, folds - 1)
            for i in range(d - 1):
                at = ((np.arange(i + 1, d) * bins + b[:, i : i + 1]) * bins + b[:, i + 1 :]).ravel()
                for j, x in enumerate((np.ones(len(b)), value)):
                    out[i, ..., j] += np.bincount(at, np.repeat(x, d - i - 1), d * bins * bins).reshape(d, bins, bins)
        return out

    grid = _summed(rows, cells, (d, d, bins, bins, 2))

    def alone(n, s):
        cn, cs = n.cumsum()[:-1], s.cumsum()[:-1]
        left, right = np.divide(cs**2, cn, out=np.zeros_like(cs), where=cn > 0), np.divide((s.sum() - cs) ** 2, n.sum() - cn, out=np.zeros_like(cs), where=n.sum() - cn > 0)
        return float((left + right).max(initial=0.0))

    ranked = []
    for i in range(d):
        for j in range(i + 1, d):
            c, s = grid[i, j, ..., 0], grid[i, j, ..., 1]
            single = max(alone(c.sum(1), s.sum(1)), alone(c.sum(0), s.sum(0)))
            ranked.append((i, j, pair_gain(c, s) - single))
    ranked.sort(key=lambda r: (-r[2], r[0], r[1]))
    chosen = [(i, j) for i, j, _ in ranked[:pairs]]
    model = Additive(limits, model.offset, model.shapes, chosen, np.zeros((folds, len(chosen), bins, bins)))
    for _ in range(rounds if chosen else 0):
        def doubles(batches, now=model):
            out = np.zeros((folds, len(chosen), bins, bins, 2))
            for batch in _slices(batches):
                b, *sides = seen(batch, now)
                for p, (i, j) in enumerate(chosen):
                    cell = b[:, i] * bins + b[:, j]
                    for f in range(folds):
                        for k, x in enumerate(sides):
                            out[f, p, ..., k] += np.bincount(cell, x[:, f], bins * bins).reshape(bins, bins)
            return out

        sums = _summed(rows, doubles, (folds, len(chosen), bins, bins, 2))
        step = rate / len(chosen) * sums[..., 0] / (sums[..., 1] + l2)
        model = Additive(limits, model.offset, model.shapes, chosen, model.tables + step)
    return model, ranked


def explained(df: DataFrame, column: str, model: Additive, fold: str, keep: list[str]) -> DataFrame:
    """keep.., feat ('f1', .., 'f1 x f2', .., 'intercept'), score: the exact parts of each row's held-out score."""
    d = len(model.limits)
    names = [f"f{i + 1}" for i in range(d)] + [f"f{i + 1} x f{j + 1}" for i, j in model.pairs] + ["intercept"]
    rows = binned(df, column, model.limits, [*keep, F.col(fold).cast("int").alias("__fold")])

    def run(batches):
        for batch in _slices(batches):
            own = batch.column("__fold").to_numpy()
            parts = np.concatenate([model.parts(_matrix(batch, "b"), own), model.offset[own][:, None]], axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(parts.tolist(), pa.list_(pa.float64()))], names=[*keep, "parts"])

    out = T.StructType([rows.schema[c] for c in keep] + [T.StructField("parts", T.ArrayType(T.DoubleType()))])
    listed = rows.mapInArrow(run, out).select(*keep, F.posexplode("parts").alias("i", "score"))
    return listed.select(*keep, F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("feat"), "score")
