"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and texts whose label is not looked at.  The risk estimator
corrects the unlabelled part by the class prior and is kept from going below zero (Kiryo et al. 2017).
The classifier is linear over the set of a text's words and word beginnings, so it looks at whole texts at any length;
weights are not negative, so that harmless words can't dilute what a long text holds.

Defined results: null and empty texts have no words and get the score of the bias alone; repeated
rows get equal scores and change none, as each document id counts once in the fit; without a confirmed toxic text every
score is next to 0; an empty table gives an empty one; columns named score are replaced, all others stay.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_texts, sampled_texts

ADDED = T.StructType([T.StructField("score", T.DoubleType())])
#: Bounds of the fit: confirmed toxic texts, unlabelled texts.
FIT_TOXIC, FIT_UNLABELLED = 3000, 7000
#: A feature needs so many confirmed texts (all, if there are fewer) to get a weight.
LEAST_TEXTS = 3
#: And so many times the share among unlabelled texts.
LIFT = 1.5
#: Lengths of word beginnings that are features too, for words with changing endings.
STEMS = (4, 5)
FOLDS, HELD_OUT = 5, 0
_WORD = re.compile(r"\w+")


@dataclass
class Model:
    """weights by the hash of a feature."""

    weights: dict[int, float]
    bias: float


def features(text: str) -> set[int]:
    """Hashes of the distinct words of a text, and of the beginnings (marked by *) that longer words share."""
    found = set(_WORD.findall(text.lower()))
    found = found.union(*({w[:n] + "*" for w in found if len(w) > n} for n in STEMS))
    return {crc32(w.encode()) for w in found}


def nnpu(pos: list[np.ndarray], unl: list[np.ndarray], size: int, prior: float, rounds: int = 500, rate: float = 0.1, l1: float = 3e-5) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk of a linear scorer with weights >= 0 by Adam.

    Risk: prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the logistic loss l.
    When the second part is negative, the step goes along its negated gradient alone.
    """
    rows = [*pos, *unl]
    lens = np.array([len(r) for r in rows])
    cols = np.concatenate(rows).astype(np.int32)
    at = np.repeat(np.arange(len(rows), dtype=np.int32), lens)
    is_pos = np.arange(len(rows)) < len(pos)
    n_p, n_u = max(1, len(pos)), max(1, len(unl))
    w, b = np.zeros(size), -1.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        f = np.bincount(at, w[cols], len(rows)) + b
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        negative = np.logaddexp(0, f)
        rest = negative[~is_pos].sum() / n_u - prior * negative[is_pos].sum() / n_p
        g_rest = np.where(is_pos, -prior * s / n_p, s / n_u)
        g = -g_rest if rest < 0 else np.where(is_pos, prior * (s - 1) / n_p, 0) + g_rest
        grad = np.append(np.bincount(cols, g[at], size) + l1 * (w > 0), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(0, w - step[:-1]), b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, held_out: F.Column | None = None, prior: float | None = None) -> Model:
    """Fit on at most FIT_TOXIC confirmed and FIT_UNLABELLED unlabelled texts outside the fold `held_out`.

    The unlabelled texts are drawn from all documents, whether they have a label or not.  Every document id counts once, however
    many rows of either table it has (toxic if one of its labels is).  `prior` is the share of toxic texts among the
    unlabelled; by default the confirmed share of the labelled ids of the training folds.
    """
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.filter(~held_out) if held_out is not None else rows
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    every = docs.select("doc_id").filter(F.col("doc_id").isNotNull())
    every = (every.filter(~held_out) if held_out is not None else every).distinct()
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not counts.get(1):
        return Model({}, -30.0)
    prior = counts[1] / total if prior is None else prior
    bags = {}
    for name, ids, limit in (("p", rows.filter(F.col("toxic") == 1), FIT_TOXIC), ("u", every, FIT_UNLABELLED)):
        # one text an id: of several the first in order
        some = sampled_texts(docs, ids, F.lit(True), limit, f"toxicity-{name}").groupBy("doc_id").agg(F.min("text").alias("text"))
        bags[name] = [np.frombuffer(r["bag"], np.uint32) for r in _bags(some).collect()]
    if not bags["p"]:
        return Model({}, -30.0)
    # weights are not negative, so only what confirmed texts hold more often than others can get one
    known, texts = np.unique(np.concatenate(bags["p"]), return_counts=True)
    held = np.concatenate([np.zeros(0, np.uint32), *bags["u"]])
    others = np.bincount(_places(known, held), minlength=len(known))
    lifted = texts / len(bags["p"]) >= LIFT * others / max(1, len(bags["u"]))
    known = known[lifted & (texts >= min(LEAST_TEXTS, len(bags["p"])))]
    weights, bias = nnpu([_places(known, b) for b in bags["p"]], [_places(known, b) for b in bags["u"]], len(known), prior)
    return Model({int(known[i]): float(weights[i]) for i in np.flatnonzero(weights > 1e-3)}, bias)


def _places(known: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where those of `some` that are known stand in `known` (sorted)."""
    if not len(known):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, some), len(known) - 1)
    return at[known[at] == some]


def _bags(texts: DataFrame) -> DataFrame:
    added = T.StructType([T.StructField("bag", T.BinaryType())])
    return map_texts(texts, "text", added, lambda: lambda batch: {"bag": [np.array(sorted(features(t)), np.uint32).tobytes() for t in batch]}, keep=[])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `score` (0 to 1, higher: likelier toxic) from each whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # bounded by the sampled texts

    def make():
        weights, bias = shared.value
        known = frozenset(weights)

        def work(texts: list[str]) -> dict:
            f = np.array([bias + sum(weights[w] for w in sorted(known.intersection(features(t)))) for t in texts])
            return {"score": (1 / (1 + np.exp(-np.clip(f, -30, 30)))).tolist()}

        return work

    return map_texts(docs, text, ADDED, make, keep)


def contract(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    held = fold("doc_id", FOLDS) == HELD_OUT
    scored = score(docs, fit(docs, labels, held), keep=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
