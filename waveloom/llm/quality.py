"""Quality by compression: a text that a dictionary of good texts shrinks more than one of bad texts is good.

Two zstandard dictionaries are built from labelled good and bad text.  Each text is compressed in
blocks (so that the dictionary matters along the whole text) with both; the normalised difference of
the sizes, calibrated by a logistic fit on other labelled texts, is the score.

Defined results: null and empty texts are one empty block and get the score of no evidence;
repeated rows get equal scores; with labels of one class only, every score is that class's share.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, map_texts, sampled_texts

ADDED = T.StructType([T.StructField("score", T.DoubleType())])
#: Bounds of the fit: labelled texts of each class, blocks taken from each, bytes of a block.
FIT_TEXTS, FIT_BLOCKS, BLOCK = 2400, 4, 1024
DICT_BYTES, LEVEL = 112_640, 3
FOLDS, HELD_OUT = 4, 2


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    prior: float


def blocks(text: str, size: int = BLOCK) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + size] for i in range(0, len(raw), size)] or [b""]


class Sizes:
    """Compressed sizes of a text under both dictionaries, and from them the inputs of the score: the difference
    of the sizes alone, normalised by both sizes, by the text's length, by a length that lets short texts count
    less, and cut off where it is large."""

    def __init__(self, model: Model):
        def compressor(raw: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = compressor(model.good).compress, compressor(model.bad).compress

    def features(self, text: str) -> list[float]:
        good = bad = raw = 0
        for b in blocks(text):
            good, bad, raw = good + len(self.good(b)), bad + len(self.bad(b)), raw + len(b)
        diff = bad - good
        share = diff / max(raw, 1)
        return [1.0, 10 * diff / (bad + good), 10 * share, 10 * diff / (raw + 200.0), math.tanh(10 * share)]


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + l2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(samples: list[bytes]) -> bytes:
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 4)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the text itself serves
        return b"".join(samples)[:DICT_BYTES] or b" " * 8


def fit(docs: DataFrame, labels: DataFrame, held_out: F.Column | None = None) -> Model:
    """Fit on at most FIT_TEXTS labelled texts of each class outside the fold `held_out`.

    The first half of each class (in an order given by a hash; equal texts count once) makes the
    dictionaries, the second half the calibration.
    """
    rows = labels.filter(~held_out) if held_out is not None else labels
    by_class: dict[int, list[str]] = {}
    for q in (0, 1):
        some = sampled_texts(docs, rows, F.col("quality") == q, FIT_TEXTS, f"quality{q}")
        pieces = _pieces(some).collect()
        by_class[q] = [list(p) for _, p in sorted({r["digest"]: (r["digest"], tuple(r["pieces"])) for r in pieces}.values())]
    total = labels.filter(F.col("quality").isNotNull()) if held_out is None else rows.filter(F.col("quality").isNotNull())
    counts = {r["quality"]: r["n"] for r in total.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.5
    if not (by_class[0] and by_class[1]):
        return Model(b"", b"", [], prior)
    flat = lambda texts: [b for t in texts for b in t]
    halves = {q: (v[: (len(v) + 1) // 2], v[(len(v) + 1) // 2 :] or v) for q, v in by_class.items()}
    model = Model(_dictionary(flat(halves[1][0])), _dictionary(flat(halves[0][0])), [], prior)
    sizes = Sizes(model)
    x = np.array([sizes.features(b"".join(t).decode(errors="ignore")) for q in (0, 1) for t in halves[q][1]])
    y = np.array([float(q) for q in (0, 1) for _ in halves[q][1]])
    # classes are sampled evenly; weighting by repetition would cost time, so the intercept is moved to the true share
    w = _logistic(x, y)
    share = y.mean()
    w[0] += math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - math.log(share / (1 - share))
    model.weights = w.tolist()
    return model


def _pieces(texts: DataFrame) -> DataFrame:
    """Blocks spread evenly over each sampled text, and a digest of the whole text."""
    import hashlib

    added = T.StructType([T.StructField("digest", T.StringType()), T.StructField("pieces", T.ArrayType(T.BinaryType()))])

    def some(text: str) -> list[bytes]:
        b = blocks(text)
        return [b[i] for i in sorted({round(k * (len(b) - 1) / max(1, FIT_BLOCKS - 1)) for k in range(FIT_BLOCKS)})]

    def work(batch: list[str]) -> dict:
        return {"digest": [hashlib.md5(t.encode()).hexdigest() for t in batch], "pieces": [some(t) for t in batch]}

    return map_texts(texts, "text", added, lambda: work, keep=[])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `score` (0 to 1, higher: better) from each whole text."""
    if not model.weights:
        kept = [n for n in docs.columns if n.lower() != "score" and (keep is None or n in keep)]
        return docs.select(*[F.col(f"`{n}`") for n in kept], F.lit(float(model.prior)).alias("score"))

    def make():
        sizes, weights = Sizes(model), np.array(model.weights)

        def work(texts: list[str]) -> dict:
            z = np.array([sizes.features(t) for t in texts]) @ weights
            return {"score": (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()}

        return work

    return map_texts(docs, text, ADDED, make, keep)


def contract(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    held = fold("doc_id", FOLDS) == HELD_OUT
    scored = score(docs, fit(docs, labels, held), keep=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
