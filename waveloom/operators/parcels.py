"""Sources of a parcel reduced to their principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(samples: DataFrame, members: DataFrame) -> DataFrame:
    """parcel, rec, bin, x: the values of a parcel's sources in their order; bins at which one is absent or null have none."""
    sizes = members.groupBy("parcel").agg(F.count("*").alias("__d"))
    rows = samples.join(members, "ch").filter("v is not null").groupBy("parcel", "rec", "bin").agg(F.array_sort(F.collect_list(F.struct("ch", F.col("v").cast("double").alias("v")))).alias("__x"))
    return rows.join(sizes, "parcel").filter(F.size("__x") == F.col("__d")).select("parcel", "rec", "bin", F.transform("__x", lambda s: s["v"]).alias("x"))


def components(samples: DataFrame, members: DataFrame, share: float, bad: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(parcel, rec, bin, scores; parcel, mean, axes, shares) of the leading components that hold `share` of a parcel's variance.

    `members` (ch, parcel) names the sources of each parcel, some hundreds at most.  One mergeable sum of packed second moments a
    parcel is taken over all recordings without the bins of `bad` (rec, bin); all parcels' eigenproblems are
    solved side by side; every bin, bad ones too, is projected.  An axis points to where its largest entry is positive.
    """
    x = _vectors(samples, members)
    fit = x if bad is None else x.join(bad.select("rec", "bin").distinct(), ["rec", "bin"], "left_anti")
    means = fit.groupBy("parcel").agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("mean"), F.count("*").alias("n"))
    centred = fit.join(means, "parcel").withColumn("d", F.zip_with("x", "mean", lambda a, b: a - b))
    # the upper triangle of d d', row by row
    packed = F.flatten(F.transform("d", lambda a, i: F.transform(F.slice("d", i + 1, F.size("d") - i), lambda b: a * b)))
    moments = centred.groupBy("parcel").agg(vector_to_array(Summarizer.mean(array_to_vector(packed))).alias("m"))
    kind = members.schema["parcel"].dataType.simpleString()

    def solve(batches):
        for batch in batches:
            axes, shares = [], []
            for mean, m in zip(batch.column("mean").to_pylist(), batch.column("m").to_pylist(), strict=True):
                d = len(mean)
                cov = np.zeros((d, d))
                cov[np.triu_indices(d)] = m
                values, turn = np.linalg.eigh(cov + np.triu(cov, 1).T)
                values, turn = np.maximum(values[::-1], 0.0), turn[:, ::-1].T
                part = values / values.sum() if values.sum() > 0 else np.append(1.0, np.zeros(d - 1))
                k = int(np.searchsorted(np.cumsum(part), share - 1e-12) + 1)
                some = turn[: min(k, d)]
                some = some * np.sign(some[np.arange(len(some)), np.abs(some).argmax(axis=1)])[:, None]
                axes.append(some.tolist())
                shares.append(part[: len(some)].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("parcel"), batch.column("mean"), pa.array(axes, pa.list_(pa.list_(pa.float64()))), pa.array(shares, pa.list_(pa.float64()))], names=["parcel", "mean", "axes", "shares"])

    model = means.join(moments, "parcel").select("parcel", "mean", "m").mapInArrow(solve, f"parcel {kind}, mean array<double>, axes array<array<double>>, shares array<double>")
    d = F.zip_with("x", "mean", lambda a, b: a - b)
    inner = lambda axis: F.aggregate(F.zip_with(axis, "d", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scores = x.join(model, "parcel").withColumn("d", d).select("parcel", "rec", "bin", F.transform("axes", inner).alias("scores"))
    return scores, model
