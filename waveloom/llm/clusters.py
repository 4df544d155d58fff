"""Centroid clustering with n-simplex projection.

The distances of a vector to a few pivots are kept; with the distances between the pivots they place the
vector as the apex of a simplex over the pivots' own.  Of two apexes, the distance with both on one side of the
base is a lower bound of the real distance and the one with both on opposite sides an upper bound.  A
centroid whose lower bound is beyond the least upper bound of all cannot be the nearest; among the others
exact integer distances decide.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no
part (no row); repeated rows are vectors of their own, and so may be several centroids, of which the first
gets their vectors; rows without an id are assigned but do not start a centroid; of equal hashes the lesser
vector comes first; with fewer vectors than centroids each starts one; an empty table gives an empty result;
other columns are ignored.  Components count as floor(256 * x), held within +-2^62; distances and their sums
beyond 2^63 - 1 count as that.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, store
from .vectors import matrix, usable

#: Pivots of a projection; rows that a worker handles at once; largest component.
PIVOTS, ROWS, MOST = 32, 2048, 1 << 62
_LAST = (1 << 63) - 1


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all pairs of rows as integers (Python's own where 64 bits do not hold them)."""
    top = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * max(1, v.shape[1]) < 1 << 53:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    a, b = v.astype(object), c.astype(object)
    return (a * a).sum(axis=1)[:, None] - 2 * a.dot(b.T) + (b * b).sum(axis=1)[None, :]


def between(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to the rows of c at the same places."""
    top = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * max(1, v.shape[1]) < 1 << 63:
        d = v - c
        return (d * d).sum(axis=1)
    d = v.astype(object) - c.astype(object)
    return (d * d).sum(axis=1)


@dataclass
class Simplex:
    """The base: pivots in general position, and the triangle of coordinates of those after the first."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, count: int) -> Simplex:
        """The first `count` points that are not (nearly) in the hull of those taken before."""
        taken, rows = [points[0]], np.zeros((0, 0))
        for p in points[1:]:
            if len(taken) > count - 1:
                break
            d = np.sqrt(distances(p[None, :], np.array(taken)).astype(np.float64))[0]
            foot, height = _apex(rows, d[None, :], _sides(rows))
            if height[0] > 1e-2 * max(d.max(), 1.0):
                rows = np.block([[rows, np.zeros((len(rows), 1))], [foot, height[:, None]]])
                taken.append(p)
        return cls(np.array(taken), rows)

    def apexes(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feet in the space of the base, and heights over it, of points with distances d (rows) to the pivots."""
        return _apex(self.base, d, _sides(self.base))


def _sides(base: np.ndarray) -> np.ndarray:
    """Squared distances of the later pivots to the first."""
    return (base * base).sum(axis=1)


def _apex(base: np.ndarray, d: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By the law of cosines each distance gives an inner product with a side of the base; the triangle is solved for the foot."""
    first = d[:, 0] ** 2
    products = (first[:, None] + sides[None, :] - d[:, 1:] ** 2) / 2
    foot = np.linalg.solve(base, products.T).T if len(base) else products
    return foot, np.sqrt(np.maximum(0.0, first - (foot * foot).sum(axis=1)))


def nearest(v: np.ndarray, apexes: tuple[np.ndarray, np.ndarray], centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest centroid (of ties the first), its exact squared distance, and with how many centroids it was compared exactly."""
    foot, height = apexes
    cfoot, cheight = simplex.apexes(np.sqrt(distances(centroids, simplex.pivots).astype(np.float64)))
    flat = (foot * foot).sum(axis=1)[:, None] - 2 * (foot @ cfoot.T) + (cfoot * cfoot).sum(axis=1)[None, :]
    low, high = flat + (height[:, None] - cheight[None, :]) ** 2, flat + (height[:, None] + cheight[None, :]) ** 2
    # rounding of the projection grows with the size of the numbers, not with the distance
    size = max(1.0, float(flat.max(initial=0)), float((height**2).max(initial=0)), float((cheight**2).max(initial=0)))
    r, c = np.nonzero(low <= high.min(axis=1, keepdims=True) + 1e-6 * size)
    exact = between(v[r], centroids[c])
    # pairs come by row, then by centroid: a stable sort keeps the first of equal distances in front
    order = np.lexsort((c, exact, r)) if exact.dtype != object else np.array(sorted(range(len(r)), key=lambda i: (r[i], exact[i], c[i])))
    first = order[np.append(True, np.diff(r[order]) > 0)]
    return c[first], exact[first], np.bincount(r, minlength=len(v))


def _starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least hashes of their ids: at most k rows come to the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    picked = rows.filter(F.col("vec_id").isNotNull()).select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in picked], np.int64)


def _projected(rows: DataFrame, simplex: Simplex) -> DataFrame:
    """Add `d`: the distances to the pivots."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                d = np.sqrt(distances(matrix(pa.chunked_array([part.column("v")])), simplex.pivots).astype(np.float64))
                ends = pa.array(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(d.ravel()))], names=[*part.schema.names, "d"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("d", T.ArrayType(T.DoubleType()))]))


def _assigned(batches, centroids: np.ndarray, simplex: Simplex):
    """(batch, vectors, clusters, distances, numbers of centroids compared exactly) of slices of batches."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            v = matrix(pa.chunked_array([part.column("v")]))
            yield (part, v, *nearest(v, simplex.apexes(matrix(pa.chunked_array([part.column("d")]))), centroids, simplex))


def _sums(rows: DataFrame, centroids: np.ndarray, simplex: Simplex) -> dict[int, tuple[int, list[int]]]:
    """For each cluster: its number of vectors and their sum; tasks sum first, at most one row a cluster comes back.

    Sums move as decimals, which hold whatever 2^40 rows may give.
    """

    def run(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, object)
        for _, v, cluster, _, _ in _assigned(batches, centroids, simplex):
            count += np.bincount(cluster, minlength=len(centroids))
            order = np.argsort(cluster, kind="stable")
            begins = np.flatnonzero(np.append(True, np.diff(cluster[order]) > 0))
            small = int(np.abs(v).max(initial=0)) < (1 << 62) // ROWS
            total[cluster[order][begins]] += np.add.reduceat(v[order] if small else v[order].astype(object), begins, axis=0).astype(object)
        live = np.flatnonzero(count)
        cells = [(int(c), int(count[c]), at, int(x)) for c in live for at, x in enumerate(total[c])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in cells], pa.int32()), pa.array([x[1] for x in cells], pa.int64()), pa.array([x[2] for x in cells], pa.int32()), pa.array([str(x[3]) for x in cells], pa.string())],
            names=["cluster", "n", "at", "total"],
        )

    parts = rows.select("v", "d").mapInArrow(run, "cluster int, n long, at int, total string")
    found = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(28,0)")).cast("string").alias("total")).collect()  # clusters * components
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found:
        out.setdefault(r["cluster"], (r["n"], [0] * centroids.shape[1]))[1][r["at"]] = int(r["total"])
    return out


def clustered(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, id: str = "vec_id", vector: str = "embedding", seed: int = 2, pivots: int = PIVOTS
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, compared) of each vector, and the final centroids.

    `compared` counts the centroids whose exact distance was needed.  Every round is one pass over the stored vectors; what it
    brings to the driver are k * dim sums, however many rows there are.
    """
    level = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), F.lit(MOST)), F.lit(-MOST)))
    some = vectors.filter(usable(F.col(vector)) & (F.size(vector) == dim)).select(F.col(id).cast("long").alias("vec_id"), level.alias("v"))
    centroids = _starts(some, k, seed)
    if not len(centroids):
        return some.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("compared")).limit(0), centroids.reshape(0, dim)
    simplex = Simplex.of(centroids, pivots)
    rows = store(_projected(some, simplex), "clusters-projected")
    for _ in range(rounds):
        for c, (n, total) in _sums(rows, centroids, simplex).items():
            centroids[c] = [x // n for x in total]  # rounded down

    def run(batches):
        for part, _, cluster, distance, compared in _assigned(batches, centroids, simplex):
            distance = pa.array([min(int(x), _LAST) for x in distance], pa.int64())
            columns = [part.column("vec_id"), pa.array(cluster.astype(np.int32)), distance, pa.array(compared.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "compared"])

    found = store(rows.mapInArrow(run, "vec_id long, cluster int, distance long, compared int"), "clusters-assigned")
    discard(rows)
    return found, centroids


def digest(centroid: np.ndarray) -> str:
    """sha256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def contract(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found, centroids = clustered(vectors)
    spark = vectors.sparkSession
    # one row a centroid
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}
    told = [(c, min(sums.get(c, 0), _LAST), min(sum(sums.values()), _LAST), digest(x)) for c, x in enumerate(centroids)]
    table = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
