"""Near-duplicate vectors and exact top-k search.

Defined results: vectors that are null, or hold null or non-finite components, link with nothing and
take no part in searches (zero vectors link with nothing too); vectors of different lengths are never
compared; empty tables give empty results; other columns are ignored.  A row without an id is near or equal
to others like any row, but no component is named after it unless all its rows lack ids (null then), and
it takes no part in searches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, store
from .graph import components

#: Rows on either side of a block that one task compares; pivots that partition the vectors at most.
ROWS, PIVOTS = 4096, 4096
#: Numbers from here on stand for vectors without ids, so that any id is smaller.
NAMELESS = 1 << 62
#: Queries in a block of a search; bytes of queries up to which they are sent to all tasks whole.
QUERIES, SENT_BYTES = 8192, 32 << 20
#: Components whose sorted lists give their heads to a search; candidates that one step of it scores.
LISTS, STEP = 64, 512


def usable(vector: Column) -> Column:
    """Not null, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False)) & (F.size(vector) > 0)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    lists = column.combine_chunks()
    flat = lists.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


# -- near-duplicates ------------------------------------------------------------------------------


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # keeps squares in range
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _assigned(vectors: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    """Add `home`, the nearest pivot's cell, `far`, the distance to it, and `cells` with `dists`: the cells before
    the own one that may need the vector.

    Of two vectors of different cells, the one of the later cell visits the earlier, so they meet once.  y is
    within `reach` of some x of cell c only if d(y, p_c) <= d(y, p_home) + 2 * reach.
    """

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                unit = _unit(matrix(pa.chunked_array([part.column("v")])))
                d = np.sqrt(np.maximum(0, 2 - 2 * unit @ pivots.T))
                home = d.argmin(axis=1)
                far = d[np.arange(len(d)), home]
                near = (d <= far[:, None] + 2 * reach + 1e-6) & (np.arange(len(pivots)) < home[:, None])
                row, cell = np.nonzero(near)
                ends = pa.array(np.append(0, np.cumsum(near.sum(axis=1))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (cell.astype(np.int32), d[row, cell])]
                columns = [*part.columns, pa.array(home.astype(np.int32)), pa.array(far), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "home", "far", "cells", "dists"])

    added = "home int, far double, cells array<int>, dists array<double>"
    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, *T._parse_datatype_string(added).fields]))


_LINKED = "node long, copies long, other long"


def _linked(least: float):
    """For two blocks: how many rows each vector links with in the other (copies counted), and its local group.
    Blocks of one cell's own vectors meet each other once, and in a block each pair counts once."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"node": [], "copies": [], "other": []}
        if left.num_rows and right.num_rows:
            x, y = _unit(matrix(left["v"])), _unit(matrix(right["r_v"]))
            xi, yi = left["node"].to_numpy(), right["r_node"].to_numpy()
            cx, cy = left["copies"].to_numpy(), right["r_copies"].to_numpy()
            own = left["side"][0].as_py() == 0 and left["xb"][0].as_py() == left["yb"][0].as_py()
            rows, cols = [], []
            for k in range(0, len(x), 512):
                r, c = np.nonzero(x[k : k + 512] @ y.T >= least)
                r += k
                if own:
                    once = xi[r] < yi[c]
                    r, c = r[once], c[once]
                rows.append(r)
                cols.append(c)
            r, c = np.concatenate(rows), np.concatenate(cols)
            if len(r):
                for ids, n in ((xi, np.bincount(r, cy[c], len(x))), (yi, np.bincount(c, cx[r], len(y)))):
                    at = np.flatnonzero(n)
                    out["node"] += ids[at].tolist()
                    out["copies"] += n[at].astype(np.int64).tolist()
                    out["other"] += [None] * len(at)
                # spread the least id along the links of the two blocks until it stays: one edge for each vector
                lx, ly = xi.copy(), yi.copy()
                while True:
                    was = lx.copy(), ly.copy()
                    np.minimum.at(ly, c, lx[r])
                    np.minimum.at(lx, r, ly[c])
                    if (was[0] == lx).all() and (was[1] == ly).all():
                        break
                for ids, low in ((xi, lx), (yi, ly)):
                    at = np.flatnonzero(ids != low)
                    out["node"] += ids[at].tolist()
                    out["copies"] += [0] * len(at)
                    out["other"] += low[at].tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return join


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.9, rows: int = ROWS) -> DataFrame:
    """id, n_links, component_id, kept for every row: exact cosine links at `least` or more.

    Equal vectors are one (with a number of copies).  Pivots partition the distinct vectors into cells,
    the triangle inequality says which other cells need a vector (by the distance to its own pivot and by
    the cell's radius), and pairs of blocks of bounded size join independently, each pair of vectors once.
    What leaves a block grows with its rows, not with its links.  A row without an id has the component of
    the rows with ids that it reaches, else null, and is kept only in the latter case.
    """
    some = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    live = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    distinct = some.filter(live).groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    distinct = store(distinct.withColumn("dim", F.size("v")).withColumn("node", F.coalesce("vec_id", F.lit(NAMELESS) + F.monotonically_increasing_id())), "vectors-distinct")
    links = None
    reach = float(np.sqrt(2 - 2 * least))
    for dim, n in sorted((r["dim"], r["n"]) for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        same = distinct.filter(F.col("dim") == dim).select("node", "copies", "v")
        count = min(PIVOTS, max(1, round(n / rows)))
        picked = same.orderBy(F.xxhash64("node"), "node").limit(count).select("v").collect()
        pivots = _unit(np.array([r["v"] for r in picked], np.float64))
        placed = store(_assigned(same, pivots, reach), "vectors-placed")
        # nothing of a cell is further from its pivot than `radius`, so visitors stay within that and the reach; at most PIVOTS rows
        radius = {r["home"]: r["radius"] for r in placed.groupBy("home").agg(F.max("far").alias("radius")).collect()}
        within = F.array(*[F.lit(radius.get(c, -4.0) + reach + 1e-6) for c in range(count)])
        visits = F.filter("cells", lambda c, i: F.get("dists", i) <= F.get(within, c))
        visitors = placed.select("node", "copies", "v", F.explode(visits).alias("cell"))
        owners = placed.select("node", "copies", "v", F.col("home").alias("cell"))
        # cells in blocks of at most `rows`; one small row for each cell
        blocks = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0)) / rows).cast("int")
        sizes = owners.groupBy("cell").agg(F.count("*").alias("own")).join(visitors.groupBy("cell").agg(F.count("*").alias("all")), "cell", "left")
        sizes = F.broadcast(sizes.select("cell", blocks("own").alias("nx"), blocks("all").alias("ny")))  # at most PIVOTS rows
        block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda a, b: F.explode(F.when(b >= a, F.sequence(a, b)))
        zero, columns = F.lit(0), ["cell", "side", "xb", "yb", "node", "copies", "v"]
        mine, theirs = owners.join(sizes, "cell"), visitors.join(sizes, "cell")
        # side 0: a cell's own blocks with each other, once; side 1: its own blocks with those of its visitors
        left = mine.withColumn("side", zero).withColumn("xb", block("nx")).withColumn("yb", every(F.col("xb"), F.col("nx") - 1)).select(columns)
        left = left.unionByName(mine.withColumn("side", F.lit(1)).withColumn("xb", block("nx")).withColumn("yb", every(zero, F.col("ny") - 1)).select(columns))
        right = mine.withColumn("side", zero).withColumn("yb", block("nx")).withColumn("xb", every(zero, F.col("yb"))).select(columns)
        right = right.unionByName(theirs.withColumn("side", F.lit(1)).withColumn("yb", block("ny")).withColumn("xb", every(zero, F.col("nx") - 1)).select(columns))
        keys = columns[:4]
        others = right.select([F.col(c).alias(f"r_{c}") for c in columns]).groupBy([f"r_{c}" for c in keys])
        found = store(left.groupBy(keys).cogroup(others).applyInArrow(_linked(least), _LINKED), "vectors-links")
        discard(placed)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return some.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    groups = components(links.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    degrees = links.filter("other is null").groupBy("node").agg(F.sum("copies").alias("linked"))
    heads = distinct.join(degrees, "node", "left").join(groups, "node", "left")
    heads = heads.select(
        F.col("v").alias("__v"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.when(F.coalesce("component_id", "node") < NAMELESS, F.coalesce("component_id", "node")).alias("component_id"),
    )
    joined = some.withColumn("v", F.when(live, F.col("v"))).join(heads, F.col("v") == F.col("__v"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


# -- search ---------------------------------------------------------------------------------------

_FOUND = "query_row long, query_id long, vec_id long, score long, resolved long"


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 1 << 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if top < 1 << 63:
        return q @ c.T
    exact = q.astype(object) @ c.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _parts(dim: int, slices: int) -> list[slice]:
    edges = np.linspace(0, dim, min(slices, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Search:
    """The k best entries of a number of queries, over candidates that come in steps.

    heads: vectors from the ends of the sorted lists of components.  Their k-th best full score is a cutoff
    that is safe for a query.  A candidate that reaches the cutoff in full reaches its uniform share in one
    of the slices of the components at least; only such entries are collected and resolved.  What is
    resolved raises the cutoff for the candidates that follow.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, heads: tuple[np.ndarray, np.ndarray], k: int, slices: int):
        self.rows, self.ids, self.q, self.k = rows, ids, q, k
        self.parts = _parts(q.shape[1], slices)
        least = np.iinfo(np.int64).min
        self.cutoff = np.full(len(q), least)
        known = _products(q, heads[1]) if len(heads[0]) else np.zeros((len(q), 0), np.int64)
        known[rows[:, None] == heads[0][None, :]] = least
        if known.shape[1] >= k:
            self.cutoff = np.partition(known, -k, axis=1)[:, -k]
        self.best = [np.zeros(0, np.int64)] * 3  # query, score, id
        self.resolved = np.zeros(len(q), np.int64)

    def step(self, rows: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        for at in range(0, len(self.q), 1024):
            q, cutoff = self.q[at : at + 1024], self.cutoff[at : at + 1024]
            partial = [_products(q[:, p], c[:, p]) for p in self.parts]
            share = -(-cutoff // len(self.parts))  # rounded up: scores are whole numbers
            reach = partial[0] >= share[:, None]
            for more in partial[1:]:
                reach |= more >= share[:, None]
            r, e = np.nonzero(reach)
            score = sum(p[r, e] for p in partial)
            self.resolved[at : at + 1024] += np.bincount(r, minlength=len(q))
            good = (score >= cutoff[r]) & (self.rows[at + r] != rows[e])
            self._add(at + r[good], score[good], ids[e[good]])

    def _add(self, r: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        r, score, ids = (np.concatenate(x) for x in zip(self.best, (r, score, ids), strict=True))
        order = np.lexsort((ids, -score, r))
        r, score, ids = r[order], score[order], ids[order]
        first = np.searchsorted(r, np.arange(len(self.q)))
        rank = np.arange(len(r)) - first[r]
        last = r[rank == self.k - 1]
        self.cutoff[last] = np.maximum(self.cutoff[last], score[rank == self.k - 1])
        stay = rank < self.k
        self.best = [r[stay], score[stay], ids[stay]]

    def found(self) -> dict[str, np.ndarray]:
        """The columns of _FOUND; each query's first row tells how many entries were resolved for it."""
        r, score, ids = self.best
        new = np.append(True, r[1:] != r[:-1])[: len(r)]
        return {"query_row": self.rows[r], "query_id": self.ids[r], "vec_id": ids, "score": score, "resolved": np.where(new, self.resolved[r], 0)}


def _heads(some: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and vectors at both ends of the sorted lists of at most LISTS components: 2 * LISTS vectors at most."""
    at = sorted({int(c) for c in np.linspace(0, dim - 1, min(dim, LISTS))})
    value = lambda c: F.get("v", F.lit(c))
    row = F.struct("row", "v")
    ends = some.agg(*[f(row, F.struct(value(c), "row")).alias(f"{n}{c}") for c in at for n, f in (("a", F.max_by), ("b", F.min_by))]).first()
    found = {r["row"]: r["v"] for r in ends if r is not None}
    return np.array(list(found), np.int64), np.array(list(found.values()), np.int64).reshape(len(found), dim)


def resolved(vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", slices: int = 2, rows: int = ROWS) -> DataFrame:
    """The k best entries of each query in each part of the candidates: the columns of _FOUND."""
    spark = vectors.sparkSession
    level = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    some = vectors.filter(usable(F.col(vector)) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("vec_id"), level.alias("v"))
    some = store(some.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "search-vectors")
    sizes = some.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(queries).alias("asked")).filter("asked > 0")
    found = spark.createDataFrame([], _FOUND)
    for dim, n, asked in sorted(map(tuple, sizes.collect())):
        same = some.filter(F.col("dim") == dim).select("row", "vec_id", "v")
        wanted, heads = same.filter(queries), _heads(same, dim)
        part = _sent(same, wanted.collect(), heads, k, slices, dim) if asked * dim * 8 <= SENT_BYTES else _blocked(same, wanted, heads, k, slices, n, asked, rows)
        found = found.unionByName(part)
    return found


def _sent(same: DataFrame, wanted: list, heads: tuple, k: int, slices: int, dim: int) -> DataFrame:
    """All queries (of a checked size) go to every task; candidates stay where they are."""
    columns = [np.array([w[c] for w in wanted], np.int64) for c in ("row", "vec_id")] + [np.array([w["v"] for w in wanted], np.int64).reshape(-1, dim)]
    sent = same.sparkSession.sparkContext.broadcast((columns, heads))

    def run(batches):
        (rows, ids, q), heads = sent.value
        search = Search(rows, ids, q, heads, k, slices)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                b = batch.slice(at, STEP)
                search.step(b.column("row").to_numpy(), b.column("vec_id").to_numpy(), matrix(pa.chunked_array([b.column("v")])))
        yield pa.RecordBatch.from_pydict(search.found())

    return same.mapInArrow(run, _FOUND)


def _blocked(same: DataFrame, wanted: DataFrame, heads: tuple, k: int, slices: int, n: int, asked: int, rows: int) -> DataFrame:
    """Blocks of queries meet blocks of candidates."""
    n_blocks, n_chunks = max(1, -(-n // rows)), max(1, -(-asked // QUERIES))
    place = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = wanted.withColumn("chunk", place("row", n_chunks)).withColumn("block", every(n_blocks))
    right = same.select(place("row", n_blocks).alias("r_block"), every(n_chunks).alias("r_chunk"), F.col("row").alias("r_row"), F.col("vec_id").alias("r_id"), F.col("v").alias("r_v"))

    def join(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not (queries.num_rows and candidates.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_row", "query_id", "vec_id", "score", "resolved")})
        search = Search(queries["row"].to_numpy(), queries["vec_id"].to_numpy(), matrix(queries["v"]), heads, k, slices)
        c, r, i = matrix(candidates["r_v"]), candidates["r_row"].to_numpy(), candidates["r_id"].to_numpy()
        for at in range(0, len(c), STEP):
            search.step(r[at : at + STEP], i[at : at + STEP], c[at : at + STEP])
        return pa.table(search.found())

    return left.groupBy("block", "chunk").cogroup(right.groupBy("r_block", "r_chunk")).applyInArrow(join, _FOUND)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", slices: int = 2, rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which `queries` (over vec_id) holds the k best others by
    integer inner product.

    Components count as floor(256 * x).  Three phases: the ends of the components' sorted lists give each query
    a cutoff that is safe; the entries that reach a uniform share of it in some slice of the components are
    collected; these are resolved exactly.  Repeated ids are rows of their own, each a query and a candidate;
    rows without ids take no part.
    """
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    found = resolved(vectors, queries, k, id, vector, slices, rows)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
