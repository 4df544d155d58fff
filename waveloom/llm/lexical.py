"""Ranked lexical search with norm buckets.

A document is a sparse vector of impacts, an item one of term weights; scores are their inner products.
Documents are ordered by the length of their vectors (a range exchange), and consecutive ones form buckets.
The bucket of the longest ones gives each item a cutoff that is safe.  In every other bucket Cauchy-Schwarz first
drops the items that even its longest vector cannot lift to their cutoff, and so does the largest impact of each term
in the bucket; then bounds by coordinate drop single documents: what the terms give that hold most of an item's
length, and for its other terms the least of three bounds: the product of what is left of both lengths, the
bucket's largest impacts, the document's largest impact.  Scores of the survivors are computed in whole numbers
and raise the cutoffs.

Items are taken in blocks of about QUERY_BYTES of text, one block after another, so what goes to all tasks has a
bound whatever the number of items.

Defined results: null and empty texts hold no terms; repeated rows of either table are rows of their own (each
item row has its own ranks); documents without an id come last of equal scores; items without terms, and
documents without any term of an item, give no rows; ids are below 2^63 - 1; other columns are ignored; an empty
table on either side gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SLICE_CHARS, discard, store

#: Text of items in a block; documents of the first bucket; share of an item's squared length that its focus terms hold.
QUERY_BYTES, HEAD, FOCUS = 4 << 20, 4096, 0.99
#: Documents, cells (documents x items) and postings of a bucket at most.
ROWS, CELLS, POSTINGS = 1024, 1 << 20, 1 << 18
#: Parts in which the best rows of an item are found before they meet.
SALTS = 64
_LAST = np.iinfo(np.int64).max
#: ASCII digits and letters stay (capitals become small), all other ASCII separates; bytes of other characters stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_TERM_BYTES).split() if text else []


class Questions:
    """A block of items: their vocabulary (ids from 1 on) and the ids of each item's terms."""

    def __init__(self, texts: list[bytes | None]):
        self.vocab: dict[bytes, int] = {}
        self.asked = [np.array(sorted({self.vocab.setdefault(t, len(self.vocab) + 1) for t in terms(x)}), np.int64) for x in texts]
        self.size = len(self.vocab) + 1


def profiles(docs: DataFrame, vocab: dict[bytes, int], id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (of the vocabulary) of each document that has a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        get = sent.value.get
        for batch in batches:
            column = batch.column("text")
            ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                # the texts of one slice at a time become Python objects
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE_CHARS, side="right")))
                part = batch.slice(begin, end - begin)
                begin = end
                sizes, found = [], []
                for t in part.column("text").to_pylist():
                    words = terms(t)
                    sizes.append(len(words))
                    found.append(np.unique(np.array(list(filter(None, map(get, words))), np.int32), return_counts=True))
                live = np.flatnonzero(sizes)
                ends_ = pa.array(np.append(0, np.cumsum([len(found[i][0]) for i in live])).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends_, pa.array(np.concatenate([found[i][k] for i in live] or [np.zeros(0)]).astype(np.int32))) for k in (0, 1)]
                ids = part.column("doc_id").take(pa.array(live))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.array(sizes, np.int64)[live]), *lists], names=["doc_id", "n", "terms", "tfs"])

    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a column of lists, and each value's row."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), sizes)


def _frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; a task gives at most one row a term."""

    def run(batches):
        n = np.zeros(size, np.int64)
        for batch in batches:
            n += np.bincount(_lists(batch.column("terms"))[0], minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the vocabulary of a block
        out[r["term"]] = r["df"]
    return out


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _vectors(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, terms, impacts, length of each document that holds a term of the vocabulary."""

    def run(batches):
        for batch in batches:
            (term, row), (tf, _) = _lists(batch.column("terms")), _lists(batch.column("tfs"))
            m = 100 - 90 + (90 * batch.column("n").to_numpy() * n_docs) // n_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
            length = np.sqrt(np.bincount(row, impact.astype(np.float64) ** 2, batch.num_rows))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, impact)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists, pa.array(length)], names=["doc_id", "terms", "impacts", "length"])

    return found.filter(F.size("terms") > 0).mapInArrow(run, "doc_id long, terms array<int>, impacts array<int>, length double")


class Ranking:
    """The k best documents of each item over buckets of documents; cutoffs only rise."""

    def __init__(self, asked: list[np.ndarray], weights: np.ndarray, k: int, cutoff: np.ndarray | None = None):
        self.asked, self.weights, self.k, n = asked, weights, k, len(asked)
        self.cutoff = np.ones(n, np.int64) if cutoff is None else cutoff.copy()
        self.lengths = np.array([math.sqrt(float((weights[a].astype(np.float64) ** 2).sum())) for a in asked])
        focus, others, self.rest = [], [], np.zeros(n)
        for q, a in enumerate(asked):
            squares = weights[a].astype(np.float64) ** 2
            order = np.argsort(-squares, kind="stable")
            held = np.cumsum(squares[order])
            take = int(np.searchsorted(held, FOCUS * held[-1]) + 1) if len(a) else 0
            focus.append(a[order[:take]])
            others.append(a[order[take:]])
            self.rest[q] = math.sqrt(max(0.0, held[-1] - held[take - 1])) if len(a) else 0.0
        # the items in whose focus a term is
        terms_, items = np.concatenate([*focus, np.zeros(0, np.int64)]), np.repeat(np.arange(n), [len(f) for f in focus])
        order = np.argsort(terms_, kind="stable")
        self.items = items[order]
        self.begin = np.searchsorted(terms_[order], np.arange(len(weights) + 1))
        self.others = np.concatenate([*others, np.zeros(0, np.int64)])
        self.owner = np.repeat(np.arange(n), [len(o) for o in others])
        self.light = np.bincount(self.owner, weights[self.others].astype(np.float64), n)
        self.terms, self.of = terms_, items
        self.best = [np.zeros(0, np.int64)] * 3  # item, score, document
        self.seen = self.scored = 0

    def bucket(self, ids: np.ndarray, length: np.ndarray, term: np.ndarray, row: np.ndarray, impact: np.ndarray) -> None:
        """Documents of decreasing length; postings in order of row and term."""
        n, slack = len(self.asked), 1 + 1e-9
        most = np.zeros(len(self.weights))
        np.maximum.at(most, term, impact)
        top = np.maximum.reduceat(impact, np.searchsorted(row, np.arange(len(ids)))).astype(np.float64)
        of_bucket = np.bincount(self.owner, self.weights[self.others] * most[self.others], n)
        whole = of_bucket + np.bincount(self.of, self.weights[self.terms] * most[self.terms], n)
        # for the bucket as a whole: Cauchy-Schwarz, and the largest impacts
        live = np.minimum(self.lengths * length.max(), whole) * slack >= self.cutoff
        self.seen += len(ids) * n
        if not live.any():
            return
        times = self.begin[term + 1] - self.begin[term]
        at = np.repeat(np.arange(len(term)), times)
        item = self.items[np.repeat(self.begin[term] - (np.cumsum(times) - times), times) + np.arange(len(at))]
        cell, v = row[at] * n + item, impact[at].astype(np.float64)
        partial = np.bincount(cell, v * self.weights[term[at]], len(ids) * n).reshape(-1, n)
        squares = np.bincount(cell, v * v, len(ids) * n).reshape(-1, n)
        left = np.sqrt(np.maximum(0.0, (length * length * slack)[:, None] - squares))
        other = np.minimum(left * self.rest, np.minimum(of_bucket, top[:, None] * self.light))
        r, q = np.nonzero(((partial + other) * slack >= self.cutoff) & live)
        self.scored += len(r)
        score = self._exact(r, q, term, row, impact)
        good = score >= self.cutoff[q]
        self._add(q[good], score[good], ids[r[good]])

    def _exact(self, r: np.ndarray, q: np.ndarray, term: np.ndarray, row: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Scores of pairs of documents and items in whole numbers."""
        keys, size, out = row * len(self.weights) + term, len(self.weights), np.zeros(len(r), np.int64)
        for k in range(0, len(r), 1 << 14):
            rows, lists = r[k : k + (1 << 14)], [self.asked[i] for i in q[k : k + (1 << 14)].tolist()]
            lens = np.array([len(a) for a in lists])
            wanted = np.concatenate(lists)
            key = np.repeat(rows, lens) * size + wanted
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            part = np.where(keys[at] == key, self.weights[wanted] * impact[at], 0)
            out[k : k + len(rows)] = np.add.reduceat(part, np.cumsum(lens) - lens)
        return out

    def _add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = (np.concatenate(x) for x in zip(self.best, (q, score, ids), strict=True))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.asked)))[q]
        last = rank == self.k - 1
        self.cutoff[q[last]] = np.maximum(self.cutoff[q[last]], score[last])
        stay = rank < self.k
        self.best = [q[stay], score[stay], ids[stay]]


def _searched(vectors: DataFrame, asked: list[np.ndarray], weights: np.ndarray, k: int, cutoff: np.ndarray | None) -> DataFrame:
    """query, doc_id, score: the best of each part of the documents, whose rows come by falling length."""
    sent = vectors.sparkSession.sparkContext.broadcast((asked, weights, cutoff))
    rows = max(1, min(CELLS // max(1, len(asked)), ROWS))

    def run(batches):
        ranking = Ranking(sent.value[0], sent.value[1], k, sent.value[2])
        for batch in batches:
            begin = 0
            sizes = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
            while begin < batch.num_rows:
                most = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + POSTINGS, side="right"))
                end = max(begin + 1, min(begin + rows, most))
                part = batch.slice(begin, end - begin)
                begin = end
                (term, row), (impact, _) = _lists(part.column("terms")), _lists(part.column("impacts"))
                ranking.bucket(pc.fill_null(part.column("doc_id"), _LAST).to_numpy(), part.column("length").to_numpy(), term, row, impact)
        q, score, ids = ranking.best
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(score)], names=["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """Add rank and keep the first k of each query: in parts first, then of these."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), "copy"]
    parts = found.withColumn("copy", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("copy"), F.lit(SALTS)))
    inside = parts.withColumn("rank", F.row_number().over(W.partitionBy("query", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    return inside.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).drop("copy", "salt")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_bytes: int = QUERY_BYTES, head: int = HEAD) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text"))
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = asked.filter(F.col("block") == block).select("item_id", "text").collect()  # about block_bytes of text
        questions = Questions([r["text"] for r in rows])
        if questions.size == 1:
            continue
        found = store(profiles(docs, questions.vocab, doc_id, text), "lexical-profiles")
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            discard(found)
            continue
        df = _frequencies(found, questions.size)
        weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
        weights[df == 0] = 0
        # equal lengths are spread by a hash, so that copies do not meet in one part
        by_length = [F.desc("length"), F.xxhash64("doc_id", "terms")]
        vectors = store(_vectors(found, n_docs, n_terms).repartitionByRange(*by_length).sortWithinPartitions(F.desc("length")), "lexical-vectors")
        discard(found)
        count = vectors.count()
        edge = vectors.agg(F.percentile_approx("length", max(0.0, 1 - head / max(1, count)), 10_000)).first()[0] or 0.0
        first = store(_best(_searched(vectors.filter(F.col("length") >= edge), questions.asked, weights, k, None), k), "lexical-head")
        cutoff = np.ones(len(rows), np.int64)
        for r in first.filter(F.col("rank") == k).select("query", "score").collect():  # one row an item of the block
            cutoff[r["query"]] = r["score"]
        rest = _searched(vectors.filter(F.col("length") < edge), questions.asked, weights, k, cutoff)
        best = _best(first.select("query", "doc_id", "score").unionByName(rest), k)
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], f"query long, item_id {kind}")
        out = out.unionByName(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def contract(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score."""
    return ranked(docs, items)
