"""Exact n-gram Jaccard join: near-duplicate classes of documents by their sets of word shingles.

The rows of an inverted index are ordered by rarity, so only the rarest shingles of a set need to be
looked up, and a set whose rare shingles are all its own links with nothing.  Two relations between
sets cut the work further (after Wang et al., "Leveraging set relations in exact set similarity join"):

* index lists are skipped by position: an entry at place i of a set of n shingles can only meet sets
  up to a size given by n - i;
* answers are derived: every list has a leader, the set with the fewest shingles of its own.  All sets
  of the list are compared with it; |x & y| <= min(|x & L|, |y & L|) + min(|x - L|, |y - L|) then settles
  most other pairs of the list, and pairs that the leader already connects need no look at all.

Defined results: a null or empty text, or one without words, has no shingles and links with nothing;
with fewer words than a shingle has, the whole sequence is the one shingle; equal sets are one class;
repeated rows are in one class; other columns are ignored.  Sets are told apart by 64-bit hashes of
their shingles' 64-bit hashes.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, slices, store
from .graph import components

WORDS = 5
#: A pair links when DEN * |x & y| >= NUM * |x | y|.
NUM, DEN = 75, 100
#: Shingles that one task sorts; index rows in one group; documents in a group of documents.
SHINGLES, ENTRIES, DOCS = 1_500_000, 400_000, 2500
#: Characters whose words are hashed at once.
CHARS = 1_000_000
#: A shingle is hot if it is in this share of all sets, and that many; hot ones that are known at most.
HOT_SHARE, HOT_LEAST, HOT_KEYS = 1 / 64, 8, 1 << 16
#: What stands for the number of sets of a hot shingle: all of them come last.
_OFTEN = (1 << 31) - 2
#: Sets of one index list that are compared at once.
LIST = 4096
#: The number of a stored row.
_ROW = "__row"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_ODD = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    p = np.full(n + 1, base & (2**64 - 1), np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and how many each has."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.append(True, space[:-1]))
    end = np.flatnonzero(space & np.append(False, ~space[:-1]))
    room = -(-len(data) // CHARS) * CHARS  # few lengths, so that the tables are kept
    power, back = _powers(_BASE, room), _powers(pow(_BASE, -1, 2**64), room)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    word = _mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _ODD)
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    step = _powers(int(_ODD), words)
    whole = max(0, len(word) - words + 1)
    key = np.zeros(whole, np.uint64)
    for k in range(words):
        key += word[k : k + whole] * step[k]
    one = doc[:whole] == doc[words - 1 : words - 1 + whole]
    key, of = _mix(key[one]), doc[:whole][one]
    first = np.cumsum(n_words) - n_words
    few = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(few):
        short = [int((word[first[d] : first[d] + n_words[d]] * step[: n_words[d]]).sum(dtype=np.uint64)) + int(n_words[d]) for d in few.tolist()]
        key, of = np.append(key, _mix(np.array([s % 2**64 for s in short], np.uint64))), np.append(of, few)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))[: len(key)]
    return key[new], np.bincount(of[new], minlength=len(texts))


def _signature(part: np.ndarray) -> int:
    return int.from_bytes(blake2b(part.tobytes(), digest_size=8).digest(), "big", signed=True)


def _split(values: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(lens).tolist()
    return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def sets(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, sig (equal for equal sets; null without shingles), the columns of `keep`, and in one row of
    each slice of texts `often`: shingles that many of its different sets hold, with how many do."""
    pair = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
    own = [T.StructField(c, T.LongType()) for c in ("doc_id", "n_shingles", "sig")]
    schema = T.StructType([*own, *(docs.schema[c] for c in keep), T.StructField("often", T.ArrayType(pair))])
    often_type = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", CHARS):
                keys, lens = shingles(texts)
                cut = _split(keys, lens)
                sigs = [_signature(k) if len(k) else None for k in cut]
                found = [_often(list({s: k for s, k in zip(sigs, cut, strict=True) if s is not None}.values()))] + [None] * (len(sigs) - 1)
                columns = [part.column("doc_id"), pa.array(lens.astype(np.int64)), pa.array(sigs, pa.int64()), *map(part.column, keep), pa.array(found, often_type)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep).mapInArrow(run, schema)


def _often(sets_: list[np.ndarray]) -> list[dict[str, int]]:
    """Shingles in so many of these sets that they may be hot.  One in a share of all sets is in that share of some
    slice at least, so no slice needs to look at rarer ones."""
    least = max(HOT_LEAST, len(sets_) * HOT_SHARE)
    if len(sets_) < least:
        return []
    keys, n = np.unique(np.concatenate(sets_), return_counts=True)
    at = n >= least
    return [{"key": k, "n": c} for k, c in zip(keys[at].view(np.int64).tolist(), n[at].tolist(), strict=True)]


def _hot(known: DataFrame, n_sets: int) -> np.ndarray:
    """Sorted shingles that are in HOT_SHARE of all sets or more; at most 1 / HOT_SHARE times the shingles of a mean set,
    and of these the HOT_KEYS most frequent.  Which are known decides only how they are dealt and ordered, not what links."""
    counts = known.select(F.inline("often")).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(HOT_LEAST, n_sets * HOT_SHARE))
    top = counts.orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()
    return np.sort(np.array([r["key"] for r in top], np.int64).view(np.uint64))


def _six(keys: np.ndarray) -> bytes:
    """The low six bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


_PACKED = "part int, sigs binary, ns binary, lens binary, keys binary"


def _dealt(docs: DataFrame, parts: int, text: str, hot: np.ndarray, hot_parts: int) -> DataFrame:
    """Shingles dealt by hash into `parts`, packed: for each part the sets' sig, size, how many keys, keys (48 bits).

    Hot shingles, of which one part would get an entry from every set, are dealt by set into parts of
    their own, numbered below 0, with their final keys (64 bits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of one task count once
        for batch in batches:
            for _, texts in slices(batch, "text", CHARS):
                keys, lens = shingles(texts)
                cut = _split(keys, lens)
                sigs = [_signature(k) if len(k) else None for k in cut]
                use = []
                for i, s in enumerate(sigs):
                    if s is not None and s not in seen:
                        seen.add(s)
                        use.append(i)
                if not use:
                    continue
                keys, n = np.concatenate([cut[i] for i in use]), lens[use]
                of = np.repeat(np.arange(len(use)), n)
                part = ((keys >> np.uint64(36)) % np.uint64(parts)).astype(np.int32)  # 28 bits, of which the key keeps 12
                sig = np.array([sigs[i] for i in use], np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                    is_hot = hot[at] == keys
                    keys = np.where(is_hot, _final(keys, part.astype(np.uint64)), keys)
                    part = np.where(is_hot, -1 - (sig.view(np.uint64) % np.uint64(hot_parts)).astype(np.int32)[of], part)
                order = np.argsort(part, kind="stable")
                keys, of, part = keys[order], of[order], part[order]
                rows = {c: [] for c in ("part", "sigs", "ns", "lens", "keys")}
                for p, a, b in _runs(part):
                    which, count = np.unique(of[a:b], return_counts=True)
                    rows["part"].append(p)
                    rows["sigs"].append(sig[which].tobytes())
                    rows["ns"].append(n[which].astype(np.int32).tobytes())
                    rows["lens"].append(count.astype(np.int32).tobytes())
                    rows["keys"].append(_six(keys[a:b]) if p >= 0 else keys[a:b].tobytes())
                yield pa.RecordBatch.from_pydict(rows, schema=_packed_schema())

    return docs.select(F.col(text).alias("text")).mapInArrow(run, _PACKED)


def _final(keys: np.ndarray, part: np.ndarray) -> np.ndarray:
    """48 bits alone would mix parts: the final key of a shingle is a hash of both."""
    return _mix((keys & np.uint64((1 << 48) - 1)) + part * _ODD)


def _packed_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("sigs", "ns", "lens", "keys"))])


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])[: len(sorted_values)])
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(sorted_values)][: len(edges)], strict=True):  # none of no values
        yield int(sorted_values[a]), a, b


def _joined(table: pa.Table, column: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), dtype)


def _counted(groups: int):
    """In one part: in how many sets each shingle is; those in two or more go back to their sets."""

    def count(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        sigs, ns, lens = _joined(table, "sigs", "<i8"), _joined(table, "ns", "<i4"), _joined(table, "lens", "<i4")
        raw = b"".join(table["keys"].to_pylist())
        keys = _from_six(raw) if part >= 0 else np.frombuffer(raw, "<u8")
        _, first = np.unique(sigs, return_index=True)
        once = np.zeros(len(sigs), bool)
        once[first] = True
        stay = np.repeat(once, lens)
        sigs, ns, lens, keys = sigs[once], ns[once], lens[once], keys[stay]
        of = np.repeat(np.arange(len(sigs), dtype=np.int32), lens)
        if part >= 0:
            order = np.argsort(keys, kind="stable")
            sorted_keys = keys[order]
            edge = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])[: len(keys)])
            df = np.empty(len(keys), np.int32)
            df[order] = np.repeat(np.diff(np.append(edge, len(keys))), np.diff(np.append(edge, len(keys))))
            shared = df > 1
            keys, of, df = _final(keys[shared], np.full(int(shared.sum()), part, np.uint64)), of[shared], df[shared]
        else:
            df = np.full(len(keys), _OFTEN, np.int32)
        group = (sigs.astype(np.uint64) % np.uint64(groups)).astype(np.int64)[of]
        order = np.argsort(group, kind="stable")
        keys, of, df, group = keys[order], of[order], df[order], group[order]
        rows = {c: [] for c in _BACK}
        for g, a, b in _runs(group):
            which, n = np.unique(of[a:b], return_counts=True)
            rows["grp"].append(g)
            rows["sigs"].append(sigs[which].tobytes())
            rows["ns"].append(ns[which].tobytes())
            rows["lens"].append(n.astype(np.int32).tobytes())
            rows["keys"].append(keys[a:b].tobytes())
            rows["dfs"].append(df[a:b].tobytes())
        return pa.table({c: pa.array(rows[c], pa.int64() if c == "grp" else pa.binary()) for c in _BACK})

    return count


_BACK = ("grp", "sigs", "ns", "lens", "keys", "dfs")


def _ordered(table: pa.Table) -> pa.Table:
    """Sets with their shared shingles, rarest first; only those that can link with any other."""
    sigs, ns, lens = _joined(table, "sigs", "<i8"), _joined(table, "ns", "<i4"), _joined(table, "lens", "<i4")
    keys, dfs = _joined(table, "keys", "<u8"), _joined(table, "dfs", "<i4")
    ids, of_entry = np.unique(sigs, return_inverse=True)
    of = np.repeat(of_entry, lens)
    n = np.zeros(len(ids), np.int64)
    n[of_entry] = ns
    order = np.lexsort((keys, dfs, of))
    keys, of = keys[order], of[order]
    shared = np.bincount(of, minlength=len(ids))
    alone = n - shared
    live = alone <= (n * (DEN - NUM)) // DEN  # the first floor(n / 4) + 1 must not all be its own
    parts = _split(keys, shared)
    at = np.flatnonzero(live)
    return pa.table(
        {
            "sig": pa.array(ids[at]),
            "n": pa.array(n[at]),
            "alone": pa.array(alone[at]),
            "keys": pa.array([parts[i].tobytes() for i in at.tolist()], pa.binary()),
        }
    )


def _release(spark) -> None:
    """Let Spark delete the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def linkable(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """sig, n, alone (shingles in no other set), keys (all others, rarest first) of the sets that can link."""
    size = known.filter("sig is not null").groupBy("sig").agg(F.max("n_shingles").alias("n")).agg(F.count("*").alias("sets"), F.sum("n").alias("n")).first()
    if not size["sets"]:
        return docs.sparkSession.createDataFrame([], "sig long, n long, alone long, keys binary")
    parts, groups = -(-size["n"] // SHINGLES), -(-size["sets"] // DOCS)
    hot = _hot(known, size["sets"])
    # at most as many entries as every set times every hot shingle
    hot_parts = max(1, min(groups, -(-size["sets"] * len(hot) // SHINGLES)))
    counted = _dealt(docs, parts, text, hot, hot_parts).groupBy("part").applyInArrow(_counted(groups), ", ".join(f"{c} {'long' if c == 'grp' else 'binary'}" for c in _BACK))
    return counted.groupBy("grp").applyInArrow(_ordered, "sig long, n long, alone long, keys binary")


_ENTRY = "key long, sig long, n int, i int, alone double"


def entries(links: DataFrame) -> DataFrame:
    """The index: one row for each set and shingle of its prefix: key, sig, n, place i, share of own shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, alone, sig = (batch.column(c).to_numpy() for c in ("n", "alone", "sig"))
            first = n * (DEN - NUM) // DEN + 1 - alone
            cut = [np.frombuffer(k, "<i8")[:f] for k, f in zip(batch.column("keys").to_pylist(), first.tolist(), strict=True)]
            lens = np.array([len(c) for c in cut], np.int64)
            of = np.repeat(np.arange(len(n)), lens)
            i = np.arange(len(of)) - np.repeat(np.cumsum(lens) - lens, lens) + alone[of]
            key = np.concatenate(cut) if cut else np.zeros(0, np.int64)
            arrays = [key.astype(np.int64), sig[of], n[of].astype(np.int32), i.astype(np.int32), (alone / n)[of]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["key", "sig", "n", "i", "alone"])

    return links.select("sig", "n", "alone", "keys").mapInArrow(run, _ENTRY)


def _overlaps(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """x, y, nx, ny, both (|x & y|) for pairs x, y."""
    side = lambda s: links.select(F.col("sig").alias(s), F.col("n").alias(f"n{s}"), F.col("keys").alias(f"k{s}"))
    found = pairs.join(side("x"), "x").join(side("y"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for a, b in zip(batch.column("kx").to_pylist(), batch.column("ky").to_pylist(), strict=True):
                all_keys = np.sort(np.frombuffer(a + b, "<u8"))
                both.append(int((all_keys[1:] == all_keys[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "y", "nx", "ny")), pa.array(both, pa.int64())], names=["x", "y", "nx", "ny", "both"])

    return found.select("x", "y", "nx", "ny", "kx", "ky").mapInArrow(run, "x long, y long, nx long, ny long, both long")


def _reached() -> F.Column:
    return DEN * F.col("both") >= NUM * (F.col("nx") + F.col("ny") - F.col("both"))


def _pairs(table: pa.Table) -> pa.Table:
    """Pairs of sets in the same list that size, place and the leader's answers leave open, of different classes."""
    cols = {c: table[c].to_numpy() for c in ("key", "sig", "n", "i", "cls", "block")}
    both = table["both"].to_numpy(zero_copy_only=False)
    a_, b_ = table["a"][0].as_py(), table["b"][0].as_py()
    order = np.lexsort((cols["sig"], cols["n"], cols["key"]))
    key, sig, n, i, cls, block = (cols[c][order] for c in ("key", "sig", "n", "i", "cls", "block"))
    n, i = n.astype(np.int64), i.astype(np.int64)
    both = both.astype(np.float64)[order]
    edge = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    run_end = edge[np.searchsorted(edge, np.arange(len(key)), side="right")]
    count = run_end - np.arange(len(key)) - 1
    found: list[np.ndarray] = []
    at = 0
    ends = np.cumsum(count)
    while at < len(key):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000, side="right")))
        c = count[at:upto]
        x = np.repeat(np.arange(at, upto), c)
        y = np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c) + x + 1
        at = upto
        ok = (cls[x] != cls[y]) & ((block[x] != block[y]) if a_ != b_ else True)
        x, y = x[ok], y[ok]
        # the least overlap that links sets of these sizes
        need = -(-NUM * (n[x] + n[y]) // (NUM + DEN))
        ok = (n[x] * DEN >= NUM * n[y]) & (np.minimum(n[x] - i[x], n[y] - i[y]) >= need)
        x, y, need = x[ok], y[ok], need[ok]
        most = np.minimum(both[x], both[y]) + np.minimum(n[x] - both[x], n[y] - both[y])
        ok = ~(most < need)
        x, y = sig[x[ok]], sig[y[ok]]
        if len(x):
            found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
    out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.table({"x": pa.array(out[:, 0]), "y": pa.array(out[:, 1])})


def links(sets_: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Enough verified links (a, b) between sets for their connected components (no class is left unjoined),
    and the stored tables that they are read from."""
    spark = sets_.sparkSession
    index = store(entries(sets_), "jaccard-index")
    lists = index.groupBy("key").agg(F.min_by(F.struct("sig", "n", "i"), F.struct("alone", "sig")).alias("leader"), F.count("*").alias("many"))
    led = index.join(lists.filter("many > 1"), "key")
    # sets against the leaders of their lists: as many pairs as entries at most
    need = F.ceil(NUM * (F.col("n") + F.col("leader.n")) / (NUM + DEN))
    possible = (F.least(F.col("n") - F.col("i"), F.col("leader.n") - F.col("leader.i")) >= need) & (F.col("sig") != F.col("leader.sig"))
    pairs = led.filter(possible).select(F.col("sig").alias("x"), F.col("leader.sig").alias("y")).distinct()
    first = store(_overlaps(pairs, sets_), "jaccard-leaders")
    _release(spark)
    linked = first.filter(_reached()).select(F.col("x").alias("a"), F.col("y").alias("b"))
    classes = components(linked)
    # what the leaders leave open: lists that still hold sets of different classes
    rows = index.join(classes, index["sig"] == classes["node"], "left").withColumn("cls", F.coalesce("component_id", "sig")).drop("node", "component_id")
    mixed = rows.groupBy("key").agg(F.min_by(F.struct("sig", "n"), F.struct("alone", "sig")).alias("leader"), F.count("*").alias("many"), F.min("cls").alias("c0"), F.max("cls").alias("c1"))
    mixed = mixed.filter("c0 <> c1").select("key", "leader", "many")
    open_ = rows.join(mixed, "key").withColumn("y", F.col("leader.sig"))
    answers = first.select(F.col("x").alias("sig"), "y", "both")
    open_ = open_.join(answers, ["sig", "y"], "left").withColumn("both", F.when(F.col("sig") == F.col("y"), F.col("n")).otherwise(F.col("both")))
    blocks = F.ceil(F.col("many") / LIST).cast("int")
    block = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    small = F.col("many") <= LIST
    groups = max(1, -(-index.count() // ENTRIES))
    open_ = open_.withColumn("block", block).withColumn("g", F.when(small, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.col("key")))
    open_ = open_.withColumn("other", F.explode(F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))))
    open_ = open_.select("g", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "key", "sig", "n", "i", "cls", "block", "both")
    more = open_.groupBy("g", "a", "b").applyInArrow(_pairs, "x long, y long").distinct()
    second = _overlaps(more, sets_).filter(_reached()).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return linked.unionByName(second), [index, first]


def _rooted(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, root (one for each class; null without shingles) and the columns of `keep` for every row."""
    known = store(sets(docs, id, text, keep), "jaccard-sets")
    able = store(linkable(docs, known, text), "jaccard-linkable")
    _release(docs.sparkSession)
    edges, used = links(able)
    joined = components(edges)
    for table in (able, *used):
        discard(table)
    return known.join(joined, known["sig"] == joined["node"], "left").withColumn("root", F.coalesce("component_id", "sig")).select("doc_id", "n_shingles", "root", *keep)


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row."""
    rooted = _rooted(docs, id, text)
    # stored, so that the join below stands alone and Spark can split a class that holds many documents
    heads = store(rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("head")), "jaccard-heads")
    return rooted.join(heads, "root", "left").select("doc_id", "n_shingles", F.coalesce("head", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class stays, that with the smallest doc_id (of rows with one doc_id, one; a null id
    comes last); all rows without shingles stay."""
    # stored, so that a row keeps its number
    rows = store(docs.withColumn(_ROW, F.monotonically_increasing_id()), "jaccard-rows")
    rooted = store(_rooted(rows, keep=(_ROW,)), "jaccard-roots")
    first = F.min_by(_ROW, F.struct(F.col("doc_id").isNull(), "doc_id", _ROW)).alias(_ROW)
    keep = rooted.filter("root is not null").groupBy("root").agg(first).select(_ROW).unionByName(rooted.filter("root is null").select(_ROW))
    return rows.join(keep, _ROW, "left_semi").select(docs.columns)
