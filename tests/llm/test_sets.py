"""Operators that compare rows with each other, and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waveloom.llm import graph, jaccard, mixing, pieces, pii, toxicity, vectors
from waveloom.llm.common import fold

from .fixtures import documents, empty, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def classes_of(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# -- components --------------------------------------------------------------------------------------


@pytest.mark.parametrize("n, m", [(30, 25), (60, 40), (40, 0)])
def test_components(spark, n, m):
    rnd = random.Random(n)
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)] * bool(m)
    got = {r.node: r.component_id for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = classes_of(pairs, {x for p in pairs for x in p})
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked and v != k} or {k: v for k, v in got.items() if k != v} == {k: v for k, v in want.items() if v != k}


# -- shingle sets ------------------------------------------------------------------------------------


def shingle_set(text):
    w = WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingle_set(t))
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return classes_of(pairs, ids), {i: len(s) for i, s in sets.items()}


def family(rnd, n, members, edits):
    base = [f"w{rnd.randrange(500)}" for _ in range(n)]
    for _ in range(members):
        w = list(base)
        for _ in range(rnd.randrange(edits)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randrange(2)] = [f"new{rnd.randrange(10**6)}"] * rnd.randrange(3)
        yield " ".join(w)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_like_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "SHINGLES", 3000)  # many parts, groups and blocks
    monkeypatch.setattr(jaccard, "DOCS", 40)
    monkeypatch.setattr(jaccard, "ENTRIES", 500)
    monkeypatch.setattr(jaccard, "LIST", 16)
    rnd = random.Random(seed)
    common = " ".join(f"c{i}" for i in range(60))
    texts = [t for _ in range(5) for t in family(rnd, rnd.randrange(30, 150), 14, 9)]
    texts += [common + " " + prose(rnd, rnd.randrange(6, 40)) for _ in range(25)] + [None, "", "one two", "ONE two", "x"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("n_shingles", F.lit("x"))
    got = jaccard.classes(docs).collect()
    want, sizes = brute_classes(rows)
    assert len(got) == len(rows) + 3
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_a_line_in_every_document_is_dealt_by_set(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHINGLES", 2000)
    monkeypatch.setattr(jaccard, "DOCS", 40)
    rnd = random.Random(14)
    line = " ".join(f"every{i}" for i in range(40))
    texts = [line + " " + prose(rnd, rnd.randrange(20, 60)) for _ in range(300)]
    texts += [line + " " + t for t in family(rnd, 50, 8, 4)] + [line, line + " x", prose(rnd, 30)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, sizes = brute_classes(rows)
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard.classes(docs).collect()} == {i: (want[i], sizes[i]) for i in want}
    known = jaccard.store(jaccard.sets(docs), "test")
    hot = jaccard._hot(known, 300)
    assert 30 <= len(hot) <= 60
    packed = jaccard._dealt(docs, 5, "text", hot, 4).collect()
    entries = Counter()
    for r in packed:
        entries[r.part] += len(r.keys) // (6 if r.part >= 0 else 8)
    assert len([p for p in entries if p < 0]) == 4 and max(entries.values()) < 2 * sum(entries.values()) / len(entries)


def test_jaccard_edge_cases(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, sizes = brute_classes(rows)
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard.classes(docs).collect()} == {i: (want[i], sizes[i]) for i in want}
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}
    assert jaccard.classes(empty(docs)).count() == 0


def test_deduplicated_decides_by_row(spark):
    rnd = random.Random(12)
    a, b, c, d = (prose(rnd, 60) for _ in range(4))
    # repeated rows, null ids alone and beside others, one id in two classes, rows without shingles
    rows = [(1, a), (1, a), (2, a), (3, b), (None, b), (None, c), (None, c), (3, a), (4, d), (1, d), (None, None), (None, ""), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = [(1, a), (3, b), (None, c), (1, d), (None, None), (None, ""), (5, None), (5, None)]
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    docs = documents(spark)
    found, _ = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.deduplicated(docs).count() == sum(found[i] == i for i in found)


# -- vectors -----------------------------------------------------------------------------------------


def some_vectors(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(12, 8))
    v = [(b + rnd.normal(size=8) * rnd.choice([0.05, 0.3])).astype(np.float32).tolist() for b in base for _ in range(12)]
    v += [v[0]] * 20 + [None, [], [0.0] * 8, [float("nan")] * 8, [None] + [1.0] * 7, [float("inf")] * 8, [-0.0] * 8, [1.0, 2.0], [2.0, 4.0], [1e30] * 8, [1e-30] * 8]
    return spark.createDataFrame([(i, x, i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("node", F.lit(1))


def clean(x):
    return x is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x)


def test_near_duplicates_like_brute_force(spark):
    df = some_vectors(spark)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    live = [(i, np.array(x, float)) for i, x in rows if clean(x) and any(x)]
    pairs = []
    for k, (i, x) in enumerate(live):
        for j, y in live[:k]:
            if len(x) == len(y):
                x1, y1 = x / np.abs(x).max(), y / np.abs(y).max()
                if x1 @ y1 / np.sqrt((x1 @ x1) * (y1 @ y1)) >= 0.9:
                    pairs.append((i, j))
    want, degree = classes_of(pairs, [i for i, _ in rows]), Counter(x for p in pairs for x in p)
    for size in (16, 4096):
        got = vectors.near_duplicates(df, rows=size).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (degree[i], want[i], want[i] == i) for i, _ in rows}
    assert vectors.near_duplicates(empty(df)).count() == 0


def test_near_duplicates_without_ids(spark):
    a, b, c = [1.0, 0.0, 0.1], [1.0, 0.05, 0.1], [0.0, 1.0, 0.0]
    rows = [(None, a), (5, b), (7, a), (None, c), (None, None), (9, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(vectors.near_duplicates(df).collect(), key=repr)
    want = [(None, 2, 5, False), (5, 2, 5, True), (7, 2, 5, False), (None, 0, None, True), (None, 0, None, True), (9, 0, 9, True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_near_duplicates_in_many_cells(spark):
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(40, 6))
    v = [(b + rnd.normal(size=6) * 0.2).tolist() for b in base for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    m = np.array(v)
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    x, y = np.nonzero(np.triu(m @ m.T >= 0.9, 1))
    want, degree = classes_of(zip(x.tolist(), y.tolist()), range(len(v))), Counter([*x.tolist(), *y.tolist()])
    for size in (16, 100):
        assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, rows=size).collect()} == {i: (degree[i], want[i]) for i in range(len(v))}


def test_top_k_like_brute_force(spark, monkeypatch):
    df = some_vectors(spark).filter("vec_id < 165 or vec_id in (168, 169, 170, 171, 172)")
    live = [(r.vec_id, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in df.collect() if clean(r.embedding)]
    want = {}
    for i, x in live:
        if i % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in live if j != i and len(x) == len(y))
            want[i] = [(j, -s) for s, j in scores[:5]]
    for slices, size, sent in ((2, 16, 0), (4, 4096, 0), (2, 16, 1 << 20)):
        monkeypatch.setattr(vectors, "SENT_BYTES", sent)
        got = {}
        for r in vectors.top_k(df, F.col("vec_id") % 10 == 0, slices=slices, rows=size).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == {i: w for i, w in want.items() if w}
    assert vectors.top_k(empty(df), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_top_k_of_repeated_ids_and_ties(spark, monkeypatch, sent):
    monkeypatch.setattr(vectors, "SENT_BYTES", sent)
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 5.0]), (3, [-1.0, 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in vectors.top_k(df, F.col("vec_id") == 0, k=2).collect())
    a, b = [(0, 2 * 65536), (1, 65536)], [(0, 2 * 65536), (1, 2 * 65536)]
    assert got == sorted((0, n + 1, i, s) for w in (a, b) for n, (i, s) in enumerate(w))


def test_search_resolves_few_entries(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(4000, 32)).tolist()
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").repartition(2)
    counts = vectors.resolved(df, F.col("vec_id") % 50 == 0).agg(F.sum("resolved")).first()[0]
    assert counts < 0.2 * 80 * 4000


# -- mixing ------------------------------------------------------------------------------------------


def sizes_of(rows):
    return {r.doc_id: len(WORD.findall((r.text or "").encode())) for r in rows}


def targets_of(by_source):
    """Proportional shares; what exceeds twice a source's size is shared anew until none does."""
    names = sorted([s for s in by_source if s is not None]) + [None] * (None in by_source)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    rest, fixed = 1.5 * sum(by_source.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 2 * by_source[s] + 1e-9]
        if not over:
            return fixed | {s: rest * weight[s] / total for s in free}
        for s in over:
            fixed[s] = 2.0 * by_source[s]
        rest = 1.5 * sum(by_source.values()) - sum(fixed.values())


def test_mixing(spark):
    docs = documents(spark)
    rows = docs.collect()
    got = mixing.contract(docs).collect()
    again = mixing.contract(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert len(got) == len(rows)
    size, source = sizes_of(rows), {r.doc_id: r.source for r in rows}
    total = Counter()
    for r in rows:
        total[r.source] += size[r.doc_id]
    want = targets_of(total)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == total[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in total:
        assert taken[s] == pytest.approx(want[s], rel=0.1, abs=2 * mixing.BLOCK)
    assert mixing.contract(empty(docs)).count() == 0


def test_mixing_targets(spark):
    for by_source in ({"a": 10, "b": 1000, "c": 50, None: 5}, {"a": 7}, {"a": 0, "b": 9}, {"a": 100, "b": 1, "c": 1, "d": 900, "e": 30}):
        df = spark.createDataFrame(list(by_source.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(targets_of(by_source))


def hashed(spark, values, kind, build):
    """build(column) of each value, computed by Spark."""
    values = sorted(set(values), key=repr)
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}").select(build(F.col("v")).alias("h")).collect()
    return {v: r.h for v, r in zip(values, rows, strict=True)}


def brute_slots(spark, sources, block, per_shard, seed=7):
    """The mix one slot after the other: a Counter of (src, block)."""
    plan = [(r.src, -(-r.source_size // block), round(-(-r.source_size // block) * r.target / r.source_size) if r.source_size else 0) for r in sources]
    total = sum(n for *_, n in plan)
    uniform = hashed(spark, range(total), "long", lambda c: mixing._uniform(F.lit(seed), c))
    part = hashed(spark, range(total // per_shard + 1), "long", lambda c: F.pmod(F.xxhash64(c), F.lit(mixing.SPREAD)))
    perms = {s: [r.p for r in spark.range(b).orderBy("id").select(mixing.permuted("id", f"CAST({b} AS BIGINT)", str(s)).alias("p")).collect()] for s, b, n in plan if n}
    draws = Counter()
    for i in range(total):
        at, u = 0, uniform[i] * total
        for s, _, n in plan:
            at += n
            if u < at:
                draws[i // per_shard, s] += 1
                break
    done, excess, out = Counter(), 0, Counter()
    want = {s: (b, n) for s, b, n in plan}

    def take(s):
        b, _ = want[s]
        out[s, perms[s][done[s] % b]] += 1
        done[s] += 1

    for shard in sorted({k for k, _ in draws}, key=lambda k: (part[k], k)):
        for s, _, n in plan:
            for _ in range(draws[shard, s]):
                if done[s] < n:
                    take(s)
                else:
                    excess += 1
    for s, _, n in plan:
        while done[s] < n:
            excess -= 1
            take(s)
    assert excess == 0
    return out


@pytest.mark.parametrize("shape", ["many", "giant", "long"])
def test_mixing_like_one_slot_after_the_other(spark, shape):
    rnd = random.Random(17)
    if shape == "many":
        rows = [(i, rnd.choice([None, "a", "b", "c", "d"]), prose(rnd, rnd.choice([0, 3, 40, 300]))) for i in range(150)]
    elif shape == "giant":
        rows = [(i, "a" if i else "b", prose(rnd, 50 if i else 5)) for i in range(200)]
    else:  # one text longer than a shard has slots
        rows = [(1, "a", prose(rnd, 70_000)), (2, "b", prose(rnd, 900)), (3, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.contract(docs).collect()
    sizes = {i: len((t or "").split()) for i, _, t in rows}
    sources = sorted(mixing.targets(docs.select("source", mixing.n_words("text").alias("size"))).collect(), key=lambda r: r.src)
    times = brute_slots(spark, sources, mixing.BLOCK, mixing.SLOTS)
    number = {r.source: r.src for r in sources}
    part = hashed(spark, sizes, "long", lambda c: F.pmod(F.xxhash64(c), F.lit(mixing.SPREAD)))
    want = {}
    for source, src in number.items():
        at = 0
        for i in sorted((i for i, s, _ in rows if s == source), key=lambda i: (part[i], i)):
            want[i] = sum(times[src, (at + k) // mixing.BLOCK] for k in range(sizes[i]))
            at += sizes[i]
    assert {r.doc_id: r.taken for r in got} == want
    # targets are met to a block, though every slot was drawn
    for r in sources:
        assert abs(sum(want[i] for i, s, _ in rows if s == r.source) - r.target) <= 2 * mixing.BLOCK


def test_draws_are_multinomial(spark):
    plan = spark.createDataFrame([(0, 6000), (1, 3000), (2, 1000)], "src int, slots long")
    got = mixing.drawn(spark, plan, 10_000, 100).collect()
    assert sum(r.n for r in got) == 10_000
    by_shard = [[r.n for r in got if r.src == s] for s in range(3)]
    for counts, share in zip(by_shard, (0.6, 0.3, 0.1), strict=True):
        counts += [0] * (100 - len(counts))
        mean, var = np.mean(counts), np.var(counts)
        assert abs(mean - 100 * share) < 3 and 0.6 < var / (100 * share * (1 - share)) < 1.5


def test_repeated_rows_take_their_own_blocks(spark):
    rnd = random.Random(18)
    text = prose(rnd, 100)
    docs = spark.createDataFrame([(1, text, "a", 5)] * 9 + [(None, text, "b", 5), (None, text, "b", 5), (2, "  " + prose(rnd, 900) + " \n", None, 5)], "doc_id long, text string, source string, n_chars long")
    taken = mixing.contract(docs).collect()
    mixed = mixing.apply(docs)
    size = lambda t: len(t.split())
    for i in (1, 2, None):
        assert sorted(size(r.text) for r in mixed.collect() if r.doc_id == i) == sorted(r.taken for r in taken if r.doc_id == i and r.taken)
    assert all(r.n_chars == len(r.text) for r in mixed.collect())


def test_mixed_texts_hold_what_was_taken(spark):
    docs = documents(spark).dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken for r in mixing.contract(docs).collect()}
    mixed = mixing.apply(docs)
    assert mixed.columns == docs.columns
    assert {i: n for i, n in sizes_of(mixed.collect()).items()} == {i: n for i, n in taken.items() if n}


def test_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        got = spark.range(n).select(mixing.permuted("id", f"CAST({n} AS BIGINT)", "5").alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mixing_is_native(spark):
    plan = mixing.contract(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- pipeline ----------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(6)
    docs = documents(spark).dropDuplicates(["doc_id"]).filter("doc_id < 40")
    toxic = spark.createDataFrame([(100 + i, prose(rnd, 30) + " vilest scummy rotten", "en", "a", 0) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    private = spark.createDataFrame([(300, prose(rnd, 200) + " write to someone@mail.example.com", "en", "a", 0)], toxic.schema)
    docs = docs.select(toxic.columns).unionByName(toxic).unionByName(private)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(100 + i, 1, 1) for i in range(30)] + [(i, 1, 0) for i in range(5, 40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir, now = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf_dir)
        path = f"{tmp_path}/out-{len(seen)}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        seen.append((now, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        now = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    # toxicity: rejected documents go, the others stay whole
    a, b = seen[0]
    model = toxicity.fit(a, spark.read.parquet(f"{tmp_path}/labels.parquet"), fold("doc_id", 5) == 0)
    assert ids(b) == {r.doc_id for r in toxicity.score(a, model).filter("score < 0.5").collect()}
    assert len(ids(b) & set(range(100, 130))) <= 3 and set(range(40)) <= ids(b)
    # near-duplicates: the smallest id of each class stays
    a, b = seen[1]
    want, _ = brute_classes([(r.doc_id, r.text) for r in a.collect()])
    assert ids(b) == {i for i, c in want.items() if i == c}
    # personal data: nothing that the base patterns find is left
    a, b = seen[2]
    assert ids(a) == ids(b) and not [s for r in b.collect() for s in pii.find(r.text or "") if s["base"]]
    assert "<EMAIL>" in b.filter("doc_id = 300").first().text
    # mixing: every text holds what the mix takes of it
    a, b = seen[3]
    taken = {r.doc_id: r.taken for r in mixing.contract(a).collect()}
    assert sizes_of(b.collect()) == {i: n for i, n in taken.items() if n}
    # pieces: what is encoded is what was mixed
    a, b = seen[4]
    codec = pieces.pieces(pieces.model_path())
    texts = {r.doc_id: r.text for r in a.collect()}
    for r in b.collect():
        flat, _ = codec.encode([texts[r.doc_id]])
        assert r.ids == flat.tolist() and r.n_tokens == len(r.ids)
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {r.doc_id: r.n_tokens for r in seen[-1][1].collect()}
