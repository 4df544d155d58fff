"""Byte-pair encoding, centroid clustering and ranked search against the library and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.llm import bpe, clusters, lexical

from .fixtures import documents, empty, prose

# -- bpe ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def odd_texts():
    rnd = random.Random(3)
    texts = ["", "a", "aaaaaaaaaaaaaaa bbbbbbbbbb", "x" * 3000, "Hi <|endoftext|>World's<|startoftext|> <|ENDOFTEXT|>", "ΑΣ Σ İx ß ǅ", "é é ẛ̣", "don't THEY'LL 's's 123½²", "\x1c\x1da\x85b\xa0c​d", "--==..!!??", "🏳️‍🌈 漢字かな 한국어", "Ᲊ Ɤ 𖺠 ՘"]
    pools = [range(32, 127), range(32, 0x600), range(32, 0xD800), [ord(c) for c in "aeiounrst' "]]
    return texts + ["".join(chr(rnd.choice(pools[k % 4])) for _ in range(rnd.randrange(1, 80))) for k in range(800)]


def test_bpe_as_library(library):
    codec, texts = bpe.words(bpe.tokenizer_path()), odd_texts()
    raw = codec.encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(r, "<i4").tolist() for r in raw] == want
    assert codec.decode(raw) == [library.decode(w, skip_special_tokens=False) for w in want]
    assert 0 < codec.failed < codec.proposed  # both ways are taken


def test_compatible_pairs_as_exact_merges():
    codec, rnd = bpe.words(bpe.tokenizer_path()), random.Random(5)
    names = {i: t for t, i in codec.vocab.items()}
    byte_of = {c: b for b, c in enumerate(bpe._byte_chars())}
    raw = lambda t: bytes(byte_of[c] for c in t.removesuffix("</w>"))
    inner = [i for i, t in names.items() if not t.endswith("</w>") and codec.exact(raw(t), False) == [i]]
    left = np.array([rnd.choice(inner) for _ in range(4000)])
    right = np.array([rnd.choice(inner) for _ in range(4000)])
    # make many pairs whose border could merge: parts of real tokens
    for k in range(0, 4000, 2):
        whole = rnd.choice([i for i in rnd.sample(inner, 20) if codec.rank[i] >= 0])
        left[k], right[k] = codec.first[whole], codec.second[whole]
    good = [codec.exact(raw(names[a]), False) == [a] and codec.exact(raw(names[b]), False) == [b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    want = [codec.exact(raw(names[a]) + raw(names[b]), False) == [a, b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    got = codec.compatible(left, right).tolist()
    assert [g for g, ok in zip(got, good, strict=True) if ok] == [w for w, ok in zip(want, good, strict=True) if ok]


def test_bpe_of_documents(spark, library):
    docs = documents(spark)
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.contract(docs).collect())) == want
    assert bpe.contract(empty(docs)).count() == 0
    coded = bpe.encode(docs, decoded=True)
    assert set(coded.columns) == set(docs.columns)  # ids and decoded take the place of columns so named
    again = bpe.decode(coded.withColumnRenamed("decoded", "was"))
    assert again.filter(~F.col("decoded").eqNullSafe(F.col("was"))).count() == 0
    assert [r.decoded for r in bpe.decode(spark.createDataFrame([(None,), ([],), ([320, -1, 10**6],)], "ids array<int>")).collect()] == ["", "", library.decode([320])]


# -- clusters ----------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dim):
    """rows: (id, vector or None) -> {(id, cluster, distance): times}, centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, some in groups.items():
            centroids[n] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), centroids


def vectors_of(spark, n, dim, scale=1.0, spread=4):
    rnd = np.random.default_rng(n)
    middles = rnd.normal(size=(spread, dim))
    rows = [(i, (scale * (middles[i % spread] + 0.2 * rnd.normal(size=dim))).tolist(), "x") for i in range(n)]
    rows += [rows[3], rows[3], (n, rows[5][1], "y"), (n + 1, None, "z"), (n + 2, [float("nan")] * dim, None), (n + 3, [1.0] * (dim - 1), ""), (n + 4, [None] * dim, ""), (None, rows[7][1], ""), (n + 5, [0.0] * dim, "")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")


@pytest.mark.parametrize("n, dim, k, scale", [(150, 8, 12, 1.0), (60, 8, 80, 1.0), (80, 5, 6, 1e7), (40, 4, 5, 1e12)])
def test_clusters_as_brute_force(spark, n, dim, k, scale):
    rows, df = vectors_of(spark, n, dim, scale)
    found, centroids = clusters.clustered(df, k=k, rounds=4, dim=dim, pivots=5)
    want, middles = brute_clusters([r[:2] for r in rows], k, 4, dim)
    assert centroids.tolist() == middles
    top = (1 << 63) - 1
    assert Counter((r.vec_id, r.cluster, r.distance) for r in found.collect()) == Counter({(i, c, min(d, top)): t for (i, c, d), t in want.items()})


def test_simplex_bounds_hold_and_prune():
    rnd = np.random.default_rng(0)
    middles = 400 * rnd.normal(size=(30, 64))
    v = (middles[rnd.integers(0, 30, 900)] + 60 * rnd.normal(size=(900, 64))).astype(np.int64)
    c = middles.astype(np.int64)
    simplex = clusters.Simplex.of(c, 16)
    (f, h), (cf, ch) = (simplex.apexes(np.sqrt(clusters.distances(x, simplex.pivots).astype(float))) for x in (v, c))
    real = clusters.distances(v, c)
    flat = ((f[:, None] - cf[None]) ** 2).sum(axis=2)
    assert (flat + (h[:, None] - ch) ** 2 <= real * (1 + 1e-9) + 1).all() and (flat + (h[:, None] + ch) ** 2 >= real * (1 - 1e-9) - 1).all()
    cluster, distance, compared = clusters.nearest(v, (f, h), c, simplex)
    assert (cluster == real.argmin(axis=1)).all() and (distance == real.min(axis=1)).all()
    assert compared.mean() < 10  # of 30


def test_clusters_of_nothing(spark):
    _, df = vectors_of(spark, 10, 64)
    got = clusters.contract(df.limit(0))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(50)], "vec_id long, embedding array<float>")
    assert {(r.cluster, r.distance, r.inertia) for r in clusters.contract(same).collect()} == {(0, 0, 0)}


# -- lexical -----------------------------------------------------------------------------------------

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, k):
    split = lambda t: _TERM.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(i, split(t)) for i, t in docs if split(t)]
    n_docs, n_terms, df = len(found), sum(len(w) for _, w in found), Counter(t for _, w in found for t in set(w))
    out = Counter()
    for item, text in items:
        scores = []
        for i, words in found:
            m, tf = 10 + 90 * len(words) * n_docs // n_terms, Counter(words)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(split(text)) if t in tf)
            if s > 0:
                scores.append((-s, i is None, i))
        out.update((item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]))
    return out


@pytest.mark.parametrize("block_bytes, head", [(1 << 20, 4096), (300, 5), (1 << 20, 1)])
def test_ranks_as_brute_force(spark, block_bytes, head):
    rnd = random.Random(2)
    docs = documents(spark)
    docs = docs.unionByName(spark.createDataFrame([(None, prose(rnd, 30), "en", "a", 1)], docs.select(docs.columns[:5]).schema), allowMissingColumns=True)
    items = [(i, prose(rnd, rnd.randrange(1, 12))) for i in range(30)] + [(30, None), (31, ""), (32, "!!"), (3, "alpha beta"), (33, "nowhere"), (34, "Alpha ALPHA alpha"), (35, "é漢字 x")]
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, score int")
    got = Counter(map(tuple, lexical.ranked(docs, table, block_bytes=block_bytes, head=head).collect()))
    assert got == brute_ranks([(r.doc_id, r.text) for r in docs.collect()], items, 10)


def test_ranks_of_nothing(spark):
    docs, items = documents(spark), spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    for a, b in ((empty(docs), items), (docs, empty(items)), (docs, items.withColumn("text", F.lit("???")))):
        assert lexical.ranked(a, b).count() == 0
    got = lexical.ranked(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and 0 < got.count() <= 10


def test_ranking_prunes():
    """Cutoffs from earlier buckets spare most pairs their exact score."""
    rnd = np.random.default_rng(1)
    weights = np.append(0, rnd.integers(500, 9000, 4000))
    asked = [np.sort(rnd.choice(np.arange(1, 4001), 20, replace=False)) for _ in range(40)]
    docs = [np.sort(rnd.choice(np.arange(1, 4001), 60, replace=False)) for _ in range(3000)]
    docs[5:2900:100] = [asked[k] for k in range(29)]
    docs = sorted(docs, key=len, reverse=True)
    ranking, want = lexical.Ranking(asked, weights, 3), []
    for k in range(0, 3000, 300):
        some = docs[k : k + 300]
        term, row = np.concatenate(some), np.repeat(np.arange(len(some)), [len(d) for d in some])
        ranking.bucket(np.arange(k, k + len(some)), np.sqrt([len(d) * 500_000.0**2 for d in some]), term, row, np.full(len(term), 500_000))
    for q, a in enumerate(asked):
        scores = sorted((-int(500_000 * weights[np.intersect1d(a, d)].sum()), i) for i, d in enumerate(docs))
        want += [(q, -s, i) for s, i in scores[:3] if s < 0]
    assert list(zip(*(x.tolist() for x in ranking.best), strict=True)) == want
    assert ranking.scored < 0.3 * ranking.seen


# -- mended in this round ----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "snippet",
    ['<p class="ad-hoc">stays</p>', '<div class="comment-period"><p>stays</p></div>', '<section id="subscription-economy"><p>stays</p></section>', '<div class="widget"><p>stays</p></div>', '<p class="signup-fee">stays</p>', '<p>By <span class="login">stays</span> today.</p>', "<fieldset><p>stays</p></fieldset>"],
)
def test_names_inside_articles_do_not_remove_text(spark, snippet):
    from waveloom.llm import html

    rows = [(1, "http://a.example/1", f"<html><body><nav>menu</nav><article><h1>T</h1><p>first</p>{snippet}</article></body></html>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).first().text
    assert "stays" in got and "menu" not in got
    # names of furniture alone, and of reader comments, still do
    for gone in ('<div class="ad">x9</div>', '<section class="reader-comments"><p>x9</p></section>', '<div class="sidebar">x9</div>', "<aside>x9</aside>", '<p class="ad">x9</p>'):
        assert "x9" not in "\n".join(html.Page(f"<article><p>a</p>{gone}</article>").main())


def test_context_window_cuts_no_words():
    from waveloom.llm import pii

    token = "q8Zt3LmN0pX7vB2yRk5W1d9cQ2w3E4r5T6y7U8i9"
    alone = [s["score"] for s in pii.find("a plain note " + token + " here")]
    for gap in range(60):
        text = "monkey " + "." * gap + " " + token
        assert [s["score"] for s in pii.find(text)] == alone, gap
    # (whole words within the window still count)
    assert pii.find("the key is " + token)[0]["score"] > max(alone, default=0.0)


def test_copies_of_rows_leave_toxicity_as_it_is(spark):
    from waveloom.llm import toxicity

    rnd = random.Random(9)
    rows = [(i, prose(rnd, 40) + (" vile scum rot" if i % 5 == 0 else ""), "x") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    again = spark.createDataFrame(rows + 6 * [r for r in rows if r[0] % 5], docs.schema)
    one, two = (toxicity.fit(d, lab) for d, lab in ((docs, labels), (again, labels.unionByName(labels.filter("toxic = 0")))))
    assert one == two
    scores = {r.doc_id: r.score for r in toxicity.score(docs, one).collect()}
    assert all((scores[i] > 0.5) == (i % 5 == 0) for i in scores)
    few = spark.createDataFrame([(0, "vile scum", "x")] + 4 * [(1, "good day", "x")] + [(2, "fine weather", "x")], docs.schema)
    model = toxicity.fit(few, spark.createDataFrame([(0, 1), (1, 0), (1, 0), (2, 0)], "doc_id long, toxic int"))
    assert all((r.score > 0.5) == (r.doc_id == 0) for r in toxicity.score(few, model).collect())


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Repeated rows, null ids, columns with clashing names, and no rows at all."""
    import corpus_pipeline

    rnd = random.Random(4)
    docs = documents(spark)
    more = [(None, prose(rnd, 50), "en", "a", 0), (None, prose(rnd, 50), "en", "a", 0)] + 12 * [(700, prose(rnd, 40), "en", "b", 0)] + [(800 + i, prose(rnd, 30) + " vile scum rot", "en", "a", 0) for i in range(20)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.select(docs.columns[:5]).schema), allowMissingColumns=True)
    labels = spark.createDataFrame([(800 + i, 1, 1) for i in range(20)] + [(i, 1, 0) for i in range(40)] + 12 * [(700, 1, 0)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        sf_dir = f"{tmp_path}/{name}"
        table.write.parquet(f"{sf_dir}/documents.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{sf_dir}/labels.parquet")
        now = spark.read.parquet(f"{sf_dir}/documents.parquet")
        kept = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, sf_dir).write.parquet(f"{sf_dir}/out-{k}")
            now = spark.read.parquet(f"{sf_dir}/out-{k}")
            kept.append([r.doc_id for r in now.select("doc_id").collect()])
            assert k == 4 or now.columns == docs.columns
        assert corpus_pipeline.run(spark, sf_dir).count() == len(kept[-1])
        if name == "none":
            assert kept == [[]] * 5
            continue
        clean = Counter(r.doc_id for r in docs.filter("doc_id is null or doc_id < 800").collect())
        assert len([i for i in kept[0] if i is not None and i >= 800]) <= 3  # held-out ones may stay
        assert Counter(i for i in kept[0] if i is None or i < 800) == clean
        # the second null id is another text; of repeated rows one stays
        assert Counter(kept[1])[None] == 2 and Counter(kept[1])[700] == 1 and Counter(kept[1])[7] == 0 and Counter(kept[1])[0] == 1
        assert Counter(kept[2]) == Counter(kept[1]) and set(kept[3]) <= set(kept[2]) and len(kept[4]) == len(kept[3])
