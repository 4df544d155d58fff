"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, html, jaccard, lexical, licences, mixing, pieces, pii, quality, toxicity, vectors
from .common import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.contract(read_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.contract(read_table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.contract(read_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.contract(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.contract(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.contract(read_table(spark, sf_dir, "pages"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.contract(read_table(spark, sf_dir, "documents"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.contract(read_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.contract(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7_pii that follows from patterns and checksums alone, which SQL can express."""
    return op7_pii(spark, sf_dir).drop("spans", "scores", "n_added")


_ALL = (op1_quality_classifier, op2_licence_scan, op3_sentencepiece, op4_embedding_near_dedup, op5_ngram_jaccard, op6_mixing, op7_pii, op8_toxicity, op9_top_k, op10_html)
QUERIES = {f.__name__: f for f in (*_ALL, op11_bpe, op12_clustering, op13_lexical_search, pii_base_spans)}

#: Classes of documents or vectors: the smallest node that links reach.
_REACH = "reach(a, b) AS (SELECT x, y FROM links UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x), low AS (SELECT a, least(a, min(b)) m FROM reach GROUP BY a)"

_OP4 = f"""WITH RECURSIVE live AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id x, b.vec_id y FROM live a JOIN live b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
  {_REACH}, n AS (SELECT x, count(*) n FROM links GROUP BY x)
  SELECT vec_id, coalesce(n.n, 0)::BIGINT n_links, coalesce(m, vec_id) component_id, coalesce(m, vec_id) = vec_id kept
  FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.x = vec_id"""

_OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM w),
  n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
  links AS (SELECT a.doc_id x, b.doc_id y FROM s a JOIN s b USING (g) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
  {_REACH}
  SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, coalesce(m, d.doc_id) component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id"""

_OP9 = """WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT q.vec_id query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT score FROM c q JOIN c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def _matches(kind: str, pattern: str, checked: str) -> str:
    """Rows doc_id, kind, start and end of the matches of a pattern that a condition on the match m accepts; what
    stands between the matches tells where they are."""
    return rf"""SELECT doc_id, '{kind}' kind, b0 AS s, b0 + length(m) AS e FROM (
      SELECT doc_id, unnest(ms) m, unnest(list_transform(range(1, len(ms) + 1), lambda k: list_sum(list_transform(ps[1:k], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda q: length(q))), 0)))::BIGINT b0
      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') ms, string_split_regex(text, '{pattern}') ps FROM documents WHERE text IS NOT NULL)) WHERE {checked}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"
_PII = f"""WITH found AS ({_matches("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")}
  UNION ALL {_matches("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0")}
  UNION ALL {_matches("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}")}
  UNION ALL {_matches("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15")}),
  g AS (SELECT doc_id, count(*) FILTER (kind = 'email') n_email, count(*) FILTER (kind = 'ip') n_ip, count(*) FILTER (kind = 'card') n_card, count(*) FILTER (kind = 'phone') n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY list_position(['email', 'ip', 'card', 'phone'], kind), s) listed FROM found GROUP BY doc_id)
  SELECT doc_id, coalesce(n_email, 0)::BIGINT n_email, coalesce(n_ip, 0)::BIGINT n_ip, coalesce(n_card, 0)::BIGINT n_card, coalesce(n_phone, 0)::BIGINT n_phone, sha256(coalesce(listed, '')) base_sha256
  FROM documents LEFT JOIN g USING (doc_id)"""


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Rounds as a chain of common tables; whole numbers below 2^53 are exact as doubles."""
    dot = lambda a, b: f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
    out = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})"""
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (SELECT r, arg_min(c, {{'d': d, 'c': c}}) c, min(d) d FROM (SELECT k.r, c.c, ({dot("k.v", "k.v")} - 2 * {dot("k.v", "c.v")} + {dot("c.v", "c.v")})::BIGINT d FROM kept k, c{i} c) GROUP BY r)"""
        if i < rounds:
            out += f""", m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) v FROM (SELECT c, i, sum(x)::HUGEINT s, count(*) n FROM (SELECT a.c, unnest(k.v) x, unnest(range(64)) i FROM a{i} a JOIN kept k USING (r)) GROUP BY ALL) GROUP BY c),
    c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) v FROM c{i} LEFT JOIN m{i} USING (c))"""
    return out + f""" SELECT vec_id, c::INT AS cluster, d distance, (sum(d) OVER (PARTITION BY c))::BIGINT cluster_inertia, (sum(d) OVER ())::BIGINT inertia, sha256(array_to_string(c{rounds}.v, ',')) centroid_sha256
    FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)"""


_OP13 = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t FROM documents),
  g AS (SELECT count(*) FILTER (len(t) > 0) n_docs, sum(len(t))::BIGINT n_terms FROM d),
  q AS MATERIALIZED (SELECT DISTINCT row_number() OVER () q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM benchmark),
  f AS MATERIALIZED (SELECT r, term, count(*) tf FROM (SELECT r, unnest(t) term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT w FROM f, g GROUP BY term, n_docs),
  m AS (SELECT r, doc_id, 100 - 90 + (90 * len(t) * n_docs) // n_terms m FROM d, g WHERE len(t) > 0),
  s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM f JOIN w USING (term) JOIN m USING (r) JOIN q USING (term) GROUP BY ALL),
  o AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM s WHERE score > 0)
  SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""

#: The other operators are trained, hashed or need a vocabulary; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_embedding_near_dedup": _OP4,
    "op5_ngram_jaccard": _OP5,
    "op9_top_k": _OP9,
    "op12_clustering": _clusters(),
    "op13_lexical_search": _OP13,
    "pii_base_spans": _PII,
}
