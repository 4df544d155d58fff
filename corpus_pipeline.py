"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again for the next one.  All but the last keep the columns of `documents`; each works on everything
that the one before it kept.  Rows with null texts count as empty; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm import jaccard, mixing, pieces, pii, toxicity
from waveloom.llm.common import fold, read_table, store


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    held_out = fold("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), held_out)
    plain = docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c.lower() == "score"})
    kept = toxicity.score(plain, model).filter(F.col("score") < 0.5).drop("score")
    return kept.withColumnsRenamed({f"__own_{c}": c for c in docs.columns if c.lower() == "score"}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id."""
    return jaccard.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _counted(pii.mask(docs)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents hold the words that the mix of sources takes of them."""
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, decoded_sha256."""
    coded = pieces.encode(docs.select("doc_id", "source", "text"), decoded=True, keep=["doc_id", "source"])
    digest = F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), digest)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express none of the trained stages; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, f"pipeline-{k}")
    return docs
