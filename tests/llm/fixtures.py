"""Small documents that hold what tables may hold: nulls, empty and long texts, copies, clashing columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
CLASH = "score double, spans string, ids string, n_shingles int, size string, target string, src int, block int, n int, decoded string, rank int, Text2 string"


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def documents(spark, extra=True):
    rnd = random.Random(7)
    base = prose(rnd, 200)
    words = base.split()
    near = " ".join("changed" if i == 50 else w for i, w in enumerate(words))
    far = " ".join("changed" if i % 12 == 0 else w for i, w in enumerate(words))
    texts = [None, "", " \n\t ", "one", "three short words", base, base, base.upper(), "  " + base.replace(" ", "\n"), near, far, prose(rnd, 30_000), "x" * 50_000, "é漢字 😀 ▁▁ a  b", prose(rnd, 12)]
    texts += [prose(rnd, rnd.randrange(5, 90)) for _ in range(40)]
    rows = [(i, t, "en", [None, "b", "a", "ä"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[12]]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for c in CLASH.split(", "):
            name, kind = c.split()
            df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def empty(df):
    return df.limit(0)
