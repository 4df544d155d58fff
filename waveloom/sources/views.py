"""The driver tables seen as recordings: lazy views, and the same views as DuckDB SQL.

rec = supplier or user, ch = measured column or event type, bin = place in time order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABELS = ("trem", "notrem", "hold", "move")
CHANNELS = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, bin, qty, price, disc, tax: each supplier's line items in shipping order, a row a bin."""
    order = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("bin", (F.row_number().over(order) - 1).cast("long"))
    return rows.select(F.col("l_suppkey").alias("rec"), "bin", *[F.col(column).alias(ch) for ch, column in CHANNELS.items()])


def stacked(rows: DataFrame, channels: tuple[str, ...] = tuple(CHANNELS)) -> DataFrame:
    """Wide rows with a row for each of the channels: their other columns, ch, v."""
    pairs = ", ".join(f"'{ch}', {ch}" for ch in channels)
    rest = [c for c in rows.columns if c not in CHANNELS]
    return rows.select(*rest, F.expr(f"stack({len(channels)}, {pairs}) AS (ch, v)"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, ch, bin, v: four channels of each supplier's line items in shipping order."""
    return stacked(wide(spark, sf_dir)).select("rec", "ch", "bin", "v")


def anns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, label, b0, b1: nine intervals of 40 bins for each supplier."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rec"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    start = F.col("k") * 60 + F.col("rec") % 7
    return rows.select("rec", F.element_at(F.array(*map(F.lit, LABELS)), F.col("k") % 4 + 1).alias("label"), start.cast("long").alias("b0"), (start + 40).cast("long").alias("b1"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, ch, t (seconds since the user's first event), bin, v."""
    rows = table(spark, sf_dir, "events")
    # timestamps without a zone: microseconds from their parts, whatever the session's zone is
    whole = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour("ts") * 3600 + F.minute("ts") * 60
    sec = (whole * 1_000_000 + (F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("long")) / 1e6
    own = W.partitionBy("user_id")
    return rows.select(
        F.col("user_id").alias("rec"),
        F.col("event_type").alias("ch"),
        (sec - F.min(sec).over(own)).alias("t"),
        (F.row_number().over(own.orderBy("ts", "event_id")) - 1).cast("long").alias("bin"),
        F.col("value").alias("v"),
    )


def ivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, label, s, e (seconds): overlapping intervals after some kinds of event."""
    label = F.when(F.col("ch") == "purchase", "trem").when(F.col("ch") == "view", "notrem").otherwise("BAD_LFP")
    hours = F.when(F.col("ch") == "error", 6).otherwise(24)
    rows = events(spark, sf_dir).filter(F.col("ch").isin("purchase", "view", "error"))
    return rows.select("rec", label.alias("label"), F.col("t").alias("s"), (F.col("t") + hours * 3600).alias("e"))


def tfr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, ch, freq (1..32), re, im: halves of each vector as real and imaginary parts."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("rec"), F.col("vec_id").alias("ch"), "embedding")
    both = F.arrays_zip(F.slice("embedding", 1, 32).alias("re"), F.slice("embedding", 33, 32).alias("im"))
    rows = rows.select("rec", "ch", F.posexplode(both).alias("freq", "z"))
    return rows.select("rec", "ch", (F.col("freq") + 1).cast("int").alias("freq"), F.col("z.re").cast("double").alias("re"), F.col("z.im").cast("double").alias("im"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feat: feature names in all grammars, composed from the parts."""
    k, s = F.col("p_partkey"), F.col("p_size")
    band = lambda x: F.element_at(F.array(*map(F.lit, ("tremor", "beta", "gamma", "HFO"))), (x % 4 + 1).cast("int"))
    side = lambda x: F.when(x % 2 == 0, "L").otherwise("R")
    lfp = F.concat(F.lit("LFP"), side(s), F.lpad((s % 13).cast("string"), 2, "0"))
    src = lambda x: F.concat(F.lit("msrc"), side(x), F.lit("_9_"), (x % 59).cast("string"), F.lit("_c"), (x % 2).cast("string"))
    hjorth = F.element_at(F.array(F.lit("act"), F.lit("mob"), F.lit("compl")), (s % 3 + 1).cast("int"))
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("H_"), hjorth, F.lit("_"), F.when(s % 2 == 0, lfp).otherwise(src(k))))
        .when(k % 4 == 1, F.concat(F.lit("con_"), band(s), F.lit("_"), lfp, F.lit(","), src(k)))
        .when(k % 4 == 2, F.concat(F.lit("rbcorr_"), band(s), F.lit("_"), src(k), F.lit(","), band(s), F.lit("_"), src(s)))
        .otherwise(F.concat(F.lit("bpcorr_"), band(k), F.lit("_"), src(k), F.lit(","), band(s), F.lit("_"), lfp))
    )
    return table(spark, sf_dir, "part").select(name.alias("feat")).distinct()


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_grp, prefix, grouping, interval_set, bacc, oid: one row for each order."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return rows.select(
        F.col("c_mktsegment").alias("rec_grp"),
        F.col("o_orderpriority").alias("prefix"),
        F.col("o_orderstatus").alias("grouping"),
        F.year("o_orderdate").cast("long").alias("interval_set"),
        (F.col("o_totalprice") / 600000).alias("bacc"),
        F.col("o_orderkey").alias("oid"),
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, yhat: quality as truth, toxic as prediction."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.col("toxic").alias("yhat"))


#: The same views for DuckDB.
SQL = {
    "fx_samples": """b AS (SELECT l_suppkey rec, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS bin,
      l_quantity qty, l_extendedprice price, l_discount disc, l_tax tax FROM lineitem),
    fx_samples AS (SELECT rec, 'qty' ch, bin, qty v FROM b UNION ALL SELECT rec, 'price', bin, price FROM b
      UNION ALL SELECT rec, 'disc', bin, disc FROM b UNION ALL SELECT rec, 'tax', bin, tax FROM b)""",
    "fx_anns": """fx_anns AS (SELECT s_suppkey rec, ['trem','notrem','hold','move'][k % 4 + 1] AS label, (60*k + s_suppkey % 7)::BIGINT b0, (60*k + s_suppkey % 7 + 40)::BIGINT b1
      FROM supplier, range(0, 9) r(k))""",
    "fx_events": """fx_events AS (SELECT user_id rec, event_type ch, epoch_us(ts)/1e6 - min(epoch_us(ts)/1e6) OVER (PARTITION BY user_id) AS t,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bin, value v FROM events)""",
    "fx_ivals": """fx_ivals AS (SELECT rec, CASE ch WHEN 'purchase' THEN 'trem' WHEN 'view' THEN 'notrem' ELSE 'BAD_LFP' END AS label, t s,
      t + CASE ch WHEN 'error' THEN 21600 ELSE 86400 END e FROM fx_events WHERE ch IN ('purchase','view','error'))""",
    "fx_tfr": """fx_tfr AS (SELECT label::BIGINT rec, vec_id ch, f::INT freq, embedding[f]::DOUBLE re, embedding[f + 32]::DOUBLE im FROM embeddings, range(1, 33) r(f))""",
    "fx_names": """fx_names AS (SELECT DISTINCT CASE p_partkey % 4
      WHEN 0 THEN 'H_' || ['act','mob','compl'][p_size % 3 + 1] || '_' || CASE WHEN p_size % 2 = 0 THEN lfp ELSE srck END
      WHEN 1 THEN 'con_' || bs || '_' || lfp || ',' || srck
      WHEN 2 THEN 'rbcorr_' || bs || '_' || srck || ',' || bs || '_' || srcs
      ELSE 'bpcorr_' || bk || '_' || srck || ',' || bs || '_' || lfp END AS feat
      FROM (SELECT *, ['tremor','beta','gamma','HFO'][p_size % 4 + 1] bs, ['tremor','beta','gamma','HFO'][p_partkey % 4 + 1] bk,
        'LFP' || CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'R' END || lpad((p_size % 13)::VARCHAR, 2, '0') lfp,
        'msrc' || CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'R' END || '_9_' || p_partkey % 59 || '_c' || p_partkey % 2 srck,
        'msrc' || CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'R' END || '_9_' || p_size % 59 || '_c' || p_size % 2 srcs FROM part))""",
    "fx_results": """fx_results AS (SELECT c_mktsegment rec_grp, o_orderpriority prefix, o_orderstatus AS grouping, year(o_orderdate) interval_set, o_totalprice / 600000 AS bacc, o_orderkey oid
      FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "fx_pred": "fx_pred AS (SELECT doc_id id, quality y, toxic yhat FROM labels)",
}
_NEEDS = {"fx_ivals": ("fx_events",)}


def with_views(sql: str) -> str:
    """Put the views that a query names in front of it; the query may begin with further `WITH` parts."""
    used: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            need(other)
        if name not in used:
            used.append(name)

    for name in SQL:
        if name in sql:
            need(name)
    sql = sql.strip()
    word = "WITH RECURSIVE " if sql.upper().startswith("WITH RECURSIVE ") else "WITH "
    rest = f", {sql[len(word):].lstrip()}" if sql.upper().startswith(word) else f" {sql}"
    return f"{word}{', '.join(SQL[n] for n in used)}{rest}" if used else sql
