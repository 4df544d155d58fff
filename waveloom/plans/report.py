"""Queries over predictions and result cubes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import report as R
from ..sources import views as V
from .registry import query

R8 = lambda c: F.round(c, 8)
KEYS = ["rec_grp", "grouping", "interval_set"]


def cells(spark, sf_dir):
    """One result for each key and prefix: the mean over its runs."""
    return V.results(spark, sf_dir).groupBy(*KEYS, "prefix").agg(F.round(F.avg("bacc"), 8).alias("bacc"))


_CELLS = "cells AS (SELECT rec_grp, grouping, interval_set, prefix, round(avg(bacc), 8) bacc FROM fx_results GROUP BY ALL)"
_CONF = "conf AS (SELECT y, yhat, count(*) n FROM fx_pred GROUP BY ALL)"


@query(f"WITH {_CONF} SELECT y, yhat, n, round(n / sum(n) OVER (PARTITION BY y), 8) share FROM conf")
def a22_normalised_confusion(spark, sf_dir):
    return R.normalised(R.confusion(V.pred(spark, sf_dir))).withColumn("share", R8("share"))


@query("""WITH k AS (SELECT DISTINCT y FROM fx_pred), m AS (SELECT k.y, count(*) FILTER (p.y = k.y AND yhat = k.y) tp, count(*) FILTER (p.y = k.y AND yhat <> k.y) fn, count(*) FILTER (p.y <> k.y AND yhat = k.y) fp, count(*) FILTER (p.y <> k.y AND yhat <> k.y) tn FROM k, fx_pred p GROUP BY k.y)
  SELECT *, round(tp / nullif(tp + fn, 0), 8) sens, round(tn / nullif(tn + fp, 0), 8) spec, round(tp / nullif(tp + fp, 0), 8) prec, round(2 * tp / nullif(2 * tp + fp + fn, 0), 8) f1 FROM m""")
def a21_class_metrics(spark, sf_dir):
    m = R.per_class(R.confusion(V.pred(spark, sf_dir)))
    return m.select("y", "tp", "fn", "fp", "tn", *[R8(c).alias(c) for c in ("sens", "spec", "prec", "f1")])


@query("WITH r AS (SELECT id % 4 fold, y, avg((y = yhat)::INT) r FROM fx_pred GROUP BY ALL) SELECT fold, round(avg(r), 8) bacc, round((avg(r) - 1 / count(*)) / nullif(1 - 1 / count(*), 0), 8) adjusted FROM r GROUP BY fold")
def a23_balanced_accuracy(spark, sf_dir):
    conf = R.confusion(V.pred(spark, sf_dir).withColumn("fold", F.col("id") % 4), ["fold"])
    adjusted = R.balanced_accuracy(conf, ["fold"], True).withColumnRenamed("bacc", "adjusted")
    return R.balanced_accuracy(conf, ["fold"]).join(adjusted, "fold").select("fold", R8("bacc").alias("bacc"), R8("adjusted").alias("adjusted"))


@query("WITH r AS (SELECT id % 4 fold, y, avg((y = yhat)::INT) r FROM fx_pred GROUP BY ALL), b AS (SELECT fold, avg(r) bacc, count(*) k FROM r GROUP BY fold) SELECT round(avg(bacc) FILTER (k = 2), 8) bacc, count(*) FILTER (k = 2) valid_folds FROM b")
def a25_average_folds(spark, sf_dir):
    """Folds without one of the classes count neither above nor below the line."""
    conf = R.confusion(V.pred(spark, sf_dir).withColumn("fold", F.col("id") % 4), ["fold"])
    whole = conf.groupBy("fold").agg((F.countDistinct("y") == 2).alias("whole"))
    valid = R.balanced_accuracy(conf, ["fold"]).join(whole, "fold").filter("whole")
    return valid.agg(R8(F.avg("bacc")).alias("bacc"), F.count("*").alias("valid_folds"))


@query(f"WITH {_CONF}, s AS (SELECT y, sum(n) / (SELECT sum(n) FROM conf) p FROM conf GROUP BY y), h AS (SELECT yhat, sum(n) / (SELECT sum(n) FROM conf) p FROM conf GROUP BY yhat) SELECT y, yhat, round(s.p * h.p, 8) expected FROM s, h")
def a24_chance_confusion(spark, sf_dir):
    """Expected shares if truth and prediction were independent; both sides have a row for each class."""
    conf = R.confusion(V.pred(spark, sf_dir))
    share = lambda c, p: conf.groupBy(c).agg(F.sum("n").alias("n")).select(F.lit(1).alias("one"), c, (F.col("n") / F.sum("n").over(W.partitionBy())).alias(p))
    return share("y", "p").join(share("yhat", "q"), "one").select("y", "yhat", R8(F.col("p") * F.col("q")).alias("expected"))


@query("WITH c AS (SELECT id % 5 rec, y, yhat, count(*) n FROM fx_pred GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY rec, y) p FROM c) SELECT y, yhat, round(avg(p), 8) mean, round(coalesce(stddev_samp(p), 0), 8) std FROM s GROUP BY ALL")
def a41_confusion_over_recordings(spark, sf_dir):
    conf = R.normalised(R.confusion(V.pred(spark, sf_dir).withColumn("rec", F.col("id") % 5), ["rec"]), "row", ["rec"])
    return conf.groupBy("y", "yhat").agg(R8(F.avg("share")).alias("mean"), R8(F.coalesce(F.stddev_samp("share"), F.lit(0.0))).alias("std"))


@query(f"WITH {_CELLS} SELECT rec_grp, grouping, interval_set, max(bacc) best, arg_max(prefix, (bacc, prefix)) best_prefix, min(bacc) worst, arg_min(prefix, (bacc, prefix)) worst_prefix, count(*) n FROM cells GROUP BY ALL")
def a31_best_groups(spark, sf_dir):
    order = F.struct("bacc", "prefix")
    return cells(spark, sf_dir).groupBy(KEYS).agg(F.max("bacc").alias("best"), F.max_by("prefix", order).alias("best_prefix"), F.min("bacc").alias("worst"), F.min_by("prefix", order).alias("worst_prefix"), F.count("*").alias("n"))


@query(f"WITH {_CELLS} SELECT a.*, b.bacc base, round(100 * (a.bacc - b.bacc) / b.bacc, 5) gain FROM cells a JOIN cells b USING (rec_grp, grouping, interval_set) WHERE b.prefix = '1-URGENT'")
def j11_gain_over_reference(spark, sf_dir):
    return R.gains(cells(spark, sf_dir), KEYS, "prefix", "1-URGENT", "bacc").withColumn("gain", F.round("gain", 5))


@query(f"WITH {_CELLS} SELECT *, round(100 * (bacc - avg(bacc) OVER w) / avg(bacc) OVER w, 5) improvement FROM cells WINDOW w AS (PARTITION BY rec_grp, grouping, interval_set)")
def a32_improvement_over_mean(spark, sf_dir):
    mean = F.avg("bacc").over(W.partitionBy(*KEYS))
    return cells(spark, sf_dir).withColumn("improvement", F.round(100 * (F.col("bacc") - mean) / mean, 5))


@query(f"WITH {_CELLS} PIVOT (SELECT rec_grp, interval_set, grouping, prefix, bacc FROM cells) ON grouping IN ('F', 'O', 'P') USING first(bacc) GROUP BY rec_grp, interval_set, prefix")
def a30_flatten_results(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("rec_grp", "interval_set", "prefix").pivot("grouping", ["F", "O", "P"]).agg(F.first("bacc"))


@query("SELECT prefix, grouping, round(avg(bacc), 6) mean, round(stddev_samp(bacc), 6) std, printf('%.1f%%', 100 * round(avg(bacc), 6)) pct FROM fx_results GROUP BY ALL")
def a33_mean_std_table(spark, sf_dir):
    m = F.round(F.avg("bacc"), 6)
    return V.results(spark, sf_dir).groupBy("prefix", "grouping").agg(m.alias("mean"), F.round(F.stddev_samp("bacc"), 6).alias("std"), F.format_string("%.1f%%", 100 * m).alias("pct"))


@query("""WITH r AS (SELECT DISTINCT c_nationkey nation, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority prefix FROM orders JOIN customer ON o_custkey = c_custkey),
  k AS (SELECT DISTINCT nation, month FROM r), p AS (SELECT DISTINCT prefix FROM r) SELECT * FROM k, p EXCEPT SELECT * FROM r""")
def a34_missing_results(spark, sf_dir):
    rows = V.table(spark, sf_dir, "orders").join(V.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").alias("nation"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("prefix"))
    return R.missing(rows, ["nation", "month"], "prefix")


@query("SELECT rec_grp, interval_set, min(CASE WHEN least(bacc, 1 - bacc) > 0.3 THEN oid END) first_balanced, count(*) n FROM fx_results GROUP BY ALL")
def a36_first_balanced(spark, sf_dir):
    level = F.when(F.least(F.col("bacc"), 1 - F.col("bacc")) > 0.3, F.col("oid"))
    return V.results(spark, sf_dir).groupBy("rec_grp", "interval_set").agg(F.min(level).alias("first_balanced"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def t4_newest_result(spark, sf_dir):
    rows = V.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return R.newest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT prefix, count(*) n, coalesce(list_position(['3-MEDIUM', '1-URGENT'], prefix), 99)::BIGINT AS rank FROM fx_results GROUP BY ALL")
def t5_user_order(spark, sf_dir):
    place = F.array_position(F.array(F.lit("3-MEDIUM"), F.lit("1-URGENT")), F.col("prefix"))
    return V.results(spark, sf_dir).groupBy("prefix").agg(F.count("*").alias("n")).withColumn("rank", F.when(place > 0, place).otherwise(F.lit(99)).cast("long"))


@query(f"WITH {_CELLS}, m AS (SELECT rec_grp, interval_set, prefix, max(bacc) - avg(bacc) up, min(bacc) - avg(bacc) down FROM cells GROUP BY ALL) SELECT rec_grp, interval_set, arg_max(prefix, (round(greatest(up, 0) + least(down, 0), 8), prefix)) best FROM m GROUP BY ALL")
def t3_best_channel(spark, sf_dir):
    m = cells(spark, sf_dir).groupBy("rec_grp", "interval_set", "prefix").agg((F.max("bacc") - F.avg("bacc")).alias("up"), (F.min("bacc") - F.avg("bacc")).alias("down"))
    gain = R8(F.greatest("up", F.lit(0.0)) + F.least("down", F.lit(0.0)))
    return m.groupBy("rec_grp", "interval_set").agg(F.max_by("prefix", F.struct(gain, "prefix")).alias("best"))


@query(f"WITH {_CELLS} SELECT * FROM cells WHERE rec_grp IN ('BUILDING', 'MACHINERY') AND grouping = 'O' AND prefix LIKE '%-%' AND interval_set BETWEEN 1996 AND 1999")
def p22_filter_cube(spark, sf_dir):
    return cells(spark, sf_dir).filter(F.col("rec_grp").isin("BUILDING", "MACHINERY") & (F.col("grouping") == "O") & F.col("prefix").contains("-") & F.col("interval_set").between(1996, 1999))


@query(f"WITH {_CELLS}, best AS (SELECT rec_grp, grouping, arg_max(prefix, (bacc, prefix)) main FROM cells GROUP BY ALL) SELECT c.rec_grp, c.grouping, c.interval_set, main, bacc FROM cells c JOIN best b ON c.rec_grp = b.rec_grp AND c.grouping = b.grouping AND c.prefix = b.main")
def j12_best_lookup(spark, sf_dir):
    rows = cells(spark, sf_dir)
    best = rows.groupBy("rec_grp", "grouping").agg(F.max_by("prefix", F.struct("bacc", "prefix")).alias("main"))
    return rows.withColumnRenamed("prefix", "main").join(best, ["rec_grp", "grouping", "main"]).select("rec_grp", "grouping", "interval_set", "main", "bacc")


@query("SELECT o_orderkey, n_name, r_name, coalesce(c_mktsegment, 'none') || '/' || o_orderpriority pars FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j15_enrich(spark, sf_dir):
    t = lambda n: V.table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("o_orderkey", "n_name", "r_name", F.concat_ws("/", F.coalesce("c_mktsegment", F.lit("none")), "o_orderpriority").alias("pars"))


@query(f"WITH {_CELLS} SELECT rec_grp, prefix, interval_set, count(*) n, round(sum(bacc), 6) total FROM cells GROUP BY ALL")
def x9_nested_results(spark, sf_dir):
    """Rows to nested maps and back: what comes out is what went in."""
    rows = cells(spark, sf_dir)
    inner = rows.groupBy("rec_grp", "prefix", "interval_set").agg(F.map_from_entries(F.collect_list(F.struct("grouping", "bacc"))).alias("m"))
    outer = inner.groupBy("rec_grp", "prefix").agg(F.map_from_entries(F.collect_list(F.struct("interval_set", "m"))).alias("m"))
    flat = outer.select("rec_grp", "prefix", F.explode("m").alias("interval_set", "m")).select("rec_grp", "prefix", "interval_set", F.explode("m").alias("grouping", "bacc"))
    return flat.groupBy("rec_grp", "prefix", "interval_set").agg(F.count("*").alias("n"), F.round(F.sum("bacc"), 6).alias("total"))


@query("SELECT interval_set, list_aggregate(list_sort(list(DISTINCT rec_grp)), 'string_agg', ',') recs, count(DISTINCT rec_grp) n FROM fx_results GROUP BY interval_set")
def x8_combined_names(spark, sf_dir):
    names = F.array_sort(F.collect_set("rec_grp"))
    return V.results(spark, sf_dir).groupBy("interval_set").agg(F.array_join(names, ",").alias("recs"), F.countDistinct("rec_grp").alias("n"))


@query("SELECT DISTINCT prefix, replace(replace(prefix, '-', '^'), 'U', '%') template, CASE WHEN prefix LIKE '%U%' THEN 'opposite' ELSE 'same' END kind FROM fx_results")
def x7_prefix_templates(spark, sf_dir):
    p = F.col("prefix")
    rows = V.results(spark, sf_dir).select("prefix").distinct()
    return rows.select("prefix", F.translate(p, "-U", "^%").alias("template"), F.when(p.contains("U"), "opposite").otherwise("same").alias("kind"))


@query("SELECT oid, round(least(bacc, 1 - bacc), 8) special, round(ln(greatest(bacc, 1e-12)), 6) log_bacc, round(ln(greatest(bacc, 1e-6) / greatest(1 - bacc, 1e-6)), 6) logit FROM fx_results")
def x11_single_scores(spark, sf_dir):
    b = F.col("bacc")
    floor = lambda x: F.greatest(x, F.lit(1e-6))
    return V.results(spark, sf_dir).select("oid", R8(F.least(b, 1 - b)).alias("special"), F.round(F.log(F.greatest(b, F.lit(1e-12))), 6).alias("log_bacc"), F.round(F.log(floor(b) / floor(1 - b)), 6).alias("logit"))


@query("SELECT y, yhat, count(*) n, round(avg((y = yhat)::INT), 8) acc FROM fx_pred WHERE y IN (0, 1) AND yhat IN (0, 1) GROUP BY ALL")
def m20_pair_performance(spark, sf_dir):
    some = V.pred(spark, sf_dir).filter(F.col("y").isin(0, 1) & F.col("yhat").isin(0, 1))
    return some.groupBy("y", "yhat").agg(F.count("*").alias("n"), R8(F.avg((F.col("y") == F.col("yhat")).cast("int"))).alias("acc"))


@query("SELECT rec_grp, prefix, 'a' AS part, oid FROM fx_results WHERE grouping = 'O' UNION ALL SELECT rec_grp, prefix, 'b', oid FROM fx_results WHERE grouping = 'F'")
def u1_union_with_provenance(spark, sf_dir):
    rows = V.results(spark, sf_dir)
    part = lambda g, name: rows.filter(F.col("grouping") == g).select("rec_grp", "prefix", F.lit(name).alias("part"), "oid")
    return part("O", "a").unionByName(part("F", "b"))


@query("SELECT rec_grp, avg(bacc) FILTER (grouping = 'O') IS NOT NULL ok, round((avg(bacc) FILTER (grouping = 'O') - avg(bacc) FILTER (grouping = 'F')) / sqrt(((count(*) FILTER (grouping = 'O') - 1) * var_samp(bacc) FILTER (grouping = 'O') + (count(*) FILTER (grouping = 'F') - 1) * var_samp(bacc) FILTER (grouping = 'F')) / (count(*) FILTER (grouping = 'O') + count(*) FILTER (grouping = 'F') - 2) * (1 / count(*) FILTER (grouping = 'O') + 1 / count(*) FILTER (grouping = 'F'))), 6) t FROM fx_results GROUP BY rec_grp")
def a39_compare_conditions(spark, sf_dir):
    from ..operators.stats import t_test

    return t_test(V.results(spark, sf_dir), F.col("grouping"), "O", "F", "bacc", ["rec_grp"]).select("rec_grp", F.lit(True).alias("ok"), F.round("t", 6).alias("t"))


@query(f"""WITH c AS (SELECT id % 4 f, CASE WHEN y = 1 THEN 'good' ELSE 'bad' END y, CASE WHEN yhat = 1 THEN 'good' ELSE 'bad' END yhat, count(*) n FROM fx_pred GROUP BY ALL), t AS (SELECT f, y, sum(n) t FROM c GROUP BY ALL),
  p AS (SELECT t.f, t.y, o.yhat, coalesce(n, 0) / t p FROM t CROSS JOIN (VALUES ('good'), ('bad')) o(yhat) LEFT JOIN c ON c.f = t.f AND c.y = t.y AND c.yhat = o.yhat)
  SELECT CASE y WHEN 'good' THEN 1 ELSE 2 END AS row, CASE yhat WHEN 'good' THEN 1 ELSE 2 END AS col, y, yhat, round(100 * avg(p), 6) pct FROM p GROUP BY ALL""")
def a24_confusion_report(spark, sf_dir):
    """Confusion in per cent, classes named and in order, averaged over folds."""
    names = lambda c: F.when(F.col(c) == 1, "one").otherwise("zero")
    pred = V.pred(spark, sf_dir).select((F.col("id") % 4).alias("f"), names("y").alias("y"), names("yhat").alias("yhat"))
    report = R.confusion_report(R.confusion(pred, ["f"]), ["good", "bad"], {"one": "good", "zero": "bad"}, "f")
    return report.withColumn("pct", F.round("pct", 6))


@query("WITH n AS (SELECT y, count(*) n FROM fx_pred GROUP BY y) SELECT a.y, b.y yhat, round(b.n / (SELECT sum(n) FROM n), 8) AS share FROM n a, n b")
def a24_chance_level(spark, sf_dir):
    return R.chance_level(R.confusion(V.pred(spark, sf_dir))).withColumn("share", R8("share"))


@query("""WITH c AS (SELECT rec_grp, interval_set n, avg(bacc) sens, 1 - avg(bacc * bacc) spec FROM fx_results GROUP BY ALL) SELECT rec_grp, n, round(sens, 8) sens, round(spec, 8) spec,
  coalesce(n = min(CASE WHEN least(sens, spec) > 0.3 THEN n END) OVER (PARTITION BY rec_grp), false) AS first FROM c""")
def a36_balanced_curve(spark, sf_dir):
    """Performance by size of the feature set (here years), and the first point at which both rates exceed a level."""
    curve = V.results(spark, sf_dir).groupBy("rec_grp", F.col("interval_set").alias("n")).agg(F.avg("bacc").alias("sens"), (1 - F.avg(F.col("bacc") * F.col("bacc"))).alias("spec"))
    return R.balanced_curve(curve, ["rec_grp"], "n", 0.3).select("rec_grp", "n", R8("sens").alias("sens"), R8("spec").alias("spec"), "first")
