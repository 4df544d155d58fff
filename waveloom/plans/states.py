"""Queries over labelled intervals in seconds: the interval algebra."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..sources import views as V
from .registry import query

BUCKET = 43_200.0
R3 = lambda c: F.round(c, 3)

_UNION = """u0 AS (SELECT *, max(e) OVER (PARTITION BY rec, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) p FROM fx_ivals),
  u1 AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY rec, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) i FROM u0),
  u AS (SELECT rec, label, min(s) s, max(e) e FROM u1 GROUP BY rec, label, i)"""


def _label(spark, sf_dir, label):
    return V.ivals(spark, sf_dir).filter(F.col("label") == label).drop("label")


@query("SELECT a.rec, round(a.s, 3) s1, round(b.s, 3) s2, round(greatest(a.s, b.s), 3) s, round(least(a.e, b.e), 3) e FROM fx_ivals a JOIN fx_ivals b ON a.rec = b.rec WHERE a.label = 'trem' AND b.label = 'BAD_LFP' AND least(a.e, b.e) - greatest(a.s, b.s) > 0.01")
def j1_interval_overlap(spark, sf_dir):
    both = I.overlaps(_label(spark, sf_dir, "trem"), _label(spark, sf_dir, "BAD_LFP"), BUCKET)
    return both.select("rec", R3("s").alias("s1"), R3("s_2").alias("s2"), R3(F.greatest("s", "s_2")).alias("s"), R3(F.least("e", "e_2")).alias("e"))


@query(f"WITH {_UNION} SELECT rec, label, round(s, 3) s, round(e, 3) e FROM u")
def w8_union_of_intervals(spark, sf_dir):
    return I.union(V.ivals(spark, sf_dir), ["rec", "label"]).select("rec", "label", R3("s").alias("s"), R3("e").alias("e"))


@query("""WITH f AS (SELECT *, max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) p FROM fx_ivals WHERE label <> 'notrem'),
  g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) i FROM f) SELECT rec, 'any' AS label, round(min(s), 3) s, round(max(e), 3) e FROM g GROUP BY rec, i""")
def w8_merge_skipping_labels(spark, sf_dir):
    some = V.ivals(spark, sf_dir).filter("label <> 'notrem'")
    return I.union(some, ["rec"]).select("rec", F.lit("any").alias("label"), R3("s").alias("s"), R3("e").alias("e"))


@query(f"WITH {_UNION} SELECT DISTINCT a.rec, round(greatest(a.s, b.s), 3) s, round(least(a.e, b.e), 3) e FROM u a JOIN u b ON a.rec = b.rec AND a.label = 'trem' AND b.label = 'notrem' WHERE least(a.e, b.e) - greatest(a.s, b.s) > 0.01")
def j7_interval_intersection(spark, sf_dir):
    u = I.union(V.ivals(spark, sf_dir), ["rec", "label"])
    side = lambda x: u.filter(F.col("label") == x).drop("label")
    return I.intersection(side("trem"), side("notrem"), BUCKET).select("rec", R3("s").alias("s"), R3("e").alias("e"))


@query("""SELECT a.rec, CASE WHEN EXISTS (SELECT 1 FROM fx_ivals b WHERE b.rec = a.rec AND b.label = 'trem' AND least(a.e, b.e) - greatest(a.s, b.s) > -1e-9) THEN label || '_isecTrem' ELSE label END AS label, count(*) n, round(sum(e - s), 3) total
  FROM fx_ivals a WHERE label <> 'trem' GROUP BY ALL""")
def j8_flag_touching(spark, sf_dir):
    rows = I.touching(V.ivals(spark, sf_dir), "trem", "_isecTrem", BUCKET)
    return rows.groupBy("rec", "label").agg(F.count("*").alias("n"), R3(F.sum(F.col("e") - F.col("s"))).alias("total"))


@query("SELECT rec, label, round(sum(greatest(least(e, 864000.0) - greatest(s, 86400.0), 0)), 3) total FROM fx_ivals GROUP BY ALL")
def a6_total_lengths(spark, sf_dir):
    return I.total_lengths(V.ivals(spark, sf_dir), 86_400.0, 864_000.0).withColumn("total", R3("total"))


@query(f"WITH {_UNION} SELECT rec, label, round(sum(e - s), 3) covered FROM u GROUP BY ALL")
def a7_coverage(spark, sf_dir):
    return I.covered(V.ivals(spark, sf_dir), ["rec", "label"]).withColumn("covered", R3("covered"))


@query(f"WITH {_UNION}, d AS (SELECT rec, max(e) t FROM fx_ivals GROUP BY rec) SELECT rec, label, round(sum(e - s), 3) AS seconds, round(100 * sum(e - s) / any_value(t), 4) pct FROM u JOIN d USING (rec) GROUP BY ALL")
def a8_interval_report(spark, sf_dir):
    ivals = V.ivals(spark, sf_dir)
    d = ivals.groupBy("rec").agg(F.max("e").alias("t"))
    return I.covered(ivals, ["rec", "label"]).join(d, "rec").select("rec", "label", R3("covered").alias("seconds"), F.round(100 * F.col("covered") / F.col("t"), 4).alias("pct"))


@query("""SELECT rec, label, p.phase phase, round(p.ps, 3) ps, round(p.pe, 3) pe FROM (SELECT rec, label, s, e, least(7200.0, (e - s) / 2) i, unnest([{'phase': 'prestart', 'ps': greatest(0, s - 3600), 'pe': s}, {'phase': 'poststart', 'ps': s, 'pe': s + i},
  {'phase': 'main', 'ps': s + i, 'pe': e - i}, {'phase': 'preend', 'ps': e - i, 'pe': e}, {'phase': 'postend', 'ps': e, 'pe': e + 3600}]) p FROM fx_ivals WHERE label = 'trem')""")
def w10_phases(spark, sf_dir):
    rows = I.phases(V.ivals(spark, sf_dir).filter("label = 'trem'"), 3600.0, 7200.0, 3600.0)
    return rows.select("rec", "label", "phase", R3("ps").alias("ps"), R3("pe").alias("pe"))


@query("""SELECT rec, kind, round(a, 3) a, round(b, 3) b FROM (SELECT rec, x.k AS kind, x.a AS a, x.b AS b FROM (SELECT rec, unnest([{'k': 'incPre', 'a': greatest(0, s - 1800), 'b': s}, {'k': 'middle', 'a': s + 1800, 'b': e - 1800}, {'k': 'middle_full', 'a': s, 'b': e}, {'k': 'incPost', 'a': e, 'b': e + 1800},
  {'k': 'initseg', 'a': s, 'b': s + 1800}, {'k': 'endseg', 'a': e - 1800, 'b': e}]) x FROM fx_ivals WHERE label = 'trem')) WHERE b - a >= 1""")
def w11_derived_intervals(spark, sf_dir):
    s, e = F.col("s"), F.col("e")
    part = lambda k, a, b: F.struct(F.lit(k).alias("kind"), a.alias("a"), b.alias("b"))
    parts = F.array(part("incPre", F.greatest(F.lit(0.0), s - 1800), s), part("middle", s + 1800, e - 1800), part("middle_full", s, e), part("incPost", e, e + 1800), part("initseg", s, s + 1800), part("endseg", e - 1800, e))
    rows = V.ivals(spark, sf_dir).filter("label = 'trem'").select("rec", F.inline(parts)).filter("b - a >= 1")
    return rows.select("rec", "kind", R3("a").alias("a"), R3("b").alias("b"))


@query("""WITH d AS (SELECT rec, max(t) AS length FROM fx_events GROUP BY rec), o AS (SELECT rec, length, coalesce(sum(length) OVER (ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) off FROM d)
  SELECT rec, label, round(greatest(s, 0) + off, 2) s, round(least(e, length) + off, 2) e FROM fx_ivals JOIN o USING (rec) WHERE least(e, length) > s""")
def w12_one_timeline(spark, sf_dir):
    lengths = V.events(spark, sf_dir).groupBy("rec").agg(F.max("t").alias("length"))
    return I.timeline(lengths, V.ivals(spark, sf_dir)).select("rec", "label", F.round("s", 2).alias("s"), F.round("e", 2).alias("e"))


@query("SELECT rec, min(s) FILTER (label IN ('trem', 'notrem')) IS NOT NULL found, round(min(s) FILTER (label IN ('trem', 'notrem')), 3) onset, min_by(label, s) AS first_label FROM fx_ivals GROUP BY rec")
def w16_first_onset(spark, sf_dir):
    task = F.when(F.col("label").isin("trem", "notrem"), F.col("s"))
    return V.ivals(spark, sf_dir).groupBy("rec").agg(F.min(task).isNotNull().alias("found"), R3(F.min(task)).alias("onset"), F.min_by("label", "s").alias("first_label"))


@query("SELECT rec, label, round(greatest(s - 60, 0), 3) s, round(e + 120, 3) e FROM fx_ivals")
def w17_extend(spark, sf_dir):
    return I.extended(V.ivals(spark, sf_dir), 60.0, 120.0).select("rec", "label", R3("s").alias("s"), R3("e").alias("e"))


@query("SELECT rec, ch, count(*) n, round(sum(v), 4) AS sum_v FROM fx_events WHERE t BETWEEN 86400 AND 864000 AND v BETWEEN 1 AND 20 GROUP BY ALL")
def p9_subspectrum(spark, sf_dir):
    rows = V.events(spark, sf_dir).filter("t BETWEEN 86400 AND 864000 AND v BETWEEN 1 AND 20")
    return rows.groupBy("rec", "ch").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("sum_v"))


@query("SELECT rec, bin, t BETWEEN 100000 AND 500000 AS inside FROM fx_events")
def p10_bins_inside(spark, sf_dir):
    return V.events(spark, sf_dir).select("rec", "bin", F.col("t").between(100_000, 500_000).alias("inside"))


@query("SELECT rec, bin, ch FROM fx_events x WHERE ch IN ('click', 'view') AND NOT EXISTS (SELECT 1 FROM fx_ivals b WHERE b.rec = x.rec AND b.label = 'BAD_LFP' AND x.t BETWEEN b.s AND b.e)")
def p11_drop_artifact_bins(spark, sf_dir):
    points = V.events(spark, sf_dir).filter(F.col("ch").isin("click", "view")).select("rec", "bin", "ch", F.col("t").alias("s"), F.col("t").alias("e"))
    bad = I.union(_label(spark, sf_dir, "BAD_LFP"), ["rec"])
    hit = I.overlaps(points, bad, BUCKET, -1e-9).select("rec", "bin")
    return points.join(hit, ["rec", "bin"], "left_anti").select("rec", "bin", "ch")


@query("SELECT rec, label, count(*) n FROM fx_ivals WHERE NOT contains(label, 'BAD') AND label NOT LIKE '%trem' OR label = 'trem' GROUP BY ALL")
def p12_filter_descriptions(spark, sf_dir):
    keep = ~F.col("label").contains("BAD") & ~F.col("label").endswith("trem") | (F.col("label") == "trem")
    return V.ivals(spark, sf_dir).filter(keep).groupBy("rec", "label").agg(F.count("*").alias("n"))


@query("SELECT rec, CASE label WHEN 'trem' THEN 'tremor' WHEN 'notrem' THEN 'quiet' ELSE label END AS label, count(*) n FROM fx_ivals GROUP BY ALL")
def p14_rename_labels(spark, sf_dir):
    new = F.create_map(F.lit("trem"), F.lit("tremor"), F.lit("notrem"), F.lit("quiet"))
    return V.ivals(spark, sf_dir).withColumn("label", F.coalesce(new[F.col("label")], F.col("label"))).groupBy("rec", "label").agg(F.count("*").alias("n"))


_SIDED = "sided AS (SELECT rec, s, CASE WHEN label = 'BAD_LFP' THEN 'BAD_LFP' || CASE WHEN rec % 2 = 0 THEN 'L01' ELSE 'R01' END ELSE label || CASE WHEN rec % 2 = 0 THEN '_L' ELSE '_R' END END AS label FROM fx_ivals)"


def _sided(spark, sf_dir):
    side = F.when(F.col("rec") % 2 == 0, "L").otherwise("R")
    named = F.when(F.col("label") == "BAD_LFP", F.concat(F.lit("BAD_LFP"), side, F.lit("01"))).otherwise(F.concat("label", F.lit("_"), side))
    return V.ivals(spark, sf_dir).select("rec", "s", named.alias("label"))


@query(f"WITH {_SIDED} SELECT rec, regexp_replace(CASE WHEN label LIKE 'BAD%' THEN regexp_replace(label, '^(BAD_[A-Z]+)([LR])', '\\1' || CASE WHEN label LIKE '%L01' THEN 'R' ELSE 'L' END) ELSE left(label, length(label) - 1) || CASE WHEN label LIKE '%L' THEN 'R' ELSE 'L' END END, 'LFLP', 'LFP') AS label, count(*) n FROM sided GROUP BY ALL")
def p15_mirror_sides(spark, sf_dir):
    label = F.col("label")
    at = F.when(label.startswith("BAD_"), F.regexp_extract(label, "^BAD_(?:LFP|MEG)([LR])", 1)).otherwise(F.substring(label, -1, 1))
    other = F.translate(at, "LR", "RL")
    mirrored = F.when(label.startswith("BAD_"), F.concat(F.regexp_extract(label, "^(BAD_(?:LFP|MEG))", 1), other, F.regexp_extract(label, "^BAD_(?:LFP|MEG)[LR](.*)$", 1))).otherwise(F.concat(F.expr("left(label, length(label) - 1)"), other))
    known = F.when(at.isin("L", "R"), mirrored).otherwise(F.raise_error(F.concat(F.lit("no side in "), label)).cast("string"))
    return _sided(spark, sf_dir).select("rec", known.alias("label")).groupBy("rec", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {_SIDED} SELECT DISTINCT label, CASE WHEN label LIKE 'BAD%' THEN 'artif' ELSE 'beh_state' END kind, CASE WHEN label LIKE 'BAD%' THEN 'LFP' END modality, CASE WHEN label LIKE 'BAD%' THEN substr(label, 8, 1) ELSE right(label, 1) END side,
  CASE WHEN label LIKE 'BAD%' THEN substr(label, 5) END chname FROM sided""")
def x4_parse_labels(spark, sf_dir):
    parts = lambda i: F.nullif(F.regexp_extract("label", "^BAD_(LFP|MEG)(.?)(.*)", i), F.lit(""))
    bad = parts(1).isNotNull()
    rows = _sided(spark, sf_dir).select("label").distinct()
    return rows.select("label", F.when(bad, "artif").otherwise("beh_state").alias("kind"), parts(1).alias("modality"), F.coalesce(parts(2), F.substring("label", -1, 1)).alias("side"), F.when(bad & parts(3).isNotNull(), F.concat(parts(1), parts(2), parts(3))).alias("chname"))


@query("SELECT a.rec, a.bin, count(b.s) n_open FROM fx_events a LEFT JOIN fx_ivals b ON a.rec = b.rec AND a.t BETWEEN b.s AND b.e WHERE a.ch = 'error' GROUP BY ALL")
def j3_open_intervals(spark, sf_dir):
    points = V.events(spark, sf_dir).filter("ch = 'error'").select("rec", "bin", F.col("t").alias("s"), F.col("t").alias("e"))
    hit = I.overlaps(points, V.ivals(spark, sf_dir), BUCKET, -1e-9).groupBy("rec", "bin").agg(F.count("*").alias("n"))
    return points.join(hit, ["rec", "bin"], "left").select("rec", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n_open"))


@query("""SELECT a.rec, round(a.s, 3) s, b.day FROM fx_ivals a JOIN (SELECT DISTINCT rec, floor(t / 604800)::BIGINT AS day FROM fx_events) b ON a.rec = b.rec AND a.s >= b.day * 604800 AND a.e < (b.day + 1) * 604800 WHERE label = 'BAD_LFP'""")
def j16_containing_dataset(spark, sf_dir):
    sets = V.events(spark, sf_dir).select("rec", F.floor(F.col("t") / 604_800).alias("day")).distinct()
    sets = sets.select("rec", "day", (F.col("day") * 604_800.0).alias("s"), ((F.col("day") + 1) * 604_800.0).alias("e"))
    both = I.overlaps(_label(spark, sf_dir, "BAD_LFP"), sets, 604_800.0).filter("s >= s_2 AND e < e_2")
    return both.select("rec", R3("s").alias("s"), F.col("day_2").alias("day"))


@query("SELECT rec, label, list(DISTINCT round(s / 3600)::BIGINT ORDER BY round(s / 3600)::BIGINT)::VARCHAR AS hours FROM fx_ivals GROUP BY ALL")
def x15_intervals_by_label(spark, sf_dir):
    hours = F.array_sort(F.collect_set(F.round(F.col("s") / 3600).cast("long")))
    return V.ivals(spark, sf_dir).groupBy("rec", "label").agg(F.concat(F.lit("["), F.array_join(hours, ", "), F.lit("]")).alias("hours"))


@query("SELECT user_id rec, (props->>'$.k')::BIGINT k, count(*) n FROM events GROUP BY ALL")
def s4_flatten_json(spark, sf_dir):
    k = F.from_json("props", "map<string,bigint>")["k"]
    return V.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("rec"), k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def s11_newest_per_key(spark, sf_dir):
    """max_by aggregates before the shuffle; a window would sort every row."""
    rows = V.table(spark, sf_dir, "events")
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return rows.groupBy("user_id", "event_type").agg(last.alias("x")).select("user_id", "event_type", "x.event_id", "x.value")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def s13_recent(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events")
    last = rows.agg(F.max("ts").alias("last"))
    return rows.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 6 HOURS")).select("event_id", "user_id")


@query("SELECT s.s_suppkey rec, c.category, count(l.l_orderkey) n, count(l.l_orderkey) = 0 missing FROM supplier s CROSS JOIN (VALUES ('A'), ('N'), ('X')) c(category) LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey AND l.l_returnflag = c.category GROUP BY ALL")
def s3_missing_annotations(spark, sf_dir):
    wanted = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rec"), F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("X"))).alias("category"))
    n = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rec"), F.col("l_returnflag").alias("category")).agg(F.count("*").alias("n"))
    return wanted.join(n, ["rec", "category"], "left").select("rec", "category", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query("WITH f AS (SELECT *, coalesce(s - max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) gap FROM fx_ivals WHERE label = 'trem') SELECT rec, round(max(gap), 3) longest_gap, count(*) FILTER (gap > 0) n_gaps FROM f GROUP BY rec")
def w9_gaps(spark, sf_dir):
    order = W.partitionBy("rec").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    gap = F.coalesce(F.col("s") - F.max("e").over(order), F.lit(0.0))
    rows = _label(spark, sf_dir, "trem").withColumn("gap", gap)
    return rows.groupBy("rec").agg(R3(F.max("gap")).alias("longest_gap"), F.count_if(F.col("gap") > 0).alias("n_gaps"))


@query("SELECT a.user_id a_rec, b.user_id b_rec FROM (SELECT user_id, count(*) n, min(event_type) k FROM events GROUP BY user_id) a JOIN (SELECT user_id, count(*) n, min(event_type) k FROM events GROUP BY user_id) b ON a.k = b.k AND abs(a.n - b.n) <= 1e-9 AND a.user_id < b.user_id")
def j18_match_recordings(spark, sf_dir):
    n = V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_type").alias("k"))
    a, b = n.withColumnRenamed("user_id", "a_rec"), n.select(F.col("user_id").alias("b_rec"), F.col("n").alias("m"), "k")
    # the tolerance is far below the grid of durations: equal cells and their neighbours make it an equi-join
    a = a.withColumn("cell", F.explode(F.sequence(F.col("n") - 1, F.col("n") + 1)))
    return a.join(b, (a["k"] == b["k"]) & (F.col("cell") == F.col("m"))).filter("abs(n - m) <= 1e-9 AND a_rec < b_rec").select("a_rec", "b_rec")


@query("SELECT rec, 'bins' AS source, label, b0::DOUBLE s, b1::DOUBLE e FROM fx_anns UNION ALL SELECT rec, 'seconds', label, round(s, 3), round(e, 3) FROM fx_ivals")
def u2_union_of_sources(spark, sf_dir):
    bins = V.anns(spark, sf_dir).select("rec", F.lit("bins").alias("source"), "label", F.col("b0").cast("double").alias("s"), F.col("b1").cast("double").alias("e"))
    return bins.unionByName(V.ivals(spark, sf_dir).select("rec", F.lit("seconds").alias("source"), "label", R3("s").alias("s"), R3("e").alias("e")))


@query("SELECT rec, ch, round(t - 86400, 3) t, v FROM fx_events WHERE t BETWEEN 86400 AND 1296000")
def p20_crop(spark, sf_dir):
    return V.events(spark, sf_dir).filter("t BETWEEN 86400 AND 1296000").select("rec", "ch", R3(F.col("t") - 86_400).alias("t"), "v")


@query(f"WITH {_SIDED}, c(ch) AS (VALUES ('LFPL01'), ('LFPL12'), ('LFPR01'), ('LFPR23')) SELECT rec, ch, count(*) n FROM sided JOIN c ON label LIKE 'BAD%' AND ch LIKE substr(label, 5) || '%' GROUP BY ALL")
def p13_artifacts_of_channels(spark, sf_dir):
    """Labels and channels share a name prefix: every prefix of a channel is a key, so the join is by equality."""
    chans = spark.createDataFrame([(c,) for c in ("LFPL01", "LFPL12", "LFPR01", "LFPR23")], "ch string")
    keys = chans.withColumn("key", F.explode(F.expr("transform(sequence(4, length(ch)), n -> left(ch, n))")))
    marks = _sided(spark, sf_dir).filter("label LIKE 'BAD%'").select("rec", F.substring("label", 5, 20).alias("key"))
    return marks.join(F.broadcast(keys), "key").groupBy("rec", "ch").agg(F.count("*").alias("n"))
