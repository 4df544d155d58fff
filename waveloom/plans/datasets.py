"""Queries over stored tables, annotations as JSON, spectra in blocks and explanations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import intervals as I
from ..operators import spectral as S
from ..operators import windows as X
from ..operators.stats import with_stats
from ..sources import tables as T
from ..sources import views as V
from .naming import _PARSED, features
from .registry import query

R3 = lambda c: F.round(c, 3).alias(c)
R6 = lambda c: F.round(c, 6).alias(c)

_NAMED = "'S' || lpad((rec % 100)::VARCHAR, 2, '0') || '-' || rec || '_on_rest'"


def _rec(rec="rec"):
    rec = F.col(rec)
    return F.concat(F.lit("S"), F.lpad((rec % 100).cast("string"), 2, "0"), F.lit("-"), rec.cast("string"), F.lit("_on_rest"))


def _marks(spark, sf_dir):
    """One JSON text for each recording, as a hand would mark it; half of the recordings nest once more, and all
    repeat their first interval."""
    rows = V.ivals(spark, sf_dir).select("rec", "label", F.array(F.round("s", 3), F.round("e", 3)).alias("p"))
    lists = rows.groupBy("rec", "label").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    lists = lists.withColumn("ps", F.concat("ps", F.slice("ps", 1, 1)))
    text = F.when(F.col("rec") % 2 == 0, F.to_json("ps")).otherwise(F.to_json(F.array("ps")))
    inner = lists.groupBy("rec").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "label", F.lit('": '), text))), ", ").alias("types"))
    subject = F.regexp_extract(_rec(), "^(.*)_on_rest$", 1)
    return inner.select(F.format_string('{"%s": {"on": {"rest": {%s}}}}', subject, "types").alias("value"))


def _main_side(spark, sf_dir, named=True):
    rec = V.ivals(spark, sf_dir).select("rec").distinct()
    side = F.when(F.col("rec") % 3 == 0, "L").otherwise("R").alias("side")
    return rec.select(_rec().alias("rec") if named else "rec", side)


_MARKS = f"m AS (SELECT DISTINCT {_NAMED} rec, rec n, label AS type, round(s, 3) s, round(e, 3) e FROM fx_ivals)"


@query(f"WITH {_MARKS} SELECT rec, type, s, e FROM m")
def s4_nested_marks(spark, sf_dir):
    return T.flatten_marks(_marks(spark, sf_dir))


@query(f"""WITH {_MARKS}, d AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'L' ELSE 'R' END side FROM m)
  SELECT rec, CASE type WHEN 'trem' THEN 'trem_' ELSE 'undef_' END || side AS label, s, e FROM d WHERE type IN ('trem', 'BAD_LFP')
  UNION ALL SELECT rec, 'notrem_' || CASE side WHEN 'L' THEN 'R' ELSE 'L' END, s, e FROM d WHERE type = 'notrem'""")
def s5_json_annotations(spark, sf_dir):
    """Types of the main side and others of the opposite side, under their new names."""
    marks = T.flatten_marks(_marks(spark, sf_dir))
    return T.to_annotations(marks, _main_side(spark, sf_dir), {"trem": "trem", "BAD_LFP": "undef"}, ("main", "other"), {"notrem": "notrem"})


@query("""WITH a AS (SELECT rec, 'LFP' || CASE WHEN rec % 2 = 0 THEN 'L' ELSE 'R' END || '01' ch, CASE WHEN rec % 3 = 0 THEN 'L' ELSE 'R' END side, s, e FROM fx_ivals WHERE label = 'BAD_LFP')
  SELECT 'main' AS sides, rec, 'BAD_' || ch AS label, round(s, 3) s, round(e, 3) e FROM a WHERE ch[4] = side UNION ALL SELECT 'other', rec, 'BAD_' || ch, round(s, 3), round(e, 3) FROM a WHERE ch[4] <> side
  UNION ALL SELECT 'both', rec, 'BAD_' || ch, round(s, 3), round(e, 3) FROM a""")
def s6_artifact_annotations(spark, sf_dir):
    ch = F.concat(F.lit("LFP"), F.when(F.col("rec") % 2 == 0, "L").otherwise("R"), F.lit("01"))
    rows = V.ivals(spark, sf_dir).filter("label = 'BAD_LFP'").select("rec", ch.alias("ch"), "s", "e")
    parts = [T.artifact_annotations(rows, _main_side(spark, sf_dir, False), x).select(F.lit(x).alias("sides"), "rec", "label", R3("s"), R3("e")) for x in ("main", "other", "both")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT rec, ch, count(*) n FROM fx_samples WHERE NOT (rec % 4 = 1 AND ch = 'qty') AND NOT (rec % 4 = 2 AND ch IN ('price', 'tax')) GROUP BY ALL")
def s7_bad_channels(spark, sf_dir):
    """Bad channels from the subjects' JSON leave before the samples are counted."""
    k = F.col("s_suppkey")
    bad = F.when(k % 4 == 1, '["qty"]').when(k % 4 == 2, '["price", "tax"]').otherwise("[]")
    text = F.format_string('{"%d": {"bad_channels": {"on": {"rest": %s}}, "sex": "f"}}', k, bad)
    found = T.bad_channels(V.table(spark, sf_dir, "supplier").select(text.alias("value")))
    found = found.select(F.regexp_extract("rec", "^([0-9]+)_", 1).cast("long").alias("rec"), "ch")
    return T.without_bad_channels(V.samples(spark, sf_dir), found).groupBy("rec", "ch").agg(F.count("*").alias("n"))


@query("SELECT rec, ch, count(*) n, round(sum(v), 4) total FROM fx_samples WHERE rec IN (1, 2, 3) AND ch IN ('qty', 'disc') AND bin BETWEEN 10 AND 199 GROUP BY ALL")
def s8_prepared_round_trip(spark, sf_dir):
    """Written by recording, then read with pruned partitions and a pushed range of bins."""
    path = T.scratch(spark, "prepared")
    T.write_prepared(V.samples(spark, sf_dir), path)
    some = T.read_prepared(spark, path, [1, 2, 3], ["qty", "disc"], (10, 199))
    return some.groupBy(F.col("rec").cast("long").alias("rec"), "ch").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("WITH s AS (SELECT rec, ch, avg(v) m, stddev_pop(v) sd FROM fx_samples GROUP BY ALL) SELECT rec, ch, count(*) n, round(avg((v - m) / nullif(sd, 0)), 6) z, round(max((v - m) / nullif(sd, 0)), 6) top FROM fx_samples JOIN s USING (rec, ch) WHERE bin < 100 GROUP BY ALL")
def s9_group_statistics(spark, sf_dir):
    """Statistics of each group are written once and read by what scales samples with them."""
    path = T.scratch(spark, "stats")
    V.samples(spark, sf_dir).groupBy("rec", "ch").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd")).write.parquet(path)
    z = (F.col("v") - F.col("m")) / F.nullif("sd", F.lit(0.0))
    rows = V.samples(spark, sf_dir).filter("bin < 100").join(spark.read.parquet(path), ["rec", "ch"]).withColumn("z", z)
    return rows.groupBy("rec", "ch").agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("z"), F.round(F.max("z"), 6).alias("top")).select("rec", "ch", "n", F.col("z") + 0.0, "top").toDF("rec", "ch", "n", "z", "top")


def _feats(spark, sf_dir):
    """rec, bin (of windows of 32), feat, value: level and spread of each channel, named by role and side."""
    side = F.when(F.col("ch").isin("qty", "disc"), "L").otherwise("R")
    name = F.when(F.col("ch").isin("qty", "price"), F.concat(F.lit("LFP"), side, F.lit("01"))).otherwise(F.concat(F.lit("msrc"), side, F.lit("_9_0_c0")))
    rows = V.samples(spark, sf_dir).withColumn("bin", F.floor(F.col("bin") / 32)).groupBy("rec", "bin", name.alias("name"))
    rows = rows.agg(F.avg("v").alias("avg"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("var"))
    return rows.select("rec", "bin", F.explode(F.create_map(F.concat(F.lit("avg_"), "name"), "avg", F.concat(F.lit("var_"), "name"), "var")).alias("feat", "value"))


_FEATS = """w AS (SELECT rec, bin // 32 AS bin, CASE ch WHEN 'qty' THEN 'LFPL01' WHEN 'price' THEN 'LFPR01' WHEN 'disc' THEN 'msrcL_9_0_c0' ELSE 'msrcR_9_0_c0' END name, avg(v) a, var_pop(v) d FROM fx_samples GROUP BY ALL),
  feats AS (SELECT rec, bin, 'avg_' || name feat, a AS value FROM w UNION ALL SELECT rec, bin, 'var_' || name, d FROM w)"""


@query(f"WITH {_FEATS} SELECT feat, count(*) n, count(DISTINCT rec) recs, round(ln(sum(value) + 1), 6) total FROM feats WHERE regexp_matches(feat, '^avg_') GROUP BY feat")
def s10_feature_table(spark, sf_dir):
    """Features go into a table by recording and their names into a small one; a pattern over the names reads a part."""
    path = T.scratch(spark, "features")
    T.write_features(_feats(spark, sf_dir), path)
    got = T.read_features(spark, path, "^avg_")
    return got.groupBy("feat").agg(F.count("*").alias("n"), F.countDistinct("rec").alias("recs"), F.round(F.log(F.sum("value") + 1), 6).alias("total"))


@query(f"""WITH {_FEATS}, r AS (SELECT *, CASE WHEN rec % 3 = 0 THEN 'L' ELSE 'R' END main, regexp_extract(feat, '(LFP|msrc)([LR])', 2) side FROM feats WHERE NOT (rec % 5 = 0 AND feat LIKE '%msrcL%')),
  have AS (SELECT rec, bool_or(feat LIKE '%msrcL%') l, bool_or(feat LIKE '%msrcR%') r FROM r GROUP BY rec),
  c AS (SELECT r.rec, bin, split_part(feat, '_', 1) k, value, CASE WHEN feat LIKE '%LFP%' AND side = main THEN 'lfp' WHEN feat LIKE '%msrc%' AND (side <> main OR NOT CASE main WHEN 'L' THEN have.r ELSE have.l END) THEN 'src' END AS role FROM r JOIN have ON r.rec = have.rec)
  SELECT rec, bin, round(ln(1 + max(value) FILTER (k = 'avg' AND role = 'lfp')), 6) log_lfp, round(ln(1 + max(value) FILTER (k = 'avg' AND role = 'src')), 6) log_src, round(sqrt(max(value) FILTER (k = 'var' AND role = 'src')), 6) sd_src FROM c WHERE role IS NOT NULL GROUP BY rec, bin""")
def p24_modelling_table(spark, sf_dir):
    """One row for each recording and window, columns named by role: the channel of the main side, and the source of
    the opposite side or, in recordings that lack it, that of the same side."""
    feats = _feats(spark, sf_dir).filter(~((F.col("rec") % 5 == 0) & F.col("feat").contains("msrcL")))
    rows = feats.withColumn("main", F.when(F.col("rec") % 3 == 0, "L").otherwise("R")).withColumn("side", F.regexp_extract("feat", "(?:LFP|msrc)([LR])", 1))
    is_source = F.col("feat").contains("msrc")
    have = rows.filter(is_source & (F.col("side") != F.col("main"))).select("rec").distinct().withColumn("has_opposite", F.lit(True))
    rows = rows.join(have, "rec", "left")
    source = is_source & ((F.col("side") != F.col("main")) | F.col("has_opposite").isNull())
    role = F.when(~is_source & (F.col("side") == F.col("main")), "lfp").when(source, "src")
    rows = rows.withColumn("column", F.concat_ws("_", F.substring_index("feat", "_", 1), role)).filter(role.isNotNull())
    wide = rows.groupBy("rec", "bin").pivot("column", ["avg_lfp", "avg_src", "var_src"]).agg(F.max("value"))
    return wide.select("rec", "bin", F.round(F.log(1 + F.col("avg_lfp")), 6).alias("log_lfp"), F.round(F.log(1 + F.col("avg_src")), 6).alias("log_src"), F.round(F.sqrt("var_src"), 6).alias("sd_src"))


@query("SELECT rec_grp, prefix, count(*) n, round(avg(bacc), 8) bacc FROM fx_results GROUP BY ALL")
def s12_light_results(spark, sf_dir):
    """Results are written whole and read without their bulky column."""
    path = T.scratch(spark, "results")
    V.results(spark, sf_dir).withColumn("model", F.repeat(F.sha2(F.col("oid").cast("string"), 256), 4)).write.parquet(path)
    rows = T.light(spark.read.parquet(path), ["model"])
    return rows.groupBy("rec_grp", "prefix").agg(F.count("*").alias("n"), F.round(F.avg("bacc"), 8).alias("bacc"))


@query("""SELECT rec_grp, prefix, grouping, interval_set, oid, round(bacc, 8) bacc FROM fx_results WHERE regexp_matches(rec_grp || '_' || prefix, '^(AUTO|BUILD).*[1-3]-')
  QUALIFY row_number() OVER (PARTITION BY rec_grp, prefix, grouping ORDER BY interval_set DESC, oid DESC) = 1""")
def s14_results_cube(spark, sf_dir):
    """The newest result of each key, of those whose name matches."""
    rows = V.results(spark, sf_dir).withColumn("name", F.concat_ws("_", "rec_grp", "prefix"))
    cube = T.newest_results(rows, ["rec_grp", "prefix", "grouping"], ["interval_set", "oid"], "name", "^(AUTO|BUILD).*[1-3]-")
    return cube.select("rec_grp", "prefix", "grouping", "interval_set", "oid", F.round("bacc", 8).alias("bacc"))


@query("SELECT form, rec_grp, count(*) n FROM fx_results, (VALUES ('csv'), ('json'), ('parquet')) f(form) GROUP BY ALL")
def s15_exports(spark, sf_dir):
    """The same table in three forms, each read back."""
    rows, out = V.results(spark, sf_dir).select("rec_grp", "prefix", "bacc"), None
    for form in ("csv", "json", "parquet"):
        path = T.scratch(spark, f"export-{form}")
        T.export(rows, path, form)
        back = spark.read.schema(rows.schema).option("header", True).format(form).load(path)
        part = back.groupBy("rec_grp").agg(F.count("*").alias("n")).select(F.lit(form).alias("form"), "rec_grp", "n")
        out = part if out is None else out.unionByName(part)
    return out


_PARCELS = """parcels AS (SELECT DISTINCT p_partkey % 59 AS parcel, 'P' || (p_partkey % 59) // 2 || CASE WHEN p_partkey % 2 = (p_partkey - p_partkey % 59) % 2 THEN '_L' ELSE '_R' END AS label,
    ((p_partkey % 59) // 2 + 1) * CASE WHEN p_partkey % 2 = (p_partkey - p_partkey % 59) % 2 THEN -1 ELSE 1 END AS x FROM part)"""


def _parcels(spark, sf_dir):
    """parcel, label (with its side), x: even numbers lie left, odd ones right."""
    k = F.col("p_partkey") % 59
    left = k % 2 == 0
    label = F.concat(F.lit("P"), F.floor(k / 2).cast("string"), F.when(left, "_L").otherwise("_R"))
    x = (F.floor(k / 2) + 1) * F.when(left, -1).otherwise(1)
    return V.table(spark, sf_dir, "part").select(k.cast("int").alias("parcel"), label.alias("label"), x.cast("long").alias("x")).distinct()


@query(f"WITH {_PARSED}, {_PARCELS}, c AS (SELECT DISTINCT ch1 ch, split_part(ch1, '_', 3)::INT parcel FROM pf WHERE ch1 LIKE 'msrc%') SELECT label, count(*) n FROM c JOIN parcels USING (parcel) GROUP BY label")
def s16_parcel_labels(spark, sf_dir):
    """A dictionary of parcels as JSON, read back as the dimension that names the parcels of channels."""
    path = T.scratch(spark, "parcels")
    _parcels(spark, sf_dir).coalesce(1).write.json(path)  # 59 rows
    labels = spark.read.schema("parcel int, label string, x long").json(path)
    ch = features(spark, sf_dir).filter("mod1 = 'msrc'").select("ch1").distinct().select(N.source(F.col("ch1"))["parcel"].alias("parcel"))
    return ch.join(labels, "parcel").groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {_PARSED}, {_PARCELS}, c AS (SELECT DISTINCT ch1 ch, split_part(ch1, '_', 3)::INT parcel FROM pf WHERE ch1 LIKE 'msrc%')
  SELECT ch, 'msrc' || CASE ch[5] WHEN 'L' THEN 'R' ELSE 'L' END || '_' || split_part(ch, '_', 2) || '_' || coalesce(o.parcel, c.parcel) || '_' || split_part(ch, '_', 4) mirrored, -p.x AS x
  FROM c JOIN parcels p USING (parcel) LEFT JOIN parcels o ON o.label = CASE WHEN p.label LIKE '%@_L' ESCAPE '@' THEN replace(p.label, '_L', '_R') ELSE replace(p.label, '_R', '_L') END""")
def p16_mirror_parcels(spark, sf_dir):
    """The side letter, the parcel's number (that of the parcel with the mirrored label, if there is one) and the sign of x change."""
    parcels = _parcels(spark, sf_dir)
    other = parcels.select(F.translate("label", "LR", "RL").alias("label"), F.col("parcel").alias("swapped"))
    pairs = parcels.join(other, "label", "left").select("parcel", "x", F.coalesce("swapped", "parcel").alias("swapped"))
    ch = features(spark, sf_dir).filter("mod1 = 'msrc'").select(F.col("ch1").alias("ch")).distinct().select("ch", N.source(F.col("ch")).alias("p"))
    rows = ch.join(pairs, F.col("p.parcel") == F.col("parcel"))
    return rows.select("ch", F.format_string("msrc%s_%d_%d_c%d", N.opposite(F.col("p.side")), "p.grp", "swapped", "p.comp").alias("mirrored"), (-F.col("x")).alias("x"))


_AREAS = """named AS (SELECT DISTINCT p_partkey % 59 AS parcel, ['Cerebellum','Precentral','Supp_Motor_Area','Calcarine','Insula','Postcentral','unlabeled'][p_partkey % 59 % 7 + 1] b, CASE WHEN p_partkey % 59 % 2 = 0 THEN 'L' ELSE 'R' END AS side FROM part),
  areas AS (SELECT parcel, b, side, CASE WHEN b = 'unlabeled' THEN b ELSE b || '_' || side END AS label, b IN ('Cerebellum', 'Precentral', 'Supp_Motor_Area', 'Postcentral') AS motor FROM named)"""


def _areas(spark, sf_dir):
    """parcel, base, side, label: parcels with names of areas."""
    k = F.col("p_partkey") % 59
    base = F.element_at(F.array(*map(F.lit, ("Cerebellum", "Precentral", "Supp_Motor_Area", "Calcarine", "Insula", "Postcentral", "unlabeled"))), (k % 7 + 1).cast("int"))
    side = F.when(k % 2 == 0, "L").otherwise("R")
    label = F.when(base == "unlabeled", base).otherwise(F.concat_ws("_", base, side))
    return V.table(spark, sf_dir, "part").select(k.cast("int").alias("parcel"), base.alias("base"), side.alias("side"), label.alias("label")).distinct()


@query(f"""WITH {_PARSED}, {_AREAS}, g AS (SELECT parcel, side, motor, label, b, u.name, CASE
    WHEN u.name IN ('all', 'all_raw') THEN label WHEN u.name = 'motor-related_only' THEN CASE WHEN motor THEN label ELSE 'unlabeled' END
    WHEN u.name = 'test' THEN CASE WHEN b IN ('Supp_Motor_Area', 'Precentral') THEN label ELSE 'unlabeled' END WHEN b = 'unlabeled' THEN b
    WHEN u.name = 'merged' THEN 'brain_B' WHEN u.name = 'merged_by_side' THEN 'hemisphere_' || side
    WHEN u.name = 'CB_vs_rest' THEN CASE WHEN b = 'Cerebellum' THEN label ELSE 'notCerebellum_' || side END
    WHEN u.name = 'CBmerged_vs_rest' THEN CASE WHEN b = 'Cerebellum' THEN 'Cerebellum_B' ELSE 'notCerebellum_' || side END
    WHEN u.name = 'motor-related_incCB_vs_rest' THEN CASE WHEN motor THEN 'motor-related_incCB_' ELSE 'rest_' END || side
    WHEN b = 'Cerebellum' THEN CASE WHEN u.name = 'motor-related_vs_CB_vs_rest' THEN label ELSE 'Cerebellum_B' END
    ELSE CASE WHEN motor THEN 'motor-related_' ELSE 'rest_' END || CASE WHEN u.name LIKE '%across_sides' THEN 'B' ELSE side END END grp
  FROM areas, (VALUES ('all'), ('all_raw'), ('merged'), ('merged_by_side'), ('CB_vs_rest'), ('CBmerged_vs_rest'), ('motor-related_incCB_vs_rest'), ('motor-related_only'), ('test'),
    ('motor-related_vs_CB_vs_rest'), ('motor-related_vs_CBmerged_vs_rest'), ('motor-related_vs_CB_vs_rest_merge_across_sides')) u(name)),
  c AS (SELECT split_part(ch1, '_', 3)::INT parcel, count(*) n FROM pf WHERE ch1 LIKE 'msrc%' GROUP BY ALL)
  SELECT name, grp, count(*) parcels, sum(n)::BIGINT n FROM g JOIN c USING (parcel) GROUP BY ALL""")
def j13_parcel_groupings(spark, sf_dir):
    """Features of sources by the coarse groups of their parcels, under every grouping at once."""
    parcel = N.source(F.col("ch1"))["parcel"].alias("parcel")
    n = features(spark, sf_dir).filter("mod1 = 'msrc'").groupBy(parcel).agg(F.count("*").alias("n"))
    groups = N.parcel_groupings(F.col("label"))
    each = F.array(*[F.struct(F.lit(k).alias("name"), c.alias("grp")) for k, c in groups.items()])
    rows = _areas(spark, sf_dir).join(n, "parcel").select("n", F.inline(each))
    return rows.groupBy("name", "grp").agg(F.count("*").alias("parcels"), F.sum("n").alias("n"))


@query(f"WITH {_AREAS} SELECT DISTINCT b AS parcel, side AS body_side, b || '_' || CASE WHEN b = 'Cerebellum' THEN side WHEN side = 'L' THEN 'R' ELSE 'L' END AS label FROM areas WHERE b <> 'unlabeled'")
def j13_side_of_body(spark, sf_dir):
    rows = _areas(spark, sf_dir).filter("base <> 'unlabeled'").select(F.col("base").alias("parcel"), F.col("side").alias("body_side")).distinct()
    return rows.withColumn("label", N.add_body_side(F.col("parcel"), F.col("body_side")))


@query(f"""WITH {_PARSED}, {_PARCELS}, c AS (SELECT ch1 ch, count(*) n FROM pf GROUP BY ch1), m AS (SELECT ch, n, CASE WHEN ch LIKE 'LFP%' THEN 'LFP' ELSE 'msrc' END AS modality FROM c),
  i AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY ch) - 1 AS idx FROM m), s AS (SELECT i.*, CASE WHEN modality = 'LFP' THEN ch[4] WHEN x < 0 THEN 'L' ELSE 'R' END AS side FROM i LEFT JOIN parcels ON modality = 'msrc' AND parcel = TRY_CAST(split_part(ch, '_', 3) AS INT))
  SELECT modality, side, string_agg(ch, ',' ORDER BY ch) AS names, string_agg(idx::VARCHAR, ',' ORDER BY ch) AS places, string_agg(ch, ',' ORDER BY ch) FILTER (n < 10) AS bad FROM s GROUP BY ALL""")
def p25_tuples_by_side(spark, sf_dir):
    """Names and places of the channels of each modality and side (of sources by the sign of x), and which hold too little."""
    ch = features(spark, sf_dir).groupBy(F.col("ch1").alias("ch")).agg(F.count("*").alias("n")).withColumn("modality", N.modality(F.col("ch")))
    placed = ch.withColumn("idx", F.row_number().over(W.partitionBy("modality").orderBy("ch")) - 1)  # one row a channel
    x = _parcels(spark, sf_dir).select("parcel", "x")
    placed = placed.withColumn("parcel", N.source(F.col("ch"))["parcel"]).join(F.broadcast(x), "parcel", "left")
    side = F.when(F.col("modality") == "LFP", N.side(F.col("ch"))).when(F.col("x") < 0, "L").otherwise("R")
    listed = lambda c, of=None: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(of, F.struct("ch", c)) if of is not None else F.struct("ch", c))), lambda t: t[c].cast("string")), ",")
    rows = placed.withColumn("side", side).withColumn("name", F.col("ch")).groupBy("modality", "side")
    return rows.agg(listed("name").alias("names"), listed("idx").alias("places"), F.nullif(listed("name", F.col("n") < 10), F.lit("")).alias("bad"))


@query("""WITH d AS (SELECT *, s > lag(e) OVER (PARTITION BY rec, label ORDER BY s, e) brk FROM fx_ivals), c AS (SELECT *, sum(coalesce(brk, true)::INT) OVER (PARTITION BY rec, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) k FROM d),
  p AS (SELECT *, (row_number() OVER (PARTITION BY rec, label, k ORDER BY s, e) - 1) // 2 q FROM c) SELECT rec, label, round(min(s), 3) s, round(max(e), 3) e FROM p GROUP BY rec, label, k, q""")
def w9_one_pass_merge(spark, sf_dir):
    return I.one_pass_merge(V.ivals(spark, sf_dir), ["rec", "label"]).select("rec", "label", R3("s"), R3("e"))


@query(f"""WITH {_PARSED}, c AS (SELECT DISTINCT ch1 ch, CASE WHEN ch1 LIKE 'LFP%' THEN ch1[4] ELSE ch1[5] END side, CASE WHEN length(ch1) % 2 = 0 THEN 'L' ELSE 'R' END move FROM pf),
  t AS (SELECT *, regexp_replace(ch, '^(LFP|msrc)[LR]', '\\1' || CASE WHEN side = move THEN '^' ELSE '%' END) AS template FROM c)
  SELECT ch, move, template, replace(replace(template, '^', move), '%', CASE move WHEN 'L' THEN 'R' ELSE 'L' END) AS back FROM t""")
def x7_side_templates(spark, sf_dir):
    """Names without sides: ^ stands for the side of movement and % for the other; the way back is given as well."""
    ch = features(spark, sf_dir).select(F.col("ch1").alias("ch")).distinct().withColumn("move", F.when(F.length("ch") % 2 == 0, "L").otherwise("R"))
    mark = F.when(N.side(F.col("ch")) == F.col("move"), "^").otherwise("%")
    rows = ch.withColumn("template", F.concat(F.regexp_extract("ch", "^(LFP|msrc)", 1), mark, F.regexp_extract("ch", "^(?:LFP|msrc)[LR](.*)$", 1)))
    back = F.replace(F.replace("template", F.lit("^"), "move"), F.lit("%"), N.opposite(F.col("move")))
    return rows.select("ch", "move", "template", back.alias("back"))


#: Rules of channel pairs: patterns of both, only pairs in order, a channel with itself.
PAIR_RULES = [(0, "^LFP", "^msrc.*_c0$", False, False), (1, "^LFPL", "^LFPL", True, True), (2, "_9_[0-9]_c[01]$", "_9_[0-9]_c[01]$", True, False)]


@query(f"""WITH {_PARSED}, c AS (SELECT DISTINCT ch1 ch FROM pf) SELECT 0 AS rule, a.ch ch1, b.ch ch2 FROM c a, c b WHERE regexp_matches(a.ch, '^LFP') AND regexp_matches(b.ch, '^msrc.*_c0$')
  UNION ALL SELECT 1, a.ch, b.ch FROM c a, c b WHERE regexp_matches(a.ch, '^LFPL') AND regexp_matches(b.ch, '^LFPL') AND a.ch <= b.ch
  UNION ALL SELECT 2, a.ch, b.ch FROM c a, c b WHERE regexp_matches(a.ch, '_9_[0-9]_c[01]$') AND regexp_matches(b.ch, '_9_[0-9]_c[01]$') AND a.ch < b.ch""")
def j10_rule_pairs(spark, sf_dir):
    """Each rule chooses its channels first, so that pairs are joined by rule and in the end only filtered by order."""
    ch = features(spark, sf_dir).select(F.col("ch1").alias("ch")).distinct()
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(up).alias("up"), F.lit(same).alias("same")) for k, a, b, up, same in PAIR_RULES])
    rows = ch.select("ch", F.inline(rules))
    left = rows.filter(F.rlike("ch", F.col("a"))).select("rule", "up", "same", F.col("ch").alias("ch1"))
    right = rows.filter(F.rlike("ch", F.col("b"))).select("rule", F.col("ch").alias("ch2"))
    fits = ~F.col("up") | (F.col("ch1") < F.col("ch2")) | (F.col("same") & (F.col("ch1") == F.col("ch2")))
    return left.join(right, "rule").filter(fits).select("rule", "ch1", "ch2")


@query("""WITH b(band, lo, hi) AS (VALUES ('tremor', 3, 10), ('beta', 11, 30)), p AS (SELECT rec, ch, freq, band, re * re + im * im p FROM fx_tfr JOIN b ON freq BETWEEN lo AND hi), w AS (SELECT rec, avg(re * re + im * im) m FROM fx_tfr GROUP BY rec)
  SELECT rec, band, count(*) n, round(max(p), 6) top, round(min(p), 8) low, round(avg(p), 6) mean, round(avg(sqrt(p)), 6) lhalf, round(sqrt(avg(p * p)), 6) l2, round(avg(p) / any_value(m), 6) relative FROM p JOIN w USING (rec) GROUP BY rec, band""")
def a19_spectral_summary(spark, sf_dir):
    """Extremes and norms of power by band, and its level against the whole recording's."""
    tfr = V.tfr(spark, sf_dir).withColumn("p", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    band = F.when(F.col("freq").between(3, 10), "tremor").when(F.col("freq").between(11, 30), "beta")
    whole = tfr.groupBy("rec").agg(F.avg("p").alias("m"))
    aggs = {"top": F.max("p"), "low": F.min("p"), "mean": F.avg("p"), "lhalf": F.avg(F.sqrt("p")), "l2": F.sqrt(F.avg(F.col("p") * F.col("p")))}
    rows = tfr.withColumn("band", band).filter("band is not null").groupBy("rec", "band").agg(F.count("*").alias("n"), *[a.alias(c) for c, a in aggs.items()])
    rows = rows.join(whole, "rec").withColumn("relative", F.col("mean") / F.col("m"))
    return rows.select("rec", "band", "n", R6("top"), F.round("low", 8).alias("low"), R6("mean"), R6("lhalf"), R6("l2"), R6("relative"))


@query("""WITH p AS (SELECT rec, ch, freq, atan2(im, re) ph, sqrt(re * re + im * im) amp FROM fx_tfr), d AS (SELECT *, coalesce(ph - lag(ph) OVER (PARTITION BY rec, ch ORDER BY freq), 0) d FROM p),
  u AS (SELECT *, ph - 2 * pi() * sum(CASE WHEN d > pi() THEN 1 WHEN d < -pi() THEN -1 ELSE 0 END) OVER (PARTITION BY rec, ch ORDER BY freq ROWS UNBOUNDED PRECEDING) un FROM d)
  SELECT rec, ch, freq, round(un, 6) phase, round((un - lag(un) OVER (PARTITION BY rec, ch ORDER BY freq)) / (2 * pi()), 6) rate, round(amp, 6) amp FROM u""")
def w14_unwrapped_phase(spark, sf_dir):
    """Phase without jumps, its rate of change and the amplitude along each analytic series."""
    return S.unwrapped(V.tfr(spark, sf_dir), ["rec", "ch"], "freq").select("rec", "ch", "freq", R6("phase"), R6("rate"), R6("amp"))


@query("""WITH k AS (SELECT rec, ch, bin // 32 AS w, bin % 32 AS i, v FROM fx_samples), f AS (SELECT rec, ch, w FROM k GROUP BY ALL HAVING count(*) = 32),
  s AS (SELECT rec, ch, w, q.freq, sum(v * cos(2 * pi() * q.freq * i / 32)) re, sum(v * sin(2 * pi() * q.freq * i / 32)) im FROM k JOIN f USING (rec, ch, w), range(0, 17) q(freq) GROUP BY ALL)
  SELECT rec, ch, freq::INT freq, count(*) n, round(ln(avg(re * re + im * im) + 1), 5) power FROM s GROUP BY ALL""")
def f4_spectrogram(spark, sf_dir):
    """Fourier transforms of blocks of 32 bins, many blocks of an Arrow batch at once, then averaged by frequency."""
    spectra = S.spectrogram(V.samples(spark, sf_dir), 32)
    return spectra.groupBy("rec", "ch", "freq").agg(F.count("*").alias("n"), F.round(F.log(F.avg("power") + 1), 5).alias("power"))


@query("""WITH d AS (SELECT rec, ch, bin, abs(v - lag(v) OVER (PARTITION BY rec, ch ORDER BY bin)) d FROM fx_samples), m AS (SELECT rec, ch, avg(d) m, stddev_pop(d) sd FROM d GROUP BY ALL),
  z AS (SELECT rec, bin, avg((d - m) / nullif(sd, 0)) z FROM d JOIN m USING (rec, ch) GROUP BY rec, bin HAVING avg((d - m) / nullif(sd, 0)) > 1.2),
  g AS (SELECT *, bin - row_number() OVER (PARTITION BY rec ORDER BY bin) g FROM z) SELECT rec, min(bin) b0, max(bin) b1, count(*) n FROM g GROUP BY rec, g.g""")
def f8_muscle_artifacts(spark, sf_dir):
    """Runs of bins in which the fast part of all channels together, scaled by channel, lies above a threshold."""
    fast = X.differences(V.samples(spark, sf_dir), ["rec", "ch"], 1.0).withColumn("d", F.when(F.col("bin") > 0, F.abs("dv")))
    scaled = with_stats(fast, ["rec", "ch"], m=F.avg("d"), sd=F.stddev_pop("d"))
    z = scaled.withColumn("z", (F.col("d") - F.col("m")) / F.nullif("sd", F.lit(0.0)))
    high = z.groupBy("rec", "bin").agg(F.avg("z").alias("z")).filter("z > 1.2")
    high = X.numbered(high, ["rec"], "at").withColumn("run", F.col("bin") - F.col("at"))
    return high.groupBy("rec", "run").agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.count("*").alias("n")).drop("run")


_LOCAL = """x AS (SELECT vec_id AS key, label % 2 y, f::INT feat, embedding[f]::DOUBLE x FROM embeddings, range(1, 65) r(f)),
  m AS (SELECT feat, avg(x) m, avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0) w FROM x GROUP BY feat)"""


@query(f"WITH {_LOCAL} SELECT key, 'f' || feat AS feat, round(w * (x - m), 8) score FROM x JOIN m USING (feat) WHERE key % 10 = 3 UNION ALL SELECT vec_id, 'intercept', round((SELECT avg(label % 2) FROM embeddings), 8) FROM embeddings WHERE vec_id % 10 = 3")
def m22_local_explanations(spark, sf_dir):
    """What each feature adds to the score of a row, as a long table with the intercept; parts of feature pairs go.

    The explained rows are those asked for; means and weights come from all."""
    rows = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), (F.col("label") % 2).alias("y"), F.posexplode("embedding").alias("pos", "x"))
    rows = rows.select("key", "y", (F.col("pos") + 1).alias("feat"), F.col("x").cast("double").alias("x"))
    stats = rows.groupBy("feat").agg(F.avg("x").alias("m"), (F.avg(F.when(F.col("y") == 1, F.col("x"))) - F.avg(F.when(F.col("y") == 0, F.col("x")))).alias("w"))
    asked = rows.filter("key % 10 = 3").join(F.broadcast(stats), "feat")  # one row for each component
    part = F.col("w") * (F.col("x") - F.col("m"))
    name = F.concat(F.lit("f"), F.col("feat").cast("string"))
    pairs = asked.filter("feat < 64").select("key", F.concat(name, F.lit(" x f"), (F.col("feat") + 1).cast("string")).alias("feat"), F.lit(0.0).alias("score"))
    ends = V.table(spark, sf_dir, "embeddings").agg(F.avg(F.col("label") % 2).alias("score"))
    keys = V.table(spark, sf_dir, "embeddings").filter("vec_id % 10 = 3").select(F.col("vec_id").alias("key"), F.lit("intercept").alias("feat"))
    scores = asked.select("key", name.alias("feat"), part.alias("score")).unionByName(pairs).unionByName(keys.crossJoin(ends))  # one row
    return scores.filter(~F.col("feat").contains(" x ")).select("key", "feat", F.round("score", 8).alias("score"))


@query("SELECT rec_grp, CASE prefix WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE 'rest' END AS label, printf('%.1f%%', avg(bacc) * 100) AS share FROM fx_results GROUP BY ALL")
def x13_percent_tables(spark, sf_dir):
    """Shares as text with one digit, labels replaced by a dictionary."""
    label = F.coalesce(T.spark_map({"1-URGENT": "urgent", "2-HIGH": "high"})[F.col("prefix")], F.lit("rest"))
    rows = V.results(spark, sf_dir).groupBy("rec_grp", label.alias("label")).agg(F.avg("bacc").alias("share"))
    return rows.select("rec_grp", "label", F.format_string("%.1f%%", F.col("share") * 100).alias("share"))


@query("WITH p AS (SELECT DISTINCT prefix FROM fx_results), g AS (SELECT DISTINCT grouping FROM fx_results) SELECT prefix, grouping, d.depth, count(oid) n FROM p CROSS JOIN g CROSS JOIN (VALUES (2), (3)) d(depth) LEFT JOIN fx_results r USING (prefix, grouping) GROUP BY ALL")
def x14_parameter_grid(spark, sf_dir):
    """Every combination of parameter values, found ones and given ones, with how many results it has."""
    rows = V.results(spark, sf_dir)
    values = rows.agg(F.collect_set("prefix").alias("prefix"), F.collect_set("grouping").alias("grouping")).withColumn("depth", F.array(F.lit(2), F.lit(3)))
    grid = values.withColumn("prefix", F.explode("prefix")).withColumn("grouping", F.explode("grouping")).withColumn("depth", F.explode("depth"))
    n = rows.groupBy("prefix", "grouping").agg(F.count("*").alias("n"))
    return grid.join(n, ["prefix", "grouping"], "left").select("prefix", "grouping", "depth", F.coalesce("n", F.lit(0)).alias("n"))
