"""Queries over feature names and channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..sources import views as V
from .registry import query

_PARSED = """p AS (SELECT feat, coalesce(nullif(regexp_extract(feat, '^(H_[a-z]{1,5})_', 1), ''), split_part(feat, '_', 1)) ftype,
    CASE WHEN feat LIKE 'H@_%' ESCAPE '@' THEN NULL ELSE split_part(feat, '_', 2) END fb1,
    CASE WHEN feat LIKE 'con%' THEN split_part(feat, '_', 2) WHEN feat LIKE 'H@_%' ESCAPE '@' THEN NULL ELSE split_part(split_part(feat, ',', 2), '_', 1) END fb2,
    CASE WHEN feat LIKE 'H@_%' ESCAPE '@' THEN regexp_extract(feat, '^H_[a-z]{1,5}_(.+)$', 1) ELSE regexp_extract(split_part(feat, ',', 1), '^[a-z]+_[A-Za-z0-9]+_(.+)$', 1) END ch1,
    CASE WHEN feat LIKE 'con%' THEN split_part(feat, ',', 2) WHEN feat LIKE 'H@_%' ESCAPE '@' THEN NULL ELSE regexp_extract(split_part(feat, ',', 2), '^[A-Za-z0-9]+_(.+)$', 1) END ch2 FROM fx_names),
  pf AS (SELECT *, CASE WHEN ch1 LIKE 'LFP%' THEN 'LFP' WHEN ch1 LIKE 'msrc%' THEN 'msrc' END mod1, CASE WHEN ch2 LIKE 'LFP%' THEN 'LFP' WHEN ch2 LIKE 'msrc%' THEN 'msrc' END mod2 FROM p)"""


def features(spark, sf_dir):
    return N.parsed(V.names(spark, sf_dir))


@query(f"WITH {_PARSED} SELECT feat, ftype, fb1, fb2, ch1, ch2, mod1, mod2 FROM pf")
def x2_parse_features(spark, sf_dir):
    return features(spark, sf_dir)


@query(f"WITH {_PARSED}, c AS (SELECT DISTINCT ch FROM (SELECT ch1 ch FROM pf UNION ALL SELECT ch2 FROM pf) WHERE ch LIKE 'msrc%') SELECT ch, ch[5] side, split_part(ch, '_', 2)::INT grp, split_part(ch, '_', 3)::INT parcel, substr(split_part(ch, '_', 4), 2)::INT comp FROM c")
def x3_parse_sources(spark, sf_dir):
    ch = features(spark, sf_dir).select(F.explode(F.array("ch1", "ch2")).alias("ch")).filter("ch LIKE 'msrc%'").distinct()
    return ch.select("ch", N.source(F.col("ch")).alias("x")).select("ch", "x.*")


@query("WITH n AS (SELECT DISTINCT 'S' || lpad((c_custkey % 150)::VARCHAR, 2, '0') || '_' || CASE WHEN c_custkey % 2 = 0 THEN 'on' ELSE 'off' END || '_' || ['hold','move','rest'][c_custkey % 3 + 1] AS name FROM customer) SELECT name, split_part(name, '_', 1) subject, split_part(name, '_', 2) medcond, split_part(name, '_', 3) task FROM n")
def x1_parse_recordings(spark, sf_dir):
    k = F.col("c_custkey")
    number = F.when(k % 150 < 100, F.lpad((k % 150).cast("string"), 2, "0")).otherwise(F.substring((k % 150).cast("string"), 1, 2))
    task = F.element_at(F.array(F.lit("hold"), F.lit("move"), F.lit("rest")), (k % 3 + 1).cast("int"))
    name = F.concat(F.lit("S"), number, F.lit("_"), F.when(k % 2 == 0, "on").otherwise("off"), F.lit("_"), task)
    rows = V.table(spark, sf_dir, "customer").select(name.alias("name")).distinct()
    return rows.select("name", N.recording(F.col("name")).alias("x")).select("name", "x.*")


@query(f"WITH {_PARSED} SELECT feat FROM pf WHERE regexp_matches(feat, '^(H_act|con_beta|rbcorr_.*c1)')")
def p1_select_names(spark, sf_dir):
    return V.names(spark, sf_dir).filter(N.any_of(F.col("feat"), ["H_act", "con_beta", "rbcorr_.*c1"]))


@query(f"""WITH {_PARSED} SELECT feat FROM pf WHERE (ch1 LIKE 'LFP%' OR coalesce(ch2 LIKE 'LFP%', false)) AND (ch1 NOT LIKE 'LFP%' OR ch1[4] = 'R') AND (ch2 IS NULL OR ch2 NOT LIKE 'LFP%' OR ch2[4] = 'R')
  AND (fb1 IS NULL OR fb1 IN ('tremor', 'beta', 'HFO')) AND (fb2 IS NULL OR fb2 IN ('tremor', 'beta', 'HFO')) AND (ch2 IS NULL OR ch1 <> ch2) AND coalesce(fb1 NOT LIKE 'HFO%', true) AND coalesce(fb2 NOT LIKE 'HFO%', true)
  AND (ch1 NOT LIKE 'msrc%' OR split_part(ch1, '_', 3)::INT NOT IN (3, 5, 7)) AND (ch2 IS NULL OR ch2 NOT LIKE 'msrc%' OR split_part(ch2, '_', 3)::INT NOT IN (3, 5, 7))""")
def p2_filter_features(spark, sf_dir):
    some = N.selected(features(spark, sf_dir), need_lfp=True, lfp_side="R", bands=["tremor", "beta", "HFO"], drop_self=True, drop_hfo=True, not_parcels=[3, 5, 7])
    return some.select("feat")


def _both(rule: str) -> str:
    """A rule on sources ({side}, {par}, {comp}) that both channels of a feature must keep."""
    one = lambda c: f"({c} IS NULL OR {c} NOT LIKE 'msrc%' OR (" + rule.format(side=f"{c}[5]", par=f"TRY_CAST(split_part({c}, '_', 3) AS INT)", comp=f"TRY_CAST(substr(split_part({c}, '_', 4), 2) AS INT)") + "))"
    return f"{one('ch1')} AND {one('ch2')}"


#: Rule families: the settings, and what SQL says of them.
_RULES = {
    "lfp": ({"need_lfp": True}, "(ch1 LIKE 'LFP%' OR coalesce(ch2 LIKE 'LFP%', false))"),
    "lfp side": ({"lfp_side": "L"}, "(ch1 NOT LIKE 'LFP%' OR ch1[4] = 'L') AND (ch2 IS NULL OR ch2 NOT LIKE 'LFP%' OR ch2[4] = 'L')"),
    "brain side": ({"brain_side": "L"}, _both("{side} = 'L'")),
    "brain side by cerebellum": ({"brain_side": "L", "cerebellum": {"L": 3, "R": 4}}, _both("({side} = 'L' AND {par} <> 3) OR ({side} = 'R' AND {par} = 4)")),
    "only cerebellum": ({"cerebellum": {"L": 3, "R": 4}, "cerebellum_only": True}, _both("{par} = CASE {side} WHEN 'L' THEN 3 ELSE 4 END")),
    "parcels": ({"parcels": list(range(1, 21))}, _both("{par} BETWEEN 1 AND 20")),
    "not parcels": ({"not_parcels": [2, 4, 6]}, _both("{par} NOT IN (2, 4, 6)")),
    "components": ({"components": [1]}, _both("{comp} = 1")),
    "no self": ({"drop_self": True}, "(ch2 IS NULL OR ch1 <> ch2)"),
    "no cross lfp": ({"drop_cross_lfp": True}, "NOT (ch2 IS NOT NULL AND ch1 LIKE 'LFP%' AND ch2 LIKE 'LFP%' AND ch1 <> ch2)"),
    "cross": ({"cross_only": True}, "(ch2 IS NOT NULL AND ch1 <> ch2)"),
    "self": ({"self_only": True}, "(ch2 IS NULL OR ch1 = ch2)"),
    "bands": ({"bands": ["beta", "gamma"]}, "coalesce(fb1 IN ('beta', 'gamma'), true) AND coalesce(fb2 IN ('beta', 'gamma'), true)"),
    "bands of modalities": ({"bands_of": {"LFP": ["HFO", "beta"], "msrc": ["tremor", "beta"]}}, " AND ".join(f"(fb{n} IS NULL OR (mod{n} = 'LFP' AND fb{n} IN ('HFO', 'beta')) OR (mod{n} = 'msrc' AND fb{n} IN ('tremor', 'beta')))" for n in (1, 2))),
    "types": ({"types": ["con", "H_act"]}, "ftype IN ('con', 'H_act')"),
    "modalities": ({"modalities": ["msrc"]}, "mod1 = 'msrc' AND coalesce(mod2 = 'msrc', true)"),
    "main channel": ({"lfp_channel": "LFPR05"}, "(ch1 NOT LIKE 'LFP%' OR ch1 = 'LFPR05') AND (ch2 IS NULL OR ch2 NOT LIKE 'LFP%' OR ch2 = 'LFPR05')"),
    "no hfo": ({"drop_hfo": True}, "coalesce(fb1 NOT LIKE 'HFO%', true) AND coalesce(fb2 NOT LIKE 'HFO%', true)"),
}


@query(f"WITH {_PARSED} " + " UNION ALL ".join(f"SELECT '{name}' AS rule, feat FROM pf WHERE {sql}" for name, (_, sql) in _RULES.items()))
def p2_rule_families(spark, sf_dir):
    """Every family of the composite filter on its own."""
    some = features(spark, sf_dir)
    out = None
    for name, (rule, _) in _RULES.items():
        one = N.selected(some, **rule).select(F.lit(name).alias("rule"), "feat")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_PARSED} SELECT replace(feat, 'LFPR05', 'LFPR_main') feat, replace(ch1, 'LFPR05', 'LFPR_main') ch1, replace(ch2, 'LFPR05', 'LFPR_main') ch2 FROM pf WHERE (ch1 NOT LIKE 'LFP%' OR ch1 = 'LFPR05') AND (ch2 IS NULL OR ch2 NOT LIKE 'LFP%' OR ch2 = 'LFPR05')")
def p2_main_channel(spark, sf_dir):
    """Features of the main channel alone, under its general name."""
    return N.renamed(N.selected(features(spark, sf_dir), lfp_channel="LFPR05"), "LFPR05", "LFPR_main").select("feat", "ch1", "ch2")


@query(f"WITH {_PARSED} SELECT feat FROM pf WHERE (mod1 = 'msrc' AND fb1 IN ('beta', 'gamma') AND mod2 = 'LFP' AND fb2 IN ('HFO', 'beta')) OR (mod2 = 'msrc' AND fb2 IN ('beta', 'gamma') AND mod1 = 'LFP' AND fb1 IN ('HFO', 'beta'))")
def p3_band_combinations(spark, sf_dir):
    def combo(a, b):
        return (F.col(f"mod{a}") == "msrc") & F.col(f"fb{a}").isin("beta", "gamma") & (F.col(f"mod{b}") == "LFP") & F.col(f"fb{b}").isin("HFO", "beta")

    return features(spark, sf_dir).filter(combo(1, 2) | combo(2, 1)).select("feat")


@query(f"WITH {_PARSED}, ok AS (SELECT DISTINCT ch1 ch FROM pf WHERE ch1 LIKE '%c0' OR ch1 LIKE 'LFPL%') SELECT feat FROM pf WHERE ftype IN ('con', 'rbcorr') AND ch1 IN (SELECT ch FROM ok) AND (ch2 IS NULL OR ch2 LIKE '%c0' OR ch2 LIKE 'LFPL%')")
def p4_select_by_channels(spark, sf_dir):
    fine = lambda c: c.endswith("c0") | c.startswith("LFPL")
    rows = features(spark, sf_dir).filter(F.col("ftype").isin("con", "rbcorr"))
    return rows.filter(F.forall(F.array_compact(F.array("ch1", "ch2")), fine)).select("feat")


@query(f"WITH {_PARSED} SELECT regexp_replace(feat, 'LFPL02', 'LFPmain') feat, CASE WHEN ch1 = 'LFPL02' OR ch2 = 'LFPL02' THEN 'only' ELSE 'without' END part FROM pf")
def p5_split_by_channel(spark, sf_dir):
    mine = F.coalesce(F.array_contains(F.array_compact(F.array("ch1", "ch2")), "LFPL02"), F.lit(False))
    return features(spark, sf_dir).select(F.replace("feat", F.lit("LFPL02"), F.lit("LFPmain")).alias("feat"), F.when(mine, "only").otherwise("without").alias("part"))


@query(f"WITH {_PARSED} SELECT DISTINCT ch FROM (SELECT ch1 ch FROM pf WHERE mod1 = 'LFP' UNION ALL SELECT ch2 FROM pf WHERE mod2 = 'LFP')")
def p6_channels_of_modality(spark, sf_dir):
    rows = features(spark, sf_dir).select(F.explode(F.array("ch1", "ch2")).alias("ch"))
    return rows.filter(N.modality(F.col("ch")) == "LFP").distinct()


@query(f"WITH {_PARSED} SELECT feat, round(list_position(['H_act','H_mob','H_compl','con','rbcorr','bpcorr'], ftype) + CASE WHEN ch2 IS NULL OR ch1 = ch2 THEN 0 ELSE 0.1 END, 1)::DOUBLE AS rank FROM pf")
def p7_canonical_order(spark, sf_dir):
    return features(spark, sf_dir).select("feat", F.round(N.rank(F.col("ftype"), F.col("ch1"), F.col("ch2")), 1).alias("rank"))


_BANDS = "bands(band, lo, hi) AS (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in N.BANDS.items()) + ")"


def bands(spark):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in N.BANDS.items()], "band string, lo int, hi int")


@query(f"WITH {_BANDS} SELECT p_size::BIGINT AS freq, band FROM (SELECT DISTINCT p_size FROM part) JOIN bands ON p_size BETWEEN lo AND hi")
def p8_bands_of_frequencies(spark, sf_dir):
    freqs = V.table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("freq")).distinct()
    # eleven bands: a table of fixed size
    return freqs.join(F.broadcast(bands(spark)), F.col("freq").between(F.col("lo"), F.col("hi"))).select("freq", "band")


@query(f"WITH {_PARSED} SELECT ch, CASE WHEN ch LIKE 'LFP%' THEN ch[4] ELSE ch[5] END side, count(*) n FROM (SELECT ch1 ch FROM pf UNION ALL SELECT ch2 FROM pf) WHERE ch IS NOT NULL GROUP BY ALL")
def p17_channels_by_side(spark, sf_dir):
    ch = features(spark, sf_dir).select(F.explode(F.array_compact(F.array("ch1", "ch2"))).alias("ch"))
    return ch.groupBy("ch", N.side(F.col("ch")).alias("side")).agg(F.count("*").alias("n"))


@query(f"WITH {_PARSED} SELECT DISTINCT regexp_replace(ch1, '_9_', '_11_') ch FROM pf WHERE ch1 LIKE 'msrc%'")
def p18_rename_source_group(spark, sf_dir):
    ch = features(spark, sf_dir).filter("mod1 = 'msrc'").select(N.source(F.col("ch1")).alias("x"))
    grp = F.when(F.col("x.grp") == 9, 11).otherwise(F.col("x.grp"))
    return ch.select(F.format_string("msrc%s_%d_%d_c%d", "x.side", grp, "x.parcel", "x.comp").alias("ch")).distinct()


@query(f"WITH {_PARSED} SELECT DISTINCT ch1 ch, 'msrc' || CASE ch1[5] WHEN 'L' THEN 'R' ELSE 'L' END || substr(ch1, 6) mirrored FROM pf WHERE ch1 LIKE 'msrc%'")
def p16_mirror_channels(spark, sf_dir):
    ch = features(spark, sf_dir).filter("mod1 = 'msrc'").select(F.col("ch1").alias("ch")).distinct()
    return ch.select("ch", F.concat(F.lit("msrc"), N.opposite(N.side(F.col("ch"))), F.substring("ch", 6, 100)).alias("mirrored"))


@query(f"WITH {_PARSED} SELECT ftype, list_aggregate(list_sort(list(DISTINCT fb1) FILTER (fb1 IS NOT NULL)), 'string_agg', ',') fb1s, list_aggregate(list_sort(list(DISTINCT mod1)), 'string_agg', ',') mods, count(*) n FROM pf GROUP BY ftype")
def a35_feature_types(spark, sf_dir):
    listed = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit(""))
    return features(spark, sf_dir).groupBy("ftype").agg(listed("fb1").alias("fb1s"), listed("mod1").alias("mods"), F.count("*").alias("n"))


@query(f"WITH {_PARSED}, lab AS (SELECT ch, unnest(['BAD_M', 'BAD_M' || side, 'BAD_' || ch]) AS label FROM (SELECT DISTINCT ch1 ch, CASE WHEN ch1 LIKE 'LFP%' THEN ch1[4] ELSE ch1[5] END side FROM pf)) SELECT label, count(*) n FROM pf JOIN lab ON ch1 = ch GROUP BY label")
def j6_artifact_labels(spark, sf_dir):
    """Labels that apply to a feature's channel: global, by side, by channel; an equi-join instead of name patterns."""
    ch = F.col("ch1")
    labels = F.array(F.lit("BAD_M"), F.concat(F.lit("BAD_M"), N.side(ch)), F.concat(F.lit("BAD_"), ch))
    return features(spark, sf_dir).select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {_PARSED}, c AS (SELECT DISTINCT ch FROM (SELECT ch1 ch FROM pf UNION ALL SELECT ch2 FROM pf) WHERE ch IS NOT NULL), lab AS (SELECT ch, unnest(CASE WHEN ch LIKE 'LFP%' THEN ['BAD_LFP', 'BAD_LFP' || ch[4], 'BAD_' || ch] ELSE ['BAD_MEG', 'BAD_MEG' || ch[5], 'BAD_' || ch] END) AS label FROM c),
  bad AS (SELECT rec, CASE label WHEN 'trem' THEN 'BAD_LFPR' WHEN 'notrem' THEN 'BAD_LFPL' || lpad((rec % 13)::VARCHAR, 2, '0') WHEN 'hold' THEN 'BAD_MEGL' ELSE CASE WHEN rec % 10 = 0 THEN 'BAD_MEG' ELSE 'BAD_LFP_other' END END AS label, unnest(range(b0, b1)) bin FROM fx_anns),
  m AS (SELECT DISTINCT ch, rec, bin FROM lab JOIN bad USING (label)), f AS (SELECT DISTINCT feat, rec, bin FROM (SELECT feat, ch1 ch FROM pf UNION SELECT feat, ch2 FROM pf) JOIN m USING (ch))
  SELECT feat, count(*) n_bins, count(DISTINCT rec) n_recs FROM f GROUP BY feat""")
def j6_artifact_masks(spark, sf_dir):
    """How many bins of how many recordings are masked for each feature: artifacts of a modality, of a side, of one of its channels."""
    label = (
        F.when(F.col("label") == "trem", "BAD_LFPR")
        .when(F.col("label") == "notrem", F.concat(F.lit("BAD_LFPL"), F.lpad((F.col("rec") % 13).cast("string"), 2, "0")))
        .when(F.col("label") == "hold", "BAD_MEGL")
        .otherwise(F.when(F.col("rec") % 10 == 0, "BAD_MEG").otherwise("BAD_LFP_other"))
    )
    sets, masks = N.mask_sets(features(spark, sf_dir), V.anns(spark, sf_dir).withColumn("label", label))
    counts = masks.groupBy("labels").agg(F.sum("n_bins").alias("n_bins"), F.count("*").alias("n_recs"))
    return sets.join(counts, "labels").select("feat", "n_bins", "n_recs")



@query(f"WITH {_PARSED}, c AS (SELECT DISTINCT ch1 ch FROM pf) SELECT a.ch ch1, b.ch ch2 FROM c a JOIN c b ON a.ch[1:3] = 'LFP' AND b.ch LIKE 'msrc%c0' AND a.ch[4] = b.ch[5]")
def j10_channel_pairs(spark, sf_dir):
    """Pairs by rule; the side in common makes it an equi-join."""
    ch = features(spark, sf_dir).select(F.col("ch1").alias("ch")).distinct().withColumn("side", N.side(F.col("ch")))
    lfp = ch.filter("ch LIKE 'LFP%'").select(F.col("ch").alias("ch1"), "side")
    src = ch.filter("ch LIKE 'msrc%c0'").select(F.col("ch").alias("ch2"), "side")
    return lfp.join(src, "side").select("ch1", "ch2")


@query(f"WITH {_PARSED}, c AS (SELECT DISTINCT ch1 ch FROM pf WHERE ch1 LIKE 'msrc%') SELECT ['frontal','parietal','motor','temporal','cerebellum'][split_part(ch, '_', 3)::INT % 5 + 1] || '_' || ch[5] grp, count(*) n FROM c GROUP BY ALL")
def j13_parcel_groups(spark, sf_dir):
    ch = features(spark, sf_dir).filter("mod1 = 'msrc'").select(F.col("ch1").alias("ch")).distinct().select(N.source(F.col("ch")).alias("x"))
    groups = ("frontal", "parietal", "motor", "temporal", "cerebellum")
    mapping = spark.createDataFrame([(k, groups[k % 5]) for k in range(59)], "parcel int, coarse string")
    joined = ch.select("x.*").join(F.broadcast(mapping), "parcel")
    return joined.groupBy(F.concat_ws("_", "coarse", "side").alias("grp")).agg(F.count("*").alias("n"))


@query(f"WITH {_PARSED} SELECT feat, CASE WHEN ch1 LIKE 'LFP%' THEN 'LFP ' || ch1[4] || ' ' || substr(ch1, 5) ELSE 'source ' || ch1[5] || ' parcel ' || split_part(ch1, '_', 3) END || coalesce(' / ' || fb1, '') nice FROM pf")
def x5_readable_names(spark, sf_dir):
    ch = F.col("ch1")
    lfp = F.concat_ws(" ", F.lit("LFP"), N.side(ch), F.substring(ch, 5, 10))
    src = F.concat_ws(" ", F.lit("source"), N.side(ch), F.lit("parcel"), N.source(ch)["parcel"].cast("string"))
    nice = F.concat(F.when(ch.startswith("LFP"), lfp).otherwise(src), F.coalesce(F.concat(F.lit(" / "), "fb1"), F.lit("")))
    return features(spark, sf_dir).select("feat", nice.alias("nice"))


@query(f"WITH {_PARSED} SELECT ch1, ch2, CASE WHEN ch1 LIKE 'LFP%' THEN ch1[4] ELSE ch1[5] END side, CASE CASE WHEN ch1 LIKE 'LFP%' THEN ch1[4] ELSE ch1[5] END WHEN 'L' THEN 'R' ELSE 'L' END opposite FROM pf")
def x6_sides(spark, sf_dir):
    s = N.side(F.col("ch1"))
    return features(spark, sf_dir).select("ch1", "ch2", s.alias("side"), N.opposite(s).alias("opposite"))


@query(f"WITH {_PARSED} SELECT ch1, ch2 FROM pf WHERE ftype = 'rbcorr' UNION SELECT ch2, ch1 FROM pf WHERE ftype = 'rbcorr'")
def x10_symmetric_pairs(spark, sf_dir):
    rows = features(spark, sf_dir).filter("ftype = 'rbcorr'")
    return rows.select("ch1", "ch2").union(rows.select(F.col("ch2").alias("ch1"), F.col("ch1").alias("ch2"))).distinct()


@query(f"WITH {_PARSED} SELECT a.feat FROM pf a WHERE a.ftype = 'bpcorr' EXCEPT SELECT feat FROM pf WHERE fb1 = 'beta'")
def u4_feature_set_difference(spark, sf_dir):
    rows = features(spark, sf_dir)
    return rows.filter("ftype = 'bpcorr'").select("feat").subtract(rows.filter("fb1 = 'beta'").select("feat"))


@query(f"WITH {_PARSED} SELECT ch1 ch, CASE WHEN ch1 LIKE 'LFP%' THEN 'LFP' ELSE 'msrc' END modality, count(*) n, count(*) < 10 AS bad FROM pf GROUP BY ALL")
def p25_channel_tuples(spark, sf_dir):
    rows = features(spark, sf_dir).groupBy(F.col("ch1").alias("ch")).agg(F.count("*").alias("n"))
    return rows.select("ch", N.modality(F.col("ch")).alias("modality"), "n", (F.col("n") < 10).alias("bad"))


@query(f"WITH {_PARSED}, w(ch) AS (SELECT DISTINCT ch1 FROM pf WHERE ch1 LIKE 'LFPR%') SELECT feat FROM pf WHERE ch1 NOT LIKE 'LFP%' OR ch1 IN (SELECT ch FROM w)")
def p23_channel_whitelist(spark, sf_dir):
    rows = features(spark, sf_dir)
    liked = rows.filter("ch1 LIKE 'LFPR%'").select("ch1").distinct()
    return rows.filter("mod1 = 'LFP'").join(liked, "ch1", "left_semi").select("feat").unionByName(rows.filter("mod1 <> 'LFP'").select("feat"))
