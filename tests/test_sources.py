import json

import pytest
from pyspark.sql import functions as F

from waveloom.sources import tables as T
from waveloom.sources.views import samples
from waveloom.streaming import windows as S


def test_prepared_round_trip_prunes(spark, tmp_path):
    rows = [(f"S{r}", c, b, float(b)) for r in range(3) for c in "ab" for b in range(10)]
    df = spark.createDataFrame(rows, T.SAMPLES)
    T.write_prepared(df, f"{tmp_path}/p")
    got = T.read_prepared(spark, f"{tmp_path}/p", ["S1"], ["a"], (2, 4))
    assert sorted(r.bin for r in got.collect()) == [2, 3, 4]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rec" in plan and "PushedFilters: [IsNotNull(ch)" in plan
    assert T.read_prepared(spark, f"{tmp_path}/p").count() == 60


def test_views_read_only_needed_columns(spark):
    plan = samples(spark, "/root/testdata/sf0.001").select("rec", "bin")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_returnflag" not in plan


def test_marks_of_any_depth(spark, tmp_path):
    marks = {"S01": {"off": {"hold": {"tremor": [[1, 2], [3.5, 4]], "no_tremor": [[[5, 6]], [[7, 8], [7.0000001, 8]]]}}}}
    (tmp_path / "m.json").write_text(json.dumps(marks))
    got = T.read_marks(spark, f"{tmp_path}/m.json")
    assert sorted((r.rec, r.type, round(r.s, 3), r.e) for r in got.collect()) == [("S01_off_hold", "no_tremor", 5, 6), ("S01_off_hold", "no_tremor", 7, 8), ("S01_off_hold", "tremor", 1, 2), ("S01_off_hold", "tremor", 3.5, 4)]
    sides = spark.createDataFrame([("S01_off_hold", "L")], "rec string, side string")
    labels = T.to_annotations(got, sides, {"tremor": "trem", "no_tremor": "notrem"})
    assert {r.label for r in labels.collect()} == {"trem_L", "notrem_L"}


def test_annotation_files(spark, tmp_path):
    (tmp_path / "S01_anns.csv").write_text("onset,duration,label\n1.0,2.0,trem_L\n")
    (tmp_path / "S01_ann_LFPartif.csv").write_text("onset,duration,label\n4.0,0.5,BAD_LFPL01\n")
    got = {r.suffix: (r.rec, r.label, r.s, r.e) for r in T.read_annotations(spark, str(tmp_path), ["_anns", "_ann_LFPartif"]).collect()}
    assert got == {"_anns": ("S01", "trem_L", 1.0, 3.0), "_ann_LFPartif": ("S01", "BAD_LFPL01", 4.0, 4.5)}


def test_bad_channels_light_and_export(spark, tmp_path):
    df = spark.createDataFrame([("S1", "a", 0, 1.0), ("S1", "b", 0, 2.0)], T.SAMPLES)
    bad = spark.createDataFrame([("S1", "b")], "rec string, ch string")
    assert [r.ch for r in T.without_bad_channels(df, bad).collect()] == ["a"]
    assert T.light(df.withColumn("model", F.lit("x" * 100)), ["model"]).columns == df.columns
    T.export(df, f"{tmp_path}/x")
    assert spark.read.csv(f"{tmp_path}/x", header=True).count() == 2
    assert T.recent_files(spark, f"{tmp_path}/x", 1.0, "*.gz").count() >= 1
    assert T.recent_files(spark, f"{tmp_path}/x", -1.0, "*.gz").count() == 0


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [("S1", "a", 1_700_000_000 + k / 8, float(k % 5)) for k in range(64)]
    df = spark.createDataFrame(rows, "rec string, ch string, t double, v double").select("rec", "ch", F.timestamp_seconds("t").alias("ts"), "v")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = S.windowed(stream, "2 seconds", "1 second").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
        got = {r.begin: (r.n, r.mean, r.activity) for r in spark.table("w").collect()}
    finally:
        query.stop()
    want = df.groupBy(F.window("ts", "2 seconds", "1 second").alias("w")).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("a"))
    assert got == {r.w.start: (r.n, pytest.approx(r.m), pytest.approx(r.a)) for r in want.collect()}
