"""Reading and writing prepared recordings, statistics, features and results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "rec string, ch string, bin long, v double"
ANNOTATIONS = "rec string, onset double, duration double, label string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of setCheckpointDir, else spark.checkpoint.dir.

    Without either, a session whose executors are threads of the driver uses the machine's temporary
    folder; any other raises, as its executors could not see each other's files.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which goes with the application at the latest."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to a new path of the shared folder and read again: computed once however often it is read, and durable."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_prepared(df: DataFrame, path: str, by: tuple[str, ...] = ("rec",), mode: str = "overwrite") -> None:
    """Parquet partitioned by recording: later reads of a few recordings see only their files.

    Rows are clustered by the partition columns first (AQE splits large ones), so that a task does not
    open a file for every recording.
    """
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def read_prepared(spark: SparkSession, path: str, recordings: list[str] | None = None, channels: list[str] | None = None, bins: tuple[int, int] | None = None) -> DataFrame:
    """Recordings prune partitions; channels and a range of bins are pushed into the scan."""
    df = spark.read.parquet(path)
    if recordings is not None:
        df = df.filter(F.col("rec").isin(recordings))
    if channels is not None:
        df = df.filter(F.col("ch").isin(channels))
    return df.filter(F.col("bin").between(*bins)) if bins is not None else df


def read_annotations(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """rec, label, s, e, suffix from CSV files named <rec><suffix>.csv; the suffix tells the category."""
    df = spark.read.csv(path, schema="onset double, duration double, label string", header=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    df = df.withColumn("name", name)
    found = F.coalesce(*[F.when(F.endswith("name", F.lit(x)), F.lit(x)) for x in sorted(suffixes, key=len, reverse=True)])
    rows = df.withColumn("suffix", found).filter("suffix is not null")
    return rows.select(F.expr("left(name, length(name) - length(suffix))").alias("rec"), "label", F.col("onset").alias("s"), (F.col("onset") + F.col("duration")).alias("e"), "suffix")


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """Marks of the hand-marked JSON files below `path`; see :func:`flatten_marks`."""
    return flatten_marks(spark.read.text(path, wholetext=True))


def flatten_marks(texts: DataFrame, column: str = "value") -> DataFrame:
    """rec, type, s, e from JSON texts: subject -> medcond -> task -> type -> intervals, which may be nested once more.

    Intervals within a microsecond of each other count once.
    """
    nested = "map<string,map<string,map<string,map<string,string>>>>"
    raw = texts.select(F.from_json(column, nested).alias("m"))
    rows = raw.select(F.explode("m").alias("subject", "m")).select("subject", F.explode("m").alias("medcond", "m"))
    rows = rows.select("subject", "medcond", F.explode("m").alias("task", "m")).select(F.concat_ws("_", "subject", "medcond", "task").alias("rec"), F.explode("m").alias("type", "text"))
    flat = F.coalesce(F.from_json("text", "array<array<double>>"), F.flatten(F.from_json("text", "array<array<array<double>>>")))
    pairs = rows.select("rec", "type", F.explode(flat).alias("p")).filter(F.size("p") == 2)
    out = pairs.select("rec", "type", F.col("p")[0].alias("s"), F.col("p")[1].alias("e"))
    return out.withColumn("__s", F.round("s", 6)).withColumn("__e", F.round("e", 6)).dropDuplicates(["rec", "type", "__s", "__e"]).drop("__s", "__e")


def opposite(side: F.Column) -> F.Column:
    return F.when(side == "L", "R").when(side == "R", "L")


def to_annotations(marks: DataFrame, main_side: DataFrame, renames: dict[str, str], sides: tuple[str, ...] = ("main",), other: dict[str, str] | None = None) -> DataFrame:
    """Marks of types <type> as labels <renamed>_<side>; unknown types go, and so do recordings without a main side.

    sides: "main" takes the types of `renames` for the main side of the recording, "other" those of
    `other` (by default the same types) for the opposite side.
    """
    out = None
    for which in sides:
        names = renames if which == "main" else (other or renames)
        kinds = marks.withColumn("kind", spark_map(names)[F.col("type")]).filter("kind is not null").join(main_side, "rec")
        side = F.col("side") if which == "main" else opposite(F.col("side"))
        part = kinds.select("rec", F.concat_ws("_", "kind", side).alias("label"), "s", "e")
        out = part if out is None else out.unionByName(part)
    return out


def artifact_annotations(artifacts: DataFrame, main_side: DataFrame, sides: str = "both") -> DataFrame:
    """rec, label BAD_<ch>, s, e of artifacts (rec, ch, s, e) on channels of the main side, the other, or both."""
    rows = artifacts.withColumn("__ch", F.regexp_extract("ch", r"^(?:LFP|msrc)([LR])", 1)).join(main_side, "rec")
    wanted = {"main": F.col("__ch") == F.col("side"), "other": F.col("__ch") == opposite(F.col("side")), "both": F.col("__ch") != ""}[sides]
    return rows.filter(wanted).select("rec", F.concat(F.lit("BAD_"), "ch").alias("label"), "s", "e")


def bad_channels(texts: DataFrame, column: str = "value") -> DataFrame:
    """rec, ch from JSON texts of subjects: subject -> {"bad_channels": medcond -> task -> [channel]}."""
    nested = "map<string,struct<bad_channels:map<string,map<string,array<string>>>>>"
    rows = texts.select(F.explode(F.from_json(column, nested)).alias("subject", "m")).select("subject", F.explode("m.bad_channels").alias("medcond", "m"))
    rows = rows.select("subject", "medcond", F.explode("m").alias("task", "chans"))
    return rows.select(F.concat_ws("_", "subject", "medcond", "task").alias("rec"), F.explode("chans").alias("ch")).distinct()


def spark_map(values: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def without_bad_channels(samples: DataFrame, bad: DataFrame) -> DataFrame:
    """Samples but those of the (rec, ch) listed as bad."""
    return samples.join(bad.select("rec", "ch").distinct(), ["rec", "ch"], "left_anti")


def light(results: DataFrame, heavy: list[str]) -> DataFrame:
    """Results without their bulky columns."""
    return results.drop(*heavy)


def export(df: DataFrame, path: str, form: str = "csv") -> None:
    """Tables for other programs: csv (gzip, with a header), json (gzip) or parquet."""
    writer = df.write.mode("overwrite")
    if form != "parquet":
        writer = writer.option("header", True).option("compression", "gzip")
    writer.format(form).save(path)


def write_features(feats: DataFrame, path: str) -> None:
    """rec, bin, feat, value as a table partitioned by recording, with names in a table of their own."""
    names = feats.select("feat").distinct().withColumn("feat_id", F.xxhash64("feat"))
    names.write.mode("overwrite").parquet(f"{path}/feat_dim")
    write_prepared(feats.select("rec", "bin", F.xxhash64("feat").alias("feat_id"), "value"), f"{path}/feats")


def read_features(spark: SparkSession, path: str, pattern: str = ".*", recordings: list[str] | None = None) -> DataFrame:
    """rec, bin, feat, value of the features whose names match; the small table of names chooses rows of the large one."""
    names = spark.read.parquet(f"{path}/feat_dim").filter(F.col("feat").rlike(pattern))
    feats = spark.read.parquet(f"{path}/feats")
    if recordings is not None:
        feats = feats.filter(F.col("rec").isin(recordings))
    return feats.join(names, "feat_id").select("rec", "bin", "feat", "value")


def newest_results(results: DataFrame, keys: list[str], newer: list[str], name: str, pattern: str) -> DataFrame:
    """The newest row of each key among results whose name matches a pattern; one aggregate, no sort of all rows."""
    rest = [c for c in results.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*newer)).alias("__last")
    return results.filter(F.col(name).rlike(pattern)).groupBy(*keys).agg(last).select(*keys, "__last.*")


def recent_files(spark: SparkSession, path: str, hours: float, pattern: str = "*") -> DataFrame:
    """path, modified of files not older than `hours` (names only: no content is read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime")
    return files.filter(F.col("modificationTime") >= F.current_timestamp() - F.make_interval(secs=F.lit(hours * 3600))).withColumnRenamed("modificationTime", "modified")
