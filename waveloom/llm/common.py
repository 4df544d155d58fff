"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a Python helper works on at once.
SLICE_CHARS = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def store(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again: cuts the lineage durably.

    Readers may be lazy, so the table goes with the application at the latest; :func:`discard` deletes it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`store`; nothing may read it afterwards."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def fold(key: str, folds: int) -> F.Column:
    """crc32 of the id written as text, modulo `folds`: the held-out rule of the label tables."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def fold_of(key: object, folds: int) -> int:
    """The same as :func:`fold`, for plain values."""
    return zlib.crc32(str(key).encode()) % folds


def without(schema: T.StructType, names: list[str]) -> list[str]:
    """Column names of `schema` that none of `names` hides (compared as Spark does, without case)."""
    hidden = {n.lower() for n in names}
    return [f.name for f in schema.fields if f.name.lower() not in hidden]


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive slices of `batch` with about `chars` characters of text; null texts are empty."""
    column_ = batch.column(column)
    sizes = pc.fill_null(pc.utf8_length(column_), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        # the texts of one slice at a time become Python strings
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + chars, side="right")))
        part = batch.slice(begin, end - begin)
        yield part, ["" if t is None else t for t in part.column(column).to_pylist()]
        begin = end


def map_texts(
    df: DataFrame,
    column: str,
    added: T.StructType,
    make: Callable[[], Callable[[list[str]], dict[str, object]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from whole texts, one Arrow batch at a time, without a shuffle.

    `make` runs once in each task and gives a function from a list of texts to a list or Arrow array
    for each field of `added`.  All columns of `df` (or those of `keep`) stay, but for those with the
    name of an added one, which it replaces.
    """
    names = [f.name for f in added.fields]
    kept = [n for n in without(df.schema, names) if keep is None or n in keep]
    out = T.StructType([df.schema[n] for n in kept] + added.fields)
    arrow = arrow_schema(added)
    alias = column if column in kept else "__text__"  # a text that stays moves once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part, texts in slices(batch, alias):
                result = work(texts)
                columns = [part.column(n) for n in kept]
                columns += [v if isinstance(v := result[f.name], pa.Array) else pa.array(v, f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    source = df.select(*[F.col(f"`{n}`") for n in kept], *([] if alias in kept else [F.col(f"`{column}`").alias(alias)]))
    return source.mapInArrow(run, out)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def sampled_texts(docs: DataFrame, labels: DataFrame, wanted: F.Column, limit: int, seed: str) -> DataFrame:
    """At most `limit` labelled documents for which `wanted` holds, in an order given by a hash.

    Only ids are sorted and broadcast (at most `limit` of them); texts don't move.
    """
    ids = (
        labels.filter(wanted)
        .select("doc_id")
        .filter(F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id")
        .limit(limit)
        .dropDuplicates(["doc_id"])
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
