"""Append-only prediction store: one JSON object per line, or Parquet.

JSON lines are the interchange form. A store of billions of rows is better kept
as Parquet, where the test for documents already done reads one column.

Rows come as plain appends, or as batches: a batch has a folder of its own name,
so that writing it again replaces it and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.session import read_if_exists

PREDICTION = T.StructType([
    T.StructField("test_idx", T.LongType()),
    T.StructField("doc_sha1", T.StringType()),
    T.StructField("true_idx", T.IntegerType()),
    T.StructField("true_label", T.StringType()),
    T.StructField("pred_label", T.StringType()),
    T.StructField("pred_idx", T.IntegerType()),
    T.StructField("correct", T.BooleanType()),
    T.StructField("summary", T.StringType()),
    T.StructField("source_words", T.IntegerType()),
    T.StructField("summary_words", T.IntegerType()),
    T.StructField("fraction", T.DoubleType()),
    T.StructField("few_shot_n", T.IntegerType()),
])


def read_store(spark: SparkSession, path: str, schema: T.StructType = PREDICTION, fmt: str = "json") -> DataFrame:
    """Rows of the store; a store not yet written is empty, a malformed line fails the job."""
    options = {"recursiveFileLookup": "true"} | ({"mode": "FAILFAST"} if fmt == "json" else {})
    return read_if_exists(spark, path, schema, fmt, **options)


def append_store(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Add rows; nulls are written out, so that every line has every field."""
    _writer(rows, fmt).mode("append").save(path)


def append_batch(rows: DataFrame, path: str, batch: str, fmt: str = "json") -> None:
    """Add the rows of a batch; a batch that was written before, whole or in part, is replaced."""
    _writer(rows, fmt).mode("overwrite").save(f"{path.rstrip('/')}/batch={batch}")


def _writer(rows: DataFrame, fmt: str) -> DataFrameWriter:
    writer = rows.write.format(fmt)
    return writer.option("ignoreNullFields", "false") if fmt == "json" else writer


def list_stores(spark: SparkSession, pattern: str) -> DataFrame:
    """``store, n, modified``: every store under a glob with its rows and newest file time."""
    lines = spark.read.option("recursiveFileLookup", "true").text(pattern).where(F.trim("value") != "")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*?)(/batch=[^/]*)?/[^/]+$", 1)
    rows = lines.select(folder.alias("store"), F.col("_metadata.file_modification_time").alias("t"))
    return rows.groupBy("store").agg(F.count("*").alias("n"), F.max("t").alias("modified"))


def newest_store(stores: DataFrame) -> DataFrame:
    """One row: the most recently modified store (the last by name on a tie)."""
    return stores.agg(F.max_by("store", F.struct("modified", "store")).alias("store"))
