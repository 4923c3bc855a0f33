"""Content-keyed caches of summaries and embeddings, as bucketed Parquet tables.

A cache folder holds one table for what a run fixes (model and prompt version,
or encoder), so a lookup reads no other model's rows, and of its own only the
key column when testing for hits. Tables are bucketed by key: a lookup shuffles
the narrow keys to the buckets, and cached texts or vectors are neither shuffled
nor sorted. The bucket count is fixed when a folder is first written; choose it
so that the keys looked up in one bucket fit into a task's memory.

A run appends only keys that it did not find, so keys are unique as long as no
two runs of one model write to a cache at the same time.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32

SUMMARY = T.StructType([
    T.StructField("cache_key", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("doc_sha1", T.StringType()),
    T.StructField("target_words", T.IntegerType()),
    T.StructField("source_words", T.IntegerType()),
    T.StructField("fraction", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("model_tag", T.StringType()),
    T.StructField("prompt_version", T.StringType()),
])

EMBEDDING = T.StructType([
    T.StructField("cache_key", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("passage_prefix", T.StringType()),
    T.StructField("normalize_embeddings", T.BooleanType()),
    T.StructField("model_id", T.StringType()),
])


def bucketed_table(spark: SparkSession, path: str, schema: T.StructType, *parts: str, buckets: int | None = None) -> str:
    """Name of the table for ``parts`` below a cache folder, entered in this session's catalog where it is not.

    The name carries the place and the bucket count; the folder remembers the
    bucket count that it was first written with.
    """
    place = f"{path.rstrip('/')}/{hashlib.sha1(chr(1).join(parts).encode()).hexdigest()[:16]}"
    try:
        buckets = spark.read.text(f"{place}-buckets").first()[0]
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        buckets = buckets or BUCKETS
        spark.range(1).selectExpr(f"'{int(buckets)}'").write.text(f"{place}-buckets")
    name = f"labelloom_cache_{hashlib.sha1(place.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        quoted = place.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cache_key) INTO {int(buckets)} BUCKETS LOCATION '{quoted}'")
    return name


def _append(rows: DataFrame, name: str) -> None:
    spark = rows.sparkSession
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])
    # One file for a bucket and append.
    rows.select(*spark.table(name).columns).repartition(buckets, "cache_key").write.insertInto(name)


def read_summaries(spark: SparkSession, path: str, model_tag: str, prompt_version: str) -> DataFrame:
    return spark.table(bucketed_table(spark, path, SUMMARY, model_tag, prompt_version))


def append_summaries(rows: DataFrame, path: str, *parts: str) -> None:
    """Add rows, all of one model and prompt version; ``parts`` names these two where the rows are not to be asked for them."""
    one = parts or rows.select("model_tag", "prompt_version").first()
    if one is not None:
        _append(rows, bucketed_table(rows.sparkSession, path, SUMMARY, *one))


def read_embeddings(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    return spark.table(bucketed_table(spark, path, EMBEDDING, model_id))


def append_embeddings(rows: DataFrame, path: str) -> None:
    """Add rows, all of one encoder."""
    one = rows.select("model_id").first()
    if one is not None:
        _append(rows, bucketed_table(rows.sparkSession, path, EMBEDDING, *one))


def lookup(keys: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """``cache_key`` and the cached ``column`` for the distinct keys that are there.

    The keys are hashed in memory, bucket by bucket, and the cache streams past them.
    """
    return known.select("cache_key", column).join(keys.select("cache_key").hint("shuffle_hash"), "cache_key")


def embedding_info(vectors: DataFrame) -> DataFrame:
    """One row: documents, dimension, and how many came from the cache."""
    return vectors.agg(F.count("*").alias("n_docs"), F.max(F.size("embedding")).alias("dim"),
                       F.count_if("cache_hit").alias("n_hits"))
