"""Scoring documents as they arrive: the incremental evaluation as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labelloom.sources.store import append_batch, read_store


def read_arrivals(spark, folder: str, schema: T.StructType, *, glob: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """A stream of the files that appear in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def _started(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a stream with this checkpoint has begun a batch."""
    try:
        spark.read.format("binaryFile").load(f"{checkpoint}/offsets")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def score_arrivals(arrivals: DataFrame, score: Callable[[DataFrame], DataFrame], *, store_path: str, checkpoint: str,
                   store_schema: T.StructType, store_key: str = "test_idx", fmt: str = "json") -> StreamingQuery:
    """Append ``score(batch)`` for documents not yet in the store; repeated ids are ignored.

    The ids seen are the stream's state, kept by key in its state store, so the
    cost of a batch does not grow with the store, which no batch reads. What the
    store holds when a stream first starts is written out once, as ids, and
    enters the state as a second source; a restart finds state and offsets in
    the checkpoint. Set the RocksDB state store for states beyond memory.

    A batch that runs again after a failure writes the same folder again.
    Of rows that repeat an id within a batch, one is scored; all rows of a null
    id count as one document.
    """
    spark = arrivals.sparkSession
    seen = f"{checkpoint.rstrip('/')}-seen"
    kind = arrivals.schema["doc_id"].dataType
    if not _started(spark, checkpoint):
        ids = read_store(spark, store_path, store_schema, fmt).select(F.col(store_key).cast(kind).alias("doc_id"))
        ids.distinct().write.mode("overwrite").parquet(seen)
    schema = T.StructType([T.StructField("doc_id", kind)])
    known = spark.readStream.schema(schema).parquet(seen).withColumn("_known", F.lit(True))
    both = arrivals.withColumn("_known", F.lit(False)).unionByName(known, allowMissingColumns=True)

    def add(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.where(~F.col("_known")).drop("_known")
        if batch_id == 0:  # the known ids come with this batch, in no order
            fresh = fresh.join(batch.sparkSession.read.schema(schema).parquet(seen), "doc_id", "left_anti")
        append_batch(score(fresh), store_path, f"{stream}-{batch_id}", fmt)

    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    return (both.dropDuplicates(["doc_id"]).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
