"""Session settings, the shared folder, and the size-checked small table."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Dimension tables (labels, class cuts, price lists) above this many rows are
# left distributed; see small_table.
SMALL_ROWS = 10_000


def build_session(app: str = "labelloom", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and skew handling on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    That is ``spark.checkpoint.dir``, or what was given to
    ``SparkContext.setCheckpointDir``. Only where neither is set and the master
    is local (single-machine tests) is a folder of our own made, and then
    remembered for the session; on a cluster that is an error, as each executor
    would write to its own disk and later reads would miss those files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    path = spark.conf.get("labelloom.shared.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="labelloom-")
        spark.conf.set("labelloom.shared.dir", path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/labelloom/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write to the shared folder and read back.

    Cuts the lineage in a way that survives lost executors, and makes sure that
    side effects upstream (a model call) happen once.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, name: str, n: int, by: str, **options: str) -> DataFrame:
    """As above, as a table of ``n`` buckets by the hash of a column, which later joins and groupings by it need not move."""
    path = fresh_path(df.sparkSession, name)
    table = "labelloom_" + re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    df.write.options(path=path, **options).bucketBy(n, by).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


@contextmanager
def buckets_in_place(spark: SparkSession) -> Iterator[None]:
    """What is planned meanwhile joins buckets on their column and others without moving them."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType,
                   fmt: str = "parquet", **options: str) -> DataFrame:
    """Read a table that may not have been written yet; absent means empty."""
    try:
        return spark.read.schema(schema).options(**options).format(fmt).load(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Replace a small table by a local relation of the same rows.

    At most ``max_rows + 1`` rows reach the driver. Within the bound the result
    has exact statistics, so Catalyst broadcasts it by size; beyond it the input
    is returned untouched and joins with it shuffle as usual.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return df.sparkSession.createDataFrame(rows, schema=df.schema)
