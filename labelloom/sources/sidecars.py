"""Persisted few-shot example sets, one JSON file per setting, named after it."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.text import sidecar_name

log = logging.getLogger(__name__)

EXAMPLE = T.StructType([
    T.StructField("train_idx", T.LongType()),
    T.StructField("label_idx", T.IntegerType()),
    T.StructField("label_name", T.StringType()),
    T.StructField("summary", T.StringType()),
])

# Fixed value: how a file name holds its setting. The corpus part is ours.
NAME = r"([^/]+?)__([^_/]+)__frac([0-9.]+)__n(\d+)__seed(\d+)(?:__corpus[0-9a-f]+)?\.json"
_IN_PATH = rf"(?:^|/){NAME}(?:/|$)"


def sidecar_file(spark: SparkSession, *, model_tag: str, prompt_version: str, fraction: float, n: int, seed: int,
                 corpus: str = "") -> str:
    """The file name of a setting; ``corpus`` is the fingerprint of the example documents."""
    one = spark.range(1).select(sidecar_name(F.lit(model_tag), F.lit(prompt_version), F.lit(float(fraction)),
                                             F.lit(n), F.lit(seed)).alias("name"))
    name = one.first()["name"]
    return name[: -len(".json")] + f"__corpus{corpus}.json" if corpus else name


def parse_sidecars(files: DataFrame) -> DataFrame:
    """Settings out of the names of ``path, value``; files named otherwise are skipped."""
    def part(i, kind):
        return F.regexp_extract("path", _IN_PATH, i).cast(kind)
    named = files.where(F.col("path").rlike(_IN_PATH))
    return named.select(
        "path", part(1, "string").alias("model_tag"), part(2, "string").alias("prompt_version"),
        part(3, "double").alias("fraction"), part(4, "int").alias("n_per_category"), part(5, "int").alias("seed"),
        F.coalesce(F.json_array_length("value"), F.lit(0)).alias("n_examples"), "value")


def scan_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    try:
        files = spark.read.text(f"{folder}/*.json", wholetext=True)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "value STRING").withColumn("path", F.lit(""))
        return parse_sidecars(files)
    return parse_sidecars(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def choose_sidecar(sidecars: DataFrame, fraction: float, n: int, seed: int) -> DataFrame:
    """The first sidecar (by path) of a setting, one row; an error when there is none."""
    match = sidecars.where((F.col("fraction") == fraction) & (F.col("n_per_category") == n) & (F.col("seed") == seed))
    found = match.orderBy("path").select("path", "model_tag").limit(2).collect()
    if not found:
        raise KeyError(f"no sidecar for fraction={fraction} n={n} seed={seed}")
    if len(found) > 1:
        log.warning("several sidecars match; using the first (%s)", found[0]["model_tag"])
    return match.where(F.col("path") == found[0]["path"])


def sidecar_examples(sidecar: DataFrame) -> DataFrame:
    return sidecar.select(F.inline(F.from_json("value", T.ArrayType(EXAMPLE), {"mode": "FAILFAST"})))


def load_sidecar(spark: SparkSession, folder: str, fraction: float, n: int, seed: int) -> DataFrame:
    return sidecar_examples(choose_sidecar(scan_sidecars(spark, folder), fraction, n, seed))


def write_sidecar(examples: DataFrame, path: str) -> None:
    """One JSON array. The set is bounded: it is made to fit into a prompt."""
    ordered = F.sort_array(F.collect_list(F.struct("label_idx", "train_idx", "label_name", "summary")))
    rows = F.transform(ordered, lambda e: F.struct(*[e[c].alias(c) for c in EXAMPLE.names]))
    examples.agg(F.to_json(rows).alias("value")).write.mode("overwrite").text(path)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame | None:
    """The examples of one file, or None when it was not written."""
    try:
        return sidecar_examples(spark.read.text(path, wholetext=True))
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
