"""Run records: writing one per run, scanning many, strict or lenient."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions.replies import is_strict_json

RUN_RECORD = """
run_name STRING, kind STRING, model STRING, featurizer STRING, data STRING,
n_train LONG, n_test LONG, n_per_category LONG, n_classes LONG, best_params MAP<STRING,STRING>,
cv STRUCT<n_splits: INT, scoring: STRING, best_score_mean: DOUBLE, best_score_std: DOUBLE>,
test STRUCT<accuracy: DOUBLE, f1_macro: DOUBLE, f1_weighted: DOUBLE>,
embedding STRUCT<model_id: STRING, dim: INT, cache_key: STRING, cache_hit: BOOLEAN, encode_seconds: DOUBLE, docs_per_second: DOUBLE,
  train_cache_key: STRING, test_cache_key: STRING, train_cache_hit: BOOLEAN, test_cache_hit: BOOLEAN>,
tfidf STRUCT<vocab_size: LONG, n_features: LONG>,
prompts STRUCT<name: STRING, version: STRING>,
few_shot STRUCT<n_per_category: INT, example_train_indices: ARRAY<LONG>>,
llm STRUCT<provider: STRING, tag: STRING, fraction: DOUBLE, n_unparseable: LONG, mean_summary_words: DOUBLE,
  elapsed_s: DOUBLE, usage: STRUCT<n_calls: LONG, input_tokens: LONG, output_tokens: LONG,
  cache_read_input_tokens: LONG, cache_creation_input_tokens: LONG, total_cost_usd: DOUBLE, batch_ids: ARRAY<STRING>>>,
n_total LONG, n_scored LONG, n_unparseable LONG, train_fraction DOUBLE,
nested_cv STRUCT<summary: STRUCT<f1_macro: STRUCT<mean: DOUBLE, std: DOUBLE>, accuracy: STRUCT<mean: DOUBLE>>>
"""

RUN_CONFIG = """
llm STRUCT<name: STRING, tag: STRING>, prompts STRUCT<name: STRING>, few_shot STRUCT<n_per_category: LONG>,
data STRUCT<name: STRING>, n_per_category LONG, fraction DOUBLE
"""

RECORD_FILE, CONFIG_FILE, NAMES_FILE = "metrics.json", "config.yaml", "target_names.json"


def write_json_file(row: DataFrame, path: str) -> None:
    """One row as one JSON document."""
    row.select(F.to_json(F.struct(*row.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_run(spark: SparkSession, folder: str, record: dict, *, config: dict | None = None,
              labels: DataFrame | None = None, report: DataFrame | None = None, confusion: DataFrame | None = None) -> None:
    """A run's record, and what belongs to it: config, class names, report, confusion table."""
    df = spark.createDataFrame([(json.dumps(record),)], "value STRING")
    parsed = df.select(F.from_json("value", RUN_RECORD, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    write_json_file(parsed, f"{folder}/{RECORD_FILE}")
    if config is not None:
        text = spark.createDataFrame([(json.dumps(config),)], "value STRING")
        text.coalesce(1).write.mode("overwrite").text(f"{folder}/{CONFIG_FILE}")
    if labels is not None:
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("label_idx", "label_name"))), lambda s: s["label_name"])
        labels.agg(F.to_json(ordered).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{NAMES_FILE}")
    if report is not None:
        write_report(report, f"{folder}/classification_report")
    if confusion is not None:
        write_confusion(confusion, f"{folder}/confusion_matrix")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label STRING, precision DOUBLE, recall DOUBLE, f1 DOUBLE, support LONG").parquet(path)


def write_confusion(matrix: DataFrame, path: str) -> None:
    matrix.write.mode("overwrite").parquet(path)


def read_confusion(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("true_idx INT, pred_idx INT, n LONG").parquet(path)


def read_files(spark: SparkSession, *globs: str) -> DataFrame:
    """``path, value`` of every file under the globs; a glob without files adds nothing."""
    files = spark.createDataFrame([], "path STRING, value STRING")
    for glob in globs:
        try:
            found = spark.read.text(glob, wholetext=True)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        files = files.unionByName(found.select(F.col("_metadata.file_path").alias("path"), "value"))
    return files


def _run_name(file: str) -> Column:
    return F.regexp_extract("path", rf"([^/]+)/{file.replace('.', '[.]')}(?:/|$)", 1)


def parse_runs_strict(files: DataFrame) -> DataFrame:
    """One row per ``path, value`` record, flattened; folders named ``_...`` are skipped, malformed records fail."""
    named = files.withColumn("run", _run_name(RECORD_FILE)).where((F.col("run") != "") & ~F.col("run").startswith("_"))
    text = F.when(is_strict_json("value"), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("malformed run record: "), F.col("path"))))
    r = named.select("run", "path", F.from_json(text, RUN_RECORD).alias("r"))
    return r.select(
        "run", F.coalesce("r.kind", F.lit("nested_cv")).alias("kind"), "r.model", "r.featurizer", "r.data", "r.n_train",
        "r.n_test", F.col("r.test.accuracy").alias("test_accuracy"), F.col("r.test.f1_macro").alias("test_f1_macro"),
        F.col("r.test.f1_weighted").alias("test_f1_weighted"),
        F.coalesce("r.nested_cv.summary.f1_macro.mean", "r.cv.best_score_mean").alias("cv_f1_macro_mean"),
        F.coalesce("r.nested_cv.summary.f1_macro.std", "r.cv.best_score_std").alias("cv_f1_macro_std"),
        F.col("r.nested_cv.summary.accuracy.mean").alias("cv_accuracy_mean"), "r.best_params",
        F.col("r.llm.tag").alias("llm_tag"), F.col("r.llm.fraction").alias("summary_fraction"),
        F.col("r.llm.n_unparseable").alias("n_unparseable"), F.col("r.llm.mean_summary_words").alias("mean_summary_words"),
        F.col("r.llm.elapsed_s").alias("llm_elapsed_s"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"))


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    return parse_runs_strict(read_files(spark, f"{root}/*/{RECORD_FILE}"))


def run_usage(spark: SparkSession, root: str) -> DataFrame:
    """``run`` and the usage of its model calls, for every record below a root and its stores that has any."""
    files = read_files(spark, f"{root}/*/{RECORD_FILE}").unionByName(read_files(spark, f"{root}/_stores/*/{RECORD_FILE}"))
    r = files.select(_run_name(RECORD_FILE).alias("run"), F.from_json("value", RUN_RECORD).alias("r")).where("r.llm.usage is not null")
    return r.select("run", "r.llm.usage.*")


@F.pandas_udf(T.StringType())
def yaml_to_json(text: pd.Series) -> pd.Series:
    """A YAML mapping as JSON text; anything else, or malformed YAML, as an empty object.

    JSON is read as such. Where no YAML reader is installed, a config that is
    not JSON is an error: it must not lose its settings without a word.
    """
    try:
        import yaml
    except ImportError:
        yaml = None

    def convert(value):
        try:
            data = json.loads(value)
        except (ValueError, RecursionError):
            if yaml is None:
                raise ValueError("a config is not JSON, and PyYAML is not installed") from None
            try:
                data = yaml.safe_load(value)
            except (yaml.YAMLError, RecursionError):
                return "{}"
        return json.dumps(data, default=str) if isinstance(data, dict) else "{}"
    return text.map(convert, na_action="ignore").astype(object)


def _has(value: Column, *path: str) -> Column:
    inside = F.get_json_object(value, "$." + path[0]) if len(path) > 1 else value
    return F.coalesce(F.array_contains(F.json_object_keys(inside), path[-1]), F.lit(False))


def join_config(records: DataFrame, configs: DataFrame) -> DataFrame:
    """Records with the config of the same folder, where there is one."""
    parsed = configs.select(F.regexp_extract("path", rf"^(.*)/{CONFIG_FILE.replace('.', '[.]')}(?:/.*)?$", 1).alias("folder"),
                            F.from_json(yaml_to_json("value"), RUN_CONFIG).alias("c"))
    keyed = records.withColumn("folder", F.regexp_extract("path", rf"^(.*)/{RECORD_FILE.replace('.', '[.]')}(?:/.*)?$", 1))
    return keyed.join(parsed, "folder", "left")


def parse_runs_lenient(files: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per record with config values filled in; malformed records are skipped, malformed configs empty."""
    ok = files.withColumn("run", _run_name(RECORD_FILE)).where((F.col("run") != "") & is_strict_json("value"))
    m = join_config(ok, configs).withColumn("m", F.from_json("value", RUN_RECORD))
    value = F.col("value")
    kind = F.coalesce("m.kind", F.when(_has(value, "nested_cv"), F.lit("nested_cv")).otherwise(F.lit("unknown")))

    def present_or(key: tuple[str, str], ours: str, theirs: str) -> Column:
        # A key that is there keeps its value, even null; only an absent key falls back.
        return F.when(_has(value, *key), F.col(ours)).otherwise(F.col(theirs))

    return m.select(
        "run", kind.alias("kind"), F.coalesce(F.nullif(F.col("m.model"), F.lit("")), F.col("c.llm.name")).alias("model"),
        "m.featurizer", F.coalesce(F.nullif(F.col("m.data"), F.lit("")), F.col("c.data.name")).alias("data"),
        "m.n_train", "m.n_test", "m.n_classes", "m.train_fraction",
        F.col("m.test.accuracy").alias("test_accuracy"), F.col("m.test.f1_macro").alias("test_f1_macro"),
        F.col("m.test.f1_weighted").alias("test_f1_weighted"),
        F.coalesce(F.col("m.few_shot.n_per_category").cast("long"), "c.few_shot.n_per_category", "m.n_per_category",
                   "c.n_per_category").alias("n_per_category"),
        present_or(("llm", "fraction"), "m.llm.fraction", "c.fraction").alias("summary_fraction"),
        present_or(("llm", "tag"), "m.llm.tag", "c.llm.tag").alias("llm_tag"),
        present_or(("prompts", "name"), "m.prompts.name", "c.prompts.name").alias("prompts"))


def scan_runs_lenient(spark: SparkSession, root: str, stores: str = "_stores") -> DataFrame:
    """Runs directly below the root, united with those of the prediction stores below it."""
    records = read_files(spark, f"{root}/*/{RECORD_FILE}").unionByName(read_files(spark, f"{root}/{stores}/*/{RECORD_FILE}"))
    configs = read_files(spark, f"{root}/*/{CONFIG_FILE}", f"{root}/{stores}/*/{CONFIG_FILE}")
    return parse_runs_lenient(records, configs)
