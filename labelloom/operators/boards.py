"""Comparison of runs: families, leaderboards, pivots, data-efficiency curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

# The kinds of a run. "nested_cv" is the older name of "vector_cv".
VECTOR_KINDS = ("nested_cv", "vector_cv")
PROMPTED_KINDS = ("llm_few_shot", "llm_zero_shot")


def is_vector() -> Column:
    return F.col("kind").isin(*VECTOR_KINDS)


def is_prompted() -> Column:
    return F.col("kind").isin(*PROMPTED_KINDS)


def run_name(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def prompted_run_name(model: Column, prompts: Column, n: Column, fraction: Column, data: Column) -> Column:
    return F.concat_ws("_", model, prompts, F.concat(F.lit("n"), n.cast("string")),
                       F.concat(F.lit("summary"), fraction.cast("double").cast("string")), data)


def vector_run_name(model: Column, featurizer: Column, data: Column, n: Column) -> Column:
    return F.concat_ws("_", model, featurizer, data, F.concat(F.lit("n"), F.coalesce(n.cast("string"), F.lit("None"))))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("None"))


def vector_variant() -> Column:
    return F.concat(_text("model"), F.lit("+"), _text("featurizer"))


def curve_variant() -> Column:
    share = F.coalesce(F.format_string("%.2f", "summary_fraction"), F.lit("NA"))
    share = F.when(F.col("summary_fraction").isNull(), F.lit("NA")).otherwise(share)
    return F.when(is_vector(), vector_variant()).otherwise(F.concat(_text("model"), F.lit(" / summary="), share))


def with_family(runs: DataFrame) -> DataFrame:
    """Add ``family, variant, samples_per_category``."""
    family = F.when(is_vector(), "vector").when(is_prompted(), "llm").otherwise("other")
    prompted = F.concat(_text("model"), F.lit("|"), F.coalesce("prompts", F.lit("")))
    given = F.col("n_per_category").cast("double")
    shared = F.try_divide(F.col("n_train").cast("double"), F.col("n_classes").cast("double"))
    samples = F.when(is_vector(), F.coalesce(given, shared)).when(is_prompted(), given)
    return runs.select("*", family.alias("family"), F.when(is_vector(), vector_variant()).otherwise(prompted).alias("variant"),
                       samples.alias("samples_per_category"))


def numbered(board: DataFrame, *order: Column) -> DataFrame:
    """Add ``place``, counted from 0, in board order. A board has one row per run."""
    return board.withColumn("place", (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))


def leaderboard(runs: DataFrame) -> DataFrame:
    cols = ["run", "kind", "model", "featurizer", "cv_f1_macro_mean", "cv_f1_macro_std", "test_f1_macro", "test_accuracy"]
    return runs.select(*cols).orderBy(F.desc_nulls_last("test_f1_macro"), "run")


def vector_board(runs: DataFrame) -> DataFrame:
    cols = ["variant", "model", "featurizer", "n_per_category", "n_train", "samples_per_category", "test_f1_macro",
            "test_accuracy", "test_f1_weighted", "run"]
    board = runs.where(is_vector()).withColumn("samples_per_category", F.round("samples_per_category", 1)).select(*cols)
    return numbered(board, F.col("variant"), F.asc_nulls_last("samples_per_category"), F.col("run"))


def prompted_board(runs: DataFrame) -> DataFrame:
    cols = ["model", "llm_tag", "prompts", "n_per_category", "summary_fraction", "test_f1_macro", "test_accuracy",
            "test_f1_weighted", "n_test", "run"]
    board = runs.where(is_prompted()).select(*cols)
    return numbered(board, F.asc_nulls_last("model"), F.asc_nulls_last("n_per_category"), F.col("run"))


def best_score(runs: DataFrame) -> DataFrame:
    """One row: the best held-out macro F1 of the vector runs."""
    return runs.where(is_vector()).agg(F.max("test_f1_macro").alias("best_f1_macro"))


def fraction_sweep(runs: DataFrame) -> DataFrame:
    """Zero-shot runs by tag and fraction, each next to the best vector score."""
    cols = ["run", "llm_tag", "summary_fraction", "mean_summary_words", "test_f1_macro", "test_accuracy", "n_unparseable",
            "llm_elapsed_s"]
    sweep = runs.where(F.col("kind") == "llm_zero_shot").select(*cols, best_score(runs).scalar().alias("baseline_f1_macro"))
    return sweep.orderBy("llm_tag", "summary_fraction", "run")


def score_pivot(runs: DataFrame, featurizers: list[str] | None = None) -> DataFrame:
    """Model by featurizer, best macro F1. Naming the featurizers saves the pass that looks for them."""
    return runs.groupBy("model").pivot("featurizer", featurizers).agg(F.max("test_f1_macro")).orderBy("model")


def curve_points(runs: DataFrame) -> DataFrame:
    """Points of the data-efficiency curves: both coordinates present, x above 0; single-point variants flagged."""
    pts = runs.where(F.col("samples_per_category").isNotNull() & F.col("test_f1_macro").isNotNull()
                     & (F.col("samples_per_category") > 0)).withColumn("variant", curve_variant())
    n = F.count("*").over(W.partitionBy("variant"))
    return pts.withColumn("has_curve", n > 1)
