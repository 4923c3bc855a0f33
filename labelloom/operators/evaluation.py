"""Scores of predictions, all derived from one confusion table.

The only pass over the data is ``confusion_counts``, a hash aggregation with at
most classes-squared result rows; every metric is arithmetic on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def scored(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("pred_idx").isNotNull())


def correct_flag(true: Column, pred: Column) -> Column:
    """Three-valued: null without a prediction."""
    return pred == true


def confusion_counts(preds: DataFrame, *by: str) -> DataFrame:
    """``[by], true_idx, pred_idx, n`` for scored rows; only pairs that occur."""
    return scored(preds).groupBy(*by, "true_idx", "pred_idx").agg(F.count("*").alias("n"))


def confusion_matrix(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """All class pairs, zero-filled. Indices run from 0, so a sequence spans the columns."""
    last = labels.agg(F.max("label_idx")).scalar()
    spine = labels.select(F.col("label_idx").alias("true_idx"),
                          F.explode(F.sequence(F.lit(0), last)).alias("pred_idx"))
    counted = spine.join(confusion_counts(preds), ["true_idx", "pred_idx"], "left")
    return counted.select("true_idx", "pred_idx", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def row_normalized(matrix: DataFrame) -> DataFrame:
    """Shares of each true class; null for a class without rows."""
    total = F.sum("n").over(W.partitionBy("true_idx"))
    return matrix.select("true_idx", "pred_idx", F.try_divide(F.col("n").cast("double"), total).alias("share"))


def _zero_div(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def class_sums(counts: DataFrame, *by: str) -> DataFrame:
    """``[by], label_idx, tp, n_true, n_pred`` per class seen in truth or prediction."""
    n, hit = F.col("n"), F.when(F.col("true_idx") == F.col("pred_idx"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("true_idx").alias("label_idx"), hit.cast("long").alias("tp"), n.alias("t"), zero.alias("p")),
        F.struct(F.col("pred_idx").alias("label_idx"), zero.alias("tp"), zero.alias("t"), n.alias("p")),
    )
    flat = counts.select(*by, F.inline(sides))
    return flat.groupBy(*by, "label_idx").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_true"),
                                              F.sum("p").alias("n_pred"))


def class_scores(sums: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is 0."""
    keys = [c for c in sums.columns if c not in ("tp", "n_true", "n_pred")]
    tp, t, p = F.col("tp"), F.col("n_true"), F.col("n_pred")
    return sums.select(
        *keys, _zero_div(tp, p).alias("precision"), _zero_div(tp, t).alias("recall"),
        _zero_div(tp * 2, t + p).alias("f1"), t.alias("support"), "tp", "n_pred",
    )


def _totals(seen: Column) -> list[Column]:
    support = F.sum("support").cast("double")
    return [
        _zero_div(F.sum("tp"), support).alias("accuracy"),
        F.coalesce(F.avg(F.when(seen, F.col("f1"))), F.lit(0.0)).alias("f1_macro"),
        _zero_div(F.sum(F.col("f1") * F.col("support")), support).alias("f1_weighted"),
    ]


def metrics(preds: DataFrame, *by: str) -> DataFrame:
    """``[by], accuracy, f1_macro, f1_weighted`` over scored rows.

    Macro F1 averages the classes seen in truth or prediction.
    """
    per_class = class_scores(class_sums(confusion_counts(preds, *by), *by))
    seen = F.col("support") + F.col("n_pred") > 0
    return per_class.groupBy(*by).agg(*_totals(seen)) if by else per_class.agg(*_totals(seen))


def class_report(preds: DataFrame, labels: DataFrame, present_only: bool = False) -> DataFrame:
    """``label_name, precision, recall, f1, support`` per class.

    All classes of the dictionary, or only those seen in truth or prediction.
    """
    sums = labels.join(class_sums(confusion_counts(preds)), "label_idx", "inner" if present_only else "left")
    sums = sums.fillna(0, ["tp", "n_true", "n_pred"])
    return class_scores(sums).select("label_idx", "label_name", "precision", "recall", "f1", "support", "tp", "n_pred")


def full_report(preds: DataFrame, labels: DataFrame, present_only: bool = False) -> DataFrame:
    """The class report followed by its accuracy, macro and weighted average rows."""
    report = class_report(preds, labels, present_only)
    weight = F.sum("support").cast("double")
    total = F.sum("support").alias("support")
    rows = report.select(F.col("label_name").alias("label"), "precision", "recall", "f1", "support")
    accuracy = _zero_div(F.sum("tp"), weight)
    averages = report.agg(F.array(
        F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"), accuracy.alias("recall"),
                 accuracy.alias("f1"), total),
        F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total),
        F.struct(F.lit("weighted avg").alias("label"),
                 *[_zero_div(F.sum(F.col(c) * F.col("support")), weight).alias(c)
                   for c in ("precision", "recall", "f1")], total),
    ).alias("rows")).select(F.inline("rows"))
    return rows.unionByName(averages)


def store_metrics(store: DataFrame) -> DataFrame:
    """Counts over the whole store, metrics over its scored rows; zeros when none is scored."""
    counts = store.groupBy("true_idx", "pred_idx").agg(F.count("*").alias("n"))
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"),
        F.coalesce(F.sum(F.when(F.col("pred_idx").isNotNull(), F.col("n"))), F.lit(0)).alias("n_scored"),
    )
    per_class = class_scores(class_sums(scored(counts)))
    score = per_class.agg(F.struct(*_totals(F.col("support") + F.col("n_pred") > 0)).alias("m")).scalar()
    return totals.withColumn("m", score).select(
        "n_total", "n_scored", (F.col("n_total") - F.col("n_scored")).alias("n_unparseable"), "m.*")


def coverage(store: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, correct and unparseable per class of the dictionary; unparseable rows count against accuracy."""
    per_class = store.groupBy("true_idx").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("correct"),
        F.count_if(F.col("pred_idx").isNull()).alias("unparseable"),
    )
    spine = labels.withColumnRenamed("label_idx", "true_idx").join(per_class, "true_idx", "left")
    spine = spine.fillna(0, ["n", "correct", "unparseable"])
    acc = F.round(F.try_divide(F.col("correct").cast("double"), F.col("n").cast("double")), 3)
    return spine.select("true_idx", F.col("label_name").alias("true_label"), "n", "correct", "unparseable",
                        acc.alias("acc"))


def smallest_class(df: DataFrame, label: str = "label_name") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("min_class_count"))


SCORINGS = ("accuracy", "f1_macro", "f1_weighted")


def check_scoring(scoring: str) -> None:
    if scoring not in SCORINGS:
        raise ValueError(f"unknown scoring {scoring!r}; known: {', '.join(SCORINGS)}")


def candidate_scores(fold_scores: DataFrame, score: str = "f1_macro") -> DataFrame:
    """Mean and population deviation of each candidate over its folds."""
    return fold_scores.groupBy("candidate").agg(F.avg(score).alias("mean_score"),
                                                F.stddev_pop(score).alias("std_score"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """Highest mean, the earliest in grid order on ties (means compared at 9 places)."""
    return scores.orderBy(F.desc(F.round("mean_score", 9)), "candidate").limit(1)
