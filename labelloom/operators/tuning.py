"""Cross-validated choice of a Naive Bayes candidate, and its held-out predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.bayes import Candidate, fit_in_blocks, score_in_blocks
from labelloom.operators.evaluation import best_candidate, candidate_scores, check_scoring, metrics
from labelloom.operators.tfidf import Blocks


def cross_validate_bayes(fitted: Blocks, rows: DataFrame, docs: DataFrame, vocab_size: int, candidates: list[Candidate],
                         n_folds: int) -> DataFrame:
    """``candidate, fold, accuracy, f1_macro, f1_weighted``, all candidates and folds in one job.

    ``rows``, of ``fitted.docs``, and ``docs`` are training rows that carry ``label_idx`` and ``fold``.
    """
    model = fit_in_blocks(fitted, rows.select("*", F.lit(True).alias("learn"), F.lit(True).alias("ask")), docs, vocab_size, n_folds)
    preds = score_in_blocks(model, docs, candidates).join(docs.select("doc_id", "fold", F.col("label_idx").alias("true_idx")), "doc_id")
    return metrics(preds, "candidate", "fold")


def tune_bayes(fitted: Blocks, rows: DataFrame, docs: DataFrame, vocab_size: int, candidates: list[Candidate], n_folds: int,
               scoring: str = "f1_macro"):
    """The winning candidate by ``scoring`` with its mean and deviation (one row reaches the driver)."""
    check_scoring(scoring)
    scores = candidate_scores(cross_validate_bayes(fitted, rows, docs, vocab_size, candidates, n_folds), scoring)
    best = best_candidate(scores).first()
    return candidates[best["candidate"]], best["mean_score"], best["std_score"]


def predict_bayes(fitted: Blocks, train: DataFrame, held_out: DataFrame, vocab_size: int, candidates: list[Candidate]) -> DataFrame:
    """``doc_id, candidate, true_idx, pred_idx, score`` of held-out documents by a model fitted on all training rows.

    ``fitted.docs`` carry ``label_idx``, ``split`` and ``fold``.
    """
    rows = fitted.docs.where(F.col("split").isin("train", "test")).select(
        "*", (F.col("split") == "train").alias("learn"), (F.col("split") == "test").alias("ask"))
    preds = score_in_blocks(fit_in_blocks(fitted, rows, train, vocab_size), held_out, candidates)
    return preds.join(held_out.select("doc_id", F.col("label_idx").alias("true_idx")), "doc_id")
