"""Profiles of corpora and feature spaces, usage totals, corpus fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import word_count


def _lengths(n: str, name: str, approx: bool) -> list:
    quantile = F.percentile_approx if approx else F.percentile
    return [F.avg(n).alias(f"mean_{name}"), quantile(n, F.lit(0.5)).cast("double").alias(f"median_{name}"),
            quantile(n, F.lit(0.9)).cast("double").alias(f"p90_{name}"), F.max(n).alias(f"max_{name}")]


def corpus_profile(corpus: DataFrame, approx: bool = False) -> DataFrame:
    """One row: documents, labels, and the spread of words per document.

    The exact percentile keeps one counter per distinct length, so its state
    grows with the longest document, not with the corpus.
    """
    counted = corpus.select("label_name", word_count("text").alias("_n"))
    return counted.agg(F.count("*").alias("n_docs"), F.count_distinct("label_name").alias("n_labels"),
                       *_lengths("_n", "words", approx))


def multi_label_profile(corpus: DataFrame, approx: bool = False) -> DataFrame:
    """One row: documents, distinct labels, and the spread of labels per document."""
    n_labels = corpus.select(F.explode("labels").alias("l")).agg(F.count_distinct("l")).scalar()
    mean, median, _, most = _lengths("_n", "labels", approx)
    counted = corpus.select(F.size("labels").alias("_n"))
    return counted.agg(F.count("*").alias("n_docs"), mean, median, most).select(
        "n_docs", n_labels.alias("n_labels"), "mean_labels", "median_labels", "max_labels")


def usage_totals(usage: DataFrame) -> DataFrame:
    """One row of sums over per-request usage columns and ``cost_usd``."""
    tokens = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    return usage.agg(
        F.count("*").alias("n_calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens],
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"),
    )


def seen_values(df: DataFrame, *cols: str, n: str) -> DataFrame:
    """One row: the sorted distinct values of small-domain columns, and a distinct count."""
    return df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in cols], F.count_distinct(n).alias(f"n_{n}"))


def corpus_fingerprint(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: a digest of the number of documents and every (place, text) pair.

    A sum of row digests is order-free, so the place is hashed with the text;
    swapping two texts or dropping one changes the result, and equal rows do not
    cancel as they would under xor.
    """
    digest = F.sha1(F.concat_ws("|", F.col(doc_id).cast("string"), F.col(text)))
    row = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")
    total = corpus.agg(F.count("*").alias("n"), F.sum(row).alias("s"))
    digest = F.substring(F.sha1(F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string"))), 1, 16)
    return total.select(F.col("n").alias("n_docs"), digest.alias("fingerprint"))


def vocabulary_facts(term_docs: DataFrame) -> DataFrame:
    """One row for a (doc_id, term, ...) table: vocabulary size, features, documents with a term."""
    terms = term_docs.groupBy("term").agg(F.count("*").alias("n")).agg(
        F.count("term").alias("vocab_size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"))
    docs = term_docs.groupBy("doc_id").agg(F.lit(1)).agg(F.count("doc_id").alias("n_rows"))
    return terms.join(docs).select("vocab_size", "n_rows", "n_entries")  # one row each


def vector_facts(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.agg(F.count("*").alias("n_docs"), F.max(F.size(column)).alias("dim"), F.min(F.size(column)).alias("min_dim"))
