"""Labelled corpora: reading, subsetting, the label dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from labelloom.functions.cleaning import strip_parts
from labelloom.session import small_table


def load_corpus(spark: SparkSession, path: str, *, doc_id: str = "doc_id", text: str = "text",
                label: str = "label", subset: tuple[str, str] | None = None,
                categories: list[str] | None = None, remove: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, label_name`` from a Parquet corpus.

    ``subset`` is a (column, value) pair, value "all" meaning no filter.
    Both filters are plain predicates and reach the scan.
    """
    df = spark.read.parquet(path)
    if subset and subset[1] != "all":
        df = df.where(F.col(subset[0]) == subset[1])
    if categories is not None:
        df = df.where(F.col(label).isin(list(categories)))
    body = strip_parts(F.col(text), remove) if remove else F.col(text)
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"),
                     F.col(label).alias("label_name"))


def label_dictionary(corpus: DataFrame, label: str = "label_name") -> DataFrame:
    """``label_idx, label_name`` in alphabetical order.

    The window runs over one row per class, after the distinct.
    """
    names = corpus.select(F.col(label).alias("label_name")).where(F.col(label).isNotNull()).distinct()
    index = (F.row_number().over(W.orderBy("label_name")) - 1).cast("int")
    return small_table(names.select(index.alias("label_idx"), "label_name"))


def with_label_index(df: DataFrame, labels: DataFrame, name: str = "label_name",
                     idx: str = "label_idx", how: str = "inner") -> DataFrame:
    """Add the class index of a name column."""
    dim = labels.select(F.col("label_name").alias(name), F.col("label_idx").alias(idx))
    return df.join(dim, name, how)


def with_label_name(df: DataFrame, labels: DataFrame, idx: str = "label_idx",
                    name: str = "label_name", how: str = "inner") -> DataFrame:
    """Add the class name of an index column."""
    dim = labels.select(F.col("label_idx").alias(idx), F.col("label_name").alias(name))
    return df.join(dim, idx, how)


def multi_label(df: DataFrame, *labels: Column | str) -> DataFrame:
    """``doc_id, text, labels`` where a document carries several labels at once."""
    cols = [F.col(c) if isinstance(c, str) else c for c in labels]
    return df.select("doc_id", "text", F.array(*cols).alias("labels"))
