"""Equi-joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.session import small_table

# A key is hot when it holds more rows than a task handles with ease.
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """Keys of more than ``rows`` rows, with the parts of about that size that each is to be cut into."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    return small_table(counts.select(key, F.ceil(F.col("_n") / rows).cast("int").alias("_parts")))


def fan_out_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, how: str = "inner",
                 rows: int = HOT_ROWS) -> DataFrame:
    """Join many rows per key with one row per key.

    Rows of a hot key are spread over parts of about ``rows`` rows by
    ``spread_by``, and the key's single right row is repeated once for each; all
    other keys join as they are.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how}")
    hot = hot_keys(left, key, rows)
    if hot.isEmpty():
        return left.join(right, key, how)
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_parts")), F.lit(0)).cast("int")
    spread = left.join(hot, key, "left").withColumn("_salt", salt).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    repeated = right.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return spread.join(repeated, [key, "_salt"], how).drop("_salt")


def mark_cached(docs: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Add ``cache_hit``: whether the cache holds a row for the document's key."""
    known = cache.select(key).distinct().withColumn("cache_hit", F.lit(True))
    return fan_out_join(docs, known, key, "doc_id", "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))


def missing_keys(keys: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows whose key the cache does not hold. Collapse copies first, so that keys are unique here."""
    return keys.join(cache.select(key), key, "left_anti")


def new_work(selected: DataFrame, store: DataFrame, key: str = "doc_id", store_key: str = "test_idx") -> DataFrame:
    """Selected documents that the store does not hold yet."""
    return selected.join(store.select(F.col(store_key).alias(key)), key, "left_anti")


def fill_groups(counts: DataFrame, groups: DataFrame, labels: DataFrame, group: str, label: str = "label_name", n: str = "n") -> DataFrame:
    """``group``, the columns of ``labels`` and ``n``: every class of every group, 0 where nothing was counted.

    Each group row carries the whole class list, which is a dictionary of few
    rows: an array on one row, so nothing is paired by a join without keys.
    Groups may be null.
    """
    classes = labels.agg(F.collect_list(F.struct(*labels.columns)).alias("_classes")).first()["_classes"]  # one row a class
    known = F.from_json(F.lit(json.dumps([c.asDict() for c in classes])), T.ArrayType(labels.schema))
    every = groups.select(group).distinct().select(group, F.inline(known))
    counted = counts.select(F.col(group).alias("_group"), F.col(label).alias("_label"), F.col(n).alias("_n"))
    met = F.col(group).eqNullSafe(F.col("_group")) & F.col(label).eqNullSafe(F.col("_label"))
    return every.join(counted, met, "left").select(group, *labels.columns, F.coalesce("_n", F.lit(0)).cast("long").alias(n))


def compare_example_sets(left: DataFrame, right: DataFrame, labels: DataFrame) -> DataFrame:
    """Per class: both id lists, what they share, and whether left is a subset of right.

    Classes absent on a side count as empty. Inputs: ``train_idx, label_name``.
    """
    none = F.array().cast("array<bigint>")
    a = indices_by_class(left).withColumnRenamed("indices", "a")
    b = indices_by_class(right).withColumnRenamed("indices", "b")
    both = labels.join(a, "label_name", "left").join(b, "label_name", "left")
    both = both.select("label_idx", "label_name", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return both.select(
        "label_idx", "label_name", F.col("a").alias("left_indices"), F.col("b").alias("right_indices"),
        F.sort_array(F.array_intersect("a", "b")).alias("shared"),
        (F.size(F.array_except("a", "b")) == 0).alias("is_subset"),
    )


def indices_by_class(examples: DataFrame) -> DataFrame:
    """``label_name, indices``: the sorted example ids of each class (n per class)."""
    return examples.groupBy("label_name").agg(F.sort_array(F.collect_set("train_idx")).alias("indices"))
