import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators import sampling as S
from labelloom.sources.corpus import label_dictionary


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(250).select(F.col("id").alias("doc_id"), (F.xxhash64("id") % 1).cast("string").alias("x"),
                                   F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("label_name")).drop("x").cache()


@pytest.fixture(scope="module")
def skewed(spark):
    """One class with nine tenths of the rows."""
    label = F.when(F.col("id") % 10 == 0, F.concat(F.lit("rare"), (F.col("id") % 3).cast("string"))).otherwise(F.lit("hot"))
    return spark.range(3001).select(F.col("id").alias("doc_id"), label.alias("label_name")).cache()


def ids(df):
    return {r["doc_id"] for r in df.collect()}


def test_counts_per_class(labelled):
    picked = S.pick_per_class(labelled, 3)
    assert Counter(r["label_name"] for r in picked.collect()) == {f"c{i}": 3 for i in range(5)}


def test_growing_only_appends(labelled):
    small, big = ids(S.pick_per_class(labelled, 2)), ids(S.pick_per_class(labelled, 5))
    assert small < big and len(big - small) == 15


def test_deterministic_and_seeded(labelled):
    assert ids(S.pick_per_class(labelled, 4, seed=7)) == ids(S.pick_per_class(labelled.repartition(3), 4, seed=7))
    assert ids(S.pick_per_class(labelled, 4, seed=7)) != ids(S.pick_per_class(labelled, 4, seed=8))


def test_too_few_or_bad_n(labelled):
    with pytest.raises(ValueError, match="has only 50"):
        S.pick_per_class(labelled, 999)
    with pytest.raises(ValueError):
        S.pick_per_class(labelled, 0)
    assert S.pick_per_class(labelled, None).count() == 250


def test_large_picks_agree_with_the_window(skewed, monkeypatch):
    want = ids(S.pick_per_class(skewed, 40))
    monkeypatch.setattr(S, "WINDOW_PICK", 1)
    assert ids(S.pick_per_class(skewed, 40)) == want
    monkeypatch.setattr(S, "BUCKET_DIGITS", 1)
    assert ids(S.pick_per_class(skewed, 40)) == want


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_split_by_brute_force(skewed, monkeypatch, digits):
    import hashlib
    monkeypatch.setattr(S, "BUCKET_DIGITS", digits)
    rows = S.stratified_split(skewed, test_size=0.25, seed=5).collect()
    assert len(rows) == 3001
    test = Counter(r["label_name"] for r in rows if r["split"] == "test")
    sizes = Counter(r["label_name"] for r in rows)
    assert sum(test.values()) == math.ceil(0.25 * 3001)
    for label, n in sizes.items():
        assert abs(test[label] - math.ceil(0.25 * 3001) * n / 3001) < 1
        order = sorted((hashlib.md5(f"5|{label}|{r['doc_id']}".encode()).hexdigest(), r["doc_id"])
                       for r in rows if r["label_name"] == label)
        want = {i for _, i in order[: test[label]]}
        assert {r["doc_id"] for r in rows if r["label_name"] == label and r["split"] == "test"} == want


@pytest.mark.parametrize("k", [2, 3, 7])
def test_folds_are_balanced(skewed, k):
    rows = S.stratified_folds(skewed, k).collect()
    assert len(rows) == 3001 and {r["fold"] for r in rows} == set(range(k))
    per = Counter((r["label_name"], r["fold"]) for r in rows)
    for label in {r["label_name"] for r in rows}:
        counts = [per[label, f] for f in range(k)]
        assert max(counts) - min(counts) <= 1


def test_split_does_not_shuffle_the_corpus(skewed):
    plan = S.stratified_split(skewed)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_small_picks_are_trimmed_before_the_shuffle(skewed):
    plan = S.pick_per_class(skewed, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sample_first_rows_and_representatives(labelled):
    assert S.simple_sample(labelled, 10).count() == 10
    assert ids(S.simple_sample(labelled, 10)) == ids(S.simple_sample(labelled.repartition(5), 10))
    assert ids(S.first_rows(labelled, 3)) == {0, 1, 2} and S.first_rows(labelled, None).count() == 250
    assert sorted((r["label_name"], r["doc_id"]) for r in S.first_per_key(labelled, "label_name").collect()) == [
        (f"c{i}", i) for i in range(5)]


def test_check_split_finds_leaks(labelled):
    split = S.stratified_split(labelled)
    assert S.check_split(S.pick_per_class(split.where("split = 'train'"), 2), split).first()[:2] == (0, 0)
    leak = S.check_split(split.where("split = 'test'").limit(4), split).first()
    assert leak["outside_train"] == 4 and leak["inside_test"] == 4


def test_label_dictionary_is_alphabetical(labelled):
    assert [tuple(r) for r in label_dictionary(labelled).orderBy("label_idx").collect()] == [(i, f"c{i}") for i in range(5)]


def test_rows_without_a_label_are_in_no_class(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("label_name"))
    split = S.stratified_split(df).groupBy("split").agg(F.count("*").alias("n"), F.count("label_name").alias("named"))
    assert {r["split"]: (r["n"], r["named"]) for r in split.collect()} == {None: (100, 0), "train": (160, 160), "test": (40, 40)}
    assert S.stratified_folds(df, 3).where("label_name is null and fold is not null").isEmpty()
    for bound in (1000, 0):
        assert S.pick_per_class(df, 20, window_pick=bound).where("label_name is null").isEmpty()
        assert S.pick_per_class(df, 20, window_pick=bound).count() == 40
    assert S.pick_per_class(df, None).count() == 200
