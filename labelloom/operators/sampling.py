"""Seeded, class-balanced choice of documents.

One rule serves all of them: within a class, documents are ordered by
``md5(seed|label|doc_id)``, ties by id. The order depends on nothing but the
row itself, so every pick is repeatable and prefix-stable, and a split can be
decided by comparing each row with its class's cut instead of sorting classes.

Rows without a label are in no class: they count for no quota, get a null split
and a null fold, and are never picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from labelloom.session import materialize, small_table

# Hash prefix length of a histogram bucket: 16**4 buckets per class.
BUCKET_DIGITS = 4
# Picks up to this size use a window, which Spark trims before the shuffle.
WINDOW_PICK = 1_000


def order_hash(seed: int, label: str, doc_id: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(label).cast("string"), F.lit("|"), F.col(doc_id).cast("string")))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n_class"))


def split_quota(sizes: DataFrame, label: str, test_size: float) -> DataFrame:
    """Held-out rows per class: ``ceil(test_size * n)`` shared by largest remainder.

    Runs over one row per class.
    """
    everything = W.partitionBy()
    n = F.sum("n_class").over(everything)
    total = F.ceil(F.lit(float(test_size)) * n).cast("long")
    base = F.floor(total * F.col("n_class") / n)
    rest = total * F.col("n_class") % n
    shared = sizes.select(label, "n_class", total.alias("_total"), base.alias("_base"), rest.alias("_rest"))
    short = F.col("_total") - F.sum("_base").over(everything)
    place = F.row_number().over(W.orderBy(F.desc("_rest"), label))
    return shared.select(label, "n_class", (F.col("_base") + F.when(place <= short, 1).otherwise(0)).alias("quota"))


def hash_histogram(df: DataFrame, *, label: str, doc_id: str, seed: int) -> DataFrame:
    """``label, _b, _n``: rows per class and hash prefix, at most 16**BUCKET_DIGITS counts a class."""
    prefix = F.substring(order_hash(seed, label, doc_id), 1, BUCKET_DIGITS)
    return df.where(F.col(label).isNotNull()).groupBy(label, prefix.alias("_b")).agg(F.count("*").alias("_n"))


def hash_cuts(df: DataFrame, quotas: DataFrame, *, label: str, doc_id: str, seed: int, counts: DataFrame | None = None) -> DataFrame:
    """``label, cuts``: where, in each class's hash order, the first ``quota`` rows end.

    ``quotas``: label, cut_no, quota. A class is never sorted as a whole. Rows
    are counted per (class, hash prefix); the running sum over at most
    16**BUCKET_DIGITS counts finds the buckets that hold a cut, and only those
    buckets' rows are ranked. A quota of 0 has no cut. ``counts`` may hold the
    histogram where it is known.
    """
    if counts is None:
        counts = hash_histogram(df, label=label, doc_id=doc_id, seed=seed)
    hashed = df.select(label, F.col(doc_id).alias("_id"), order_hash(seed, label, doc_id).alias("_h"))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    upto = F.sum("_n").over(W.partitionBy(label).orderBy("_b"))
    edges = (
        counts.withColumn("_upto", upto).join(quotas.select(label, "cut_no", "quota"), label)
        .where((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(label, "_b", "cut_no", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    inside = hashed.join(small_table(edges), [label, "_b"])
    rank = F.row_number().over(W.partitionBy(label, "cut_no").orderBy("_h", "_id"))
    ends = inside.withColumn("_rank", rank).where(F.col("_rank") == F.col("_need"))
    cut = F.struct("cut_no", F.col("_h").alias("hash"), F.col("_id").alias("id"))
    return small_table(ends.groupBy(label).agg(F.sort_array(F.collect_list(cut)).alias("cuts")))


def cuts_passed(df: DataFrame, cuts: DataFrame, out: str, *, label: str, doc_id: str, seed: int) -> DataFrame:
    """Add the number of cuts of its class that lie before a row (null for a class without cuts).

    The cuts are one small row per class; ``df`` is not shuffled.
    """
    placed = df.withColumn("_h", order_hash(seed, label, doc_id)).join(cuts, label, "left")
    after = F.filter("cuts", lambda c: (F.col("_h") > c["hash"]) | ((F.col("_h") == c["hash"]) & (F.col(doc_id) > c["id"])))
    n = F.when(F.col("cuts").isNotNull(), F.size(after))
    return placed.withColumn(out, n).select(*df.columns, out)


def stratified_split(df: DataFrame, *, test_size: float = 0.2, seed: int = 42, label: str = "label_name",
                     doc_id: str = "doc_id") -> DataFrame:
    """Add ``split`` ("train" / "test"), keeping class shares."""
    quota = split_quota(class_sizes(df, label), label, test_size).withColumn("cut_no", F.lit(0))
    cuts = hash_cuts(df, small_table(quota), label=label, doc_id=doc_id, seed=seed)
    placed = cuts_passed(df, cuts, "split", label=label, doc_id=doc_id, seed=seed)
    side = F.when(F.col("split") == 0, F.lit("test")).otherwise(F.lit("train"))
    return placed.withColumn("split", F.when(F.col(label).isNotNull(), side))


def fold_cuts(df: DataFrame, k: int, *, seed: int, label: str, doc_id: str) -> DataFrame:
    """Where, in each class, folds 1 to k - 1 begin."""
    sizes = class_sizes(df, label).withColumn("cut_no", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
    quota = sizes.select(label, "cut_no", F.ceil(F.col("cut_no") * F.col("n_class") / F.lit(k)).alias("quota"))
    return hash_cuts(df, small_table(quota), label=label, doc_id=doc_id, seed=seed)


def stratified_folds(df: DataFrame, k: int, *, seed: int = 42, label: str = "label_name",
                     doc_id: str = "doc_id") -> DataFrame:
    """Add ``fold``: every row in exactly one of k class-balanced folds.

    Fold f of a class holds the ranks ``r`` with ``floor((r - 1) * k / n) = f``,
    so fold sizes within a class differ by at most one.
    """
    cuts = fold_cuts(df, k, seed=seed, label=label, doc_id=doc_id)
    return cuts_passed(df, cuts, "fold", label=label, doc_id=doc_id, seed=seed)


def split_and_folds(df: DataFrame, k: int, *, test_size: float = 0.2, seed: int = 42, label: str = "label_name",
                    doc_id: str = "doc_id") -> DataFrame:
    """Add ``split``, and ``fold`` for the training rows: two passes over the corpus find all cuts.

    The held-out rows are the first of a class in the order that its folds go
    by, so a fold ends at a rank beyond the held-out ones. One histogram gives
    the class sizes and the buckets of all cuts, a second pass ranks the rows of
    those buckets. The result is that of a split followed by its folds.
    """
    counts = materialize(hash_histogram(df, label=label, doc_id=doc_id, seed=seed), "hash-histogram")
    sizes = counts.groupBy(label).agg(F.sum("_n").alias("n_class"))
    held = small_table(split_quota(sizes, label, test_size))
    each = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    beyond = F.ceil(F.col("cut_no") * (F.col("n_class") - F.col("quota")) / F.lit(k))  # none for cut 0, the held-out part's
    quotas = held.withColumn("cut_no", each).select(label, "cut_no", (F.col("quota") + beyond).alias("quota"))
    cuts = hash_cuts(df, small_table(quotas), label=label, doc_id=doc_id, seed=seed, counts=counts)
    placed = df.withColumn("_h", order_hash(seed, label, doc_id)).join(cuts, label, "left")
    passed = F.filter("cuts", lambda c: (F.col("_h") > c["hash"]) | ((F.col("_h") == c["hash"]) & (F.col(doc_id) > c["id"])))

    def has_first(some) -> Column:
        return F.exists(some, lambda c: c["cut_no"] == 0)

    is_test = F.coalesce(has_first(F.col("cuts")) & ~has_first(F.col("_passed")), F.lit(False))
    side = F.when(F.col(label).isNotNull(), F.when(is_test, F.lit("test")).otherwise(F.lit("train")))
    fold = F.when(F.col("split") == "train", F.size(F.filter("_passed", lambda c: c["cut_no"] > 0)))
    placed = placed.withColumn("_passed", passed).withColumn("split", side).withColumn("fold", fold)
    return placed.select(*df.columns, "split", "fold")


def short_classes(df: DataFrame, n: int, label: str = "label_name") -> DataFrame:
    """Classes with fewer than n rows."""
    return class_sizes(df, label).where(F.col("n_class") < n)


def pick_per_class(df: DataFrame, n: int | None, *, seed: int = 42, label: str = "label_name",
                   doc_id: str = "doc_id", strict: bool = True, window_pick: int = WINDOW_PICK) -> DataFrame:
    """The first n rows of each class in hash order; null n keeps all rows that have a label.

    Raising n only ever adds rows. With ``strict``, a class of fewer than n rows
    is an error. Picks up to ``window_pick`` are a window trimmed before the
    shuffle, larger ones go by the class's cut; the rows are the same.
    """
    df = df.where(F.col(label).isNotNull())
    if n is None:
        return df
    if n <= 0:
        raise ValueError(f"n must be positive or None, got {n}")
    if strict:
        short = short_classes(df, n, label).orderBy(label).first()
        if short is not None:
            raise ValueError(f"class {short[label]} has only {short['n_class']} rows but {n} were asked for")
    if n <= window_pick:
        rank = F.row_number().over(W.partitionBy(label).orderBy("_h", doc_id))
        ranked = df.withColumn("_h", order_hash(seed, label, doc_id)).withColumn("_rank", rank)
        return ranked.where(F.col("_rank") <= n).drop("_h", "_rank")
    quota = class_sizes(df, label).select(label, F.lit(0).alias("cut_no"), F.least("n_class", F.lit(n)).alias("quota"))
    cuts = hash_cuts(df, small_table(quota), label=label, doc_id=doc_id, seed=seed)
    placed = cuts_passed(df, cuts, "_after", label=label, doc_id=doc_id, seed=seed)
    return placed.where(F.col("_after") == 0).drop("_after")


def simple_sample(df: DataFrame, n: int, *, seed: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """n rows at random, whole set or (after a filter) one class."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col(doc_id).cast("string")))
    return df.withColumn("_h", key).orderBy("_h", doc_id).limit(n).drop("_h")


def first_per_key(df: DataFrame, key: str, doc_id: str = "doc_id") -> DataFrame:
    """One representative row per key, the one with the lowest id.

    Rows are reduced before the shuffle, sorted by key in each task: reduce to
    the keys of interest first where texts are among the columns.
    """
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), doc_id).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_rows(df: DataFrame, n: int | None, doc_id: str = "doc_id") -> DataFrame:
    """The first n documents by id; null or 0 keeps all."""
    return df.orderBy(doc_id).limit(int(n)) if n else df


def check_split(train_pick: DataFrame, corpus: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row: picked rows outside train, inside test (both should be 0), and their number."""
    sides = corpus.select(doc_id, "split")
    placed = train_pick.select(doc_id).join(sides, doc_id, "left")
    return placed.agg(
        F.count_if(~F.col("split").eqNullSafe(F.lit("train"))).alias("outside_train"),
        F.count_if(F.col("split").eqNullSafe(F.lit("test"))).alias("inside_test"),
        F.count("*").alias("n_picked"),
    )
