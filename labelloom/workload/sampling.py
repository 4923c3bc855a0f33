"""Splits, picks, folds, samples, and the row predicates around them."""

from pyspark.sql import functions as F

from labelloom.functions.text import doc_digest
from labelloom.operators import evaluation as E
from labelloom.operators import sampling as S
from labelloom.sources.corpus import with_label_index
from labelloom.workload.base import SQL_PREDS, SQL_SOURCE_DIM, corpus, lang_labels, predictions, query, source_labels, table


def sql_split(label, seed=42, test_size=0.2, name="split_docs"):
    """CTEs that add the split to every document, by sorting each class."""
    return f"""sizes AS (SELECT {label} AS label_name, count(*) AS n_c FROM documents GROUP BY 1),
shared AS (SELECT label_name, n_c, CAST(ceil(CAST({test_size} AS DOUBLE) * sum(n_c) OVER ()) AS BIGINT) AS total,
  CAST(sum(n_c) OVER () AS BIGINT) AS n FROM sizes),
placed AS (SELECT label_name, total * n_c // n AS base, total,
  row_number() OVER (ORDER BY total * n_c % n DESC, label_name) AS place FROM shared),
quotas AS (SELECT label_name, base + CASE WHEN place <= total - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM placed),
{name} AS (SELECT d.doc_id, d.text, d.{label} AS label_name, CASE WHEN row_number() OVER (
    PARTITION BY d.{label} ORDER BY md5(concat('{seed}|', d.{label}, '|', d.doc_id)), d.doc_id) <= q.quota
  THEN 'test' ELSE 'train' END AS split FROM documents d JOIN quotas q ON q.label_name = d.{label})"""


def sql_rank(src, seed=42, label="label_name", by="label_name"):
    return f"row_number() OVER (PARTITION BY {by} ORDER BY md5(concat('{seed}|', {label}, '|', doc_id)), doc_id)"


@query("w01_stratified_split", f"WITH {sql_split('lang')} SELECT doc_id, label_name, split FROM split_docs")
def w01(spark, sf):
    return S.stratified_split(corpus(spark, sf, "lang")).select("doc_id", "label_name", "split")


@query("w01_split_even_classes", f"WITH {sql_split('source', 7, 0.33)} SELECT doc_id, label_name, split FROM split_docs")
def w01_even(spark, sf):
    return S.stratified_split(corpus(spark, sf), test_size=0.33, seed=7).select("doc_id", "label_name", "split")


@query("w01_split_counts", f"""
WITH {sql_split('lang')} SELECT label_name, split, count(*) AS n FROM split_docs GROUP BY ALL""")
def w01_counts(spark, sf):
    return S.stratified_split(corpus(spark, sf, "lang")).groupBy("label_name", "split").agg(F.count("*").alias("n"))


@query("w02_pick_per_class", f"""
WITH {sql_split('source')}, r AS (SELECT doc_id, label_name, {sql_rank('split_docs')} AS rn FROM split_docs WHERE split = 'train')
SELECT doc_id, label_name FROM r WHERE rn <= 4""")
def w02(spark, sf):
    train = S.stratified_split(corpus(spark, sf)).where(F.col("split") == "train")
    return S.pick_per_class(train, 4).select("doc_id", "label_name")


@query("w03_prefix_stable_pick", f"""
WITH r AS (SELECT doc_id, label_name, {sql_rank('d')} AS rn FROM (SELECT doc_id, source AS label_name FROM documents) d)
SELECT doc_id, label_name, rn <= 2 AS in_two, rn <= 5 AS in_five FROM r WHERE rn <= 5""")
def w03(spark, sf):
    d = corpus(spark, sf).select("doc_id", "label_name")
    two = S.pick_per_class(d, 2).select("doc_id", F.lit(True).alias("in_two"))
    five = S.pick_per_class(d, 5).withColumn("in_five", F.lit(True))
    return five.join(two, "doc_id", "full").select("doc_id", "label_name", F.coalesce("in_two", F.lit(False)).alias("in_two"), "in_five")


@query("w03_large_pick", f"""
WITH sizes AS (SELECT count(*) AS n FROM documents GROUP BY lang),
r AS (SELECT doc_id, label_name, {sql_rank('d')} AS rn FROM (SELECT doc_id, lang AS label_name FROM documents) d)
SELECT doc_id, label_name FROM r WHERE rn <= (SELECT (min(n) + max(n)) // 2 FROM sizes)""")
def w03_large(spark, sf):
    """By cuts, whatever n is; n lies between the smallest and the largest class."""
    d = corpus(spark, sf, "lang").select("doc_id", "label_name")
    n = S.class_sizes(d, "label_name").agg(((F.min("n_class") + F.max("n_class")) / 2).cast("int").alias("n")).first()["n"]
    return S.pick_per_class(d, n, strict=False, window_pick=0).select("doc_id", "label_name")


NULL_LABELS = "(SELECT doc_id, CASE WHEN n_chars % 5 > 0 THEN lang END AS label_name FROM documents)"


def _null_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr("CASE WHEN n_chars % 5 > 0 THEN lang END").alias("label_name"))


@query("w01_null_labels", f"""
WITH d AS {NULL_LABELS}, sizes AS (SELECT label_name, count(*) AS n_c FROM d WHERE label_name IS NOT NULL GROUP BY 1),
shared AS (SELECT label_name, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n_c) OVER ()) AS BIGINT) AS total, CAST(sum(n_c) OVER () AS BIGINT) AS n, n_c FROM sizes),
placed AS (SELECT label_name, total * n_c // n AS base, total, row_number() OVER (ORDER BY total * n_c % n DESC, label_name) AS place FROM shared),
quotas AS (SELECT label_name, base + CASE WHEN place <= total - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM placed),
ranked AS (SELECT doc_id, label_name, {sql_rank('d')} AS rn FROM d WHERE label_name IS NOT NULL),
split AS (SELECT r.doc_id, r.label_name, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM ranked r JOIN quotas q USING (label_name))
SELECT d.doc_id, d.label_name, split.split FROM d LEFT JOIN split USING (doc_id)""")
def w01_null_labels(spark, sf):
    """Rows without a label are in neither side and count for no quota."""
    return S.stratified_split(_null_labels(spark, sf)).select("doc_id", "label_name", "split")


@query("w02_null_labels", f"""
WITH d AS {NULL_LABELS}, r AS (SELECT doc_id, label_name, {sql_rank('d')} AS rn FROM d WHERE label_name IS NOT NULL)
SELECT doc_id, label_name, way FROM r, (SELECT unnest(['window', 'cut']) AS way) WHERE rn <= 60""")
def w02_null_labels(spark, sf):
    """Both ways of picking give the same rows, and none without a label."""
    d = _null_labels(spark, sf)
    window, cut = (S.pick_per_class(d, 60, strict=False, window_pick=bound).withColumn("way", F.lit(way))
                   for bound, way in ((60, "window"), (59, "cut")))
    return window.unionByName(cut).select("doc_id", "label_name", "way")


@query("w04_stratified_folds", f"""
WITH {sql_split('lang')}, t AS (SELECT doc_id, label_name FROM split_docs WHERE split = 'train')
SELECT doc_id, label_name, CAST(({sql_rank('t')} - 1) * 3 // count(*) OVER (PARTITION BY label_name) AS INTEGER) AS fold FROM t""")
def w04(spark, sf):
    train = S.stratified_split(corpus(spark, sf, "lang")).where(F.col("split") == "train")
    return S.stratified_folds(train, 3).select("doc_id", "label_name", "fold")


@query("w05_simple_sample", """
SELECT doc_id, text FROM documents ORDER BY md5(concat('0|', doc_id)), doc_id LIMIT 25""")
def w05(spark, sf):
    return S.simple_sample(corpus(spark, sf).select("doc_id", "text"), 25)


@query("w05_sample_of_class", """
SELECT doc_id, text FROM documents WHERE source = 'src3' ORDER BY md5(concat('0|', doc_id)), doc_id LIMIT 2""")
def w05_class(spark, sf):
    return S.simple_sample(corpus(spark, sf).where(F.col("label_name") == "src3").select("doc_id", "text"), 2)


@query("w06_first_per_key", """
SELECT substr(sha1(text), 1, 16) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS label_name FROM documents GROUP BY 1""")
def w06(spark, sf):
    d = corpus(spark, sf).select(doc_digest("text").alias("digest"), "doc_id", "label_name")
    return S.first_per_key(d, "digest")


@query("w08_example_order", f"""
WITH {SQL_SOURCE_DIM}, r AS (SELECT d.doc_id, s.label_idx, d.source AS label_name, row_number() OVER (
  PARTITION BY d.source ORDER BY md5(concat('42|', d.source, '|', d.doc_id)), d.doc_id) AS rn
  FROM documents d JOIN source_dim s ON s.label_name = d.source)
SELECT row_number() OVER (ORDER BY label_idx, doc_id) AS place, doc_id, label_idx FROM r WHERE rn <= 3""")
def w08(spark, sf):
    from pyspark.sql import Window as W
    picked = with_label_index(S.pick_per_class(corpus(spark, sf), 3), source_labels(spark, sf))
    # n rows per class: small enough to number as one list
    return picked.select(F.row_number().over(W.orderBy("label_idx", "doc_id")).cast("long").alias("place"), "doc_id", "label_idx")


@query("p01_rows_of_split", f"""
WITH {sql_split('lang')} SELECT doc_id, len(embedding) AS dim, e.label FROM embeddings e JOIN split_docs s ON s.doc_id = e.vec_id
WHERE split = 'train'""")
def p01(spark, sf):
    train = S.stratified_split(corpus(spark, sf, "lang")).where(F.col("split") == "train").select("doc_id")
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return vectors.join(train, "doc_id", "left_semi").select("doc_id", F.size("embedding").cast("long").alias("dim"), "label")


@query("p02_rows_of_class", f"""
WITH {SQL_SOURCE_DIM} SELECT d.doc_id, s.label_idx, s.label_name FROM documents d JOIN source_dim s ON s.label_name = d.source
WHERE s.label_idx = 7 OR s.label_name = 'src3'""")
def p02(spark, sf):
    d = with_label_index(corpus(spark, sf).select("doc_id", "label_name"), source_labels(spark, sf))
    return d.where((F.col("label_idx") == 7) | (F.col("label_name") == "src3")).select("doc_id", "label_idx", "label_name")


@query("p03_scored_rows", f"WITH {SQL_PREDS} SELECT * FROM preds WHERE pred_idx IS NOT NULL")
def p03(spark, sf):
    return E.scored(predictions(spark, sf, source_labels(spark, sf)))


@query("p04_misclassified", f"WITH {SQL_PREDS} SELECT doc_id, true_label, pred_idx FROM preds WHERE NOT (pred_idx = true_idx)")
def p04(spark, sf):
    p = predictions(spark, sf, source_labels(spark, sf))
    p = p.withColumn("correct", E.correct_flag(F.col("true_idx"), F.col("pred_idx")))
    return p.where(~F.col("correct")).select("doc_id", "true_label", "pred_idx")


@query("p05_unparseable_rows", f"WITH {SQL_PREDS} SELECT doc_id, true_label FROM preds WHERE pred_idx IS NULL")
def p05(spark, sf):
    return predictions(spark, sf, source_labels(spark, sf)).where(F.col("pred_idx").isNull()).select("doc_id", "true_label")


@query("p10_split_integrity", f"""
WITH {sql_split('source')}, r AS (SELECT doc_id, {sql_rank('split_docs')} AS rn FROM split_docs WHERE split = 'train'),
picked AS (SELECT doc_id FROM r WHERE rn <= 4)
SELECT (SELECT count(*) FROM picked WHERE doc_id NOT IN (SELECT doc_id FROM split_docs WHERE split = 'train')) AS outside_train,
  (SELECT count(*) FROM picked WHERE doc_id IN (SELECT doc_id FROM split_docs WHERE split = 'test')) AS inside_test,
  (SELECT count(*) FROM picked) AS n_picked""")
def p10(spark, sf):
    split = S.stratified_split(corpus(spark, sf))
    picked = S.pick_per_class(split.where(F.col("split") == "train"), 4)
    return S.check_split(picked, split)


@query("p11_short_classes", """
SELECT lang AS label_name, count(*) AS n_class FROM documents GROUP BY 1 HAVING count(*) < (SELECT count(*) / count(DISTINCT lang) FROM documents)""")
def p11(spark, sf):
    """Classes below the mean size."""
    d = table(spark, sf, "documents").withColumnRenamed("lang", "label_name")
    sizes = S.class_sizes(d, "label_name").agg(F.sum("n_class").alias("rows"), F.count("*").alias("classes")).first()
    return S.short_classes(d, sizes["rows"] / sizes["classes"])


@query("l04_first_rows", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50")
def l04(spark, sf):
    return S.first_rows(corpus(spark, sf).select("doc_id", "text"), 50)


@query("l06_sorted_names", "SELECT source AS label_name, row_number() OVER (ORDER BY source) - 1 AS place FROM (SELECT DISTINCT source FROM documents)")
def l06(spark, sf):
    return source_labels(spark, sf).orderBy("label_name").select("label_name", F.col("label_idx").cast("long").alias("place"))
