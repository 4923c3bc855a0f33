"""Evaluation, profiles and usage totals."""

from pyspark.sql import functions as F

from labelloom.functions import text as X
from labelloom.functions.replies import request_cost
from labelloom.operators import evaluation as E
from labelloom.operators import profile as P
from labelloom.sources.corpus import multi_label
from labelloom.workload.base import (
    SQL_PREDS, lang_labels, predictions, query, source_labels, sql_word_count, table,
)

# Per-class sums of the shared predictions, and scores of them.
SQL_CLASS = SQL_PREDS + """, scored AS (SELECT * FROM preds WHERE pred_idx IS NOT NULL), sums AS (
  SELECT s.label_idx, s.label_name,
    (SELECT count(*) FROM scored p WHERE p.true_idx = s.label_idx AND p.pred_idx = s.label_idx) AS tp,
    (SELECT count(*) FROM scored p WHERE p.true_idx = s.label_idx) AS t,
    (SELECT count(*) FROM scored p WHERE p.pred_idx = s.label_idx) AS p FROM source_dim s),
scores AS (SELECT label_idx, label_name, tp, t, p,
    CASE WHEN p = 0 THEN 0.0::DOUBLE ELSE tp / p END AS precision,
    CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE tp / t END AS recall,
    CASE WHEN t + p = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (t + p) END AS f1 FROM sums)"""


def _preds(spark, sf):
    labels = source_labels(spark, sf)
    return predictions(spark, sf, labels), labels


def _r(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("a01_accuracy", f"WITH {SQL_CLASS} SELECT round(sum(tp) / sum(t), 6) AS accuracy FROM scores")
def a01(spark, sf):
    return _r(E.metrics(_preds(spark, sf)[0]).select("accuracy"), "accuracy")


@query("a02_f1_macro", f"WITH {SQL_CLASS} SELECT round(avg(f1), 6) AS f1_macro FROM scores WHERE t + p > 0")
def a02(spark, sf):
    return _r(E.metrics(_preds(spark, sf)[0]).select("f1_macro"), "f1_macro")


@query("a03_f1_weighted", f"WITH {SQL_CLASS} SELECT round(sum(f1 * t) / sum(t), 6) AS f1_weighted FROM scores")
def a03(spark, sf):
    return _r(E.metrics(_preds(spark, sf)[0]).select("f1_weighted"), "f1_weighted")


@query("a04_class_report", f"""
WITH {SQL_CLASS} SELECT label_idx, label_name, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, t AS support FROM scores""")
def a04(spark, sf):
    rep = E.class_report(*_preds(spark, sf)).drop("tp", "n_pred")
    return _r(rep, "precision", "recall", "f1")


@query("a04_class_report_present", f"""
WITH {SQL_CLASS} SELECT label_name, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, t AS support FROM scores WHERE t + p > 0""")
def a04_present(spark, sf):
    rep = E.class_report(*_preds(spark, sf), present_only=True)
    return _r(rep.select("label_name", "precision", "recall", "f1", "support"), "precision", "recall", "f1")


@query("a05_full_report", f"""
WITH {SQL_CLASS}, rows AS (
  SELECT label_name AS label, precision, recall, f1, t AS support FROM scores
  UNION ALL SELECT 'accuracy', sum(tp) / sum(t), sum(tp) / sum(t), sum(tp) / sum(t), sum(t) FROM scores
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(t) FROM scores
  UNION ALL SELECT 'weighted avg', sum(precision * t) / sum(t), sum(recall * t) / sum(t), sum(f1 * t) / sum(t), sum(t) FROM scores)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM rows""")
def a05(spark, sf):
    return _r(E.full_report(*_preds(spark, sf)), "precision", "recall", "f1")


@query("a06_confusion", f"""
WITH {SQL_PREDS} SELECT a.label_idx AS true_idx, b.label_idx AS pred_idx, count(p.doc_id) AS n
FROM source_dim a CROSS JOIN source_dim b
LEFT JOIN preds p ON p.true_idx = a.label_idx AND p.pred_idx = b.label_idx GROUP BY ALL""")
def a06(spark, sf):
    return E.confusion_matrix(*_preds(spark, sf))


@query("a07_confusion_shares", f"""
WITH {SQL_PREDS}, cm AS (SELECT a.label_idx AS true_idx, b.label_idx AS pred_idx, count(p.doc_id) AS n
  FROM source_dim a CROSS JOIN source_dim b
  LEFT JOIN preds p ON p.true_idx = a.label_idx AND p.pred_idx = b.label_idx GROUP BY ALL)
SELECT true_idx, pred_idx, round(n / nullif(sum(n) OVER (PARTITION BY true_idx), 0), 6) AS share FROM cm""")
def a07(spark, sf):
    return _r(E.row_normalized(E.confusion_matrix(*_preds(spark, sf))), "share")


@query("a08_store_totals", f"""
WITH {SQL_CLASS} SELECT (SELECT count(*) FROM preds) AS n_total, (SELECT count(*) FROM scored) AS n_scored,
  (SELECT count(*) FROM preds WHERE pred_idx IS NULL) AS n_unparseable, round(sum(tp) / sum(t), 6) AS accuracy,
  round(avg(f1) FILTER (t + p > 0), 6) AS f1_macro, round(sum(f1 * t) / sum(t), 6) AS f1_weighted FROM scores""")
def a08(spark, sf):
    return _r(E.store_metrics(_preds(spark, sf)[0]), "accuracy", "f1_macro", "f1_weighted")


@query("a08_store_nothing_scored", """
SELECT count(*) AS n_total, CAST(0 AS BIGINT) AS n_scored, count(*) AS n_unparseable, 0.0::DOUBLE AS accuracy,
  0.0::DOUBLE AS f1_macro, 0.0::DOUBLE AS f1_weighted FROM documents""")
def a08_none(spark, sf):
    return E.store_metrics(_preds(spark, sf)[0].withColumn("pred_idx", F.lit(None).cast("int")))


@query("a09_coverage", f"""
WITH {SQL_PREDS} SELECT s.label_idx AS true_idx, s.label_name AS true_label, count(p.doc_id) AS n,
  count(*) FILTER (p.pred_idx = p.true_idx) AS correct,
  count(*) FILTER (p.doc_id IS NOT NULL AND p.pred_idx IS NULL) AS unparseable,
  round(count(*) FILTER (p.pred_idx = p.true_idx) / nullif(count(p.doc_id), 0), 3) AS acc
FROM (SELECT * FROM source_dim UNION ALL SELECT CAST(count(*) AS INTEGER), '~ no document' FROM source_dim) s
LEFT JOIN preds p ON p.true_idx = s.label_idx GROUP BY ALL""")
def a09(spark, sf):
    preds, labels = _preds(spark, sf)
    # One more class, without rows, to show the fill.
    labels = labels.unionByName(labels.agg(F.count("*").cast("int").alias("label_idx"), F.lit("~ no document").alias("label_name")))
    return E.coverage(preds.withColumn("correct", E.correct_flag(F.col("true_idx"), F.col("pred_idx"))), labels)


@query("a10_mean_summary_words", f"SELECT round(avg({sql_word_count('text')}), 6) AS mean_words FROM documents")
def a10(spark, sf):
    return table(spark, sf, "documents").agg(F.round(F.avg(X.word_count("text")), 6).alias("mean_words"))


@query("a11_unparseable", f"WITH {SQL_PREDS} SELECT count(*) FILTER (pred_idx IS NULL) AS n_unparseable FROM preds")
def a11(spark, sf):
    return _preds(spark, sf)[0].agg(F.count_if(F.col("pred_idx").isNull()).alias("n_unparseable"))


@query("a12_smallest_class", "SELECT min(n) AS min_class_count FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
def a12(spark, sf):
    return E.smallest_class(table(spark, sf, "documents"), "lang")


SQL_PROFILE = """count(*) AS n_docs, count(DISTINCT {label}) AS n_labels, round(avg(n), 6) AS mean_words,
  round(quantile_cont(n, 0.5), 6) AS median_words, round(quantile_cont(n, 0.9), 6) AS p90_words, max(n) AS max_words"""


@query("a13_corpus_profile", f"""
SELECT {SQL_PROFILE.format(label="source")} FROM (SELECT source, {sql_word_count("text")} AS n FROM documents)""")
def a13(spark, sf):
    d = table(spark, sf, "documents").select("text", F.col("source").alias("label_name"))
    return _r(P.corpus_profile(d), "mean_words", "median_words", "p90_words")


@query("a14_multi_label_profile", f"""
WITH tagged AS (SELECT doc_id, {sql_word_count("text")} AS n,
  CASE WHEN doc_id % 3 = 0 THEN [lang] WHEN doc_id % 3 = 1 THEN [lang, source] ELSE [lang, source, 'all'] END AS labels FROM documents)
SELECT count(*) AS n_docs, (SELECT count(DISTINCT l) FROM (SELECT unnest(labels) AS l FROM tagged)) AS n_labels,
  round(avg(len(labels)), 6) AS mean_labels, round(quantile_cont(len(labels), 0.5), 6) AS median_labels,
  max(len(labels)) AS max_labels FROM tagged""")
def a14(spark, sf):
    d = table(spark, sf, "documents")
    labels = F.when(F.col("doc_id") % 3 == 0, F.array("lang")).when(
        F.col("doc_id") % 3 == 1, F.array("lang", "source")).otherwise(F.array("lang", "source", F.lit("all")))
    prof = P.multi_label_profile(d.select("doc_id", "text", labels.alias("labels")))
    return _r(prof, "mean_labels", "median_labels").withColumn("max_labels", F.col("max_labels").cast("long"))


@query("a15_usage_totals", """
WITH u AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS i, CAST(floor(value * 10) AS BIGINT) AS o,
  CASE WHEN event_id % 3 = 0 THEN user_id END AS cr, CASE WHEN event_id % 5 = 0 THEN 7 END AS cc FROM events)
SELECT count(*) AS n_calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
  CAST(sum(cr) AS BIGINT) AS cache_read_input_tokens, CAST(sum(cc) AS BIGINT) AS cache_creation_input_tokens,
  round(sum((coalesce(i, 0) / 1e6 * 3.0 + coalesce(o, 0) / 1e6 * 15.0 + coalesce(cr, 0) / 1e6 * 0.30) * 0.5), 6) AS total_cost_usd
FROM u""")
def a15(spark, sf):
    e = table(spark, sf, "events")
    usage = e.select(F.get_json_object("props", "$.k").cast("long").alias("input_tokens"),
                     F.floor(F.col("value") * 10).alias("output_tokens"),
                     F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("cache_read_input_tokens"),
                     F.when(F.col("event_id") % 5 == 0, F.lit(7).cast("long")).alias("cache_creation_input_tokens"))
    cost = request_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_input_tokens"), batch=True)
    return P.usage_totals(usage.withColumn("cost_usd", cost))


@query("a16_seen_values", """
SELECT array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(DISTINCT source) AS n_sources,
  array_to_string(list_sort(list(DISTINCT doc_id % 7)), ',') AS residues FROM documents""")
def a16(spark, sf):
    return P.seen_values(table(spark, sf, "documents").withColumn("residue", F.col("doc_id") % 7), "lang", "residue", n="source").select(
        F.array_join("lang", ",").alias("langs"), F.col("n_source").alias("n_sources"),
        F.array_join(F.transform("residue", lambda x: x.cast("string")), ",").alias("residues"))


@query("a19_cv_mean_std", f"""
WITH {SQL_PREDS}, f AS (SELECT true_idx % 4 AS candidate, doc_id % 3 AS fold,
  avg(CASE WHEN pred_idx = true_idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM preds GROUP BY ALL)
SELECT candidate, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score FROM f GROUP BY candidate""")
def a19(spark, sf):
    p = _preds(spark, sf)[0]
    hit = F.when(F.col("pred_idx") == F.col("true_idx"), 1.0).otherwise(0.0)
    folds = p.groupBy((F.col("true_idx") % 4).alias("candidate"), (F.col("doc_id") % 3).alias("fold")).agg(F.avg(hit).alias("score"))
    return _r(E.candidate_scores(folds, "score"), "mean_score", "std_score")


@query("a24_corpus_fingerprint", """
SELECT count(*) AS n_docs, substr(sha1(concat(count(*), '|',
  sum(CAST('0x' || substr(sha1(concat(doc_id, '|', text)), 1, 15) AS BIGINT)))), 1, 16) AS fingerprint FROM documents""")
def a24(spark, sf):
    return P.corpus_fingerprint(table(spark, sf, "documents"))
