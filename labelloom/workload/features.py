"""Tokens, TF-IDF, Naive Bayes."""

from pyspark.sql import functions as F

from labelloom.operators import bayes as B
from labelloom.operators import evaluation as E
from labelloom.operators import profile as P
from labelloom.operators import sampling as S
from labelloom.operators import tfidf as T
from labelloom.operators import tuning as U
from labelloom.sources.corpus import with_label_index
from labelloom.workload.base import SQL_LANG_DIM, corpus, lang_labels, query, table
from labelloom.workload.sampling import sql_rank, sql_split

SETTINGS = T.TfidfSettings()

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
SQL_TOKENS = """toks AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS all_toks FROM documents)"""
SQL_KEPT = SQL_TOKENS + f""", stops AS (SELECT unnest({_STOP}) AS w),
flat AS (SELECT doc_id, unnest(all_toks) AS tok, generate_subscripts(all_toks, 1) AS pos FROM toks),
kept AS (SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos
         FROM flat WHERE tok NOT IN (SELECT w FROM stops)),
grams AS (SELECT doc_id, tok AS term FROM kept UNION ALL
          SELECT a.doc_id, a.tok || ' ' || b.tok FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1)"""
SQL_VOCAB = SQL_KEPT + """, tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT term, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), nd WHERE df >= 2 AND df <= 0.95::DOUBLE * n)"""
SQL_WEIGHTS = SQL_VOCAB + """, raw AS (SELECT doc_id, term, (1.0::DOUBLE + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query("m01_tokens", "WITH " + SQL_TOKENS + """
SELECT doc_id, len(all_toks) AS n_tokens, md5(array_to_string(all_toks, ' ')) AS tokens_md5 FROM toks""")
def m01(spark, sf):
    d = corpus(spark, sf).select("doc_id", T.tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("m02_stop_words", "WITH " + SQL_KEPT + """
SELECT d.doc_id, count(k.tok) AS n_kept, md5(coalesce(string_agg(k.tok, ' ' ORDER BY k.pos), '')) AS kept_md5
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id""")
def m02(spark, sf):
    kept = corpus(spark, sf).select("doc_id", T.drop_stop_words(T.tokens("text"), SETTINGS.stop_words).alias("t"))
    return kept.select("doc_id", F.size("t").cast("long").alias("n_kept"), F.md5(F.array_join("t", " ")).alias("kept_md5"))


@query("m03_term_counts", "WITH " + SQL_KEPT + " SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL")
def m03(spark, sf):
    return T.term_counts(corpus(spark, sf))


@query("m04_vocabulary", "WITH " + SQL_VOCAB + " SELECT term, df, round(idf, 6) AS idf FROM vocab")
def m04(spark, sf):
    return T.fit_tfidf(corpus(spark, sf)).withColumn("idf", F.round("idf", 6))


@query("m05_tfidf", "WITH " + SQL_WEIGHTS + " SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def m05(spark, sf):
    return T.fit_transform_tfidf(corpus(spark, sf))[0].withColumn("weight", F.round("weight", 6))


@query("a20_feature_facts", "WITH " + SQL_WEIGHTS + """
SELECT count(DISTINCT term) AS vocab_size, count(DISTINCT doc_id) AS n_rows, count(*) AS n_entries FROM weights""")
def a20(spark, sf):
    return P.vocabulary_facts(T.fit_transform_in_blocks(corpus(spark, sf))[0])


@query("a20_vector_facts", """
SELECT count(*) AS n_docs, CAST(max(len(embedding)) AS INTEGER) AS dim, CAST(min(len(embedding)) AS INTEGER) AS min_dim FROM embeddings""")
def a20_vectors(spark, sf):
    return P.vector_facts(table(spark, sf, "embeddings"))


# Language classes, held-out split, folds over the training rows.
SQL_NB_DOCS = f"""{SQL_LANG_DIM}, {sql_split('lang')},
docs AS (SELECT doc_id, label_idx, split, CASE WHEN split = 'train' THEN CAST(({sql_rank('s', by='label_name, split')} - 1) * 3
    // count(*) OVER (PARTITION BY label_name, split) AS INTEGER) END AS fold
  FROM split_docs s JOIN lang_dim l USING (label_name))"""


def sql_nb(kind, alphas, norms=(False,), folds: bool | None = True):
    """Dense scoring: every class, term and candidate spelled out; held-out folds, the test part, or (None) both."""
    cands = [(a, n) for a in alphas for n in norms]
    values = ", ".join(f"({i}, {a}::DOUBLE, {str(n).lower()})" for i, (a, n) in enumerate(cands))
    # Runs 0 to 2 hold a fold out of the training rows, run -1 is the fit on all of them.
    runs = f"SELECT unnest({[0, 1, 2] if folds is True else [-1] if folds is False else [0, 1, 2, -1]}) AS run"
    in_train = "d.split = 'train' AND d.fold <> r.run"
    scored = "CASE WHEN r.run = -1 THEN d.split = 'test' ELSE d.split = 'train' AND d.fold = r.run END"
    if kind == "multinomial":
        weights = """theta AS (SELECT run, number, label_idx, term,
          ln(n + alpha) - ln(sum(n + alpha) OVER (PARTITION BY run, number, label_idx)) AS th FROM dense, cands)"""
        prior = "(SELECT ln(p.n_c / p.n_all) FROM priors p WHERE p.run = x.run AND p.label_idx = x.label_idx)"
    else:
        weights = """comp AS (SELECT run, number, norm, label_idx, term,
          sum(n) OVER (PARTITION BY run, number, term) - n + alpha AS c FROM dense, cands),
        logged AS (SELECT *, ln(c) - ln(sum(c) OVER (PARTITION BY run, number, label_idx)) AS lg FROM comp),
        theta AS (SELECT run, number, label_idx, term,
          CASE WHEN norm THEN lg / sum(lg) OVER (PARTITION BY run, number, label_idx) ELSE -lg END AS th FROM logged)"""
        prior = "0.0::DOUBLE"
    return f"""WITH {SQL_WEIGHTS}, {SQL_NB_DOCS},
runs AS ({runs}), cands(number, alpha, norm) AS (VALUES {values}),
train_docs AS (SELECT r.run, d.doc_id, d.label_idx FROM docs d, runs r WHERE {in_train}),
test_docs AS (SELECT r.run, d.doc_id, d.label_idx FROM docs d, runs r WHERE {scored}),
class_docs AS (SELECT run, label_idx, count(*) AS n_c FROM train_docs GROUP BY ALL),
priors AS (SELECT run, label_idx, n_c, sum(n_c) OVER (PARTITION BY run) AS n_all FROM class_docs),
sums AS (SELECT run, label_idx, term, sum(weight) AS n FROM train_docs JOIN weights USING (doc_id) GROUP BY ALL),
dense AS (SELECT r.run, l.label_idx, v.term, coalesce(s.n, 0.0::DOUBLE) AS n FROM runs r CROSS JOIN lang_dim l CROSS JOIN vocab v
  LEFT JOIN sums s ON s.run = r.run AND s.label_idx = l.label_idx AND s.term = v.term),
{weights},
dots AS (SELECT t.run, t.doc_id, th.number, th.label_idx, sum(w.weight * th.th) AS dot
  FROM test_docs t JOIN weights w ON w.doc_id = t.doc_id JOIN theta th ON th.run = t.run AND th.term = w.term GROUP BY ALL),
x AS (SELECT t.run, t.doc_id, t.label_idx AS true_idx, c.number, l.label_idx, coalesce(d.dot, 0.0::DOUBLE) AS dot
  FROM test_docs t CROSS JOIN cands c CROSS JOIN lang_dim l
  LEFT JOIN dots d ON d.run = t.run AND d.doc_id = t.doc_id AND d.number = c.number AND d.label_idx = l.label_idx),
scored AS (SELECT run, doc_id, true_idx, number, label_idx, round({prior} + dot, 9) AS s FROM x),
nb_preds AS (SELECT run, doc_id, number, true_idx, label_idx AS pred_idx, s FROM scored
  QUALIFY row_number() OVER (PARTITION BY run, doc_id, number ORDER BY s DESC, label_idx) = 1)"""


SQL_FOLD_SCORES = """cm AS (SELECT number, run, true_idx, pred_idx, count(*) AS n FROM nb_preds GROUP BY ALL),
per_class AS (SELECT c.number, c.run, l.label_idx,
    coalesce(sum(n) FILTER (true_idx = l.label_idx AND pred_idx = l.label_idx), 0) AS tp,
    coalesce(sum(n) FILTER (true_idx = l.label_idx), 0) AS t, coalesce(sum(n) FILTER (pred_idx = l.label_idx), 0) AS p
  FROM cm c CROSS JOIN lang_dim l GROUP BY ALL),
fold_scores AS (SELECT number AS candidate, run AS fold, avg(2 * tp / (t + p)) FILTER (t + p > 0) AS f1_macro,
    sum(tp) / sum(t) AS accuracy FROM per_class GROUP BY ALL)"""


def nb_inputs(spark, sf):
    """Documents of the whole corpus in blocks and vocabulary size; train and test documents. All carry class, split and fold."""
    docs = with_label_index(S.split_and_folds(corpus(spark, sf, "lang"), 3), lang_labels(spark, sf))
    fitted = T.fit_in_blocks(docs, keep=("label_idx", "split", "fold"))
    ids = docs.select("doc_id", "label_idx", "split", "fold")
    return fitted, fitted.size(), ids.where(F.col("split") == "train"), ids.where(F.col("split") == "test")


def _cv(spark, sf, kind):
    fitted, v, train, _ = nb_inputs(spark, sf)
    return U.cross_validate_bayes(fitted, fitted.docs.where(F.col("split") == "train"), train, v, B.grid(kind), 3)


@query("m07_multinomial_nb", sql_nb("multinomial", (0.1,), folds=False) + """
SELECT doc_id, true_idx, pred_idx, round(s, 6) AS score FROM nb_preds""")
def m07(spark, sf):
    fitted, v, train, test = nb_inputs(spark, sf)
    preds = U.predict_bayes(fitted, train, test, v, [B.Candidate(0, "multinomial", 0.1)])
    return preds.select(
        "doc_id", "true_idx", "pred_idx", F.round("score", 6).alias("score"))


@query("m08_complement_nb", sql_nb("complement", (0.5,), (False, True), folds=False) + """
SELECT doc_id, CAST(number AS INTEGER) AS candidate, true_idx, pred_idx, round(s, 6) AS score FROM nb_preds""")
def m08(spark, sf):
    fitted, v, train, test = nb_inputs(spark, sf)
    return U.predict_bayes(fitted, train, test, v, B.grid("complement", (0.5,))).select(
        "doc_id", "candidate", "true_idx", "pred_idx", F.round("score", 6).alias("score"))


@query("m13_nb_grid_cv", sql_nb("multinomial", B.ALPHAS) + ", " + SQL_FOLD_SCORES + """
SELECT CAST(candidate AS INTEGER) AS candidate, CAST(fold AS INTEGER) AS fold, round(accuracy, 6) AS accuracy,
  round(f1_macro, 6) AS f1_macro FROM fold_scores""")
def m13(spark, sf):
    return _cv(spark, sf, "multinomial").select(
        "candidate", "fold", F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro"))


@query("m13_complement_grid_cv", sql_nb("complement", B.ALPHAS, (False, True)) + ", " + SQL_FOLD_SCORES + """
SELECT CAST(candidate AS INTEGER) AS candidate, CAST(fold AS INTEGER) AS fold, round(accuracy, 6) AS accuracy,
  round(f1_macro, 6) AS f1_macro FROM fold_scores""")
def m13_complement(spark, sf):
    return _cv(spark, sf, "complement").select(
        "candidate", "fold", F.round("accuracy", 6).alias("accuracy"), F.round("f1_macro", 6).alias("f1_macro"))


@query("w07_best_candidate", sql_nb("multinomial", B.ALPHAS) + ", " + SQL_FOLD_SCORES + """
SELECT CAST(candidate AS INTEGER) AS candidate, round(avg(f1_macro), 6) AS mean_score, round(stddev_pop(f1_macro), 6) AS std_score
FROM fold_scores GROUP BY candidate ORDER BY round(avg(f1_macro), 9) DESC, candidate LIMIT 1""")
def w07(spark, sf):
    best = E.best_candidate(E.candidate_scores(_cv(spark, sf, "multinomial")))
    return best.select("candidate", F.round("mean_score", 6).alias("mean_score"), F.round("std_score", 6).alias("std_score"))


@query("w07_best_by_accuracy", sql_nb("complement", B.ALPHAS, (False, True)) + ", " + SQL_FOLD_SCORES + """
SELECT CAST(candidate AS INTEGER) AS candidate, round(avg(accuracy), 6) AS mean_score, round(stddev_pop(accuracy), 6) AS std_score
FROM fold_scores GROUP BY candidate ORDER BY round(avg(accuracy), 9) DESC, candidate LIMIT 1""")
def w07_accuracy(spark, sf):
    fitted, v, train, _ = nb_inputs(spark, sf)
    best, mean, std = U.tune_bayes(fitted, fitted.docs.where(F.col("split") == "train"), train, v, B.grid("complement"), 3, "accuracy")
    return spark.createDataFrame([(best.number, round(mean, 6), round(std, 6))], "candidate INT, mean_score DOUBLE, std_score DOUBLE")


@query("m14_nb_report", sql_nb("multinomial", (0.1,), folds=False) + """,
sums2 AS (SELECT l.label_idx, l.label_name, count(*) FILTER (true_idx = l.label_idx AND pred_idx = l.label_idx) AS tp,
    count(*) FILTER (true_idx = l.label_idx) AS t, count(*) FILTER (pred_idx = l.label_idx) AS p
  FROM lang_dim l CROSS JOIN nb_preds GROUP BY ALL)
SELECT label_name, round(CASE WHEN p = 0 THEN 0 ELSE tp / p END, 6) AS precision, round(CASE WHEN t = 0 THEN 0 ELSE tp / t END, 6) AS recall,
  round(CASE WHEN t + p = 0 THEN 0 ELSE 2 * tp / (t + p) END, 6) AS f1, t AS support FROM sums2""")
def m14(spark, sf):
    fitted, v, train, test = nb_inputs(spark, sf)
    preds = U.predict_bayes(fitted, train, test, v, [B.Candidate(0, "multinomial", 0.1)])
    rep = E.class_report(preds, lang_labels(spark, sf))
    return rep.select("label_name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
