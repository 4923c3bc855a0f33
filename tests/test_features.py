import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelloom.operators import bayes as B
from labelloom.operators import models as M
from labelloom.operators import tfidf as T

random.seed(3)
VOCAB = "alpha beta gamma delta the and ömega été x 42 foo_bar Ω9".split()
DOCS = [(i, " ".join(random.choice(VOCAB) for _ in range(random.randint(0, 14))) + random.choice(["", ".", " Alpha!", " the-beta"])) for i in range(40)]
DOCS += [(40, ""), (41, "the and the"), (42, "unseen words only here")]
LABEL = {i: i % 3 for i, _ in DOCS}


def brute_terms(text):
    toks = [t for t in re.findall(r"(?u)\b\w\w+\b", text.lower()) if t not in T.STOP_WORDS]
    return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]


def brute_tfidf():
    tf = {i: Counter(brute_terms(t)) for i, t in DOCS}
    df = Counter(term for c in tf.values() for term in c)
    n = len(DOCS)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if 2 <= d <= 0.95 * n}
    out = {}
    for i, c in tf.items():
        w = {t: (1 + math.log(k)) * idf[t] for t, k in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out[i] = {t: v / norm for t, v in w.items()}
    return out, idf


@pytest.fixture(scope="module")
def features(spark):
    label = F.col("doc_id") % 3
    docs = spark.createDataFrame(DOCS, "doc_id LONG, text STRING").select(
        "*", label.cast("int").alias("label_idx"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"))
    weights, vocab = T.fit_transform_tfidf(docs, keep=("label_idx", "fold"))
    return docs, weights.cache(), vocab.cache()


def test_tfidf_by_brute_force(features):
    _, weights, vocab = features
    want, idf = brute_tfidf()
    got = defaultdict(dict)
    for r in weights.collect():
        got[r["doc_id"]][r["term"]] = r["weight"]
    assert {r["term"] for r in vocab.collect()} == set(idf)
    assert set(got) == {i for i, w in want.items() if w}
    for i, w in got.items():
        assert w.keys() == want[i].keys() and all(math.isclose(w[t], want[i][t], rel_tol=1e-12) for t in w)


def test_trigrams_and_no_stop_words(spark):
    df = spark.createDataFrame([(1, "aa bb cc dd"), (2, "aa")], "doc_id LONG, text STRING")
    got = T.term_counts(df, T.TfidfSettings(stop_words=(), ngram_range=(2, 3)))
    assert {(r["doc_id"], r["term"]) for r in got.collect()} == {(1, t) for t in ("aa bb", "bb cc", "cc dd", "aa bb cc", "bb cc dd")}


def brute_bayes(train, test, cand, weights, vocab):
    n = {c: Counter() for c in range(3)}
    docs = Counter(LABEL[i] for i in train)
    for i in train:
        for t, w in weights[i].items():
            n[LABEL[i]][t] += w
    a, preds = cand.alpha, {}
    theta = {}
    for c in range(3):
        if cand.kind == "multinomial":
            den = sum(n[c].values()) + a * len(vocab)
            theta[c] = {t: math.log(n[c][t] + a) - math.log(den) for t in vocab}
        else:
            comp = {t: a + sum(n[k][t] for k in range(3)) - n[c][t] for t in vocab}
            lg = {t: math.log(v / sum(comp.values())) for t, v in comp.items()}
            total = sum(lg.values())
            theta[c] = {t: (v / total if cand.norm else -v) for t, v in lg.items()}
    for i in test:
        score = {c: (math.log(docs[c] / len(train)) if cand.kind == "multinomial" else 0.0)
                 + sum(w * theta[c][t] for t, w in weights[i].items()) for c in range(3)}
        preds[i] = max(score, key=lambda c: (round(score[c], 9), -c)), score
    return preds


@pytest.mark.parametrize("kind", B.KINDS)
def test_bayes_by_brute_force(features, kind):
    docs, weights, vocab = features
    want_w, idf = brute_tfidf()
    rows = docs.select("doc_id", "label_idx", "fold").collect()
    fold = {r["doc_id"]: r["fold"] for r in rows}
    cands = B.grid(kind)
    model = B.fit_bayes(weights, docs.select("doc_id", "label_idx", "fold"), len(idf), 2)
    got = {(r["doc_id"], r["candidate"]): r for r in B.score(model, weights, docs.select("doc_id", "fold"), cands).collect()}
    assert len(got) == len(DOCS) * len(cands)
    for f in (0, 1):
        train, test = [i for i in fold if fold[i] != f], [i for i in fold if fold[i] == f]
        for c in cands:
            want = brute_bayes(train, test, c, want_w, idf)
            for i in test:
                best, score = want[i]
                assert math.isclose(got[i, c.number]["score"], score[best], abs_tol=1e-8)
                assert got[i, c.number]["pred_idx"] == best


def test_number_terms(spark):
    vocab = spark.range(500).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"))
    got = {r["term"]: r["idx"] for r in M.number_terms(vocab, buckets=16).collect()}
    assert sorted(got.values()) == list(range(500))


def test_sparse_vectors(features):
    docs, weights, vocab = features
    rows = M.sparse_input(weights, vocab, docs, 3).collect()
    assert len(rows) == len(DOCS)
    by_id = {r["doc_id"]: r["features"] for r in rows}
    want, _ = brute_tfidf()
    for i, vec in by_id.items():
        assert vec.size == vocab.count()
        assert sorted(round(v, 9) for v in vec.values) == sorted(round(v, 9) for v in want[i].values())


def test_sparse_model_learns(features):
    docs, weights, vocab = features
    data = M.sparse_input(weights, vocab, docs, 3)
    preds = M.predict(M.make_model("logreg").fit(data), data)
    assert preds.where("true_idx = pred_idx").count() > 25


def test_registry_and_compatibility():
    with pytest.raises(ValueError, match="non-negative"):
        M.check_compatible("nb", dense_features=True)
    M.check_compatible("logreg", dense_features=True)
    with pytest.raises(ValueError, match="unknown model"):
        M.make_model("perceptron")
    assert M.expand_grid({"a": [1, 2], "b": [[1, 2], "x"]}) == [
        {"a": 1, "b": (1, 2)}, {"a": 1, "b": "x"}, {"a": 2, "b": (1, 2)}, {"a": 2, "b": "x"}]
    assert [c.params for c in B.grid("complement", (0.1,))] == [{"alpha": 0.1, "norm": False}, {"alpha": 0.1, "norm": True}]


def test_pipeline_of_a_registered_model(spark):
    from pyspark.ml.linalg import Vectors
    data = spark.createDataFrame([(float(i % 2), Vectors.dense([float(i % 2), 1.0])) for i in range(20)], ["label", "features"])
    for name in ("logreg", "random_forest", "nb", "complement_nb"):
        assert M.build_pipeline(name).fit(data).transform(data).where("label = prediction").count() == 20


def test_documents_are_spread_over_the_tasks_asked_for(spark):
    df = spark.createDataFrame([(i, "aa bb") for i in range(50)], "doc_id LONG, text STRING")
    assert T.document_tokens(df, T.TfidfSettings(partitions=7)).rdd.getNumPartitions() == 7
    assert T.document_tokens(df, T.TfidfSettings()).rdd.getNumPartitions() == 4


def test_ngrams_of_three_lengths(spark):
    texts = [[], ["a"], ["a", "b"], ["a", "b", "c"], ["d", "d", "d", "d"]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, toks ARRAY<STRING>")
    got = {r["i"]: r["g"] for r in rows.select("i", T.ngrams(F.col("toks"), (1, 3)).alias("g")).collect()}
    assert got == {i: [" ".join(t[s:s + n]) for n in (1, 2, 3) for s in range(len(t) - n + 1)] for i, t in enumerate(texts)}
    # Each token is joined with its neighbours, not cut out of the list again for every n-gram.
    plan = rows.select(T.ngrams(F.col("toks"), (2, 2)).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan and "array_join" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, "aa bb cc dd" if i % 2 else "bb cc ee") for i in range(50)], "doc_id LONG, text STRING")
    known = spark.createDataFrame([(b, "bb", 1.5) for b in range(4)], "block INT, term STRING, idf DOUBLE")
    # The texts go to their blocks and the terms known there follow; nothing else moves.
    plan = plan_of(T.unit_weights(T.weigh(df, known)))
    assert plan.count("Exchange") == 2 and plan.count("REPARTITION_BY_NUM") == 2


def test_repeated_and_null_ids_are_weighed_as_one_document(spark):
    rows = [(1, "aa bb"), (1, "bb cc"), (None, "aa"), (None, "cc cc"), (2, "aa bb cc"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    settings = T.TfidfSettings(stop_words=(), ngram_range=(1, 1), max_df=1.0)
    got, vocab = T.fit_transform_tfidf(df, settings)
    idf = {r["term"]: r["idf"] for r in vocab.collect()}
    assert {r["term"]: r["df"] for r in vocab.collect()} == {"aa": 3, "bb": 3, "cc": 3}
    want = {}
    for doc, counts in ((1, {"aa": 1, "bb": 2, "cc": 1}), (None, {"aa": 1, "cc": 2}), (2, {"aa": 1, "bb": 1, "cc": 1})):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        want |= {(doc, t): round(w / norm, 9) for t, w in raw.items()}
    for weights in (got, T.transform_tfidf(df, vocab, settings)):
        assert {(r["doc_id"], r["term"]): round(r["weight"], 9) for r in weights.collect()} == want


def test_blocks_are_bounded_by_their_text(spark, monkeypatch):
    df = spark.createDataFrame([(i, "aa bb cc dd" if i % 2 else "bb cc ee") for i in range(40)] + [(40, None)], "doc_id LONG, text STRING")

    def rounded(weights):
        return sorted((r["doc_id"], r["term"], round(r["weight"], 9)) for r in weights.collect())

    want = rounded(T.fit_transform_tfidf(df)[0])
    assert T.in_blocks(df, T.TfidfSettings()).partitions == 4
    monkeypatch.setattr(T, "BLOCK_BYTES", 20)
    assert T.in_blocks(df, T.TfidfSettings()).partitions == 19  # 380 bytes
    assert T.in_blocks(df, T.TfidfSettings(partitions=3)).partitions == 3
    weights, vocab = T.fit_transform_tfidf(df)
    assert rounded(weights) == want and len(want) > 40
    assert rounded(T.transform_tfidf(df, vocab)) == want


def test_documents_have_few_rows_of_sums(spark):
    docs = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id LONG, label_idx INT")
    rows = docs.select("doc_id", "label_idx", F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string")).alias("term"), F.lit(1.0).alias("weight"))
    model = B.fit_bayes(rows, docs, 4)
    assert model.terms.count() == 4
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 3 * B.JOIN_TASKS)
    try:
        plan = plan_of(B.score(model, rows, docs, [B.Candidate(0)]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by_term = [line for line in plan.splitlines() if "hashpartitioning(term" in line]
    assert len(by_term) == 2 and all(f", {B.JOIN_TASKS})" in line for line in by_term)


def test_naive_bayes_of_very_long_vectors(spark):
    """No array as long as the vectors is made: two of these would be 32 GB."""
    from pyspark.ml.linalg import Vectors
    size = 2_000_000_000
    rows = [(float(i % 2), Vectors.sparse(size, {i % 2: 2.0, size - 1 - i: 1.0})) for i in range(12)] + [(0.0, Vectors.sparse(size, {}))]
    data = spark.createDataFrame(rows, ["label", "features"])
    model = M.build_pipeline("nb").fit(data)
    got = model.transform(data).select("label", "prediction").collect()
    assert len(got) == 13 and all(r.label == r.prediction for r in got)


def test_a_saved_naive_bayes_of_vectors_predicts_the_same(spark, tmp_path):
    from pyspark.ml.linalg import Vectors
    data = spark.createDataFrame([(i % 5, float(i % 2), Vectors.dense([float(i % 2), 1.0, float(i % 3)])) for i in range(20)], ["doc_id", "label", "features"])
    model = M.build_pipeline("nb").fit(data)
    M.save_model(model.stages, str(tmp_path / "m"))
    want = sorted(tuple(r) for r in M.predict(model, data).collect())
    assert sorted(tuple(r) for r in M.predict(M.load_model(str(tmp_path / "m")), data).collect()) == want and len(want) == 20


def test_naive_bayes_in_blocks_equals_that_of_moved_postings(spark):
    from labelloom.session import buckets_in_place
    texts = ["red apple pie", "green apple tree", "red car red road", "fast car road", None]
    rows = [(i, f"{texts[i % 5]} w{i % 7}" if texts[i % 5] else None, i % 2 if i % 5 != 3 else 1, i % 3) for i in range(60)]
    rows += [rows[1], rows[2], (None, "red apple", 0, 1), (None, "fast car", 1, 1)]  # repeated and null ids
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, label_idx INT, fold INT")
    settings = T.TfidfSettings(min_df=1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        # Blocks go by the text and the cores, not by the session's partitions.
        assert T.in_blocks(docs, settings).partitions == spark.sparkContext.defaultParallelism
        moved, vocab = T.fit_transform_tfidf(docs, settings, keep=("label_idx", "fold"))
        placed, again, homes = T.fit_transform_in_blocks(docs, settings, keep=("label_idx", "fold"))
        assert sorted(again.collect()) == sorted(vocab.collect())
        with buckets_in_place(spark):
            sums = placed.groupBy("home", "doc_id", "term").count()
            assert not [line for line in plan_of(sums).splitlines() if "hashpartitioning" in line and "term" in line]
        for cands in (B.grid("multinomial"), B.grid("complement")):
            found = []
            for features, blocks in ((moved, None), (placed, len(homes))):
                model = B.fit_bayes(features, docs, vocab.count(), 3)
                for dense in (B.DENSE, 0):
                    got = B.score(model, features, docs, cands, dense=dense, blocks=blocks).collect()
                    found.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["candidate"], r["pred_idx"], round(r["score"], 7)) for r in got))
            assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 64 * len(cands)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
