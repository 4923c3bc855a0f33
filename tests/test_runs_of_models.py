"""Repeated and null ids, usage, context windows, cache plans, repeated batches, stream state, saved stages, optima."""

import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from labelloom.functions import prompts as P
from labelloom.operators import bayes as B
from labelloom.operators import inference as I
from labelloom.operators import models as M
from labelloom.operators import sampling as S
from labelloom.operators import stages
from labelloom.operators.evaluation import check_scoring
from labelloom.operators.optimum import softmax_optimum
from labelloom.operators.tfidf import TfidfSettings
from labelloom.session import materialize
from labelloom.sources import caches, store
from labelloom.workload.doubles import digest_encoder, lead_backend, lead_words, window_teller

ROWS = [(5, "alpha beta gamma one"), (5, "delta epsilon two words"), (None, "no id at all here"), (None, "another one without id"),
        (7, "alpha beta gamma one"), (5, "alpha beta gamma one"), (8, None), (9, "")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id LONG, text STRING")


def key(row):
    return tuple("" if v is None else str(v) for v in row)


def test_every_document_gets_the_summary_of_its_own_text(spark, odd, tmp_path):
    want = sorted(((i, " ".join((t or "").split()[:8])) for i, t in ROWS), key=key)
    for hits in (0, len(ROWS)):
        out = I.summarize(odd, 0.25, backend=I.Backend("lead", lead_words), model_tag="m", prompts=P.ZERO_SHOT, cache_path=str(tmp_path))
        rows = out.collect()
        assert sorted(((r.doc_id, r.summary) for r in rows), key=key) == want and sum(r.cache_hit for r in rows) == hits
    known = caches.read_summaries(spark, str(tmp_path), "m", "v1")
    assert known.count() == known.select("cache_key").distinct().count() == 5


def test_every_document_gets_the_vector_of_its_own_text(spark, odd, tmp_path):
    want = {t or "": list(next(digest_encoder([pd.DataFrame({"cache_key": ["k"], "text": [t or ""]})]))["embedding"][0]) for _, t in ROWS}
    for hits in (0, len(ROWS)):
        out = I.embed(odd, digest_encoder, model_id="e", cache_path=str(tmp_path), normalize=False).collect()
        assert sorted(((r.doc_id, r.embedding) for r in out), key=key) == sorted(((i, want[t or ""]) for i, t in ROWS), key=key)
        assert sum(r.cache_hit for r in out) == hits


def test_a_lookup_neither_shuffles_nor_sorts_what_is_cached(spark, tmp_path):
    path = str(tmp_path / "c")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    I.summarize(docs, 0.25, backend=lead_backend(), model_tag="m", prompts=P.ZERO_SHOT, cache_path=path)
    known = caches.read_summaries(spark, path, "m", "v1")
    keys = known.select("cache_key").where("cache_key < 'a'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = caches.lookup(keys.repartition(3), known, "text")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == keys.count() and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert plan.count("Exchange hashpartitioning") == 1  # of the keys
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_usage_is_counted_once(spark, odd, tmp_path):
    meter = I.Meter()
    backend = I.Backend("lead", lead_words, price={"input": 2.0, "output": 4.0, "cache_read": 0.0}, batch=True, meter=meter)
    for _ in range(2):  # the second time nothing is asked
        I.summarize(odd, 0.25, backend=backend, model_tag="m", prompts=P.ZERO_SHOT, cache_path=str(tmp_path))
    texts = {t or "" for _, t in ROWS}
    asked, said = sum(map(len, texts)), sum(len(" ".join(t.split()[:8])) + 3 for t in texts)
    use = meter.usage()
    assert (use["n_calls"], use["input_tokens"], use["output_tokens"], use["cache_read_input_tokens"]) == (len(texts), asked, said, 0)
    assert use["total_cost_usd"] == pytest.approx((asked * 2 + said * 4) / 2e6, abs=1e-6) and meter.seconds["summarize"] > 0


def test_batch_ids_and_missing_usage(spark, odd):
    def fn(batches):
        for pdf in batches:
            yield pd.DataFrame({"custom_id": pdf["custom_id"], "content": "x", "batch_id": "b1"})

    meter = I.Meter()
    requests = I.with_options(I.text_requests(odd, F.lit("k"), F.col("text"), F.lit(5)), model="m", num_ctx=99)
    assert I.run_model(requests, I.Backend("b", fn, meter=meter)).count() == len(ROWS)
    assert meter.usage()["batch_ids"] == ["b1"] and meter.usage()["input_tokens"] == 0 and meter.usage()["n_calls"] == len(ROWS)


def test_a_task_sees_one_context_window(spark):
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "label_idx INT, label_name STRING")
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") * F.col("id")).cast("int")).alias("text"))
    backend = I.Backend("w", window_teller, parallel_calls=7, num_ctx=512, prompt_tokens=lambda p: F.length(p))
    requests = I.classify_requests(docs, labels, backend=backend, prompts=P.ZERO_SHOT, model="m", seed=3)
    replies = I.run_model(requests, backend).select("custom_id", F.split("content", "[|]").alias("c")).collect()
    assert {r.c[1] for r in replies} == {"1"} and len({r.c[0] for r in replies}) > 5
    window = {r.custom_id: int(r.c[0]) for r in replies}
    for r in requests.select("custom_id", "num_ctx", F.length(F.col("messages")[0]["content"]).alias("n")).collect():
        need = r.n + 64
        assert r.num_ctx == window[r.custom_id] == (512 if need <= 512 else 1 << (need - 1).bit_length())


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_a_batch_written_twice_is_there_once(spark, tmp_path, fmt):
    path = str(tmp_path / "store")
    rows = spark.range(5).select(F.col("id").alias("test_idx"))
    full = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in store.PREDICTION if f.name != "test_idx"])
    store.append_store(full.where("test_idx = 0"), path, fmt)
    for _ in range(2):
        store.append_batch(full.where("test_idx in (1, 2)"), path, "a", fmt)
        store.append_batch(full.where("test_idx > 2"), path, "b", fmt)
    assert sorted(r.test_idx for r in store.read_store(spark, path, fmt=fmt).collect()) == [0, 1, 2, 3, 4]


def test_split_and_folds_equal_a_split_followed_by_folds(spark):
    rows = [(i, "abcde"[i % 5] if i % 7 else "a") for i in range(203)] + [(900, "solo"), (901, None), (902, "two"), (903, "two")]
    df = spark.createDataFrame(rows, "doc_id LONG, label_name STRING")
    for k, share in ((3, 0.2), (5, 0.5), (2, 0.02)):
        split = S.stratified_split(df, test_size=share)
        folds = S.stratified_folds(split.where("split = 'train'"), k).select("doc_id", "fold")
        want = {r.doc_id: (r.split, r.fold) for r in split.join(folds, "doc_id", "left").collect()}
        assert {r.doc_id: (r.split, r.fold) for r in S.split_and_folds(df, k, test_size=share).collect()} == want


@pytest.fixture(scope="module")
def labelled(spark):
    words = [("red apple tree", 0), ("blue ocean wave", 1), ("green forest moss", 2)]
    rows = [(i, f"{words[i % 3][0]} item n{i % 7}", words[i % 3][1]) for i in range(60)]
    return spark.createDataFrame(rows + [(100, None, 1), (101, "never seen", 2)], "doc_id LONG, text STRING, label_idx INT")


def test_a_saved_pipeline_predicts_the_same_in_another_session(spark, labelled, tmp_path):
    settings = TfidfSettings(min_df=1, max_df=1.0, stop_words=("item",))
    for kind, norm in (("multinomial", False), ("complement", True)):
        pipeline = Pipeline(stages=[stages.Tfidf(settings), stages.Bayes(kind=kind, alpha=0.5, norm=norm)])
        pipeline.write().overwrite().save(str(tmp_path / "unfitted"))
        model = Pipeline.load(str(tmp_path / "unfitted")).fit(labelled)
        model.write().overwrite().save(str(tmp_path / "model"))
        want = sorted(model.transform(labelled).select("doc_id", "prediction", "score").collect())
        again = PipelineModel.load(str(tmp_path / "model"))
        assert again.stages[0].settings == settings and again.stages[1].candidate == B.Candidate(0, kind, 0.5, norm)
        assert sorted(again.transform(labelled).select("doc_id", "prediction", "score").collect()) == want
        assert len(want) == 62 and all(r.prediction == r.doc_id % 3 for r in want if r.doc_id < 60)


def test_scores_are_the_same_by_arrays_and_by_rows(spark, labelled):
    terms = stages.Tfidf(TfidfSettings(min_df=1, max_df=1.0)).fit(labelled).transform(labelled).withColumn("fold", (F.col("doc_id") % 3).cast("int"))
    long, docs = terms.select("doc_id", "label_idx", "fold", F.inline("terms")), terms.select("doc_id", "label_idx", "fold")
    for grid in (B.grid("multinomial"), B.grid("complement")):
        model = B.fit_bayes(long, docs, 50, 3)
        a, b = (sorted((r.doc_id, r.candidate, r.pred_idx, round(r.score, 8)) for r in B.score(model, long, docs, grid, dense=n).collect()) for n in (0, 10 ** 6))
        assert a == b and len(a) == 62 * len(grid)


def test_an_unfinished_fit_is_no_optimum(spark):
    rows = [(i, i % 2, [float(i % 5), float((i * 7) % 3), 1.0 if i % 2 else -0.5]) for i in range(120)]
    data = M.dense_input(spark.createDataFrame(rows, "doc_id LONG, label_idx INT, embedding ARRAY<DOUBLE>"))
    data = materialize(data, "vectors")
    from pyspark.ml.classification import LogisticRegression
    for steps, good in ((1000, True), (1, False)):
        fitted = LogisticRegression(family="multinomial", regParam=0.01, standardization=False, maxIter=steps).fit(data)
        o = softmax_optimum(fitted, data, 0.01)
        assert (o["gradient_norm"] < 1e-3 and o["objective"] < o["least_changed"]) is good and o["n"] == 120


def test_scoring_is_checked():
    check_scoring("accuracy")
    for use in (check_scoring, M.HeldOut):
        with pytest.raises(ValueError, match="unknown scoring"):
            use("roc")
