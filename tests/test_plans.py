import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators.inference import Backend
from labelloom.plans import incremental, prompted, vector
from labelloom.sources import store
from labelloom.sources.runs import read_confusion, read_report, scan_runs, scan_runs_lenient
from labelloom.streaming import arrivals
from labelloom.workload.doubles import digest_encoder, lead_backend

WORDS = ["red apple tree", "blue ocean wave", "green forest moss"]


@pytest.fixture(scope="module")
def corpus(spark):
    text = F.concat_ws(" ", F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("id") % 3 + 1).cast("int")), F.lit("item"),
                       F.concat(F.lit("n"), (F.col("id") % 7).cast("string")))
    return spark.range(90).select(F.col("id").alias("doc_id"), text.alias("text"),
                                  F.concat(F.lit("class"), (F.col("id") % 3).cast("string")).alias("label_name")).cache()


def folders(tmp_path):
    return prompted.Folders(f"{tmp_path}/summaries", f"{tmp_path}/examples", f"{tmp_path}/runs")


def settings(**kw):
    return prompted.PromptedSettings(**({"model": "m", "tag": "t"} | kw))


def test_store_grows_and_never_rescores(spark, corpus, tmp_path):
    where = folders(tmp_path)
    added = [incremental.run_incremental(corpus, settings(test_per_category=n), lead_backend(), where)["n_added"] for n in (1, 3, 3, 2)]
    assert added == [3, 6, 0, 0]
    path = f"{where.runs}/_stores/{settings().run_name}"
    rows = store.read_store(spark, f"{path}/predictions")
    assert rows.count() == 9 and rows.select("test_idx").distinct().count() == 9
    run = scan_runs_lenient(spark, where.runs).first()
    assert run["kind"] == "llm_zero_shot" and run["n_test"] == 9


def test_failed_replies_stay_unless_retried(spark, corpus, tmp_path):
    def lost(batches):
        import pandas as pd
        from labelloom.workload.doubles import lead_words
        for pdf in lead_words(batches):
            is_summary = ~pdf["custom_id"].str.startswith("doc")
            yield pd.DataFrame(pdf[is_summary])

    where, s = folders(tmp_path), settings(test_per_category=2)
    first = incremental.run_incremental(corpus, s, Backend("lost", lost), where)
    assert (first["n_added"], first["n_unparseable"]) == (6, 6)
    assert incremental.run_incremental(corpus, s, lead_backend(), where)["n_added"] == 0
    again = incremental.run_incremental(corpus, s, lead_backend(), where, retry_null=True)
    assert again["n_added"] == 6 and again["n_total"] == 6 and again["n_unparseable"] < 6


def test_prompted_run_writes_everything(spark, corpus, tmp_path):
    where = folders(tmp_path)
    s = settings(shots=2, prompts="few_shot_v1", smoke=10)
    rec = prompted.run_prompted(corpus, s, lead_backend(), where)
    assert rec["kind"] == "llm_few_shot" and rec["n_test"] == 10 and len(rec["few_shot"]["example_train_indices"]) == 6
    assert rec["run_name"] == "m_few_shot_v1_n2_summary0.25_corpus" and rec["featurizer"] == "llm_summary_0.25_n2"
    folder = f"{where.runs}/{rec['run_name']}"
    assert read_confusion(spark, f"{folder}/confusion_matrix").count() == 9
    assert read_report(spark, f"{folder}/classification_report").count() == 6
    assert scan_runs(spark, where.runs).first()["mean_summary_words"] == rec["llm"]["mean_summary_words"]


def test_examples_come_from_the_training_part_and_are_reused(spark, corpus, tmp_path):
    where, s = folders(tmp_path), settings(shots=3, prompts="few_shot_v1")
    _, train, test = prompted.prepare(corpus, s)
    one = prompted.build_examples(train, s, lead_backend(), where)
    assert one.count() == 9 and one.join(test, one.train_idx == test.doc_id).count() == 0

    def never(batches):
        raise AssertionError("called")
        yield

    again = prompted.build_examples(train, s, Backend("never", never), where)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ValueError):
        prompted.build_examples(train, settings(), lead_backend(), where)
    assert prompted.warm_examples(train, [0.1], settings(), lead_backend(), where) == []


@pytest.mark.parametrize("model", ["nb", "complement_nb"])
def test_vector_run_with_bayes(spark, corpus, tmp_path, model):
    rec = vector.run_vector(corpus, vector.VectorSettings(model=model), f"{tmp_path}")
    assert rec["test"]["accuracy"] == 1.0 and rec["best_params"] and rec["cv"]["n_splits"] == 3
    assert rec["n_train"] == 72 and rec["n_test"] == 18 and rec["tfidf"]["vocab_size"] > 0
    row = scan_runs(spark, str(tmp_path)).first()
    assert row["run"] == f"{model}_tfidf_corpus_nNone" and row["cv_f1_macro_mean"] == 1.0


def test_vector_run_without_tuning(spark, corpus, tmp_path):
    rec = vector.run_vector(corpus, vector.VectorSettings(n_per_category=2), f"{tmp_path}")
    assert rec["best_params"] is None and rec["cv"] is None and rec["n_train"] == 6


def test_vector_run_with_sparse_model(spark, corpus, tmp_path):
    rec = vector.run_vector(corpus, vector.VectorSettings(model="logreg", n_per_category=6), f"{tmp_path}", grid={"C": [1.0]})
    assert rec["test"]["accuracy"] == 1.0 and rec["best_params"] == {"C": "1.0"}


def test_vector_run_with_an_encoder(spark, corpus, tmp_path):
    enc = vector.Encoder(digest_encoder, "double", f"{tmp_path}/cache")
    with pytest.raises(ValueError, match="non-negative"):
        vector.run_vector(corpus, vector.VectorSettings(model="nb"), f"{tmp_path}/runs", encoder=enc)
    s = vector.VectorSettings(model="random_forest", featurizer="double", n_per_category=2)
    first = vector.run_vector(corpus, s, f"{tmp_path}/runs", encoder=enc)
    assert first["embedding"]["dim"] == 8 and first["embedding"]["cache_hit"] is False
    assert vector.run_vector(corpus, s, f"{tmp_path}/runs", encoder=enc)["embedding"]["cache_hit"] is True


def test_arrivals_are_scored_once(spark, tmp_path):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    out = T.StructType([T.StructField("test_idx", T.LongType()), T.StructField("n", T.IntegerType())])
    folder, path, ckpt = (str(tmp_path / n) for n in ("in", "store", "ckpt"))

    def arrive(lo, hi):
        spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.lit("text").alias("text")).write.mode("append").parquet(folder)

    def drain(checkpoint):
        stream = arrivals.read_arrivals(spark, folder, schema, max_files=1)
        score = lambda b: b.select(F.col("doc_id").alias("test_idx"), F.length("text").alias("n"))
        arrivals.score_arrivals(stream, score, store_path=path, checkpoint=checkpoint, store_schema=out, fmt="parquet").awaitTermination()
        return store.read_store(spark, path, out, "parquet")

    arrive(0, 10)
    assert drain(ckpt).count() == 10
    arrive(5, 15)  # half of them again
    assert drain(ckpt).count() == 15
    assert drain(str(tmp_path / "other")).count() == 15  # a fresh checkpoint replays everything, nothing is added
