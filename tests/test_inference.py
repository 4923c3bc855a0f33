import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from labelloom.functions import prompts as P
from labelloom.functions import replies as R
from labelloom.operators import inference as I
from labelloom.operators import joins as J
from labelloom.sources import caches
from labelloom.workload.doubles import dropping, lead_backend, lead_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # model functions below run in tasks

# Five documents, two pairs of them equal.
DUPES = ["alpha beta gamma delta", "zeta eta theta iota", "alpha beta gamma delta", "unique lone document", "zeta eta theta iota"]


def echo(batches):
    for pdf in batches:
        yield pd.DataFrame({"custom_id": pdf["custom_id"], "content": pdf["prompt"]})


def summarize(docs, path, fn=echo, fractions=0.25, **kw):
    return I.summarize(docs, fractions, backend=I.Backend("t", fn), model_tag="m", prompts=P.ZERO_SHOT, cache_path=path, **kw)


@pytest.fixture
def dupes(spark):
    return spark.createDataFrame(list(enumerate(DUPES)), "doc_id LONG, text STRING")


def test_copies_share_one_request(spark, dupes, tmp_path):
    calls = str(tmp_path / "calls")

    def noting(batches):
        import os
        import uuid
        os.makedirs(calls, exist_ok=True)
        for pdf in batches:
            for key in pdf["custom_id"]:
                open(f"{calls}/{key}-{uuid.uuid4().hex}", "w").close()
            yield pd.DataFrame({"custom_id": pdf["custom_id"], "content": pdf["prompt"]})

    import os
    out = summarize(dupes, str(tmp_path / "cache"), noting)
    rows = {r["doc_id"]: r for r in out.collect()}
    out.count()
    assert len(os.listdir(calls)) == 3  # three distinct texts, each sent once, however often the result is read
    assert len(rows) == 5 and all(r["summary"] and not r["cache_hit"] for r in rows.values())
    assert rows[0]["summary"] == rows[2]["summary"] != rows[1]["summary"] == rows[4]["summary"]
    again = summarize(dupes, str(tmp_path / "cache"), noting).collect()
    assert len(os.listdir(calls)) == 3 and all(r["cache_hit"] for r in again)
    assert {r["doc_id"]: r["summary"] for r in again} == {i: r["summary"] for i, r in rows.items()}


def test_a_grown_corpus_sends_only_new_texts(spark, dupes, tmp_path):
    path = str(tmp_path)
    summarize(dupes.where("doc_id < 2"), path)
    hits = {r["doc_id"]: r["cache_hit"] for r in summarize(dupes, path).collect()}
    assert hits == {0: True, 1: True, 2: True, 3: False, 4: True}


def test_raw_documents_never_reach_the_model(spark, dupes, tmp_path):
    def never(batches):
        raise AssertionError("called")
        yield

    out = summarize(dupes, str(tmp_path / "none"), never, fractions=1.0).collect()
    assert [(r["summary"], r["cache_key"], r["cache_hit"]) for r in sorted(out)] == [(t, "raw", True) for t in DUPES]


def test_sweep_shares_entries_of_equal_length(spark, dupes, tmp_path):
    # All texts are short, so every fraction asks for the smallest summary.
    out = summarize(dupes, str(tmp_path), fractions=[0.1, 0.5, 1.0])
    assert out.count() == 15
    assert caches.read_summaries(spark, str(tmp_path), "m", "v1").count() == 3


def test_missing_replies_fail_but_keep_what_arrived(spark, tmp_path):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("document number "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path)
    with pytest.raises(I.MissingReplies):
        summarize(docs, path, dropping)
    kept = caches.read_summaries(spark, path, "m", "v1").count()
    assert 0 < kept < 60
    done = summarize(docs, path, lead_words)
    assert done.count() == 60 and done.where("cache_hit").count() == kept


REPLIES = [
    ('{"category": "a"}', "a"), ('  {"category": "a"}\n', "a"), ('{"category": "a", "x": [1]}', "a"), ('{"category": "zzz"}', None),
    ('{"category": 1}', None), ('{"category": null}', None), ("{}", None), ("[]", None), ("", None), ("a", None), (None, None),
    ('{"category": "a"} trailing', None), ('{"category": "a"}{"category": "b"}', None), ('{"category": "a"}]', None), ('"a"', None),
]


def test_reply_parsing_is_strict(spark):
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "label_idx INT, label_name STRING")
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(REPLIES)], "i INT, content STRING")
    got = {r["i"]: r["pred_label"] for r in I.parse_predictions(df, labels).collect()}
    assert got == {i: want for i, (_, want) in enumerate(REPLIES)}


def test_reply_blocks_and_outcomes(spark):
    text, tool = {"type": "text", "text": "  hello  "}, {"type": "tool_use", "input": {"category": "rec.autos"}}
    use = {"input_tokens": 20, "output_tokens": 3, "cache_read_input_tokens": 10}
    rows = [("t", "succeeded", [tool, text], use), ("n", "succeeded", [text], None), ("e", "errored", [text], use),
            ("x", "expired", None, None), ("m", "succeeded", [], use)]
    df = spark.createDataFrame([json.dumps(dict(zip(("custom_id", "status", "content", "usage"), r))) for r in rows], "STRING")
    df = df.select(F.from_json("value", R.BATCH_REPLY).alias("r")).select("r.*")
    got = {r["custom_id"]: r for r in I.batch_outcomes(df).collect()}
    assert {k: r["content"] for k, r in got.items()} == {"t": "hello", "n": "hello", "m": ""}
    assert got["n"]["has_usage"] is False and got["n"]["cost_usd"] == 0.0
    assert got["t"]["cost_usd"] == pytest.approx((20 * 3 + 3 * 15 + 10 * 0.3) / 1e6 * 0.5)
    tools = {r["custom_id"]: json.loads(r["content"]) for r in I.batch_outcomes(df, "tool", batch=False).collect()}
    assert tools == {"t": {"category": "rec.autos"}, "n": {}, "m": {}}


def test_join_replies_strict(spark):
    req = spark.createDataFrame([("a",), ("b",)], "custom_id STRING")
    rep = spark.createDataFrame([("a", "x")], "custom_id STRING, content STRING")
    assert {tuple(r) for r in I.join_replies(req, rep).collect()} == {("a", "x"), ("b", None)}
    with pytest.raises(I.MissingReplies):
        I.join_replies(req, rep, strict=True)


def test_classify_checks_the_context_first(spark):
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "label_idx INT, label_name STRING")
    docs = spark.createDataFrame([(1, "short"), (2, "long " * 5000)], "doc_id LONG, text STRING")
    with pytest.raises(ValueError, match="1 prompts exceed"):
        I.classify(docs, labels, backend=lead_backend(), prompts=P.ZERO_SHOT, num_ctx=1024, max_ctx=2048,
                   prompt_tokens=lambda p: F.length(p) / 4)
    assert I.classify(docs, labels, backend=lead_backend(), prompts=P.ZERO_SHOT).count() == 2


def test_backend_registry():
    assert I.make_backend("lead_words", rows_per_call=5).rows_per_call == 5
    with pytest.raises(ValueError, match="unknown backend"):
        I.make_backend("nobody")


def test_salted_join_equals_plain_join(spark):
    left = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 90).cast("string"))).alias("key"))
    right = left.select("key").distinct().where("key <> 'k3'").withColumn("v", F.length("key"))
    assert [r["key"] for r in J.hot_keys(left, "key", rows=100).collect()] == ["hot"]
    for how in ("inner", "left"):
        plain = left.join(right, "key", how).select("doc_id", "key", "v")
        salted = J.fan_out_join(left, right, "key", "doc_id", how, rows=100).select("doc_id", "key", "v")
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)
    with pytest.raises(ValueError):
        J.fan_out_join(left, right, "key", "doc_id", "full")


def test_embedding_cache_and_normalization(spark, dupes, tmp_path):
    def encoder(batches):
        for pdf in batches:
            yield pd.DataFrame({"cache_key": pdf["cache_key"], "embedding": [[3.0 * len(t), 4.0 * len(t)] for t in pdf["text"]]})

    path = str(tmp_path)
    first = I.embed(dupes, encoder, model_id="e", cache_path=path).collect()
    assert all([round(x, 6) for x in r["embedding"]] == [0.6, 0.8] and not r["cache_hit"] for r in first)
    assert caches.read_embeddings(spark, path, "e").count() == 3
    assert all(r["cache_hit"] for r in I.embed(dupes, encoder, model_id="e", cache_path=path).collect())
    raw = I.embed(dupes, encoder, model_id="e", cache_path=path, prefix="q: ", normalize=False).collect()
    assert {tuple(r["embedding"]) for r in raw} == {(3.0 * (len(t) + 3), 4.0 * (len(t) + 3)) for t in DUPES}


def test_ids_that_texts_share_find_each_text_once(spark, monkeypatch):
    """300 texts under three ids: as many candidates as texts, not a text for every other text of its id."""
    docs = spark.createDataFrame([(i % 3 or None, f"text number {i} of this small corpus") for i in range(300)], "doc_id LONG, text STRING")
    keyed = I._keyed(docs, [0.25, 0.5], model_tag="m", prompts=P.ZERO_SHOT, temperature=0.0, seed=0)
    places = keyed.select("_place", "text").distinct()
    assert places.count() == places.select("_place").distinct().count() == 300
    lacking = keyed.drop("doc_id", "text")
    found = I.fetch_texts(docs.union(docs), lacking, lambda digest, a: I.X.summary_key(
        digest=digest, target=a["target_words"], model_tag="m", prompt_version=P.ZERO_SHOT.cache_version)).collect()
    assert len(found) == 300 and all(len(r["asked"]) == 2 for r in found)  # a text once, with both of its rows


def test_more_text_than_the_calls_hold_goes_in_rounds(spark, tmp_path, monkeypatch):
    sizes = str(tmp_path / "sizes")

    def noting(batches):
        import os
        import uuid
        os.makedirs(sizes, exist_ok=True)
        rows = [pdf.assign(content=pdf["prompt"].str.split("POST:\n").str[1].str[:12])[["custom_id", "content"]] for pdf in batches]
        open(f"{sizes}/{sum(map(len, rows))}-{uuid.uuid4().hex}", "w").close()
        yield from rows

    import os
    monkeypatch.setattr(I, "CALL_CHARS", 1000)
    docs = spark.createDataFrame([(i, f"{i:012d} " + "word " * 20) for i in range(100)], "doc_id LONG, text STRING")
    backend = I.Backend("t", noting, parallel_calls=2, meter=I.Meter())
    out = I.summarize(docs, 0.25, backend=backend, model_tag="m", prompts=P.ZERO_SHOT, cache_path=str(tmp_path / "cache")).collect()
    assert {r["doc_id"]: r["summary"] for r in out} == {i: f"{i:012d}" for i in range(100)}
    seen = [int(f.split("-")[0]) for f in os.listdir(sizes)]
    assert sum(seen) == backend.meter.totals["n_calls"] == 100 and max(seen) < 30  # about 9 texts a task; all in two tasks would be 50
