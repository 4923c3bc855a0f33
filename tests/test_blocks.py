"""Blocks of documents in arrays: terms, document frequencies and sums next to brute force; nothing moves by posting."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelloom.operators import bayes as B
from labelloom.operators import blocks
from labelloom.operators import models as M
from labelloom.operators import tfidf as T

WORDS = "aa bb cc dd e ee é ff the".split()
TEXTS = [" ".join(WORDS[(i * j + j * j) % 9] for j in range(i % 11)) for i in range(200)] + [None, "", " ", "e"]
IDS = [None if i % 29 == 0 else i % 70 for i in range(len(TEXTS))]


@pytest.mark.parametrize("lengths", [(1, 1), (1, 2), (2, 3)])
def test_a_block_is_taken_apart_like_by_brute_force(lengths):
    batch = pa.record_batch({"home": pa.array([5] * len(IDS), pa.int32()), "doc_id": pa.array(IDS, pa.int64()), "text": pa.array(TEXTS)})
    rows = [r for b in blocks.encode(("the",), lengths, 3, ["home", "doc_id"])(iter([batch])) for r in b.to_pylist()]
    want, df = defaultdict(Counter), Counter()
    for i, text in zip(IDS, TEXTS):
        toks = [t for t in (text or "").split(" ") if len(t) > 1 and t != "the"]
        found = [" ".join(toks[k:k + n]) for n in range(lengths[0], lengths[1] + 1) for k in range(len(toks) - n + 1)]
        if found:
            want[i].update(found)
            df.update(set(found))
    word, counted = {}, {}
    for r in rows:
        if r["part"] is not None:
            (terms, ns), _ = blocks.unpack(pa.chunked_array([pa.array([r["chunk"]])]), "terms", "ns")
            for place, (term, n) in enumerate(zip(terms.to_pylist(), ns), r["start"]):
                word[place], counted[term] = term, n
    got = {}
    for r in rows:
        if r["part"] is None:
            places = [sum(r["ids"][:k + 1]) for k in range(len(r["ids"]))]
            assert r["doc_id"] not in got  # rows of an id are one document
            got[r["doc_id"]] = {word[p]: n for p, n in zip(places, r["tfs"])}
    assert got == want and counted == df and len(word) == len(df)


def test_a_block_that_sends_two_rows_is_answered_once():
    cells = blocks.Cells((0, 1), 2)

    def row(home, ranks, cell, sums, asked):
        entries = blocks.pack(ranks=pa.array(ranks, pa.int64()).to_numpy(), cells=pa.array(cell, pa.int16()), sums=pa.array(sums, pa.float64()))
        return {"home": home, "part": 7, "entries": entries, "asked": blocks.pack(ranks=pa.array(asked, pa.int64()).to_numpy())}

    table = pa.Table.from_pylist([row(1, [0, 2], [0, 3], [0.5, 1.0], [0, 2]), row(2, [2], [3], [2.0], [2]), row(1, [2], [1], [4.0], [2])],
                                 pa.schema([("home", pa.int32()), ("part", pa.int32()), ("entries", pa.binary()), ("asked", pa.binary())]))
    out = {}
    for r in blocks.total(cells)(table).to_pylist():
        (ranks, cell, sums), _ = blocks.unpack(pa.chunked_array([pa.array([r["entries"]])]), "ranks", "cells", "sums")
        assert r["home"] not in out
        out[r["home"]] = list(zip(ranks.tolist(), cell.tolist(), sums.tolist()))
    assert out[1] == out[None] == [(0, 0, 0.5), (2, 1, 4.0), (2, 3, 3.0)] and out[2] == [(2, 1, 4.0), (2, 3, 3.0)]


def test_naive_bayes_by_arrays_equals_that_by_rows(spark):
    rows = [(i, t, None if j % 40 == 3 else j % 3, j % 2) for j, (i, t) in enumerate(zip(IDS, TEXTS))]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, label_idx INT, fold INT")
    settings = T.TfidfSettings(min_df=1, partitions=3)
    fitted = T.fit_in_blocks(docs, settings, keep=("label_idx", "fold"))
    features, size = fitted.features(), fitted.size()
    asked = fitted.docs.select("*", F.lit(True).alias("learn"), F.lit(True).alias("ask"))
    # One row a document, and nothing but a row per block and part moves.
    assert fitted.docs.count() < features.count() / 3 and fitted.parts.count() <= 3
    for cands in (B.grid("multinomial"), B.grid("complement")):
        model = B.fit_in_blocks(fitted, asked, docs, size, 2)
        assert model.sums.count() <= 3 * 3 + 3
        found = []
        for scores in (B.score_in_blocks(model, docs, cands), B.score(B.fit_bayes(features, docs, size, 2), features, docs, cands)):
            found.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["candidate"], r["pred_idx"], round(r["score"], 7)) for r in scores.collect()))
        assert found[0] == found[1] and len(found[0]) == len(rows) * len(cands)
    whole, plain = B.fit_in_blocks(fitted, asked, docs, size), B.fit_bayes(features, docs, size)
    number = {r["number"]: r["term"] for r in fitted.numbered().collect()}

    def told(terms, name):
        return {(name(r["term"]), c["label_idx"], round(c["sums"][0], 9)) for r in terms.collect() for c in r["classes"]}

    assert told(whole.terms(), str) == told(plain.terms, number.get)


def test_postings_are_stored_by_document_and_spelled_without_being_shuffled(spark):
    rows = [(1, "red green red"), (1, "blue red"), (None, "green blue"), (3, None), (4, "red green blue"), (None, "green red")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    weights, vocab = T.fit_transform_tfidf(docs, T.TfidfSettings(partitions=3, min_df=2, max_df=1.0))
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()
    # A row for each document with terms and one for each block, not one for each posting.
    assert spark.read.parquet(*weights.inputFiles()).count() <= 4 + 3 < weights.count()
    known = {r["term"] for r in vocab.collect()}
    found = {(r["doc_id"], r["term"]) for r in weights.collect()}
    assert {t for _, t in found} == known and (None, "green") in found and (1, "red") in found and not [i for i, _ in found if i == 3]


@pytest.mark.parametrize("stored", [True, False])
def test_vectors_are_made_in_their_block(spark, stored):
    texts = spark.createDataFrame([*enumerate(TEXTS), (None, "aa bb")], "doc_id LONG, text STRING")
    settings = T.TfidfSettings(partitions=3)
    docs = spark.createDataFrame([(i, i % 3, "a") for i in [*range(len(TEXTS)), 7, 999]] + [(None, 0, "b")], "doc_id LONG, label_idx INT, split STRING")
    features, vocab = T.fit_transform_tfidf(texts, settings)
    keep = ("doc_id", "split")
    fitted = T.fit_in_blocks(texts, settings)
    got = M.sparse_input_in_blocks(fitted, docs, 3, keep=keep, stored=stored)
    if not stored:
        # The labels go to the blocks; documents stay where they are.
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1

    def rows(vectors):
        return sorted(((str(r.doc_id), r.split, r.label, r.features.size, sorted(round(float(v), 9) for v in r.features.values)) for r in vectors.collect()))

    assert got.columns == ["doc_id", "split", "label", "features"] and rows(got) == rows(M.sparse_input(features, vocab, docs, 3, keep=keep))
    assert all((r.features.indices[1:] > r.features.indices[:-1]).all() for r in got.collect())
    with pytest.raises(ValueError, match="too large"):
        M.sparse_input_in_blocks(fitted, docs, 3, max_coefficients=10)


def test_parts_without_sums_and_blocks_without_questions(spark):
    cells = blocks.Cells((0, 1), 0)
    one = {"ranks": np.array([3], np.int64), "cells": np.array([1], np.int16), "sums": np.array([0.5])}
    none = {c: v[:0] for c, v in one.items()}
    for entries, want in ((one, [0.0, 0.5]), (none, [0.0, 0.0])):
        table = pa.table({"home": [7], "part": [2], "entries": [blocks.pack(**entries)], "asked": [blocks.pack(ranks=np.array([3], np.int64))]})
        out = blocks.total(cells)(table)
        assert out.column("totals").type == pa.list_(pa.float64()) and out.column("totals")[0].as_py() == want
    rows = pa.table({"doc_id": pa.array([], pa.int64()), "fold": pa.array([], pa.int32()), "terms": pa.array([], pa.list_(pa.int64())),
                     "tfs": pa.array([], pa.list_(pa.int32())), "dfs": pa.array([], pa.list_(pa.int64())), "norm": pa.array([], pa.float64())})
    answers = pa.table({"part": [2], "entries": [blocks.pack(**one)]})
    out = blocks.doc_sums(cells, [("multinomial", 1.0)], 5, True)(rows, answers)
    assert out.schema.field("w").type == pa.float64() and out.schema.field("g").type == pa.list_(pa.float64())


def test_few_training_rows_in_many_blocks(spark):
    docs = spark.createDataFrame([(i, f"aa{i % 7} bb{i % 5} cc{i % 3}", i % 2, "train" if i < 2 else "test", None) for i in range(60)],
                                 "doc_id LONG, text STRING, label_idx INT, split STRING, fold INT")
    fitted = T.fit_in_blocks(docs, T.TfidfSettings(partitions=40), keep=("label_idx", "split", "fold"))
    rows = fitted.docs.select("*", (F.col("split") == "train").alias("learn"), (F.col("split") == "test").alias("ask"))
    model = B.fit_in_blocks(fitted, rows, docs.where("split = 'train'"), fitted.size())
    found = B.score_in_blocks(model, docs.where("split = 'test'"), [B.Candidate(0)]).count()
    assert found == 58 and model.terms().count() == len({t for i in range(2) for t in (f"aa{i} bb{i}", f"bb{i} cc{i}", f"aa{i}", f"bb{i}", f"cc{i}")})


def test_known_terms_find_their_parts(spark):
    """Terms come to documents as postings of ``transform_tfidf`` do, with other documents than those that were fitted, and stay in buckets by id."""
    settings = T.TfidfSettings(stop_words=("the",), ngram_range=(1, 3), partitions=5)
    fit_on = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id LONG, text STRING")
    docs = spark.createDataFrame([(i, t and t + " new bb") for i, t in enumerate(TEXTS[:60])] + [(3, "aa bb"), (None, "aa"), (None, "bb"), (500, "new")],
                                 "doc_id LONG, text STRING")
    vocab = T.fit_tfidf(fit_on, settings)
    fitted = {r["term"]: (r["df"], round(r["idf"], 9)) for r in vocab.collect()}
    assert {r["term"]: (r["df"], round(r["idf"], 9)) for r in T.fit_vocabulary_in_blocks(fit_on, settings).collect()} == fitted
    for known in (vocab, vocab.where("term < ''")):
        want = {(r.doc_id, r.term): round(r.weight, 9) for r in T.transform_tfidf(docs, known, settings).collect()}
        got = T.transform_in_blocks(docs, known, settings)
        assert {(r.doc_id, r.term): round(r.weight, 9) for r in got.select("doc_id", F.inline("terms")).collect()} == want
        assert got.count() == len({i for i, _ in want})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = docs.select("doc_id").join(got, "doc_id", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1
