import math

import pytest
from pyspark.sql import functions as F

from labelloom.operators import evaluation as E

LABELS = [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
CASES = {
    "all correct": [(0, 0), (1, 1), (2, 2), (2, 2)],
    "a class never predicted": [(0, 0), (1, 0), (2, 2), (2, 0)],
    "predicted but never true": [(0, 3), (0, 0), (1, 1), (1, 3)],
    "some unparseable": [(0, 0), (1, None), (2, 1), (3, 3), (3, None)],
    "nothing scored": [(0, None), (1, None)],
}


def brute(pairs):
    done = [(t, p) for t, p in pairs if p is not None]
    per = {}
    for c in range(4):
        tp = sum(t == p == c for t, p in done)
        n_true, n_pred = sum(t == c for t, _ in done), sum(p == c for _, p in done)
        div = lambda a, b: a / b if b else 0.0
        per[c] = (div(tp, n_pred), div(tp, n_true), div(2 * tp, n_true + n_pred), n_true, n_pred)
    seen = [v for v in per.values() if v[3] + v[4]]
    n = len(done)
    return per, (sum(t == p for t, p in done) / n if n else 0.0, sum(v[2] for v in seen) / len(seen) if seen else 0.0,
                 sum(v[2] * v[3] for v in seen) / n if n else 0.0)


@pytest.fixture(params=CASES, ids=lambda k: k.replace(" ", "-"))
def case(request, spark):
    pairs = CASES[request.param]
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(pairs)], "doc_id LONG, true_idx INT, pred_idx INT")
    return pairs, df, spark.createDataFrame(LABELS, "label_idx INT, label_name STRING")


def close(a, b):
    return all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a, b))


def test_metrics_and_report(case):
    pairs, df, labels = case
    per, total = brute(pairs)
    assert close(E.metrics(df).first(), total)
    for r in E.class_report(df, labels).collect():
        assert close((r["precision"], r["recall"], r["f1"], r["support"]), per[r["label_idx"]][:4])
    present = {r["label_idx"] for r in E.class_report(df, labels, present_only=True).collect()}
    assert present == {c for c, v in per.items() if v[3] + v[4]}


def test_report_averages(case):
    pairs, df, labels = case
    per, (acc, _, weighted) = brute(pairs)
    rows = {r["label"]: r for r in E.full_report(df, labels).collect()}
    assert len(rows) == 7
    assert math.isclose(rows["accuracy"]["f1"], acc, abs_tol=1e-12)
    assert math.isclose(rows["macro avg"]["f1"], sum(v[2] for v in per.values()) / 4, abs_tol=1e-12)
    assert math.isclose(rows["weighted avg"]["f1"], weighted, abs_tol=1e-12)


def test_confusion_matrix_is_complete(case):
    pairs, df, labels = case
    cm = {(r["true_idx"], r["pred_idx"]): r["n"] for r in E.confusion_matrix(df, labels).collect()}
    assert cm == {(t, p): pairs.count((t, p)) for t in range(4) for p in range(4)}
    shares = {(r["true_idx"], r["pred_idx"]): r["share"] for r in E.row_normalized(E.confusion_matrix(df, labels)).collect()}
    for (t, p), n in cm.items():
        total = sum(cm[t, q] for q in range(4))
        assert shares[t, p] is None if total == 0 else math.isclose(shares[t, p], n / total)


def test_store_metrics_and_coverage(case):
    pairs, df, labels = case
    _, total = brute(pairs)
    row = E.store_metrics(df).first()
    scored = sum(p is not None for _, p in pairs)
    assert tuple(row[:3]) == (len(pairs), scored, len(pairs) - scored) and close(row[3:], total)
    store = df.withColumn("correct", E.correct_flag(F.col("true_idx"), F.col("pred_idx")))
    for r in E.coverage(store, labels).collect():
        mine = [p for t, p in pairs if t == r["true_idx"]]
        ok, bad = sum(p == r["true_idx"] for p in mine), sum(p is None for p in mine)
        assert (r["n"], r["correct"], r["unparseable"]) == (len(mine), ok, bad)
        assert r["acc"] == (round(ok / len(mine), 3) if mine else None)


def test_empty_store(spark):
    empty = spark.createDataFrame([], "true_idx INT, pred_idx INT")
    assert tuple(E.store_metrics(empty).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_best_candidate_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(0, 0, .5), (0, 1, .7), (1, 0, .6), (1, 1, .6), (2, 0, .1), (2, 1, .2)], "candidate INT, fold INT, f1_macro DOUBLE")
    best = E.best_candidate(E.candidate_scores(df)).first()
    assert best["candidate"] == 0 and math.isclose(best["std_score"], 0.1)
