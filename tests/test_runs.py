import json

import pytest
from pyspark.sql import functions as F

from labelloom.operators import boards as B
from labelloom.sources import runs as U
from labelloom.sources import sidecars as C
from labelloom.sources import store as S


def put(root, name, record=None, config=None):
    folder = root / name
    folder.mkdir(parents=True)
    if record is not None:
        (folder / "metrics.json").write_text(record if isinstance(record, str) else json.dumps(record, indent=2))
    if config is not None:
        (folder / "config.yaml").write_text(config)


TEST = {"accuracy": 0.5, "f1_macro": 0.4, "f1_weighted": 0.45}


@pytest.fixture
def root(tmp_path):
    put(tmp_path, "vec_n4", {"kind": "vector_cv", "model": "logreg", "featurizer": "bge", "data": "d", "n_train": 80, "n_test": 10,
                             "n_per_category": 4, "n_classes": 20, "best_params": {"clf__C": 10.0}, "test": TEST | {"f1_macro": 0.9},
                             "cv": {"n_splits": 3, "scoring": "f1_macro", "best_score_mean": 0.7, "best_score_std": 0.01}})
    put(tmp_path, "vec_all", {"kind": "vector_cv", "model": "nb", "featurizer": "tfidf", "data": "d", "n_train": 90, "n_test": 10,
                              "n_per_category": None, "n_classes": 20, "test": TEST, "best_params": None, "cv": None})
    put(tmp_path, "zero", {"kind": "llm_zero_shot", "model": "q", "featurizer": "s", "data": "d", "n_test": 10, "n_classes": 20, "test": TEST,
                           "few_shot": {"n_per_category": 0}, "llm": {"tag": "q:1", "fraction": 0.25, "n_unparseable": 2}},
        "prompts: {name: zero_shot_v1}\nfraction: 0.9\n")
    put(tmp_path, "few", {"kind": "llm_few_shot", "model": "q", "featurizer": "s", "data": "d", "n_test": 10, "n_classes": 20, "test": TEST,
                          "few_shot": {"n_per_category": 2}, "prompts": {"name": "few_shot_v1"}, "llm": {"tag": "q:1", "fraction": 0.25}})
    put(tmp_path, "legacy", {"model": "svm", "featurizer": "tfidf", "data": "d", "n_train": 100, "n_test": 10, "n_classes": 20, "test": TEST,
                             "nested_cv": {"summary": {"f1_macro": {"mean": 0.3, "std": 0.02}, "accuracy": {"mean": 0.33}}}})
    put(tmp_path, "config_only_fields", {"model": "", "test": TEST, "llm": {"fraction": None}},
        "llm: {name: from_cfg, tag: t}\ndata: {name: cfgdata}\nn_per_category: 6\nfraction: 0.5\n")
    put(tmp_path, "bad_config", {"kind": "llm_zero_shot", "model": "q", "featurizer": "s", "data": "d", "test": TEST}, "a: [unclosed")
    put(tmp_path, "no_record", None, "fraction: 0.1\n")
    put(tmp_path, "_cache", {"model": "hidden", "featurizer": "x", "data": "d", "test": TEST})
    put(tmp_path / "_stores", "grown", {"kind": "llm_zero_shot", "model": "c", "featurizer": "s", "data": "d", "test": TEST,
                                        "few_shot": {"n_per_category": 0}})
    return tmp_path


def by_run(df):
    return {r["run"]: r for r in df.collect()}


def test_strict_scan(spark, root):
    runs = by_run(U.scan_runs(spark, str(root)))
    assert set(runs) == {"vec_n4", "vec_all", "zero", "few", "legacy", "config_only_fields", "bad_config"}
    assert runs["legacy"]["kind"] == "nested_cv" and runs["legacy"]["cv_f1_macro_std"] == 0.02
    assert runs["vec_n4"]["cv_f1_macro_mean"] == 0.7 and runs["vec_n4"]["best_params"] == {"clf__C": "10.0"}
    assert runs["zero"]["n_unparseable"] == 2 and runs["zero"]["cv_f1_macro_mean"] is None
    assert runs["vec_n4"]["path"].endswith("/vec_n4")


def test_strict_scan_fails_on_two_objects(spark, root):
    put(root, "two", json.dumps({"test": TEST}) + "\n" + json.dumps({"test": TEST}))
    with pytest.raises(Exception, match="malformed run record"):
        U.scan_runs(spark, str(root)).collect()


def test_lenient_scan(spark, root):
    put(root, "two", json.dumps({"test": TEST}) + "\n" + json.dumps({"test": TEST}))
    runs = by_run(U.scan_runs_lenient(spark, str(root)))
    assert "two" not in runs and "no_record" not in runs and "grown" in runs
    c = runs["config_only_fields"]
    assert (c["kind"], c["model"], c["data"], c["n_per_category"], c["summary_fraction"], c["llm_tag"]) == (
        "unknown", "from_cfg", "cfgdata", 6, None, "t")
    assert runs["zero"]["summary_fraction"] == 0.25 and runs["zero"]["prompts"] == "zero_shot_v1" and runs["zero"]["n_per_category"] == 0
    assert runs["legacy"]["kind"] == "nested_cv" and runs["bad_config"]["prompts"] is None


def test_families_boards_and_curves(spark, root):
    runs = B.with_family(U.scan_runs_lenient(spark, str(root)))
    r = by_run(runs)
    assert (r["vec_n4"]["family"], r["vec_n4"]["variant"], r["vec_n4"]["samples_per_category"]) == ("vector", "logreg+bge", 4.0)
    assert r["vec_all"]["samples_per_category"] == 4.5 and r["few"]["variant"] == "q|few_shot_v1"
    assert r["config_only_fields"]["family"] == "other" and r["config_only_fields"]["samples_per_category"] is None
    board = B.vector_board(runs).orderBy("place").collect()
    assert [b["run"] for b in board] == ["vec_n4", "vec_all", "legacy"]
    pts = by_run(B.curve_points(runs))
    assert set(pts) == {"vec_n4", "vec_all", "legacy", "few"} and pts["few"]["variant"] == "q / summary=0.25"
    assert not any(p["has_curve"] for p in pts.values())
    strict = U.scan_runs(spark, str(root))
    assert B.leaderboard(strict).first()["run"] == "vec_n4"
    assert {s["baseline_f1_macro"] for s in B.fraction_sweep(strict).collect()} == {0.9}
    pivot = {p["model"]: p.asDict() for p in B.score_pivot(strict.where("model <> ''")).collect()}
    assert pivot["logreg"]["bge"] == 0.9 and pivot["logreg"]["tfidf"] is None


def test_no_runs_at_all(spark, tmp_path):
    assert U.scan_runs(spark, str(tmp_path)).count() == 0
    assert U.scan_runs_lenient(spark, str(tmp_path)).count() == 0


def test_write_and_scan_run(spark, tmp_path):
    labels = spark.createDataFrame([(1, "b"), (0, "a")], "label_idx INT, label_name STRING")
    U.write_run(spark, f"{tmp_path}/r1", {"kind": "vector_cv", "model": "nb", "test": TEST, "n_train": 5}, config={"fraction": 0.1}, labels=labels)
    row = U.scan_runs(spark, str(tmp_path)).first()
    assert (row["run"], row["test_accuracy"], row["n_train"]) == ("r1", 0.5, 5)
    assert json.loads(spark.read.text(f"{tmp_path}/r1/target_names.json").first()[0]) == ["a", "b"]
    assert U.scan_runs_lenient(spark, str(tmp_path)).first()["summary_fraction"] == 0.1


ROW = {"test_idx": 1, "doc_sha1": "x", "true_idx": 0, "true_label": "a", "pred_label": None, "pred_idx": None, "correct": None, "summary": "s",
       "source_words": 3, "summary_words": 1, "fraction": 0.25, "few_shot_n": 0}


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_store_grows(spark, tmp_path, fmt):
    path = str(tmp_path / "store")
    assert S.read_store(spark, path, fmt=fmt).count() == 0
    one = spark.createDataFrame([ROW], S.PREDICTION)
    S.append_store(one, path, fmt)
    S.append_store(one.withColumn("test_idx", F.lit(2).cast("long")), path, fmt)
    assert {r["test_idx"] for r in S.read_store(spark, path, fmt=fmt).collect()} == {1, 2}
    if fmt == "json":
        assert all(set(json.loads(r[0])) == set(ROW) for r in spark.read.text(path).collect())


def test_store_reads_blank_lines_and_rejects_bad_ones(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text(json.dumps(ROW) + "\n\n   \n" + json.dumps(ROW | {"test_idx": 2}) + "\n")
    assert S.read_store(spark, str(good)).count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text(json.dumps(ROW) + "\n{oops\n")
    with pytest.raises(Exception):
        S.read_store(spark, str(bad)).collect()


def test_list_and_newest_store(spark, tmp_path):
    import os
    for i, name in enumerate(("old", "new")):
        (tmp_path / name).mkdir()
        f = tmp_path / name / "predictions.jsonl"
        f.write_text((json.dumps(ROW) + "\n") * (i + 1))
        os.utime(f, (1000 + i, 1000 + i))
    stores = S.list_stores(spark, f"{tmp_path}/*/predictions.jsonl")
    assert sorted(r["n"] for r in stores.collect()) == [1, 2]
    assert S.newest_store(stores).first()["store"].endswith("/new")


EXAMPLE = {"train_idx": 3, "label_idx": 0, "label_name": "a", "summary": "s"}


def test_sidecars(spark, tmp_path):
    def put_side(name, rows):
        (tmp_path / name).write_text(json.dumps(rows))
    put_side("q_7b__v1__frac0.25__n1__seed0.json", [EXAMPLE])
    put_side("q__x__v1__frac0.25__n2__seed0.json", [EXAMPLE, EXAMPLE | {"train_idx": 4}])
    put_side("zz__v1__frac0.25__n2__seed0.json", [EXAMPLE])
    put_side("notes.json", [])
    rows = {(r["model_tag"], r["n_per_category"]): r for r in C.scan_sidecars(spark, str(tmp_path)).collect()}
    assert set(rows) == {("q_7b", 1), ("q__x", 2), ("zz", 2)} and rows["q__x", 2]["n_examples"] == 2
    assert rows["q_7b", 1]["fraction"] == 0.25 and rows["q_7b", 1]["seed"] == 0 and rows["q_7b", 1]["prompt_version"] == "v1"
    assert {r["train_idx"] for r in C.load_sidecar(spark, str(tmp_path), 0.25, 2, 0).collect()} == {3, 4}
    with pytest.raises(KeyError):
        C.load_sidecar(spark, str(tmp_path), 0.5, 2, 0)
    assert C.scan_sidecars(spark, str(tmp_path / "missing")).count() == 0


def test_sidecar_write_read_and_scan(spark, tmp_path):
    name = C.sidecar_file(spark, model_tag="a/b:c", prompt_version="v1", fraction=0.25, n=1, seed=0, corpus="00ff")
    assert name == "a_b_c__v1__frac0.25__n1__seed0__corpus00ff.json"
    assert C.read_sidecar(spark, f"{tmp_path}/{name}") is None
    C.write_sidecar(spark.createDataFrame([tuple(EXAMPLE.values())], C.EXAMPLE), f"{tmp_path}/{name}")
    assert C.read_sidecar(spark, f"{tmp_path}/{name}").first().asDict() == EXAMPLE
    assert C.scan_sidecars(spark, str(tmp_path)).first()["n_examples"] == 1
