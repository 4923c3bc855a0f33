"""The hinge solver next to Spark's, and the jobs that a search takes."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelloom.operators import hinge
from labelloom.operators import models as M


def rows(spark, sparse, n=90, size=6):
    """Three classes in three folds; one number is the same everywhere, one outside fold 0 only."""
    draw = np.random.default_rng(7)
    x = np.round(draw.normal(size=(n, size)), 3) * (draw.random((n, size)) < 0.6)
    y = draw.integers(0, 3, n)
    x[:, 0] += y
    x[:, 4], x[:, 5] = 0.1, np.where(np.arange(n) % 3 == 0, x[:, 5], 0.0)
    vector = (lambda v: Vectors.sparse(size, [(int(i), float(v[i])) for i in np.flatnonzero(v)])) if sparse else Vectors.dense
    return spark.createDataFrame([(i, i % 3, float(y[i]), vector(x[i])) for i in range(n)], ["doc_id", "fold", "label", "features"])


@pytest.fixture(autouse=True)
def few_steps(monkeypatch):
    monkeypatch.setattr(hinge, "MAX_ITER", 12)


@pytest.mark.parametrize("sparse", [False, True])
def test_weights_are_those_of_linear_svc(spark, sparse):
    data = rows(spark, sparse).repartition(3, "doc_id").cache()
    wanted = [(1.0, None), (0.5, 0)]
    for (c, fold), model in zip(wanted, hinge.fit(data, wanted)):
        part = data if fold is None else data.where(F.col("fold") != fold)
        theirs = OneVsRest(classifier=LinearSVC(regParam=1.0 / (c * part.count()), standardization=False, maxIter=12)).fit(part)
        assert len(model.models) == 3
        for a, b in zip(model.models, theirs.models):
            assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=1e-6) and abs(a.intercept - b.intercept) < 1e-6


def test_a_search_does_not_take_jobs_for_each_problem(spark):
    data = rows(spark, False).coalesce(1).cache()
    total = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = total()
    tuned = M.tune(data, "linear_svm", n_folds=3, smallest_class=3)
    assert set(tuned.best_params) == {"C"} and total() - before < 300


def test_problems_that_the_driver_has_no_room_for_wait(spark, monkeypatch):
    data = rows(spark, False)
    whole = hinge.fit(data, [(1.0, None)])[0]
    monkeypatch.setattr(hinge, "DRIVER_NUMBERS", 1)
    monkeypatch.setattr(hinge, "SUM_NUMBERS", 1)
    monkeypatch.setattr(hinge, "STEP_NUMBERS", 7)
    for a, b in zip(whole.models, hinge.fit(data, [(1.0, None)])[0].models):
        assert np.allclose(a.coefficients.toArray(), b.coefficients.toArray(), atol=1e-6)


def test_a_saved_model_is_read_back(spark, tmp_path):
    data = rows(spark, False)
    model = M.make_model("linear_svm").fit(data)
    M.save_model(model, str(tmp_path / "m"))
    a, b = (sorted(map(tuple, M.predict(m, data).collect())) for m in (model, M.load_model(str(tmp_path / "m"))))
    assert a == b and len(a) == 90
