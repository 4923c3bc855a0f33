"""Spark ML classifiers: registry, grids, macro-F1 cross-validation, persistence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators import blocks, forest, hinge
from labelloom.operators.evaluation import check_scoring, metrics
from labelloom.operators.stages import VectorBayes
from labelloom.operators.tfidf import Blocks, home
from labelloom.session import fresh_path, materialize

# The parameter grids of the five classifiers.
GRIDS: dict[str, dict[str, list]] = {
    "nb": {"alpha": [0.01, 0.1, 0.5, 1.0]},
    "complement_nb": {"alpha": [0.01, 0.1, 0.5, 1.0], "norm": [False, True]},
    "logreg": {"C": [0.1, 1.0, 10.0]},
    "linear_svm": {"C": [0.1, 1.0, 10.0]},
    "random_forest": {"n_estimators": [200], "max_features": ["sqrt", "log2"], "min_samples_leaf": [1, 5]},
}
NON_NEGATIVE = ("nb", "complement_nb")

# The most that Spark ML's trees grow.
MAX_DEPTH = 30


def check_compatible(model: str, dense_features: bool) -> None:
    if dense_features and model in NON_NEGATIVE:
        raise ValueError(f"model {model!r} needs non-negative features and cannot use dense embeddings; "
                         "use logreg, linear_svm or random_forest")


class PenaltyByC(Estimator):
    """A linear classifier penalized by C: ``regParam = 1 / (C * rows)`` for the rows it is fitted on.

    So the same C means the same thing in a fold and in the final fit.
    """

    C = Param(Params._dummy(), "C", "inverse strength of the penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, make: Callable[[float], Estimator] | None = None):
        super().__init__()
        self.make = make
        self._setDefault(C=1.0)

    def _fit(self, dataset: DataFrame):
        return self.make(1.0 / (self.getOrDefault(self.C) * max(dataset.count(), 1))).fit(dataset)


class HingeByC(Estimator):
    """A linear classifier with hinge loss, each class against the rest, penalized as above; see ``hinge``."""

    C = PenaltyByC.C

    def __init__(self):
        super().__init__()
        self._setDefault(C=1.0)

    def _fit(self, dataset: DataFrame):
        return hinge.fit(dataset, [(self.getOrDefault(self.C), None)])[0]


def _logreg() -> PenaltyByC:
    return PenaltyByC(make=lambda reg: LogisticRegression(family="multinomial", regParam=reg, standardization=False, maxIter=1000))


def _forest() -> RandomForestClassifier:
    # Depth is unlimited in the models compared with; 30 is the most Spark grows.
    return RandomForestClassifier(numTrees=100, featureSubsetStrategy="sqrt", minInstancesPerNode=1, maxDepth=MAX_DEPTH, seed=0)


@dataclass
class ModelSpec:
    """An estimator by name, with its grid in the names of that estimator."""

    name: str
    make: Callable[[], Estimator]
    params: dict[str, str] = field(default_factory=dict)


MODELS: dict[str, ModelSpec] = {
    "logreg": ModelSpec("logreg", _logreg, {"C": "C"}),
    "linear_svm": ModelSpec("linear_svm", HingeByC, {"C": "C"}),
    "random_forest": ModelSpec("random_forest", _forest, {
        "n_estimators": "numTrees", "max_features": "featureSubsetStrategy", "min_samples_leaf": "minInstancesPerNode"}),
    "nb": ModelSpec("nb", lambda: VectorBayes(smoothing=1.0), {"alpha": "smoothing"}),
    "complement_nb": ModelSpec("complement_nb", lambda: NaiveBayes(modelType="complement", smoothing=1.0), {"alpha": "smoothing"}),
}


def make_model(name: str) -> Estimator:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return MODELS[name].make()


def build_pipeline(name: str) -> Pipeline:
    return Pipeline(stages=[make_model(name)])


def expand_grid(grid: dict[str, list]) -> list[dict]:
    """All combinations in grid order (the last name varies fastest); lists become tuples."""
    combos: list[dict] = [{}]
    for key, values in grid.items():
        values = [tuple(v) if isinstance(v, list) else v for v in values]
        combos = [c | {key: v} for c in combos for v in values]
    return combos


def param_maps(name: str, estimator: Estimator, grid: dict[str, list] | None = None) -> list[dict]:
    builder = ParamGridBuilder()
    for key, values in (GRIDS[name] if grid is None else grid).items():
        builder = builder.addGrid(estimator.getParam(MODELS[name].params[key]), values)
    return builder.build()


class HeldOut(Evaluator):
    """A held-out score by name: accuracy, or F1 over the classes seen in truth or prediction."""

    def __init__(self, scoring: str = "f1_macro"):
        super().__init__()
        check_scoring(scoring)
        self.scoring = scoring

    def _evaluate(self, dataset: DataFrame) -> float:
        preds = dataset.select(F.col("label").cast("int").alias("true_idx"), F.col("prediction").cast("int").alias("pred_idx"))
        return float(metrics(preds).first()[self.scoring])

    def isLargerBetter(self) -> bool:
        return True


def dense_input(vectors: DataFrame) -> DataFrame:
    """``doc_id, [fold], label, features`` of rows with ``label_idx, embedding``."""
    keep = [c for c in ("doc_id", "fold") if c in vectors.columns]
    return vectors.select(*keep, F.col("label_idx").cast("double").alias("label"),
                          array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def number_terms(vocab: DataFrame, buckets: int = 4096) -> DataFrame:
    """``term, idx``: every term gets a place from 0, without sorting the vocabulary in one task.

    Places are counted within hash buckets and shifted by the sizes of the
    buckets before.
    """
    placed = vocab.select("term", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("_b"))
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_b")) - F.col("_n")
    inside = F.row_number().over(W.partitionBy("_b").orderBy("term")) - 1
    return placed.withColumn("_i", inside).join(sizes.select("_b", before.alias("_s")), "_b").select(
        "term", (F.col("_s") + F.col("_i")).cast("int").alias("idx"))


def sparse_input(features: DataFrame, vocab: DataFrame, docs: DataFrame, n_classes: int,
                 max_coefficients: int | None = None, keep: tuple[str, ...] = ("doc_id", "fold")) -> DataFrame:
    """``doc_id, [fold], label, features`` with one sparse vector per document.

    ``features``: doc_id, term, weight; ``docs``: doc_id, label_idx, [fold], also
    those without terms. Written once and read back with the vector type. A
    linear model keeps classes x terms coefficients on the driver: bound them by
    ``min_df``, or set ``max_coefficients`` to be refused instead.
    """
    size = vocab.count()
    _check_size(size, n_classes, max_coefficients)
    spark = features.sparkSession
    entries = features.select("doc_id", "term", "weight").join(number_terms(vocab), "term").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("e"))
    keep = [c for c in keep if c in docs.columns]
    rows = docs.select(*keep, F.col("label_idx").cast("double").alias("label")).join(entries, "doc_id", "left")
    none = F.array().cast("array<struct<idx:int,weight:double>>")
    e = F.coalesce("e", none)
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
                      F.transform(e, lambda x: x["idx"]).alias("indices"), F.transform(e, lambda x: x["weight"]).alias("values"))
    path = fresh_path(spark, "sparse-vectors")
    out = rows.select(*keep, "label", vector.alias("features"))
    out.write.parquet(path)
    schema = T.StructType([f for f in out.schema if f.name != "features"] + [T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)


def sparse_input_in_blocks(fitted: Blocks, docs: DataFrame, n_classes: int, max_coefficients: int | None = None,
                           keep: tuple[str, ...] = ("doc_id", "fold"), stored: bool = True) -> DataFrame:
    """As ``sparse_input``, of documents in blocks, which have no columns of their own: the rows of ``docs`` go to them, and no posting is moved.

    Not ``stored``, vectors are made as they are read, which takes no room beside the blocks but a pass of its own each time.
    """
    spark = docs.sparkSession
    sizes = {r["part"]: r["n"] for r in fitted.parts.select("part", F.size("terms").alias("n")).collect()}
    size = sum(sizes.values())
    _check_size(size, n_classes, max_coefficients)
    places = [sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)]
    before = [sum(places[:p]) for p in range(len(places))]
    names = [c for c in dict.fromkeys(("doc_id", *keep)) if c in docs.columns]
    docs = docs.select(*names, F.col("label_idx").cast("double").alias("label"))
    asked = docs.withColumn("home", home("doc_id", fitted.homes))
    task = blocks.vectors([*names, "label"], size, before, fitted.n_docs, fitted.settings.sublinear_tf)
    schema = T.StructType([*docs.schema.fields, T.StructField("features", VectorUDT())])
    # Grouped by nothing but their bucket, documents stay where they are, whoever plans the reading.
    rows = fitted.docs.select("home", "doc_id", "terms", "tfs", "dfs", "norm").groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(task, schema)
    rows = rows.select(*(c for c in keep if c in names), "label", "features")
    return materialize(rows, "sparse-vectors", compression="zstd") if stored else rows


def _check_size(size: int, n_classes: int, max_coefficients: int | None) -> None:
    if max_coefficients is not None and size * n_classes > max_coefficients:
        raise ValueError(f"{size} terms x {n_classes} classes is too large for a model kept on the driver; "
                         "raise min_df or use the Naive Bayes of this package")


@dataclass
class Tuned:
    model: object
    best_params: dict | None
    best_mean: float | None
    best_std: float | None


def tune(train: DataFrame, name: str, *, n_folds: int, smallest_class: int, grid: dict[str, list] | None = None,
         parallelism: int = 4, scoring: str = "f1_macro") -> Tuned:
    """Grid search by ``scoring`` over given folds, then a refit on all rows of the best candidate.

    With fewer rows in the smallest class than folds, tuning is skipped and the
    defaults are fitted. ``train`` should be a stored table, as it is read once
    per fit.
    """
    estimator = make_model(name)
    if name == "random_forest":
        return _tune_forest(train, estimator, n_folds=n_folds, tuned=smallest_class >= n_folds, grid=grid, scoring=scoring)
    if smallest_class < n_folds:
        return Tuned(estimator.fit(train), None, None, None)
    maps = param_maps(name, estimator, grid)
    if name == "linear_svm":
        return _tune_hinge(train, estimator, maps, n_folds=n_folds, scoring=scoring)
    search = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=HeldOut(scoring), numFolds=n_folds,
                            foldCol="fold", parallelism=parallelism).fit(train)
    best = max(range(len(maps)), key=lambda i: (round(search.avgMetrics[i], 9), -i))
    back = {v: k for k, v in MODELS[name].params.items()}
    params = {back[p.name]: v for p, v in maps[best].items()}
    return Tuned(search.bestModel, params, search.avgMetrics[best], search.stdMetrics[best])


def _tune_hinge(train: DataFrame, estimator: HingeByC, maps: list[dict], *, n_folds: int, scoring: str) -> Tuned:
    """All candidates and folds are fitted side by side."""
    wanted = [(float(m.get(estimator.C, estimator.getOrDefault(estimator.C))), fold) for m in maps for fold in range(n_folds)]
    outside = train.where(F.col("fold").isNull() | (F.col("fold") < 0) | (F.col("fold") >= n_folds))
    if outside.limit(1).count():
        raise ValueError(f"folds are not all in 0 to {n_folds - 1}")
    scores = [HeldOut(scoring).evaluate(model.transform(train.where(F.col("fold") == fold)))
              for model, (_, fold) in zip(hinge.fit(train, wanted), wanted)]
    scores = [scores[i:i + n_folds] for i in range(0, len(scores), n_folds)]
    means = [sum(s) / n_folds for s in scores]
    best = max(range(len(maps)), key=lambda i: (round(means[i], 9), -i))
    std = (sum((x - means[best]) ** 2 for x in scores[best]) / n_folds) ** 0.5
    params = {p.name: v for p, v in maps[best].items()}
    return Tuned(estimator.copy(maps[best]).fit(train), params, means[best], std)


def _tune_forest(train: DataFrame, estimator, *, n_folds: int, tuned: bool, grid: dict[str, list] | None, scoring: str) -> Tuned:
    """Each forest in stored groups of trees: the driver holds as many groups at a time as it has room for."""
    if not tuned:
        return Tuned(forest.grow(train, estimator), None, None, None)
    maps = param_maps("random_forest", estimator, grid)
    scores = forest.cross_validate(train, [estimator.copy(m) for m in maps], n_folds=n_folds, scoring=scoring)
    means = [sum(s) / len(s) for s in scores]
    best = max(range(len(maps)), key=lambda i: (round(means[i], 9), -i))
    back = {v: k for k, v in MODELS["random_forest"].params.items()}
    std = (sum((x - means[best]) ** 2 for x in scores[best]) / len(scores[best])) ** 0.5
    return Tuned(forest.grow(train, estimator.copy(maps[best])), {back[p.name]: v for p, v in maps[best].items()}, means[best], std)


def predict(model, data: DataFrame) -> DataFrame:
    """``doc_id, true_idx, pred_idx`` of held-out rows."""
    return model.transform(data).select("doc_id", F.col("label").cast("int").alias("true_idx"),
                                        F.col("prediction").cast("int").alias("pred_idx"))


def save_model(model, path: str) -> None:
    """A fitted model, or the fitted stages of a pipeline in their order."""
    PipelineModel(stages=model if isinstance(model, list) else [model]).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
