"""Feature-based experiments: split, featurize once, tune, score, record."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators import bayes, evaluation as E, models, tuning
from labelloom.operators.inference import EncoderFn, embed
from labelloom.operators.sampling import check_split, pick_per_class, stratified_folds, stratified_split
from labelloom.operators.stages import BayesModel, TfidfModel
from labelloom.operators.tfidf import TfidfSettings, fit_in_blocks, fit_transform_tfidf, home, save_vocabulary
from labelloom.session import materialize
from labelloom.sources.corpus import label_dictionary, with_label_index
from labelloom.sources.runs import write_run

_BAYES = {"nb": "multinomial", "complement_nb": "complement"}


@dataclass(frozen=True)
class Encoder:
    """An injected encoder and its settings."""

    fn: EncoderFn
    model_id: str
    cache_path: str
    prefix: str = ""
    normalize: bool = True


@dataclass(frozen=True)
class VectorSettings:
    model: str = "nb"
    featurizer: str = "tfidf"
    data: str = "corpus"
    seed: int = 42
    test_size: float = 0.2
    n_per_category: int | None = None
    n_folds: int = 3
    scoring: str = "f1_macro"

    @property
    def run_name(self) -> str:
        return f"{self.model}_{self.featurizer}_{self.data}_n{self.n_per_category}"


def run_vector(corpus: DataFrame, settings: VectorSettings, runs: str, *, encoder: Encoder | None = None,
               tfidf: TfidfSettings = TfidfSettings(), grid: dict | None = None) -> dict:
    """One experiment on ``doc_id, text, label_name``; returns the record it wrote.

    Features are made once for the whole corpus and written; the training part
    and its folds are chosen by comparing hashes, without moving the corpus.
    """
    spark = corpus.sparkSession
    models.check_compatible(settings.model, encoder is not None)
    models.check_scoring(settings.scoring)
    labels = label_dictionary(corpus)
    n_classes = labels.count()
    ids = stratified_split(with_label_index(corpus.select("doc_id", "label_name"), labels),
                           test_size=settings.test_size, seed=settings.seed)
    ids = materialize(ids, "split")
    test = ids.where(F.col("split") == "test")
    train = pick_per_class(ids.where(F.col("split") == "train"), settings.n_per_category, seed=settings.seed)
    train = materialize(stratified_folds(train, settings.n_folds, seed=settings.seed), "train")
    bounds = check_split(train, ids).first()
    if bounds["outside_train"] or bounds["inside_test"]:
        raise AssertionError("training rows leave the training part")
    smallest = E.smallest_class(train).first()["min_class_count"]
    n_train, n_test = train.count(), test.count()
    folder = f"{runs.rstrip('/')}/{settings.run_name}"

    tfidf_info = embed_info = None
    if encoder is not None:
        started = time.perf_counter()
        vectors = embed(corpus.select("doc_id", "text"), encoder.fn, model_id=encoder.model_id,
                        cache_path=encoder.cache_path, prefix=encoder.prefix, normalize=encoder.normalize)
        vectors = materialize(vectors, "features")
        elapsed = time.perf_counter() - started
        facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.bool_and("cache_hit").alias("hit")).first()
        embed_info = {"model_id": encoder.model_id, "dim": facts["dim"], "cache_hit": facts["hit"],
                      "encode_seconds": elapsed, "docs_per_second": facts["n"] / max(elapsed, 1e-6)}
        fit_on = materialize(models.dense_input(train.join(vectors, "doc_id")), "train-vectors")
        held_out = models.dense_input(test.join(vectors, "doc_id"))
    else:
        if settings.model in _BAYES:
            fitted = fit_in_blocks(corpus, tfidf)
            homes, vocab = fitted.homes, fitted.vocabulary()
        else:
            features, vocab = fit_transform_tfidf(corpus, tfidf)
        size = vocab.count()
        tfidf_info = {"vocab_size": size, "n_features": size}
        save_vocabulary(vocab, f"{folder}/vocabulary")

    best_params = cv = None
    if settings.model in _BAYES:
        def placed(ids, *columns):
            where = ids.select(home("doc_id", homes).alias("home"), "doc_id", *columns)
            return where.repartition(len(homes), "home").hint("shuffle_hash")

        # The ids go to the documents, which stay in their buckets.
        def rows(ids):
            return fitted.docs.join(placed(ids, *[c for c in ids.columns if c != "doc_id"]), ["home", "doc_id"])

        kind = _BAYES[settings.model]
        spec = grid or models.GRIDS[settings.model]
        candidates = bayes.grid(kind, tuple(spec["alpha"]), tuple(spec.get("norm", (False,))))
        best, mean, std = bayes.Candidate(0, kind), None, None
        if smallest >= settings.n_folds:
            best, mean, std = tuning.tune_bayes(fitted, rows(train.select("doc_id", "label_idx", "fold")), train, size, candidates,
                                                settings.n_folds, settings.scoring)
            best_params = best.params
        no_fold = F.lit(None).cast("int").alias("fold")
        sides = train.select("doc_id", "label_idx", no_fold, F.lit(True).alias("learn"), F.lit(False).alias("ask")).unionByName(
            test.select("doc_id", "label_idx", no_fold, F.lit(False).alias("learn"), F.lit(True).alias("ask")))
        model = bayes.fit_in_blocks(fitted, rows(sides), train, size)
        preds = bayes.score_in_blocks(model, test, [best]).join(test.select("doc_id", F.col("label_idx").alias("true_idx")), "doc_id")
        # From text to class, as one model that load_model reads back.
        models.save_model([TfidfModel(vocab).take(tfidf), BayesModel(model.terms(), model.classes, size).take(best)], f"{folder}/best_model")
    else:
        if encoder is None:
            # One table of vectors for both parts: rows outside the training pick have no fold.
            sides = train.select("doc_id", "label_idx", "fold", F.lit("train").alias("side")).unionByName(
                test.select("doc_id", "label_idx", F.lit(None).cast("int").alias("fold"), F.lit("test").alias("side")))
            vectors = models.sparse_input(features, vocab, sides, n_classes, keep=("doc_id", "fold", "side"))
            fit_on = vectors.where("side = 'train'").drop("side")
            held_out = vectors.where("side = 'test'").drop("side", "fold")
        tuned = models.tune(fit_on, settings.model, n_folds=settings.n_folds, smallest_class=smallest, grid=grid, scoring=settings.scoring)
        best_params, mean, std = tuned.best_params, tuned.best_mean, tuned.best_std
        preds = models.predict(tuned.model, held_out)
        models.save_model(tuned.model, f"{folder}/best_model")
    if best_params is not None:
        cv = {"n_splits": settings.n_folds, "scoring": settings.scoring, "best_score_mean": mean, "best_score_std": std}
    preds = materialize(preds.select("doc_id", "true_idx", "pred_idx"), "predictions")
    m = E.metrics(preds).first()
    record = {
        "run_name": settings.run_name, "kind": "vector_cv", "model": settings.model, "featurizer": settings.featurizer,
        "data": settings.data, "n_train": n_train, "n_test": n_test, "n_per_category": settings.n_per_category,
        "n_classes": n_classes, "best_params": best_params and {k: str(v) for k, v in best_params.items()}, "cv": cv,
        "test": m.asDict(), "embedding": embed_info, "tfidf": tfidf_info,
    }
    write_run(spark, folder, record, config=asdict(settings), labels=labels, report=E.full_report(preds, labels),
              confusion=E.confusion_matrix(preds, labels))
    return record
