"""Growing an append-only prediction store: no document is ever scored twice."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators import evaluation as E
from labelloom.operators.inference import Backend, Meter
from labelloom.operators.joins import new_work
from labelloom.operators.profile import corpus_fingerprint
from labelloom.operators.sampling import pick_per_class
from labelloom.plans.prompted import Folders, PromptedSettings, example_text, prepare, score_rows
from labelloom.session import materialize
from labelloom.sources.runs import write_run
from labelloom.sources.store import append_batch, read_store


def score_new(selected: DataFrame, store_path: str, settings: PromptedSettings, backend: Backend, folders: Folders,
              labels: DataFrame, train: DataFrame | None, retry_null: bool = False, fmt: str = "json") -> int:
    """Score the selected documents that the store lacks and append them; returns their number."""
    known = store = read_store(selected.sparkSession, store_path, fmt=fmt)
    if retry_null:
        store = store.where(F.col("pred_idx").isNotNull())
    todo = materialize(new_work(selected, store), "new-work")
    n = todo.count()
    if n:
        block = example_text(train, settings, backend, folders)[0] if train is not None else ""
        # Named by the documents it holds and their earlier rows: the same work written twice is there once, a retry adds to it.
        tries = known.join(todo.select(F.col("doc_id").alias("test_idx")), "test_idx", "left_semi").count() if retry_null else 0
        batch = f"{corpus_fingerprint(todo).first()['fingerprint']}-{tries}"
        append_batch(score_rows(todo, settings, backend, folders, labels, block), store_path, batch, fmt)
    return n


def latest_rows(store: DataFrame) -> DataFrame:
    """One row per document: a parsed prediction before a failed one (a retry appends a second row)."""
    rest = [c for c in store.columns if c != "test_idx"]
    best = store.groupBy("test_idx").agg(F.max_by(F.struct(*rest), F.col("pred_idx").isNotNull()).alias("r"))
    return best.select("test_idx", *[F.col(f"r.{c}").alias(c) for c in rest])


def run_incremental(corpus: DataFrame, settings: PromptedSettings, backend: Backend, folders: Folders,
                    retry_null: bool = False, fmt: str = "json") -> dict:
    """Pick a number of test documents per class, score the new ones, report over the whole store.

    ``fmt`` is the store's form, JSON lines or Parquet. Usage is that of the calls of this run.
    """
    spark = corpus.sparkSession
    backend = replace(backend, meter=Meter())
    labels, train, test = prepare(corpus, settings)
    selected = pick_per_class(test, settings.test_per_category, seed=settings.seed, strict=settings.strict)
    folder = f"{folders.runs.rstrip('/')}/_stores/{settings.run_name}"
    added = score_new(selected, f"{folder}/predictions", settings, backend, folders, labels, train, retry_null, fmt)
    m = E.store_metrics(latest_rows(read_store(spark, f"{folder}/predictions", fmt=fmt))).first()
    record = {
        "run_name": settings.run_name, "kind": settings.kind, "model": settings.model, "featurizer": settings.featurizer,
        "data": settings.data, "n_test": m["n_total"], "n_classes": labels.count(),
        "test": {k: m[k] for k in ("accuracy", "f1_macro", "f1_weighted")},
        "prompts": {"name": settings.prompts, "version": settings.prompt_set.version},
        "few_shot": {"n_per_category": settings.shots},
        "llm": {"provider": settings.provider, "tag": settings.tag, "fraction": settings.fraction,
                "n_unparseable": m["n_unparseable"], "elapsed_s": backend.meter.seconds.get("classify", 0.0),
                "usage": backend.meter.usage()},
        "n_total": m["n_total"], "n_scored": m["n_scored"], "n_unparseable": m["n_unparseable"],
    }
    write_run(spark, folder, record, config=asdict(settings), labels=labels)
    return record | {"n_added": added}
