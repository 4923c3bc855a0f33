"""Prompted experiments: summarize, pick examples, classify, score, record."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.prompts import PROMPTS, PromptSet, examples_block
from labelloom.functions.text import word_count
from labelloom.operators import evaluation as E
from labelloom.operators.inference import Backend, Meter, classify, summarize
from labelloom.operators.profile import corpus_fingerprint
from labelloom.operators.sampling import first_rows, pick_per_class, stratified_split
from labelloom.session import materialize
from labelloom.sources import sidecars
from labelloom.sources.corpus import label_dictionary, with_label_index
from labelloom.sources.runs import write_run


@dataclass(frozen=True)
class PromptedSettings:
    model: str
    tag: str
    fraction: float = 0.25
    shots: int = 0
    prompts: str = "zero_shot_v1"
    data: str = "corpus"
    provider: str = "injected"
    seed: int = 42
    test_size: float = 0.2
    model_seed: int = 0
    temperature: float = 0.0
    smoke: int | None = None
    test_per_category: int | None = None
    strict: bool = True  # a class of fewer test documents than asked for is an error

    @property
    def prompt_set(self) -> PromptSet:
        return PROMPTS[self.prompts]

    @property
    def kind(self) -> str:
        return "llm_few_shot" if self.shots > 0 else "llm_zero_shot"

    @property
    def featurizer(self) -> str:
        return f"llm_summary_{self.fraction}_n{self.shots}"

    @property
    def run_name(self) -> str:
        return f"{self.model}_{self.prompts}_n{self.shots}_summary{self.fraction}_{self.data}"


@dataclass(frozen=True)
class Folders:
    summaries: str
    examples: str
    runs: str


def prepare(corpus: DataFrame, settings: PromptedSettings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Label dictionary, train and test rows (``doc_id, text, label_name, label_idx``)."""
    labels = label_dictionary(corpus)
    split = stratified_split(with_label_index(corpus, labels), test_size=settings.test_size, seed=settings.seed)
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    return labels, train, first_rows(test, settings.smoke)


def summaries_of(docs: DataFrame, settings: PromptedSettings, backend: Backend, folders: Folders,
                 fractions: float | list[float] | None = None) -> DataFrame:
    return summarize(docs.select("doc_id", "text"), settings.fraction if fractions is None else fractions, backend=backend,
                     model_tag=settings.tag, prompts=settings.prompt_set, cache_path=folders.summaries,
                     temperature=settings.temperature, seed=settings.model_seed)


def pick_examples(train: DataFrame, settings: PromptedSettings) -> DataFrame:
    """The training documents that serve as examples, written once (n per class)."""
    if settings.shots <= 0:
        raise ValueError(f"shots must be positive, got {settings.shots}")
    return materialize(pick_per_class(train, settings.shots, seed=settings.model_seed), "examples")


def build_examples(train: DataFrame, settings: PromptedSettings, backend: Backend, folders: Folders,
                   picked: DataFrame | None = None) -> DataFrame:
    """``train_idx, label_idx, label_name, summary`` of the worked examples; persisted, and reused when present.

    The file name carries the setting and the fingerprint of the picked
    documents, so a changed corpus does not find the examples of another.
    """
    spark = train.sparkSession
    picked = pick_examples(train, settings) if picked is None else picked
    path = folders.examples.rstrip("/") + "/" + sidecars.sidecar_file(
        spark, model_tag=settings.tag, prompt_version=settings.prompt_set.version, fraction=settings.fraction,
        n=settings.shots, seed=settings.model_seed, corpus=corpus_fingerprint(picked).first()["fingerprint"])
    stored = sidecars.read_sidecar(spark, path)
    if stored is not None:
        return stored
    texts = summaries_of(picked, settings, backend, folders).select("doc_id", "summary")
    examples = picked.join(texts, "doc_id").select(
        F.col("doc_id").alias("train_idx"), "label_idx", "label_name", "summary")
    sidecars.write_sidecar(examples, path)
    return sidecars.read_sidecar(spark, path)


def example_text(train: DataFrame, settings: PromptedSettings, backend: Backend, folders: Folders) -> tuple[str, list[int]]:
    """The rendered block and the example ids; both empty for zero-shot."""
    if settings.shots <= 0:
        return "", []
    examples = build_examples(train, settings, backend, folders)
    ids = [r["train_idx"] for r in examples.select("train_idx").collect()]
    return examples_block(examples).first()["examples_block"], ids


def warm_summaries(docs: DataFrame, fractions: list[float], settings: PromptedSettings, backend: Backend,
                   folders: Folders) -> DataFrame:
    """Fill the summary cache for several fractions in one job; 1.0 needs no summary."""
    return summaries_of(docs, settings, backend, folders, [f for f in fractions if f < 1.0])


def warm_examples(train: DataFrame, fractions: list[float], settings: PromptedSettings, backend: Backend,
                  folders: Folders) -> list[DataFrame]:
    """Persist the example sets of several fractions; nothing to do without shots.

    The summaries of all fractions are made in one job, so each set only reads the cache.
    """
    if settings.shots <= 0:
        return []
    picked = pick_examples(train, settings)
    short = [f for f in fractions if f < 1.0]
    if short:
        summaries_of(picked, settings, backend, folders, short)
    return [build_examples(train, PromptedSettings(**(asdict(settings) | {"fraction": f})), backend, folders, picked)
            for f in fractions]


def score_rows(test: DataFrame, settings: PromptedSettings, backend: Backend, folders: Folders, labels: DataFrame,
               block: str) -> DataFrame:
    """Store rows: document, truth, prediction and summary."""
    summaries = summaries_of(test, settings, backend, folders)
    summaries = materialize(summaries.select("doc_id", "summary", "source_words"), "test-summaries")
    preds = classify(summaries.select("doc_id", F.col("summary").alias("text")), labels, backend=backend,
                     prompts=settings.prompt_set, examples_block=block, model=settings.tag,
                     temperature=settings.temperature, seed=settings.model_seed)
    return store_rows(test, summaries, preds, settings)


def store_rows(docs: DataFrame, summaries: DataFrame, preds: DataFrame, settings: PromptedSettings) -> DataFrame:
    """The twelve fields of a prediction row."""
    from labelloom.functions.text import doc_digest

    facts = docs.select(F.col("doc_id"), doc_digest("text").alias("doc_sha1"), F.col("label_idx").alias("true_idx"),
                        F.col("label_name").alias("true_label"), word_count("text").alias("source_words"))
    rows = facts.join(preds, "doc_id", "left").join(summaries.select("doc_id", "summary"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("test_idx"), "doc_sha1", "true_idx", "true_label", "pred_label", "pred_idx",
        E.correct_flag(F.col("true_idx"), F.col("pred_idx")).alias("correct"), "summary", "source_words",
        word_count("summary").alias("summary_words"), F.lit(float(settings.fraction)).alias("fraction"),
        F.lit(int(settings.shots)).alias("few_shot_n"))


def run_prompted(corpus: DataFrame, settings: PromptedSettings, backend: Backend, folders: Folders) -> dict:
    """Classify the whole held-out part once; returns the run record that was written.

    ``elapsed_s`` is the time of the classification calls alone; usage counts every call of the run.
    """
    spark = corpus.sparkSession
    backend = replace(backend, meter=Meter())
    labels, train, test = prepare(corpus, settings)
    test = materialize(test, "test-docs")
    block, example_ids = example_text(train, settings, backend, folders)
    rows = materialize(score_rows(test, settings, backend, folders, labels, block), "predictions")
    m = E.store_metrics(rows).first()
    mean_words = rows.agg(F.avg("summary_words").alias("w")).first()["w"]
    record = {
        "run_name": settings.run_name, "kind": settings.kind, "model": settings.model, "featurizer": settings.featurizer,
        "data": settings.data, "n_test": m["n_total"], "n_classes": labels.count(),
        "test": {k: m[k] for k in ("accuracy", "f1_macro", "f1_weighted")},
        "prompts": {"name": settings.prompts, "version": settings.prompt_set.version},
        "few_shot": {"n_per_category": settings.shots, "example_train_indices": example_ids},
        "llm": {"provider": settings.provider, "tag": settings.tag, "fraction": settings.fraction,
                "n_unparseable": m["n_unparseable"], "mean_summary_words": mean_words,
                "elapsed_s": backend.meter.seconds.get("classify", 0.0), "usage": backend.meter.usage()},
    }
    write_run(spark, f"{folders.runs.rstrip('/')}/{settings.run_name}", record, config=asdict(settings), labels=labels,
              report=E.full_report(rows, labels), confusion=E.confusion_matrix(rows, labels))
    return record
