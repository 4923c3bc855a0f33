"""Multinomial and complement Naive Bayes on long-form features.

Fitting is one aggregation to (term, class) sums, kept per fold, so that every
fold's training sums are "all minus held out" and a whole grid of smoothing
values is cross-validated in the same job. A class's score of a document is a
part that depends only on the document's total weight plus gains of the terms
that the class has seen, so the dense class-by-vocabulary table is never built.

Feature rows carry their document's class and fold (``doc_id, label_idx, fold,
term, weight``), so neither fitting nor scoring joins features with documents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators import blocks as block
from labelloom.operators.blocks import Cells
from labelloom.operators.tfidf import Blocks
from labelloom.session import buckets_in_place, materialize, small_table

KINDS = ("multinomial", "complement")
# Sums or gains of a term kept as one array: classes x candidates x (folds + 1) at most.
DENSE = 256
# Tasks of the join of postings with terms, where postings are in no blocks: each
# has a row of sums for nearly every document, so that more of them would shuffle more.
JOIN_TASKS = 100


@dataclass(frozen=True)
class Candidate:
    """One grid entry; its number is its place in the grid."""

    number: int
    kind: str = "multinomial"
    alpha: float = 1.0
    norm: bool = False

    @property
    def params(self) -> dict:
        return {"alpha": self.alpha} | ({"norm": self.norm} if self.kind == "complement" else {})


# The smoothing grid.
ALPHAS = (0.01, 0.1, 0.5, 1.0)


def grid(kind: str = "multinomial", alphas: tuple[float, ...] = ALPHAS,
         norms: tuple[bool, ...] = (False, True)) -> list[Candidate]:
    pairs = [(a, n) for a in alphas for n in (norms if kind == "complement" else (False,))]
    return [Candidate(i, kind, a, n) for i, (a, n) in enumerate(pairs)]


@dataclass
class BayesModel:
    """Sums that any candidate can be scored from.

    ``terms``: term, classes ARRAY<STRUCT<label_idx, sums ARRAY<DOUBLE>>>, where
    sums[0] is over all training rows and sums[f + 1] leaves fold f out.
    ``classes``: label_idx, n_docs, total (arrays of the same layout).
    """

    terms: DataFrame
    classes: DataFrame
    vocab_size: int
    n_folds: int = 0


def _slots(value: Column, n_folds: int) -> list[Column]:
    """Sums over all rows, then over the rows outside each fold."""
    return [F.sum(value)] + [F.sum(F.when(F.col("fold") != f, value).otherwise(0)) for f in range(n_folds)]


def fit_bayes(features: DataFrame, docs: DataFrame, vocab_size: int, n_folds: int = 0, dense: int = DENSE) -> BayesModel:
    """Fit on training rows: ``features`` as above, ``docs`` with doc_id, label_idx and, with folds, fold."""
    width = range(n_folds + 1)
    counts = small_table(docs.groupBy("label_idx").agg(F.array(*_slots(F.lit(1).cast("long"), n_folds)).alias("n_docs")))
    labels = _labels(counts)
    if len(labels) * len(width) <= dense:
        # One row a term and task is shuffled, with the sums of all classes beside each other.
        def of(label: int) -> list[Column]:
            return _slots(F.when(F.col("label_idx") == label, F.col("weight")).otherwise(0.0), n_folds)
        by_label = [F.struct(F.lit(label).alias("label_idx"), F.array(*of(label)).alias("sums")) for label in labels]
        terms = features.groupBy("term").agg(F.array(*by_label).alias("classes")) if labels else features.select("term").distinct().withColumn(
            "classes", F.array().cast("array<struct<label_idx:int,sums:array<double>>>"))
        terms = terms.select("term", F.filter("classes", lambda x: x["sums"][0] != 0).alias("classes"))
    else:
        by_class = features.groupBy("term", "label_idx").agg(F.array(*_slots(F.col("weight"), n_folds)).alias("sums"))
        terms = by_class.groupBy("term").agg(F.collect_list(F.struct("label_idx", "sums")).alias("classes"))
    with buckets_in_place(terms.sparkSession):
        terms = materialize(terms, "bayes-terms")
    flat = terms.select(F.inline("classes"))
    totals = flat.groupBy("label_idx").agg(F.array(*[F.sum(F.col("sums")[i]) for i in width]).alias("total"))
    zero = F.array(*[F.lit(0.0) for _ in width])
    classes = counts.join(totals, "label_idx", "left").select("label_idx", "n_docs", F.coalesce("total", zero).alias("total"))
    return BayesModel(terms, small_table(classes), vocab_size, n_folds)


def _labels(classes: DataFrame) -> list[int]:
    """The class indices in order; one row per class reaches the driver."""
    return sorted(r["label_idx"] for r in classes.select("label_idx").where(F.col("label_idx").isNotNull()).collect())


def _gain(n: Column, term_total: Column, c: Candidate) -> Column:
    """What a class's own sum of a term adds to the part that all classes share."""
    if c.kind == "multinomial":
        return F.log(n + c.alpha) - F.log(F.lit(c.alpha))
    return F.log(term_total - n + c.alpha) - F.log(term_total + c.alpha)


def _shared(term_total: Column, c: Candidate) -> Column:
    return F.log(F.lit(c.alpha)) if c.kind == "multinomial" else F.log(term_total + c.alpha)


def _term_gains(model: BayesModel, candidates: list[Candidate]) -> DataFrame:
    """``term, shared, classes ARRAY<STRUCT<label_idx, gains>>``, both [slot][candidate].

    All logarithms are taken here, once per term and class, not once per posting.
    """
    slots = range(model.n_folds + 1)

    def total(s: int) -> Column:
        return F.greatest(F.aggregate("classes", F.lit(0.0), lambda acc, x: acc + x["sums"][s]), F.lit(0.0))

    def gains(x: Column) -> Column:
        return F.array(*[F.array(*[_gain(x["sums"][s], F.col("tt")[s], c) for c in candidates]) for s in slots])

    totals = model.terms.select("term", "classes", F.array(*[total(s) for s in slots]).alias("tt"))
    return totals.select(
        "term", F.array(*[F.array(*[_shared(F.col("tt")[s], c) for c in candidates]) for s in slots]).alias("shared"),
        F.transform("classes", lambda x: F.struct(x["label_idx"].alias("label_idx"), gains(x).alias("gains"))).alias("classes"))


def _weight_sums(model: BayesModel, candidates: list[Candidate], labels: list[int], dense: int) -> DataFrame:
    """Per class and slot, the sum of log complement weights over the vocabulary (for ``norm``).

    Terms never seen in training are counted through the vocabulary size.
    """
    if len(labels) * len(candidates) * (model.n_folds + 1) <= dense:
        return _dense_weight_sums(model, candidates, labels)
    slots = F.explode(F.sequence(F.lit(0), F.lit(model.n_folds))).alias("slot")
    per_term = _term_gains(model, candidates).select("shared", "classes", slots)
    n = range(len(candidates))
    shared = per_term.groupBy("slot").agg(F.count("*").alias("n_terms"),
                                          F.array(*[F.sum(F.col("shared")[F.col("slot")][i]) for i in n]).alias("shared"))
    each = per_term.select("slot", F.inline("classes"))
    gains = each.groupBy("slot", "label_idx").agg(F.array(*[F.sum(F.col("gains")[F.col("slot")][i]) for i in n]).alias("gain"))
    return gains.join(shared, "slot")


def _dense_weight_sums(model: BayesModel, candidates: list[Candidate], labels: list[int]) -> DataFrame:
    """As above, in plain sums over the terms' arrays; each smoothing's logarithms are added up once."""
    width, alphas = model.n_folds + 1, list(dict.fromkeys(c.alpha for c in candidates))
    of = [[F.col("n")[s + c * width] for c in range(len(labels))] for s in range(width)]
    totals = [F.greatest(sum(own, F.lit(0.0)), F.lit(0.0)) for own in of]

    def logs(s: int, c: int) -> list[Column]:
        return [F.sum(F.log(totals[s] - of[s][c] + a)) for a in alphas]

    rows = _flat_terms(model, labels).agg(F.count("*").alias("n_terms"), F.array(*[F.struct(
        F.lit(s).alias("slot"), F.lit(label).alias("label_idx"), F.array(*logs(s, c)).alias("sums"))
        for s in range(width) for c, label in enumerate(labels)]).alias("rows"))
    none = F.array(*[F.lit(0.0) for _ in candidates])
    each = F.array(*[F.coalesce(F.col("sums")[alphas.index(c.alpha)], F.lit(0.0)) for c in candidates])
    return rows.select("n_terms", F.inline("rows")).select("slot", "label_idx", "n_terms", each.alias("gain"), none.alias("shared"))


def _class_constants(model: BayesModel | BlockModel, candidates: list[Candidate], weight_sums: Callable[[], DataFrame]) -> DataFrame:
    """``slot, consts``: per slot one array over classes with what scoring needs of each candidate."""
    slots = F.explode(F.sequence(F.lit(0), F.lit(model.n_folds))).alias("slot")
    flat = model.classes.select("label_idx", "n_docs", "total", slots).select(
        "slot", "label_idx", F.col("n_docs")[F.col("slot")].alias("n"), F.col("total")[F.col("slot")].alias("t"))
    sums = flat.groupBy("slot").agg(F.sum("n").alias("all_n"), F.sum("t").alias("all_t"))
    flat = flat.join(sums, "slot").where(F.col("n") > 0)
    v = F.lit(float(model.vocab_size))
    if any(c.norm for c in candidates):
        flat = flat.join(weight_sums(), ["slot", "label_idx"], "left")
    per_candidate = []
    for i, c in enumerate(candidates):
        if c.kind == "multinomial":
            prior = F.log(F.col("n") / F.col("all_n"))
            log_den = F.log(F.col("t") + F.lit(c.alpha) * v)
            scale = F.lit(1.0)
        else:
            prior = F.lit(0.0)
            log_den = F.log(F.col("all_t") - F.col("t") + F.lit(c.alpha) * v)
            scale = F.lit(-1.0)
            if c.norm:
                unseen = (v - F.col("n_terms")) * F.log(F.lit(c.alpha))
                scale = 1.0 / (F.col("shared")[i] + unseen + F.coalesce(F.col("gain")[i], F.lit(0.0)) - v * log_den)
        per_candidate.append(F.struct(prior.alias("prior"), log_den.alias("log_den"), scale.alias("scale")))
    entry = F.struct("label_idx", F.array(*per_candidate).alias("p"))
    return flat.groupBy("slot").agg(F.sort_array(F.collect_list(entry)).alias("consts"))


def _sparse_sums(model: BayesModel, hits: DataFrame, candidates: list[Candidate], labels: list[int]) -> DataFrame:
    """``doc_id, g, w``: a row per posting and class that has seen its term, added up per class and then per document."""
    # One pseudo class (-1) carries what all classes share; a term unseen in training has nothing else.
    unseen = F.array(*[F.log(F.lit(c.alpha)) for c in candidates])
    shared = F.struct(F.lit(-1).alias("label_idx"), F.coalesce(F.col("shared")[F.col("slot")], unseen).alias("gains"))
    own = F.transform("classes", lambda x: F.struct(x["label_idx"].alias("label_idx"), x["gains"][F.col("slot")].alias("gains")))
    none = F.array().cast("array<struct<label_idx:int,gains:array<double>>>")
    joined = hits.join(_term_gains(model, candidates), "term", "left")
    each = joined.select("doc_id", "weight", F.inline(F.concat(F.array(shared), F.coalesce(own, none))))
    w, n = F.col("weight"), range(len(candidates))
    per_class = each.groupBy("doc_id", "label_idx").agg(
        F.array(*[F.sum(w * F.col("gains")[i]) for i in n]).alias("g"),
        F.sum(F.when(F.col("label_idx") == -1, w).otherwise(0.0)).alias("w"))
    per_doc = per_class.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("label_idx", "g"))).alias("m"), F.sum("w").alias("w"))

    def of(label: int, i: int) -> Column:
        return F.col("m")[-1][i] + F.coalesce(F.try_element_at(F.col("m"), F.lit(label))[i], F.lit(0.0))

    return per_doc.select("doc_id", F.array(*[F.array(*[of(c, i) for i in n]) for c in labels]).alias("g"), "w")


def _flat_terms(model: BayesModel, labels: list[int]) -> DataFrame:
    """``term, n``: the sums of all classes and slots beside each other."""
    def sums(label: int) -> list[Column]:
        mine = F.try_element_at(F.filter("classes", lambda x: x["label_idx"] == label), F.lit(1))["sums"]
        return [F.coalesce(mine[s], F.lit(0.0)) for s in range(model.n_folds + 1)]

    return model.terms.select("term", F.array(*[value for label in labels for value in sums(label)]).alias("n"))


def _dense_sums(model: BayesModel, hits: DataFrame, candidates: list[Candidate], labels: list[int], blocks: int | None = None) -> DataFrame:
    """``doc_id, g, w``: each term has one array, the sums of all classes and slots; a posting takes its slot's logarithms.

    Postings in ``blocks`` stay where they are: the sums of a term go once to
    each block that has it, and documents are added up there. Others go to the
    terms, and the sums of documents back.
    """
    slots, n = range(model.n_folds + 1), range(len(candidates))
    per_term = _flat_terms(model, labels)
    if blocks:
        sent = hits.select("home", "term").distinct().join(per_term, "term").repartition(blocks, "home")
        joined, by = hits.join(sent.hint("shuffle_hash"), ["home", "term"], "left"), ["home", "doc_id"]
    else:
        tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if tasks > JOIN_TASKS:
            hits, per_term = hits.repartition(JOIN_TASKS, "term"), per_term.repartition(JOIN_TASKS, "term")
        joined, by = hits.join(per_term, "term", "left"), ["doc_id"]
    own = [F.coalesce(F.col("n")[F.col("slot") + c * len(slots)], F.lit(0.0)).alias(f"n{c}") for c in range(len(labels))]
    joined = joined.select(*by, "weight", *own)
    total = F.greatest(sum((F.col(f"n{c}") for c in range(len(labels))), F.lit(0.0)), F.lit(0.0))

    def log(c: int, i: int) -> Column:
        mine = F.col(f"n{c}")
        return F.log((mine if candidates[i].kind == "multinomial" else total - mine) + candidates[i].alpha)

    sums_of_doc = joined.groupBy(*by).agg(
        *[F.sum(F.col("weight") * log(c, i)).alias(f"s{c}_{i}") for c in range(len(labels)) for i in n], F.sum("weight").alias("w"))
    sums_of_doc = sums_of_doc.select("doc_id", F.array(*[F.array(*[F.col(f"s{c}_{i}") for i in n]) for c in range(len(labels))]).alias("g"), "w")
    if not blocks:
        return sums_of_doc
    with buckets_in_place(hits.sparkSession):
        return materialize(sums_of_doc, "document-sums", compression="zstd")


def score(model: BayesModel, features: DataFrame, docs: DataFrame, candidates: list[Candidate], dense: int = DENSE,
          blocks: int | None = None) -> DataFrame:
    """``doc_id, candidate, pred_idx`` for every document and candidate.

    With folds, a document is scored by the sums that leave its fold out.
    ``docs`` lists every document, also those without any known term. Ties go to the lowest class index (scores compared at 9 places).

    Where classes x candidates x folds are at most ``dense``, a term's sums for
    all classes are one array, and one aggregation by document adds logarithms;
    beyond, only the classes that have seen a term have gains, a row each.
    ``blocks`` is the number of blocks of features that carry their ``home``
    (``tfidf.fit_transform_in_blocks``); an id is in one block only.
    """
    slot, labels = _slot(model), _labels(model.classes)
    shared = _shared_sums(candidates)
    hits = features.select(*(["home"] if blocks else []), "doc_id", "term", "weight", slot)
    small = len(labels) * len(candidates) * (model.n_folds + 1) <= dense
    per_doc = _dense_sums(model, hits, shared, labels, blocks) if small else _sparse_sums(model, hits, shared, labels)
    return _decide(model, per_doc, docs, candidates, labels, lambda: _weight_sums(model, candidates, labels, dense))


def _slot(model: BayesModel | BlockModel) -> Column:
    return ((F.col("fold") + 1) if model.n_folds else F.lit(0)).cast("int").alias("slot")


def _shared_sums(candidates: list[Candidate]) -> list[Candidate]:
    """Candidates that differ in norm alone share their sums."""
    return list({(c.kind, c.alpha): c for c in candidates}.values())


def _decide(model: BayesModel | BlockModel, per_doc: DataFrame, docs: DataFrame, candidates: list[Candidate], labels: list[int],
            weight_sums: Callable[[], DataFrame]) -> DataFrame:
    """``doc_id, candidate, pred_idx, score`` from the sums of each document, ``g`` [class][shared candidate] and ``w``."""
    shared, slot = _shared_sums(candidates), _slot(model)
    place = [next(j for j, c in enumerate(shared) if (c.kind, c.alpha) == (d.kind, d.alpha)) for d in candidates]
    consts = small_table(_class_constants(model, candidates, weight_sums))
    scored = docs.select("doc_id", slot).join(per_doc, "doc_id", "left").join(consts, "slot")
    zero = F.array(*[F.array(*[F.lit(0.0) for _ in shared]) for _ in labels])
    scored = scored.select("doc_id", "consts", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("g", zero).alias("g"))
    places = F.array(*[F.lit(label) for label in labels])

    def best_class(i: int) -> Column:
        def class_score(k):
            p = k["p"][i]
            seen = F.element_at(F.col("g"), F.array_position(places, k["label_idx"]).cast("int"))[place[i]]
            value = p["prior"] + p["scale"] * (seen - F.col("w") * p["log_den"])
            return F.struct(F.round(value, 9).alias("s"), (-k["label_idx"]).alias("l"))
        return F.array_max(F.transform("consts", class_score))

    best = scored.select("doc_id", F.array(*[best_class(i) for i in range(len(candidates))]).alias("b"))
    numbered = [F.struct(F.lit(c.number).alias("candidate"), (-F.col("b")[i]["l"]).cast("int").alias("pred_idx"),
                         F.col("b")[i]["s"].alias("score")) for i, c in enumerate(candidates)]
    return best.select("doc_id", F.inline(F.array(*numbered)))


@dataclass
class BlockModel:
    """As ``BayesModel``, of documents in blocks. ``sums`` are rows of ``blocks.ALL_SUMS``, ``rows`` the documents they were made from."""

    rows: DataFrame
    sums: DataFrame
    classes: DataFrame
    vocab_size: int
    n_folds: int
    cells: Cells
    fitted: Blocks

    def terms(self) -> DataFrame:
        """As in ``BayesModel``, of a model without folds."""
        parts = self.fitted.parts.select("part", "terms")
        rows = self.sums.where("home IS NULL").select("part", "entries").join(parts, "part").drop("part")
        return rows.mapInArrow(block.classes_of_terms(self.cells), "term STRING, classes ARRAY<STRUCT<label_idx: INT, sums: ARRAY<DOUBLE>>>")


def fit_in_blocks(fitted: Blocks, rows: DataFrame, docs: DataFrame, vocab_size: int, n_folds: int = 0) -> BlockModel:
    """Fit on the ``rows`` of ``fitted.docs`` that are to ``learn``, for scoring those to ``ask``; ``docs`` as in ``fit_bayes``.

    ``rows`` carry label_idx, fold, and learn and ask BOOLEAN. A block sends each
    part of the vocabulary one row of its own sums, and gets one back with those
    of all blocks, for the terms of what is asked.
    """
    width = range(n_folds + 1)
    counts = small_table(docs.groupBy("label_idx").agg(F.array(*_slots(F.lit(1).cast("long"), n_folds)).alias("n_docs")))
    cells = Cells(tuple(_labels(counts)), n_folds)
    own = rows.select("home", "label_idx", "fold", "learn", "ask", "terms", "tfs", "dfs", "norm").mapInArrow(
        block.add_up(cells, fitted.n_docs, fitted.settings.sublinear_tf), block.SUMS)
    with buckets_in_place(rows.sparkSession):
        sums = materialize(own.groupBy("part").applyInArrow(block.total(cells), block.ALL_SUMS), "bayes-sums", compression="zstd")
    total = sums.where("home IS NULL").agg(F.array(*[F.coalesce(F.sum(F.col("totals")[i]), F.lit(0.0)) for i in range(len(cells))]).alias("t")).first()["t"]

    def of_slot(c: int, s: int) -> float:
        return sum(total[c * cells.folds + f] for f in range(cells.folds) if s == 0 or f not in (s - 1, n_folds))

    by_class = counts.sparkSession.createDataFrame([(label, [float(of_slot(c, s)) for s in width]) for c, label in enumerate(cells.labels)],
                                                   "label_idx INT, total ARRAY<DOUBLE>")
    zero = F.array(*[F.lit(0.0) for _ in width])
    classes = counts.join(by_class, "label_idx", "left").select("label_idx", "n_docs", F.coalesce("total", zero).alias("total"))
    return BlockModel(rows, sums, small_table(classes), vocab_size, n_folds, cells, fitted)


def score_in_blocks(model: BlockModel, docs: DataFrame, candidates: list[Candidate]) -> DataFrame:
    """As ``score``, for the rows that were to ask: they meet the sums of their terms in their block."""
    labels, shared, spark = list(model.cells.labels), _shared_sums(candidates), model.rows.sparkSession
    asking = model.rows.where("ask").select("home", "doc_id", "fold", "terms", "tfs", "dfs", "norm")
    answers = model.sums.where("home IS NOT NULL").select("home", "part", "entries")
    task = block.doc_sums(model.cells, [(c.kind, c.alpha) for c in shared], model.fitted.n_docs, model.fitted.settings.sublinear_tf)
    schema = T.StructType([asking.schema["doc_id"], T.StructField("g", T.ArrayType(T.DoubleType())), T.StructField("w", T.DoubleType())])
    with buckets_in_place(spark):
        sums_of_doc = materialize(asking.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(task, schema), "document-sums", compression="zstd")
    g = F.array(*[F.array(*[F.sum(F.col("g")[c * len(shared) + i]) for i in range(len(shared))]) for c in range(len(labels))])
    per_doc = sums_of_doc.groupBy("doc_id").agg(g.alias("g"), F.sum("w").alias("w"))
    return _decide(model, per_doc, docs, candidates, labels, lambda: _block_weight_sums(model, candidates, labels))


def _block_weight_sums(model: BlockModel, candidates: list[Candidate], labels: list[int]) -> DataFrame:
    """As ``_weight_sums``, each part of the vocabulary being added up in its row."""
    alphas = tuple(dict.fromkeys(c.alpha for c in candidates))
    each = model.sums.where("home IS NULL").select("part", "entries").mapInArrow(
        block.complement_logs(model.cells, alphas), "n_terms LONG, logs ARRAY<DOUBLE>")
    size = (model.n_folds + 1) * len(labels) * len(alphas)
    row = each.agg(F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n"), F.array(*[F.coalesce(F.sum(F.col("logs")[i]), F.lit(0.0)) for i in range(size)]).alias("logs")).first()
    none = [0.0] * len(candidates)
    rows = [(s, label, row["n"], [row["logs"][(s * len(labels) + c) * len(alphas) + alphas.index(d.alpha)] for d in candidates], none)
            for s in range(model.n_folds + 1) for c, label in enumerate(labels)]
    return model.rows.sparkSession.createDataFrame(rows, "slot INT, label_idx INT, n_terms LONG, gain ARRAY<DOUBLE>, shared ARRAY<DOUBLE>")
