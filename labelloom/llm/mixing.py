"""Mixing sources to target weights: raking by iterative proportional fitting.

Documents fall into cells (source, language, topic) that weigh their tokens.
Cell weights are raked until their margins meet the target shares of sources,
languages and topics; the raked weights, scaled to a token budget, give each
cell the probability with which its documents are drawn. No cell is ever raked
beyond its own tokens, so the probabilities keep the margins. Everything is
DataFrame expressions: the documents are read once to sum the cells, which are
all that the rounds touch, and once to draw.

Targets are shares by value, or a tempering exponent: a share in proportion to
the tokens to that power (1 keeps the mixture, 0 makes all values equal).
Shares of values that no document has are dealt out over the others; values
that a named target leaves out have share 0. ``margins`` tells the target, the
expected and the drawn share of every value.

Defined results: null attributes are a value of their own, ``(none)``; null and
empty texts weigh nothing and are drawn as their cell is, or always in a cell
without tokens; a value that holds too few tokens for its share of the budget is
taken whole and the others share what is left as far as all margins allow; rows
that repeat an id share their draw; an empty table gives an empty result.
Margins that cannot be met together stop where rounds no longer bring them
closer, or at ``rounds``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import query, table
from labelloom.session import materialize

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
# Topics by what a text holds; the first that fits, else "prose".
TOPICS = (("legal", ("icense", "opyright", "arranty")), ("contact", ("@",)), ("markup", ("###", "***", "%%%", "| ")))


@dataclass(frozen=True)
class MixSettings:
    """Targets by margin, the share of all tokens to draw, and when to stop."""

    targets: dict[str, float | dict[str, float]] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.7})
    budget: float = 0.5
    tolerance: float = 1e-6
    rounds: int = 40
    seed: int = 17


def topic_of(text: Column, topics=TOPICS) -> Column:
    out = F.lit("prose")
    for name, needles in reversed(topics):
        found = F.lit(False)
        for needle in needles:
            found = found | F.contains(text, F.lit(needle))
        out = F.when(found, name).otherwise(out)
    return out


def attributes(docs: DataFrame, *, text: str = "text", source: str = "source", lang: str = "lang") -> list[Column]:
    """The cell and the tokens (white-space separated words) of each document."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NONE)).alias("source"),
            F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NONE)).alias("lang"),
            topic_of(body).alias("topic"), F.regexp_count(body, F.lit(r"\S+")).cast("long").alias("n_tokens")]


def _targets(cells: DataFrame, margin: str, target: float | dict[str, float]) -> DataFrame:
    """``margin, share`` of the values that have tokens."""
    sums = cells.groupBy(margin).agg(F.sum("base").alias("sum")).filter("sum > 0")
    if isinstance(target, dict):
        named = F.coalesce(*[F.when(F.col(margin) == k, float(v)) for k, v in target.items()], F.lit(0.0))
        sums = sums.select(margin, named.alias("raw")).filter("raw > 0")
    else:
        sums = sums.select(margin, F.pow(F.col("sum").cast("double"), F.lit(float(target))).alias("raw"))
    whole = sums.agg(F.sum("raw").alias("whole")).first()["whole"] or 1.0
    return materialize(sums.select(margin, (F.col("raw") / whole).alias("share")), f"target-{margin}")


def rake(cells: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """``source, lang, topic, base, weight``: weights meet the target margins, none beyond its cell's share of the budget.

    ``cells`` (source, lang, topic, base) should be a written table. A weight is
    at most base / (budget * all tokens): the whole cell. Where a value's share
    rises, only its cells below that bound take part.
    """
    targets = {m: _targets(cells, m, settings.targets[m]) for m in MARGINS if m in settings.targets}
    total = float(cells.agg(F.sum("base").alias("n")).first()["n"] or 1)
    most = F.col("base") / F.lit(max(settings.budget, 1e-12) * total)
    full = F.col("weight") >= most * (1 - 1e-12)
    fitted = cells.select(*MARGINS, "base", F.least(F.col("base") / F.lit(total), most).alias("weight"))
    before = float("inf")
    for _ in range(settings.rounds):
        for margin, target in targets.items():
            sums = fitted.groupBy(margin).agg(F.sum("weight").alias("_sum"), F.sum(F.when(full, F.col("weight")).otherwise(0.0)).alias("_full"))
            share, free = F.coalesce("share", F.lit(0.0)), F.col("_sum") - F.col("_full")
            falls = F.when(F.col("_sum") > 0, share / F.col("_sum")).otherwise(0.0)
            rises = F.when(free > 1e-15, (share - F.col("_full")) / free).otherwise(1.0)
            factors = sums.join(target, margin, "left").select(
                margin, (share > F.col("_sum")).alias("_up"), F.when(share > F.col("_sum"), rises).otherwise(falls).alias("_factor"))
            grown = F.when(F.col("_up") & full, F.col("weight")).otherwise(F.least(F.col("weight") * F.col("_factor"), most))
            fitted = fitted.join(factors, margin).select(*MARGINS, "base", grown.alias("weight"))
        fitted = materialize(fitted, "raked")
        gaps = [fitted.groupBy(m).agg(F.sum("weight").alias("sum")).join(t, m).agg(F.max(F.abs(F.col("sum") / F.col("share") - 1)).alias("gap"))
                for m, t in targets.items()]
        worst = max([gap.first()["gap"] or 0.0 for gap in gaps], default=0.0)
        if worst <= settings.tolerance or worst > before * 0.9999:
            break
        before = worst
    return fitted


def probabilities(raked: DataFrame, budget: float) -> DataFrame:
    """``source, lang, topic, probability``: the share of each cell's tokens that its weight of the budget asks for."""
    total = raked.agg(F.sum("base").alias("n")).first()["n"] or 0
    ratio = F.when(F.col("base") > 0, F.col("weight") * F.lit(float(budget) * float(total)) / F.col("base"))
    return raked.select(*MARGINS, F.least(F.lit(1.0), F.coalesce(ratio, F.lit(1.0))).alias("probability"))


def margins(mixed: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """``margin, value, target, expected, drawn``: shares of the tokens, for what ``mix`` returns (written, as it is read per margin).

    ``expected`` is that of the probabilities, ``drawn`` that of the documents
    sampled. Both fall short of a target where a value has too few tokens for it.
    """
    cells = materialize(mixed.groupBy(*MARGINS).agg(
        F.sum("n_tokens").alias("base"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"),
        F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).alias("drawn")), "mixed-cells")
    whole = cells.agg(F.sum("expected").alias("expected"), F.sum("drawn").alias("drawn")).first()
    out = None
    for margin in (m for m in MARGINS if m in settings.targets):
        sums = cells.groupBy(margin).agg(*[(F.sum(c) / F.lit(float(whole[c] or 1))).alias(c) for c in ("expected", "drawn")])
        rows = sums.join(_targets(cells, margin, settings.targets[margin]), margin, "left").select(
            F.lit(margin).alias("margin"), F.col(margin).alias("value"), F.coalesce("share", F.lit(0.0)).alias("target"), "expected", "drawn")
        out = rows if out is None else out.unionByName(rows)
    return out


def draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 up to 1 that depends on the id alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) * F.lit(2.0 ** -53)


def cell_probabilities(cells: DataFrame, settings: MixSettings) -> DataFrame:
    """Written, so that its true size decides how it is joined: cells are few next to documents, but not bounded."""
    return materialize(probabilities(rake(cells, settings), settings.budget), "probabilities")


def mix(docs: DataFrame, settings: MixSettings = MixSettings(), *, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, cell, tokens, probability and draw of every document."""
    narrow = materialize(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *attributes(docs)), "mix")
    cells = materialize(narrow.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("base")), "mix-cells")
    known = cell_probabilities(cells, settings)
    return narrow.join(known, list(MARGINS)).select(
        "doc_id", *MARGINS, "n_tokens", "probability", (draw(F.col("doc_id"), settings.seed) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, settings: MixSettings = MixSettings(), *, doc_id: str = "doc_id") -> DataFrame:
    """The documents that are drawn, with their own columns."""
    cell = [c.alias(f"_mix_{n}") for c, n in zip(attributes(docs), (*MARGINS, "n_tokens"))]
    wide = docs.select(F.struct("*").alias("_doc"), *cell)
    cells = materialize(wide.groupBy(*[F.col(f"_mix_{m}").alias(m) for m in MARGINS]).agg(F.sum("_mix_n_tokens").alias("base")), "mix-cells")
    known = cell_probabilities(cells, settings).toDF(*[f"_mix_{m}" for m in MARGINS], "_mix_p")
    drawn = wide.join(known, [f"_mix_{m}" for m in MARGINS]).filter(draw(F.col(f"_doc.`{doc_id}`"), settings.seed) < F.col("_mix_p"))
    return drawn.select("_doc.*")


@query("op1_mixing")
def op1(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
