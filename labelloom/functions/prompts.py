"""Prompt templates and their rendering as column expressions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PromptSet:
    """A named, versioned pair of templates. The version is part of every cache key."""

    name: str
    version: str
    summary: str
    classify: str

    @property
    def cache_version(self) -> str:
        """Version and digest of the summary template: an edited template does not find the summaries of another."""
        return f"{self.version}.{hashlib.sha1(self.summary.encode()).hexdigest()[:8]}"

    @property
    def takes_examples(self) -> bool:
        return "{examples_block}" in self.classify


# The prompts that cached summaries and replies depend on.
_SUMMARY = """\
You are summarizing a Usenet newsgroup post for a downstream classifier.
Produce a faithful summary in approximately {target_words} words. Preserve topical vocabulary (named entities, jargon, technical terms) — these are the strongest classification signal. Do not add commentary or preamble.

POST:
{document}

SUMMARY:
"""

ZERO_SHOT = PromptSet("zero_shot_v1", "v1", _SUMMARY, """\
You are classifying a Usenet newsgroup post into exactly one of {n_categories} categories.

Categories:
{categories_block}

POST:
{text}

Choose the single best category. Respond with JSON matching the schema.
""")

FEW_SHOT = PromptSet("few_shot_v1", "v1", _SUMMARY, """\
You are classifying a Usenet newsgroup post into exactly one of {n_categories} categories.

Categories:
{categories_block}

Here are labeled examples. Each example shows a POST followed by the RESPONSE JSON the classifier should emit:

{examples_block}
Now classify the following post in the same way.

POST:
{text}

Respond with JSON matching the schema.
""")

PROMPTS = {p.name: p for p in (ZERO_SHOT, FEW_SHOT)}


def render(template: str, **fields: Column | str | int) -> Column:
    """A template as one concat; the template is taken apart once, on the driver.

    Inserted text is never scanned for placeholders, so a document that holds
    braces or a percent sign comes through unchanged.
    """
    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            value = fields[field]
            parts.append(value.cast("string") if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*parts)


def summary_prompt(template: str, target: Column, document: Column) -> Column:
    return render(template, target_words=target, document=document)


def classify_prompt(template: str, *, n_categories: Column | int, categories_block: Column | str,
                    text: Column, examples_block: Column | str = "") -> Column:
    """Examples are used only where the template has a place for them."""
    return render(template, n_categories=n_categories, categories_block=categories_block,
                  text=text, examples_block=examples_block)


def categories_block(labels: DataFrame) -> DataFrame:
    """One row: the bullet list of class names in index order, and their number."""
    ordered = F.sort_array(F.collect_list(F.struct("label_idx", "label_name")))
    bullets = F.transform(ordered, lambda s: F.concat(F.lit("- "), s["label_name"]))
    return labels.agg(F.array_join(bullets, "\n").alias("categories_block"),
                      F.count("*").alias("n_categories"))


def category_json(name: Column) -> Column:
    """The reply a model is asked for: ``{"category": "<name>"}``."""
    quoted = F.substr(F.to_json(F.struct(name.alias("c"))), F.lit(6))
    return F.concat(F.lit('{"category": '), quoted)


def examples_block(examples: DataFrame) -> DataFrame:
    """One row: the worked examples in order of class, then document.

    Examples number ``n per class * classes`` and go into one prompt, so the
    single collected row is bounded by what a prompt may hold.
    """
    block = F.concat(F.lit("POST:\n"), F.col("summary"), F.lit("\nRESPONSE: "), category_json(F.col("label_name")))
    ordered = F.sort_array(F.collect_list(F.struct("label_idx", "train_idx", block.alias("block"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n")
    return examples.agg(F.concat(joined, F.lit("\n")).alias("examples_block"))
