"""Registry of queries, and the inputs that several of them share.

Inputs the tables lack (raw posts, predictions, replies, run records) are
derived from whole tables by the expressions below, which both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.prompts import ZERO_SHOT
from labelloom.sources.corpus import label_dictionary, with_label_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a key, with its SQL equivalent if it has one."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, label: str = "source") -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", F.col(label).alias("label_name"))


# A word, in RE2: anything but the white space that Unicode and ASCII know.
SQL_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}]+"
SQL_WS = r"chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||" + "||".join(
    f"chr({c})" for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SQL_SPACES}'), lambda w: w <> '')"


def sql_word_count(text: str) -> str:
    return f"CAST(len({sql_words(text)}) AS INTEGER)"


def sql_target(text: str, fraction: str) -> str:
    return f"greatest(8, CAST(ceil(CAST({fraction} AS DOUBLE) * greatest(1, {sql_word_count(text)})) AS INTEGER))"


def sql_summary_key(text: str, target: str, model_tag: str = "double:lead-words", version: str = ZERO_SHOT.cache_version) -> str:
    sep = "chr(1)"
    return (f"substr(sha1(concat_ws({sep}, '{version}', '{model_tag}', substr(sha1({text}), 1, 16), "
            f"CAST({target} AS VARCHAR), '0.0', '0')), 1, 24)")


# Label dictionaries.
SQL_SOURCE_DIM = """source_dim AS (
  SELECT CAST(row_number() OVER (ORDER BY label_name) - 1 AS INTEGER) AS label_idx, label_name
  FROM (SELECT DISTINCT source AS label_name FROM documents))"""
SQL_LANG_DIM = """lang_dim AS (
  SELECT CAST(row_number() OVER (ORDER BY label_name) - 1 AS INTEGER) AS label_idx, label_name
  FROM (SELECT DISTINCT lang AS label_name FROM documents))"""

# Predictions by rule: some unparseable, some wrong, the rest right.
_PRED = """CASE WHEN doc_id % 17 = 0 THEN NULL
  WHEN substr(md5(concat('p', doc_id)), 1, 1) < '9' THEN true_idx
  ELSE CAST(n_chars % {k} AS INTEGER) END"""

SQL_PREDS = SQL_SOURCE_DIM + f""", preds AS (
  SELECT doc_id, true_idx, true_label, {_PRED.format(k="(SELECT count(*) FROM source_dim)")} AS pred_idx
  FROM (SELECT d.doc_id, d.n_chars, d.source AS true_label, s.label_idx AS true_idx
        FROM documents d JOIN source_dim s ON s.label_name = d.source))"""


def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_dictionary(table(spark, sf_dir, "documents"), "source")


def lang_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_dictionary(table(spark, sf_dir, "documents"), "lang")


def predictions(spark: SparkSession, sf_dir: str, labels: DataFrame) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("source").alias("true_label"))
    true = with_label_index(docs, labels, "true_label", "true_idx")
    k = labels.count()
    return true.select("doc_id", "true_idx", "true_label", F.expr(_PRED.format(k=k)).alias("pred_idx"))


# Raw posts: header block, quotations and footer put around the documents.
RAW_POST = """concat(
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('From: u', doc_id, '@example.org', chr(10), 'Subject: ', source, chr(10), chr(10)) END,
  CASE WHEN doc_id % 3 = 0 THEN concat('In article <', doc_id, '> someone wrote:', chr(10), '> earlier words', chr(10), '| more', chr(10)) ELSE '' END,
  text,
  CASE WHEN doc_id % 4 = 0 THEN concat(chr(10), '--', chr(10), 'sig ', lang)
       WHEN doc_id % 4 = 1 THEN concat(chr(10), ' ', chr(10), 'bye')
       WHEN doc_id % 4 = 2 THEN concat(chr(10), '------ ', chr(10)) ELSE '' END)"""


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(RAW_POST).alias("raw"))


def sql_strip_header(t: str) -> str:
    return (f"CASE WHEN strpos({t}, chr(10)||chr(10)) > 0 THEN substr({t}, strpos({t}, chr(10)||chr(10)) + 2) "
            f"ELSE '' END")


def sql_strip_quotes(t: str) -> str:
    return (f"array_to_string(list_filter(string_split({t}, chr(10)), lambda line: NOT regexp_matches(line, "
            r"'writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>')), chr(10))")


def sql_strip_footer(t: str) -> str:
    """By line lists: position of the last blank-or-dashes line, cut there unless it is the first."""
    lines = f"string_split(trim({t}, {SQL_WS}), chr(10))"
    blank = f"trim(trim(line, {SQL_WS}), '-') = ''"
    at = f"list_max(list_transform({lines}, lambda line, i: CASE WHEN {blank} THEN i ELSE 0 END))"
    return f"CASE WHEN {at} > 1 THEN array_to_string(list_slice({lines}, 1, {at} - 1), chr(10)) ELSE {t} END"
