"""Corpus reading and cleaning."""

from pyspark.sql import functions as F

from labelloom.functions import cleaning as C
from labelloom.sources.corpus import label_dictionary, load_corpus, multi_label
from labelloom.workload.base import (
    RAW_POST, SQL_SOURCE_DIM, query, raw_posts, source_labels, sql_strip_footer, sql_strip_header,
    sql_strip_quotes, table,
)

_RAW = f"(SELECT doc_id, {RAW_POST} AS raw FROM documents)"


@query("s01_load_corpus", "SELECT doc_id, text, source AS label_name FROM documents")
def s01(spark, sf):
    return load_corpus(spark, f"{sf}/documents.parquet", label="source")


@query("s02_subset", """
SELECT doc_id, text, source AS label_name FROM documents WHERE lang = 'fr'""")
def s02(spark, sf):
    return load_corpus(spark, f"{sf}/documents.parquet", label="source", subset=("lang", "fr"))


@query("s03_categories", """
WITH kept AS (SELECT doc_id, source FROM documents WHERE source IN ('src3', 'src7', 'src11')),
dim AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT source FROM kept))
SELECT doc_id, source AS label_name, label_idx FROM kept JOIN dim USING (source)""")
def s03(spark, sf):
    kept = load_corpus(spark, f"{sf}/documents.parquet", label="source", categories=["src3", "src7", "src11"])
    return kept.join(label_dictionary(kept), "label_name").select("doc_id", "label_name", "label_idx")


@query("s04_strip_header", f"SELECT doc_id, {sql_strip_header('raw')} AS body FROM {_RAW}")
def s04(spark, sf):
    return raw_posts(spark, sf).select("doc_id", C.strip_header(F.col("raw")).alias("body"))


@query("s05_strip_footer", f"SELECT doc_id, {sql_strip_footer('raw')} AS body FROM {_RAW}")
def s05(spark, sf):
    return raw_posts(spark, sf).select("doc_id", C.strip_footer(F.col("raw")).alias("body"))


@query("s06_strip_quotes", f"SELECT doc_id, {sql_strip_quotes('raw')} AS body FROM {_RAW}")
def s06(spark, sf):
    return raw_posts(spark, sf).select("doc_id", C.strip_quotes(F.col("raw")).alias("body"))


@query("s06_strip_all", f"""
SELECT doc_id, {sql_strip_quotes('b')} AS body FROM (
  SELECT doc_id, {sql_strip_footer('a')} AS b FROM (SELECT doc_id, {sql_strip_header('raw')} AS a FROM {_RAW}))""")
def s06_all(spark, sf):
    return raw_posts(spark, sf).select("doc_id", C.strip_parts("raw").alias("body"))


@query("s07_label_dictionary", f"WITH {SQL_SOURCE_DIM} SELECT * FROM source_dim")
def s07(spark, sf):
    return source_labels(spark, sf)


@query("s08_multi_label", """
SELECT doc_id, unnest([lang, source]) AS label, 2 AS n_labels FROM documents""")
def s08(spark, sf):
    d = multi_label(table(spark, sf, "documents"), "lang", "source")
    return d.select("doc_id", F.explode("labels").alias("label"), F.size("labels").alias("n_labels"))
