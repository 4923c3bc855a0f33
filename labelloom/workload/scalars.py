"""Scalar functions and projections over whole tables."""

from pyspark.sql import functions as F

from labelloom.functions import prompts as P
from labelloom.functions import replies as R
from labelloom.functions import text as X
from labelloom.functions import vectors as V
from labelloom.operators.evaluation import correct_flag
from labelloom.sources.corpus import with_label_index, with_label_name
from labelloom.workload.base import (
    RAW_POST, SQL_PREDS, SQL_SOURCE_DIM, SQL_WS, corpus, predictions, query, source_labels, sql_summary_key,
    sql_target, sql_word_count, table,
)

# Odd white space around and inside the documents, in both engines.
SPACED = """concat(chr(160), chr(8195), ' ', replace(text, ' ', chr(CASE doc_id % 4 WHEN 0 THEN 8195 WHEN 1 THEN 28
  WHEN 2 THEN 133 ELSE 32 END)), chr(11), chr(10))"""
# Spark's chr() takes a byte; code points above it are written out.
SPACED_SPARK = """concat('\\u00a0', '\\u2003', ' ', replace(text, ' ', CASE doc_id % 4 WHEN 0 THEN '\\u2003' WHEN 1 THEN '\\u001c'
  WHEN 2 THEN '\\u0085' ELSE ' ' END), '\\u000b', '\\n')"""


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("f01_word_count_floor", f"""
SELECT item_id AS id, greatest(1, {sql_word_count("text")}) AS n_words FROM benchmark
UNION ALL SELECT 1000000 + doc_id, greatest(1, {sql_word_count("text")}) FROM documents
UNION ALL SELECT 1000000000 + doc_id, greatest(1, {sql_word_count("regexp_replace(text, '[^ ]', '', 'g')")}) FROM documents""")
def f01(spark, sf):
    d = _docs(spark, sf)
    blank = d.select(F.col("doc_id") + 1000000000, F.regexp_replace("text", "[^ ]", "").alias("text"))
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text").union(
        d.select(F.col("doc_id") + 1000000, "text")).union(blank)
    return texts.select("id", X.word_count("text", at_least_one=True).alias("n_words"))


@query("f02_word_count", f"""
SELECT doc_id, {sql_word_count("text")} AS plain_words, {sql_word_count("spaced")} AS spaced_words
FROM (SELECT doc_id, text, {SPACED} AS spaced FROM documents)""")
def f02(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text", F.expr(SPACED_SPARK).alias("spaced"))
    return d.select("doc_id", X.word_count("text").alias("plain_words"), X.word_count("spaced").alias("spaced_words"))


@query("f03_doc_digest", "SELECT doc_id, substr(sha1(text), 1, 16) AS doc_sha1 FROM documents")
def f03(spark, sf):
    return _docs(spark, sf).select("doc_id", X.doc_digest("text").alias("doc_sha1"))


@query("f04_summary_key", f"""
SELECT doc_id, {sql_summary_key("text", sql_target("text", "0.25"), "qwen2.5:7b-instruct")} AS cache_key FROM documents""")
def f04(spark, sf):
    key = X.summary_key(digest=X.doc_digest("text"), target=X.target_words("text", 0.25),
                        model_tag="qwen2.5:7b-instruct", prompt_version=P.ZERO_SHOT.cache_version)
    return _docs(spark, sf).select("doc_id", key.alias("cache_key"))


@query("f05_embedding_key", """
SELECT doc_id, substr(sha1(concat_ws(chr(1), 'enc-1', 'classification: ', 'true', substr(sha1(text), 1, 16))), 1, 24) AS cache_key
FROM documents""")
def f05(spark, sf):
    key = X.embedding_key(digest=X.doc_digest("text"), model_id="enc-1", prefix="classification: ", normalize=True)
    return _docs(spark, sf).select("doc_id", key.alias("cache_key"))


@query("f06_target_words", " UNION ALL ".join(
    f"SELECT doc_id, CAST({f} AS DOUBLE) AS fraction, {sql_target('text', f)} AS target_words FROM documents"
    for f in ("0.1", "0.25", "0.5", "0.75")))
def f06(spark, sf):
    d = _docs(spark, sf).withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in (0.1, 0.25, 0.5, 0.75)])))
    return d.select("doc_id", "fraction", X.target_words("text", F.col("fraction")).alias("target_words"))


@query("f07_output_budget", f"""
SELECT doc_id, greatest(64, 2 * {sql_target("text", "0.25")} + 64) AS max_tokens FROM documents""")
def f07(spark, sf):
    return _docs(spark, sf).select("doc_id", X.output_budget(X.target_words("text", 0.25)).alias("max_tokens"))


@query("f08_next_pow2", """
SELECT doc_id, CAST(CASE WHEN n_chars <= 1 THEN 1 ELSE 1::BIGINT << length(bin(n_chars - 1)) END AS BIGINT) AS p_chars,
  CAST(CASE WHEN doc_id <= 1 THEN 1 ELSE 1::BIGINT << length(bin(doc_id - 1)) END AS BIGINT) AS p_id FROM documents""")
def f08(spark, sf):
    return _docs(spark, sf).select("doc_id", X.next_pow2("n_chars").alias("p_chars"), X.next_pow2("doc_id").alias("p_id"))


@query("f09_context_budget", """
WITH need AS (SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) + 64 AS required FROM documents),
grown AS (SELECT doc_id, required, CASE WHEN required > 1024
  THEN least(1::BIGINT << length(bin(required - 1)), 4096) ELSE 1024 END AS num_ctx FROM need)
SELECT doc_id, required, CAST(num_ctx AS BIGINT) AS num_ctx, required > num_ctx AS overflow FROM grown""")
def f09(spark, sf):
    budget = X.context_budget(X.approx_tokens("text"), num_ctx=1024, max_ctx=4096)
    return _docs(spark, sf).select("doc_id", budget.alias("b")).select("doc_id", "b.*")


@query("f10_token_estimate", "SELECT conv_id, turn, CAST(length(text) // 4 AS BIGINT) AS approx_tokens FROM conversations")
def f10(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.approx_tokens("text").alias("approx_tokens"))


@query("f11_passage_prefix", "SELECT doc_id, md5('classification: ' || text) AS input_md5 FROM documents")
def f11(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(X.with_prefix("text", "classification: ")).alias("input_md5"))


def _sql_lit(s):
    return "'" + s.replace("'", "''") + "'"


def sql_render(template, **fields):
    from string import Formatter
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(_sql_lit(literal))
        if field is not None:
            parts.append(f"CAST({fields[field]} AS VARCHAR)")
    return "concat(" + ", ".join(parts) + ")"


@query("f12_summary_prompt", f"""
SELECT doc_id, {sql_render(P.ZERO_SHOT.summary, target_words=sql_target("text", "0.25"), document="text")} AS prompt
FROM documents""")
def f12(spark, sf):
    return _docs(spark, sf).select("doc_id", P.summary_prompt(
        P.ZERO_SHOT.summary, X.target_words("text", 0.25), F.col("text")).alias("prompt"))


SQL_CATEGORIES = """cats AS (
  SELECT string_agg('- ' || label_name, chr(10) ORDER BY label_idx) AS block, count(*) AS n FROM source_dim)"""


@query("f13_classify_prompt", f"""
WITH {SQL_SOURCE_DIM}, {SQL_CATEGORIES}
SELECT doc_id, md5({sql_render(P.ZERO_SHOT.classify, n_categories="n", categories_block="block", text="text")}) AS prompt_md5
FROM documents, cats""")
def f13(spark, sf):
    cats = P.categories_block(source_labels(spark, sf))
    prompt = P.classify_prompt(P.ZERO_SHOT.classify, n_categories=cats.select("n_categories").scalar(),
                               categories_block=cats.select("categories_block").scalar(), text=F.col("text"))
    return _docs(spark, sf).select("doc_id", F.md5(prompt).alias("prompt_md5"))


@query("f14_category_list", f"""
WITH {SQL_SOURCE_DIM}, {SQL_CATEGORIES} SELECT block AS categories_block, n AS n_categories FROM cats""")
def f14(spark, sf):
    return P.categories_block(source_labels(spark, sf))


SQL_EXAMPLE_ROWS = f"""{SQL_SOURCE_DIM}, ranked AS (
  SELECT d.doc_id, d.text, s.label_idx, s.label_name,
         row_number() OVER (PARTITION BY d.source ORDER BY md5(concat('0|', d.source, '|', d.doc_id)), d.doc_id) AS rn
  FROM documents d JOIN source_dim s ON s.label_name = d.source)"""


@query("f15_examples_block", f"""
WITH {SQL_EXAMPLE_ROWS}
SELECT string_agg(concat('POST:', chr(10), text, chr(10), 'RESPONSE: {{"category": "', label_name, '"}}'),
  chr(10) || chr(10) ORDER BY label_idx, doc_id) || chr(10) AS examples_block FROM ranked WHERE rn <= 2""")
def f15(spark, sf):
    from labelloom.operators.sampling import pick_per_class
    labels = source_labels(spark, sf)
    picked = pick_per_class(corpus(spark, sf), 2, seed=0)
    rows = with_label_index(picked, labels).select(
        F.col("doc_id").alias("train_idx"), "label_idx", "label_name", F.col("text").alias("summary"))
    return P.examples_block(rows)


@query("f16_sidecar_name", """
SELECT url, page_id, replace(replace(url, '/', '_'), ':', '_') AS safe_tag,
  concat(replace(replace(url, '/', '_'), ':', '_'), '__v1__frac', CAST((page_id % 4 + 1) / 8 AS VARCHAR), '__n',
         page_id % 5, '__seed', page_id % 3, '.json') AS name FROM pages""")
def f16(spark, sf):
    name = X.sidecar_name(F.col("url"), F.lit("v1"), (F.col("page_id") % 4 + 1) / 8, F.col("page_id") % 5, F.col("page_id") % 3)
    return table(spark, sf, "pages").select("url", "page_id", X.safe_tag("url").alias("safe_tag"), name.alias("name"))


@query("f18_parse_reply", f"""
WITH {SQL_SOURCE_DIM}, replies AS (
  SELECT doc_id, source, CASE doc_id % 12
    WHEN 0 THEN concat('{{"category": "', source, '"}}') WHEN 1 THEN concat('  {{"category" : "', source, '", "why": 1}} ')
    WHEN 2 THEN concat('{{"category": "', source, '"}} trailing') WHEN 3 THEN '{{"category": 1}}' WHEN 4 THEN '[]'
    WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN '{{}}' WHEN 8 THEN '{{"category": "no such class"}}'
    WHEN 9 THEN concat('{{"category": "', source, '"}}{{"a":1}}') WHEN 10 THEN concat('{{"category": "', source, '"}}]')
    ELSE CASE doc_id // 12 % 3 WHEN 0 THEN repeat('[', 20000) WHEN 1 THEN '{{"category": "\\ud800"}}' ELSE source END END AS content FROM documents)
SELECT r.doc_id, s.label_name AS pred_label, s.label_idx AS pred_idx
FROM replies r LEFT JOIN source_dim s ON s.label_name = r.source AND r.doc_id % 12 IN (0, 1)""")
def f18(spark, sf):
    content = F.expr("""CASE doc_id % 12
    WHEN 0 THEN concat('{"category": "', source, '"}') WHEN 1 THEN concat('  {"category" : "', source, '", "why": 1} ')
    WHEN 2 THEN concat('{"category": "', source, '"} trailing') WHEN 3 THEN '{"category": 1}' WHEN 4 THEN '[]'
    WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN '{}' WHEN 8 THEN '{"category": "no such class"}'
    WHEN 9 THEN concat('{"category": "', source, '"}{"a":1}') WHEN 10 THEN concat('{"category": "', source, '"}]')
    ELSE CASE doc_id DIV 12 % 3 WHEN 0 THEN repeat('[', 20000) WHEN 1 THEN '{"category": "\\\\ud800"}' ELSE source END END""")
    parsed = _docs(spark, sf).select("doc_id", R.reply_category(content).alias("said"))
    labels = source_labels(spark, sf).select(F.col("label_name").alias("pred_label"), F.col("label_idx").alias("pred_idx"))
    return parsed.join(labels, parsed.said == labels.pred_label, "left").select("doc_id", "pred_label", "pred_idx")


@query("f19_label_lookup", f"""
WITH {SQL_SOURCE_DIM} SELECT d.doc_id, s.label_idx, t.label_name AS back FROM documents d
JOIN source_dim s ON s.label_name = d.source JOIN source_dim t ON t.label_idx = s.label_idx""")
def f19(spark, sf):
    labels = source_labels(spark, sf)
    there = with_label_index(corpus(spark, sf).select("doc_id", "label_name"), labels).drop("label_name")
    return with_label_name(there, labels, "label_idx", "back").select("doc_id", "label_idx", "back")


@query("f20_correct_flag", f"WITH {SQL_PREDS} SELECT doc_id, true_idx, pred_idx, pred_idx = true_idx AS correct FROM preds")
def f20(spark, sf):
    p = predictions(spark, sf, source_labels(spark, sf))
    return p.select("doc_id", "true_idx", "pred_idx", correct_flag(F.col("true_idx"), F.col("pred_idx")).alias("correct"))


@query("f21_compression_ratio", f"""
SELECT doc_id, round(least(n, 50) / greatest(1, n), 6) AS ratio FROM (SELECT doc_id, {sql_word_count("text")} AS n FROM documents)""")
def f21(spark, sf):
    n = X.word_count("text")
    return _docs(spark, sf).select("doc_id", F.round(X.compression_ratio(F.least(n, F.lit(50)), n), 6).alias("ratio"))


@query("f22_text_heads", """
SELECT doc_id, replace(substr(text, 1, 120), chr(10), ' ') AS head,
  CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS clipped FROM documents""")
def f22(spark, sf):
    return _docs(spark, sf).select("doc_id", X.one_line_head("text").alias("head"), X.clipped_head("text", 200).alias("clipped"))


@query("f23_strip_spaces", f"SELECT doc_id, trim(spaced, {SQL_WS}) AS stripped FROM (SELECT doc_id, {SPACED} AS spaced FROM documents)")
def f23(spark, sf):
    return _docs(spark, sf).select("doc_id", X.strip_spaces(F.expr(SPACED_SPARK)).alias("stripped"))


_USAGE = """CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
  CASE WHEN event_id % 3 = 0 THEN user_id END AS cache_read, event_type = 'error' AS is_batch"""


@query("f28_request_cost", f"""
SELECT event_id, round((coalesce(input_tokens, 0) / 1e6 * 3.0 + coalesce(output_tokens, 0) / 1e6 * 15.0
  + coalesce(cache_read, 0) / 1e6 * 0.30) * CASE WHEN is_batch THEN 0.5 ELSE 1 END, 9) AS cost_usd
FROM (SELECT event_id, {_USAGE} FROM events)""")
def f28(spark, sf):
    e = table(spark, sf, "events")
    cost = R.request_cost(F.get_json_object("props", "$.k").cast("long"), F.floor(F.col("value") * 10),
                          F.when(F.col("event_id") % 3 == 0, F.col("user_id")), batch=F.col("event_type") == "error")
    return e.select("event_id", F.round(cost, 9).alias("cost_usd"))


@query("f29_first_block", f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE trim(text, {SQL_WS}) END AS first_text,
  CASE WHEN doc_id % 3 = 0 THEN '{{}}' ELSE concat('{{"category":"', source, '"}}') END AS tool_input FROM documents""")
def f29(spark, sf):
    block = R.BLOCK.simpleString()
    tool = F.struct(F.lit("tool_use"), F.lit(None).cast("string"), F.create_map(F.lit("category"), F.col("source"))).cast(block)
    text = F.struct(F.lit("text"), F.concat(F.lit("  "), F.col("text"), F.lit("\n")), F.lit(None).cast("map<string,string>")).cast(block)
    content = F.when(F.col("doc_id") % 3 == 0, F.array(text, text)).when(
        F.col("doc_id") % 3 == 1, F.array(tool, text, tool)).otherwise(F.array(tool))
    return _docs(spark, sf).select("doc_id", R.first_text(content).alias("first_text"), R.first_tool_input(content).alias("tool_input"))


@query("f30_l2_normalize", """
WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * (vec_id % 7 + 1) AS FLOAT)) AS v FROM embeddings),
unit AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm, v FROM scaled)
SELECT vec_id, round(list_sum(list_transform(v, lambda x, i: i * CAST(CAST(CAST(x AS DOUBLE) / norm AS FLOAT) AS DOUBLE))), 6) AS weighted_sum
FROM unit""")
def f30(spark, sf):
    scaled = F.transform("embedding", lambda x: (x.cast("double") * (F.col("vec_id") % 7 + 1)).cast("float"))
    unit = V.l2_normalize(scaled)
    total = F.aggregate(F.transform(unit, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", F.round(total, 6).alias("weighted_sum"))


@query("f31_rounding", f"""
WITH {SQL_PREDS} SELECT true_label, round(avg(CASE WHEN pred_idx = true_idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS acc
FROM preds GROUP BY true_label""")
def f31(spark, sf):
    p = predictions(spark, sf, source_labels(spark, sf))
    hit = F.when(F.col("pred_idx") == F.col("true_idx"), 1.0).otherwise(0.0)
    return p.groupBy("true_label").agg(F.round(F.avg(hit), 4).alias("acc"))
