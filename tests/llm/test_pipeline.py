"""The pipeline on the smallest tables, and its stages on planted cases; queries with SQL next to DuckDB."""

import os

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402
from labelloom.llm import queries  # noqa: E402
from labelloom.session import materialize  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@needs_data
def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, SF), name)
        assert after.columns == columns
        assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        assert 0 < after.count() <= docs.count()
        docs = after
    out = pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.columns[:2] == ["doc_id", "n_tokens"]


def test_one_document_of_each_group_of_copies_stays(spark):
    words = [f"word{i % 211}x{i}" for i in range(400)]
    near = words[:200] + ["changed"] + words[201:]
    other = [f"other{i}" for i in range(300)]
    rows = [(5, " ".join(words)), (3, " ".join(words)), (3, " ".join(words)), (9, " ".join(near)), (4, " ".join(other)), (7, None), (8, ""),
            (None, "lonely text without any id to it"), (None, " ".join(words))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 7), (True, 0)]
    assert pipeline.drop_copies(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("share, linked", [(0.5, False), (0.6, False), (0.7, False), (0.85, True)])
def test_copies_are_those_that_share_enough_shingles(spark, share, linked):
    rows, size = [], 120
    for k in range(12):
        same = round(size * 2 * share / (1 + share))
        words = [f"{k}w{i}" for i in range(size + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:same + 4] + [f"{k}o{i}" for i in range(size - same)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in pipeline.drop_copies(spark, docs, SF).collect())
    assert kept == [i for i, _ in rows if not (linked and i % 2)]


@needs_data
def test_stages_do_not_mind_odd_columns_and_nulls(spark):
    rows = [(i, f"the {i} words of a plain text in here" if i % 3 else None, None if i % 5 == 0 else "en", None, None, "x", 0.1, {"a": 1})
            for i in range(30)] + [(None, "no id", "en", "s", 5, "x", 0.2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, _toxicity double, _doc map<string,int>")
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() <= len(rows), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check import table
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df = queries.all_queries()[name](spark, SF)
    cur = con.execute(queries.all_oracles()[name])
    columns = [d[0] for d in cur.description]
    assert table([tuple(r) for r in df.collect()], df.columns) == table(cur.fetchall(), columns)


def test_filters_keep_what_they_do_not_reject(spark, tmp_path):
    english, german, spanish = "the cat sat on the mat and then it went away", "der Hund lief schnell durch den großen Wald", "el perro corre por la calle con su amigo"
    rows = [(i, (english, german, spanish)[i % 3], ("en", "de", "es")[i % 3]) for i in range(60)]
    rows += [(100 + i, f"{english}. {german}. {spanish}.", None) for i in range(20)] + [(200, "12 + 3 = 15", "en"), (201, None, "en"), (202, "", None)]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.keep_languages(spark, docs, SF).collect()}
    assert kept == {r[0] for r in rows} - {200, 201, 202}
    nothing_known = docs.withColumn("lang", pipeline.F.lit(None).cast("string"))
    assert pipeline.keep_languages(spark, nothing_known, SF).count() == len(rows)
    spark.createDataFrame([(i, 1, 1) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == len(rows)
