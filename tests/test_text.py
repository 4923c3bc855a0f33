import math
import re

import pytest
from pyspark.sql import functions as F

from labelloom.functions import cleaning as C
from labelloom.functions import prompts as P
from labelloom.functions import text as X

WORDS = ["", "   ", "a b  c", "x y", "p q r", "one\u0085two", "u\x1cv", "m\x0bn", "  lead and trail \n", "é ü\tö", "　", "a" * 50]


def one(df):
    return [r[0] for r in df.collect()]


def test_words_agree_with_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(WORDS)], "i INT, t STRING").orderBy("i")
    assert one(df.select(X.word_count("t"))) == [len(t.split()) for t in WORDS]
    assert one(df.select(X.word_count("t", at_least_one=True))) == [max(1, len(t.split())) for t in WORDS]
    assert one(df.select(X.strip_spaces("t"))) == [t.strip() for t in WORDS]
    assert one(df.select(X.words("t"))) == [t.split() for t in WORDS]


def test_every_white_space_character_separates(spark):
    texts = [f"a{c}b" for c in X.WHITESPACE] + [f"a{chr(c)}b" for c in (0x180E, 0x200B, 0xFEFF, 0x21, 0x7F)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").orderBy("i")
    assert one(df.select(X.word_count("t"))) == [len(t.split()) for t in texts]


def test_whitespace_is_all_of_unicode():
    assert set(X.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_budgets(spark):
    df = spark.range(0, 70).withColumn("t", F.array_join(F.array_repeat(F.lit("w"), F.col("id").cast("int")), " "))
    for fraction in (0.1, 0.25, 0.5, 0.75):
        got = one(df.select(X.target_words("t", fraction)))
        assert got == [max(8, math.ceil(fraction * max(1, n))) for n in range(70)]
    assert one(df.select(X.output_budget(F.col("id").cast("int")))) == [max(64, 2 * n + 64) for n in range(70)]


def test_next_pow2_and_context(spark):
    ns = [-3, 0, 1, 2, 3, 4, 5, 1023, 1024, 1025, 2**40 + 1]
    df = spark.createDataFrame([(n,) for n in ns], "n LONG")
    assert one(df.select(X.next_pow2("n"))) == [1 << max(0, n - 1).bit_length() for n in ns]
    fit = spark.createDataFrame([(10,), (1000,), (5000,)], "n LONG")
    rows = fit.select(X.context_budget("n", num_ctx=512, max_ctx=4096).alias("b")).select("b.*").collect()
    assert [tuple(r) for r in rows] == [(74, 512, False), (1064, 2048, False), (5064, 4096, True)]
    unlimited = fit.select(X.context_budget("n", num_ctx=512)["num_ctx"]).collect()
    assert [r[0] for r in unlimited] == [512, 2048, 8192]
    with pytest.raises(Exception, match="prompt needs 5064 tokens"):
        fit.select(X.context_budget("n", num_ctx=512, max_ctx=4096, strict=True)["num_ctx"]).collect()


def test_keys_depend_on_every_part(spark):
    df = spark.createDataFrame([("d", 9)], "d STRING, t INT")
    base = dict(digest="d", target="t", model_tag="m", prompt_version="v1", temperature=0.0, seed=0)
    keys = {df.select(X.summary_key(**(base | change))).first()[0] for change in (
        {}, {"model_tag": "m2"}, {"prompt_version": "v2"}, {"temperature": 0.5}, {"seed": 1}, {"target": F.lit(8)}, {"digest": F.lit("e")})}
    assert len(keys) == 7 and all(re.fullmatch("[0-9a-f]{24}", k) for k in keys)


RAW = [
    "From: a\nSubject: b\n\nbody line\nsecond",
    "no blank line at all",
    "H: x\n\n> quoted\nkept\n| also quoted\nBob wrote:\nIn article <1> x\nNot In article\nend",
    "H: x\n\nbody\n--\nname\nphone",
    "H: x\n\n--\nonly footer mark first",
    "",
    "H: x\n\nfirst\n\nsecond part\n  \nlast part\n",
    "H: x\n\ntext\n--------  \n",
    "H: x\n\n\n\nafter blanks",
]
QUOTE = re.compile(C.QUOTE_LINE)


def brute_strip(text):
    text = text.partition("\n\n")[2]
    lines = text.strip().split("\n")
    blank = [i for i, line in enumerate(lines) if not line.strip().strip("-")]
    if blank and blank[-1] > 0:
        text = "\n".join(lines[: blank[-1]])
    return "\n".join(line for line in text.split("\n") if not QUOTE.search(line))


def test_cleaning_by_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(RAW)), "i INT, t STRING").orderBy("i")
    assert one(df.select(C.strip_parts("t"))) == [brute_strip(t) for t in RAW]
    assert one(df.select(C.strip_parts("t", ("headers",)))) == [t.partition("\n\n")[2] for t in RAW]
    with pytest.raises(ValueError):
        C.strip_parts("t", ("signatures",))


def test_render_leaves_documents_alone(spark):
    doc = "100% {target_words} {document} {{x}} %s"
    df = spark.createDataFrame([(doc,)], "d STRING")
    out = df.select(P.summary_prompt("n={target_words} {{kept}}\n{document}|", F.lit(12), F.col("d"))).first()[0]
    assert out == "n=12 {kept}\n" + doc + "|"
    with pytest.raises(KeyError):
        P.render("{missing}")


def test_examples_only_where_the_template_has_a_place(spark):
    args = dict(n_categories=2, categories_block="- a\n- b", text=F.lit("T"), examples_block="EX")
    row = spark.range(1).select(P.classify_prompt(P.ZERO_SHOT.classify, **args), P.classify_prompt(P.FEW_SHOT.classify, **args)).first()
    assert "EX" not in row[0] and "EX" in row[1]
    assert P.FEW_SHOT.takes_examples and not P.ZERO_SHOT.takes_examples


def test_examples_block_text(spark):
    ex = spark.createDataFrame([(7, 1, 'say "b"', "two"), (3, 0, "a", "one")], "train_idx LONG, label_idx INT, label_name STRING, summary STRING")
    assert P.examples_block(ex).first()[0] == (
        'POST:\none\nRESPONSE: {"category": "a"}\n\nPOST:\ntwo\nRESPONSE: {"category": "say \\"b\\""}\n')


def test_footer_of_long_blank_runs(spark):
    text = "first\n" + " " * 20000 + "x\n" + "-" * 20000 + "y\nend"
    df = spark.createDataFrame([(text,)], "t STRING")
    assert one(df.select(C.strip_footer(F.col("t")))) == [text]
