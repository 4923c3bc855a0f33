"""TF-IDF in long form: one row per (document, term).

Fitted on the whole corpus. Documents are dealt over blocks by id, a task each.
Terms are counted and weighed inside their block: only one row per block and
term goes to the term's count of documents, and one comes back with its idf, so
that postings are never shuffled and a term of nearly every document costs one
row per block.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.operators import blocks
from labelloom.session import buckets_in_place, materialize, materialize_buckets

# A token is a run of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# What stands between runs of such characters.
NO_TOKEN = r"[^\p{L}\p{N}_]+"

# Common English function words, the default stop list. Any other
# list can be passed in TfidfSettings.
STOP_WORDS = """
a about above after again against all also am an and any are as at be because been before being below between both
but by can cannot could did do does doing down during each few for from further had has have having he her here hers
herself him himself his how if in into is it its itself just me might more most must my myself no nor not now of off
on once only or other our ours ourselves out over own per same shall she should so some such than that the their
theirs them themselves then there these they this those through to too under until up upon us very was we were what
when where whether which while who whom whose why will with within without would you your yours yourself yourselves
""".split()

# Bytes of text that a block has on average at most, as its terms are hashed, and its postings sorted, in memory.
BLOCK_BYTES = 2**24


@dataclass(frozen=True)
class TfidfSettings:
    stop_words: tuple[str, ...] = tuple(STOP_WORDS)
    ngram_range: tuple[int, int] = (1, 2)
    min_df: int = 2
    max_df: float = 0.95
    sublinear_tf: bool = True
    lowercase: bool = True
    # Tasks the documents are spread over; None is the session's shuffle partitions,
    # or as many blocks as the text and the cores need where terms are weighed.
    partitions: int | None = None


def tokens(text: Column | str, lowercase: bool = True) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(TOKEN), F.lit(0))


def drop_stop_words(toks: Column, stop_words: tuple[str, ...]) -> Column:
    return F.filter(toks, lambda t: ~t.isin(*stop_words)) if stop_words else toks


def ngrams(toks: Column, ngram_range: tuple[int, int]) -> Column:
    """All n-grams of the range. ``toks`` must be a plain column, as it is read once per element."""
    def of_length(n: int) -> Column:
        if n == 1:
            return toks
        # Token by token beside its neighbours: no slice and join for every single n-gram.
        whole = F.size(toks) - (n - 1)
        grams = F.slice(toks, F.lit(1), whole)
        for i in range(2, n + 1):
            grams = F.zip_with(grams, F.slice(toks, F.lit(i), whole), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))

    sets = [of_length(n) for n in range(ngram_range[0], ngram_range[1] + 1)]
    return sets[0] if len(sets) == 1 else F.concat(*sets)


def _tasks(spark: SparkSession, settings: TfidfSettings) -> int:
    return settings.partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_blocks(corpus: DataFrame, settings: TfidfSettings) -> TfidfSettings:
    """The settings with as many tasks as blocks of ``BLOCK_BYTES`` need, unless their number is given.

    Every block sends a row for each of its terms, so there are no more of them
    than the text and the session's cores ask for.
    """
    if settings.partitions:
        return settings
    size = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return replace(settings, partitions=max(corpus.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES)))


def document_tokens(corpus: DataFrame, settings: TfidfSettings, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, [keep], toks``: the tokens of each document without stop words.

    Documents are spread by id over an explicit number of tasks, as n-grams
    multiply the text and adaptive coalescing would go by the text alone.
    """
    tasks = _tasks(corpus.sparkSession, settings)
    spread = corpus.select("doc_id", *keep, "text").repartition(tasks, "doc_id")
    toks = drop_stop_words(tokens("text", settings.lowercase), settings.stop_words)
    return spread.select("doc_id", *keep, toks.alias("toks"))


def block_tokens(corpus: DataFrame, settings: TfidfSettings, keep: tuple[str, ...] = ()) -> DataFrame:
    """``block, doc_id, [keep], toks``: as above, in blocks by id with a task each; equal ids share a block."""
    tasks = _tasks(corpus.sparkSession, settings)
    placed = corpus.select(F.pmod(F.hash("doc_id"), F.lit(tasks)).alias("block"), "doc_id", *keep, "text").repartitionById(tasks, "block")
    toks = drop_stop_words(tokens("text", settings.lowercase), settings.stop_words)
    return placed.select("block", "doc_id", *keep, toks.alias("toks"))


def term_counts(corpus: DataFrame, settings: TfidfSettings = TfidfSettings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, [keep], term, tf``. ``keep`` names columns of the document to carry along."""
    # The n-grams are exploded as an expression: for a plain column Spark infers
    # a filter on its size, which takes the tokens apart once per n-gram.
    grams = ngrams(F.col("toks"), settings.ngram_range)
    terms = document_tokens(corpus, settings, keep).select("doc_id", *keep, F.explode(grams).alias("term"))
    return terms.groupBy("doc_id", *keep, "term").agg(F.count("*").alias("tf"))


def document_frequencies(corpus: DataFrame, settings: TfidfSettings = TfidfSettings()) -> DataFrame:
    """``term, df``. Repeats within a document are dropped in its own row, before anything is shuffled."""
    grams = F.array_distinct(ngrams(F.col("toks"), settings.ngram_range))
    terms = document_tokens(corpus, settings).select(F.explode(grams).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def block_frequencies(corpus: DataFrame, settings: TfidfSettings = TfidfSettings()) -> DataFrame:
    """``block, term, n``: the documents of each block that have a term, counted within the block."""
    grams = F.array_distinct(ngrams(F.col("toks"), settings.ngram_range))
    terms = block_tokens(corpus, settings).select("block", F.explode(grams).alias("term"))
    return terms.groupBy("block", "term").agg(F.count("*").alias("n"))


def vocabulary(frequencies: DataFrame, n_docs: Column, settings: TfidfSettings = TfidfSettings()) -> DataFrame:
    """``term, df, idf, [more]`` of the terms in at least min_df and at most max_df * n documents."""
    df = F.col("df")
    more = [c for c in frequencies.columns if c not in ("term", "df")]
    kept = frequencies.where((df >= settings.min_df) & (df <= F.lit(float(settings.max_df)) * n_docs))
    return kept.select("term", "df", (F.log((n_docs + 1.0) / (df + 1.0)) + 1.0).alias("idf"), *more)


def _weight(settings: TfidfSettings) -> Column:
    tf = F.col("tf").cast("double")
    return (F.log(tf) + 1.0 if settings.sublinear_tf else tf) * F.col("idf")


def weigh(corpus: DataFrame, block_terms: DataFrame, settings: TfidfSettings = TfidfSettings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """``block, doc_id, [keep], term, tf, idf, norm``: what ``unit_weights`` makes weights of unit length from.

    ``block_terms``: block, term, idf of the terms known to each block, which
    are sent there. A document without any of them has no rows.
    """
    w = _weight(settings)
    norm = F.sqrt(F.sum(w * w).over(W.partitionBy("block", "doc_id")))
    return _counts(corpus, block_terms, settings, keep).withColumn("norm", norm)


def _counts(corpus: DataFrame, block_terms: DataFrame, settings: TfidfSettings, keep: tuple[str, ...]) -> DataFrame:
    """``block, doc_id, [keep], term, tf, idf``."""
    # The n-grams are exploded as an expression, as in term_counts.
    grams = ngrams(F.col("toks"), settings.ngram_range)
    terms = block_tokens(corpus, settings, keep).select("block", "doc_id", *keep, F.explode(grams).alias("term"))
    counts = terms.groupBy("block", "doc_id", *keep, "term").agg(F.count("*").alias("tf"))
    sent = block_terms.select("block", "term", "idf").repartitionById(_tasks(corpus.sparkSession, settings), "block")
    return counts.join(sent.hint("shuffle_hash"), ["block", "term"]).select("block", "doc_id", *keep, "term", "tf", "idf")


def unit_weights(weighed: DataFrame, settings: TfidfSettings = TfidfSettings()) -> DataFrame:
    """``doc_id, [keep], term, weight``."""
    keep = [c for c in weighed.columns if c not in ("block", "term", "tf", "idf", "norm")]
    return weighed.select(*keep, "term", (_weight(settings) / F.col("norm")).alias("weight"))


def fit_tfidf(corpus: DataFrame, settings: TfidfSettings = TfidfSettings()) -> DataFrame:
    """The fitted vocabulary. Write it to keep the vectorizer; read it back to use it."""
    return vocabulary(document_frequencies(corpus, settings), corpus.agg(F.count("*").cast("double")).scalar(), settings)


def transform_tfidf(corpus: DataFrame, vocab: DataFrame, settings: TfidfSettings = TfidfSettings(),
                    keep: tuple[str, ...] = ()) -> DataFrame:
    settings = in_blocks(corpus, settings)
    known = block_frequencies(corpus, settings).join(vocab.select("term", "idf"), "term")
    return unit_weights(weigh(corpus, known, settings, keep), settings)


def fit_transform_tfidf(corpus: DataFrame, settings: TfidfSettings = TfidfSettings(),
                        keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Features and vocabulary, both written once to the shared folder.

    Documents are written in blocks, by the numbers of their terms, each block
    with the words of its own; a posting has a row of its own only as it is read.
    """
    fitted = fit_in_blocks(corpus, settings, keep, spelled=True)
    return fitted.spelled_features(), fitted.vocabulary()


@dataclass
class Blocks:
    """Documents of a corpus in blocks, by the numbers of their terms.

    ``docs``: home, doc_id, [keep], terms ARRAY<LONG>, tfs, dfs, norm, in buckets by the ``home`` of the block;
    a document without any known term has no row. ``parts``: part, terms ARRAY<STRING>, dfs, the vocabulary,
    where the term at place i of a part has the number ``part << 32 | i``.
    """

    docs: DataFrame
    parts: DataFrame
    homes: list[int]
    n_docs: int
    settings: TfidfSettings
    # ``docs`` and the rows with the words of each block, where they were asked for.
    stored: DataFrame | None = None

    def _idf(self) -> Column:
        return F.log((F.lit(float(self.n_docs)) + 1.0) / (F.col("df") + 1.0)) + 1.0

    def features(self) -> DataFrame:
        """``home, doc_id, [keep], term, weight`` with the terms' numbers."""
        keep = [c for c in self.docs.columns if c not in ("terms", "tfs", "dfs", "norm")]
        long = self.docs.select(*keep, "norm", F.inline(F.arrays_zip(
            F.col("terms").alias("term"), F.col("tfs").alias("tf"), F.col("dfs").alias("df"))))
        return long.withColumn("idf", self._idf()).select(*keep, "term", (_weight(self.settings) / F.col("norm")).alias("weight"))

    def spelled_features(self) -> DataFrame:
        """``doc_id, [keep], term, weight`` of documents with ``words``, made in their block."""
        rows = self.stored
        names = [c for c in self.docs.columns if c not in ("home", "terms", "tfs", "dfs", "norm")]
        schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
        with buckets_in_place(rows.sparkSession):
            return rows.groupBy("home").applyInArrow(blocks.spell(names, self.n_docs, self.settings.sublinear_tf), schema)

    def numbered(self) -> DataFrame:
        """``number, term, df``."""
        rows = self.parts.select("part", F.posexplode(F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"))).alias("i", "t"))
        return rows.select((F.shiftleft(F.col("part").cast("long"), 32) + F.col("i")).alias("number"), "t.term", F.col("t.df").cast("long").alias("df"))

    def vocabulary(self) -> DataFrame:
        return self.numbered().select("term", "df", self._idf().alias("idf"))

    def size(self) -> int:
        return self.parts.agg(F.sum(F.size("terms"))).first()[0] or 0


def fit_in_blocks(corpus: DataFrame, settings: TfidfSettings = TfidfSettings(), keep: tuple[str, ...] = (), spelled: bool = False) -> Blocks:
    """As ``fit_transform_tfidf``, with rows that are whole documents, and arrays where that has a row for each posting.

    The corpus is taken apart once, by ``blocks.encode``. A block sends each part
    of the vocabulary one row of terms, and gets one back with what is known.
    """
    settings = in_blocks(corpus, settings)
    spark, n, n_docs = corpus.sparkSession, _tasks(corpus.sparkSession, settings), corpus.count()
    encoded, ids, homes = _encoded(corpus, settings, keep)
    encoded = materialize_buckets(encoded, "blocks", n, "home", compression="zstd")
    chunks = encoded.where("part IS NOT NULL").select("home", "part", "start", "chunk")
    known = chunks.groupBy("part").applyInArrow(blocks.merge(settings.min_df, float(settings.max_df) * n_docs), blocks.MERGED)
    known = materialize(known, "vocabulary", compression="zstd")
    back = known.where("home IS NOT NULL").select("home", "part", "known")
    docs = encoded if spelled else encoded.where("part IS NULL").select(*ids.names, "ids", "tfs")
    weigh_block = blocks.weigh(ids.names, n_docs, settings.sublinear_tf, spelled)
    words = [T.StructField("words", T.BinaryType())] if spelled else []
    with buckets_in_place(spark):
        weighed = docs.groupBy("home").cogroup(back.groupBy("home")).applyInArrow(weigh_block, T.StructType(ids.fields + blocks.WEIGHED.fields + words))
        weighed = materialize_buckets(weighed, "tfidf", n, "home", compression="zstd")
    parts = known.where("home IS NULL").select("part", "terms", "dfs")
    docs = weighed.where("words IS NULL").drop("words") if spelled else weighed
    return Blocks(docs, parts, homes, n_docs, settings, weighed if spelled else None)


def _encoded(corpus: DataFrame, settings: TfidfSettings, keep: tuple[str, ...] = ()) -> tuple[DataFrame, T.StructType, list[int]]:
    """Documents, and chunks of terms, as ``blocks.encode`` takes the corpus apart; the columns of a document; the homes of the blocks."""
    n = _tasks(corpus.sparkSession, settings)
    homes = _homes(corpus.sparkSession, n)
    clean = F.regexp_replace(F.lower("text") if settings.lowercase else F.col("text"), NO_TOKEN, " ")
    placed = corpus.select(home("doc_id", homes).alias("home"), F.pmod(F.hash("doc_id"), F.lit(n)).alias("block"), "doc_id", *keep, "text")
    placed = placed.repartitionById(n, "block").select("home", "doc_id", *keep, clean.alias("text"))
    # Rows of terms have none of these but the home.
    ids = T.StructType([T.StructField(c, placed.schema[c].dataType) for c in ("home", "doc_id", *keep)])
    schema = T.StructType(ids.fields + blocks.ENCODED.fields)
    return placed.mapInArrow(blocks.encode(settings.stop_words, settings.ngram_range, n, ids.names), schema), ids, homes


def fit_vocabulary_in_blocks(corpus: DataFrame, settings: TfidfSettings = TfidfSettings()) -> DataFrame:
    """As ``fit_tfidf``: a block sends each part of the vocabulary one row of terms."""
    settings, n_docs = in_blocks(corpus, settings), corpus.count()
    encoded, _, homes = _encoded(corpus, settings)
    chunks = encoded.where("part IS NOT NULL").select("home", "part", "start", "chunk")
    known = chunks.groupBy("part").applyInArrow(blocks.merge(settings.min_df, float(settings.max_df) * n_docs), blocks.MERGED)
    return Blocks(encoded, known.where("home IS NULL").select("part", "terms", "dfs"), homes, n_docs, settings).vocabulary()


def transform_in_blocks(corpus: DataFrame, vocab: DataFrame, settings: TfidfSettings = TfidfSettings()) -> DataFrame:
    """``doc_id, terms``, an array of (term, weight), of documents with any known term; equal ids are one document.

    A block sends each part of the vocabulary one row of terms, and gets one back with what is known. The result is stored in
    buckets by ``doc_id``, so that what is joined to it by that comes to it.
    """
    settings = in_blocks(corpus, settings)
    n = _tasks(corpus.sparkSession, settings)
    encoded, ids, _ = _encoded(corpus, settings)
    encoded = materialize_buckets(encoded, "blocks", n, "home", compression="zstd")
    chunks = encoded.where("part IS NOT NULL").select("home", "part", "start", "chunk")
    vocab = vocab.select("term", "idf").mapInArrow(blocks.parts_of(n), "part INT, words BINARY")
    known = chunks.groupBy("part").cogroup(vocab.groupBy("part")).applyInArrow(blocks.match, "home INT, known BINARY")
    schema = T.StructType([ids["doc_id"], T.StructField("terms", T.ArrayType(T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])))])
    terms = encoded.groupBy("home").cogroup(known.groupBy("home")).applyInArrow(blocks.terms_of_documents(settings.sublinear_tf), schema)
    return materialize_buckets(terms, "terms", n, "doc_id", compression="zstd")


def fit_transform_in_blocks(corpus: DataFrame, settings: TfidfSettings = TfidfSettings(),
                            keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[int]]:
    """As ``fit_transform_tfidf``, and the homes of the blocks; features carry the ``home`` of their block, by which they are
    stored in buckets, and the number of their term.

    What is grouped by home and document, or joined (``buckets_in_place``) by
    home and others with rows that are ``repartition(len(homes), "home")``,
    leaves the features where they are.
    """
    fitted = fit_in_blocks(corpus, settings, keep)
    return fitted.features(), fitted.vocabulary(), fitted.homes


def _homes(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` blocks a number that hashing deals to the partition of that block; ``n`` rows reach the driver."""
    tried, found = 32 * n, {}
    while len(found) < n:
        dealt = spark.range(tried).select(F.col("id").cast("int").alias("home"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("block"))
        found = {r["block"]: r["home"] for r in dealt.groupBy("block").agg(F.min("home").alias("home")).collect()}
        tried *= 2
    return [found[b] for b in range(n)]


def home(doc_id: str, homes: list[int]) -> Column:
    """The home of a document's block."""
    return F.get(F.array(*[F.lit(h) for h in homes]), F.pmod(F.hash(doc_id), F.lit(len(homes))))


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term STRING, df LONG, idf DOUBLE").parquet(path)
