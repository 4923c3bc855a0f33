"""Batch inference over documents with an injected model function.

A model function maps batches of requests (``custom_id, prompt, messages,
max_tokens, model, temperature, seed, num_ctx``) to batches of replies
(``custom_id, content``, and where it knows them the tokens of ``USAGE`` and a
``batch_id``). Everything around it is table work: keys, cache, one request per
distinct document, prompts, distribution, parsing, and handing each reply back
to all its documents.

Replies are written before anything reads them. A plan that contained the model
call could be evaluated twice, and would then call the model twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions import text as X
from labelloom.functions.prompts import PromptSet, classify_prompt, categories_block, summary_prompt
from labelloom.functions.replies import first_text, first_tool_input, reply_category, request_cost
from labelloom.functions.vectors import l2_normalize
from labelloom.operators.joins import fan_out_join, missing_keys
from labelloom.session import materialize
from labelloom.sources import caches

ModelFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
REPLY = T.StructType([T.StructField("custom_id", T.StringType()), T.StructField("content", T.StringType()),
                      *[T.StructField(c, T.LongType()) for c in USAGE], T.StructField("batch_id", T.StringType())])

# Fixed value: output tokens allowed for a classification reply.
CLASSIFY_MAX_TOKENS = 64
RAW_KEY = "raw"
NUM_CTX = 16384
# Characters of text for a task that calls the model, where the number of those tasks is fixed.
CALL_CHARS = 1 << 27


@dataclass
class Meter:
    """What the model calls of a run used, summed from the replies as they were written."""

    totals: dict = field(default_factory=lambda: dict.fromkeys(("n_calls", *USAGE), 0) | {"total_cost_usd": 0.0})
    batch_ids: set = field(default_factory=set)
    seconds: dict = field(default_factory=dict)

    def add(self, kind: str, counted: dict, seconds: float) -> None:
        for name in self.totals:
            self.totals[name] += counted.get(name) or 0
        self.batch_ids.update(counted.get("batch_ids") or ())
        self.seconds[kind] = self.seconds.get(kind, 0.0) + seconds

    def usage(self) -> dict:
        return self.totals | {"total_cost_usd": round(self.totals["total_cost_usd"], 6), "batch_ids": sorted(self.batch_ids)}


@dataclass(frozen=True)
class Backend:
    """A model function and how to drive it.

    ``parallel_calls`` is the number of tasks that call the model at once (more
    text than these hold is sent in rounds, one after the other),
    ``rows_per_call`` the number of requests handed over at a time. With
    ``prompt_tokens`` a prompt that needs more than ``num_ctx`` tokens gets a
    larger context window, up to ``max_ctx``. ``price`` is in dollars for a
    million tokens (see ``request_cost``), halved for ``batch`` calls.
    """

    name: str
    fn: ModelFn
    parallel_calls: int | None = None
    rows_per_call: int | None = None
    num_ctx: int = NUM_CTX
    max_ctx: int | None = None
    prompt_tokens: Callable[[Column], Column] | None = None
    price: dict[str, float] | None = None
    batch: bool = False
    meter: Meter | None = None


BACKENDS: dict[str, Callable[..., Backend]] = {}


def register_backend(name: str, factory: Callable[..., Backend]) -> None:
    BACKENDS[name] = factory


def make_backend(name: str, **settings) -> Backend:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known: {sorted(BACKENDS)}")
    return BACKENDS[name](**settings)


def text_requests(df: DataFrame, custom_id: Column, prompt: Column, max_tokens: Column) -> DataFrame:
    return df.select(custom_id.alias("custom_id"), prompt.alias("prompt"), F.lit(None).cast(MESSAGES).alias("messages"),
                     max_tokens.cast("int").alias("max_tokens"))


def conversation_requests(turns: DataFrame, max_tokens: int = 1024, **options) -> DataFrame:
    """One request per conversation (``conv_id, turn, role, text``), messages in turn order."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    messages = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    grouped = turns.groupBy("conv_id").agg(messages.alias("messages"))
    requests = grouped.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("custom_id"),
                              F.lit(None).cast("string").alias("prompt"), "messages", F.lit(max_tokens).alias("max_tokens"))
    return with_options(requests, **options)


def with_options(requests: DataFrame, *, model: str | None = None, temperature: float = 0.0, seed: int = 0,
                 num_ctx: Column | int = NUM_CTX) -> DataFrame:
    """Requests with what a call is to be made with; every request names its own context window."""
    window = num_ctx if isinstance(num_ctx, Column) else F.lit(int(num_ctx))
    return requests.withColumns({"model": F.lit(model).cast("string"), "temperature": F.lit(float(temperature)),
                                 "seed": F.lit(int(seed)), "num_ctx": window.cast("long")})


def spread(df: DataFrame, backend: Backend, key: str) -> DataFrame:
    """Documents over the tasks that will call the model.

    An explicit number, as the cost of a call has nothing to do with bytes and
    adaptive coalescing must not merge the calls. Done before prompts are
    rendered, so templates and worked examples are not shuffled with every row.
    """
    return df.repartition(_tasks(df, backend), key)


def _tasks(df: DataFrame, backend: Backend) -> int:
    return backend.parallel_calls or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread_by_window(df: DataFrame, backend: Backend, key: str, sizes: dict[int, int]) -> DataFrame:
    """As ``spread``, but no task gets two context windows, so a backend sets its window once a task.

    ``sizes`` has the rows of each ``num_ctx``, of which there are few: they are
    powers of two. Each window gets tasks by its share of the rows, one at least.
    """
    total, tasks, first, placed = max(1, sum(sizes.values())), _tasks(df, backend), 0, F.lit(0)
    for window, rows in sorted(sizes.items()):
        share = max(1, round(tasks * rows / total))
        at = F.lit(first) + F.pmod(F.xxhash64(key, "text"), F.lit(share))
        placed = F.when(F.col("num_ctx") == window, at).otherwise(placed)
        first += share
    return df.repartitionById(max(1, first), placed.cast("int"))


def run_model(requests: DataFrame, backend: Backend, kind: str = "requests") -> DataFrame:
    """The replies of ``REPLY`` for every request the model answered, written to the shared folder.

    One task per partition of ``requests``; see ``spread``. For the backend's
    meter, calls, tokens and cost are summed from the narrow columns of what was
    written: contents are not read again, and a task that ran twice counts once.
    (An observation on the write would do, but leaves its session unable to ship
    linear models that were fitted in it: their closures then hold its manager.)
    """
    fn, rows = backend.fn, backend.rows_per_call

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chunks():
            for pdf in batches:
                step = rows or max(len(pdf), 1)
                for start in range(0, len(pdf), step):
                    yield pdf.iloc[start:start + step]
        for reply in fn(chunks()):
            reply = reply.reindex(columns=REPLY.names)
            yield reply.astype({c: "Int64" for c in USAGE} | {"batch_id": object})

    started = time.perf_counter()
    replies = materialize(requests.mapInPandas(call, REPLY), "replies")
    if backend.meter is not None:
        elapsed = time.perf_counter() - started
        dollars = request_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_input_tokens"),
                               batch=backend.batch, price=backend.price)
        counted = replies.agg(F.count("*").alias("n_calls"), *[F.sum(c).alias(c) for c in USAGE],
                              F.sum(dollars).alias("total_cost_usd"), F.collect_set("batch_id").alias("batch_ids")).first()
        backend.meter.add(kind, counted.asDict(), elapsed)
    return replies


class MissingReplies(RuntimeError):
    """Some requests came back without a reply; what did arrive is in the cache."""


def keyed_documents(docs: DataFrame, fractions: list[float], *, model_tag: str, prompts: PromptSet,
                    temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """Documents times fractions with word counts, target and cache key.

    Fractions of 1 or more stand for the document itself: key "raw", no request.
    """
    return _keyed(docs, fractions, model_tag=model_tag, prompts=prompts, temperature=temperature, seed=seed).drop("_place", "_chars")


def _place() -> Column:
    """Where a text is looked for: a hash of its id and of the text itself, so ids that many texts share find few candidates."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame, fractions: list[float], *, model_tag: str, prompts: PromptSet, temperature: float, seed: int) -> DataFrame:
    """As ``keyed_documents``, with the place and the length of each text."""
    # Words and digest are taken once per document, below the explode. A null text counts as empty.
    counted = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", X.word_count("text", at_least_one=True).alias("source_words"),
                          X.doc_digest("text").alias("_digest"), _place().alias("_place"), F.length("text").cast("long").alias("_chars"))
    swept = counted.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    asked = F.greatest(F.lit(X.MIN_TARGET_WORDS), F.ceil(F.col("fraction") * F.col("source_words")).cast("int"))
    is_raw = F.col("fraction") >= 1.0
    sized = swept.withColumn("target_words", F.when(is_raw, F.col("source_words")).otherwise(asked))
    key = X.summary_key(digest="_digest", target="target_words", model_tag=model_tag,
                        prompt_version=prompts.cache_version, temperature=temperature, seed=seed)
    return sized.withColumn("cache_key", F.when(is_raw, F.lit(RAW_KEY)).otherwise(key)).drop("_digest")


def summary_requests(misses: DataFrame, prompts: PromptSet) -> DataFrame:
    return text_requests(misses, F.col("cache_key"),
                         summary_prompt(prompts.summary, F.col("target_words"), F.col("text")),
                         X.output_budget("target_words"))


def summarize(docs: DataFrame, fractions: float | list[float], *, backend: Backend, model_tag: str, prompts: PromptSet,
              cache_path: str, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """``doc_id, fraction, summary, cache_key, cache_hit, target_words, source_words``, one row per document and fraction.

    Copies of a document share a key. They are collapsed by a partial
    aggregation before anything is shuffled on the key, so a document that makes
    up a third of the corpus costs one request and one row per task.
    """
    spark = docs.sparkSession
    fractions = fractions if isinstance(fractions, list) else [fractions]
    keyed = _keyed(docs, fractions, model_tag=model_tag, prompts=prompts, temperature=temperature, seed=seed)
    raw = keyed.where(F.col("cache_key") == RAW_KEY).select(
        "doc_id", "fraction", F.col("text").alias("summary"), "cache_key", F.lit(True).alias("cache_hit"),
        "target_words", "source_words")
    if all(f >= 1.0 for f in fractions):
        return raw
    known = caches.read_summaries(spark, cache_path, model_tag, prompts.version)
    ids = materialize(keyed.where(F.col("cache_key") != RAW_KEY).select(
        "doc_id", "fraction", "cache_key", "target_words", "source_words", "_place", "_chars", F.monotonically_increasing_id().alias("_row")), "summary-keys")
    # Narrow keys meet the cache first; texts are fetched only for what it lacks. Rows of a key share text and lengths.
    keys = ids.groupBy("cache_key").agg(*[F.min(c).alias(c) for c in ("_place", "_chars", "fraction", "target_words", "source_words")])
    keys = materialize(keys, "summary-distinct-keys")
    lacking = materialize(missing_keys(keys, known), "summary-misses-keys")

    def key(digest: Column, asked: Column) -> Column:
        return X.summary_key(digest=digest, target=asked["target_words"], model_tag=model_tag, prompt_version=prompts.cache_version,
                             temperature=temperature, seed=seed)

    # A text is moved and stored once, with all keys that want it; it is repeated only where its prompts are written.
    n_rounds = _rounds(lacking, backend)
    misses = fetch_texts(docs, lacking, key).withColumn("_round", F.pmod(F.xxhash64(F.col("asked")[0]["cache_key"]), F.lit(n_rounds)).cast("int"))
    misses = materialize(misses, "summary-misses", ("_round",) if n_rounds > 1 else ())
    _same_number(lacking, misses.select(F.explode("asked")))
    replies = []
    for n in range(n_rounds):
        texts = misses.where(F.col("_round") == n) if n_rounds > 1 else misses
        spread_texts = spread(texts.withColumn("_first", F.col("asked")[0]["cache_key"]), backend, "_first")
        requests = with_options(summary_requests(spread_texts.select("text", F.inline("asked")), prompts), model=model_tag,
                                temperature=temperature, seed=seed, num_ctx=backend.num_ctx)
        replies.append(run_model(requests, backend, "summarize"))
    replies = reduce(DataFrame.unionByName, replies)

    # What is kept of a text beside its summary is narrow: texts are not moved again.
    answered = misses.select("digest", F.inline("asked")).join(replies.withColumnRenamed("custom_id", "cache_key"), "cache_key")
    fresh = answered.where(F.col("content").isNotNull()).select(
        "cache_key", X.strip_spaces("content").alias("text"), F.col("digest").alias("doc_sha1"), "target_words",
        "source_words", "fraction", F.lit(float(temperature)).alias("temperature"), F.lit(int(seed)).alias("seed"),
        F.lit(model_tag).alias("model_tag"), F.lit(prompts.version).alias("prompt_version"))
    # Which keys were there before is settled before the cache grows.
    hits = materialize(caches.lookup(keys.join(lacking, "cache_key", "left_anti"), known, "text").withColumnRenamed("text", "summary"), "summary-hits")
    caches.append_summaries(fresh, cache_path, model_tag, prompts.version)
    arrived = replies.where(F.col("content").isNotNull()).select(F.col("custom_id").alias("cache_key"))
    lost = lacking.join(arrived, "cache_key", "left_anti").count()
    if lost:
        raise MissingReplies(f"{lost} summaries missing; some requests failed or expired")

    # The new summaries are read from the cache, where they are stored anyway.
    grown = caches.read_summaries(spark, cache_path, model_tag, prompts.version)
    made = caches.lookup(lacking, grown, "text").withColumnRenamed("text", "summary")
    texts = hits.withColumn("cache_hit", F.lit(True)).unionByName(made.withColumn("cache_hit", F.lit(False)))
    done = fan_out_join(ids.drop("_place", "_chars"), texts, "cache_key", "_row").drop("_row")
    return raw.unionByName(done)


def _rounds(lacking: DataFrame, backend: Backend) -> int:
    """How often the model's tasks have to be filled so that none gets more than about ``CALL_CHARS`` of text.

    Only a number of calls that the backend fixes needs this; else the session's shuffle partitions go by the input.
    """
    if backend.parallel_calls is None:
        return 1
    texts = lacking.groupBy("_place").agg(F.max("_chars").alias("n")).agg(F.sum("n").alias("n")).first()["n"] or 0
    return max(1, -(-texts // (backend.parallel_calls * CALL_CHARS)))


def fetch_texts(docs: DataFrame, lacking: DataFrame, key: Callable[[Column, Column], Column]) -> DataFrame:
    """``text, digest, asked``: each distinct text that ``lacking`` wants, with its rows there as an array of structs.

    ``lacking`` has unique ``cache_key`` and ``_place``, see above, of a document that
    has the text. A place only finds candidates, as hashes may be shared. What a
    text is a text of is told by its keys, made anew from its digest.
    """
    wanted = lacking.groupBy("_place").agg(F.collect_list(F.struct(*[c for c in lacking.columns if c not in ("_place", "_chars")])).alias("asked"))
    named = docs.select(_place().alias("_place"), F.coalesce("text", F.lit("")).alias("text"))
    # The texts stream past the keys and are not sorted; what is taken apart by key is a text's own array.
    found = named.join(wanted.hint("shuffle_hash"), "_place").withColumn("digest", X.doc_digest("text"))
    own = found.withColumn("asked", F.filter("asked", lambda a: a["cache_key"] == key(F.col("digest"), a))).where(F.size("asked") > 0)
    # Copies of a text under one id share their place, and so the task.
    return own.dropDuplicates(["_place", "digest"]).drop("_place")


def _same_number(lacking: DataFrame, fetched: DataFrame) -> None:
    wanted, got = lacking.count(), fetched.count()
    if wanted != got:
        raise RuntimeError(f"{wanted} keys lack a result but {got} texts were found for them; did the documents change meanwhile?")


def join_replies(requests: DataFrame, replies: DataFrame, strict: bool = False) -> DataFrame:
    """Requests with their reply by id. Without a reply: null content, or an error when strict."""
    joined = requests.join(replies.select("custom_id", "content"), "custom_id", "left")
    if strict:
        lost = joined.where(F.col("content").isNull()).count()
        if lost:
            raise MissingReplies(f"{lost} replies missing; some requests failed or expired")
    return joined


def parse_predictions(replies: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``pred_label, pred_idx``; null unless the reply is strict JSON that names a known class."""
    said = replies.withColumn("_said", reply_category("content"))
    dim = labels.select(F.col("label_name").alias("pred_label"), F.col("label_idx").alias("pred_idx"))
    return said.join(dim, said["_said"] == dim["pred_label"], "left").drop("_said")


def classify_requests(texts: DataFrame, labels: DataFrame, *, backend: Backend, prompts: PromptSet, examples_block: str = "",
                      model: str | None = None, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """Requests to classify each ``doc_id, text``, spread over tasks of one context window each.

    Where the backend counts prompt tokens, each request names the window that
    its prompt needs; a prompt that fits none fails the job before any request.
    """
    cats = categories_block(labels).first()
    prompt = classify_prompt(prompts.classify, n_categories=cats["n_categories"],
                             categories_block=cats["categories_block"], text=F.col("text"), examples_block=examples_block)
    if backend.prompt_tokens is None:
        placed = spread(texts.withColumn("num_ctx", F.lit(int(backend.num_ctx)).cast("long")), backend, "doc_id")
    else:
        budget = X.context_budget(backend.prompt_tokens(prompt), num_ctx=backend.num_ctx, max_ctx=backend.max_ctx)
        sized = texts.select("*", budget.alias("_b")).select(*texts.columns, F.col("_b.num_ctx").alias("num_ctx"), "_b")
        windows = sized.groupBy("num_ctx").agg(F.count("*").alias("n"), F.max("_b.required").alias("most"),
                                               F.count_if("_b.overflow").alias("over")).collect()
        over = sum(w["over"] for w in windows)
        if over:
            raise ValueError(f"{over} prompts exceed the context ceiling; the longest needs {max(w['most'] for w in windows)} tokens")
        placed = spread_by_window(sized.drop("_b"), backend, "doc_id", {w["num_ctx"]: w["n"] for w in windows})
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    requests = placed.select(request_id("doc_id").alias("custom_id"), F.lit(None).cast("string").alias("prompt"), F.array(message).alias("messages"),
                             F.lit(CLASSIFY_MAX_TOKENS).alias("max_tokens"), "num_ctx")
    return with_options(requests, model=model, temperature=temperature, seed=seed, num_ctx=F.col("num_ctx"))


def request_id(doc_id: str) -> Column:
    return F.concat(F.lit("doc"), F.col(doc_id).cast("string"))


def classify(texts: DataFrame, labels: DataFrame, *, backend: Backend, prompts: PromptSet, examples_block: str = "",
             prompt_tokens: Callable[[Column], Column] | None = None, num_ctx: int | None = None, max_ctx: int | None = None,
             model: str | None = None, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """``doc_id, pred_label, pred_idx`` for each ``doc_id, text``; null where the reply does not parse.

    ``prompt_tokens``, ``num_ctx`` and ``max_ctx`` stand in for the backend's.
    Ids are unique and not null here: a reply is handed back by id.
    """
    given = {"prompt_tokens": prompt_tokens, "num_ctx": num_ctx, "max_ctx": max_ctx}
    backend = replace(backend, **{k: v for k, v in given.items() if v is not None})
    requests = classify_requests(texts, labels, backend=backend, prompts=prompts, examples_block=examples_block,
                                 model=model, temperature=temperature, seed=seed)
    replies = run_model(requests, backend, "classify")
    ids = texts.select("doc_id", request_id("doc_id").alias("custom_id"))
    return parse_predictions(join_replies(ids, replies), labels).select("doc_id", "pred_label", "pred_idx")


def batch_outcomes(results: DataFrame, kind: str = "text", **cost) -> DataFrame:
    """``custom_id, content, usage columns, cost_usd`` of the results that succeeded; others are left out."""
    pick = first_text if kind == "text" else first_tool_input
    usage = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    cols = [F.coalesce(F.col(f"usage.{c}"), F.lit(0)).alias(c) for c in usage]
    cost.setdefault("batch", True)
    dollars = request_cost(F.col("usage.input_tokens"), F.col("usage.output_tokens"),
                           F.col("usage.cache_read_input_tokens"), **cost)
    return results.where(F.col("status") == "succeeded").select(
        "custom_id", pick(F.col("content")).alias("content"), F.col("usage").isNotNull().alias("has_usage"), *cols,
        dollars.alias("cost_usd"))


EncoderFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
VECTOR = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def embed(docs: DataFrame, encoder: EncoderFn, *, model_id: str, cache_path: str, prefix: str = "",
          normalize: bool = True, tasks: int | None = None) -> DataFrame:
    """``doc_id, embedding, cache_hit`` by an injected encoder, through a per-document cache.

    The encoder maps batches of ``cache_key, text`` to ``cache_key, embedding``.
    Only documents whose key is not cached are encoded, each distinct text once.
    """
    spark = docs.sparkSession

    def key(digest: Column) -> Column:
        return X.embedding_key(digest=digest, model_id=model_id, prefix=prefix, normalize=normalize)

    known = caches.read_embeddings(spark, cache_path, model_id)
    digest = X.doc_digest(F.coalesce("text", F.lit("")))
    ids = materialize(docs.select("doc_id", key(digest).alias("cache_key"), _place().alias("_place"), F.monotonically_increasing_id().alias("_row")), "embedding-keys")
    keys = materialize(ids.groupBy("cache_key").agg(F.min("_place").alias("_place")), "embedding-distinct-keys")
    lacking = materialize(missing_keys(keys, known), "embedding-misses-keys")
    found = fetch_texts(docs, lacking, lambda digest, _: key(digest)).select("text", F.inline("asked"))
    misses = materialize(found, "embedding-misses")
    _same_number(lacking, misses)
    inputs = misses.select("cache_key", X.with_prefix("text", prefix).alias("text"))
    inputs = inputs.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "cache_key")
    vectors = inputs.mapInPandas(encoder, VECTOR)
    if normalize:
        vectors = vectors.withColumn("embedding", l2_normalize(F.col("embedding")))
    fresh = materialize(vectors.select(
        "cache_key", "embedding", F.lit(prefix).alias("passage_prefix"), F.lit(normalize).alias("normalize_embeddings"),
        F.lit(model_id).alias("model_id")), "embeddings")
    hits = materialize(caches.lookup(keys.join(lacking, "cache_key", "left_anti"), known, "embedding"), "embedding-hits")
    caches.append_embeddings(fresh, cache_path)
    both = hits.withColumn("cache_hit", F.lit(True)).unionByName(
        fresh.select("cache_key", "embedding").withColumn("cache_hit", F.lit(False)))
    return fan_out_join(ids.drop("_place"), both, "cache_key", "_row").drop("cache_key", "_row")
