"""URL filters: rules first, then words of the host and path under naive Bayes.

Hosts are lists of labels that run words together. Each distinct label is
split by a unigram Viterbi: its substrings are joined with the counts of all
words of the crawl, and the split of highest probability wins. A multinomial
naive Bayes over the words of host and path then scores the URLs that no rule
settles. It learns from weak labels: a URL whose words hold a seed word is an
example of what to block, any other of what to allow; words that keep company
with seeds come to tell on their own.

All tables grow with the crawl and are joined, never collected: words, labels
and tokens are reduced by partial aggregation, and a hot host or token meets
its one row in a join that adaptive execution may split.

Defined results: a null URL or one without ``://`` has empty host and path, no
tokens, and is allowed unless the prior says otherwise; ties between splits go
to fewer words, then to the longer first word; of rules that fit equally long
the first listed wins; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import query, table
from labelloom.session import materialize

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Words that mark a URL as an example of what to block (a parameter: the policy's vocabulary).
SEEDS = ("adult", "ads", "bet", "bets", "betting", "casino", "cheap", "escort", "gambling", "jackpot", "loan", "loans", "malware",
         "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx")
# Longest word and label that are looked into; a longer label (DNS allows 63) stays one word.
LONGEST_WORD, LONGEST_LABEL = 20, 63
SMOOTHING = 1.0
# Occurrences that a seed word has besides those in the crawl.
SEED_COUNT = 50


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``verdict, rule`` of the longest rule that fits; null where none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    ordered = sorted(enumerate(rules), key=lambda r: (len(r[1][1] + r[1][2]), -r[0]))
    for _, (verdict, rule_host, rule_path) in ordered:
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(out)
    return out


def plain_words(text: Column) -> Column:
    """Runs of letters and of digits, lower case; digits all count as one word."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""),
                       lambda w: F.when(w.rlike("^[0-9]+$"), F.lit("0")).otherwise(w))


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """``word, n``: how often each run of letters occurs in all texts."""
    words = texts.select(F.explode(F.split(F.lower(F.coalesce(F.col(f"`{column}`"), F.lit(""))), "[^a-z]+")).alias("word"))
    return words.filter(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def _split(label: str, counts: dict[str, int], total: float) -> list[str]:
    """The likeliest way to cut a label into words; an unseen one costs as a run of unseen characters."""
    best: list[tuple[float, int, tuple[str, ...]]] = [(0.0, 0, ())]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            word = label[start:end]
            n = counts.get(word, 0)
            # An unseen word is less likely than a word seen once by a factor of ten, and as much again for each character.
            own = np.log(n / total) if n else -np.log(total) - (len(word) + 1) * np.log(10.0)
            score, words, way = best[start]
            options.append((round(score + own, 9), -(words + 1), way + (word,)))
        top = max(options, key=lambda o: (o[0], o[1], [len(w) for w in o[2]]))
        best.append((top[0], -top[1], top[2]))
    return list(best[-1][2])


def segment(labels: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``label, words`` of distinct labels (column ``label``).

    A label's substrings, some hundreds at most, are joined with the counts and
    gathered again by label; the Viterbi itself only sees what one label needs.
    """
    n = F.length("label")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), n - i + 1)), lambda k: F.substr(F.col("label"), i, k))))
    short = labels.filter(n.between(1, LONGEST_LABEL))
    spread = short.select("label", F.explode(F.array_distinct(pieces)).alias("word"))
    known = spread.join(counts, "word").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))

    @F.pandas_udf("array<string>")
    def cut(label: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([_split(x, dict(k) if k is not None else {}, float(total)) for x, k in zip(label, known)])

    done = short.join(known, "label", "left").select("label", cut("label", "known").alias("words"))
    return done.unionByName(labels.filter(n > LONGEST_LABEL).select("label", F.array("label").alias("words")))


def tokens(pages: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``host, path, token, n``: words of each distinct pair of host and path, those of the host after segmentation."""
    urls = pages.select("host", "path").distinct()
    parts = pages.select("host").distinct().select("host", F.posexplode(F.filter(F.split("host", r"[^a-z0-9]+"), lambda w: w != "")).alias("at", "label"))
    split = materialize(segment(parts.select("label").distinct(), counts, total), "segments")
    of_host = parts.join(split, "label").select("host", F.explode("words").alias("token"))
    of_host = materialize(of_host.groupBy("host", "token").agg(F.count("*").alias("n")), "host-words")
    of_path = urls.select("host", "path", F.explode(plain_words(F.col("path"))).alias("token")).withColumn("n", F.lit(1).cast("long"))
    return urls.join(of_host, "host").select("host", "path", "token", "n").unionByName(of_path)


def scores(found: DataFrame, weight: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """``host, path, score``: log odds that a URL is one to block, from its tokens.

    ``weight`` (host, path, pages) says how many pages have the URL. Both tables
    should be written ones.
    """
    marked = found.groupBy("host", "path").agg(F.max(F.col("token").isin(list(seeds)).cast("int")).alias("block"))
    examples = materialize(marked.join(weight, ["host", "path"]), "examples")
    sizes = examples.agg(F.sum(F.col("block") * F.col("pages")).alias("block"), F.sum("pages").alias("all")).first()
    blocked, everything = sizes["block"] or 0, sizes["all"] or 0
    counted = found.join(examples, ["host", "path"]).groupBy("token").agg(
        F.sum(F.when(F.col("block") == 1, F.col("n") * F.col("pages")).otherwise(0)).alias("block"),
        F.sum(F.when(F.col("block") == 0, F.col("n") * F.col("pages")).otherwise(0)).alias("allow"))
    counted = materialize(counted, "token-counts")
    totals = counted.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("tokens")).first()
    size = SMOOTHING * (totals["tokens"] or 0)
    odds = (F.log((F.col("block") + SMOOTHING) / F.lit(float((totals["block"] or 0) + size or 1)))
            - F.log((F.col("allow") + SMOOTHING) / F.lit(float((totals["allow"] or 0) + size or 1))))
    weights = materialize(counted.select("token", odds.alias("odds")), "token-odds")
    prior = float(np.log((blocked + 1) / (everything - blocked + 1)))
    return found.join(weights, "token").groupBy("host", "path").agg((F.sum(F.col("n") * F.col("odds")) + F.lit(prior)).alias("score"))


def judge(pages: DataFrame, counts: DataFrame, *, url: str = "url", keep: tuple[str, ...] = ("page_id",),
          rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """``keep`` columns, ``host, path, rule, verdict, score``; ``counts`` (word, n) is a written table."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 1
    address = F.col(f"`{url}`")
    split = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(address).alias("host"), path_of(address).alias("path"))
    split = materialize(split, "urls")
    weight = materialize(split.groupBy("host", "path").agg(F.count("*").alias("pages")), "distinct-urls")
    found = materialize(tokens(weight, counts, total), "url-tokens")
    scored = materialize(scores(found, weight, seeds), "url-scores")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = split.join(scored, ["host", "path"], "left").withColumn("_rule", rule)
    learned = F.when(F.coalesce("score", F.lit(-1.0)) > 0, "block").otherwise("allow")
    return judged.select(*[F.col(f"`{c}`") for c in keep], "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce("_rule.verdict", learned).alias("verdict"), "score")


def crawl_words(pages: DataFrame, *, url: str = "url", html: str = "html", seeds: Sequence[str] = SEEDS) -> DataFrame:
    """``word, n`` over the visible text and the paths of all pages; seed words count some times more.

    Hosts are left out: a name run together must not be a word because it is a name.
    """
    shown = pages.select(F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), "<[^>]*>", " ").alias("text"))
    paths = pages.select(path_of(F.col(f"`{url}`")).alias("text"))
    known = pages.sparkSession.createDataFrame([(w, SEED_COUNT) for w in seeds], "word string, n bigint")
    every = word_counts(shown, "text").unionByName(word_counts(paths, "text")).unionByName(known)
    return materialize(every.groupBy("word").agg(F.sum("n").alias("n")), "words")


@query("op7_url_filter")
def op7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judge(pages, crawl_words(pages))
