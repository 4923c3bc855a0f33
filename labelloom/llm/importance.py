"""Importance resampling towards a target distribution, by hashed n-grams.

Features of a text are its runs of one to two consecutive words, hashed into
buckets. The gain of a bucket is the logarithm of its smoothed share in the
target over that in the corpus; a document's weight is the mean gain of its
features, and Gumbel noise from a hash of its id turns the highest scores into
a draw without replacement.

Line feeds separate words, so a text is cut into lines: each distinct line of
the corpus is cut into words and hashed once and its counts multiplied by its
occurrences, and later each distinct line adds up its gains once for all
documents that hold it. The n-grams that reach from one line to the next are
added for each document separately. Only keys of lines are joined to documents;
a line that a third of all documents share is one row on its side of that join,
and adaptive execution splits the other.

Defined results: null and empty texts have no features and weight 0; rows that
repeat a document are documents each; documents of a null id hash the empty id;
texts of any length count whole. With an empty target or corpus the smoothing
alone gives the gains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import query, slices, table
from labelloom.session import materialize, small_table


@dataclass(frozen=True)
class ResampleSettings:
    buckets: int = 10_000    # at most 65,536
    least_words: int = 20
    percent: int = 25
    seed: int = 7


# Bytes of words stay, those of A to Z become lower case, all others part words; a line feed also parts lines.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b == 0x0A or b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def _hashes(words: list[bytes]) -> list[int]:
    """Checksums of the words and of the pairs of neighbours; that of a pair goes on from that of its first word."""
    single = list(map(crc32, words))
    return single + list(map(crc32, words[1:], map(crc32, repeat(b" "), single)))


def _crossing(lines: list[bytes]) -> list[int]:
    """Checksums of the pairs that reach from one of the lines, which all have words, to the next."""
    last = [line.rsplit(None, 1)[-1] for line in lines[:-1]]
    return list(map(crc32, [line.split(None, 1)[0] for line in lines[1:]], map(crc32, repeat(b" "), map(crc32, last))))


def _packed(hashes: list[int], buckets: int) -> bytes:
    return (np.array(hashes, dtype=np.uint32) % np.uint32(buckets)).astype("<u2").tobytes()


def occurrences(docs: DataFrame, how: ResampleSettings, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row``, ``keep``, the keys of each document's lines with words, and the buckets of the pairs across lines; a written table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            keys, across = [], []
            for value in batch.column("_text").to_pylist():
                raw = (value or "").encode().split(b"\n")
                lines = [line.translate(_WORDS) for line in raw]
                full = [bool(line) and not line.isspace() for line in lines]
                keys.append(list(map(xxhash.xxh3_128_digest, compress(raw, full))))
                across.append(_packed(_crossing(list(compress(lines, full))), how.buckets))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.list_(pa.binary())), pa.array(across, pa.binary())],
                                             ["row", *keep, "lines", "across"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([T.StructField("row", T.LongType()), *[docs.schema[c] for c in keep],
                           T.StructField("lines", T.ArrayType(T.BinaryType())), T.StructField("across", T.BinaryType())])
    return materialize(rows.mapInArrow(run, schema), "occurrences")


def segments(docs: DataFrame, how: ResampleSettings, *, text: str = "text") -> DataFrame:
    """``key, times, buckets``: each distinct line once, how often it stands in the corpus, and its features; a written table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "line"):
            lines = [line.encode() for line in batch.column("line").to_pylist()]
            words = [line.translate(_WORDS).split() for line in lines]
            keys = pa.array(list(map(xxhash.xxh3_128_digest, lines)), pa.binary())
            found = pa.array([_packed(_hashes(w), how.buckets) for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, batch.column("times"), found], ["key", "times", "buckets"]).filter(pa.array(map(bool, words), pa.bool_()))

    lines = docs.select(F.explode(F.split(F.col(f"`{text}`"), "\n")).alias("line")).filter("line <> ''")
    return materialize(lines.groupBy("line").agg(F.count("*").alias("times")).mapInArrow(run, "key binary, times long, buckets binary"), "segments")


def _counted(buckets: pa.Array, times: np.ndarray, of: int) -> np.ndarray:
    """Sums per bucket of how often each row counts."""
    raw = buckets.to_pylist()
    sizes = np.array([len(b) // 2 for b in raw], dtype=np.int64)
    flat = np.frombuffer(b"".join(raw), dtype="<u2")
    return np.bincount(flat, weights=np.repeat(times, sizes), minlength=of).astype(np.int64)


def feature_counts(lines: DataFrame, rows: DataFrame, how: ResampleSettings) -> np.ndarray:
    """Features of a corpus in each bucket: distinct lines times their occurrences, and the pairs across lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, dtype=np.int64)
        for batch in slices(batches, "buckets"):
            total += _counted(batch.column("buckets"), batch.column("times").to_numpy(), how.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    both = lines.select("times", "buckets").unionAll(rows.select(F.lit(1).cast("long").alias("times"), F.col("across").alias("buckets")))
    counts = both.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(how.buckets, dtype=np.int64)
    for r in counts.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed share in the target over that in the corpus."""
    n, all_target, all_corpus = len(target), int(target.sum()), int(corpus.sum())
    return np.array([floor(1000 * log((t + 1) * (all_corpus + n) / ((s + 1) * (all_target + n))))
                     for t, s in zip(target.tolist(), corpus.tolist())], dtype=np.int64)


def weights(rows: DataFrame, lines: DataFrame, gain: np.ndarray, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row``, ``keep``, ``n_features`` and ``weight``, the floored mean gain, of each document."""
    def added(name: str, *kept: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, name):
                raw = batch.column(name).to_pylist()
                sizes = np.array([len(b) // 2 for b in raw], dtype=np.int64)
                sums = np.concatenate([[0], np.cumsum(gain[np.frombuffer(b"".join(raw), dtype="<u2")])])
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])],
                                                 [*kept, "n", "sum"])
        return run

    once = lines.select("key", "buckets").mapInArrow(added("buckets", "key"), "key binary, n long, sum long")
    held = rows.select("row", F.explode("lines").alias("key")).join(once, "key").select("row", "n", "sum")
    across = rows.select("row", "across").mapInArrow(added("across", "row"), "row long, n long, sum long")
    total = held.unionAll(across).groupBy("row").agg(F.sum("n").alias("n_features"), F.sum("sum").alias("_sum"))
    # Floors go down: the remainder is taken off before dividing.
    mean = ((F.col("_sum") - F.pmod("_sum", "n_features")) / F.col("n_features")).cast("long")
    return rows.select("row", *[F.col(f"`{c}`") for c in keep]).join(total, "row").select(
        "row", *[F.col(f"`{c}`") for c in keep], "n_features", F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0).cast("long")).alias("weight"))


def draw(weighted: DataFrame, how: ResampleSettings, *, doc_id: str = "doc_id") -> DataFrame:
    """``weighted`` with ``score`` and ``rank``: the best scores of the documents that are long enough, in order; null for those not drawn.

    Scores are thousandths of logarithms, so there are some hundred thousand
    different ones at most, and the noise spreads any group of copies over
    thousands. Counts per score give the rank at which each score begins; only
    documents of one score are sorted together.
    """
    key = F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    # A text of w words has 2 w - 1 features.
    long_enough = F.col("n_features") >= max(0, 2 * how.least_words - 1)
    scored = materialize(weighted.withColumn("score", F.col("weight") + noise).withColumn("_able", long_enough), "scored")
    counts = materialize(scored.filter("_able").groupBy("score").agg(F.count("*").alias("n")), "scores")
    able = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    places = how.percent * able // 100
    better = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    begin = counts.select("score", F.coalesce(F.sum("n").over(better), F.lit(0)).alias("_before")).filter(F.col("_before") < places)
    begin = small_table(begin, 200_000)
    near = scored.join(begin, "score", "left").withColumn("_near", F.col("_able") & F.col("_before").isNotNull())
    order = W.partitionBy("score").orderBy(F.col(f"`{doc_id}`").asc_nulls_last(), "row")
    rank = F.col("_before") + F.row_number().over(order)
    ranked = near.filter("_near").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= places, F.col("rank")).cast("long"))
    rest = near.filter("not _near").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("_able", "_before", "_near")


def resample(docs: DataFrame, target: DataFrame, how: ResampleSettings = ResampleSettings(), *, text: str = "text", doc_id: str = "doc_id",
             target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document."""
    rows, lines = occurrences(docs, how, text=text, keep=(doc_id,)), segments(docs, how, text=text)
    wanted = feature_counts(segments(target, how, text=target_text), occurrences(target, how, text=target_text, keep=()), how)
    gain = gains(wanted, feature_counts(lines, rows, how))
    return draw(weights(rows, lines, gain, keep=(doc_id,)), how, doc_id=doc_id).select(F.col(f"`{doc_id}`").alias("doc_id"), "n_features", "weight", "score", "rank")


@query("op13_importance")
def op13(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
