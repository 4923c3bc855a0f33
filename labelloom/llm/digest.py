"""Document fingerprints: quartile bucket digests.

Every triplet of bytes within a window of five is hashed into one of 256
buckets. The digest holds, for each bucket, the quartile of the bucket counts
that its own count falls in (two bits), and the length on a logarithmic scale.
Two digests are compared by the distance of their quartiles and lengths, as a
likeness between 0 and 1; equal digests have likeness 1.

Defined results: null and empty texts have the digest of no bytes; texts under
three bytes have no triplet and are told apart by their length alone; equal
texts have equal digests, so repeated rows agree. A text of any length is read
whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import query, slices, table

BUCKETS = 256
# Positions of the triplets in a window of five bytes: each starts with the first.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
# Likeness lost for each step of the length scale, and at most for length.
LENGTH_STEP, LENGTH_MOST = 0.01, 0.25
_WEIGHTS = np.array([(2654435761 * (2 * k + 1)) & 0xFFFFFFFF for k in range(3)], dtype=np.uint32)


def counts(raw: bytes) -> np.ndarray:
    """Triplets in each bucket."""
    data = np.frombuffer(raw, dtype=np.uint8)
    total = np.zeros(BUCKETS, dtype=np.int64)
    # Whole text in pieces, so that a long one needs no memory in proportion.
    for start in range(0, len(data), 1 << 20):
        piece = data[start:start + (1 << 20) + 4].astype(np.uint32)
        for salt, places in enumerate(TRIPLETS):
            n = min(len(piece) - places[2], 1 << 20)
            if n > 0:
                mixed = np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)
                for place, weight in zip(places, _WEIGHTS):
                    mixed = (mixed ^ piece[place:place + n]) * weight
                    mixed ^= mixed >> np.uint32(15)
                total += np.bincount(mixed & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return total


def digest(text: str | None) -> str:
    """Lower-case hex: one byte of length, then two bits for each bucket."""
    raw = (text or "").encode()
    total = counts(raw)
    cuts = np.partition(total, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = (total[:, None] > cuts).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    length = min(255, round(8 * np.log2(1 + len(raw))))
    packed = quartile[:, 0] << 6 | quartile[:, 1] << 4 | quartile[:, 2] << 2 | quartile[:, 3]
    return bytes([length]).hex() + packed.tobytes().hex()


def _parts(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), dtype=np.uint8).reshape(len(digests), -1)
    body = raw[:, 1:]
    quartiles = np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3], axis=2).reshape(len(raw), -1)
    return raw[:, 0].astype(np.int64), quartiles.astype(np.int16)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 less the share of the greatest quartile distance, less a bounded part for length; 0 at least.

    A step between neighbouring quartiles counts 1, from end to end it counts 6:
    such a jump is no noise.
    """
    if not a:
        return np.zeros(0)
    (la, qa), (lb, qb) = _parts(a), _parts(b)
    steps = np.abs(qa - qb)
    apart = np.where(steps == 3, 6, steps).sum(axis=1) / (6 * BUCKETS)
    length = np.minimum(LENGTH_STEP * np.maximum(np.abs(la - lb) - 1, 0), LENGTH_MOST)
    # Unrelated texts lie about a quarter of the greatest distance apart: the scale is stretched to use 0 to 1.
    return np.clip(1 - 2 * apart - length, 0.0, 1.0)


def fingerprints(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "fingerprint") -> DataFrame:
    """``keep`` columns and the digest of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = pa.array([digest(t) for t in batch.column("_text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*keep, out])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.StringType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def with_next(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", per_partition: int = 8) -> DataFrame:
    """``doc_id, text, bucket, guest``: documents in ascending id, dealt into ranges that each end with the first document of the next.

    The texts are shuffled once. The ranges are cut at quantiles of the id, some
    for each shuffle partition, and only the cuts and the first id of each range
    reach the driver. Rows are sorted by id (null first), then text, within
    (bucket, guest); guests only serve as the next of the row before.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = partitions * per_partition
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], F.lit(10 * n)).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))
    bounds = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, ids.fillna(0).astype("int64"), side="left")
        return pd.Series(np.where(ids.isna(), 0, at).astype(np.int32))

    firsts = sorted((r["bucket"], r["m"]["doc_id"]) for r in rows.select("doc_id", range_of("doc_id").alias("bucket")).groupBy("bucket").agg(
        F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("m")).collect())
    # The first document of a range also goes, as a guest, to the range before; that of the first range to the last.
    hosts = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    null_host = hosts.pop(None, -1)

    @F.pandas_udf("int")
    def host_of(ids: pd.Series) -> pd.Series:
        return pd.Series([hosts.get(int(x), -1) if x == x and x is not None else null_host for x in ids.tolist()], dtype="int32")

    both = F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest")),
                   F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest")))
    dealt = (rows.select("doc_id", "text", range_of("doc_id").alias("own"), host_of("doc_id").alias("host"))
             .select("doc_id", "text", F.explode(both).alias("at")).filter("at.bucket >= 0"))
    return (dealt.select("doc_id", "text", "at.bucket", "at.guest").repartition(partitions, "bucket")
            .sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text"))


def edited(text: str, after: str) -> str:
    """The last half of a text replaced by as much of another's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def compare_next(ordered: DataFrame) -> DataFrame:
    """Digests of each document and of its edited text, and their likeness to each other and to the next document's.

    ``ordered`` is what ``with_next`` returns; a row needs the row after it only.
    """
    def rows(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in slices(batches, "text"):
            for doc_id, text, bucket, guest in zip(*map(pa.Array.to_pylist, batch.columns)):
                mark = digest(text)
                if held is not None and held[2] == bucket and not held[3]:
                    changed = edited(held[1], text)
                    yield (held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(), held[4], digest(changed), mark)
                held = (doc_id, text, bucket, guest, mark)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pack(some: list[tuple]) -> pa.RecordBatch:
        ids, sizes, shas, own, changed, after = map(list, zip(*some))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas), pa.array(own), pa.array(changed),
             pa.array(likeness(own, changed)), pa.array(likeness(own, after))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in rows(batches):
            out.append(row)
            if len(out) == 1000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return ordered.select("doc_id", "text", "bucket", "guest").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@query("op4_digest")
def op4(spark, sf_dir):
    return compare_next(with_next(table(spark, sf_dir, "documents")))
