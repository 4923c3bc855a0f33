"""Hard-negative mining: exact integer inner products by Kronecker-packed multiplication.

Components are integers. Those of several candidates are biased to be
non-negative and laid into separate fields of one wide integer, so that one
multiplication by an anchor's component serves them all; after the sum over the
components the fields are unpacked, and the bias is taken off again. Fields are
as wide as the numbers at hand need. Where two or more fit a 64-bit word, words
are such words; otherwise they are Python's integers, which hold any width.

Work is dealt out in blocks of candidates against blocks of anchors. Positives
are looked for within a label only: a label of any size is cut into blocks by
row. Negatives are looked for in blocks of all rows, labels being told apart
inside, so no label, however many rows it holds, makes a larger block. From
each pair of blocks only the best few rows of an anchor go on.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; shorter vectors count as padded with zeros,
empty ones score 0; a row is no candidate of an anchor of the same id; ties go
to the smaller id; rows that repeat an id are candidates each, and anchors that
repeat an id share one ranking. Scores beyond 64 bits count as the greatest or
least 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import query, table
from labelloom.session import materialize

# Candidates and anchors of a block, anchors multiplied together, fields of a word that has no fixed width.
BLOCK, ANCHORS, STRIP, FIELDS = 8192, 4096, 64, 32
LONG = np.iinfo(np.int64)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact: as 64-bit numbers where all are small, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x)
    if not scaled.size or np.abs(scaled).max() < 2.0 ** 53:
        return scaled.astype(np.int64)
    whole = [int(s) if abs(s) < 2.0 ** 53 else int(v) * scale for s, v in zip(scaled.ravel().tolist(), x.ravel().tolist())]
    return np.array(whole, dtype=object).reshape(x.shape)


def packed_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors (m x d and n x d), as 64-bit numbers."""
    (m, _), (n, d) = anchors.shape, candidates.shape
    if not (m and n and d):
        return np.zeros((m, n), dtype=np.int64)
    low = int(candidates.min())
    span, weight = int(candidates.max()) - low, max(int(sum(map(abs, row))) for row in anchors.tolist())
    bits = (span * weight).bit_length() + 1
    fields, kind = 63 // bits, np.int64
    if fields < 2 or abs(low) * weight >> 62 or candidates.dtype == object or anchors.dtype == object:
        fields, kind = FIELDS, object
    words = -(-n // fields)
    biased = np.zeros((words * fields, d), dtype=kind)
    biased[:n] = candidates.astype(kind) - low
    biased = biased.reshape(words, fields, d)
    word = sum(biased[:, f] << bits * f for f in range(fields))
    left = anchors.astype(kind)
    half, mask = 1 << bits - 1, (1 << bits) - 1
    product = left @ word.T + sum(half << bits * f for f in range(fields))
    out = np.empty((m, words, fields), dtype=kind)
    for f in range(fields):
        out[:, :, f] = (product >> bits * f & mask) - half
    out = out.reshape(m, -1)[:, :n] + low * left.sum(axis=1)[:, None]
    return out if kind is np.int64 else np.clip(out, LONG.min, LONG.max).astype(np.int64)


def first_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, greatest first, earlier places first among equals."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        places = np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((places, ~scores[places]))]  # ~x falls as x grows, without -x's overflow


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    vectors = column.combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _blocks(left: pa.Table, right: pa.Table, scale: int):
    """Candidates in order of their ids, and strips of anchors with their scores."""
    left = left.sort_by("vec_id")
    width = max(pc.max(pc.list_value_length(t.column("x"))).as_py() or 0 for t in (left, right))
    candidates = integers(_matrix(left.column("x"), width), scale)
    anchors = integers(_matrix(right.column("x"), width), scale)
    for start in range(0, len(anchors), STRIP):
        yield left, right.slice(start, STRIP), packed_scores(anchors[start:start + STRIP], candidates)


def usable(vectors: DataFrame, anchor: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """``row, vec_id, label, x, anchor`` of the rows that take part, as a written table."""
    x = F.col(f"`{vector}`")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
                          (F.col(f"`{label}`") if isinstance(label, str) else label).alias("label"), x.alias("x"),
                          F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _part(of: Column) -> Column:
    return F.pmod(F.xxhash64("row"), of).cast("int")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _own(side: DataFrame) -> DataFrame:
    """Columns of its own for one side of a cogroup: both sides stem from the same table."""
    return side.select(*[F.col(c).alias(c) for c in side.columns])


def positives(vectors: DataFrame, sizes: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """``anchor_id, slot, positive_id, positive_score``: the k best other rows of each anchor's label."""
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for rows, asked, scores in _blocks(left, right, scale):
            ids = rows.column("vec_id").to_numpy()
            for own, line in zip(asked.column("vec_id").to_pylist(), scores):
                other = np.flatnonzero(ids != own)
                places = other[first_of(line[other], k)]
                out += [(own, i, s) for i, s in zip(ids[places].tolist(), line[places].tolist())]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "positive_id", "positive_score"), list(zip(*out)) or [(), (), ()])})

    cut = sizes.filter("anchors > 0").select(F.col("label").alias("label"), F.ceil(F.col("n") / BLOCK).alias("parts"), F.ceil(F.col("anchors") / ANCHORS).alias("strips"))
    left = vectors.join(cut, "label").select("label", _part(F.col("parts")).alias("part"), _each(F.col("strips")).alias("strip"), "vec_id", "x")
    right = vectors.filter("anchor").join(cut, "label").select("label", _each(F.col("parts")).alias("part"), _part(F.col("strips")).alias("strip"), "vec_id", "x")
    left, right = map(_own, (left, right))
    keys = ("label", "part", "strip")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= k)


def negatives(vectors: DataFrame, sizes: DataFrame, chosen: DataFrame, k: int = 3, scale: int = 256, least: int = 50, most: int = 95) -> DataFrame:
    """``anchor_id, slot, rank, negative_id, negative_score``: for each positive the k best rows of other labels.

    Their scores lie between ``least`` and ``most`` percent of the positive's.
    """
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            names = {v: i for i, v in enumerate({*left.column("label").to_pylist(), *right.column("label").to_pylist()})}
        for rows, asked, scores in _blocks(left, right, scale):
            ids = rows.column("vec_id").to_numpy()
            labels = np.array([names[v] for v in rows.column("label").to_pylist()])
            for own, label, slots, line in zip(asked.column("vec_id").to_pylist(), asked.column("label").to_pylist(), asked.column("slots").to_pylist(), scores):
                windows = [(s["slot"], -(-least * s["positive_score"] // 100), most * s["positive_score"] // 100) for s in slots]
                low = max(min(w[1] for w in windows), LONG.min)
                high = min(max(w[2] for w in windows), LONG.max)
                some = np.flatnonzero((line >= low) & (line <= high) & (labels != names[label]) & (ids != own)) if low <= high else []
                if len(some):
                    some = some[np.argsort(line[some], kind="stable")]
                    ascending = line[some]
                    for slot, low, high in windows:
                        # Down from the greatest score of the window, equal scores in order of their ids.
                        start, end, left_over = np.searchsorted(ascending, low) if low > LONG.min else 0, np.searchsorted(ascending, min(high, LONG.max), side="right"), k
                        while end > start and left_over:
                            first = max(np.searchsorted(ascending, ascending[end - 1]), start)
                            for place in some[first:end][:left_over].tolist():
                                out.append((own, slot, int(ids[place]), int(line[place])))
                                left_over -= 1
                            end = first
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, pa.int32() if n == "slot" else pa.int64()) for n, c in zip(("anchor_id", "slot", "negative_id", "negative_score"), columns)})

    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("anchors"), F.lit(0)).alias("anchors")).first()
    parts, strips = F.lit(max(1, -(-total["n"] // BLOCK))), F.lit(max(1, -(-total["anchors"] // ANCHORS)))
    windows = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("slot", "positive_score")).alias("slots"))
    left = vectors.select(_part(parts).alias("part"), _each(strips).alias("strip"), "vec_id", "label", "x")
    right = vectors.filter("anchor").join(windows, "vec_id").select(_each(parts).alias("part"), _part(strips).alias("strip"), "vec_id", "label", "x", "slots")
    left, right = map(_own, (left, right))
    found = left.groupBy("part", "strip").cogroup(right.groupBy("part", "strip")).applyInArrow(
        best, "anchor_id long, slot int, negative_id long, negative_score long")
    order = W.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label",
         n_positives: int = 5, n_negatives: int = 3, scale: int = 256, least: int = 50, most: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds."""
    rows = usable(vectors, anchor, vec_id=vec_id, vector=vector, label=label)
    sizes = materialize(rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")), "label-sizes")
    chosen = materialize(positives(rows, sizes, n_positives, scale), "positives")
    found = negatives(rows, sizes, chosen, n_negatives, scale, least, most)
    return found.join(chosen, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         coalesce(CAST(list_sum(list_transform(list_zip(a.parts, c.parts), lambda z: z[1] * z[2])) AS BIGINT), 0) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
pos AS (
  SELECT * FROM (SELECT anchor_id, other_id AS positive_id, score AS positive_score,
                        row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS slot FROM pairs WHERE same) WHERE slot <= 5),
neg AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.other_id AS negative_id, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.slot ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank
  FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3"""


@query("op11_hard_negatives", OP11_SQL)
def op11(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)
