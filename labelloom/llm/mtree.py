"""Exact top-k search by inner product: best-first search of M-trees.

Inner products become distances by one more component: with M the greatest
norm, a vector x gets sqrt(M^2 - |x|^2) and a query 0, and then the square of
their distance is |q|^2 + M^2 - 2 q.x. That is a metric, so covering radii and
distances to parents, stored in the pages of a tree, bound it from below by the
triangle inequality.

Vectors are dealt to their nearest of a bounded sample of routing objects, and
each such cell, whatever its size, into parts by hash: every part becomes one
subtree of bounded size, whose pages (nodes) are rows of a written table. A
block of queries meets every subtree; in it, pages are visited in order of
their lower bound until none can hold a better vector, and entries are passed
over without computing their distance where the stored one to their parent
rules them out. Every vector is indexed; scores are exact integers.

Components are 64-bit integers, kept in 32 bits where all of a table fit; products
are summed in 64 bits where no sum of the table can leave them, and as Python's
integers otherwise, so that any finite vector takes part.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part; scaled components and scores beyond 64 bits count as the greatest
or least 64-bit number; shorter vectors count as padded with zeros; a
row is no candidate of a query of the same id; ties go to the smaller id; rows
that repeat an id are candidates each, and their queries share one ranking.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from labelloom.llm.common import query, table
from labelloom.session import materialize

# Routing objects on the top level: a sample by hash of the id.
PIVOTS = 32
# Vectors of a subtree, entries of a leaf page and of an inner page, queries of a block: all at most about.
SUBTREE, LEAF, FAN, BLOCK = 8192, 128, 16, 2048
# What a 64-bit integer holds.
LEAST, MOST = -(1 << 63), (1 << 63) - 1

_NODE = ("subtree bigint, node int, leaf boolean, ids array<bigint>, objects binary, extra array<double>, "
         "radii array<double>, to_parent array<double>")


def quantized(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """``vec_id, parts``: floor(scale * x) of each component of the vectors that take part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    parts = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.when(~bad, parts).alias("parts"))
    return rows.filter("vec_id is not null and parts is not null")


def products(objects: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Exact inner products, within 64 bits; rows of Python's integers where sums might not fit."""
    if objects.dtype != object and target.dtype != object:
        return objects @ target
    exact = (objects.astype(object) * target.astype(object)).sum(axis=1)
    return np.array([min(max(int(v), LEAST), MOST) for v in exact], dtype=np.int64)


class Subtree:
    """Pages of one M-tree, by number; page 0 is the root."""

    def __init__(self):
        self.pages: dict[int, tuple] = {}

    @classmethod
    def build(cls, ids: np.ndarray, objects: np.ndarray, extra: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Subtree:
        tree = cls()
        full = np.concatenate([objects.astype(float), extra[:, None]], axis=1)

        def page(rows: np.ndarray, center: int | None) -> int:
            number = len(tree.pages)
            tree.pages[number] = ()
            to_center = np.zeros(len(rows)) if center is None else np.sqrt(((full[rows] - full[center]) ** 2).sum(axis=1))
            if len(rows) <= leaf:
                tree.pages[number] = (True, ids[rows], objects[rows], extra[rows], np.zeros(len(rows)), to_center)
                return number
            # Routing objects far from each other, starting with the row that comes first.
            routing = [0]
            near = np.sqrt(((full[rows] - full[rows[0]]) ** 2).sum(axis=1))
            owner = np.zeros(len(rows), dtype=np.int64)
            while len(routing) < min(fan, -(-len(rows) // leaf) + 1) and near.max() > 0:
                routing.append(int(near.argmax()))
                far = np.sqrt(((full[rows] - full[rows[routing[-1]]]) ** 2).sum(axis=1))
                closer = far < near
                owner[closer], near = len(routing) - 1, np.minimum(near, far)
            groups = [np.flatnonzero(owner == g) for g in range(len(routing))]
            if len(routing) == 1:  # nothing but copies of one vector: any cut will do
                groups = np.array_split(np.arange(len(rows)), min(fan, -(-len(rows) // leaf)))
                routing = [int(g[0]) for g in groups]
            children = [page(rows[g], int(rows[r])) for g, r in zip(groups, routing)]
            radii = np.array([np.sqrt(((full[rows[g]] - full[rows[r]]) ** 2).sum(axis=1)).max() for g, r in zip(groups, routing)])
            at = rows[routing]
            tree.pages[number] = (False, np.array(children), objects[at], extra[at], radii, to_center[routing])
            return number

        if len(ids):
            page(np.arange(len(ids)), None)
        return tree

    def search(self, target: np.ndarray, own: int, k: int, norm: float, floor_: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) for a query, best first; only scores of ``floor_`` at least need be found."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst kept is on top
        flat = target.astype(float)
        base = float(flat @ flat) + norm
        if not self.pages:
            return []

        def reach() -> float:
            """Greatest distance that still matters."""
            if len(best) == k:
                score = best[0][0] if floor_ is None else max(best[0][0], floor_)
            elif floor_ is not None:
                score = floor_
            else:
                return np.inf
            if score == LEAST:
                return np.inf  # lower ones count as equal
            return np.sqrt(max(0.0, base - 2.0 * score)) + 1e-7 * np.sqrt(base) + 1e-6  # beyond what rounding can do

        waiting = [(0.0, 0, np.nan)]  # lower bound, page, distance to the page's routing object
        while waiting:
            bound, number, center = heapq.heappop(waiting)
            limit = reach()
            if bound > limit:
                break
            leaf, ids, objects, _, radii, to_parent = self.pages[number]
            if center == center:
                some = np.flatnonzero(np.abs(center - to_parent) - radii <= limit)
                ids, objects, radii = ids[some], objects[some], radii[some]
            if not len(ids):
                continue
            scores = products(objects, target)
            if leaf:
                other = ids != own
                for score, vec_id in zip(scores[other].tolist(), ids[other].tolist()):
                    item = (score, -vec_id)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            else:
                away = np.sqrt(np.maximum(0.0, base - 2.0 * (objects.astype(float) @ flat)))
                for child, distance, lower in zip(ids.tolist(), away.tolist(), np.maximum(0.0, away - radii).tolist()):
                    if lower <= limit:
                        heapq.heappush(waiting, (lower, child, distance))
        return [(score, -neg) for score, neg in sorted(best, reverse=True)]


def _packed(parts: Column, width: int, size: int) -> Column:
    """Components as big-endian integers of ``size`` bytes, padded with zeros."""
    padded = F.concat(parts, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(width) - F.size(parts))))
    digits = F.transform(padded, lambda c: F.lpad(F.hex(c if size == 8 else F.pmod(c, F.lit(1 << 32))), 2 * size, "0"))
    return F.unhex(F.array_join(digits, ""))


def _unpacked(column: pa.Array, width: int, size: int, exact: bool) -> np.ndarray:
    """Rows of components, 64-bit integers or, where their products need more, Python's."""
    found = np.frombuffer(b"".join(column.to_pylist()), dtype=f">i{size}").reshape(-1, width).astype(np.int64)
    return found if exact else found.astype(object)


def build_index(vectors: DataFrame) -> tuple[DataFrame, dict]:
    """Pages of the subtrees of ``vectors`` (vec_id, parts; a written table), and what a search must know of them."""
    wide = F.transform("parts", lambda c: c.cast("double"))
    facts = vectors.agg(F.max(F.size("parts")).alias("width"), F.max(F.aggregate(wide, F.lit(0.0), lambda a, c: a + c * c)).alias("norm"),
                        F.max(F.array_max(F.transform(wide, F.abs))).alias("largest")).first()
    width, norm, largest = max(1, facts["width"] or 1), float(facts["norm"] or 0), float(facts["largest"] or 0)
    shape = (width, 4 if largest < 2.0 ** 31 else 8, largest * largest * width < 2.0 ** 62)
    packed = vectors.select("vec_id", _packed(F.col("parts"), width, shape[1]).alias("object"))
    pivots = packed.orderBy(F.xxhash64("vec_id"), "vec_id", "object").limit(PIVOTS).toArrow()
    pivot_ids = pivots.column("vec_id").to_numpy()
    centers = _unpacked(pivots.column("object").combine_chunks(), *shape) if len(pivots) else np.zeros((1, width), np.int64)
    middles = centers.astype(float)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lift = np.sqrt(np.maximum(0.0, norm - (middles * middles).sum(axis=1)))
        for batch in batches:
            if batch.num_rows:
                x = _unpacked(batch.column("object"), *shape).astype(float)
                own = (x * x).sum(axis=1)
                extra = np.sqrt(np.maximum(0.0, norm - own))
                apart = own[:, None] + (middles * middles).sum(axis=1) - 2 * (x @ middles.T) + (extra[:, None] - lift) ** 2
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(apart.argmin(axis=1), pa.int64())], ["vec_id", "object", "cell"])

    dealt = materialize(packed.mapInArrow(nearest, "vec_id long, object binary, cell long"), "cells")
    sizes = materialize(dealt.groupBy("cell").agg(F.ceil(F.count("*") / SUBTREE).cast("int").alias("parts")), "cell-sizes")
    placed = dealt.join(sizes, "cell").select("vec_id", "object", (F.col("cell") + PIVOTS * F.pmod(F.xxhash64("vec_id", "object"), F.col("parts"))).alias("subtree"))

    def grow(rows: pa.Table) -> pa.Table:
        x = _unpacked(rows.column("object").combine_chunks(), width, shape[1], True)
        ids, number = rows.column("vec_id").to_numpy(), rows.column("subtree")[0].as_py()
        order = np.lexsort((*x.T[::-1], ids))
        x, ids = x[order], ids[order]
        pages = Subtree.build(ids, x, np.sqrt(np.maximum(0.0, norm - (x.astype(float) ** 2).sum(axis=1)))).pages
        return pa.table({
            "subtree": pa.array([number] * len(pages), pa.int64()), "node": pa.array(list(pages), pa.int32()),
            "leaf": [p[0] for p in pages.values()], "ids": pa.array([p[1].tolist() for p in pages.values()], pa.list_(pa.int64())),
            "objects": pa.array([p[2].astype(f">i{shape[1]}").tobytes() for p in pages.values()], pa.binary()),
            **{name: pa.array([p[i].tolist() for p in pages.values()], pa.list_(pa.float64())) for i, name in ((3, "extra"), (4, "radii"), (5, "to_parent"))}})

    pages = materialize(placed.groupBy("subtree").applyInArrow(grow, _NODE), "mtree")
    return pages, {"shape": shape, "norm": norm, "sample": (pivot_ids, centers if len(pivots) else centers[:0])}


def search(pages: DataFrame, known: dict, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` (vec_id, parts), which should be a written table."""
    shape, norm, (sample_ids, sample) = known["shape"], known["norm"], known["sample"]
    blocks = max(1, -(-queries.count() // BLOCK))
    asked = queries.select(F.col("vec_id").alias("query_id"), _packed(F.col("parts"), *shape[:2]).alias("target"),
                           F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    trees = materialize(pages.select("subtree").distinct(), "subtrees")
    # The stated queries, in blocks, against every subtree.
    every = trees.select("subtree", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    left = pages.join(every, "subtree").select("block", *pages.columns)
    right = asked.join(every, "block").select("block", "subtree", "query_id", "target")

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        tree = Subtree()
        for p in left.to_pylist():
            objects = _unpacked(pa.array([p["objects"]], pa.binary()), *shape)
            tree.pages[p["node"]] = (p["leaf"], np.array(p["ids"], dtype=np.int64), objects, None, np.array(p["radii"]), np.array(p["to_parent"]))
        out: list[tuple[int, int, int]] = []
        if len(right) and tree.pages:
            targets = _unpacked(right.column("target").combine_chunks(), *shape)
            for own, target in zip(right.column("query_id").to_pylist(), targets):
                first = np.sort(products(sample, target)[sample_ids != own])
                floor_ = int(first[-k]) if len(first) >= k else None
                out += [(own, vec_id, score) for score, vec_id in tree.search(target, own, k, norm, floor_)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    found = left.groupBy("subtree", "block").cogroup(right.groupBy("subtree", "block")).applyInArrow(
        visit, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.parts, v.parts), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query("op3_top_k", OP3_SQL)
def op3(spark, sf_dir):
    vectors = materialize(quantized(table(spark, sf_dir, "embeddings")), "quantized")
    pages, known = build_index(vectors)
    return search(pages, known, materialize(vectors.filter("vec_id % 100 = 0"), "queries"))
