"""SimHash near-duplicates: exact comparison of fingerprint tiles.

A fingerprint is the bitwise majority of the hashes of a text's word shingles.
Distinct fingerprints are laid out in cells by the population counts of their
blocks, and cells are cut into tiles of bounded size. Two fingerprints within
the radius cannot differ by more than the radius in those counts, so only tile
pairs of cells that close are compared, by exclusive-or and bit counts. Each
tile pair gives a spanning forest of its links in place of all pairs, and the
components of the links are the groups.

Where fingerprints only propose copies (``exact_duplicates``), a group of the
links is looked into once more: its texts with their whole sets of shingles are
cut into tiles of bounded size, every pair of tiles is met, and two texts within
the radius are linked only if their sets are as alike as asked for.

Defined results: null texts are empty; a text without words has fingerprint
zero and is linked like any other; equal fingerprints are one node however many
rows share them; a null doc_id takes part, but is never the id of a group
unless the group has no other. Shingles are compared by their 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import query, slices, table
from labelloom.llm.components import components
from labelloom.session import materialize

SEED = 42
# Pairs compared at a time in a task.
CHUNK = 1 << 19
# Shingles that a tile of whole sets holds at about the most, and those that even the shortest text counts for.
ROOM, LEAST = 1 << 19, 128


def hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words; a shorter text is one shingle, one without words has none."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*[tokens[i:] for i in range(words)]))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype=np.uint64)


def shingle_set(base: np.ndarray) -> np.ndarray:
    """The distinct ones, in order of their values as signed numbers."""
    return np.unique(base.view(np.int64))


def signature(text: str | None, words: int, parts: int) -> np.ndarray:
    """``parts`` 64-bit words, the first by XXH64 itself, the others by mixing it further."""
    return majority(hashes(text, words), parts)


def majority(base: np.ndarray, parts: int) -> np.ndarray:
    if not len(base):
        return np.zeros(parts, dtype=np.uint64)
    out = np.empty(parts, dtype=np.uint64)
    for k in range(parts):
        h = base
        if k:  # the finalizer of splitmix64
            h = base + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
        ones = np.zeros(64, dtype=np.int64)
        for start in range(0, len(h), 4096):
            rows = h[start:start + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def cell_base(bits: int, width: int, radius: int) -> int:
    return bits // width + 2 * radius + 3


def cells(fingerprints: np.ndarray, blocks: int, width: int, radius: int) -> np.ndarray:
    """One number for the population counts of the blocks, in steps of ``width``."""
    raw = fingerprints.astype(">u8").view(np.uint8).reshape(len(fingerprints), -1)
    ones = np.bitwise_count(raw).astype(np.int64).reshape(len(raw), blocks, -1).sum(axis=2) // width
    base = cell_base(fingerprints.shape[1] * 64 // blocks, width, radius)
    return ((ones + radius) * base ** np.arange(blocks)).sum(axis=1)


def neighbours(bits: int, blocks: int, width: int, radius: int) -> list[int]:
    """The differences of cell numbers, one of each opposite pair, that links within the radius can have."""
    reach = (radius - 1) // width + 1
    base, out = cell_base(bits // blocks, width, radius), []
    for steps in itertools.product(range(-reach, reach + 1), repeat=blocks):
        if sum((abs(s) - 1) * width + 1 for s in steps if s) <= radius:
            shift = sum(s * base ** k for k, s in enumerate(steps))
            if shift >= 0:
                out.append(shift)
    return sorted(out)


def fingerprints(docs: DataFrame, *, words: int = 3, bits: int = 64, blocks: int = 4, width: int = 1, radius: int = 2,
                 text: str = "text", keep: tuple[str, ...] = ("doc_id",), sets: bool = False) -> DataFrame:
    """``keep`` columns, ``fp`` (binary, most significant byte first) and ``cell`` of each text; with ``sets``, ``set`` too.

    That is a digest of the distinct shingles.
    """
    parts = bits // 64
    names = [*keep, "fp", "cell", *(["set"] if sets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            prints, digests = [], []
            for t in batch.column("_text").to_pylist():
                base = hashes(t, words)
                prints.append(majority(base, parts))
                if sets:
                    digests.append(xxhash.xxh3_128_digest(shingle_set(base).tobytes()))
            prints = np.array(prints).reshape(-1, parts)
            raw = prints.astype(">u8").tobytes()
            size = 8 * parts
            fp = pa.array([raw[i:i + size] for i in range(0, len(raw), size)], type=pa.binary())
            cell = pa.array(cells(prints, blocks, width, radius), type=pa.int64())
            more = [pa.array(digests, type=pa.binary())] if sets else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp, cell, *more], names)

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.BinaryType()), T.StructField("cell", T.LongType())]
                          + [T.StructField("set", T.BinaryType())] * sets)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of linked nodes; a label is the smallest node of its tree."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
        a, b = a[apart], b[apart]


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> np.ndarray:
    """Pairs of row numbers (those of ``right`` after those of ``left``) that span the links of two tiles."""
    n, m = len(left), len(right)
    label = np.arange(n if same else n + m)
    shift = 0 if same else n
    half = (left.shape[1] + 1) // 2
    for start in range(0, n, max(1, CHUNK // m)):
        part = left[start:start + max(1, CHUNK // m)]
        apart = np.zeros((len(part), m), dtype=np.uint16 if left.shape[1] > 3 else np.uint8)
        for k in range(half):
            apart += np.bitwise_count(part[:, None, k] ^ right[None, :, k])
        i, j = np.nonzero(apart <= radius)
        if same:
            i, j = i[j > i + start], j[j > i + start]
        if half < left.shape[1] and len(i):
            more = apart[i, j].astype(np.int64)
            for k in range(half, left.shape[1]):
                more += np.bitwise_count(part[i, k] ^ right[j, k])
            i, j = i[more <= radius], j[more <= radius]
        if len(i):
            _forest(label, i + start, j + shift)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return np.stack([linked, label[linked]], axis=1)


def _matrix(column: pa.ListArray, i: int, parts: int) -> np.ndarray:
    values = column[i].values
    at = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset:values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2], dtype=np.uint8)[at[0]:at[-1]]
    return raw.view(">u8").astype(np.uint64).reshape(-1, parts)


def links(nodes: DataFrame, *, bits: int = 64, blocks: int = 4, width: int = 1, radius: int = 2, tile: int = 4096) -> DataFrame:
    """``a, b``: links that span the components of the distinct fingerprints ``nodes(fp, cell)``.

    A cell of any size is cut into tiles of about ``tile`` fingerprints by hash;
    every pair of tiles in cells close enough is compared in full.
    """
    parts = bits // 64
    sizes = materialize(nodes.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("n")), "cells")
    placed = nodes.join(sizes, "cell").select("cell", F.expr("pmod(xxhash64(fp), n)").alias("block"), "fp")
    tiles = materialize(placed.groupBy("cell", "block").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "tiles")
    near = sizes.select(F.col("cell").alias("cell_a"), F.col("n").alias("n_a"),
                        F.explode(F.lit(neighbours(bits, blocks, width, radius)).cast("array<bigint>")).alias("shift"))
    near = near.select("cell_a", "n_a", (F.col("cell_a") + F.col("shift")).alias("cell_b"))
    near = near.join(sizes.select(F.col("cell").alias("cell_b"), F.col("n").alias("n_b")), "cell_b")
    near = near.select("cell_a", "cell_b", F.explode(F.expr("sequence(0L, n_a - 1L)")).alias("block_a"), "n_b")
    near = near.select("cell_a", "block_a", "cell_b", F.explode(F.expr("sequence(0L, n_b - 1L)")).alias("block_b"))
    near = near.filter("cell_a <> cell_b or block_a <= block_b")
    pairs = (near.join(tiles.toDF("cell_a", "block_a", "left"), ["cell_a", "block_a"])
             .join(tiles.toDF("cell_b", "block_b", "right"), ["cell_b", "block_b"])
             .select("left", "right", F.expr("cell_a = cell_b and block_a = block_b").alias("same")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lefts, rights, sames = batch.columns
            for i, same in enumerate(sames.to_pylist()):
                left, right = _matrix(lefts, i, parts), _matrix(rights, i, parts)
                found = tile_links(left, right, same, radius)
                if len(found):
                    rows = left if same else np.concatenate([left, right])
                    raw = rows.astype(">u8").tobytes()
                    size = 8 * parts
                    sides = [pa.array([raw[x * size:x * size + size] for x in side], type=pa.binary()) for side in found.T.tolist()]
                    yield pa.RecordBatch.from_arrays(sides, ["a", "b"])

    return pairs.mapInArrow(run, "a binary, b binary")


def near_duplicates(prints: DataFrame, **settings) -> DataFrame:
    """``component_id`` beside every row of ``prints`` (doc_id, fp, cell, ...): the smallest doc_id reachable over links.

    ``prints`` should be a written table, as it is read more than once.
    """
    first = materialize(prints.groupBy("fp", "cell").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(links(first.select("fp", "cell"), **settings), "a", "b")
    return prints.join(materialize(_smallest(first, roots, "fp"), "classes"), "fp")


def _smallest(first: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``node, component_id`` of all of ``first(node, first_id)``: the smallest id of those of the same root."""
    linked = first.join(roots.withColumnRenamed("node", node), node)
    smallest = materialize(linked.groupBy("root").agg(F.min("first_id").alias("smallest")), "smallest")
    joined = linked.join(smallest, "root").select(node, "smallest")
    return first.join(joined, node, "left").select(node, F.coalesce("smallest", "first_id").alias("component_id"))


def set_links(prints: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, radius: int, similarity: float) -> np.ndarray:
    """Pairs of row numbers that span the links: prints within the radius, and sets of at least this Jaccard similarity.

    With ``side``, only rows of different sides are compared. A pair whose rows
    hang together already is skipped, so many copies of one text cost little.
    """
    least = Fraction(str(similarity))
    num, den = least.numerator, least.denominator
    sizes, label, out = np.array([len(x) for x in sets], dtype=np.int64), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        apart = np.bitwise_count(prints[i + 1:] ^ prints[i]).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero(apart <= radius) + i + 1
        near = near[np.minimum(sizes[near], sizes[i]) * den >= np.maximum(sizes[near], sizes[i]) * num]
        if side is not None:
            near = near[side[near] != side[i]]
        near = near[label[near] != label[i]]
        while len(near):
            j, near = near[0], near[1:]
            few, many = sorted((sets[i], sets[j]), key=len)
            at = np.searchsorted(many, few)
            both = np.count_nonzero(many[np.minimum(at, len(many) - 1)] == few) if len(many) else 0
            if both * den >= (len(few) + len(many) - both) * num:
                out.append((i, j))
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def exact_duplicates(prints: DataFrame, texts: DataFrame, key: tuple[str, ...], *, words: int, similarity: float,
                     room: int = ROOM, radius: int = 2, **settings) -> DataFrame:
    """``component_id`` beside every row of ``prints`` (doc_id, key, fp, cell, set): as ``near_duplicates``, but links are exact.

    Fingerprints within the radius propose links; those stay whose sets of
    shingles have a Jaccard similarity of at least ``similarity``. ``texts`` (key,
    text) are the documents of ``prints``; only texts that may have a copy are
    read again.
    """
    parts = settings.get("bits", 64) // 64
    nodes = materialize(prints.groupBy("fp", "cell", "set").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(*key)).alias("row")), "nodes")
    near = components(links(nodes.select("fp", "cell").distinct(), radius=radius, **settings), "a", "b")
    placed = nodes.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("row.*", "fp", "set", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "candidates")
    several = materialize(placed.groupBy("root").count().filter("count > 1").select("root"), "several")
    wanted = materialize(placed.join(several, "root", "left_semi"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingle_set(hashes(t, words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, type=pa.list_(pa.int64()))], ["root", "fp", "set", "grams"])

    sets = texts.join(wanted, list(key)).select("root", "fp", "set", "text").mapInArrow(run, "root binary, fp binary, set binary, grams array<bigint>")
    sets = materialize(sets.dropDuplicates(["fp", "set"]), "shingle-sets")
    weight = F.greatest(F.size("grams"), F.lit(LEAST)).cast("bigint")
    tiles = materialize(sets.groupBy("root").agg(F.ceil(F.sum(weight) / room).cast("int").alias("n")), "set-tiles")
    dealt = sets.join(tiles, "root").withColumn("tile", F.expr("cast(pmod(xxhash64(fp, set), n) as int)"))
    dealt = dealt.select("root", "fp", "set", "grams", "tile", F.explode(F.expr("sequence(0, n - 1)")).alias("other"))
    dealt = dealt.select("root", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile", "fp", "set", "grams")

    def verify(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        fps, digests = rows.column("fp").to_pylist(), rows.column("set").to_pylist()
        matrix = np.frombuffer(b"".join(fps), dtype=">u8").astype(np.uint64).reshape(-1, parts)
        grams = [x for c in rows.column("grams").chunks
                 for x in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])]
        side = None if rows.column("one")[0] == rows.column("two")[0] else rows.column("tile").to_numpy()
        names = [f + s for f, s in zip(fps, digests)]
        found = set_links(matrix, grams, side, radius, similarity)
        return pa.table([pa.array([names[x] for x in ends], type=pa.binary()) for ends in found.T.tolist()], ["a", "b"])

    exact = materialize(dealt.groupBy("root", "one", "two").applyInArrow(verify, "a binary, b binary"), "exact-links")
    node = F.concat("fp", "set").alias("node")
    classes = materialize(_smallest(nodes.select(node, "first_id"), components(exact, "a", "b"), "node"), "classes")
    return prints.withColumn("node", node).join(classes, "node").drop("node")


@query("op5_simhash")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prints = materialize(fingerprints(docs), "simhash")
    return near_duplicates(prints).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
