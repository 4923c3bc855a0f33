"""Best-fit packing of tokenized documents into sequences of a bounded length.

Best-fit decreasing takes the longest piece first and puts each into the open
bin with the least room that still holds it. What it does depends on the lengths
alone, of which there are at most as many as the bound: so the plan is made from
the histogram of lengths, for all documents at once, and is the same as if every
document had been placed by itself. A segment tree over the remaining
capacities finds the tightest open bin in logarithmic time; bins of equal room
and documents of equal length are dealt with together, as ranges of numbers.

The plan is a table of runs (a length, a range of ordinal numbers of the pieces
of that length, and the bins and offset they go to). Its size is bounded by the
square of the capacity, whatever the number of documents. Each piece finds its
ordinal number among those of its length by counts per block of rows, never by
sorting a length as a whole, as one length may be that of most documents.

Defined results: null and empty texts are the end token alone; rows that repeat
a document are packed as often as they come; a text of any length is encoded
whole and cut only where it is longer than a sequence.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import query, slices, table
from labelloom.session import materialize

CAPACITY, END = 2048, 0
# Rows numbered together: the rows of a block are neighbours in the written table.
BLOCK_BITS = 16
# Words that a worker remembers with their ids, in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 600_000, 48

# White space as the pattern of byte-level vocabularies sees it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BESIDE_SPACE = re.compile(f"[{_SPACE}] ")
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_INNER_SPACE = re.compile(rf".[^\S\n]|.[\x1c-\x1f]", re.S)
# A word, and marks after it that are a match of their own (an apostrophe may begin a contraction).
_WORD = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_CHARACTERS = {byte: 0x100 + k for k, byte in enumerate(b for b in range(256) if b not in _PRINTED)}
_MEMORIES: dict[str, Words] = {}


class AfterSpace(dict):
    """Ids of a space and the word that is the key, remembered like chunks: so no string is made for a word that is known."""

    def __init__(self, words: Words):
        super().__init__()
        self.words, self.older = words, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.words.find(f" {word}")
        if len(word) < LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Words(dict):
    """Ids of chunks of text, as little-endian 32-bit integers; the less used half is forgotten when it is full."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.older: dict[str, bytes] = {}
        self.after = AfterSpace(self)
        settings = json.loads(file)
        before = settings.get("pre_tokenizer") or {}
        # Other kinds of file encode whole texts.
        self.by_chunk = settings.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.find(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def find(self, chunk: str) -> bytes:
        """The ids of a chunk that is not remembered."""
        plain = _WORD.fullmatch(chunk)
        lines = () if plain else chunk.split("\n")
        if len(lines) > 1 and "" not in lines and not _INNER_SPACE.search(chunk):  # single line feeds between words
            return self["\n"].join(map(self.__getitem__, lines))
        if plain is None:
            parts = [part for part, _ in self.split.pre_tokenize_str(chunk)]
            return array("I", [token.id for part in parts for token in self.model.tokenize(part)]).tobytes()
        if plain[2]:
            return (self.after[plain[1][1:]] if chunk[0] == " " else self[plain[1]]) + self[plain[2]]
        return array("I", [token.id for token in self.model.tokenize(self._written(chunk))]).tobytes()

    @staticmethod
    def _written(word: str) -> str:
        """A word in the characters by which byte-level vocabularies write bytes: those that can't be printed from U+0100 on."""
        if word.isascii():
            return "\u0120" + word[1:] if word[0] == " " else word
        return word.encode().decode("latin-1").translate(_CHARACTERS)

    def encode(self, text: str) -> bytes:
        """The ids of a text, put together from those of its chunks.

        A chunk is a run of white space and what follows it up to the next white
        space; no match of the vocabulary's pattern reaches over such a cut.
        """
        if not self.by_chunk:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if _BESIDE_SPACE.search(text):
            return b"".join(map(self.__getitem__, _CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return b"".join([self[first] if first else b"", *map(self.after.__getitem__, rest)])


def _words(file: bytes) -> Words:
    """A worker's memory outlives its tasks."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _MEMORIES:
        _MEMORIES.clear()
        _MEMORIES[key] = Words(file)
    return _MEMORIES[key]


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END, text: str = "text",
           keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``piece, start, length, ids`` of each document's pieces; ids are little-endian 32-bit integers.

    A document is the ids of its text and the end token. Only longer ones are
    cut, the first piece taking what the whole ones leave. ``tokenizer`` is the
    path of a tokenizer file on the driver (2 MB for 50,000 tokens), whose bytes
    are broadcast.
    """
    with open(tokenizer, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    last = np.array([end], dtype="<u4").tobytes()
    fields = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _words(shipped.value).encode
        for batch in slices(batches, "_text"):
            of, number, start, length, ids = [], [], [], [], []
            for row, text in enumerate(batch.column("_text").to_pylist()):
                found = (encode(text) if text else b"") + last
                n = len(found) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    of.append(row), number.append(k), start.append(a), length.append(b - a), ids.append(found[4 * a:4 * b])
            kept = [c.take(pa.array(of, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                [*keep, *(f.name for f in fields)])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + fields))


class OpenBins:
    """How many bins have each remaining capacity: a segment tree that finds the tightest for a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.open[at] += bins
            at >>= 1

    def tightest(self, length: int) -> int:
        """The least room of at least ``length`` that a bin has, or -1."""
        at = length + self.leaves
        while not self.open[at]:
            while at & 1:  # a right child: go up
                at >>= 1
            if not at:
                return -1
            at += 1  # the subtree to the right of this one
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Runs (length, first, pieces, bin, pieces a bin, offset) for a histogram of lengths, and the number of bins.

    Piece ``first + i`` of a length, for i below ``pieces``, goes to bin
    ``bin + i // pieces a bin``, at ``offset + length * (i % pieces a bin)``.
    """
    tree, ranges, runs, bins = OpenBins(capacity), {}, [], 0

    def leave(room: int, start: int, n: int) -> None:
        if room and n:
            ranges.setdefault(room, []).append((start, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            room = tree.tightest(length)
            if room < 0:  # nothing fits: as many new bins as the rest of this length needs
                room = capacity
                start, found = bins, -(-(n - done) // (capacity // length))
                bins += found
            else:
                start, found = ranges[room].pop()
                tree.add(room, -found)
            each = room // length  # the bin just used stays the tightest as long as the length fits
            full = min(found, (n - done) // each)
            if full:
                runs.append((length, done, full * each, start, each, capacity - room))
                leave(room - each * length, start, full)
                done += full * each
            rest = min(n - done, each - 1) if full < found else 0
            if rest:
                runs.append((length, done, rest, start + full, each, capacity - room))
                leave(room - rest * length, start + full, 1)
                done, full = done + rest, full + 1
            leave(room, start + full, found - full)
    return runs, bins


def pack(found: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """The columns of ``found`` (a written table with a unique ``row`` and a ``length``), ``sequence_id`` and ``offset``."""
    numbered = found.withColumn("_block", F.shiftright("row", BLOCK_BITS))
    counts = materialize(numbered.groupBy("length", "_block").agg(F.count("*").alias("_n")), "lengths")
    # One row for each length at most: bounded by the capacity.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, _ = best_fit_decreasing(totals, capacity)
    runs.sort()
    plan = np.array(runs, dtype=np.int64).reshape(-1, 6)
    starts = plan[:, 0] << 48 | plan[:, 1]

    earlier = W.partitionBy("length").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("length", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    order = W.partitionBy("length", "_block").orderBy("row")
    ordinal = numbered.withColumn("_at", F.row_number().over(order) - 1).join(before, ["length", "_block"])
    names = [c for c in found.columns if c != "row"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("_ordinal").to_numpy()
            run = plan[np.searchsorted(starts, length << 48 | at, side="right") - 1]
            within = at - run[:, 1]
            columns = [pa.array(run[:, 3] + within // run[:, 4]), pa.array(run[:, 5] + length * (within % run[:, 4]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*names, "sequence_id", "offset"])

    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ordinal.select(*names, (F.col("_before") + F.col("_at")).alias("_ordinal")).mapInArrow(
        place, T.StructType([found.schema[c] for c in names] + fields))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the pieces of each sequence (sequence_id, offset, length, ids) one after the other."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.aggregate(
        parts, F.unhex(F.lit("")), lambda held, p: F.concat(held, p["ids"])).alias("ids"))


@query("op12_packing")
def op12(spark, sf_dir):
    import public_tokenizers
    found = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    kept = found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), F.monotonically_increasing_id().alias("row"))
    return pack(materialize(kept, "pieces"))
