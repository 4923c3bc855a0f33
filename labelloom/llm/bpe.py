"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut into the matches of a pattern. A task gathers the distinct words
of its part of the corpus and encodes them all at once: an inverted index leads
from each merge to the positions where its pair stands, merges are applied in
rank order over all words, and each application only looks at the two
neighbours it touched. Documents are then put together from their words.
Nothing is shuffled, so a hot source or a large group of copies costs nothing.

Defined results: a null or empty text gives an empty list of ids; repeated rows
are encoded as often as they come; a single match of any length is encoded
whole. Decoding null ids gives empty bytes; an id outside the vocabulary fails.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import query, slices, table

# Distinct pieces, and pairs of tokens, that a task remembers before it starts afresh; words twice as many.
REMEMBERED = 200_000
# Text bytes that are encoded together: what the merge replay holds grows with it.
BLOCK_BYTES = 4 << 20
# White space of any kind before a space: there a cut at spaces could part white space that belongs together.
_SPACE_RUN = re.compile(r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
_CHUNK = re.compile(r" *[^ ]+| +")
# A word of Latin letters, and marks after it that are a match of their own (an apostrophe may begin a contraction).
_WORD = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
# Fixed value: the pattern no match of which reaches over a cut at spaces; texts under any other are matched as they are.
_CUT_AT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and rank from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class MergeReplay:
    """Encodes many distinct words together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[int, int] = {}
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])

    def rank_of(self, left: int, right: int) -> int:
        """The rank of the token that two neighbours make, -1 if there is none."""
        key = left << 32 | right
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words in one array, and how many each has. A word that is itself a token is that token."""
        whole = np.array([self.ranks.get(w, -1) for w in words], dtype=np.int64)
        hard = np.flatnonzero(whole < 0)
        if not len(hard):
            return whole, np.ones(len(words), dtype=np.int64)
        found, counts = self._replay([words[i] for i in hard.tolist()])
        sizes = np.ones(len(words), dtype=np.int64)
        sizes[hard] = counts
        ids = np.empty(int(sizes.sum()), dtype=np.int64)
        of_hard = np.repeat(whole < 0, sizes)
        ids[of_hard], ids[~of_hard] = found, whole[whole >= 0]
        return ids, sizes

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many belong to each word."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words])
        n = len(raw)
        last = np.zeros(n, dtype=bool)
        last[ends - 1] = True
        first = np.roll(last, 1)
        token = self.of_byte[raw]
        after = np.where(last, -1, np.arange(1, n + 1))
        before = np.where(first, -1, np.arange(-1, n - 1))
        rank = np.where(last[:-1], -1, self.byte_pairs[raw[:-1], raw[1:]])
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []
        self._add(index, waiting, rank, np.arange(len(rank)))
        listed = np.zeros(n, dtype=bool)
        while waiting:
            rank = heapq.heappop(waiting)
            parts = index.pop(rank, None)
            if parts is None:
                continue
            places = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            places = places[token[places] >= 0]
            right = after[places]
            places, right = places[right >= 0], right[right >= 0]
            same = self._ranks(token[places], token[right]) == rank
            places, right = places[same], right[same]
            if not len(places):
                continue
            beyond = after[right]
            listed[places] = True
            touching = listed[right].any()
            listed[places] = False
            if touching:
                self._one_by_one(rank, places.tolist(), token, after, before, index, waiting)
                continue
            ahead = before[places]
            l, r = ahead >= 0, beyond >= 0
            # What the neighbours would make of it, as they stand now.
            early = np.concatenate([self._ranks(token[ahead[l]], np.full(int(l.sum()), rank)),
                                    self._ranks(np.full(int(r.sum()), rank), token[beyond[r]])])
            if ((early >= 0) & (early < rank)).any():
                self._one_by_one(rank, places.tolist(), token, after, before, index, waiting)
                continue
            token[places], token[right] = rank, -1
            after[places] = beyond
            before[beyond[r]] = places[r]
            pairs_at = np.concatenate([before[places][l], places[r]])
            made = self._ranks(token[pairs_at], token[after[pairs_at]])
            self._add(index, waiting, made, pairs_at)
        alive = token >= 0
        total = np.concatenate([[0], np.cumsum(alive)])
        return token[alive], np.diff(total[np.concatenate([[0], ends])])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``rank_of`` for arrays."""
        if len(left) > 64:
            keys, which = np.unique(left << 32 | right, return_inverse=True)
            return np.array([self.rank_of(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()], dtype=np.int64)[which]
        return np.array([self.rank_of(a, b) for a, b in zip(left.tolist(), right.tolist())], dtype=np.int64)

    @staticmethod
    def _add(index, waiting, ranks: np.ndarray, places: np.ndarray) -> None:
        """Enter positions under the merge that their pair allows; those of a merge are distinct and ascending."""
        some = ranks >= 0
        ranks, places = ranks[some], places[some]
        if len(ranks) == 0:
            return
        order = np.lexsort((places, ranks))
        ranks, places = ranks[order], places[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(ranks)) + 1]).tolist()
        for start, end, rank in zip(starts, [*starts[1:], len(ranks)], ranks[starts].tolist()):
            if rank in index:
                index[rank].append(places[start:end])
            else:
                index[rank] = [places[start:end]]
                heapq.heappush(waiting, rank)

    def _one_by_one(self, rank, places, token, after, before, index, waiting) -> None:
        """A merge whose places overlap or open an earlier merge: from left to right, the earlier merge first."""
        for done, p in enumerate(places):
            q = after[p] if token[p] >= 0 else -1
            if q < 0 or self.rank_of(int(token[p]), int(token[q])) != rank:
                continue
            token[p], token[q] = rank, -1
            after[p] = after[q]
            if after[p] >= 0:
                before[after[p]] = p
            lower = False
            for x in (before[p], p):
                if x >= 0 and after[x] >= 0:
                    new = self.rank_of(int(token[x]), int(token[after[x]]))
                    lower |= 0 <= new < rank
                    self._add(index, waiting, np.array([new]), np.array([x]))
            if lower:
                rest = np.array(places[done + 1:], dtype=np.int64)
                self._add(index, waiting, np.full(len(rest), rank), rest)
                return


class _Codes(dict):
    """A number for each piece, in order of appearance; ``new`` lists those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        self.new.append(piece)
        return code


def gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of a sequence of pieces, one after the other."""
    n = sizes[codes]
    ends = np.cumsum(n)
    shift = np.repeat(starts[codes] - (ends - n), n)
    return ids[np.arange(len(shift)) + shift]


class _Memory:
    """Pieces in order of appearance, with their ids one after the other."""

    def __init__(self):
        self.codes, self.ids, self.sizes = _Codes(), np.empty(0, np.int32), np.empty(0, np.int64)

    def learn(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of ``codes.new``."""
        self.ids, self.sizes = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.sizes, sizes])
        self.codes.new = []

    def ids_of(self, codes: np.ndarray) -> np.ndarray:
        return gather(self.ids, np.cumsum(self.sizes) - self.sizes, self.sizes, codes)


def encoder(rank_file: bytes, pattern: str):
    """A function from texts to a list array of ids; it remembers the pieces and the words that it has seen."""
    replay, words_of = MergeReplay(parse_ranks(rank_file)), regex.compile(pattern)
    cut, state = pattern == _CUT_AT_SPACES, {}

    def split(piece: str, code_of) -> list[int]:
        plain = _WORD.fullmatch(piece) if cut else None
        if plain is None:
            return list(map(code_of, words_of.findall(piece)))
        return [code_of(plain[1]), code_of(plain[2])] if plain[2] else [code_of(piece)]

    def encode(texts: list[str | None]) -> pa.ListArray:
        if not state or len(state["words"].codes) > 2 * REMEMBERED:
            state.update(pieces=_Memory(), words=_Memory())
        if len(state["pieces"].codes) > REMEMBERED:  # pieces are soon put together again from their words
            state.update(pieces=_Memory())
        pieces, words, seq, ends = state["pieces"], state["words"], [], [0]
        code_of = pieces.codes.__getitem__
        for text in texts:
            if text:
                seq.extend(map(code_of, (_CHUNK if cut and not _SPACE_RUN.search(text) else words_of).findall(text)))
            ends.append(len(seq))
        if pieces.codes.new:
            parts = [split(piece, words.codes.__getitem__) for piece in pieces.codes.new]
            if words.codes.new:
                words.learn(*replay.encode_words([w.encode() for w in words.codes.new]))
            flat = np.fromiter(chain.from_iterable(parts), dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum(words.sizes[flat])])
            pieces.learn(words.ids_of(flat), np.diff(bounds[np.cumsum([0, *map(len, parts)])]))
        seq = np.array(seq, dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(pieces.sizes[seq])])[ends]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pieces.ids_of(seq), pa.int32()))

    return encode


def _schema(df: DataFrame, keep: tuple[str, ...], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind)])


def encode(df: DataFrame, *, ranks: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           out: str = "ids") -> DataFrame:
    """``keep`` columns and the token ids of each text.

    ``ranks`` is the path of a rank file on the driver (under 1 MB for 50,000
    tokens); its bytes are broadcast, so executors need no copy.
    """
    with open(ranks, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(shipped.value, pattern)
        for batch in slices(batches, "_text", BLOCK_BYTES):
            ids = work(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*keep, out])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, _schema(df, keep, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, *, ranks: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",),
           out: str = "decoded") -> DataFrame:
    """``keep`` columns and the bytes that a list of ids stands for."""
    with open(ranks, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in parse_ranks(shipped.value).items()}
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = [b"".join(map(tokens.__getitem__, x)) if x else b"" for x in part.column("_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, type=pa.binary())], [*keep, out])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("_ids"))
    return rows.mapInArrow(run, _schema(df, keep, out, T.BinaryType()))


def token_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Count and digest of the ids of each document, and the digest of what they decode to.

    Ids are encoded, told and decoded by one worker: they never leave it.
    """
    with open(ranks, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(shipped.value, pattern)
        by_rank = {rank: token for token, rank in parse_ranks(shipped.value).items()}
        token_of, written = by_rank.__getitem__, {rank: str(rank) for rank in by_rank}.__getitem__
        for batch in slices(batches, "_text", BLOCK_BYTES):
            found = work(batch.column("_text").to_pylist())
            values, ends = found.values.to_numpy(), found.offsets.to_numpy().tolist()
            told, decoded = [], []
            for a, b in zip(ends, ends[1:]):
                ids = values[a:b].tolist()
                told.append(hashlib.sha256(",".join(map(written, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(token_of, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(told, pa.string()),
                                              pa.array(decoded, pa.string())], names)

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, schema)


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    import public_tokenizers
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                         public_tokenizers.PATTERN)
