"""Token counts of a unigram tokenizer: a count-only Viterbi.

An Aho-Corasick automaton enumerates every vocabulary piece in a text; a
dynamic program over its positions carries the best score and the number of
pieces that reach it, nothing else. Ties follow the tokenizer library's rule:
of equally scored ways to a position, the one whose last piece starts first
stays. Characters that no piece covers cost the lowest score less ten and,
with byte fallback, count as their UTF-8 bytes; without it, a run of them
counts as one.

The vocabulary is read from a model file of pieces and scores. White space is
written as the model does: a mark before the text and for every space. No piece
has that mark behind another character, so texts are cut in front of marks, and
each distinct part is worked out once by a task. (If a vocabulary has such
pieces, texts are not cut.) Nothing is shuffled.

Defined results: null and empty texts have no token and score 0; repeated rows
agree; a text of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import query, slices, table

MARK = "▁"
PENALTY = 10.0
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")
# Parts of texts that a task remembers before it starts afresh.
REMEMBERED = 200_000


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores, in order of id, of a model file (about 32,000 pieces: bounded by the file)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class CountingViterbi:
    """Score and number of pieces of the best way through a text."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(pieces).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        known = {p for p, _ in pieces}
        self.by_bytes = byte_fallback and sum(1 for p in known if _BYTE.fullmatch(p)) == 256
        self.single = {p for p in known if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in known)

    def best(self, text: str) -> tuple[float, int]:
        """Of one part of a marked text.

        The automaton reports matches by their end, and those of one end
        longest first: the piece that starts first is met first, and only a
        better one replaces it.
        """
        n = len(text)
        score, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        if self.single.issuperset(text):
            for end, (length, own) in self.automaton.iter(text):
                at = end + 1 - length
                total = score[at] + own
                if total > score[end + 1]:
                    score[end + 1], count[end + 1] = total, count[at] + 1
            return score[n], count[n]
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            matches[end].append(match)
        unknown = [False] * (n + 1)
        for end in range(n):
            for length, own in matches[end]:
                at = end + 1 - length
                total = score[at] + own
                if total > score[end + 1]:
                    score[end + 1], count[end + 1] = total, count[at] + 1
            total = score[end] + self.unknown
            if text[end] not in self.single and total > score[end + 1]:
                score[end + 1], unknown[end + 1] = total, True
                more = len(text[end].encode()) if self.by_bytes else 0 if unknown[end] else 1
                count[end + 1] = count[end] + more
        return score[n], count[n]

    def parts(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked) if self.cuttable else [marked]


def counter(pieces: list[tuple[str, float]], byte_fallback: bool = True):
    """A function from a text to (score, pieces); it remembers the parts it has seen."""
    viterbi, known = CountingViterbi(pieces, byte_fallback), {}

    def count(text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        if len(known) > REMEMBERED:
            known.clear()
        parts = viterbi.parts(text)
        for part in set(parts).difference(known):
            known[part] = viterbi.best(part)
        found = [known[p] for p in parts]
        return sum([s for s, _ in found]), sum([c for _, c in found])

    return count


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], *, byte_fallback: bool = True, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",), count: str = "n_tokens", score: str = "score") -> DataFrame:
    """``keep`` columns, the number of tokens of each text, and the score of that segmentation."""
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = counter(shipped.value, byte_fallback)
        for batch in slices(batches, "_text"):
            found = [work(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c for _, c in found], pa.int64()),
                                              pa.array([float(s) for s, _ in found], pa.float64())], [*keep, count, score])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(count, T.LongType()), T.StructField(score, T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


@query("op2_token_counts")
def op2(spark, sf_dir):
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
