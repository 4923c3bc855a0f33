"""Language identification of mixed-language text.

A model is one table of character n-gram scores, a row for each hash bucket
and a column for each language, fitted on a bounded sample of labelled texts.
A word's script narrows the languages it may be; its score in each is the sum
over its n-grams. Viterbi over the words of a text, with a penalty for every
switch, labels spans; the language of most letters is the language of the text.

Defined results: a text that is null or has no letter gives ``und`` with score
0 and no spans; a script that no language was learned in leaves all languages
open; ties go to the language that sorts first; without a labelled text every
text is ``und``. Rows are treated alike and alone, so repeated rows agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import query, slices, table

# First and last code point of the letter ranges of each script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFEFC)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
# Letters, and numbers that are no decimal digits; the latter are sorted out word by word.
_WORD = re.compile(r"[^\W\d_]+")
_BOUNDS = np.array(sorted(lo for ranges in SCRIPTS.values() for lo, _ in ranges))
_RANGES = sorted((lo, hi, s) for s, ranges in enumerate(SCRIPTS.values()) for lo, hi in ranges)
OTHER = len(SCRIPTS)
# Words whose scores a task remembers before it starts afresh.
REMEMBERED = 200_000


@dataclass(frozen=True)
class LanguageSettings:
    """``sample_docs``: labelled texts of each language, about, that the model is fitted on (a bound, by hash of the id)."""

    sample_docs: int = 3000
    buckets: int = 1 << 16
    longest: int = 4
    smoothing: float = 0.5
    switch_penalty: float = 12.0
    script_share: float = 0.01


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    scores: np.ndarray = field(repr=False)  # buckets x languages, float32
    scripts: np.ndarray = field(repr=False)  # scripts x languages: may the language be written in the script
    longest: int = 4
    switch_penalty: float = 12.0


def script_of(word: str) -> int:
    """Number of the script of a word's first letter."""
    code = ord(next(filter(str.isalpha, word), word[0]))
    i = int(np.searchsorted(_BOUNDS, code, side="right")) - 1
    return _RANGES[i][2] if i >= 0 and code <= _RANGES[i][1] else OTHER


def grams(words: list[str], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character n-grams of the words between their edges, and where each word starts.

    A row for each character and a column for each length; -1 where no n-gram of that length starts.
    """
    sizes = np.array([len(w) for w in words]) + 2
    chars = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(chars))
    out = np.full((len(chars), longest), -1, dtype=np.int64)
    mixed = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, longest + 1):
        here = chars[n - 1:]
        mixed = (mixed[:len(here)] ^ here) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        fits = at[:len(here)] + n <= ends[:len(here)]
        if n == 1:
            fits &= (here != ord("^")) & (here != ord("$"))
        out[:len(here), n - 1] = np.where(fits, (mixed >> np.uint64(33)).astype(np.int64) % buckets, -1)
    return out, np.concatenate([[0], np.cumsum(sizes)[:-1]])


class _Codes(dict):
    """A number for each word, in order of appearance; ``new`` lists those not yet looked into."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def fit(docs: DataFrame, settings: LanguageSettings = LanguageSettings(), *, text: str = "text", lang: str = "lang",
        by: str = "doc_id") -> LanguageModel:
    """Count n-grams of a bounded sample of labelled texts in tasks; the sums that come back are buckets x languages."""
    rows = docs.filter(f"`{lang}` is not null and `{text}` is not null").select(
        F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{by}`").alias("by"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros((settings.buckets, 0)), np.zeros((OTHER + 1, 0), bool))
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, settings.sample_docs / sizes[x]))) for x in languages])
    drawn = rows.filter(F.pmod(F.xxhash64("by"), F.lit(1 << 40)) < share * (1 << 40)).select("lang", "text")
    buckets, longest = settings.buckets, settings.longest

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            names = np.array(batch.column("lang").to_pylist())
            texts = batch.column("text").to_pylist()
            for language in set(names.tolist()):
                codes, seq = _Codes(), []
                for i in np.flatnonzero(names == language):
                    seq.extend(map(codes.__getitem__, _words(texts[i])))
                if not codes:
                    continue
                often = np.bincount(seq, minlength=len(codes))
                found, starts = grams(codes.new, longest, buckets)
                weight = np.repeat(often, np.diff([*starts, len(found)]))[:, None].repeat(longest, axis=1)
                counts = totals.setdefault(language, np.zeros(buckets + OTHER + 1, dtype=np.int64))
                counts[:buckets] += np.bincount(found[found >= 0], weights=weight[found >= 0], minlength=buckets).astype(np.int64)
                counts[buckets:] += np.bincount([script_of(w) for w in codes.new], weights=often, minlength=OTHER + 1).astype(np.int64)
        for language, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])],
                                             ["lang", "bucket", "n"])

    found = (drawn.mapInArrow(count, "lang string, bucket int, n bigint")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros((buckets + OTHER + 1, len(languages)))
    column = np.array([languages.index(x) for x in found.column("lang").to_pylist()], dtype=np.int64)
    counts[found.column("bucket").to_numpy(), column] = found.column("n").to_numpy()
    letters = counts[buckets:]
    scripts = letters >= settings.script_share * np.maximum(letters.sum(axis=0), 1)
    smooth = counts[:buckets] + settings.smoothing
    # Centred by bucket: only differences between languages matter, and unseen n-grams then say nothing.
    scores = np.log(smooth / smooth.sum(axis=0))
    scores -= scores.mean(axis=1, keepdims=True)
    return LanguageModel(languages, scores.astype(np.float32), scripts, longest, settings.switch_penalty)


class Labeller:
    """Labels texts by a model, remembering the scores of words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.codes = _Codes()
        self.rows = np.zeros((0, len(self.model.languages)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)

    def _score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        m = self.model
        found, starts = grams(words, m.longest, len(m.scores))
        table = np.concatenate([m.scores, np.zeros((1, m.scores.shape[1]), np.float32)])  # the last row is that of -1
        each = sum(table[found[:, n]] for n in range(m.longest))
        sums = np.add.reduceat(each, starts, axis=0)
        open_ = m.scripts[[script_of(w) for w in words]]
        open_[~open_.any(axis=1)] = True
        return np.where(open_, sums, np.float32(-1e6))

    def _codes(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.codes) > REMEMBERED:
            self._forget()
        code_of = self.codes.__getitem__
        out = [np.array(list(map(code_of, _words(t))), dtype=np.int64) for t in texts]
        if self.codes.new:
            letters = np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in self.codes.new])
            self.rows = np.concatenate([self.rows, np.where(letters[:, None] > 0, self._score(self.codes.new), np.float32(0))])
            self.letters = np.concatenate([self.letters, letters])
            self.codes.new = []
        return out

    def paths(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Letters and language of each word of each text: the best path under the switching penalty."""
        codes = self._codes(texts)
        paths: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        order = sorted((i for i in range(len(texts)) if len(codes[i])), key=lambda i: -len(codes[i]))
        while order and self.model.languages:
            longest = len(codes[order[0]])
            some, order = order[:max(1, (1 << 20) // longest)], order[max(1, (1 << 20) // longest):]
            for i, path in zip(some, self._viterbi([codes[i] for i in some])):
                paths[i] = path
        return [(self.letters[c], p) for c, p in zip(codes, paths)]

    def _viterbi(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Texts side by side, longest first; step t advances those that have a word t."""
        penalty, k = np.float32(self.model.switch_penalty), len(self.model.languages)
        n, steps, kind = len(codes), len(codes[0]), np.min_scalar_type(-max(k, 1))
        lengths = np.array([len(c) for c in codes])
        live = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
        grid = np.zeros((steps, n), dtype=np.int64)
        for i, c in enumerate(codes):
            grid[:len(c), i] = c
        back = np.empty((steps, n, k), dtype=kind)
        own = np.arange(k, dtype=kind)[None, :]
        best = self.rows[grid[0]].copy()
        for t in range(1, steps):
            m = live[t]
            now = best[:m]
            top = now.argmax(axis=1)
            other = now[np.arange(m), top][:, None] - penalty
            stay = now >= other
            back[t, :m] = np.where(stay, own, top[:, None].astype(kind))
            best[:m] = np.maximum(now, other) + self.rows[grid[t, :m]]
        path = np.empty((steps, n), dtype=kind)
        at = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            m = live[t]
            path[t, :m] = at[:m]
            if t:
                at[:m] = back[t, np.arange(m), at[:m]]
        return [path[:len(c), i] for i, c in enumerate(codes)]

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the language of most letters, and its share of them."""
        langs, scores, k = [], [], len(self.model.languages)
        for letters, path in self.paths(texts):
            share = np.bincount(path, weights=letters, minlength=k) if len(path) else np.zeros(1)
            if not share.any():
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(share.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(share[best] / share.sum()))
        return langs, scores


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType())])


def _ship(docs: DataFrame, model: LanguageModel):
    """Buckets x languages numbers, whatever the corpus, as a plain tuple: workers need no class of this package to read it."""
    return docs.sparkSession.sparkContext.broadcast(tuple(getattr(model, f.name) for f in fields(model)))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
             lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``keep`` columns with the predicted language of each text and the share of its letters in that language."""
    shipped = _ship(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(LanguageModel(*shipped.value))
        for batch in slices(batches, "_text"):
            langs, scores = labeller.label(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*keep, lang, score])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def spans(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``spans``: runs of words in one language, by number of the first word and count of words."""
    shipped = _ship(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, names = Labeller(LanguageModel(*shipped.value)), shipped.value[0]
        for batch in slices(batches, "_text"):
            out = []
            for _, path in labeller.paths(batch.column("_text").to_pylist()):
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]]) if len(path) else np.zeros(1, int)
                out.append([{"start": int(a), "words": int(b - a), "lang": names[path[a]]} for a, b in zip(cuts[:-1], cuts[1:])])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], [*keep, "spans"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("spans", T.ArrayType(SPAN))])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


@query("op8_language")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
