"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what
sets toxic texts apart. A word is seen through four windows: its first five,
six and eight characters and the whole of it. Each window is compressed once
with the ordinary dictionary and once with both; its distance is the bytes that
the toxic one saves, beside the bytes still needed with it. How often each
distance occurs in toxic and in ordinary texts, measured on labelled texts kept
from the training of the dictionaries, tells which distances are evidence. The
evidence of all words of a whole text, against what a text of its length should
hold, goes through a logistic curve fitted on the same texts; 0.5 is its
calibrated threshold: each label counts by the inverse of its class's drawing
rate, so that the curve sees the classes in the shares they have in the corpus.

Labels learn from a bounded sample (``ToxicSettings``): texts that share their
smallest shingle are copies of each other and the one of smallest id counts, so
that a large group of labelled copies cannot pass for a kind of speech. Scoring
covers every text.

Defined results: null and empty texts have no window and get the score of
none; labels other than 0 and 1, null labels and labels without a document are
ignored; without texts of both labels the score is the share of toxic labels;
repeated rows get equal scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import query, slices, table
from labelloom.session import materialize

_LETTERS = re.compile(r"[^\W\d_]+")
# Behind every window, as a compressor finds no match in the last bytes of its input.
TAIL = b"#0123456789abcdefghijklmnopqrstuvwxyz#"
# Distances are told apart between these numbers of bytes saved, and up to this many still needed.
LOW, HIGH, NEEDED = -1, 7, 9
BINS = (HIGH - LOW + 1) * (NEEDED + 1)
# Characters of a word's windows; the last is the whole word.
HEADS = (5, 6, 8, None)
# Log likelihood ratio from which a distance is evidence.
EVIDENCE = 1.0
# Words that stand for a bin's share of all words, as if seen in either kind of text.
PRIOR = 2000.0
# Words that a task remembers before it starts afresh.
REMEMBERED = 200_000


@dataclass(frozen=True)
class ToxicSettings:
    """Bounds of the sample the model is fitted on (about; by hash of the id), and sizes of the dictionaries."""

    toxic_docs: int = 3000
    ordinary_docs: int = 5000
    toxic_bytes: int = 2048
    ordinary_bytes: int = 4096
    windows: int = 20_000
    window_chars: int = 64
    lift: float = 8.0
    least_docs: int = 6
    least_share: float = 0.01


@dataclass(frozen=True)
class ToxicModel:
    toxic: bytes
    ordinary: bytes
    log_ratio: tuple[float, ...]  # of each window's distances, zero where they are no evidence
    rate: float  # words with evidence that a toxic text has more than an ordinary one, to a word
    slope: float
    offset: float


def _family(text: str) -> int:
    words = text.lower().split()
    return min(zlib.crc32(" ".join(words[i:i + 3]).encode()) for i in range(max(1, len(words) - 2)))


def _features(word: str) -> list[str]:
    """A word's beginnings and the word itself, between its edges."""
    edged = f" {word} "
    return [*{edged[:n] for n in range(4, min(12, len(edged)) + 1)} | {edged}]


def stem(word: str, lifted: dict[str, int]) -> str | None:
    """The longest of a word's features that is about as frequent in toxic texts as its most frequent one."""
    found = [f for f in _features(word) if f in lifted]
    most = max((lifted[f] for f in found), default=0)
    return max((f for f in found if lifted[f] >= 0.8 * most), key=lambda f: (len(f), f), default=None)


def windows(text: str, size: int) -> list[str]:
    """Runs of whole words of ``size`` characters at least."""
    out, run, held = [], [], 0
    for word in text.lower().split():
        run.append(word)
        held += len(word) + 1
        if held >= size:
            out.append(f" {' '.join(run)} ")
            run, held = [], 0
    return out + ([f" {' '.join(run)} "] if run else [])


def _train(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to choose from: take them as they are
        return b"".join(dict.fromkeys(samples))[:size]


def _phrase_book(samples: list[bytes], size: int) -> bytes:
    """A content dictionary of whole samples, the most frequent last, where they are cheapest to refer to."""
    out, held = [], 0
    for sample, _ in sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0])):
        if held + len(sample) <= size:
            out.append(sample)
            held += len(sample)
    return b"".join(reversed(out))


class _Codes(dict):
    """A number for each word, in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class Distance:
    """Bytes that the toxic dictionary saves on each word of a text."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.plain, self.both = self._compressor(ordinary + TAIL), self._compressor(toxic + ordinary + TAIL)
        self.least = len(self.both.compress(TAIL))
        self.ratio, self.idle = None, np.zeros(NEEDED + 1, dtype=bool)
        self._forget()

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters(
            window_log=15, chain_log=15, hash_log=15, search_log=6, min_match=4, target_length=64,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(compression_params=how, dict_data=known)

    def _forget(self) -> None:
        self.codes = _Codes()
        self.known: dict[str, int] = {}
        self.bins = np.zeros((1024, len(HEADS)), dtype=np.int64)
        self.strength, self.judged = np.zeros(0), 0

    def _judge_by(self, log_ratio: np.ndarray | None) -> None:
        """What is known of words holds for one use: where a number of bytes needed is never evidence, bytes saved are not told."""
        if self.ratio is not log_ratio:
            self._forget()
            self.ratio = log_ratio
            self.idle = np.zeros(NEEDED + 1, dtype=bool) if log_ratio is None else ~np.reshape(log_ratio, (-1, NEEDED + 1)).any(axis=0)

    def __call__(self, window: str) -> tuple[int, int]:
        """Bytes saved, and bytes still needed."""
        raw = window.encode() + TAIL
        with_both = len(self.both.compress(raw))
        return len(self.plain.compress(raw)) - with_both, with_both - self.least

    def _bin(self, window: str) -> int:
        raw = window.encode() + TAIL
        with_both = len(self.both.compress(raw))
        needed = min(max(with_both - self.least, 0), NEEDED)
        if self.idle[needed]:
            return needed
        saved = len(self.plain.compress(raw)) - with_both
        return (min(max(saved, LOW), HIGH) - LOW) * (NEEDED + 1) + needed

    def _bins(self, word: str) -> list[int]:
        """Those of a word's windows; beginnings are shared by many words, so they are remembered."""
        out = []
        for k, n in enumerate(HEADS):
            if n is None:
                out.append(k * BINS + self._bin(f" {word} "))
                continue
            head = word[:n]
            found = self.known.get(head)
            if found is None:
                found = self.known[head] = self._bin(f" {head}")
            out.append(k * BINS + found)
        return out

    def _places(self, text: str | None) -> np.ndarray:
        """A number for each word; ``bins`` has the distances of its windows."""
        words = text.lower().split() if text else []
        if len(self.codes) > REMEMBERED:
            self._forget()
        codes, held = self.codes, len(self.codes)
        at = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
        if len(codes) > held:
            if len(codes) > len(self.bins):
                more = np.zeros((len(codes), len(HEADS)), dtype=np.int64)
                self.bins = np.concatenate([self.bins, more])
            new = [*islice(reversed(codes), len(codes) - held)][::-1]
            self.bins[held:len(codes)] = [self._bins(w) for w in new]
        return at

    def histogram(self, text: str | None) -> np.ndarray:
        """How many windows of a text's words are at each distance."""
        self._judge_by(None)
        at = self._places(text)
        return np.bincount(self.bins[at].ravel(), minlength=BINS * len(HEADS))

    def evidence(self, text: str | None, log_ratio: np.ndarray) -> np.ndarray:
        """That of each word of a text, by its strongest window."""
        self._judge_by(log_ratio)
        at = self._places(text)
        known = len(self.codes)
        if self.judged < known:  # a word's evidence is found once
            if len(self.strength) < known:
                self.strength = np.concatenate([self.strength, np.zeros(len(self.bins) - len(self.strength))])
            self.strength[self.judged:known] = log_ratio[self.bins[self.judged:known]].max(axis=1, initial=0.0)
            self.judged = known
        return self.strength[at]


def strongest_run(evidence: np.ndarray, rate: float) -> float:
    """The greatest sum of evidence, less ``rate`` a word, of any run of words; 0 for the empty run, 20 at most."""
    sums = np.concatenate([[0.0], np.cumsum(evidence - rate)])
    return min(float((sums - np.minimum.accumulate(sums)).max()), 20.0)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, slightly ridged, by Newton steps that never lose ground."""
    weight = weight / weight.mean()
    middle, spread = x.mean(), x.std() or 1.0
    rows = np.stack([(x - middle) / spread, np.ones_like(x)], axis=1)

    def loss(w):
        return (weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (rows @ w))).sum() + 0.05 * w[0] ** 2

    w, now = np.zeros(2), loss(np.zeros(2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (weight * (p - y)) + np.array([0.1 * w[0], 0])
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag([0.1, 1e-6]), grad)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w, before, now = w - step, now, loss(w - step)
        if before - now < 1e-9:
            break
    slope = w[0] / spread
    return float(slope), float(w[1] - slope * middle)


def fit(docs: DataFrame, labels: DataFrame, settings: ToxicSettings = ToxicSettings(), *, text: str = "text",
        doc_id: str = "doc_id", label: str = "toxic") -> ToxicModel:
    """Dictionaries, distances and curve from a bounded sample of the labelled documents."""
    marked = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("toxic")).filter(
        "toxic in (0, 1) and id is not null")
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = min(max(float(sizes.get(1, 0) > 0), 0.01), 0.99)
        return ToxicModel(b"", b"", (0.0,) * (BINS * len(HEADS)), 0.0, 1.0, float(np.log(share / (1 - share))))
    drawing = np.minimum(1.0, np.array([settings.ordinary_docs / sizes[0], settings.toxic_docs / sizes[1]]))
    share = F.when(F.col("toxic") == 1, float(drawing[1])).otherwise(float(drawing[0]))
    drawn = materialize(marked.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < share * (1 << 40)), "toxic-ids")

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([_family(t) for t in batch.column("text").to_pylist()], pa.int64())], ["id", "toxic", "text", "family"])

    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    sample = texts.join(drawn, "id").select("id", "toxic", "text")
    named = T.StructType([*sample.schema.fields, T.StructField("family", T.LongType())])
    sample = sample.mapInArrow(families, named).groupBy("family").agg(F.min(F.struct("id", "toxic", "text")).alias("first"))
    sample = materialize(sample.select("first.toxic", "first.text", "family").withColumn("part", F.pmod(F.xxhash64("family"), F.lit(10))), "toxic-sample")
    train, kept = sample.filter("part < 7").select("toxic", "text"), sample.filter("part >= 7").select("toxic", "text")
    of_class = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_plain = of_class.get(1, 0), of_class.get(0, 0)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for batch in slices(batches, "text"):
            for toxic, t in zip(*map(pa.Array.to_pylist, batch.columns)):
                counts[toxic].update({f for w in set(_LETTERS.findall(t.lower())) for f in _features(w)})
        names = list(counts[0] | counts[1])
        for start in range(0, len(names), 50_000):
            some = names[start:start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([c[f] for f in some], pa.int64()) for c in counts)],
                                             ["feature", "plain", "toxic"])

    # Features of a hundredth of the toxic sample at least: their number is bounded by the features of a text.
    often = max(settings.least_docs, settings.least_share * n_toxic)
    ratio = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("plain") + 0.5) / (n_plain + 1))
    found = (train.mapInArrow(presence, "feature string, plain bigint, toxic bigint").groupBy("feature")
             .agg(F.sum("plain").alias("plain"), F.sum("toxic").alias("toxic"))
             .filter((F.col("toxic") >= often) & (ratio >= settings.lift)).select("feature", "toxic").toArrow())
    lifted = dict(zip(found.column("feature").to_pylist(), found.column("toxic").to_pylist()))
    # A beginning that one longer feature mostly accounts for says nothing of other words.
    explained = {f[:n] for f, k in lifted.items() for n in range(4, len(f)) if k >= 0.8 * lifted.get(f[:n], k + 1)}
    lifted = {f: k for f, k in lifted.items() if f not in explained}
    size = settings.window_chars

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for toxic, t in zip(*map(pa.Array.to_pylist, batch.columns)):
                if toxic:
                    out = [s for w in _LETTERS.findall(t.lower()) for s in [stem(w, lifted)] if s]
                else:
                    out = windows(t, size)
                order = [zlib.crc32(f"{i} {w}".encode()) for i, w in enumerate(out)]
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(out), pa.int32()), pa.array(out, pa.string()),
                                                  pa.array(order, pa.int64())], ["toxic", "part", "place"])

    cut = train.mapInArrow(parts, "toxic int, part string, place bigint")
    chosen = [[p.encode() for p in cut.filter(F.col("toxic") == kind).orderBy("place", "part").limit(settings.windows)
               .select("part").toArrow().column("part").to_pylist()] for kind in (1, 0)]
    toxic, ordinary = _phrase_book(chosen[0], settings.toxic_bytes), _train(chosen[1], settings.ordinary_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, sums = Distance(toxic, ordinary), np.zeros((2, BINS * len(HEADS)), dtype=np.int64)
        for batch in slices(batches, "text"):
            for kind, t in zip(*map(pa.Array.to_pylist, batch.columns)):
                sums[kind] += distance.histogram(t)
        kinds, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(at, pa.int32()), pa.array(sums[kinds, at])],
                                         ["toxic", "bin", "n"])

    if kept.select("toxic").distinct().count() < 2:
        kept = train
    found = (kept.mapInArrow(count, "toxic int, bin int, n bigint").groupBy("toxic", "bin").agg(F.sum("n").alias("n")).toArrow())
    seen = np.zeros((2, BINS * len(HEADS)))
    seen[found.column("toxic").to_numpy(), found.column("bin").to_numpy()] = found.column("n").to_numpy()
    total = seen.sum(axis=1, keepdims=True) / len(HEADS)
    share = (seen.sum(axis=0) + 0.01) / (total.sum() + 1)
    log_ratio = np.subtract(*np.log((seen[::-1] + PRIOR * share) / (total[::-1] + PRIOR)))
    log_ratio = np.where(log_ratio >= EVIDENCE, log_ratio, 0.0)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, sums = Distance(toxic, ordinary), np.zeros((2, 2), dtype=np.int64)
        for batch in slices(batches, "text"):
            for kind, t in zip(*map(pa.Array.to_pylist, batch.columns)):
                each = distance.evidence(t, log_ratio)
                sums[kind] += np.count_nonzero(each), len(each)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), *map(pa.array, sums.T)], ["toxic", "hits", "words"])

    counted = kept.mapInArrow(hits, "toxic int, hits bigint, words bigint").groupBy("toxic").agg(F.sum("hits").alias("h"), F.sum("words").alias("w"))
    of_kind = {r["toxic"]: r["h"] / max(1, r["w"]) for r in counted.collect()}
    rate = max(0.0, of_kind.get(1, 0.0) - of_kind.get(0, 0.0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(toxic, ordinary)
        for batch in slices(batches, "text"):
            runs = [strongest_run(distance.evidence(t, log_ratio), rate) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(runs, pa.float64())], ["toxic", "run"])

    rows = kept.mapInArrow(measure, "toxic int, run double").toArrow().sort_by([("toxic", "ascending"), ("run", "ascending")])
    y, runs = (rows.column(c).to_numpy().astype(float) for c in rows.column_names)
    if len(np.unique(y)) < 2:
        return ToxicModel(toxic, ordinary, tuple(log_ratio.tolist()), 0.0, 1.0, float(np.log(sizes[1] / sizes[0])))
    slope, offset = _logistic(runs, y, 1 / drawing[y.astype(int)])
    return ToxicModel(toxic, ordinary, tuple(log_ratio.tolist()), float(rate), slope, offset)


def score(docs: DataFrame, model: ToxicModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          out: str = "score") -> DataFrame:
    """``keep`` columns and the score of each whole text, 0 to 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, ratio = Distance(model.toxic, model.ordinary), np.array(model.log_ratio)
        for batch in slices(batches, "_text"):
            runs = np.array([strongest_run(distance.evidence(t, ratio), model.rate) for t in batch.column("_text").to_pylist()])
            odds = np.clip(model.slope * runs + model.offset, -30, 30)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-odds)), pa.float64())], [*keep, out])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """The fold whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


@query("op10_toxicity")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                     F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
