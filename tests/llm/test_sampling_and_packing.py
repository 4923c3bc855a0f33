"""Hard negatives, packing and importance resampling against brute force, and on nulls, ties, copies and odd columns."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from labelloom.llm import importance, negatives, packing  # noqa: E402
from labelloom.session import materialize  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# 11: hard negatives

@pytest.mark.parametrize("high", [1, 3, 150, 40_000, 2 ** 40, 2 ** 70])
def test_packed_scores_are_exact_for_any_size_of_number(high):
    rnd = random.Random(high)
    for m, n, d in ((1, 1, 1), (3, 50, 7), (5, 33, 64), (2, 0, 3), (0, 4, 3), (4, 9, 0)):
        a, c = ([[rnd.randint(-high, high) for _ in range(d)] for _ in range(k)] for k in (m, n))
        kind = np.int64 if high < 2 ** 53 else object
        got = negatives.packed_scores(np.array(a, dtype=kind).reshape(m, d), np.array(c, dtype=kind).reshape(n, d))
        want = [[min(max(sum(x * y for x, y in zip(p, q)), -2 ** 63), 2 ** 63 - 1) for q in c] for p in a]
        assert got.dtype == np.int64 and got.tolist() == want


def test_components_are_floored_exactly():
    assert negatives.integers(np.array([[-0.001, 0.0, 0.999]]), 256).tolist() == [[-1, 0, 255]]
    assert negatives.integers(np.array([[1e30, -0.5]]), 256).tolist() == [[int(1e30) * 256, -128]]


def mined_by_hand(rows, anchors, k=5, m=3):
    out, clip = [], lambda s: min(max(s, -2 ** 63), 2 ** 63 - 1)
    ints = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    for i, y, v in ints:
        if i not in anchors:
            continue
        scores = [(clip(sum(a * b for a, b in zip(v, w))), j, z) for j, z, w in ints if j != i]
        best = sorted((-s, j) for s, j, z in scores if z == y)[:k]
        for s, j in best:
            found = sorted((-t, q) for t, q, z in scores if z != y and -50 * s <= 100 * t <= -95 * s)[:m]
            out += [(i, j, r + 1, q, -s, -t) for r, (t, q) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("labels, copies", [(4, False), (1, False), (3, True)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, labels, copies):
    for name, value in (("BLOCK", 50), ("ANCHORS", 7), ("STRIP", 3)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(labels)
    rows = [(i, int(rng.integers(labels)) if i % 3 else 0, [float(np.float32(x)) for x in (np.ones(5) if copies and i % 2 else rng.normal(size=5) + 0.4)]) for i in range(400)]
    rows += [(1000, None, [1.0]), (1010, 1, None), (1020, 1, [None, 1.0]), (1030, 1, [math.nan]), (1040, 1, [math.inf]), (None, 1, [1.0]),
             (1050, 1, []), (1060, 2, [0.5, 0.5]), (1070, 2, [float(np.float32(3e20)), 1.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], "vec_id long, label int, embedding array<float>, part string, row int, score double")
    got = negatives.mine(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == mined_by_hand(rows, {r[0] for r in rows if r[0] is not None and r[0] % 10 == 0})
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


# 12: packing

def best_fit_by_hand(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        bins += at == len(rooms)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - n)
    return bins, rooms


def test_the_plan_equals_placing_documents_one_by_one():
    for seed in range(200):
        rnd = random.Random(seed)
        capacity = rnd.choice([1, 5, 16, 37, 100])
        lengths = [rnd.randint(1, capacity if rnd.random() < 0.5 else max(1, capacity // 4)) for _ in range(rnd.randint(0, 300))]
        runs, bins = packing.best_fit_decreasing(Counter(lengths), capacity)
        held, seen = {}, Counter()
        for length, first, n, start, each, offset in runs:
            for i in range(n):
                seen[length, first + i] += 1
                held.setdefault(start + i // each, []).append((offset + length * (i % each), length))
        assert set(seen.values()) <= {1} and Counter(n for n, _ in seen) == Counter(lengths)
        for parts in held.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert (bins, sorted(capacity - sum(n for _, n in p) for p in held.values())) == best_fit_by_hand(lengths, capacity)


def test_the_tree_finds_the_tightest_bin():
    rnd = random.Random(2)
    for capacity in (1, 2, 7, 8, 2048):
        tree, rooms = packing.OpenBins(capacity), Counter()
        for _ in range(500):
            room = rnd.randint(0, capacity)
            change = 1 if not rooms[room] or rnd.random() < 0.4 else -1
            rooms[room] += change
            tree.add(room, change)
            length = rnd.randint(0, capacity)
            assert tree.tightest(length) == min((r for r, n in rooms.items() if n and r >= length), default=-1)


def test_pieces_and_sequences_equal_the_library(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    monkeypatch.setattr(packing, "BLOCK_BITS", 3)
    rnd = random.Random(4)
    letters = list("abAB' \n\t\x0b\x1c\x85\xa0 　é漢1٢!…'sll😀ß²")
    texts = [None, "", " ", "  ", "\n", "one", "one", "<|endoftext|> in <|endoftext|>", "the and " * 6000, "x" * 5000, "a  b\n\nc d's. It's\nfine, ñandú"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["same text again"] * 100
    rows = [(i if i % 9 else None, t, "x", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, row int, piece int")
    for capacity in (16, 2048):
        found = packing.pieces(docs, TOKENIZER, capacity=capacity, keep=("doc_id", "text"))
        table = materialize(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
        out = materialize(packing.pack(table, capacity=capacity), "packed")
        placed, whole = out.collect(), {}
        ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts}
        for r in placed:
            n = len(ids[r.text])
            first = (n - 1) % capacity + 1
            start = 0 if r.piece == 0 else first + (r.piece - 1) * capacity
            want = ids[r.text][start:first + r.piece * capacity]
            assert (r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()) == (start, len(want), want)
            whole.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
        assert Counter((r.doc_id, r.text) for r in placed if r.piece == 0) == Counter((r[0], r[1]) for r in rows)
        assert len(placed) == sum(-(-len(ids[t]) // capacity) for t in texts)
        assert len(whole) == best_fit_by_hand([r.length for r in placed], capacity)[0]
        for parts in whole.values():
            parts.sort()
            assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1]] and sum(p[1] for p in parts) <= capacity
        got = {r.sequence_id: (r.length, bytes(r.ids)) for r in packing.sequences(out).collect()}
        assert got == {k: (sum(p[1] for p in parts), b"".join(p[2] for p in parts)) for k, parts in whole.items()}
    nothing = packing.pieces(docs.limit(0), TOKENIZER).withColumn("row", F.monotonically_increasing_id())
    assert packing.pack(materialize(nothing, "pieces")).count() == 0


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    with open(TOKENIZER, "rb") as f:
        words = packing.Words(f.read())
    rnd = random.Random(1)
    for _ in range(300):
        text = " ".join(rnd.choice(["the", "and,", "wórd", "x1", "it's"]) + rnd.choice("abcdefghij") for _ in range(12))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(words) <= 21 and len(words.older) <= 21


# 13: importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def resampled_by_hand(docs, target, how):
    counts = [Counter(b for t in texts for b in features(t, how.buckets)[1]) for texts in ([t for _, t in docs], target)]
    s, t, n = *counts, how.buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + n) / ((s[b] + 1) * (t.total() + n)))) for b in range(n)]
    rows = []
    for doc_id, text in docs:
        words, found = features(text, n)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(words) >= how.least_words))
    able = sorted((-r[3], r[0] is None, r[0] or 0) for r in rows if r[4])
    drawn = able[:how.percent * len(able) // 100]
    return [r[:4] for r in rows], [(rank + 1, -s, None if null else i) for rank, (s, null, i) in enumerate(drawn)]


def test_importance_resampling_equals_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünïcødé", "漢字", "A", "b2", "😀"]
    lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))) for _ in range(60)] + ["", "  ", "...", "\t-\r"]
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 8))) for _ in range(250)]
    texts += [None, "", "\n\n", "one", "x-y\nz", "\n".join([lines[0]] * 3000), "word " * 40000] + [lines[1] * 3] * 40
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 2 + [(None, "\n".join(lines))]
    target = [" ".join(rnd.choice(vocabulary[:8]) for _ in range(30)) for _ in range(20)] + [None, "a\nb"]
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in docs], "doc_id long, text string, lines string, row int, weight double")
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, row int")
    for how in (importance.ResampleSettings(), importance.ResampleSettings(buckets=97, least_words=3, percent=60, seed=11)):
        rows, drawn = resampled_by_hand(docs, target, how)
        got = importance.resample(df, bench, how).collect()
        key = lambda r: (r[0] is None, *r)
        assert sorted((tuple(r)[:4] for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
        assert sorted((r["rank"], r.score, r.doc_id) for r in got if r["rank"] is not None) == sorted(drawn)
    assert importance.resample(df.limit(0), bench).count() == 0
    assert all(r.weight is not None for r in importance.resample(df, bench.limit(0)).collect())


def test_ties_go_to_the_smaller_id_and_ranks_have_no_gaps(spark):
    rows = [(i, 39 if i else 5, 0, int(i) // 7) for i in range(200)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, n_features long, weight long").withColumn("row", F.col("doc_id"))
    got = importance.draw(df, importance.ResampleSettings(percent=50)).collect()
    drawn = sorted((r["rank"], -r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert [d[0] for d in drawn] == list(range(1, 100)) and [d[1:] for d in drawn] == sorted((-r.score, r.doc_id) for r in got if r.doc_id)[:99]


# 6: patterns other than the proved one

def test_bpe_under_a_pattern_that_matches_across_spaces(spark):
    import base64

    import tiktoken

    from labelloom.llm import bpe
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"\w+ \w+|\s+|\S+"
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["one two three four", "in the end  of it", "", "a b c d e\nf g!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: library.encode_ordinary(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in bpe.encode(docs, ranks=file, pattern=pattern).collect()} == want
    for r in bpe.token_digests(docs, file, pattern).collect():
        assert r.n_tokens == len(want[r.doc_id]) and r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
