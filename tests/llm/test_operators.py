"""Every dealt operator against a brute-force version, and on nulls, ties, copies, empty tables and odd columns."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from labelloom.llm import bpe, chat, components, digest, langid, mixing, mtree, queries, simhash, toxicity, unigram, urls  # noqa: E402
from labelloom.session import materialize  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, _text string, fp string, ids int, cell string, bucket int"


def documents(spark, rows, extra=False):
    """Rows of (doc_id, text[, lang, source]); with ``extra``, columns whose names clash with those used inside."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), None) for r in rows]
    if extra:
        return spark.createDataFrame([r + (0.5, "x", "y", 1, "z", 2) for r in full], SCHEMA + EXTRA)
    return spark.createDataFrame(full, SCHEMA)


ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (None, "no id here at all"), (6, "12 + 30 = 42"),
       (7, "the and " * 9000), (8, "naïve façade Ünïcødé 漢字 😀  two  spaces\t tabs\r\n")]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD, extra=True)


# 6: byte-level BPE

def reference_bpe(ranks, word):
    parts = [bytes([b]) for b in word]
    if word in ranks:
        return [ranks[word]]
    while True:
        best = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return [ranks[p] for p in parts]
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_merge_replay_equals_greedy_merging_for_odd_rank_orders():
    for seed in range(25):
        rnd = random.Random(seed)
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 500:
            token = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 6)))
            if token not in tokens:
                tokens.append(token)
        ranks = {t: i for i, t in enumerate(tokens)}
        words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 25))) for _ in range(120)]
        ids, counts = bpe.MergeReplay(ranks).encode_words(words)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [reference_bpe(ranks, w) for w in words]


def test_bpe_equals_the_library_and_decodes_back(spark, odd):
    tiktoken = pytest.importorskip("tiktoken")
    rnd = random.Random(5)
    letters = list("abAB' \n\t\x0b\x1c\x85\xa0\u2003\u3000é漢1٢!…'sll😀ß")
    rows = ODD + [(100 + i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(documents(spark, rows), ranks=RANKS, pattern=public_tokenizers.PATTERN, keep=("doc_id", "text"))
    for r in bpe.decode(encoded, ranks=RANKS, keep=("text", "ids")).collect():
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    out = bpe.token_digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == len(ODD)
    empty = next(r for r in out if r.doc_id == 1)
    assert (empty.n_tokens, empty.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.token_digests(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# 2: unigram counts

def library_unigram(pieces, byte_fallback):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer(tokenizers.models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.Prepend("▁"), tokenizers.normalizers.Replace(" ", "▁")])
    return t


def test_unigram_counts_equal_the_library_with_ties_and_unknown_characters():
    for seed in range(20):
        rnd = random.Random(seed)
        pieces = {"<unk>": 0.0} | {c: -float(rnd.randint(1, 6)) for c in "abc"}
        while len(pieces) < 25:
            pieces["".join(rnd.choice("abc▁") for _ in range(rnd.randint(2, 5)))] = -float(rnd.randint(1, 8))
        library, count = library_unigram(list(pieces.items()), False), unigram.counter(list(pieces.items()), False)
        for _ in range(100):
            text = "".join(rnd.choice("abcxy ") for _ in range(rnd.randint(0, 30)))
            assert count(text)[1] == len(library.encode(text, add_special_tokens=False).ids), text


def test_unigram_counts_with_byte_fallback(spark, odd):
    pieces = unigram.read_pieces(PIECES)
    library = library_unigram(pieces, True)
    for r in unigram.token_counts(odd, pieces, keep=("doc_id", "text")).collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert unigram.token_counts(odd.limit(0), pieces).count() == 0


# 3: exact top-k

def test_top_k_equals_brute_force_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SUBTREE", 40)
    monkeypatch.setattr(mtree, "LEAF", 8)
    monkeypatch.setattr(mtree, "BLOCK", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 64]) for i in range(0, 900, 3)]
    rows += [(5000 + i, [0.5, 0.25, 0.0, 0.125]) for i in range(200)] + [(7, None), (8, [None, 1.0]), (9, [float("nan")]), (10, [float("inf")]), (11, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", mixing.F.lit(1))
    vectors = materialize(mtree.quantized(df), "v")
    pages, known = mtree.build_index(vectors)
    got = {}
    for r in mtree.search(pages, known, materialize(vectors.filter("vec_id % 100 = 0"), "q")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    valid = {i: np.floor(1024 * np.array(v + [0.0] * (4 - len(v)))).astype(int) for i, v in rows if v and None not in v and np.isfinite(v).all()}
    asked = [i for i in valid if i % 100 == 0]
    assert set(got) == set(asked)
    for q in asked:
        best = sorted(((-int(valid[q] @ v), i) for i, v in valid.items() if i != q))[:10]
        assert [got[q][k] for k in range(1, 11)] == [(i, -s) for s, i in best]


def test_top_k_of_any_finite_vector_is_exact(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SUBTREE", 30)
    monkeypatch.setattr(mtree, "LEAF", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(-2, 15)]) for i in range(0, 200, 2)]
    rows += [(300, [1e300, 0.0, 0.0]), (301, [-1e300, 0.0, 0.0]), (303, [262144.0, 1.0, 0.0])]
    vectors = materialize(mtree.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "wide")
    pages, known = mtree.build_index(vectors)
    got = {}
    for r in mtree.search(pages, known, materialize(vectors.filter("vec_id % 100 = 0"), "q")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    kept = lambda v: min(max(v, mtree.LEAST), mtree.MOST)
    parts = {i: [kept(int(np.floor(1024 * c))) for c in v] for i, v in rows}
    assert set(got) == {0, 100, 300}
    for q in got:
        best = sorted((-kept(sum(a * b for a, b in zip(parts[q], v))), i) for i, v in parts.items() if i != q)[:10]
        assert [got[q][k] for k in range(1, 11)] == [(i, -s) for s, i in best]


def test_top_k_of_an_empty_table_and_of_few_rows(spark):
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, [2.0])]):
        v = materialize(mtree.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "v")
        pages, known = mtree.build_index(v)
        assert mtree.search(pages, known, v.filter("vec_id = 0")).count() == max(0, len(rows) - 1)


def test_m_tree_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-50, 50, (60, 6)) + 2000 * rng.integers(-1, 2, 6) for _ in range(12)]).astype(np.int64)
    norm = float((x * x).sum(axis=1).max())
    extra = np.sqrt(norm - (x * x).sum(axis=1))
    full = np.concatenate([x, extra[:, None]], axis=1)
    tree = mtree.Subtree.build(np.arange(len(x)), x, extra, leaf=16, fan=4)

    def below(number):
        leaf, ids, *_ = tree.pages[number]
        return list(ids) if leaf else [i for c in ids for i in below(int(c))]

    assert sorted(below(0)) == list(range(len(x)))
    for leaf, ids, objects, lift, radii, _ in tree.pages.values():
        if not leaf:
            for child, routing, up, radius in zip(ids, objects, lift, radii):
                far = np.sqrt(((full[below(int(child))] - np.append(routing, up)) ** 2).sum(axis=1)).max()
                assert far <= radius + 1e-6


# 4: digests

def test_digests_and_the_next_document(spark, odd):
    rows = [(i * 7 % 1009, "word%d " % (i % 13) * (i % 50)) for i in range(400)] + [(5000, None), (None, "first"), (-3, "é漢" * 60)]
    out = digest.compare_next(digest.with_next(documents(spark, rows))).collect()
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for place, (known, i, text) in enumerate(ordered):
        r, after = got[i if known else None], ordered[(place + 1) % len(ordered)][2]
        changed = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == digest.digest(text) and r.edited_fingerprint == digest.digest(changed)
        assert r.near_next == digest.likeness([digest.digest(text)], [digest.digest(after)])[0]
    assert digest.compare_next(digest.with_next(odd)).count() == len(ODD)
    assert digest.compare_next(digest.with_next(odd.limit(0))).count() == 0
    alone = digest.compare_next(digest.with_next(documents(spark, [(1, "abcd")]))).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_digest_counts_every_triplet_and_likeness_is_bounded():
    text = "the quick brown fox " * 40
    raw = text.encode()
    n = sum(max(0, len(raw) - places[2]) for places in digest.TRIPLETS)
    assert digest.counts(raw).sum() == n
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(12)]
    own = [digest.digest(t) for t in texts]
    half = [digest.digest(digest.edited(a, b)) for a, b in zip(texts, texts[1:])]
    assert (digest.likeness(own, own) == 1).all()
    assert (digest.likeness(own[:-1], half) > digest.likeness(own[:-1], own[1:])).mean() > 0.8
    every = digest.likeness(*map(list, zip(*itertools.product(own + [digest.digest("")], repeat=2))))
    assert ((every >= 0) & (every <= 1)).all()


# 5: SimHash

def brute_fingerprint(text, n=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < n else [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    ids, parent = sorted(prints), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= radius:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius,tile", [(2, 4096), (14, 7)])
def test_simhash_components_equal_brute_force(spark, radius, tile):
    rnd = random.Random(radius)
    base = [" ".join(rnd.choice("ABcdefgh") * 3 for _ in range(rnd.randint(1, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(25, 110):
        words = rnd.choice(base).split()
        words[rnd.randrange(len(words))] = rnd.choice(["x", "y", "c" * 3])
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n")]
    prints = materialize(simhash.fingerprints(documents(spark, rows, extra=True), radius=radius), "p")
    got = simhash.near_duplicates(prints, radius=radius, tile=tile).collect()
    want = {i: brute_fingerprint(t) for i, t in rows}
    groups = brute_components(want, radius)
    assert {r.doc_id: (int(bytes(r.fp).hex(), 16), r.component_id) for r in got} == {i: (want[i], groups[i]) for i in want}


def test_wide_fingerprints_link_in_tiles():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, (50, 4), dtype=np.uint64)
    b = a.copy()
    b[:, 3] ^= np.uint64(0xFFFF)
    found = simhash.tile_links(a, b, False, 16)
    assert sorted(map(tuple, found.tolist())) == [(50 + i, i) for i in range(50)]
    assert len(simhash.tile_links(a, b, False, 15)) == 0


def test_simhash_of_no_rows_and_null_ids(spark):
    empty = materialize(simhash.fingerprints(documents(spark, [])), "p")
    assert simhash.near_duplicates(empty).count() == 0
    some = materialize(simhash.fingerprints(documents(spark, [(None, "a b c d"), (9, "a b c d"), (None, "alone in here")])), "p")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(some).collect()) == [(-1, -1), (-1, 9), (9, 9)]


def jaccard(a, b, n=5):
    a, b = ({tuple(t[i:i + n]) for i in range(len(t) - n + 1)} for t in (a, b))
    return len(a & b) / len(a | b)


def text_pair(name, size, shared):
    """Two lists of words with this many five-word shingles each, ``shared`` of them the same."""
    words = [f"{name}{i}" for i in range(size + 4)]
    return words, words[:shared + 4] + [f"{name}other{i}" for i in range(size - shared)]


def test_exact_links_keep_only_what_is_alike_enough():
    rnd = random.Random(5)
    texts = [t for k, wanted in enumerate([0.5, 0.6, 0.7, 0.79, 0.8, 0.85]) for t in text_pair(f"w{k}x", 90, round(90 * 2 * wanted / (1 + wanted)))]
    long = [f"long{i}" for i in range(150)]
    for _ in range(12):
        at = rnd.randrange(120)
        texts.append(long[:at] + [f"cut{rnd.random()}"] + long[at + rnd.randrange(12):])
    sets = [simhash.shingle_set(simhash.hashes(" ".join(t), 5)) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8]
    assert len(links) > 10 and (8, 9) in links and (6, 7) not in links
    found = simhash.set_links(np.zeros((len(sets), 4), dtype=np.uint64), sets, None, 51, 0.8).tolist()
    assert all(tuple(sorted(x)) in links for x in found)

    def groups(pairs):
        label = list(range(len(texts)))
        for i, j in pairs:
            label = [label[i] if x == label[j] else x for x in label]
        return {frozenset(k for k, x in enumerate(label) if x == y) for y in label}

    assert groups(found) == groups(links)


@pytest.mark.parametrize("room", [simhash.ROOM, 300])
def test_tiles_of_whole_sets_equal_one_tile(spark, room):
    rnd, rows = random.Random(6), []
    long = [f"long{i}" for i in range(150)]
    for k in range(40):
        at = rnd.randrange(120)
        rows.append((k, " ".join(long[:at] + [f"cut{k % 9}"] + long[at + rnd.randrange(20):])))
    rows += [(k + 100, t) for k, t in rows[::7]] + [(k + 200, " ".join(f"{k}z{i}" for i in range(9))) for k in range(5)] + [(None, rows[0][1]), (300, None)]
    how = {"bits": 256, "blocks": 1, "width": 16, "radius": 90}
    docs = materialize(documents(spark, rows).withColumn("k", F.xxhash64("doc_id", "text")), "d")
    prints = materialize(simhash.fingerprints(docs, words=5, keep=("doc_id", "k"), sets=True, **how), "p")
    got = simhash.exact_duplicates(prints, docs.select("k", "text"), ("k",), words=5, similarity=0.8, room=room, **how).collect()
    texts = [(i, (t or "").split()) for i, t in rows]
    print_of = [simhash.signature(t, 5, 4) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        near = np.bitwise_count(print_of[i] ^ print_of[j]).sum() <= 90
        if near and texts[i][1] and texts[j][1] and jaccard(texts[i][1], texts[j][1]) >= 0.8:
            label = [label[i] if x == label[j] else x for x in label]
    smallest = {y: min(texts[k][0] for k, x in enumerate(label) if x == y and texts[k][0] is not None) for y in label}
    assert len(set(label)) < 40
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in got) == sorted(
        (-1 if i is None else i, smallest[label[k]]) for k, (i, _) in enumerate(texts))


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    found = components.components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()
    roots = {r.node: r.root for r in found}
    assert all(roots[i] == 0 for i in range(1, 41)) and all(roots[100 + i] == 100 for i in range(1, 60))


# 7: URLs

def test_hosts_paths_and_rules(spark):
    cases = {"https://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "allow", "example.net/en/"),
             "http://example.net/de/": ("example.net", "/de/", "block", "net/"), "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
             "http://b.example.com/de/a#/en/": ("b.example.com", "/de/a", "block", "example.com/de/"), "http://org/fr/": ("org", "/fr/", "allow", "org/fr/"),
             "http://x.net": ("x.net", "", None, None), "x://q.org?fr=/fr/": ("q.org", "", None, None), "no scheme": ("", "", None, None),
             None: ("", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None), "http://É.net/\nq": ("É.net", "/\nq", "block", "net/")}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    h, p = urls.host_of(mixing.F.col("url")), urls.path_of(mixing.F.col("url"))
    for r in df.select("url", h.alias("h"), p.alias("p"), urls.rule_of(h, p).alias("r")).collect():
        rule = (r.r.verdict, r.r.rule) if r.r else (None, None)
        assert (r.h, r.p, *rule) == cases[r.url], r.url


def test_segmentation_is_the_likeliest_split():
    counts = {"free": 40, "casino": 9, "win": 30, "a": 500, "the": 400, "there": 20, "re": 80}
    total = float(sum(counts.values()))

    def cost(words):
        return round(sum(np.log(counts[w] / total) if w in counts else -np.log(total) - (len(w) + 1) * np.log(10.0) for w in words), 6)

    for label in ("freecasino", "thewin", "there", "zzz", "acasinoz", "x"):
        ways = [[label[i:j] for i, j in zip((0, *c), (*c, len(label)))] for k in range(len(label)) for c in itertools.combinations(range(1, len(label)), k)]
        assert cost(urls._split(label, counts, total)) == max(map(cost, ways))
    assert urls._split("freecasino", counts, total) == ["free", "casino"]


def test_url_verdicts(spark):
    hosts = ["freecasino.example.com", "goodnews.example.org", "winpoker.example.com", "daily.example.org"]
    rows = [(i, f"http://{hosts[i % 4]}/a{i}/news", "<p>free win good news daily poker casino</p>" * 3) for i in range(80)]
    rows += [(100, None, None), (101, "plain", ""), (102, "http://x.net/", "x"), (3, rows[3][1], None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", mixing.F.lit("clash"))
    got = {}
    for r in urls.judge(pages, urls.crawl_words(pages)).collect():
        got.setdefault(r.page_id, r)
    assert all(got[i].verdict == ("block" if i % 4 in (0, 2) else "allow") for i in range(80))
    assert got[100].verdict == got[101].verdict == "allow" and (got[102].rule, got[102].verdict) == ("net/", "block")
    none = pages.limit(0)
    assert urls.judge(none, urls.crawl_words(none)).count() == 0


# 8: language

def made_up(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 3))) for _ in range(n))


TONGUES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "er", "und", "ich"], "ru": ["да", "не", "то", "ли"]}


def test_language_held_out_spans_and_odd_texts(spark, odd):
    rnd = random.Random(8)
    rows = [(i, made_up(rnd, TONGUES[t], rnd.randint(3, 40)), t, "s") for i, t in enumerate(list(TONGUES) * 60)]
    docs = documents(spark, rows)
    model = langid.fit(docs.filter(~langid.held_out()))
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert test and np.mean([found[r[0]].lang_pred == r[2] for r in test]) > 0.95
    mixed = documents(spark, [(1, made_up(rnd, TONGUES["aa"], 30) + " " + made_up(rnd, TONGUES["ru"], 30))])
    spans = langid.spans(mixed, model).first().spans
    assert [s.lang for s in spans] == ["aa", "ru"] and [s.words for s in spans] == [30, 30]
    out = langid.identify(odd, model).collect()
    assert len(out) == len(ODD)
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {1, 2, 3, 6}
    assert all(0 <= r.score <= 1 for r in out)
    blank = langid.fit(odd.filter("false"))
    assert {r.lang_pred for r in langid.identify(odd, blank).collect()} == {"und"}


def test_language_path_is_the_best_of_all():
    rng = np.random.default_rng(2)
    model = langid.LanguageModel(("a", "b", "c"), rng.normal(size=(64, 3)).astype(np.float32), np.ones((langid.OTHER + 1, 3), bool), 2, 1.5)
    texts = ["ab cd ef gh", "xy", "qq ww ee rr tt"]
    labeller = langid.Labeller(model)
    for text, (_, path) in zip(texts, labeller.paths(texts)):
        rows = labeller.rows[[labeller.codes[w] for w in text.split()]]

        def value(way):
            return sum(rows[i, x] for i, x in enumerate(way)) - 1.5 * sum(x != y for x, y in zip(way, way[1:]))

        assert abs(value(path) - max(map(value, itertools.product(range(3), repeat=len(rows))))) < 1e-4


@pytest.mark.parametrize("n", [4, 128, 129, 300])
def test_language_paths_of_many_languages(n):
    names = tuple(f"l{i:03}" for i in range(n))
    labeller = langid.Labeller(langid.LanguageModel(names, np.zeros((8, n), np.float32), np.ones((langid.OTHER + 1, n), bool), 3, 1.0))
    labeller.rows = 5 * np.eye(n, dtype=np.float32)
    words = np.array([n - 1, 0, n - 1, n // 2, n - 2])
    assert [p.tolist() for p in labeller._viterbi([words, words[:2]])] == [words.tolist(), words[:2].tolist()]


# 9: chats

def test_chat_layouts_and_exact_round_trip(spark):
    tricky = ["\\### Assistant: </turn> ok", "<turn user>", "\\l\\b\\g", "", "a>b<c\\", "line\nbreak"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(itertools.cycle(["user", "assistant", "sys<tem"]), tricky))]
    rows += [(2, 0, None, None), (2, 0, None, None), (3, None, "assistant", "late"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (None, 1, "user", "q")]
    table_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", mixing.F.lit("clash"))
    canonical = chat.canonical_table(table_)
    back = chat.format_turns(canonical).select("conv_id", chat.read_turns(mixing.F.col("formatted")).alias("turns"),
                                              chat.read_loss(mixing.F.col("formatted"), mixing.F.col("loss")).alias("loss"))
    found = {r.conv_id: r for r in back.collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in found[conv].turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert found[conv].loss == "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert chat.format_digests(canonical.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.canonical_table(table_.select("conv_id", "text"))


def test_a_stored_conversation_of_the_added_id_is_one_with_it(spark, tmp_path):
    rows = [(-7, 2, "user", "more"), (1, 0, "user", "hi"), (1, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op9(spark, str(tmp_path)).collect()}
    tricky = "\\### Assistant: </turn> ok"
    whole = f"user\n{tricky}\nassistant\n{tricky}\nuser\nmore\n"
    assert {k: r.n_turns for k, r in got.items()} == {-7: 3, 1: 2}
    assert got[-7].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[-7].loss_chars == len(tricky)


def test_json_records_choose_their_layout(spark):
    records = {'{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":null}],"id":3}': ("messages", [("user", "q"), ("assistant", "")]),
               '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}': ("shares", [("user", "q"), ("assistant", "a")]),
               '{"instruction":"i","input":"","output":"o","extra":{"prompt":1}}': ("instruction_input", [("user", "i"), ("assistant", "o")]),
               '{"prompt":"p","response":"r"}': ("prompt_response", [("user", "p"), ("assistant", "r")]),
               '{"foo":[1,2]}': (None, []), "broken": (None, []), None: (None, []), "{}": (None, []), "[]": (None, [])}
    df = spark.createDataFrame([(r,) for r in records], "record string")
    for r in chat.canonical_json(df, "record", ("record",)).collect():
        assert (r.layout, [(t.role, t.text) for t in r.turns]) == records[r.record], r.record


# 10: toxicity

def test_toxic_words_are_found_in_held_out_documents(spark, odd):
    rnd = random.Random(10)
    rows, labels = [], []
    for i in range(700):
        words = made_up(rnd, ["the", "an", "tion", "er", "ing", "ou", "re"], rnd.randint(10, 80)).split()
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["zorgblat", "quixfump", "vlimsk"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(9999, 1), (None, 1), (5, None)]
    docs = documents(spark, rows)
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marked.filter(~toxicity.held_out()))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    test = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.5) == (i % 3 == 0) for i in test]) > 0.95
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    bare = toxicity.fit(docs, marked.filter("toxic = 0"))
    assert {r.score >= 0.5 for r in toxicity.score(odd, bare).collect()} == {False}
    assert toxicity.score(odd, toxicity.fit(docs, marked.limit(0))).count() == len(ODD)


def test_strongest_run_is_that_of_all_runs():
    rnd = random.Random(12)
    for n in (0, 1, 2, 7, 30):
        each = np.array([rnd.choice([0.0, 0.0, 1.5, 3.0]) for _ in range(n)])
        runs = [each[a:b].sum() - 0.7 * (b - a) for a in range(n + 1) for b in range(a, n + 1)]
        assert np.isclose(toxicity.strongest_run(each, 0.7), min(max(runs), 20.0))


def test_toxic_passages_in_long_texts_and_copies_of_two_labels(spark):
    rnd = random.Random(11)
    parts, bad = ["the", "an", "tion", "er", "ing", "ou", "re"], ["zorgblat", "quixfump", "vlimsk"]
    rows = []
    for i in range(500):
        words = made_up(rnd, parts, 60).split()
        for _ in range(4 * (i % 3 == 0)):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[1][1]) for i in range(50)]  # copies, labelled at odds
    labels = [(i, int(i % 3 == 0)) for i, _ in rows]
    models = [toxicity.fit(documents(spark, rows).repartition(n), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(n))
              for n in (1, 3, 8)]
    assert models[0] == models[1] == models[2]
    clean = made_up(rnd, parts, 10000).split()
    passage = made_up(rnd, parts, 60).split()
    for at in (5, 15, 25, 30, 44, 52):
        passage.insert(at, rnd.choice(bad))
    asked = documents(spark, [(1, " ".join(clean)), (2, " ".join(clean[:5000] + passage + clean[5000:])), (3, " ".join(passage))])
    assert {r.doc_id: r.score >= 0.5 for r in toxicity.score(asked, models[0]).collect()} == {1: False, 2: True, 3: True}


def test_toxic_curve_sees_the_true_shares_of_the_classes(spark, monkeypatch):
    rnd, seen, curve = random.Random(8), [], toxicity._logistic
    plain, bad = made_up(rnd, ["ba", "lo", "mi", "tu"], 300).split(), made_up(rnd, ["xo", "zak", "gru"], 40).split()
    rows = [(i, " ".join(rnd.choices(plain, k=60) + rnd.choices(bad, k=12 * (i % 4 == 0)))) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y, *weight: seen.append((y, *weight)) or curve(x, y, *weight))
    toxicity.fit(documents(spark, rows), labels, toxicity.ToxicSettings(ordinary_docs=90))
    y, weight = seen[0]
    assert np.allclose(weight, np.where(y == 1, 1, 2))

    x = np.concatenate([np.linspace(-3, 2, 900), np.linspace(0, 5, 300)])
    y = np.repeat([0.0, 1.0], [900, 300])
    some = np.concatenate([np.arange(0, 900, 9), np.arange(900, 1200)])
    whole = toxicity._logistic(x, y, np.ones(1200))
    drawn = toxicity._logistic(x[some], y[some], np.where(y[some] == 1, 1, 9))
    assert np.allclose(whole, drawn, atol=0.1)


def brute_probabilities(cells, alphas, budget):
    keys = list(cells)
    base = np.array([cells[k] for k in keys], float)
    w, targets = base / base.sum(), []
    for m, alpha in enumerate(alphas):
        sums = {v: sum(b for k, b in zip(keys, base) if k[m] == v) for v in {k[m] for k in keys}}
        whole = sum(s ** alpha for s in sums.values() if s)
        targets.append({v: s ** alpha / whole for v, s in sums.items()})
    most, before = base / (budget * base.sum()), np.inf
    for _ in range(40):
        for m in range(3):
            for v, share in targets[m].items():
                mine = np.array([k[m] == v for k in keys])
                full = mine & (w >= most * (1 - 1e-12))
                if share <= w[mine].sum():
                    w[mine] *= share / w[mine].sum()
                elif w[mine].sum() - w[full].sum() > 1e-15:
                    free = mine & ~full
                    w[free] = np.minimum(w[free] * (share - w[full].sum()) / w[free].sum(), most[free])
        worst = max(abs(sum(x for k, x in zip(keys, w) if k[m] == v) / share - 1) for m in range(3) for v, share in targets[m].items() if share)
        if worst <= 1e-6 or worst > before * 0.9999:
            break
        before = worst
    return dict(zip(keys, np.minimum(1, w / most)))


# 1: mixing

def test_mixing_equals_brute_force(spark):
    rnd = random.Random(11)
    rows = [(i, "w " * rnd.randint(1, 30) + rnd.choice(["", "a@b", "license"]), rnd.choice(["en", "en", "de"]), rnd.choice(["s0"] * 5 + ["s1", "s2"])) for i in range(400)]
    docs = documents(spark, rows, extra=True).withColumn("topic", mixing.F.lit("clash")).withColumn("n_tokens", mixing.F.lit(-1))
    out = mixing.mix(docs).collect()
    cells = {}
    for r in out:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    want = brute_probabilities(cells, (0.5, 0.7, 0.7), 0.5)
    assert all(abs(r.probability - want[r.source, r.lang, r.topic]) < 1e-5 for r in out)
    assert {r.doc_id: r.n_tokens for r in out} == {r[0]: len(r[1].split()) for r in rows}
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.sampled}


@pytest.mark.parametrize("budget, scarce", [(0.5, False), (0.8, True)])
def test_mixing_meets_its_targets_wherever_they_can_be_met(spark, budget, scarce):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(5, 30) + rnd.choice(["", "license"]), rnd.choice(["en", "en", "de"]), rnd.choice(["s0"] * 4 + ["s1"])) for i in range(600)]
    targets = {"source": {"s0": 0.7, "s1": 0.3}, "lang": {"en": 0.6, "de": 0.4}}  # s1 holds a fifth of all tokens
    how = mixing.MixSettings(targets=targets, budget=budget)
    mixed = materialize(mixing.mix(documents(spark, rows), how), "mixed")
    got = {(r.margin, r.value): r for r in mixing.margins(mixed, how).collect()}
    assert {k: round(r.target, 9) for k, r in got.items()} == {(m, v): t for m, t_ in targets.items() for v, t in t_.items()}
    assert all(abs(r.expected / r.target - 1) < 0.01 for (m, v), r in got.items() if not (scarce and m == "source"))
    if scarce:  # taken whole, and still short of its share
        assert all(r.probability == 1 for r in mixed.collect() if r.source == "s1") and got["source", "s1"].expected < 0.29
    expected = sum(r.n_tokens * r.probability for r in mixed.collect()) / sum(r.n_tokens for r in mixed.collect())
    assert scarce or abs(expected / budget - 1) < 1e-3
    assert all(abs(r.drawn - r.expected) < 0.06 for r in got.values())


def test_mixing_of_nulls_empty_tables_and_named_targets(spark, odd):
    rows = [(1, None, None, None), (2, "a b", "en", None), (3, "c d", "en", "x"), (3, "c d", "en", "x"), (None, "e", "de", "x")]
    docs = documents(spark, rows)
    out = mixing.mix(docs, mixing.MixSettings(targets={"source": {"x": 0.5, "gone": 0.5}, "lang": 1.0}, budget=0.9)).collect()
    assert len(out) == len(rows) and all(0 <= r.probability <= 1 for r in out)
    assert all(r.probability == 0 for r in out if r.source == mixing.NONE and r.n_tokens)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0
    assert mixing.mix(odd).count() == len(ODD)


def test_registry():
    names = queries.all_queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.all_oracles()) <= set(names)
    assert regex.compile(public_tokenizers.PATTERN)


def test_evidence_compresses_twice_only_where_it_may_count():
    told = toxicity.Distance(b" foolish idiot", b" the weather is fine today")
    ratio = np.zeros(toxicity.BINS * len(toxicity.HEADS))
    ratio[toxicity.NEEDED + 1] = 2.0  # nothing saved, nothing needed: the only evidence, in the first window
    texts = ["the weather is foolish today", "Foolish idiots talk", None, "", "the idiot"]
    plain = [told.bins[told._places(t)] for t in texts]
    want = [ratio[b].max(axis=1, initial=0.0) for b in plain]
    distance, calls = toxicity.Distance(b" foolish idiot", b" the weather is fine today"), []

    class Counting:
        def compress(self, raw):
            calls.append(raw)
            return told.plain.compress(raw)
    distance.plain = Counting()
    assert all(np.array_equal(distance.evidence(t, ratio), w) for t, w in zip(texts, want))
    evidence_calls = len(calls)
    # Histograms after it tell all distances apart.
    assert all(np.array_equal(distance.histogram(t), np.bincount(b.ravel(), minlength=len(ratio))) for t, b in zip(texts, plain))
    assert evidence_calls < len(calls) - evidence_calls


def test_words_after_a_space_are_remembered_without_it():
    import public_tokenizers
    from labelloom.llm import packing
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        words = packing.Words(f.read())
    for text in ("the cat, the cat\nand the cat ", " a  b", "it's the cat's \n hat", ""):
        ids = np.frombuffer(words.encode(text), dtype="<u4").tolist()
        assert ids == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"cat", "the"} <= set(words.after)
