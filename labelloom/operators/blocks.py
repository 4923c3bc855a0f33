"""What a task does with a block of documents: terms counted, weighed and scored in arrays, no row for a posting.

Functions over Arrow tables, made for one group or partition each. A term is
known by its place: within a block by ``start`` and its place in the chunk of a
part, in the vocabulary by ``part << 32 | place``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

_INTS, _LONGS, _STRINGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
# Of a document: its terms' places in the block (each less the one before) and counts. Of a chunk, the terms that a block
# has of a part: the place of its first term and, packed, the terms in order with the number of rows with each.
ENCODED = T.StructType([T.StructField("ids", _INTS), T.StructField("tfs", _INTS), T.StructField("part", T.IntegerType()),
                        T.StructField("start", T.IntegerType()), T.StructField("chunk", T.BinaryType())])
# Of a block: packed, the places of the terms known, their ranks in the part and document frequencies. Of a part (home is null): its terms.
MERGED = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("known", T.BinaryType()),
                       T.StructField("terms", _STRINGS), T.StructField("dfs", _LONGS)])
WEIGHED = T.StructType([T.StructField("terms", _LONGS), T.StructField("tfs", _INTS), T.StructField("dfs", _LONGS), T.StructField("norm", T.DoubleType())])
# Packed columns whose numbers mostly rise.
RISING = ("places", "ranks")
# Documents of a block that are written at a time.
ROWS = 512


def lists(values, lengths, kind: pa.DataType | None = None) -> pa.ListArray:
    """Rows of the given lengths out of one array."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values, kind))


def flat(column: pa.ChunkedArray, kind=None) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the length of each list."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    values = pc.list_flatten(column).to_numpy()
    return (values if kind is None else values.astype(kind)), lengths


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=6)


def pack(**columns) -> bytes:
    """Arrays of one length, compressed; numbers in ``RISING`` columns are kept as differences, and strings as their lengths and, behind, their bytes."""
    arrays, tail, codec = [], b"", _zstd()
    for c, v in columns.items():
        if c in RISING:
            v = np.diff(v, prepend=0)
        elif _is_text(v):
            offsets, body = _bytes(v)
            v, tail = np.diff(offsets), codec.compress(body, asbytes=True) if len(body) else b""
            arrays.append(pa.array(np.full(len(v), len(body), np.int64)))
        arrays.append(v if isinstance(v, pa.Array) else pa.array(v))
    names = [n for c, v in columns.items() for n in ([f"{c}_bytes", c] if _is_text(v) else [c])]
    batch = pa.RecordBatch.from_arrays(arrays, names=names)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes() + tail


def _is_text(values) -> bool:
    return isinstance(values, pa.Array) and pa.types.is_string(values.type)


def _bytes(strings: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets, from 0 on, and bytes of strings without nulls."""
    if not len(strings):
        return np.zeros(1, np.int32), memoryview(b"")
    _, offsets, body = strings.buffers()
    offsets = np.frombuffer(offsets, np.int32)[strings.offset:strings.offset + len(strings) + 1]
    return offsets - offsets[0], memoryview(body or b"")[offsets[0]:offsets[-1]]


def _strings(table: pa.Table, name: str, tail: pa.Buffer) -> pa.Array:
    lengths = table.column(name).to_numpy()
    n = table.column(f"{name}_bytes")[0].as_py() if len(lengths) else 0
    body = _zstd().decompress(tail, decompressed_size=n) if n else pa.py_buffer(b"")
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), body)


def unpack(column: pa.ChunkedArray, *names: str) -> tuple[list, np.ndarray]:
    """The arrays of all rows one after the other, and the number of values of each row."""
    tables, tails = [], []
    for row in column:
        stream = pa.BufferReader(row.as_buffer())
        tables.append(pa.ipc.open_stream(stream).read_all())
        tails.append(row.as_buffer().slice(stream.tell()))
    out: list = []
    for name in names:
        each = [t.column(name) for t in tables]
        if name in RISING:
            out.append(np.concatenate([np.cumsum(e.to_numpy()) for e in each]) if each else np.zeros(0, np.int64))
        elif name == "terms":
            out.append(pa.concat_arrays([_strings(t, name, tail) for t, tail in zip(tables, tails)]) if tables else pa.array([], pa.string()))
        else:
            out.append(np.concatenate([e.to_numpy() for e in each]) if each else np.zeros(0, np.int64))
    return out, np.array([t.num_rows for t in tables], np.int64)


def add(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of values by their place, as doubles also where there are none."""
    return np.bincount(at, weights=values, minlength=n).astype(np.float64)


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as its length."""
    return np.arange(int(lengths.sum())) + np.repeat(first - starts(lengths), lengths)


def _longer(hashed: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """The hashes of n-grams by those of all but their last token, and of that."""
    return (hashed * np.uint64(0x9E3779B97F4A7C15)) ^ (last + np.uint64(n))


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    mixed = hashes ^ (hashes >> np.uint64(29))
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % parts


class _Terms:
    """All n-grams of a block's rows, as numbers; strings are made of the distinct ones only.

    ``rows`` and ``numbers`` tell each occurrence; ``words`` and ``hashes`` belong to the numbers.
    """

    def __init__(self, texts: pa.Array, stop_words: pa.Array, ngram_range: tuple[int, int]):
        split = pc.split_pattern(texts, " ")
        toks = pc.list_flatten(split).dictionary_encode()
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        plain = pc.and_(pc.greater(pc.utf8_length(toks.dictionary), 1), pc.invert(pc.is_in(toks.dictionary, stop_words)))
        kept = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        # Numbers in the order of the tokens, so that n-grams come out nearly sorted.
        kept = kept[pc.sort_indices(toks.dictionary.take(pa.array(kept))).to_numpy()]
        number = np.full(len(toks.dictionary), -1, np.int64)
        number[kept] = np.arange(len(kept))
        ids = number[toks.indices.to_numpy()]
        row, ids = row[ids >= 0], ids[ids >= 0]
        token = toks.dictionary.take(pa.array(kept))
        own = np.fromiter((zlib.crc32(t.encode()) for t in token.to_pylist()), np.uint64, len(token))
        rows, numbers, words, hashes, size = [], [], [], [], 0
        before, word, hashed = ids, token, own
        for n in range(1, ngram_range[1] + 1):
            if n > 1:
                at = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:])
                keys, same = np.unique(before[at] * len(token) + ids[at + n - 1], return_inverse=True)
                first, last = keys // max(len(token), 1), keys % max(len(token), 1)
                word = pc.binary_join_element_wise(word.take(pa.array(first)), token.take(pa.array(last)), " ")
                hashed = _longer(hashed[first], own[last], n)
                before = np.zeros(len(ids), np.int64)
                before[at] = same
            else:
                at, same = np.arange(len(ids)), ids
            if n >= ngram_range[0]:
                rows.append(row[at])
                numbers.append(same + size)
                words.append(word)
                hashes.append(hashed)
                size += len(word)
        self.rows, self.numbers, self.size = np.concatenate(rows), np.concatenate(numbers), size
        self.words, self.hashes = pa.concat_arrays(words), np.concatenate(hashes)


def encode(stop_words: tuple[str, ...], ngram_range: tuple[int, int], parts: int, names: list[str]) -> Callable:
    """``ENCODED`` of rows ``home, doc_id, [keep], text``, where tokens have spaces between them; a token has two or more characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        table = table.filter(pc.is_valid(table.column("text")))
        for home in pc.unique(table.column("home")).to_pylist():
            yield from _encoded(home, table.filter(pc.equal(table.column("home"), home)),
                                pa.array(stop_words, pa.string()), ngram_range, parts, names)

    return run


def _encoded(home: int, table: pa.Table, stop_words: pa.Array, ngram_range: tuple[int, int], parts: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    found = _Terms(pa.concat_arrays(table.column("text").chunks), stop_words, ngram_range)
    if not found.size:
        return
    part = _part(found.hashes, parts)
    order = np.argsort(part, kind="stable")
    place = np.empty(found.size, np.int64)
    place[order] = np.arange(found.size)
    keys, tfs = np.unique(found.rows * found.size + place[found.numbers], return_counts=True)
    ns = np.bincount(keys % found.size, minlength=found.size).astype(np.int32)
    # Rows of equal ids are one document, of the first such row.
    first: dict[tuple, int] = {}
    of = np.array([first.setdefault(k, i) for i, k in enumerate(zip(*(table.column(c).to_pylist() for c in names)))])
    if len(first) < len(of):
        keys, same = np.unique(of[keys // found.size] * found.size + keys % found.size, return_inverse=True)
        tfs = np.bincount(same, weights=tfs).astype(np.int64)
    docs, ids = keys // found.size, keys % found.size
    lengths = np.bincount(docs, minlength=len(of))
    steps, begin = np.diff(ids, prepend=0), starts(lengths)
    steps[begin[lengths > 0]] = ids[begin[lengths > 0]]
    kinds = {"ids": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32()), "part": pa.int32(), "start": pa.int32(), "chunk": pa.binary()}
    kinds = {c: table.schema.field(c).type for c in names} | kinds

    def batch(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in kinds.items()], names=list(kinds))

    there = np.flatnonzero(lengths > 0)
    for i in range(0, len(there), ROWS):
        some = there[i:i + ROWS]
        at = ranges(begin[some], lengths[some])
        columns = {c: pa.concat_arrays(table.column(c).take(pa.array(some)).chunks) for c in names}
        columns["ids"] = lists(steps[at].astype(np.int32), lengths[some])
        columns["tfs"] = lists(tfs[at].astype(np.int32), lengths[some])
        yield batch(columns, len(some))
    present, begin, lengths = np.unique(part[order], return_index=True, return_counts=True)
    words = found.words.take(pa.array(order))
    chunks = [pack(terms=words.slice(i, n), ns=ns[i:i + n]) for i, n in zip(begin.tolist(), lengths.tolist())]
    yield batch({"home": pa.array([home] * len(present), pa.int32()), "part": pa.array(present, pa.int32()), "start": pa.array(begin, pa.int32()),
                 "chunk": pa.array(chunks, pa.binary())}, len(present))


def merge(min_df: int, max_df: float) -> Callable:
    """``MERGED`` of the chunks of one part."""
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        (words, ns), lengths = unpack(table.column("chunk"), "terms", "ns")
        words = words.dictionary_encode()
        codes, distinct = words.indices.to_numpy(), words.dictionary
        df = np.bincount(codes, weights=ns, minlength=len(distinct)).astype(np.int64)
        kept = np.flatnonzero((df >= min_df) & (df <= max_df))
        known = distinct.take(pa.array(kept))
        order = pc.sort_indices(known).to_numpy()
        rank = np.full(len(distinct), -1, np.int32)
        rank[kept[order]] = np.arange(len(kept), dtype=np.int32)
        ranks, place = rank[codes], ranges(table.column("start").to_numpy().astype(np.int64), lengths)
        hit = ranks >= 0
        n, back = table.num_rows, []
        for i, k in zip(starts(lengths).tolist(), lengths.tolist()):
            some = i + np.flatnonzero(hit[i:i + k])
            back.append(pack(places=place[some], ranks=ranks[some], dfs=df[codes[some]]))
        back = pa.table({"home": table.column("home").combine_chunks(), "part": pa.array([part] * n, pa.int32()), "known": pa.array(back, pa.binary()),
                         "terms": pa.nulls(n, pa.list_(pa.string())), "dfs": pa.nulls(n, pa.list_(pa.int64()))})
        words = pa.table({"home": pa.nulls(1, pa.int32()), "part": pa.array([part], pa.int32()), "known": pa.nulls(1, pa.binary()),
                          "terms": lists(known.take(pa.array(order)), [len(kept)]), "dfs": lists(df[kept[order]], [len(kept)], pa.int64())})
        return pa.concat_tables([back, words])

    return run


def parts_of(parts: int) -> Callable:
    """``part, words``, packed terms and idf, of rows ``term, idf`` by the part to which ``encode`` sends a term."""
    def of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).sort_by("term")
        term, idf = pa.concat_arrays(table.column("term").chunks), table.column("idf").to_numpy()
        split = pc.split_pattern(term, " ")
        toks = pc.list_flatten(split).dictionary_encode()
        own = np.fromiter((zlib.crc32(t.encode()) for t in toks.dictionary.to_pylist()), np.uint64, len(toks.dictionary))[toks.indices.to_numpy()]
        lengths = pc.list_value_length(split).to_numpy().astype(np.int64)
        first = starts(lengths)
        hashed = own[first]
        for n in range(2, int(lengths.max()) + 1):
            more = np.flatnonzero(lengths >= n)
            hashed[more] = _longer(hashed[more], own[first[more] + n - 1], n)
        part = _part(hashed, parts)
        order = np.argsort(part, kind="stable")
        present, begin, n = np.unique(part[order], return_index=True, return_counts=True)
        rows = [pack(terms=term.take(pa.array(order[i:i + k])), idfs=idf[order[i:i + k]]) for i, k in zip(begin.tolist(), n.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array(rows, pa.binary())], names=["part", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # As many terms together as make rows of some length.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= NUMBERS // 8:
                yield of(held)
                held = []
        if sum(b.num_rows for b in held):
            yield of(held)

    return run


def match(chunks: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """``home, known``, packed places and idf of the terms known, of the chunks of one part and its rows of ``parts_of``."""
    (words,), lengths = unpack(chunks.column("chunk"), "terms")
    (terms, idf), _ = unpack(vocabulary.column("words"), "terms", "idfs")
    found = pc.index_in(words, value_set=terms)
    hit, at = pc.is_valid(found).to_numpy(zero_copy_only=False), pc.fill_null(found, 0).to_numpy()
    place, back = ranges(chunks.column("start").to_numpy().astype(np.int64), lengths), []
    for i, k in zip(starts(lengths).tolist(), lengths.tolist()):
        some = i + np.flatnonzero(hit[i:i + k])
        back.append(pack(places=place[some], idfs=idf[at[some]] if len(idf) else np.zeros(0)))
    return pa.table({"home": chunks.column("home"), "known": pa.array(back, pa.binary())})


def terms_of_documents(sublinear_tf: bool) -> Callable:
    """``doc_id, terms``, an array of (term, weight) of unit length, of a block's documents and chunks by the idf of the terms known there."""
    kind = pa.struct([("term", pa.string()), ("weight", pa.float64())])

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        chunks, docs = rows.filter(pc.is_valid(rows.column("part"))), rows.filter(pc.is_null(rows.column("part")))
        (words,), per_row = unpack(chunks.column("chunk"), "terms")
        (places, idfs), _ = unpack(known.column("known"), "places", "idfs")
        word, idf = np.zeros(len(words), np.int64), np.full(len(words), np.nan)
        word[ranges(chunks.column("start").to_numpy().astype(np.int64), per_row)] = np.arange(len(words))
        idf[places] = idfs
        out = []
        # Documents of one id are one row already.
        for i in range(0, docs.num_rows, ROWS):
            some = docs.slice(i, ROWS)
            ids, lengths = flat(some.column("ids"), np.int64)
            total, first = np.cumsum(ids), starts(lengths)
            ids = total - np.repeat(total[first] - ids[first], lengths)
            w = flat(some.column("tfs"))[0].astype(np.float64)
            w = (np.log(w) + 1.0 if sublinear_tf else w) * idf[ids]
            hit, row = ~np.isnan(w), np.repeat(np.arange(len(lengths)), lengths)
            row, ids, w = row[hit], ids[hit], w[hit]
            n = np.bincount(row, minlength=len(lengths))
            w /= np.sqrt(add(row, w ** 2, len(lengths)))[row]
            each = pa.StructArray.from_arrays([words.take(pa.array(word[ids])), pa.array(w)], fields=list(kind))
            out.append(pa.table([some.column("doc_id"), lists(each, n)], names=["doc_id", "terms"]).filter(pa.array(n > 0)))
        return pa.concat_tables(out) if out else pa.table([docs.column("doc_id"), pa.array([], pa.list_(kind))], names=["doc_id", "terms"])

    return run


def weights(tfs: np.ndarray, dfs: np.ndarray, n_docs: int, sublinear_tf: bool) -> np.ndarray:
    """Of postings, before a document has unit length."""
    return (np.log(tfs) + 1.0 if sublinear_tf else tfs) * (np.log((n_docs + 1.0) / (dfs + 1.0)) + 1.0)


def weigh(names: list[str], n_docs: int, sublinear_tf: bool, spelled: bool = False) -> Callable:
    """``WEIGHED`` of a block's documents by the terms known there; all documents of an id have one norm.

    Where ``spelled``, the block's chunks are among its documents, and a row with the numbers of the terms known, in order,
    and, packed, the ``words`` themselves is among the result's.
    """
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        chunks = docs.filter(pc.is_valid(docs.column("part"))) if spelled else None
        if spelled:
            docs = docs.filter(pc.is_null(docs.column("part")))
        ids, lengths = flat(docs.column("ids"), np.int64)
        total = np.cumsum(ids)
        first = starts(lengths)
        ids = total - np.repeat(total[first] - ids[first], lengths) if len(ids) else ids
        number = np.full(int(ids.max(initial=-1)) + 1, -1, np.int64)
        df = np.zeros(len(number), np.int64)
        (places, ranks, dfs), per_row = unpack(known.column("known"), "places", "ranks", "dfs")
        parts = np.repeat(known.column("part").to_numpy().astype(np.int64), per_row)
        number[places], df[places] = parts << 32 | ranks.astype(np.int64), dfs
        hit = number[ids] >= 0
        row = np.repeat(np.arange(len(lengths)), lengths)[hit]
        ids, tfs = ids[hit], flat(docs.column("tfs"))[0][hit]
        squares = add(row, weights(tfs, df[ids], n_docs, sublinear_tf) ** 2, len(lengths))
        by_id: dict = {}
        keys = docs.column("doc_id").to_pylist()
        for key, s in zip(keys, squares):
            by_id[key] = by_id.get(key, 0.0) + s
        some = np.bincount(row, minlength=len(lengths))
        left = pa.array(np.flatnonzero(some > 0))
        out = docs.select(names).take(left)
        norm = np.sqrt(np.fromiter((by_id[k] for k in keys), np.float64, len(keys)))
        some = some[some > 0]
        weighed = pa.table({**{c: out.column(c) for c in names}, "terms": lists(number[ids], some, pa.int64()), "tfs": lists(tfs, some, pa.int32()),
                            "dfs": lists(df[ids], some, pa.int64()), "norm": pa.array(norm[left.to_numpy()])})
        if not spelled:
            return weighed
        weighed = weighed.append_column("words", pa.nulls(weighed.num_rows, pa.binary()))
        if not len(places):
            return weighed
        (words,), per_row = unpack(chunks.column("chunk"), "terms")
        at = np.zeros(len(words), np.int64)
        at[ranges(chunks.column("start").to_numpy().astype(np.int64), per_row)] = np.arange(len(words))
        places = places[np.argsort(number[places])]
        row = {"home": chunks.column("home").slice(0, 1), "terms": lists(number[places], [len(places)], pa.int64()),
               "words": pa.array([pack(terms=words.take(pa.array(at[places])))], pa.binary())}
        return pa.concat_tables([weighed, pa.table([row.get(f.name, pa.nulls(1, f.type)) for f in weighed.schema], schema=weighed.schema)])

    return run


def _spelled(table: pa.Table) -> tuple[pa.Table, np.ndarray, pa.Array]:
    """A block's documents, and the numbers of its terms in order with their words."""
    named = pc.is_valid(table.column("words"))
    words = table.filter(named)
    docs = table.filter(pc.invert(named))
    if not words.num_rows:
        return docs, np.zeros(0, np.int64), pa.array([], pa.string())
    return docs, flat(words.column("terms"), np.int64)[0], unpack(words.column("words"), "terms")[0][0]


def spell(names: list[str], n_docs: int, sublinear_tf: bool) -> Callable:
    """``[names], term, weight`` of a block that was weighed ``spelled``, a row for each posting."""
    def run(table: pa.Table) -> pa.Table:
        docs, numbers, words = _spelled(table)
        schema = pa.schema([*(docs.schema.field(c) for c in names), pa.field("term", pa.string()), pa.field("weight", pa.float64())])
        out = []
        for i in range(0, docs.num_rows, ROWS):
            some = docs.slice(i, ROWS)
            terms, w, lengths = _postings(some, n_docs, sublinear_tf)
            row = pa.array(np.repeat(np.arange(some.num_rows), lengths))
            term = words.take(pa.array(np.searchsorted(numbers, terms)))
            out.append(pa.table([*(some.column(c).take(row) for c in names), term, pa.array(w)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def vectors(names: list[str], size: int, before: list[int], n_docs: int, sublinear_tf: bool) -> Callable:
    """``names, features``, sparse vectors as structs, of a block's documents and the rows ``names`` that ask for them by ``doc_id``.

    A term's place is its rank in its part and the number of terms in the parts ``before``.
    """
    shift = np.array(before, np.int64)

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        found = pc.index_in(asked.column("doc_id"), value_set=docs.column("doc_id"), skip_nulls=True)
        there = np.flatnonzero(pc.is_valid(found).to_numpy())
        terms, w, lengths = _postings(docs, n_docs, sublinear_tf)
        places = shift[terms >> 32] + (terms & np.int64(2**32 - 1))
        by = np.lexsort((places, np.repeat(np.arange(len(lengths)), lengths)))
        places, w = places[by], w[by]
        n = np.zeros(asked.num_rows, np.int64)
        row = found.drop_null().to_numpy().astype(np.int64)
        n[there] = lengths[row]
        at = ranges(starts(lengths)[row], lengths[row])
        offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        # As Spark has a vector: neither numbers nor the type are ever null.
        of = [pa.list_(pa.field("element", kind, nullable=False)) for kind in (pa.int32(), pa.float64())]
        columns = [pa.array(np.zeros(len(n), np.int8)), pa.array(np.full(len(n), size, np.int32)),
                   *(pa.ListArray.from_arrays(offsets, pa.array(v[at], t.value_type), type=t) for v, t in zip((places, w), of))]
        fields = [pa.field("type", pa.int8(), nullable=False), pa.field("size", pa.int32()), pa.field("indices", of[0]), pa.field("values", of[1])]
        features = pa.StructArray.from_arrays(columns, fields=fields)
        return asked.select(names).append_column("features", features)

    return run


# Sums of a block, or, where home is null, of all blocks: packed entries by rank in the part and cell, a class and fold;
# ``asked`` are the ranks of which a block wants to know all entries, ``totals`` the sums of each cell.
SUMS = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("entries", T.BinaryType()),
                     T.StructField("asked", T.BinaryType())])
ALL_SUMS = T.StructType(SUMS.fields[:3] + [T.StructField("totals", T.ArrayType(T.DoubleType()))])
# Numbers in the arrays of logarithms that a task makes at a time.
NUMBERS = 2**23


@dataclass(frozen=True)
class Cells:
    """Places of sums by class and fold; with folds, a last place is for rows in no fold."""

    labels: tuple[int, ...]
    n_folds: int

    @property
    def folds(self) -> int:
        return self.n_folds + 1 if self.n_folds else 1

    def __len__(self) -> int:
        return len(self.labels) * self.folds

    def of(self, labels: pa.ChunkedArray, folds: pa.ChunkedArray | None) -> np.ndarray:
        """The cell of each row, -1 for rows of no class."""
        index = pc.fill_null(pc.index_in(labels, pa.array(self.labels, labels.type)), -1).to_numpy().astype(np.int64)
        return np.where(index < 0, -1, index * self.folds + (self.fold(folds) if self.n_folds else 0))

    def fold(self, folds: pa.ChunkedArray) -> np.ndarray:
        return pc.fill_null(folds, self.n_folds).to_numpy().astype(np.int64)

    def slots(self, dense: np.ndarray) -> np.ndarray:
        """[term][slot][class]: sums over all rows, then over the rows outside each fold."""
        by = dense.reshape(len(dense), len(self.labels), self.folds)
        out = [by.sum(axis=2)] + [by[:, :, [g for g in range(self.n_folds) if g != f]].sum(axis=2) for f in range(self.n_folds)]
        return np.stack(out, axis=1)

    def dense(self, at: np.ndarray, cells: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
        return add(at * len(self) + cells, sums, n * len(self)).reshape(n, len(self))


def _postings(rows: pa.Table, n_docs: int, sublinear_tf: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, weights, and the number of them in each row."""
    terms, lengths = flat(rows.column("terms"), np.int64)
    raw = weights(flat(rows.column("tfs"))[0], flat(rows.column("dfs"))[0], n_docs, sublinear_tf)
    return terms, raw / np.repeat(rows.column("norm").to_numpy(), lengths), lengths


def add_up(cells: Cells, n_docs: int, sublinear_tf: bool) -> Callable:
    """``SUMS`` of rows ``home, label_idx, fold, learn, ask, terms, tfs, dfs, norm``."""
    def of_block(home: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        terms, w, lengths = _postings(rows, n_docs, sublinear_tf)
        cell = cells.of(rows.column("label_idx"), rows.column("fold"))
        learn, ask = rows.column("learn").to_numpy() & (cell >= 0), np.repeat(rows.column("ask").to_numpy(), lengths)
        distinct, at = np.unique(terms, return_inverse=True)
        taught = np.repeat(learn, lengths)
        keys, same = np.unique(at[taught] * len(cells) + np.repeat(cell, lengths)[taught], return_inverse=True)
        sums = add(same, w[taught], len(keys))
        asked = np.zeros(len(distinct), bool)
        asked[at[ask]] = True
        asked, known = distinct[asked], distinct[keys // len(cells)]
        parts = np.unique(distinct >> 32)
        low, cell = np.int64(2**32 - 1), (keys % len(cells)).astype(np.int16)
        n, m = (np.searchsorted(of, np.append(parts << 32, np.iinfo(np.int64).max)) for of in (known, asked))
        entries = [pack(ranks=known[i:j] & low, cells=cell[i:j], sums=sums[i:j]) for i, j in zip(n, n[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([home] * len(parts), pa.int32()), pa.array(parts, pa.int32()), pa.array(entries, pa.binary()),
             pa.array([pack(ranks=asked[i:j] & low) for i, j in zip(m, m[1:])], pa.binary())], names=SUMS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block whose rows come in more than one go sends its sums in as many rows.
        held: dict[int, list[pa.RecordBatch]] = {}
        n = 0
        for batch in batches:
            homes = batch.column("home")
            for home in pc.unique(homes).to_pylist():
                held.setdefault(home, []).append(batch.filter(pc.equal(homes, home)))
            n += pc.sum(pc.list_value_length(batch.column("terms"))).as_py() or 0
            if n > NUMBERS:
                for home, some in held.items():
                    yield from of_block(home, some)
                held, n = {}, 0
        for home, some in held.items():
            yield from of_block(home, some)

    return run


def total(cells: Cells) -> Callable:
    """``ALL_SUMS`` of a part: one row with all, and for each block one with the entries of what it asked for."""
    def run(table: pa.Table) -> pa.Table:
        (ranks, cell, sums), _ = unpack(table.column("entries"), "ranks", "cells", "sums")
        keys, same = np.unique(ranks.astype(np.int64) * len(cells) + cell, return_inverse=True)
        sums = add(same, sums, len(keys))
        ranks, cell = keys // len(cells), (keys % len(cells)).astype(np.int16)
        (asked,), lengths = unpack(table.column("asked"), "ranks")
        # A block that sent more than one row gets one back: no entry is told twice.
        rows, of, homes = [pack(ranks=ranks, cells=cell, sums=sums)], np.repeat(table.column("home").to_numpy(), lengths), []
        by = np.argsort(of, kind="stable")
        for home in np.unique(of):
            mine = np.unique(asked[by[np.searchsorted(of[by], home, "left"):np.searchsorted(of[by], home, "right")]])
            first, last = np.searchsorted(ranks, mine, "left"), np.searchsorted(ranks, mine, "right")
            at = ranges(first, last - first)
            homes.append(int(home))
            rows.append(pack(ranks=ranks[at], cells=cell[at], sums=sums[at]))
        totals = add(cell, sums, len(cells))
        return pa.table({"home": pa.array([None, *homes], pa.int32()), "part": pa.array([table.column("part")[0].as_py()] * len(rows), pa.int32()),
                         "entries": pa.array(rows, pa.binary()), "totals": lists(totals, [len(totals)] + [0] * len(homes))})

    return run


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order, cells and sums."""
    (ranks, cell, sums), lengths = unpack(rows.column("entries"), "ranks", "cells", "sums")
    terms = np.repeat(rows.column("part").to_numpy().astype(np.int64), lengths) << 32 | ranks.astype(np.int64)
    by = np.argsort(terms, kind="stable")
    return terms[by], cell[by].astype(np.int64), sums[by]


def complement_logs(cells: Cells, alphas: tuple[float, ...]) -> Callable:
    """``n_terms, logs`` of rows of ``ALL_SUMS``: for each slot, class and smoothing the logarithms of the terms' sums in other classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, cell, sums = _entries(pa.Table.from_batches([batch]))
            distinct, at = np.unique(terms, return_inverse=True)
            step, logs = max(1, NUMBERS // (len(cells) + 1)), np.zeros(((cells.n_folds + 1), len(cells.labels), len(alphas)))
            for start in range(0, len(distinct), step):
                n = min(step, len(distinct) - start)
                some = slice(*np.searchsorted(at, (start, start + n)))
                of = cells.slots(cells.dense(at[some] - start, cell[some], sums[some], n))
                others = of.sum(axis=2, keepdims=True) - of
                for i, a in enumerate(alphas):
                    logs[:, :, i] += np.log(others + a).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([len(distinct)], pa.int64()), lists(logs.ravel(), [logs.size])], names=["n_terms", "logs"])

    return run


def doc_sums(cells: Cells, candidates: list[tuple[str, float]], n_docs: int, sublinear_tf: bool) -> Callable:
    """``doc_id, g, w`` of a block's documents: for each class and candidate (kind, alpha) the sum of weights times logarithms, and of weights."""
    classes, width = len(cells.labels), len(cells.labels) * len(candidates)

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        known, cell, sums = _entries(answers)
        terms, w, lengths = _postings(rows, n_docs, sublinear_tf)
        slot = cells.fold(rows.column("fold")) + 1 if cells.n_folds else np.zeros(len(lengths), np.int64)
        g, first = np.zeros((len(lengths), width)), starts(lengths)
        for s in range(cells.n_folds + 1):
            mine = np.flatnonzero((slot == s) & (lengths > 0))
            # Pieces of documents, so that a task's arrays have a bound.
            pieces = np.cumsum(lengths[mine]) // max(1, NUMBERS // (width + len(cells)))
            for piece in np.unique(pieces):
                docs = mine[pieces == piece]
                at = ranges(first[docs], lengths[docs])
                distinct, of = np.unique(terms[at], return_inverse=True)
                low, high = np.searchsorted(known, distinct, "left"), np.searchsorted(known, distinct, "right")
                entry = ranges(low, high - low)
                dense = cells.dense(np.repeat(np.arange(len(distinct)), high - low), cell[entry], sums[entry], len(distinct))
                own = cells.slots(dense)[:, s, :]
                others = own.sum(axis=1, keepdims=True) - own
                logs = np.stack([np.log(np.maximum(own if kind == "multinomial" else others, 0.0) + a) for kind, a in candidates], axis=2)
                g[docs] = np.add.reduceat(logs.reshape(len(distinct), width)[of] * w[at][:, None], starts(lengths[docs]), axis=0)
        row = np.repeat(np.arange(len(lengths)), lengths)
        return pa.table({"doc_id": rows.column("doc_id"), "g": lists(g.ravel(), [width] * len(g)), "w": add(row, w, len(lengths))})

    return run


def classes_of_terms(cells: Cells) -> Callable:
    """``term, classes`` of rows ``terms, entries`` without folds: the classes that have seen a term, with their sums."""
    kind = pa.list_(pa.struct([("label_idx", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ranks, cell, sums), _ = unpack(batch.column("entries").slice(i, 1), "ranks", "cells", "sums")
                terms = batch.column("terms")[i].values
                distinct, counts = np.unique(ranks, return_counts=True)
                label = pa.array(np.array(cells.labels, np.int32)[cell], pa.int32())
                each = pa.StructArray.from_arrays([label, lists(sums, np.ones(len(sums), np.int64))], names=["label_idx", "sums"])
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(distinct)), lists(each, counts).cast(kind)], names=["term", "classes"])

    return run
