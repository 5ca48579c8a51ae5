"""Lexical retrieval packing: fixed windows filled with a seed document's nearest unused neighbours.

``tokenize`` gives each text its ids by the tokenizers library (each distinct
pre-token of a block is encoded once) and an end id. ``pack`` counts documents,
ids and the documents of each term over the whole corpus, and deals documents
into shards by content: they are ordered by their strongest terms
(``content_key``), and the order is cut into shards of about ``SHARD_BYTES`` of
text, whatever the number of documents and however the files are laid out. So
copies and documents of one subject meet, and a frequent subject is cut by its
next terms. A shard keeps a BM25 inverted index over the token ids of its
documents, with the corpus's statistics. Full windows of long documents come
first; then all terms of each seed query the index, and its unused neighbours
in the shard fill the seed's window in order of score; neighbours in other
shards are not seen. The
neighbour that overruns is cut, and its rest stays in the index. Only the last
window of a shard is not full; it is cut at powers of two, which take no
padding.

Nulls: a null text is the empty text, one end id; a null document id is kept.
Repeated rows are packed as often as they occur, and any number of them is
dealt to as many shards as their ids fill. A very long text, or one long word
without a space, is cut into windows like any other; a document longer than a
shard is a shard of its own. Equal scores go to the smaller id, then to the
row that was read first. An empty table packs nothing. Only the two named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import chunks, lean, modest_batches, stored, string_buffers, table, text_or_empty

WINDOW = 2048
END_ID = 1
#: Bytes of text in a shard, about: some 800,000 ids.
SHARD_BYTES = 2_000_000
K1, B = 1.2, 0.75
#: Least documents, in shards, of the terms that lead a content key, and how many of the strongest terms follow them.
SUBJECT_SHARDS, KEY_TERMS = (3, 1), 8
#: Bytes of text that a task splits at a time.
BLOCK_BYTES = 2 << 20
#: Pre-tokens that the tokenizer gets in one string.
LINES = 64
#: Words whose ids a worker process remembers.
KNOWN_WORDS = 900_000


class Words:
    """A tokenizer of one process, and the words that it has met with their ids.

    Words are known by 128-bit hashes, kept sorted in flat arrays of some 35
    bytes a word; a look-up is a binary search and builds nothing anew.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = id_type(self.tokenizer.get_vocab_size())
        line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_break = line_break[0] if len(line_break) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.high, self.low, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.ends = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Each distinct word's place among the known ones; new words are encoded and added."""
        import xxhash

        if len(self.place) + len(words) > KNOWN_WORDS:
            self._forget()
        plain = words.to_pylist()
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, plain)), np.uint64).reshape(-1, 2)
        at = np.searchsorted(self.high, hashes[:, 0])
        near = np.minimum(at, max(len(self.high) - 1, 0))
        hit = (self.high[near] == hashes[:, 0]) & (self.low[near] == hashes[:, 1]) if len(self.high) else np.zeros(len(plain), bool)
        places = np.zeros(len(plain), np.int64)
        places[hit] = self.place[near[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            ids, sizes = self._encoded([plain[i].decode() for i in new.tolist()])
            places[new] = len(self.ends) - 1 + np.arange(len(new))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids.astype(self.kind)])
            rising = new[np.argsort(hashes[new, 0], kind="stable")]
            self.high, self.low = np.insert(self.high, at[rising], hashes[rising, 0]), np.insert(self.low, at[rising], hashes[rising, 1])
            self.place = np.insert(self.place, at[rising], places[rising].astype(np.int32))
        return places

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these pre-tokens, and how many each has.

        Pre-tokens that aren't white space are encoded many at a time, a line
        each: a line break is a pre-token of its own before them and after
        them, and its id marks where they end.
        """
        solid = np.array([not w.isspace() for w in words], bool)
        lines = [w for w, s in zip(words, solid) if s]
        joined = ["\n".join(lines[i : i + LINES]) + "\n" for i in range(0, len(lines), LINES)]
        found = self._flat(joined)
        at = np.flatnonzero(found == self.line_break) if self.line_break is not None else np.zeros(0, np.int64)
        if len(at) != len(lines):  # this tokenizer has no line break of its own
            each = [self._flat([w]) for w in words]
            return np.concatenate(each), np.array([len(e) for e in each], np.int64)
        sizes = np.zeros(len(words), np.int64)
        sizes[solid] = np.diff(at, prepend=-1) - 1
        spaces = [self._flat([w]) for w, s in zip(words, solid) if not s]
        sizes[~solid] = [len(e) for e in spaces]
        ids = np.empty(int(sizes.sum()), np.int32)
        of_solid = np.repeat(solid, sizes)
        ids[of_solid] = np.delete(found, at)
        ids[~of_solid] = np.concatenate(spaces) if spaces else []
        return ids, sizes

    def _flat(self, texts: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(array("i", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts, and the n+1 offsets of each text's ids."""
        tokens, rows = pretokens.split(texts)
        if not len(tokens):
            return np.zeros(0, self.kind), np.zeros(len(rows), np.int64)
        coded = tokens.dictionary_encode()
        places = self._places(coded.dictionary)
        width = self.ids.itemsize
        each = pa.Array.from_buffers(pa.large_binary(), len(self.ends) - 1, [None, pa.py_buffer(self.ends * width), pa.py_buffer(self.ids)])
        stream, ends = string_buffers(pc.take(each, pa.array(places[coded.indices.to_numpy(zero_copy_only=False)])))
        return np.ascontiguousarray(stream).view(self.kind), ends[rows] // width


@cache
def _words(path: str) -> Words:
    return Words(path)


def id_type(vocabulary: int) -> str:
    """How ids of so large a vocabulary are stored: little-endian in two bytes where they fit, else in four."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenize(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, place, row, ids, stats): ids as the little-endian integers of ``id_type`` in a binary column, ``end_id`` last.

    place: a hash of the row's content, row: what tells equal rows apart. One
    more row a task, of which only stats is not null, holds the task's share
    of the corpus's statistics (``Corpus.packed``).
    """
    plain = df.select(F.col(id_column).alias("doc_id"), F.xxhash64(id_column, text_column).alias("place"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_column).alias("text"))
    key_type = plain.select("doc_id").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("doc_id", key_type), ("place", pa.int64()), ("row", pa.int64()), ("ids", pa.binary()), ("stats", pa.binary())])

    def work(batches):
        own = _words(tokenizer_path)
        seen = Corpus(np.zeros(0, np.int64), 0, 0)
        for batch in batches:
            texts = batch.column("text")
            for start, end in chunks(texts, BLOCK_BYTES):
                ids, rows = own.encode(texts.slice(start, end - start))
                closed = np.insert(ids, rows[1:], end_id)
                rows = rows + np.arange(len(rows))
                seen = seen.with_block(closed, rows)
                cells = pa.Array.from_buffers(pa.large_binary(), end - start, [None, pa.py_buffer(rows * closed.itemsize), pa.py_buffer(closed)])
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(key_type), part.column("place"), part.column("row"), cells.cast(pa.binary()), pa.nulls(end - start, pa.binary())], schema=schema)
        if seen.n:
            yield pa.RecordBatch.from_pylist([{"stats": seen.packed()}], schema=schema)

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(lean(work), f"doc_id {kind}, place bigint, row bigint, ids binary, stats binary")


def _pairs(ids: np.ndarray, rows: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often) of every document and term that it has, by document, then term."""
    doc = np.repeat(np.arange(len(rows) - 1, dtype=np.int64), np.diff(rows))
    pair, times = np.unique(doc * terms + ids, return_counts=True)
    doc = pair // terms
    return doc, pair - doc * terms, times


@dataclass
class Corpus:
    """How many documents have each term, how many there are, and their ids in all; of fixed bounds, as terms are token ids."""

    found: np.ndarray
    n: int
    ids: int

    @classmethod
    def of(cls, documents: list[np.ndarray]) -> Corpus:
        return cls(np.zeros(0, np.int64), 0, 0).with_block(np.concatenate(documents) if documents else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64))

    def plus(self, other: Corpus) -> Corpus:
        longer, shorter = (self.found, other.found) if len(self.found) >= len(other.found) else (other.found, self.found)
        found = longer.copy()
        found[: len(shorter)] += shorter
        return Corpus(found, self.n + other.n, self.ids + other.ids)

    def with_block(self, ids: np.ndarray, rows: np.ndarray) -> Corpus:
        """The statistics with those of more documents, given as all their ids and the n+1 offsets."""
        _, terms, _ = _pairs(ids, rows, int(ids.max()) + 1 if len(ids) else 1)
        return self.plus(Corpus(np.bincount(terms), len(rows) - 1, len(ids)))

    def packed(self) -> bytes:
        return np.concatenate([[self.n, self.ids], self.found]).astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> Corpus:
        numbers = np.frombuffer(raw, "<i8")
        return cls(numbers[2:], int(numbers[0]), int(numbers[1]))

    def idf(self, terms: np.ndarray) -> np.ndarray:
        return np.log1p((self.n - self.found[terms] + 0.5) / (self.found[terms] + 0.5))

    def norm(self, sizes):
        return K1 * (1 - B + B * sizes * self.n / self.ids)


def corpus_of(tokens: DataFrame) -> Corpus:
    """The statistics of all documents, from the tasks' shares in ``tokens``."""

    def work(batches):
        seen = Corpus(np.zeros(0, np.int64), 0, 0)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                seen = seen.plus(Corpus.unpacked(raw))
        terms = np.flatnonzero(seen.found)
        for start in range(0, len(terms), 100_000):
            part = terms[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen.found[part])], names=["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2], pa.int64()), pa.array([seen.n, seen.ids], pa.int64())], names=["term", "n"])

    rows = tokens.where("stats is not null").select("stats").mapInArrow(lean(work), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    by_term = dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist()))
    n, ids = by_term.pop(-1, 0), by_term.pop(-2, 0)
    found = np.zeros(max(by_term, default=-1) + 1, np.int64)
    found[list(by_term)] = list(by_term.values())
    return Corpus(found, n, ids)


def content_keys(ids: np.ndarray, rows: np.ndarray, corpus: Corpus, shards: int) -> np.ndarray:
    """(documents, terms) by which documents are ordered: the strongest of those terms that fill some shards, then the strongest of all, falling; equal weights by term.

    Weights are compared to 24 bits, so that one sort of integers (document, weight, term) ranks the terms of all documents.
    """
    n, terms = len(rows) - 1, len(corpus.found)
    doc, term, tf = _pairs(ids, rows, terms)
    weight = (corpus.idf(term) * tf * (K1 + 1) / (tf + corpus.norm(np.diff(rows))[doc])).astype(np.float32)
    falling = (1 << 24) - 1 - (weight.view(np.int32).astype(np.int64) >> 7)
    bits = terms.bit_length()
    ranked = np.sort((doc << (24 + bits)) | (falling << bits) | term)
    ranked_term, first = ranked & ((1 << bits) - 1), np.searchsorted(doc, np.arange(n + 1))
    keys = np.zeros((n, len(SUBJECT_SHARDS) + KEY_TERMS), ">u4")
    for i, k in enumerate(SUBJECT_SHARDS):
        wide = np.flatnonzero(corpus.found[ranked_term] >= min(k * corpus.n / shards, corpus.found.max()))
        owner = ranked[wide] >> (24 + bits)
        lead = np.searchsorted(owner, np.arange(n))
        has = lead < len(owner)
        has[has] = owner[lead[has]] == np.flatnonzero(has)
        keys[has, i] = ranked_term[wide[lead[has]]]
    rank = np.arange(len(ranked)) - first[doc]
    strong = np.flatnonzero(rank < KEY_TERMS)
    keys[doc[strong], len(SUBJECT_SHARDS) + rank[strong]] = ranked_term[strong]
    return keys


def _keys_of(batch: pa.RecordBatch, kind: str, corpus: Corpus, shards: int) -> tuple[list[bytes], np.ndarray]:
    """Each row's content key, closed by its place and row, and its number of ids."""
    data, offsets = string_buffers(batch.column("ids"))
    rows = offsets // np.dtype(kind).itemsize
    keys = content_keys(np.ascontiguousarray(data).view(kind), rows, corpus, shards)
    tail = np.stack([batch.column("place").to_numpy(), batch.column("row").to_numpy()], axis=1).astype(">i8")
    raw = np.concatenate([np.ascontiguousarray(keys).view(np.uint8), np.ascontiguousarray(tail).view(np.uint8)], axis=1)
    joined, width = raw.tobytes(), raw.shape[1]
    return [joined[i : i + width] for i in range(0, len(joined), width)], np.diff(rows)


def keyed(tokens: DataFrame, corpus: Corpus, shards: int, kind: str) -> DataFrame:
    """(key, n): each row's content key and its number of ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(corpus)

    def work(batches):
        for batch in batches:
            keys, n = _keys_of(batch, kind, shared.value, shards)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(n)], names=["key", "n"])

    return tokens.select("place", "row", "ids").mapInArrow(lean(work), "key binary, n bigint")


def bounds_of(keys: DataFrame, shards: int, most: int) -> list[bytes]:
    """The least key of each shard but the first: the keys in order, cut where a shard would pass ``most`` ids.

    Ranges of keys are cut one by one, as many as 16 shards make, so that no task holds the order of all.
    """

    def work(batches):
        held = most
        for batch in batches:
            cuts = []
            for key, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist()):
                if held + n > most:
                    cuts.append(key)
                    held = 0
                held += n
            yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.binary())], names=["key"])

    ranges = keys.repartitionByRange(-(-shards // 16), "key").sortWithinPartitions("key")
    return sorted(ranges.mapInArrow(lean(work), "key binary").toArrow().column("key").to_pylist())[1:]


def dealt(tokens: DataFrame, corpus: Corpus, shards: int, kind: str) -> DataFrame:
    """The documents with their shard, by content."""
    documents = tokens.where("ids is not null").select("doc_id", "place", "row", "ids")
    bounds = bounds_of(stored(keyed(documents, corpus, shards, kind)), shards, -(-corpus.ids // shards)) if shards > 1 else []
    if not bounds:
        return documents.withColumn("shard", F.lit(0).cast("long"))
    shared = tokens.sparkSession.sparkContext.broadcast((corpus, bounds))

    def work(batches):
        corpus, bounds = shared.value
        for batch in batches:
            shard = [bisect_right(bounds, key) for key in _keys_of(batch, kind, corpus, shards)[0]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64())], names=["doc_id", "place", "row", "ids", "shard"])

    key_type = tokens.schema["doc_id"].dataType.simpleString()
    return documents.mapInArrow(lean(work), f"doc_id {key_type}, place bigint, row bigint, ids binary, shard bigint")


class Index:
    """BM25 over the documents of one shard, terms being token ids; statistics are the corpus's."""

    def __init__(self, documents: list[np.ndarray], corpus: Corpus):
        sizes = np.array([len(d) for d in documents])
        self.n = len(documents)
        self.doc, term, tf = _pairs(np.concatenate(documents), np.concatenate([[0], np.cumsum(sizes)]), len(corpus.found))
        terms = np.flatnonzero(np.bincount(term))
        place = np.zeros(len(corpus.found), np.int32)
        place[terms] = np.arange(len(terms))
        self.term = place[term]
        found = np.bincount(self.term, minlength=len(terms))
        weight = corpus.idf(terms)[self.term] * tf * (K1 + 1) / (tf + corpus.norm(sizes)[self.doc])
        self.doc_rows = np.searchsorted(self.doc, np.arange(self.n + 1))
        order = np.argsort(self.term.astype(np.uint16) if len(terms) <= 1 << 16 else self.term, kind="stable")  # of 16 bits: a radix sort
        self.posted_doc, self.posted_weight = self.doc[order], weight[order]
        self.term_rows = np.concatenate([[0], np.cumsum(found)])
        # terms that many documents have are rows of a table, as their lists are long
        frequent = np.flatnonzero(found * 8 > self.n)
        self.table_row = np.full(len(terms), -1)
        self.table_row[frequent] = np.arange(len(frequent))
        self.table = np.zeros((len(frequent), self.n))
        at = np.flatnonzero(self.table_row[self.term] >= 0)
        self.table[self.table_row[self.term[at]], self.doc[at]] = weight[at]

    def scores(self, seed: int) -> np.ndarray:
        """Every document's score for all terms of the seed."""
        terms = self.term[self.doc_rows[seed] : self.doc_rows[seed + 1]]
        row = self.table_row[terms]
        asked = np.zeros(len(self.table))
        asked[row[row >= 0]] = 1
        found = asked @ self.table
        rare = terms[row < 0]
        if len(rare):
            begin, size = self.term_rows[rare], self.term_rows[rare + 1] - self.term_rows[rare]
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            found += np.bincount(self.posted_doc[at], self.posted_weight[at], minlength=self.n)
        return found


def fill(documents: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset): every id in exactly one piece, no gaps in a sequence.

    All sequences are full but the last few, whose lengths are falling powers of two. Without a corpus the documents are their own.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    done = np.zeros(len(documents), np.int64)
    sizes = np.array([len(d) for d in documents], np.int64)
    for i, size in enumerate(sizes.tolist()):
        while size - done[i] >= window:
            pieces.append((i, int(done[i]), window, sequence, 0))
            done[i] += window
            sequence += 1
    index = Index(documents, corpus or Corpus.of(documents)) if len(documents) > 1 else None
    left = int((sizes - done).sum())
    waiting = iter(range(len(documents)))
    current = None
    while left >= window:
        seed = current if current is not None and done[current] < sizes[current] else next(i for i in waiting if done[i] < sizes[i])
        room = window

        def put(i: int) -> None:
            nonlocal room, left, current
            take = min(room, int(sizes[i] - done[i]))
            pieces.append((i, int(done[i]), take, sequence, window - room))
            done[i] += take
            room -= take
            left -= take
            current = i

        put(seed)
        if room and index is not None:
            scores = index.scores(seed)
            scores[done >= sizes] = -1
            ranked = np.argsort(-scores, kind="stable")
            for i in ranked.tolist():
                if not room:
                    break
                if done[i] < sizes[i]:
                    put(i)
        sequence += 1
    # The rest is shorter than a window: sequences of falling powers of two.
    order = [*([current] if current is not None else []), *range(len(documents))]
    queue = [i for i in dict.fromkeys(order) if done[i] < sizes[i]]
    while left:
        length = 1 << (left.bit_length() - 1)
        offset = 0
        while offset < length:
            i = queue[0]
            take = min(length - offset, int(sizes[i] - done[i]))
            pieces.append((i, int(done[i]), take, sequence, offset))
            done[i] += take
            offset += take
            if done[i] == sizes[i]:
                queue.pop(0)
        left -= length
        sequence += 1
    return pieces


def pack(tokens: DataFrame, shards: int, window: int = WINDOW, kind: str = "<u4") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of the rows of ``tokenize``, which are read twice; ids: the piece's own, as uint32 in binary.

    ``kind``: the integers that the given ids are stored as.
    """
    key_type = tokens.schema["doc_id"].dataType.simpleString()
    corpus = corpus_of(tokens)
    shared = tokens.sparkSession.sparkContext.broadcast(corpus)

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("doc_id", "ascending"), ("place", "ascending"), ("row", "ascending")])
        ids, shard = group.column("ids"), group.column("shard")[0].as_py()
        documents = [np.frombuffer(x.as_buffer(), kind) for x in ids]
        pieces = np.array(fill(documents, window, shared.value), np.int64).reshape(-1, 5)
        cells = [documents[i][a : a + n].astype("<u4").tobytes() for i, a, n in pieces[:, :3].tolist()]
        sizes = np.array([len(d) for d in documents])
        return pa.table({
            "doc_id": group.column("doc_id").take(pa.array(pieces[:, 0])), "start": pieces[:, 1], "length": pieces[:, 2], "ids": pa.array(cells, pa.binary()),
            "doc_tokens": sizes[pieces[:, 0]], "sequence_id": pieces[:, 3] + (shard << 32), "offset": pieces[:, 4],
        })

    return dealt(tokens, corpus, shards, kind).groupBy("shard").applyInArrow(work, f"doc_id {key_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def shards_for(df: DataFrame, text_column: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards of about so many bytes the texts make."""
    total = df.agg(F.sum(F.octet_length(F.col(text_column).cast("string")).cast("long"))).head()[0] or 0
    return max(1, -(-total // shard_bytes))


def packed(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) tokenised and packed."""
    import public_tokenizers
    from tokenizers import Tokenizer

    modest_batches(docs.sparkSession)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(stored(tokenize(docs, path)), shards_for(docs), kind=id_type(Tokenizer.from_file(path).get_vocab_size()))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the pieces of all documents."""
    pieces = packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
