"""Byte-level BPE: encoding by recursive queries in DuckDB, decoding by ordered aggregation.

Each task splits its texts into pre-tokens (``pretokens``) and gives the
distinct ones that it has not met to a DuckDB connection of its own process.
There a word is a set of token-position rows. One step of the recursive query
joins neighbouring rows with the merge table, takes the leftmost pair of
minimum rank of each word and contracts it; words without a pair are done.
Documents are then put together from their words' ids. Decoding joins the rows
(document, position, id) with the vocabulary and aggregates in order.

The query keeps the rows of all steps, so a word costs the square of its
length. Words over ``PIECE`` bytes are therefore contracted in pieces, and the
seams between pieces are contracted anew (``Codec.joined``): tokens are a
text's encoding if every two neighbours are the encoding of their own bytes,
and inside any encoding they are. So only the seams need a look, and the
cost grows with the length.

The merge table follows from the ranks file alone. Texts are handled in blocks
of bounded bytes and queries in blocks of bounded rows, without files of their
own; the memory of known words is bounded and emptied when full.

Nulls: a null text is the empty text, without ids; null ids decode to the
empty byte string. An id that is not in the vocabulary is an error. Ties of
rank go to the left. Repeated rows are encoded as often as they occur. An
empty table gives no rows. Only the named columns are read; they leave under
their own names, beside ``ids`` or ``decoded``.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import chunks, lean, modest_batches, string_buffers, table, text_or_empty

#: Words whose ids a worker process remembers.
KNOWN_WORDS = 400_000
#: Ids that one decoding query takes at a time.
DECODE_IDS = 2_000_000
DUCKDB_MEMORY = "300MB"
#: Tokens of either side that a seam's window takes.
SEAM = 6
#: Bytes of a word that one query contracts as a whole, and rows (half the squares of the words' lengths) of one query.
PIECE, QUERY_ROWS = 128, 3_000_000

#: Both sides of a pair are below 2**17, a position below 2**32.
CONTRACT = """
WITH RECURSIVE state(step, word, pos, token, next_pos, next_token) AS (
    SELECT 0, word, pos, token, lead(pos) OVER w, lead(token) OVER w FROM letters WINDOW w AS (PARTITION BY word ORDER BY pos)
    UNION ALL
    SELECT step + 1, word, pos, token, lead(pos) OVER w, lead(token) OVER w
    FROM (
        SELECT r.step, r.word, r.pos, CASE WHEN r.pos = b.pos THEN b.merged ELSE r.token END AS token
        FROM state r
        JOIN (
            SELECT word, min(place) & 4294967295 AS pos, (min(place) >> 32)::INTEGER AS merged, arg_min(next_pos, place) AS gone
            FROM (SELECT word, next_pos, (merges.rank << 32) + pos AS place FROM state JOIN merges ON merges.pair = state.token::BIGINT * 131072 + state.next_token)
            GROUP BY word
        ) b ON r.word = b.word AND r.pos <> b.gone
    )
    WINDOW w AS (PARTITION BY word ORDER BY pos)
)
SELECT word, list(token ORDER BY pos) AS ids
FROM state JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) USING (word, step)
GROUP BY word ORDER BY word
"""

DECODE = """
SELECT doc, string_agg(vocabulary.hex, '' ORDER BY pos) AS hex
FROM positions JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(pair, rank) of every two tokens whose concatenation is a token: that token's id is the pair's rank."""
    pairs, merged = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs.append(left * 131072 + right)
                merged.append(rank)
    return pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(merged, pa.int64())})


class Codec:
    """One process's DuckDB connection with the merge table and vocabulary, and the words that it knows."""

    def __init__(self, path: str):
        import duckdb

        ranks = read_ranks(path)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        self.con.register("given_merges", merge_table(ranks))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given_merges")
        self.con.register("given_words", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [k.hex() for k in ranks]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given_words")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = {k: np.int32(v).tobytes() for k, v in ranks.items()}
        self.token = {v: k for k, v in ranks.items()}
        self.known: dict[bytes, bytes] = {}

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32, as bytes) of words that are not tokens themselves."""
        long = [i for i, w in enumerate(words) if len(w) > PIECE]
        if not long:
            return self._contracted_all(words)
        apart = set(long)
        short = iter(self._contracted_all([w for i, w in enumerate(words) if i not in apart]))
        return [self.joined(w) if i in apart else next(short) for i, w in enumerate(words)]

    def _contracted_all(self, words: list[bytes]) -> list[bytes]:
        """``contract`` of words as wholes, in queries of bounded rows."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes * (sizes + 1) // 2) // QUERY_ROWS)) + 1
        bounds = [0, *cuts.tolist(), len(words)]
        return [ids for x, y in zip(bounds, bounds[1:]) if y > x for ids in self._contracted(words[x:y])]

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        """``contract`` of words that one query takes."""
        data, offsets = string_buffers(pa.array(words, pa.large_binary()))
        sizes = np.diff(offsets)
        letters = pa.table({
            "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            "pos": np.arange(len(data), dtype=np.int64) - np.repeat(offsets[:-1], sizes),
            "token": self.single[data],
        })
        self.con.register("letters", letters)
        ids = self.con.sql(CONTRACT).to_arrow_table().column("ids").combine_chunks()
        self.con.unregister("letters")
        flat, ends = np.asarray(ids.values, dtype=np.int32), np.asarray(ids.offsets) * 4
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def joined(self, word: bytes) -> bytes:
        """Ids of a long word: of its pieces, with seams contracted anew until all neighbours belong together.

        A window around a seam takes some tokens of either side. Where its
        encoding begins and ends with the tokens that were there, the tokens
        before, in and after it are all encoded with their neighbours, and the
        seam is done. Windows of all seams are encoded at once. What fails is
        tried in order from the left, with a window that reaches to the end of
        its right piece and, doubled until its first token stays, into what
        is already joined.
        """
        pieces = [np.frombuffer(x, np.int32).tolist() for x in self._contracted_all([word[i : i + PIECE] for i in range(0, len(word), PIECE)])]
        windows = [left[-SEAM:] + right[:SEAM] for left, right in zip(pieces, pieces[1:])]
        tried = self._contracted_all([self.bytes_of(w) for w in windows])
        done = pieces[0]
        began = 0  # tokens before this one belong to an earlier piece than the last
        for right, old, raw in zip(pieces[1:], windows, tried):
            new, n_right = np.frombuffer(raw, np.int32).tolist(), min(SEAM, len(right))
            n_left = len(old) - n_right
            if len(done) - began >= n_left and done[len(done) - n_left :] == old[:n_left] and new[0] == old[0] and new[-1] == old[-1]:
                done = done[: len(done) - n_left]
                began = len(done)
                done += new + right[n_right:]
                continue
            width = SEAM
            while True:
                taken = done[-width:]
                new = np.frombuffer(self._contracted([self.bytes_of(taken + right)])[0], np.int32).tolist()
                if new[0] == taken[0] or width >= len(done):
                    break
                width *= 2
            began = max(len(done) - len(taken), 0)
            del done[began:]
            done += new
        return np.array(done, np.int32).tobytes()

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts, and the n+1 offsets of each text's ids."""
        tokens, rows = pretokens.split(texts)
        if not len(tokens):
            return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
        coded = tokens.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.whole and w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {}
            new = [w for w in words if w not in self.whole]
        if new:
            self.known.update(zip(new, self.contract(new)))
        each = pa.array([self.whole.get(w) or self.known[w] for w in words], pa.large_binary())
        stream, ends = string_buffers(pc.take(each, coded.indices))
        return np.ascontiguousarray(stream).view(np.int32), ends[rows] // 4

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> list[bytes]:
        """Bytes of each document; ``rows``: the n+1 offsets of the documents' ids."""
        sizes = np.diff(rows)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.con.register("positions", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int64), "id": ids.astype(np.int32)}))
        if unknown := self.con.execute("SELECT id FROM positions ANTI JOIN vocabulary USING (id) LIMIT 1").fetchone():
            raise ValueError(f"id {unknown[0]} is not in the vocabulary")
        found = self.con.sql(DECODE).to_arrow_table()
        self.con.unregister("positions")
        out = [b""] * len(sizes)
        for d, text in zip(found.column("doc").to_pylist(), found.column("hex").to_pylist()):
            out[d] = bytes.fromhex(text)
        return out


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, ranks_path: str, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The ``keep`` columns and ids (array of int): the tokens of each whole text."""
    plain = df.select(F.struct(*keep).alias("kept"), text_or_empty(text_column).alias("text"))

    def work(batches):
        own = codec(ranks_path)
        for batch in batches:
            kept, texts = batch.column("kept"), batch.column("text")
            for start, end in chunks(texts):
                ids, rows = own.encode(texts.slice(start, end - start))
                lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([kept.slice(start, end - start), lists], names=["kept", "ids"])

    kind = plain.schema["kept"].dataType.simpleString()
    return plain.mapInArrow(lean(work), f"kept {kind}, ids array<int>").select("kept.*", "ids")


def decode(df: DataFrame, ranks_path: str, keep: tuple[str, ...] = ("doc_id",), ids_column: str = "ids") -> DataFrame:
    """The ``keep`` columns and decoded (binary): the bytes that each row's ids stand for."""
    plain = df.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(ids_column), F.array().cast("array<int>")).alias("ids"))

    def work(batches):
        own = codec(ranks_path)
        for batch in batches:
            kept, lists = batch.column("kept"), batch.column("ids")
            rows = np.asarray(lists.offsets).astype(np.int64)
            ids, rows = np.asarray(lists.values)[rows[0] : rows[-1]], rows - rows[0]
            start = 0
            while start < len(lists):
                end = min(max(int(np.searchsorted(rows, rows[start] + DECODE_IDS, side="right")) - 1, start + 1), len(lists))
                texts = own.decode(ids[rows[start] : rows[end]], rows[start : end + 1] - rows[start])
                yield pa.RecordBatch.from_arrays([kept.slice(start, end - start), pa.array(texts, pa.binary())], names=["kept", "decoded"])
                start = end

    kind = plain.schema["kept"].dataType.simpleString()
    return plain.mapInArrow(lean(work), f"kept {kind}, decoded binary").select("kept.*", "decoded")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: digests of the ids of all documents and of what they decode to."""
    import public_tokenizers

    modest_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents"), path)
    digests = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "ids")
    return decode(digests, path, keep=("doc_id", "n_tokens", "ids_sha256")).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
