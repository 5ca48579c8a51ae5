"""Helpers that every module of this subpackage shares.

Words are maximal runs of bytes other than space and 0x09-0x0D; that is also
right for UTF-8, whose multi-byte sequences never hold such a byte.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Bytes of text that one step inside a task handles at a time.
CHUNK_BYTES = 4 << 20

#: Bytes of an Arrow batch, about, and Spark's setting for them.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds each Arrow batch of this session by bytes, and so what a Python worker holds however long the rows are (a longer row stands alone)."""
    if (spark.conf.get(BATCH_SETTING, None) or "").isdigit() and 0 < int(spark.conf.get(BATCH_SETTING)) <= most:
        return
    spark.conf.set(BATCH_SETTING, str(most))


def _release() -> None:
    """Gives back to the system what this process holds but does not use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(work):
    """``work`` over a partition's Arrow batches, after which the worker gives its free memory back: Spark keeps idle workers, and several stages' workers share an executor."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            _release()

    return run


def text_or_empty(column: str | Column) -> Column:
    """The column as a string, a null as the empty string."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def in_group(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves this remainder (a null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names that folder in spark.checkpoint.dir. Where it is unset
    (tests on one machine), a folder below the warehouse serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-steps"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition_columns: str) -> DataFrame:
    """The rows written to the shared folder and read back: cuts the lineage."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_columns) if partition_columns else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an array of texts and the n+1 offsets of its rows (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES):
    """(first row, end row) of runs of rows of about so many bytes; a longer text stands alone."""
    _, offsets = string_buffers(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end
        start = end


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of these texts in one binary array, and the n+1 offsets of each text's words in it."""
    data, rows = string_buffers(texts)
    if lower:
        data = _LOWER[data]
    word = ~_IS_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = rows[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] |= word[inner]  # a text's first byte never continues the text before it
    at = np.flatnonzero(begins)
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(word, out=kept[1:])
    offsets = np.append(kept[at], kept[-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[word]))])
    return words, np.searchsorted(at, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words; each distinct word is hashed once."""
    import xxhash

    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)]
