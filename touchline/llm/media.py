"""Media columns: lossless 8-bit PNG in binary columns, and hashes of their low frequencies.

``encode_png`` stores any bytes as a greyscale PNG of 64 samples a row;
``decode_png`` reads such a column back (chunk framing, CRC of every chunk,
zlib, unfiltering with numpy) and adds a 64-bit hash of the image's low
cosine frequencies. Both work row by row, so nothing is shuffled and a lost
executor costs only its own rows.

Nulls: a null text is the empty text, stored as 64 zero bytes; a null binary
value decodes to nulls. A damaged file gives a row with ``error`` set and no
samples, and the job goes on. Equal bytes give equal files and hashes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, modest_batches, text_or_empty

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of compressed data in one IDAT chunk.
IDAT_BYTES = 1 << 16
#: Image side before the cosine transform, and the side of the block that is kept.
SIDE, KEPT = 32, 8

_STEP = np.arange(SIDE)
_COSINES = np.cos(np.pi * (2 * _STEP[None, :] + 1) * np.arange(KEPT)[:, None] / (2 * SIDE))


def pad(payload: bytes, unit: int = WIDTH) -> bytes:
    """The payload with zero bytes up to a positive multiple of ``unit``."""
    size = max(unit, -(-len(payload) // unit) * unit)
    return payload.ljust(size, b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: bytes, level: int = 1) -> bytes:
    """A greyscale PNG of 64 columns; each row takes the filter (none, sub or up) with the smallest sum of absolute residues."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    left = np.zeros_like(image)
    left[:, 1:] = image[:, :-1]
    above = np.zeros_like(image)
    above[1:] = image[:-1]
    tried = np.stack([image, image - left, image - above])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    rows = np.empty((len(image), WIDTH + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = tried[best, np.arange(len(image))]
    packed = zlib.compress(rows.tobytes(), level)
    header = struct.pack(">IIBBBBB", WIDTH, len(image), 8, 0, 0, 0, 0)
    parts = [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *parts, _chunk(b"IEND", b"")])


def _paeth(line: np.ndarray, up: np.ndarray) -> np.ndarray:
    out, a, c = bytearray(len(line)), 0, 0
    for i, (x, b) in enumerate(zip(line.tolist(), up.tolist())):
        p = a + b - c
        pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        a = (x + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
        out[i], c = a, b
    return np.frombuffer(bytes(out), np.uint8)


def _average(line: np.ndarray, up: np.ndarray) -> np.ndarray:
    out, a = bytearray(len(line)), 0
    for i, (x, b) in enumerate(zip(line.tolist(), up.tolist())):
        a = (x + ((a + b) >> 1)) & 255
        out[i] = a
    return np.frombuffer(bytes(out), np.uint8)


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples of filtered rows (one byte a pixel). Runs of one kind are undone at once."""
    out = np.empty_like(lines)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    above = np.zeros(lines.shape[1], np.uint8)
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(lines)]):
        kind, part = int(kinds[start]), lines[start:end]
        if kind == 0:
            out[start:end] = part
        elif kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[start:end])
        elif kind == 2:
            np.cumsum(part, axis=0, dtype=np.uint8, out=out[start:end])
            out[start:end] += above
        elif kind in (3, 4):
            for i in range(start, end):
                out[i] = (_average if kind == 3 else _paeth)(lines[i], out[i - 1] if i else above)
        else:
            raise ValueError(f"filter {kind} is unknown")
        above = out[end - 1]
    return out


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale PNG without interlace; ValueError where the file is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4:
            raise ValueError("a chunk is cut off")
        if struct.unpack(">I", check)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise ValueError("a chunk is missing")
    width, height, depth, colour, _, _, interlace = header
    if (depth, colour, interlace) != (8, 0, 0) or not width or not height:
        raise ValueError("only 8-bit greyscale without interlace is read")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as error:
        raise ValueError(str(error)) from error
    if len(raw) != height * (width + 1):
        raise ValueError("the image has another size")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits of an image: which of its 8 x 8 lowest cosine frequencies lie above their median (the constant one left out)."""
    height, width = image.shape
    rows = np.linspace(0, height, SIDE + 1).astype(np.int64)
    cols = np.linspace(0, width, SIDE + 1).astype(np.int64)
    rows_to, cols_to = np.maximum(rows[1:], rows[:-1] + 1), np.maximum(cols[1:], cols[:-1] + 1)
    total = np.zeros((height + 1, width + 1), np.int64)
    total[1:, 1:] = image.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    block = total[rows_to][:, cols_to] - total[rows_to][:, cols[:-1]] - total[rows[:-1]][:, cols_to] + total[rows[:-1]][:, cols[:-1]]
    small = block / ((rows_to - rows[:-1])[:, None] * (cols_to - cols[:-1])[None, :])
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_png(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", level: int = 1) -> DataFrame:
    """(id, n_bytes, media): each row's text as UTF-8, padded and stored as PNG."""
    plain = df.select(F.col(id_column).alias("id"), text_or_empty(text_column).cast("binary").alias("payload"))

    def work(batches):
        for batch in batches:
            payloads = batch.column("payload")
            media = pa.array((write_png(pad(x.as_py()), level) for x in payloads), pa.binary())
            sizes = pa.array((len(x.as_buffer()) for x in payloads), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, media], names=["id", "n_bytes", "media"])

    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(lean(work), f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_column)


def decode_png(df: DataFrame, keep: tuple[str, ...], media_column: str = "media") -> DataFrame:
    """The ``keep`` columns, and samples (binary), feature (8 bytes, binary) and error (null if the file is sound)."""
    plain = df.select(F.struct(*keep).alias("kept"), F.col(media_column).alias("media"))
    kept = plain.schema["kept"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            samples, features, errors = [], [], []
            for cell in batch.column("media"):
                data = cell.as_py()
                try:
                    image = read_png(data) if data is not None else None
                    samples.append(None if image is None else image.tobytes())
                    features.append(None if image is None else cosine_hash(image))
                    errors.append(None)
                except ValueError as error:
                    samples.append(None)
                    features.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), batch.column("media"), pa.array(samples, pa.binary()), pa.array(features, pa.binary()), pa.array(errors, pa.string())],
                names=["kept", "media", "samples", "feature", "error"],
            )

    return plain.mapInArrow(lean(work), f"kept {kept}, media binary, samples binary, feature binary, error string").select("kept.*", F.col("media").alias(media_column), "samples", "feature", "error")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: digests of what the stored PNG files give back, for all documents."""
    from .common import table

    modest_batches(spark)
    stored = encode_png(table(spark, sf_dir, "documents"))
    read = decode_png(stored, keep=("doc_id", "n_bytes"))
    tail = F.substring("samples", -64, 64)
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"),
        "error",
    )
