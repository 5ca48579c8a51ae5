"""WARC: archives of one gzip member per record, written and read sequentially.

``assign_types`` finds for each page whether its payload was seen under a
smaller id. ``write_archives`` packs records into archives of bounded size in a
binary column; ``read_archives`` walks such a column (or what
``spark.read.format("binaryFile")`` gives for real ``.warc.gz`` files) member
by member: incremental zlib, content-length framing, digest verification.

Nulls: a null payload is the empty payload; a null id is a page of its own and
never the one that others refer to. Rows with equal ids and payloads are all
responses if their id is the smallest. A damaged archive gives one row with
``error`` set where reading stopped; the records before it are kept.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, modest_batches, stored, table, text_or_empty

#: Compressed bytes after which a writer begins another archive.
ARCHIVE_BYTES = 4 << 20
#: Bytes that the reader hands to zlib at a time.
READ_BYTES = 1 << 16
#: Bytes within which a record's head must end.
HEAD_BYTES = 1 << 20
#: A payload of fewer bytes is always stored in full.
REVISIT_FROM_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = "archive string, record_offset bigint, record_type string, page_id bigint, uri string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def assign_types(pages: DataFrame, id_column: str = "page_id", text_column: str = "html", uri_column: str = "url", least: int = REVISIT_FROM_BYTES) -> DataFrame:
    """(page_id, uri, payload, refers_to): refers_to is the smallest id with an equal payload, null where that is the page itself.

    Ids of repeated payloads are found by a pre-aggregated group on (SHA-1,
    length), so a payload that a third of the pages share is summed up before
    the shuffle; the join back is one that AQE may split.
    """
    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.coalesce(F.col(uri_column).cast("string"), F.lit("")).alias("uri"), text_or_empty(text_column).cast("binary").alias("payload"))
    key = [F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")]
    named = rows.select("*", *key)
    firsts = (
        named.select("page_id", "sha", "size").where(F.col("size") >= least)
        .groupBy("sha", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .select("sha", "size", "first_id")
    )
    return named.join(firsts, ["sha", "size"], "left").select("page_id", "uri", "payload", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"))


def _uri(text: str) -> str:
    return "".join(text.split()) or "about:blank"


def record(page_id: int | None, uri: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header alone, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", _uri(uri)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def write_archives(typed: DataFrame, most: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): archives of about ``most`` compressed bytes, each from the rows of one task."""

    def work(batches):
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "uri", "payload", "refers_to")]
            for i in range(batch.num_rows):
                held.append(record(*(c[i].as_py() for c in columns)))
                size += len(held[-1])
                if size >= most:
                    yield archive()
                    number, held, size = number + 1, [], 0
        if held:
            yield archive()

    return typed.select("page_id", "uri", "payload", "refers_to").mapInArrow(lean(work), "archive string, content binary")


def _whole_size(seen: bytes) -> int | None:
    """Bytes of the record that begins so, by its Content-Length; None while its head has not ended."""
    end = seen.find(b"\r\n\r\n")
    if end < 0:
        if len(seen) > HEAD_BYTES:
            raise ValueError("a record's head does not end")
        return None
    size = _fields(bytes(seen[:end])).get("content-length", "")
    if not size.isdigit():
        raise ValueError("the content length differs")
    return end + 4 + int(size) + 4


def members(data: bytes):
    """(offset, bytes) of each gzip member, inflated piece by piece up to the record's stated length; ValueError on damage.

    A member that inflates to more than its head says is damage, found before
    the rest is inflated.
    """
    view, at = memoryview(data), 0
    while at < len(data):
        inflater, found, start, size, piece = zlib.decompressobj(31), bytearray(), at, None, b""
        while not inflater.eof:
            if not piece:
                piece = view[at : at + READ_BYTES]
                at += len(piece)
            try:
                got = inflater.decompress(piece, READ_BYTES)
            except zlib.error as error:
                raise ValueError(str(error)) from error
            if not (got or inflater.eof or len(piece)):
                raise ValueError("a member is cut off")
            found += got
            piece = inflater.unconsumed_tail
            size = _whole_size(found) if size is None else size
            if size is not None and len(found) > size:
                raise ValueError("the content length differs")
        at -= len(inflater.unused_data)
        yield start, bytes(found)


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def _page(field: str | None) -> int | None:
    digits = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def parse_record(member: bytes) -> dict:
    """The record's fields and payload; ValueError where framing or a digest fails."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[int(size) :] != b"\r\n\r\n":
        raise ValueError("the content length differs")
    block = rest[: int(size)]
    said = fields.get("warc-block-digest")
    if said and said != f"sha1:{base32_sha1(block)}":
        raise ValueError("the block's digest differs")
    kind, payload, length = fields.get("warc-type", ""), block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(_fields(http).get("content-length") or len(payload))
    digest = (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None
    if kind != "revisit":
        if length != len(payload):
            raise ValueError("the payload's length differs")
        if digest and digest != base32_sha1(payload):
            raise ValueError("the payload's digest differs")
    return {
        "record_type": kind, "page_id": _page(fields.get("warc-record-id")), "uri": fields.get("warc-target-uri"), "refers_to": _page(fields.get("warc-refers-to")),
        "payload_bytes": length, "payload_digest": digest, "payload": None if kind == "revisit" else payload, "error": None,
    }


def read_archives(archives: DataFrame, name_column: str = "archive", content_column: str = "content", with_payload: bool = True) -> DataFrame:
    """One row per record, as RECORD_SCHEMA, in the order of the archive; a revisit has no payload of its own."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def rows(name, content):
        at = 0
        try:
            for at, member in members(content or b""):
                yield {"archive": name, "record_offset": at, **parse_record(member)}
        except ValueError as error:
            yield {"archive": name, "record_offset": at, "error": str(error)}

    def work(batches):
        kinds = [("archive", pa.string()), ("record_offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())]
        schema = pa.schema(kinds)
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for row in rows(name.as_py(), content.as_py()):
                    size += len(row.get("payload") or b"") + 200
                    if not with_payload:
                        row["payload"] = None
                    held.append({k: row.get(k) for k in names})
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return archives.select(F.col(name_column).alias("archive"), F.col(content_column).alias("content")).mapInArrow(lean(work), RECORD_SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all pages written to archives in the shared folder, and their records as read back."""
    modest_batches(spark)
    archives = stored(write_archives(assign_types(table(spark, sf_dir, "pages"))))
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "record_offset", "error")
