"""Zstandard web archives: one frame per record, dictionary in the leading frame.

An archive is one ``.warc.zst`` byte string.  Its first frame is a skippable frame
(magic 0x184D2A5D) that holds the dictionary -- itself a Zstandard frame, or raw --
and every further frame is exactly one record, compressed with that dictionary.
Archives travel as rows ``(path, content)``, the shape of Spark's ``binaryFile``
source, so ``read_archives(spark.read.format("binaryFile").load(...))`` reads files
of other writers and any file system Spark reaches works.

The reader walks the frames by their headers and decodes one at a time, so memory
is one archive plus one record.  It validates every record: version line, header
syntax, mandatory headers, ``Content-Length`` against the block, the closing blank
lines, the HTTP ``Content-Length`` against the payload and the SHA-1 payload digest.
A broken record raises ``ArchiveError`` (``strict``) or becomes a row with ``error``.

Defined results: a null payload is empty, a null URL leaves the target header out,
a null page id stays null; repeated rows are written one by one (rows that share the
largest id are all responses); an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlake.llm.tables import cut, table

#: Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES, DICTIONARY_RECORDS = 16 << 10, 200
DATE = "2024-01-01T00:00:00Z"


class ArchiveError(ValueError):
    pass


# ---------------------------------------------------------------- writing


def _record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _header_value(text: str) -> str:
    return "".join(f"%{b:02X}" if b < 33 or b > 126 else chr(b) for b in text.encode("utf-8")) \
        if any(c.isspace() or not c.isprintable() or ord(c) > 126 for c in text) else text


def encode_record(page_id, url, payload: bytes, n_bytes: int, digest: str, refers_to) -> bytes:
    """A response with its payload, or a revisit (headers only) of ``refers_to``."""
    revisit = refers_to is not None
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
             ).encode() + (b"" if revisit else payload)
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
            f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response",
            "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()]
    if url is not None:
        head.append("WARC-Target-URI: " + _header_value(url))
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {SAME_PAYLOAD}"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def encode_archive(records: list[bytes], level: int = 3) -> bytes:
    """Dictionary frame, then a frame per record.  The dictionary is trained on the
    first ``DICTIONARY_RECORDS`` records; where there is too little to train on, it is
    the raw head of the first record."""
    sample = records[:DICTIONARY_RECORDS]
    try:
        words = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:DICTIONARY_BYTES] for r in sample]).as_bytes()
    except zstandard.ZstdError:
        words = sample[0][:1024]
    packed = zstandard.ZstdCompressor(level=level).compress(words)
    writer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words),
                                      write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed,
                     *[writer.compress(r) for r in records]])


# ---------------------------------------------------------------- reading


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the frame at ``at``, from its header and its block headers."""
    if len(data) - at < 8:
        raise ArchiveError(f"truncated frame at {at}")
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == FRAME_MAGIC:
        descriptor = data[at + 4]
        p = at + zstandard.frame_header_size(data[at:at + 18])
        last = 0
        while not last:
            if p + 3 > len(data):
                raise ArchiveError(f"truncated frame at {at}")
            header = int.from_bytes(data[p:p + 3], "little")
            last, kind, size = header & 1, header >> 1 & 3, header >> 3
            if kind == 3:
                raise ArchiveError(f"bad block in the frame at {at}")
            p += 3 + (1 if kind == 1 else size)
        end = p + (4 if descriptor & 4 else 0)
    else:
        raise ArchiveError(f"no frame at {at}")
    if end > len(data):
        raise ArchiveError(f"truncated frame at {at}")
    return end - at


def decode_frames(content: bytes):
    """The records of an archive, one frame at a time."""
    data, at = memoryview(content), 0
    reader = zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data, 0)[0] == DICTIONARY_MAGIC:
        at = frame_length(data, 0)
        words = bytes(data[8:at])
        if words[:4] == struct.pack("<I", FRAME_MAGIC):
            words = reader.decompressobj().decompress(words)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    while at < len(data):
        n = frame_length(data, at)
        if struct.unpack_from("<I", data, at)[0] == FRAME_MAGIC:  # other skippable frames carry no record
            try:
                yield reader.decompressobj().decompress(data[at:at + n])
            except zstandard.ZstdError as exc:
                raise ArchiveError(f"frame at {at}: {exc}") from exc
        at += n


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"bad header line {name[:40]!r}")
        out[name.lower()] = value.strip()
    return out


def _length(text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise ArchiveError("bad length")
    return int(text)


def _page(record_id: str | None):
    inner = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.lstrip("-").isdigit() else None


def parse_record(record: bytes) -> dict:
    """The validated fields of one record."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not blank or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError("no version line")
    fields = _headers(lines)
    for name in MANDATORY:
        if name.lower() not in fields:
            raise ArchiveError(f"no {name}")
    n = _length(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"block of {len(rest) - 4} bytes, Content-Length {n}")
    http, blank, payload = rest[:n].partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not blank or not status.startswith(b"HTTP/"):
        raise ArchiveError("no HTTP head")
    size = _length(_headers(lines).get("content-length", "x"))
    named = fields.get("warc-payload-digest", "")
    if not named.startswith("sha1:"):
        raise ArchiveError("no payload digest")
    digest = base64.b32decode(named[5:]).hex()
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != size:
            raise ArchiveError(f"payload of {len(payload)} bytes, HTTP length {size}")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ArchiveError("payload digest differs")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ArchiveError(f"bad {kind} record")
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
            "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": _page(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


# ---------------------------------------------------------------- on Spark

ARCHIVE_SCHEMA = "path string, content binary"
RECORD_SCHEMA = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, "
                 "record_type string, refers_to bigint, payload binary, path string, error string")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
                 min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Every page with its payload digest and, for a revisit, the response's id.

    Owners of payloads are one grouped maximum (combined before the shuffle); the
    join back carries no payload, and adaptive execution can split a digest that
    many pages share."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"),
                        F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("bigint"))
    owners = (rows.where(F.col("n") >= min_bytes).groupBy("digest", "n")
                  .agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("c")).where("c > 1")
                  .select("digest", "n", "owner"))
    return (rows.join(owners, ["digest", "n"], "left")
                .withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("owner")), F.col("owner")))
                .drop("owner"))


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``(path, content)`` archives of about ``archive_bytes`` of payload each."""

    def pack(batches):
        held, size, made = [], 0, 0

        def flush():
            content = encode_archive(held)
            name = f"{hashlib.sha1(content).hexdigest()[:16]}.warc.zst"
            return pa.RecordBatch.from_pydict({"path": pa.array([name]), "content": pa.array([content], pa.binary())})

        for batch in batches:
            for page, url, payload, n, digest, owner in zip(
                    *[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "n", "digest", "refers_to")]):
                held.append(encode_record(page, url, payload, n, digest, owner))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield flush()

    return records.select("page_id", "url", "payload", "n", "digest", "refers_to").mapInArrow(pack, ARCHIVE_SCHEMA)


def read_archives(archives: DataFrame, strict: bool = True, with_payload: bool = True) -> DataFrame:
    """One row per record of ``archives(path, content)``."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def rows_of(path, content):
        try:
            for record in decode_frames(content):
                try:
                    yield parse_record(record) | {"path": path, "error": None}
                except (ArchiveError, ValueError) as exc:
                    if strict:
                        raise
                    yield {"path": path, "error": str(exc)}
        except ArchiveError as exc:
            if strict:
                raise
            yield {"path": path, "error": str(exc)}

    def unpack(batches):
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(),
                 pa.string(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r.get(c) if c != "payload" or with_payload else None for r in rows], t)
                 for c, t in zip(names, types)], names)

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                for row in rows_of(path, content.as_py()):
                    rows.append(row)
                    size += len(row.get("payload") or b"") if with_payload else 100
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("path", "content").mapInArrow(unpack, RECORD_SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut(write_archives(plan_records(table(spark, sf_dir, "pages"))), "warc")
    return read_archives(archives, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
o AS (SELECT h, max(page_id) AS owner FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN page_id < owner OR (page_id IS NULL AND owner IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < owner OR page_id IS NULL THEN owner END AS refers_to
FROM p LEFT JOIN o ON p.h = o.h
"""
