"""WARC records in Zstandard archives: a writer for Spark rows, and the archive reader.

An archive is one skippable frame that holds the dictionary, then one frame per
record. A record is a WARC/1.1 header block, an empty line, the content block
and two line ends. Pages become ``response`` records (an HTTP header block and
the payload) or, where another record holds an equal payload, ``revisit``
records (the HTTP header block alone, with the digest and the record it refers
to).

Archives are files that any reader of Zstandard frames can open. Spark writes them
through its own commit protocol into the shared folder, one row a file, as text whose
line separator is an empty skippable frame; so a lost executor's files are written
again, and none is half there. The reader takes ``binaryFile`` rows ``(path,
content)``: it loads the
dictionary, decodes a frame at a time and validates versions, mandatory headers,
content lengths, payload lengths and digests; a record that fails, or is larger than
``max_record_bytes`` when decoded, is returned
with ``valid = false`` and the reason instead of ending the job. An archive of few
or small records has nothing to learn a dictionary from: its leading frame is empty.

Copies are told apart by SHA-1 with a partial aggregation (the
largest id for each digest, of rows with one id the last written) and an equi-join,
so a digest that a third of the
rows share costs no more than any other. Null payloads are empty. Rows with a
null id are records as well, the response of others only if no copy has an id.
Rows that repeat an id are records of their own: a record's id holds the page's id
and the row's number, so no two are alike. Columns besides the three that are named
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 4 << 20
SAMPLE_BYTES = 512 << 10
DICTIONARY_BYTES = 16 << 10
LEVEL = 3
FEED_BYTES = 16 << 10
MIN_REVISIT_BYTES = 0
MAX_RECORD_BYTES = 256 << 20
#: An empty skippable frame, in characters that are their own bytes.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
SUFFIX = ".warc.zst"
ID_PREFIX = "urn:tessera:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() else "%" + format(ord(c), "02X") for c in value)


def record_bytes(ident: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(records: list[bytes]) -> bytes:
    """The dictionary frame and a frame for each record. Few or small records get an empty dictionary frame."""
    sample, size = [], 0
    for r in records:
        sample.append(r[: SAMPLE_BYTES // 8])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    raw = b""
    if len(sample) >= 16 and size >= 8 * DICTIONARY_BYTES:
        try:
            raw = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
        except zstandard.ZstdError:  # samples too alike to learn from
            raw = b""
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}))
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(packer.compress, records)])


class ArchiveError(ValueError):
    """The archive cannot be read on."""


def read_frames(content: bytes, most: int = MAX_RECORD_BYTES) -> Iterator[bytes | None]:
    """The decoded records of an archive, one frame at a time; None for one of more than ``most`` bytes, which is never held."""
    view, at = memoryview(content), 0
    unpacker = zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise ArchiveError("truncated frame header")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            body = bytes(view[at + 8 : at + 8 + size])
            if len(body) != size:
                raise ArchiveError("truncated skippable frame")
            if at == 0 and magic == DICTIONARY_MAGIC and body:
                if body[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary itself may be compressed
                    body = zstandard.ZstdDecompressor().decompress(body)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ArchiveError(f"no frame at byte {at}")
        reader, parts, held, began = unpacker.decompressobj(), [], 0, at
        while not reader.eof:
            piece = view[at : at + FEED_BYTES]
            if not len(piece):
                raise ArchiveError("truncated frame")
            try:
                part = reader.decompress(piece)
            except zstandard.ZstdError as error:
                raise ArchiveError(f"frame at byte {began}: {error}") from error
            at += len(piece)
            held += len(part)
            if held <= most:
                parts.append(part)
            else:
                parts.clear()
        at -= len(reader.unused_data)
        yield b"".join(parts) if held <= most else None


def parse_record(raw: bytes) -> dict:
    """The fields of a record; ``error`` is None if it is sound."""
    out = {"record_id": None, "record_type": None, "target_uri": None, "refers_to": None, "payload_bytes": None, "payload_digest": None, "payload": None, "error": None}
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        return out | {"error": "no WARC header"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return out | {"error": "malformed header line"}
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if n not in fields]
    out |= {"record_id": fields.get("warc-record-id", "").strip("<>") or None, "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None}
    if missing:
        return out | {"error": f"without {missing[0]}"}
    if not fields["content-length"].isdigit() or len(rest) != (size := int(fields["content-length"])) + 4 or rest[size:] != b"\r\n\r\n":
        return out | {"error": "content length"}
    block = rest[:size]
    if (said := fields.get("warc-block-digest")) and said != f"sha1:{base32_sha1(block)}":
        return out | {"error": "block digest"}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    out["payload_digest"] = digest
    if out["record_type"] not in ("response", "revisit"):
        return out | {"payload": block, "payload_bytes": len(block)}
    http, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/"):
        return out | {"error": "no HTTP header"}
    length = next((line.split(b":", 1)[1].strip() for line in http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")), b"")
    if not length.isdigit():
        return out | {"error": "HTTP content length"}
    out["payload_bytes"] = int(length)
    if out["record_type"] == "revisit":
        return out | ({"error": "revisit with a payload"} if payload else {"error": "refers to nothing"} if not out["refers_to"] else {})
    out["payload"] = payload
    if len(payload) != int(length):
        return out | {"error": "payload length"}
    if digest and digest != base32_sha1(payload):
        return out | {"error": "payload digest"}
    return out


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int]]:
    """(archive, records) of rows (ident, url, payload, digest, refers_to), each of about ARCHIVE_BYTES of records."""
    held, size = [], 0
    for batch in batches:
        columns = [batch.column(k) for k in range(5)]
        for k in range(len(batch)):
            ident, url, payload, digest, refers = (c[k].as_py() for c in columns)
            payload = (payload or "").encode()
            held.append(record_bytes(ident, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield write_archive(held), len(held)
                held, size = [], 0
    if held:
        yield write_archive(held), len(held)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for content, _ in _archives(batches):
        yield pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.zst"]), pa.array([content], pa.binary())], ["path", "content"])


RECORDS = "path string, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, valid boolean, error string"


def _reader(with_payload: bool, max_record_bytes: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "valid", "error"]
        types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.string()]

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        blank = parse_record(b"")
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                try:
                    for raw in read_frames(content.as_buffer().to_pybytes(), max_record_bytes) if content.is_valid else ():
                        row = parse_record(raw) if raw is not None else blank | {"error": "larger than max_record_bytes"}
                        rows.append(row | {"path": path, "valid": row["error"] is None} | ({} if with_payload else {"payload": None}))
                        size += len(raw or b"") if with_payload else 256
                        if size > 8 << 20:
                            yield out(rows)
                            rows, size = [], 0
                except ArchiveError as error:
                    rows.append(blank | {"path": path, "valid": False, "error": str(error)})
                if rows:
                    yield out(rows)

    return read


def read_archives(archives: DataFrame, with_payload: bool = True, max_record_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """A row for each record of ``archives`` (path, content), as from ``spark.read.format('binaryFile')``."""
    ship(archives.sparkSession)
    return archives.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(_reader(with_payload, max_record_bytes), RECORDS)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(path, content)`` rows, each an archive, that hold a record for each row of ``pages``."""
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "warc-rows")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    # Written with its number, which has to be the same for the choice of responses and for the records.
    rows = scratch.cut(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    last = F.max(F.struct("page_id", "row")).alias("response")
    first = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy(F.col("digest").alias("of")).agg(last, F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = scratch.cut(first.drop("copies"), "first")  # so that Spark can split a digest with very many rows in the join
    keyed = rows.join(first, F.col("digest") == F.col("of"), "left")
    ident = lambda page, row: F.concat(F.lit(ID_PREFIX), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"))
    revisits = F.col("response").isNotNull() & (F.col("row") != F.col("response.row"))
    records = keyed.select(ident(F.col("page_id"), F.col("row")).alias("ident"), "url", "html", "digest", F.when(revisits, ident(F.col("response.page_id"), F.col("response.row"))).alias("refers_to"))
    return records.mapInArrow(_pack, "path string, content binary")


def save_archives(archives: DataFrame, folder: str) -> None:
    """Write each of ``archives`` (path, content) as a file of its own into ``folder``, named part-...{SUFFIX}.

    The names are given by the driver when all is written: a call of the file system a file, no data moves.
    """
    spark = archives.sparkSession
    archives.select(F.col("content").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(at):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(at, name.removesuffix(".txt") + SUFFIX))


def open_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of the archives in ``folder``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", "content")


def page_of(record_id: Column) -> Column:
    """The page's id in a record's id."""
    return F.regexp_extract(record_id, f"^{ID_PREFIX}(-?[0-9]+|none):", 1).try_cast("long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives of ``pages`` to the shared folder, and read every record back from there."""
    spark = pages.sparkSession
    folder = Scratch(spark, "warc").folder("archives")
    save_archives(write_archives(pages, id_col, url_col, html_col), folder)
    return read_archives(open_archives(spark, folder), with_payload=False)
