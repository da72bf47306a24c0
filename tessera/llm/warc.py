"""WARC archives: a deduplicating writer and a salvage reader.

write_archives() turns pages into gzip members, one record each, in files of about ``FILE_BYTES``. Of records with
equal payloads of at least ``least`` bytes, that with the smallest page_id is a response; the others are revisits that
refer to it. read_archives() reads any archive, compressed by member or plain. Where a check fails (gzip CRC, version
line, header, length, digest), it searches for the next valid gzip member or version line, goes on with the records
from there, and logs the bytes between as a quarantined gap.

Defined cases: null html is an empty payload; a null url has no target header; rows with a null page_id are never what
others refer to, and if no copy has a page_id all are responses; rows repeated with the smallest page_id are all
responses; an empty table gives no archive and no records; further columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import new_path, store, write_file
from tessera.operators.components import lookup

_log = logging.getLogger(__name__)

FILE_BYTES = 32 << 20
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the payload's length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    own = "none" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{own}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Damage(ValueError):
    pass


_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_RECORD_END = re.compile(rb"\r?\n\r?\n")
_MAGIC = b"\x1f\x8b\x08"
#: Bytes that one gzip member may hold; a longer one is taken for damage, so that no archive can fill a worker's memory.
MEMBER_BYTES = 1 << 30


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record at a version line, and where it ends."""
    m = _VERSION.match(data, at)
    if not m:
        raise Damage("no version line")
    closed = _HEAD_END.search(data, m.end() - 1)
    if not closed:
        raise Damage("header without end")
    headers, name = {}, ""
    for line in re.split(rb"\r?\n", data[m.end() : closed.start()]):
        if line[:1] in (b" ", b"\t") and name:  # a folded line goes on with the value before it
            headers[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        head, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without colon")
        name = head.strip().lower().decode("utf-8", "replace")
        headers[name] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise Damage("no length")
    start, length = closed.end(), int(headers["content-length"])
    block = data[start : start + length]
    if len(block) < length:
        raise Damage("block cut short")
    tail = _RECORD_END.match(data, start + length)
    if not tail:
        raise Damage("no record end")
    told = headers.get("warc-block-digest")
    if told and told != "sha1:" + digest(block):
        raise Damage("block digest differs")
    return Record(at, headers, block), tail.end()


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    z, out, view, step, size = zlib.decompressobj(31), [], memoryview(data), 4096, 0
    try:
        while not z.eof and at < len(data):  # by small steps, as zlib copies what it is given beyond a member's end
            out.append(z.decompress(view[at : at + step], MEMBER_BYTES + 1 - size))
            size += len(out[-1])
            if size > MEMBER_BYTES:
                raise Damage("gzip member over the bound")
            at, step = at + step, min(2 * step, 1 << 20)
    except zlib.error as e:
        raise Damage(f"gzip: {e}") from None
    if not z.eof:
        raise Damage("gzip member cut short")
    return b"".join(out), min(at, len(data)) - len(z.unused_data)


def _records_of(data: bytes, base: int | None) -> Iterator[Record | Gap]:
    """Records of plain WARC bytes; base: the offset to tell for all of them, or None for their own."""
    at = 0
    while at < len(data):
        try:
            found, end = _parse(data, at)
            if base is not None:
                found.offset = base
            yield found
            at = end
        except Damage as e:
            m = _VERSION.search(data, at + 1)
            end = m.start() if m else len(data)
            yield Gap(at if base is None else base, end - at, str(e))
            at = end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Every record that can be recovered from an archive, in order, and every gap between them."""
    at = 0
    while at < len(data):
        if data.startswith(_MAGIC, at):
            try:
                inner, end = _member(data, at)
            except Damage as e:
                reason = str(e)
            else:
                yield from _records_of(inner, at)
                at = end
                continue
        else:
            m = _VERSION.match(data, at)
            if m:
                try:
                    found, end = _parse(data, at)
                except Damage as e:
                    reason = str(e)
                else:
                    yield found
                    at = end
                    continue
            else:
                reason = "neither gzip member nor version line"
        start = at
        while True:
            magic = data.find(_MAGIC, at + 1)
            line = _VERSION.search(data, at + 1, magic if magic >= 0 else len(data))
            at = line.start() if line else magic
            if at < 0:
                at = len(data)
                break
            try:
                _parse(data, at) if line else _member(data, at)
                break
            except Damage:
                continue
        yield Gap(start, at - start, reason)


def payload_of(found: Record) -> tuple[int, str, bytes | None]:
    """Length and digest of the full payload, and the payload itself unless the record is a revisit."""
    head, _, body = found.block.partition(b"\r\n\r\n")
    told = found.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if found.headers.get("warc-type") == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
        return int(m[1]) if m else 0, told, None
    own = digest(body)
    if told and told != own:
        raise Damage("payload digest differs")
    return len(body), own, body


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: null for responses, else the page whose payload it repeats.

    Payloads stay where they are: only digests that repeat are looked up, by pages split by salt where one is hot.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("_key"))
    repeated = keyed.groupBy("_key").agg(F.count("*").alias("_n"), F.min("page_id").alias("_first")).filter("_n > 1 and _first is not null")
    repeated = store(repeated, "repeated")
    keyed = lookup(keyed, "_key", repeated.drop("_n"), repeated.agg(F.max("_n")).first()[0] or 0, "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.octet_length("payload") >= least)
    return keyed.select("page_id", "url", "payload", F.when(again, F.col("_first")).alias("refers_to"))


def _writer(path: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, out, rows = TaskContext.get().partitionId(), 0, bytearray(), 0

        def close() -> pa.RecordBatch:
            nonlocal k, out, rows
            at = f"{path}/part-{part:06d}-{k:04d}.warc.gz"
            write_file(at, bytes(out))
            told = pa.RecordBatch.from_pydict({"path": [at], "bytes": [len(out)], "records": [rows]})
            k, out, rows = k + 1, bytearray(), 0
            return told

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(n) for n in ("page_id", "url", "payload", "refers_to")), strict=True):
                first = refers_to.as_py()
                out += member(record("response" if first is None else "revisit", page_id.as_py(), url.as_py(), payload.as_py(), first))
                rows += 1
                if len(out) >= file_bytes:
                    yield close()
        if rows:
            yield close()

    return write


def write_archives(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages below path; path, bytes, records of every file.

    A task's rows are sorted and its file names follow its partition, so a repeated task writes the same files again,
    each by an atomic rename.
    """
    rows = roles(pages, least).sortWithinPartitions("page_id", "refers_to", "payload")
    return store(rows.mapInArrow(_writer(path, file_bytes), "path string, bytes long, records long"), "warc-manifest")


_READ = "path string, offset long, length long, reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{_ID}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _READ.split(", ")])
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows, held = [], 0
            for x in salvage(content.as_py()):
                row = dict.fromkeys(names) | {"path": path.as_py(), "offset": x.offset}
                try:
                    if isinstance(x, Gap):
                        row |= {"length": x.length, "reason": x.reason}
                    else:
                        size, sha, body = payload_of(x)
                        h = x.headers
                        row |= {"page_id": _page(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": h.get("warc-type"), "payload_bytes": size, "payload_digest": sha, "refers_to": _page(h.get("warc-refers-to")), "payload": body}
                        held += size
                except Damage as e:
                    row |= {"length": len(x.block), "reason": str(e)}
                rows.append(row)
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives below path. A gap has a reason and a length, and no record_type."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(_reader, _READ)


def quarantined(records: DataFrame, path: str) -> int:
    """Write the gaps among what read_archives() found to a table beside the archives, and log how many there are."""
    gaps = records.filter("record_type is null").select("path", "offset", "length", "reason")
    gaps.write.mode("overwrite").parquet(f"{path}-quarantine")
    n = records.sparkSession.read.parquet(f"{path}-quarantine").count()
    if n:
        _log.warning("%d gaps in archives below %s are told in %s-quarantine", n, path, path)
    return n


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from archives.

    What was read is held against the manifest: gaps go to a quarantine table, and missing records are an error.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    manifest = write_archives(pages, path)
    wanted = manifest.agg(F.sum("records")).first()[0]
    if not wanted:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = store(read_archives(spark, path).drop("payload"), "warc-records")
    gaps, got = quarantined(found, path), found.filter("record_type is not null").count()
    if gaps or got != wanted:
        raise ValueError(f"{got} of {wanted} records were read back; {gaps} gaps are told in {path}-quarantine")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
