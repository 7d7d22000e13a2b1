"""Legacy archive converter: ARC files to WARC records, WARC files written and read back.

An ARC file begins with a version block whose header line gives the file's version and field list; each
record has one header line (fields by version) with a declared length, then so many bytes. Conversion
synthesises what WARC asks for and ARC lacks: record ids, ISO timestamps, record types and payload
digests. Records with equal payloads become one response, the one with the smallest key, and revisits
of it; keys that are null come after all others, and rows that repeat the smallest key are responses too.

Null payloads are empty ones, null addresses 'urn:none'. Extra columns are not read. An empty table
gives no record. Very long payloads are one record each, held whole by the task that has it; files and batches end by
bytes as well as by number, so that long payloads don't add up in one. In an ARC file, a
line that is no header (too few fields, no number for a date or a length) is skipped up to the next that is,
a record that its declared length breaks off ends the file, and bytes without a version block hold no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import short_batches

#: The field names of an ARC record's header line by the file's version, in order (fixed values of the format).
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
DEFAULT_DATE = "20240101000000"
KEY_HEADER = "X-Archive-Key"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS_PER_ARCHIVE = 256
RECORDS_PER_FILE = 1000
#: Bytes of payloads about at which an ARC file or an Arrow batch ends, and a WARC file; one record may be larger.
BATCH_BYTES = 32 << 20
FILE_BYTES = 256 << 20
#: Bytes that are decompressed at a time.
STEP = 1 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD = "record_id string, key string, url string, date string, http_head binary, payload binary, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(value: str) -> str:
    return quote(value, safe="!#$&'()*+,/:;=?@[]%-._~") or "urn:none"


def write_arc(rows: Iterator[tuple[str | None, str | None, bytes]], version: int = 1) -> bytes:
    """An ARC file of (key, url, html) rows; each record holds an HTTP response whose head carries the key."""
    fields = " ".join(ARC_FIELDS[version])
    about = f"{version} 0 lociframe\n{fields}\n".encode()
    extra = " 200 - - 0 lociframe.arc" if version == 2 else ""
    out = [f"filedesc://lociframe.arc 0.0.0.0 {DEFAULT_DATE} text/plain{extra} {len(about)}\n".encode(), about]
    for key, url, html in rows:
        mark = f"{KEY_HEADER}: {quote(key)}\r\n" if key is not None else ""
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{mark}\r\n".encode() + html
        out += [f"\n{_name(url or '')} 0.0.0.0 {DEFAULT_DATE} text/html{extra} {len(block)}\n".encode(), block]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[dict]:
    """Each record's header fields by name and its block, under 'block'."""
    first, _, rest = data.partition(b"\n")
    length = first.rsplit(b" ", 1)[-1]
    if not first.startswith(b"filedesc:") or not length.isdigit():
        return
    about = rest[: int(length)].decode("utf-8", "replace").split("\n")
    version, names = about[0].split(" ")[0], tuple("".join(about[1:2]).split())
    if not {"URL", "Archive-date"} < set(names) or names[-1] != "Archive-length":
        names = ARC_FIELDS.get(int(version) if version.isdigit() else 1, ARC_FIELDS[1])
    at = len(first) + 1 + int(length)
    while (end := data.find(b"\n", at)) >= 0:
        values = data[at:end].decode("utf-8", "replace").strip("\r").split(" ")
        at = end + 1
        spare = len(values) - len(names)  # spaces in the address
        head = dict(zip(names, [" ".join(values[: spare + 1]), *values[spare + 1 :]], strict=True)) if spare >= 0 else {}
        if not (head and head["Archive-length"].isdigit() and re.fullmatch(r"\d{8,14}", head["Archive-date"])):
            continue
        length = int(head["Archive-length"])
        if at + length > len(data):
            return
        yield head | {"block": data[at : at + length]}
        at += length


def _head_value(head: bytes, name: str) -> str | None:
    found = re.search(rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*)", head.decode("utf-8", "replace"))
    return found[1] if found else None


def convert_record(record: dict) -> tuple:
    """The RECORD of an ARC record."""
    head, _, payload = record["block"].partition(b"\r\n\r\n")
    key = _head_value(head, KEY_HEADER)
    d = record["Archive-date"].ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    said = digest(payload)
    made = uuid.uuid5(_NAMESPACE, f"{key}\n{record['URL']}\n{date}\n{said}")
    return f"urn:uuid:{made}", unquote(key) if key is not None else None, record["URL"], date, head, payload, len(payload), said


def _spans(sizes: list[int], most: int, limit: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of at most `most` items that end once they hold limit bytes."""
    low = held = 0
    for k, size in enumerate(sizes):
        held += size
        if held >= limit or k + 1 - low == most:
            yield low, k + 1
            low, held = k + 1, 0
    if low < len(sizes):
        yield low, len(sizes)


def archives(pages: DataFrame, key_col: str, url_col: str, html_col: str, version: int = 1) -> DataFrame:
    """content: ARC files of the rows, ROWS_PER_ARCHIVE and about BATCH_BYTES at most in each."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for low, high in _spans(sizes, ROWS_PER_ARCHIVE, BATCH_BYTES):
                keys, urls, htmls = (c.to_pylist() for c in batch.slice(low, high - low).columns)
                yield pa.RecordBatch.from_pydict({"content": [write_arc(((k, u, (h or "").encode()) for k, u, h in zip(keys, urls, htmls, strict=True)), version)]})

    short_batches(pages.sparkSession)
    return pages.select(*[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate((key_col, url_col, html_col))]).mapInArrow(run, "content binary")


def convert(files: DataFrame, content_col: str = "content", payloads: bool = True) -> DataFrame:
    """The RECORD rows of ARC files' bytes; without payloads, http_head and payload are null."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(RECORD)
    schema = to_arrow_schema(fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for content in batch.column(0):
                rows = [convert_record(r) for r in read_arc(content.as_py() or b"")]
                if not payloads:
                    rows = [(*r[:4], None, None, *r[6:]) for r in rows]
                for low, high in _spans([len(r[5] or b"") for r in rows], len(rows), BATCH_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[low:high], strict=True), schema.types, strict=True)], schema=schema)

    return files.select(content_col).mapInArrow(run, fields)


def with_revisits(records: DataFrame, known: DataFrame | None = None, key_type: str = "bigint") -> DataFrame:
    """records with refers_to, refers_to_url and refers_to_date: of the response that a revisit refers to, else null.

    known may hold the same records without payloads, where these are cheaper to make.

    Equal payloads are known by digest and length. Only ids and digests are shuffled to find them, and
    one row a digest comes from each task, so a payload that fills the table makes no hot task."""
    slim = (records if known is None else known).select("record_id", F.col("key").cast(key_type).alias("k"), "url", "date", "payload_digest", "payload_bytes")
    order = F.struct(F.col("k").isNull().alias("no"), "k", "record_id", "url", "date")
    first = slim.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first != last").drop("last")
    again = slim.join(first, ["payload_digest", "payload_bytes"]).where("not (k <=> first.k)")
    again = again.groupBy("record_id").agg(F.min("first").alias("first"))  # repeated rows share a record id
    again = again.select("record_id", F.col("first.record_id").alias("refers_to"), F.col("first.url").alias("refers_to_url"), F.col("first.date").alias("refers_to_date"))
    return records.join(again, "record_id", "left")


def write_warc(records: DataFrame, path: str, largest: int | None = None, records_per_file: int = RECORDS_PER_FILE) -> None:
    """WARC/1.1 files, gzip-compressed, at path: a response, or where refers_to is set a revisit without payload.

    A block that isn't UTF-8 text is written in base64 and says so in its header. Files end by number of records, so payloads of
    over FILE_BYTES / records_per_file bytes go to files of their own, of as many as fit; largest is the most bytes of a payload,
    where the caller knows."""
    if largest is None:
        largest = records.agg(F.max("payload_bytes")).first()[0] or 0
    usual = FILE_BYTES // records_per_file
    if largest <= usual:
        return _write(records, path, records_per_file)
    _write(records.where(F.col("payload_bytes") <= usual), path, records_per_file)
    _write(records.where(F.col("payload_bytes") > usual), path, max(1, FILE_BYTES // largest))


def _write(records: DataFrame, path: str, records_per_file: int) -> None:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for low, high in _spans(pc.fill_null(pc.binary_length(batch.column("payload")), 0).to_pylist(), 256, BATCH_BYTES):
                yield pa.RecordBatch.from_pydict({"value": pa.array([_warc(r) for r in batch.slice(low, high - low).to_pylist()], pa.string())})

    done = records.select("record_id", "url", "date", "http_head", "payload", "payload_bytes", "payload_digest", "refers_to", "refers_to_url", "refers_to_date").mapInArrow(run, "value string")
    # a record ends with CR LF CR LF; the last LF is the text sink's line separator
    done.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).mode("append").text(path)


def _warc(r: dict) -> str:
    revisit = r["refers_to"] is not None
    block = (r["http_head"] or b"") + b"\r\n\r\n" + (b"" if revisit else r["payload"] or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}",
        f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"X-Payload-Length: {r['payload_bytes']}", "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{r['refers_to']}>", f"WARC-Refers-To-Target-URI: {r['refers_to_url']}", f"WARC-Refers-To-Date: {r['refers_to_date']}"]
    try:
        text = block.decode()
    except UnicodeDecodeError:
        text = base64.b64encode(block).decode()
        lines.append("X-Block-Encoding: base64")
    size = len(text.encode())
    return "\r\n".join([*lines, f"Content-Length: {size}", "", ""]) + text + "\r\n\r"


def inflated(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members that follow one another, STEP bytes at a time; a member that breaks off ends them."""
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            out = member.decompress(data, STEP)
            data = member.unconsumed_tail
            if not (out or data or member.eof):
                return
            yield out
        data = member.unused_data


def parse_warc(parts: Iterator[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Each record's header and block; what is held is one record and one part."""
    held = bytearray()

    def find(what: bytes, at: int) -> int:
        while (found := held.find(what, at)) < 0:
            if (more := next(parts, None)) is None:
                return -1
            held.extend(more)
        return found

    while (begin := find(b"WARC/1.", 0)) >= 0 and (end := find(b"\r\n\r\n", begin)) >= 0:
        head = dict(line.split(": ", 1) for line in held[begin:end].decode().split("\r\n")[1:])
        last = end + 4 + int(head["Content-Length"])
        while len(held) < last:
            if (more := next(parts, None)) is None:
                return
            held.extend(more)
        block = bytes(held[end + 4 : last])
        del held[:last]
        yield head, base64.b64decode(block) if head.get("X-Block-Encoding") == "base64" else block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files at path: record_id, record_type, key, url, date, payload (null for
    revisits), payload_bytes and payload_digest (of the full payload), refers_to_record."""
    schema = "record_id string, record_type string, key string, url string, date string, payload binary, payload_bytes long, payload_digest string, refers_to_record string"
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in schema.split(", ")]

    def row(head: dict, block: bytes) -> tuple:
        top, _, payload = block.partition(b"\r\n\r\n")
        key = _head_value(top, KEY_HEADER)
        plain = head["WARC-Type"] == "response"
        said = digest(payload) if plain else head["WARC-Payload-Digest"].removeprefix("sha1:")
        size = len(payload) if plain else int(head["X-Payload-Length"])
        return head["WARC-Record-ID"].strip("<>"), head["WARC-Type"], unquote(key) if key is not None else None, head["WARC-Target-URI"], head["WARC-Date"], payload if plain else None, size, said, head.get("WARC-Refers-To", "").strip("<>") or None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in parse_warc(inflated(content.as_py())):
                    rows.append(row(head, block))
                    held += len(block)
                    if len(rows) == 256 or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema)


def referred(read: DataFrame) -> DataFrame:
    """read with refers_to: the key of the response that a revisit refers to."""
    response = read.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("key").alias("refers_to"))
    used = read.where("record_type = 'revisit'").select("refers_to_record").distinct()
    return read.join(response.join(used, "refers_to_record", "left_semi"), "refers_to_record", "left")
