"""Legacy archive converter: ARC files to WARC files.

ARC files (version 1 and 2) are read as their own version block says: header lines of that version's fields, anchored on
the address and the date (targets and content types may hold blanks), then as many content bytes as the line declares.
For each record an equivalent WARC record is synthesised: an identifier (UUID of target, date and content digest, so a
retried task writes the same), an ISO date from the 14-digit one, block and payload digests, and the type: response for
HTTP messages, resource for anything else (dns:, ftp:), and a warcinfo record for the version block. Of responses with
equal payloads of at least MIN_REVISIT bytes one stays a response - that with the largest key, where the messages name
one, or else the earliest (the first target of that date) - and the others become revisits that keep their HTTP headers
and refer to it.

Files are written and read by Spark's own text and binaryFile sources, so any store that Spark reaches will do. An
ARC file holds one partition's records, a WARC file at most FILE_RECORDS. A fixed-size bitmap of the repeated payload
digests decides in the parsing task which records may be revisits; only those are shuffled (salted) to meet their
response.

Malformed archives: what is no record line where one is due is skipped up to the next line that is one, and becomes a
row of ``rejects`` with its bytes; a file without a version block, or of an unknown version, is one reject; a record cut
off at the end of its file keeps what is there and is marked WARC-Truncated. Nothing of this stops the job.

Defined results: a null html is an empty payload; a null url becomes urn:page:<id>, and white space in a url is
percent-encoded; rows repeated with the largest key are all responses, as are records that share target and date with
the response; records without a key never beat one with a key. Payloads of any length are taken whole. Extra columns,
whatever their names, are not read. An empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.functions.bitmaps import in_bitmap, slot_bitmap
from skillweave.llm.common import written
from skillweave.session import scratch_path

MIN_REVISIT = 1000
FILTER_BITS = 25
SALTS = 16
#: Date given to pages, which carry none.
PAGE_DATE = "20240101000000"
#: Bytes of records handed on at a time.
BATCH_BYTES = 4 << 20

#: The header fields of an ARC record line, by version of the file.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
KEY_HEADER = b"X-Record-Key"
#: Records in a WARC file.
FILE_RECORDS = 50_000
#: What a field of a record line looks like; the target and the content type may hold blanks.
_SHAPES = {"URL": rb"(.*)", "IP-address": rb"(\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*|-)",
           "Archive-date": rb"(\d{4,14})", "Content-type": rb"(.*)", "Archive-length": rb"(\d+)"}


# ---- ARC -------------------------------------------------------------------------------------------------------

def arc_line(version: int, url: str, date: str, mime: str, length: int, name: str = "-") -> bytes:
    middle = [] if version == 1 else ["200", "-", "-", "0", name]
    return " ".join([url, "0.0.0.0", date, mime, *middle, str(length)]).encode("utf-8", "surrogatepass")


def arc_head(version: int, name: str) -> bytes:
    """The version block that opens an ARC file, without its closing newline."""
    block = f"{version} 0 skillweave\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_line(version, f"filedesc://{name}", PAGE_DATE, "text/plain", len(block), name) + b"\n" + block


def http_message(key, payload: bytes) -> bytes:
    head = (b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
            + KEY_HEADER + b": %s\r\n\r\n" % ("" if key is None else str(key)).encode())
    return head + payload


def record_line(fields: list[str]) -> re.Pattern:
    """What a record line with these fields looks like."""
    return re.compile(b" ".join(_SHAPES.get(f, rb"(\S+)") for f in fields), re.DOTALL)


def read_arc(stream, bad=None, info: bool = False) -> Iterator[dict]:
    """Records of an open ARC file; declared lengths rule, never line breaks. With ``info`` the version block comes first,
    as a record with its ``version``. What is malformed raises an error, or is given to ``bad(bytes, reason)`` and skipped up to the next
    record line."""
    def fail(data: bytes, reason: str) -> None:
        if bad is None:
            raise ValueError(f"{reason}: {data[:200]!r}")
        bad(data, reason)

    fields, shape, lost = None, None, []
    while line := stream.readline():
        if not line.strip(b"\r\n"):
            continue
        bare = line.rstrip(b"\r\n")
        if fields is None:
            if not bare.startswith(b"filedesc://") or not bare.rsplit(b" ", 1)[-1].isdigit():
                fail(line + stream.read(), "no version block")
                return
            text = stream.read(int(bare.rsplit(b" ", 1)[1]))
            block = text.split(b"\n")
            version = block[0].split(b" ", 1)[0].decode("utf-8", "replace")
            if not version.isdigit() or int(version) not in ARC_FIELDS:
                fail(line + text + stream.read(), "unknown ARC version")
                return
            fields = block[1].decode().split(" ") if len(block) > 1 and block[1] else ARC_FIELDS[int(version)]
            shape = record_line(fields)
            parts = bare.decode("utf-8", "surrogateescape").split(" ")
            if info:
                yield {"version": int(version), "URL": parts[0], "IP-address": parts[1] if len(parts) > 2 else "-",
                       "Archive-date": next((x for x in parts[1:-1] if x.isdigit()), PAGE_DATE), "Content-type": "text/plain",
                       "content": text, "truncated": False}
            continue
        found = shape.fullmatch(bare)
        if found is None:
            lost.append(line)
            continue
        if lost:
            fail(b"".join(lost), "bad record line")
            lost = []
        record = dict(zip(fields, (v.decode("utf-8", "surrogateescape") for v in found.groups())))
        length = int(record["Archive-length"])
        content = stream.read(length)
        yield record | {"version": None, "content": content, "truncated": len(content) < length}
    if lost:
        fail(b"".join(lost), "bad record line")


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP message; no head for other content."""
    if content.startswith(b"HTTP/") and (at := content.find(b"\r\n\r\n")) >= 0:
        return content[:at + 4], content[at + 4:]
    return b"", content


def header_value(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].strip() if found else None


# ---- WARC ------------------------------------------------------------------------------------------------------

def record_id(url: str, date: str, digest: bytes, key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest.hex()} {key}')}>"


def iso_date(date: str) -> str:
    date = (date + "00000101000000"[len(date):])[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def digest_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(record: dict, holder: dict | None) -> bytes:
    """WARC record of a parsed ARC record, without the blank lines that close it; a revisit of ``holder`` if given."""
    if record["version"] is not None:
        return info_record(record)
    head, payload = record["head"], record["payload"]
    block = head if holder else head + payload
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if holder else 'response' if head else 'resource'}",
             f"WARC-Record-ID: {record_id(record['url'], record['date'], record['digest'], record['key'])}",
             f"WARC-Date: {iso_date(record['date'])}", f"WARC-Target-URI: {record['url']}"]
    if record["ip"] not in ("0.0.0.0", "-", ""):
        lines.append(f"WARC-IP-Address: {record['ip']}")
    lines += [f"WARC-Block-Digest: {digest_label(hashlib.sha1(block).digest())}",
              f"WARC-Payload-Digest: {digest_label(record['digest'])}"]
    if record["truncated"]:
        lines.append("WARC-Truncated: length")
    if holder:
        refers = record_id(holder["url"], holder["date"], record["digest"], holder["key"])
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {refers}", f"WARC-Refers-To-Target-URI: {holder['url']}",
                  f"WARC-Refers-To-Date: {iso_date(holder['date'])}"]
        if holder["key"] is not None:
            lines.append(f"Refers-To-Key: {holder['key']}")
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else record['mime']}",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def info_record(record: dict) -> bytes:
    """warcinfo of an ARC file's version block."""
    name = record["url"].removeprefix("filedesc://")
    origin = record["payload"].split(b"\n")[0].decode("utf-8", "replace").split(" ")
    fields = {"software": "skillweave", "format": "WARC File Format 1.0", "converted-from": f"ARC version {record['version']}"}
    if len(origin) > 2 and origin[2]:
        fields["publisher"] = " ".join(origin[2:])
    block = "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()
    lines = ["WARC/1.0", "WARC-Type: warcinfo",
             f"WARC-Record-ID: {record_id(record['url'], record['date'], record['digest'], None)}",
             f"WARC-Date: {iso_date(record['date'])}", f"WARC-Filename: {name}",
             f"WARC-Block-Digest: {digest_label(hashlib.sha1(block).digest())}", "Content-Type: application/warc-fields",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an open WARC file, by declared length."""
    while line := stream.readline():
        if not line.strip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"bad WARC record: {line[:200]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("WARC record is cut off")
        yield fields, block


# ---- Spark -----------------------------------------------------------------------------------------------------

def opened(content: bytes):
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _save(records: DataFrame, path: str, separator: str, most: int = 0) -> str:
    """Binary ``record`` rows as gzip files of at most ``most`` rows, each row closed by ``separator``."""
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator)
     .option("maxRecordsPerFile", most)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path))
    return path


def write_arc(pages: DataFrame, path: str) -> str:
    """ARC files of ``pages`` (page_id, url, html): one per partition, versions 1 and 2 in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = part % 2 + 1, f"pages-{part:05d}.arc"

        def rows():
            yield (arc_head(version, name),)
            for batch in batches:
                for key, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                    message = http_message(key, (html or "").encode("utf-8", "surrogatepass"))
                    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{key}")
                    yield (arc_line(version, url, PAGE_DATE, "text/html", len(message), name) + b"\n" + message,)
        yield from _batches(rows(), pa.schema([("record", pa.binary())]), lambda r: len(r[0]))
    return _save(pages.select("page_id", "url", "html").mapInArrow(run, "record binary"), path, "\n")


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


_KEYS = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("h", pa.int64()),
                   ("url", pa.string()), ("date", pa.string())])
_FULL = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("url", pa.string()), ("date", pa.string()),
                   ("ip", pa.string()), ("mime", pa.string()), ("truncated", pa.bool_()), ("version", pa.int32()),
                   ("head", pa.binary()), ("payload", pa.binary()), ("size", pa.int64())])


def _text(value: str) -> str:
    """A field as Unicode text; bytes that are none are percent-encoded."""
    return "".join(f"%{ord(c) - 0xDC00:02X}" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in value)


def _parsed(content: bytes, bad=lambda data, reason: None) -> Iterator[dict]:
    for r in read_arc(opened(content), bad, info=True):
        head, payload = split_http(r["content"]) if r["version"] is None else (b"", r["content"])
        key = header_value(head, KEY_HEADER)
        digest = hashlib.sha1(payload).digest()
        yield {"key": int(key) if key and key.lstrip(b"-").isdigit() else None, "digest": digest, "size": len(payload),
               "h": int.from_bytes(digest[:8], "big", signed=True), "url": _text(r["URL"]), "date": r["Archive-date"],
               "ip": r["IP-address"], "mime": _text(r["Content-type"]), "truncated": r["truncated"], "version": r["version"],
               "head": head, "payload": payload}


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for c in batch.column(0):
            yield c.as_py()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (tuple(r[n] for n in _KEYS.names) for c in _contents(batches) for r in _parsed(c) if r["head"])
    yield from _batches(rows, _KEYS, lambda r: 100)


def _full(bitmap_ref, repeated: bool, min_size: int):
    """Records that may be revisits (repeated) or the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bitmap_ref.value

        def rows():
            for c in _contents(batches):
                for r in _parsed(c):
                    maybe = bool(r["head"]) and r["size"] >= min_size and bool(in_bitmap(bitmap, np.array([r["h"]]).astype(np.uint64))[0])
                    if maybe == repeated:
                        yield tuple(r[n] for n in _FULL.names)
        yield from _batches(rows(), _FULL, lambda r: r[-1] + len(r[-3]) + 200)
    return run


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                holder = {"url": r["to_url"], "date": r["to_date"], "key": r["to_key"]} if r["to_url"] is not None else None
                yield (warc_record(r, holder),)
    yield from _batches(rows(), pa.schema([("record", pa.binary())]), lambda r: len(r[0]))


_FULL_SQL = ("key long, digest binary, url string, date string, ip string, mime string, truncated boolean, version int, "
             "head binary, payload binary, size long")


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_size: int = MIN_REVISIT) -> str:
    """Writes WARC files of all records of the ARC files under ``arc_path``."""
    arcs = archives(spark, arc_path)
    keys = arcs.mapInArrow(_keys, "key long, digest binary, size long, h long, url string, date string")
    holders = written(
        keys.where(F.col("size") >= min_size).groupBy("digest", "size", "h")
        .agg(F.coalesce(F.max_by(F.struct("url", "date", "key"), "key"),
                        F.min_by(F.struct("url", "date", "key"), F.struct("date", "url"))).alias("to"), F.count("*").alias("n"))
        .where("n > 1"), "arc-holders")
    bitmap = spark.sparkContext.broadcast(slot_bitmap(holders, "h", FILTER_BITS))
    alone = (arcs.mapInArrow(_full(bitmap, False, min_size), _FULL_SQL)
             .withColumns({"to_key": F.lit(None).cast("long"), "to_url": F.lit(None).cast("string"),
                           "to_date": F.lit(None).cast("string")}))
    salted = holders.select("digest", "size", F.col("to.key").alias("to_key"), F.col("to.url").alias("to_url"),
                            F.col("to.date").alias("to_date"),
                            F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("salt"))
    repeated = (arcs.mapInArrow(_full(bitmap, True, min_size), _FULL_SQL)
                .withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
                .join(salted, ["digest", "size", "salt"], "left").drop("salt"))
    # the response itself: by its key, or without keys by target and date
    first = F.when(F.col("to_key").isNotNull(), F.coalesce(F.col("key") == F.col("to_key"), F.lit(False))).otherwise(
        (F.col("url") == F.col("to_url")) & (F.col("date") == F.col("to_date")))
    repeated = repeated.withColumn("first", F.coalesce(first, F.lit(False)))
    repeated = repeated.withColumns({c: F.when(~F.col("first"), F.col(c)) for c in ("to_key", "to_url", "to_date")}).drop("first")
    both = alone.unionByName(repeated.select(*alone.columns))
    return _save(both.mapInArrow(_to_warc, "record binary"), warc_path, "\r\n\r\n", FILE_RECORDS)


def rejects(spark: SparkSession, arc_path: str) -> DataFrame:
    """(file, reason, data): what ``convert`` skips in the ARC files under ``arc_path``."""
    arcs = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(arc_path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found: list[tuple] = []
                for _ in _parsed(content.as_py(), lambda data, reason: found.append((reason, data))):  # noqa: B023
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()),
                                                  pa.array([r for r, _ in found], pa.string()),
                                                  pa.array([d for _, d in found], pa.binary())], ["file", "reason", "data"])
    return arcs.mapInArrow(run, "file string, reason string, data binary")


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
                   ("target_uri", pa.string()), ("warc_date", pa.string())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for content in _contents(batches):
            for fields, block in read_warc(opened(content)):
                head, payload = split_http(block)
                if digest_label(hashlib.sha1(block).digest()) != fields["warc-block-digest"]:
                    raise ValueError("block digest does not match")
                if fields["warc-type"] == "warcinfo":
                    yield (None, None, None, "warcinfo", None, fields["warc-record-id"], None, fields["warc-date"])
                    continue
                digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2])
                if not head:
                    payload = block
                size = len(payload)
                if fields["warc-type"] == "revisit":
                    declared = header_value(head, b"Content-Length")  # genuine messages may state none
                    size = int(declared) if declared and declared.isdigit() else None
                elif hashlib.sha1(payload).digest() != digest:
                    raise ValueError("payload digest does not match")
                key, to = header_value(head, KEY_HEADER), fields.get("refers-to-key")
                yield (int(key) if key else None, size, digest.hex(), fields["warc-type"], int(to) if to else None,
                       fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"])
    yield from _batches(rows(), _READ, lambda r: 200)


def read_records(spark: SparkSession, warc_path: str) -> DataFrame:
    """Records of WARC files, digests checked against the blocks."""
    return archives(spark, warc_path).mapInArrow(
        _read_back, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                    "record_id string, target_uri string, warc_date string")


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` through ARC files, the converter and WARC files, read back: their responses and revisits."""
    spark = pages.sparkSession
    arcs = write_arc(pages, scratch_path(spark, "arc"))
    return read_records(spark, convert(spark, arcs, scratch_path(spark, "warc"))).where("record_type <> 'warcinfo'")
