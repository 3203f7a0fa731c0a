"""Legacy archive converter: ARC files to WARC files with revisit records.

ARC (versions 1 and 2): a file starts with a ``filedesc`` record whose body
names the version and the fields of the header lines. Each record is a header
line and as many bytes as its last field declares. The converter reads both
versions by the fields the file itself names, and synthesises for each record
a WARC identifier (name-based UUID of file, place and URL), ISO timestamp,
type, and block and payload digests.

Archives are plain files in a shared folder: Spark's text writer puts each
record's bytes in one row, and the row separator is the format's own (a line
feed after an ARC record, two CR LF after a WARC record). Files hold about
``FILE_BYTES`` each, so a reader's task holds one file.

Equal payloads of at least ``MIN_REVISIT`` bytes: the record of the largest
(key, record id) is the response, the others become revisits of it. They are
found on a narrow index of the records (digest, size, key, identifier); only
the list of a file's revisits meets the file, so no payload is exchanged.

Defined cases: NULL payloads are empty; NULL URLs are written as ``unknown:``;
bytes of a URL that would break a header line are percent-encoded; a date that
is no date becomes 1970-01-01; a record cut short by the file's end is kept
and marked truncated; a line that is no header is skipped to the next line.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.session import scratch_path

from .common import saved

FILE_BYTES = 32 << 20
MIN_REVISIT = 1000
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
WARC_END = "\r\n\r\n"
#: Records are written once and read twice: speed matters more than size.
GZIP_LEVEL = "BEST_SPEED"
KEY_HEADER = "X-Record-Key"
RECORDS = ("record_id string, type string, url string, date string, ip string, content_type string, head binary, "
           "payload binary, payload_bytes long, sha1 string, key long, truncated boolean")


def _line_safe(url: str | None) -> str:
    raw = (url if url is not None else "unknown:").encode("utf-8")
    return "".join(chr(c) if 0x20 < c < 0x7F else f"%{c:02X}" for c in raw) or "unknown:"


def http_block(payload: bytes, key: int | None) -> bytes:
    """An HTTP response of the payload that carries the row's key."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n"
    return (head + (f"{KEY_HEADER}: {key}\r\n" if key is not None else "") + "\r\n").encode() + payload


def arc_filedesc(name: str, version: int, date: str = "19960101000000") -> bytes:
    """The first record of an ARC file, without its last line feed."""
    body = f"{version} 0 textlake\n{V1 if version == 1 else V2}\n"
    extra = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n{body}".encode()


def arc_record(name: str, version: int, url: str, ip: str, date: str, ctype: str, body: bytes) -> bytes:
    """An ARC record without its last line feed."""
    extra = "" if version == 1 else f"200 {hashlib.md5(body).hexdigest()} - 0 {name} "
    return f"{url} {ip} {date} {ctype} {extra}{len(body)}\n".encode() + body


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: fields in lower case, place, body, truncated."""
    fields, at = V1.lower().split(), 0
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)]
        after = end + 1 if end >= 0 else len(data)
        if not line.strip():
            at = after
            continue
        first = line.startswith(b"filedesc://")
        text = line.decode("latin-1").rstrip("\r")
        # the version line comes inside the first record: its own header has the fields of either version
        names = (V1 if len(text.split(" ")) == 5 else V2).lower().split() if first else fields
        parts = text.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            at = after
            continue
        rec = dict(zip(names, parts))
        size = int(parts[-1])
        body = data[after:after + size]
        if first:
            lines = body.decode("latin-1").split("\n")
            fields = lines[1].lower().split() if len(lines) > 1 and lines[1].strip() else fields
        yield rec | {"at": at, "body": body, "truncated": len(body) < size, "first": first}
        at = after + size


def iso_date(stamp: str) -> str:
    """ISO time of an ARC date of 8, 12 or 14 digits."""
    try:
        return datetime.strptime(stamp[:14].ljust(14, "0") if len(stamp) >= 8 else stamp, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and payload; a body that is no HTTP message is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    m = re.search(rb"\r?\n\r?\n", body)
    return (body[:m.end()], body[m.end():]) if m else (body, b"")


def _header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name).encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("latin-1").strip() if m else None


def convert_record(rec: dict, name: str) -> dict:
    """The WARC fields of an ARC record."""
    url = rec["url"]
    head, payload = (b"", rec["body"]) if rec["first"] else split_http(rec["body"])
    kind = "warcinfo" if rec["first"] else "response" if head else "resource"
    key = _header(head, KEY_HEADER)
    return {"record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{rec['at']}#{url}')}>", "type": kind, "url": url,
            "date": iso_date(rec["archive-date"]), "ip": rec["ip-address"],
            "content_type": "application/http; msgtype=response" if head else rec["content-type"], "head": head, "payload": payload,
            "payload_bytes": len(payload), "sha1": hashlib.sha1(payload).hexdigest(),
            "key": int(key) if key and re.fullmatch(r"-?\d+", key) else None, "truncated": rec["truncated"]}


def _b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def warc_record(r: dict) -> bytes:
    """A WARC/1.1 record without the two CR LF that end it. A revisit carries only the HTTP head."""
    revisit = r["refers_to_id"] is not None
    block = r["head"] if revisit else r["head"] + r["payload"]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else r['type']}", f"WARC-Record-ID: {r['record_id']}",
            f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}",
            f"WARC-Block-Digest: sha1:{_b32(hashlib.sha1(block).hexdigest())}", f"WARC-Payload-Digest: sha1:{_b32(r['sha1'])}"]
    if revisit:
        head += ["WARC-Profile: http://netpreservation.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {r['refers_to_id']}"]
        if r["refers_to"] is not None:
            head.append(f"X-Refers-To-Key: {r['refers_to']}")
    if r["truncated"]:
        head.append("WARC-Truncated: length")
    head += [f"Content-Type: {r['content_type']}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8") + block


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(named fields in lower case, block) of each record of a WARC file."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at) if at >= 0 else -1
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields.get("content-length", "0"))
        yield fields, data[end + 4:end + 4 + size]
        at = end + 4 + size


def _content(b: pa.RecordBatch) -> Iterator[bytes]:
    for i in range(b.num_rows):
        data = b.column("content")[i].as_py()
        yield gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def write_arc(rows: DataFrame, path: str, version: int = 1) -> None:
    """ARC files of rows (key, url, ip, date, payload): one record a row."""
    def run(batches):
        name, begun = f"part-{TaskContext.get().partitionId():05d}.arc", False
        for b in batches:
            out = [] if begun else [arc_filedesc(name, version)]
            begun = True
            for r in b.to_pylist():
                out.append(arc_record(name, version, _line_safe(r["url"]), r["ip"], r["date"], "text/html",
                                      http_block(r["payload"] or b"", r["key"])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = rows.select("key", "url", "ip", "date", "payload").mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\n").option("zlib.compress.level", GZIP_LEVEL).text(path, compression="gzip")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a folder, a row each."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def convert_arc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RECORDS: every record of a folder of ARC files as WARC fields."""
    def run(batches):
        for b in batches:
            for data in _content(b):
                name, out, held = "unnamed", [], 0
                for rec in parse_arc(data):
                    name = rec["url"] if rec["first"] else name
                    out.append(convert_record(rec, name))
                    held += len(rec["body"])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=_records_schema())
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_records_schema())

    return read_files(spark, path).mapInArrow(run, RECORDS)


def _records_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORDS.split(", "))])


def with_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Add refers_to_id and refers_to (key) to the records that another with an equal payload stands for."""
    big = records.where((F.col("payload_bytes") >= min_bytes) & (F.col("type") == "response"))
    last = big.groupBy("sha1", "payload_bytes").agg(F.max(F.struct("key", "record_id")).alias("last"), F.count("*").alias("n"))
    last = last.where("n > 1").select(F.col("sha1").alias("l_sha1"), F.col("payload_bytes").alias("l_bytes"),
                                      F.col("last.key").alias("l_key"), F.col("last.record_id").alias("l_id"))
    # the extra hash key makes both sides exchange, so that a payload of many records can be split by the skew join
    same = (F.xxhash64("sha1") == F.col("l_hash")) & (F.col("sha1") == F.col("l_sha1")) & (F.col("payload_bytes") == F.col("l_bytes"))
    out = records.join(last.withColumn("l_hash", F.xxhash64("l_sha1")), same & (F.col("type") == "response"), "left")
    other = F.col("record_id") != F.col("l_id")
    return out.select(*records.columns, F.when(other, F.col("l_id")).alias("refers_to_id"), F.when(other, F.col("l_key")).alias("refers_to"))


def _warcinfo(name: str) -> bytes:
    """The record that a WARC file starts with."""
    body = b"software: textlake\r\nformat: WARC File Format 1.1\r\n"
    return warc_record({"record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "type": "warcinfo", "url": name,
                        "date": "1970-01-01T00:00:00Z", "ip": "0.0.0.0", "content_type": "application/warc-fields", "head": b"",
                        "payload": body, "sha1": hashlib.sha1(body).hexdigest(), "refers_to_id": None, "truncated": False})


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of records with refers_to_id and refers_to; each file starts with a warcinfo record."""
    def run(batches):
        name, begun = f"part-{TaskContext.get().partitionId():05d}.warc", False
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                out = []
                if not begun:
                    out.append(_warcinfo(name))
                    begun = True
                out += [warc_record(r) for r in b.slice(at, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    _write_warc_rows(records.mapInArrow(run, "record binary"), path)


def _write_warc_rows(rows: DataFrame, path: str) -> None:
    text = rows.select(F.col("record").cast("string"))
    text.write.option("lineSep", WARC_END).option("zlib.compress.level", GZIP_LEVEL).text(path, compression="gzip")


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, record_id, type, payload_bytes, sha1, key): the records of a folder of ARC files without their contents."""
    def run(batches):
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), _content(b)):
                name, out = "unnamed", []
                for rec in parse_arc(data):
                    name = rec["url"] if rec["first"] else name
                    r = convert_record(rec, name)
                    out.append((file, r["record_id"], r["type"], r["payload_bytes"], r["sha1"], r["key"]))
                if out:
                    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)],
                                                     ["path", "record_id", "type", "payload_bytes", "sha1", "key"])

    return read_files(spark, path).mapInArrow(run, "path string, record_id string, type string, payload_bytes long, sha1 string, key long")


def convert_files(spark: SparkSession, arc: str, warc: str, min_bytes: int = MIN_REVISIT) -> None:
    """A folder of ARC files to a folder of WARC files with revisits.

    A file's list of revisits is as long as the file has records at most.
    """
    again = with_revisits(saved(arc_index(spark, arc), "arc-index"), min_bytes).where(F.col("refers_to_id").isNotNull())
    again = again.groupBy("path").agg(F.collect_list(F.struct("record_id", "refers_to_id", "refers_to")).alias("again"))

    def run(batches):
        name, begun = f"part-{TaskContext.get().partitionId():05d}.warc", False
        for b in batches:
            for data, listed in zip(_content(b), b.column("again").to_pylist()):
                revisits = {r["record_id"]: r for r in listed or []}
                source, out, held = "unnamed", [] if begun else [_warcinfo(name)], 0
                begun = True
                for rec in parse_arc(data):
                    source = rec["url"] if rec["first"] else source
                    r = convert_record(rec, source)
                    out.append(warc_record(r | revisits.get(r["record_id"], {"refers_to_id": None, "refers_to": None})))
                    held += len(out[-1])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    _write_warc_rows(read_files(spark, arc).join(again, "path", "left").mapInArrow(run, "record binary"), warc)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, url, record_type, payload_bytes, payload_digest, refers_to, digest_ok) of a folder of WARC files.

    Size and digest of a response come from its payload; a revisit states its
    own in the HTTP head and the payload digest.
    """
    kinds = [("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())]

    def run(batches):
        for b in batches:
            for data in _content(b):
                out = []
                for f, block in parse_warc(data):
                    kind = f.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    stated = base64.b32decode(f["warc-payload-digest"].partition(":")[2]).hex()
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if kind == "revisit":
                        size, digest = int(_header(head, "Content-Length") or 0), stated
                    key, refers = _header(head, KEY_HEADER), f.get("x-refers-to-key")
                    out.append({"key": int(key) if key else None, "url": f.get("warc-target-uri"), "record_type": kind, "payload_bytes": size,
                                "payload_digest": digest, "refers_to": int(refers) if refers else None, "digest_ok": digest == stated})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    return read_files(spark, path).mapInArrow(run, "key long, url string, record_type string, payload_bytes long, "
                                                   "payload_digest string, refers_to long, digest_ok boolean")


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", version: int = 1,
                  min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write the rows as ARC files, convert them to WARC files with revisits, and read those back."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.lit("0.0.0.0").alias("ip"),
                        F.lit("20000101000000").alias("date"), F.encode(F.col(payload), "UTF-8").alias("payload"))
    total = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("payload"), F.lit(0)) + 400), F.lit(0))).first()[0]
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    # dealt out row by row: neither a hot page nor a hot host fills one file
    files = max(int(total) // FILE_BYTES + 1, spark.sparkContext.defaultParallelism)
    write_arc(rows.repartition(files), arc, version)
    convert_files(spark, arc, warc, min_bytes)
    return read_warc(spark, warc)
