"""Legacy web archives (ARC, versions 1 and 2) to WARC.

An ARC file starts with a version block that names the fields of its header lines; each record is such a line, whose
last field declares the length of what follows. The converter makes the WARC equivalent of each record: an identifier
(a UUID of file and position, so repeated attempts agree), a timestamp, a type and SHA-1 digests. Of records with equal
payloads the one of the smallest page is a response, others are revisits that refer to it.

Defined cases: null html is an empty payload; a null or blank URL is `about:blank`, white space in URLs is
percent-encoded; a null page_id is larger than any other when the response is chosen; of equal page_ids the first in
file order is the response; payloads are whole, whatever their length; an empty table gives no records; extra columns
are dropped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import common

#: The fields of the two versions' header lines.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_DATE = "20240101000000"
_SPACE = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes

    @property
    def is_http(self) -> bool:
        return self.content.startswith(b"HTTP/")

    @property
    def http(self) -> tuple[bytes, bytes]:
        """Header block with its blank line, and payload."""
        if not self.is_http:
            return b"", self.content
        end = self.content.find(b"\r\n\r\n")
        return (self.content, b"") if end < 0 else (self.content[: end + 4], self.content[end + 4 :])


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1") if found else None


def arc_bytes(version: int, fields: dict[str, str], content: bytes) -> bytes:
    line = " ".join(_SPACE.sub(lambda m: f"%{ord(m[0]):02X}", fields.get(f) or "-") for f in FIELDS[version][:-1])
    return f"{line} {len(content)}\n".encode() + content + b"\n"


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 plinth\n{' '.join(FIELDS[version])}\n".encode()
    return arc_bytes(version, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": ARCHIVE_DATE, "Content-type": "text/plain", "Result-code": "200", "Offset": "0", "Filename": name}, body)


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """Records of an ARC file after its version block, by declared lengths."""
    version = None
    while line := stream.readline():
        if not line.strip():
            continue
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if version is None:
            if not text.startswith("filedesc://"):
                raise ValueError(f"no version block: {text[:80]!r}")
            body = stream.read(int(text.rsplit(" ", 1)[1]))
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        names = FIELDS[version]
        values = text.rsplit(" ", len(names) - 1)  # a legacy URL may hold spaces
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"bad header line of version {version}: {text[:80]!r}")
        content = stream.read(size := int(values[-1]))
        if len(content) != size:
            raise ValueError(f"record ends after {len(content)} of {size} bytes")
        yield ArcRecord(version, dict(zip(names, values)), content)


def record_uri(file: str, seq: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{seq}')}"


def warc_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def iso_date(archive_date: str) -> str:
    d = archive_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def _opened(path: str):
    fs, inner = common.filesystem(path)
    return gzip.open(fs.open_input_file(inner), "rb")


def _member(data: bytes) -> bytes:
    return gzip.compress(data, 1, mtime=0)


def write_arcs(pages: DataFrame, path: str) -> list[str]:
    """Pages (page_id, url, html) as compressed ARC files, one an input partition, of either version by turns."""

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:06d}.arc.gz"
        with common.published(f"{path}/{name}") as out:
            out.write(_member(version_block(version, name)))
            for batch in batches:
                for page_id, url, html in zip(*(common.column(batch, c) for c in ("page_id", "url", "html"))):
                    payload = (html or "").encode()
                    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n".encode()
                    fields = {"URL": (url or "").strip() or "about:blank", "IP-address": "0.0.0.0", "Archive-date": ARCHIVE_DATE, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Filename": name}
                    out.write(_member(arc_bytes(version, fields, head + payload)))
        yield pa.RecordBatch.from_pylist([{"file": f"{path}/{name}"}])

    common.small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html").mapInArrow(common.tidy(write), "file string").collect()  # a row a file
    return sorted(r.file for r in rows)


def convert(spark: SparkSession, arcs: list[str], path: str, min_bytes: int = 0) -> list[str]:
    """ARC files to as many WARC files under path."""
    n = len(arcs)
    if not n:
        return []

    def scan(batches):
        out = pa.schema([("file", pa.int64()), ("seq", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("size", pa.int64()), ("date", pa.string())])
        for batch in batches:
            for k in common.column(batch, "id"):
                rows = []
                with _opened(arcs[k]) as stream:
                    for seq, record in enumerate(read_arc(stream)):
                        head, payload = record.http
                        mark = http_field(head, "X-Page-Id")
                        rows.append({"file": k, "seq": seq, "page_id": None if mark is None else int(mark), "digest": base32_sha1(payload), "size": len(payload), "date": record.fields["Archive-date"]})
                yield pa.RecordBatch.from_pylist(rows, out)

    index = common.cut(spark.range(0, n, 1, n).mapInArrow(common.tidy(scan), "file long, seq long, page_id long, digest string, size long, date string"), "arc-index")
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("page_id"), F.col("file").alias("file"), F.col("seq").alias("seq"), F.col("date").alias("date"))
    large = F.col("size") >= min_bytes
    firsts = common.cut(index.where(large).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "arc-firsts")
    decided = (
        common.hot_join(index.where(large), firsts, "digest")
        .unionByName(index.where(~large), allowMissingColumns=True)
        .withColumn("revisit", F.coalesce(large & ~((F.col("first.file") == F.col("file")) & (F.col("first.seq") == F.col("seq"))), F.lit(False)))
        .select("file", "seq", "digest", "size", "revisit", F.col("first.date").alias("to_date"), F.col("first.file").alias("to_file"), F.col("first.seq").alias("to_seq"))
    )

    def write(batches):
        out = stream = records = done = None
        current = -1
        made = []

        def finish():
            if done is not None:
                done.__exit__(None, None, None)
                stream.close()
                made.append(path_of(current))

        def path_of(k):
            return f"{path}/part-{k:06d}.warc.gz"

        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != current:
                    finish()
                    current = row["file"]
                    stream = _opened(arcs[current])
                    records = read_arc(stream)
                    done = common.published(path_of(current))
                    out = done.__enter__()
                    info = b"software: plinth\r\nformat: WARC File Format 1.1\r\n"
                    out.write(_member(warc_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{record_uri(arcs[current], -1)}>"), ("WARC-Date", iso_date(ARCHIVE_DATE)), ("Content-Type", "application/warc-fields")], info)))
                record = next(records)
                out.write(_member(warc_of(record, arcs, row)))
        finish()
        yield pa.RecordBatch.from_pylist([{"file": f} for f in made], pa.schema([("file", pa.string())]))

    ordered = decided.repartitionByRange(n, "file").sortWithinPartitions("file", "seq")
    made = sorted(r.file for r in ordered.mapInArrow(common.tidy(write), "file string").collect())  # a row a file
    common.drop(index, firsts)
    return made


def warc_of(record: ArcRecord, arcs: list[str], row: dict) -> bytes:
    """The WARC equivalent of an ARC record, as decided in row."""
    head, payload = record.http
    date = iso_date(record.fields["Archive-date"])
    kind = ("revisit" if row["revisit"] else "response") if record.is_http else "resource"
    block = head if row["revisit"] else record.content
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_uri(arcs[row['file']], row['seq'])}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", record.fields["URL"]),
        ("WARC-IP-Address", record.fields["IP-address"]),
        ("Content-Type", "application/http; msgtype=response" if record.is_http else record.fields["Content-type"]),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if row["revisit"]:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_uri(arcs[row['to_file']], row['to_seq'])}>"), ("WARC-Refers-To-Date", iso_date(row["to_date"])), ("X-Payload-Length", str(row["size"]))]
    return warc_bytes(headers, block)


def read_pages(spark: SparkSession, warcs: list[str]) -> DataFrame:
    """Per response, revisit or resource record: page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    record_id. Digests of blocks and of present payloads are checked; refers_to is the page of the record that a revisit's
    WARC-Refers-To names."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("target", pa.string()), ("url", pa.string()), ("record_id", pa.string())])
    text = "page_id long, payload_bytes long, payload_digest string, record_type string, target string, url string, record_id string"
    if not warcs:
        return spark.createDataFrame([], text.replace("target string", "refers_to long"))

    def read(batches):
        for batch in batches:
            for k in common.column(batch, "id"):
                rows = []
                with _opened(warcs[k]) as stream:
                    for headers, block in read_warc(stream):
                        kind = headers["warc-type"]
                        if kind == "warcinfo":
                            continue
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        head, payload = ArcRecord(0, {}, block).http
                        if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or kind != "revisit" and base32_sha1(payload) != digest:
                            raise ValueError(f"{warcs[k]}: a digest differs at {headers['warc-record-id']}")
                        size = int(headers["x-payload-length"]) if kind == "revisit" else len(payload)
                        mark, to = http_field(head, "X-Page-Id"), headers.get("warc-refers-to")
                        rows.append({"page_id": mark and int(mark), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "target": to and to.strip("<>"), "url": headers["warc-target-uri"], "record_id": headers["warc-record-id"].strip("<>")})
                yield pa.RecordBatch.from_pylist(rows, schema)

    rows = common.cut(spark.range(0, len(warcs), 1, len(warcs)).mapInArrow(common.tidy(read), text), "warc-records")
    revisits = rows.where("target IS NOT NULL")
    named = rows.select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    targets = revisits.groupBy("target").agg(F.count(F.lit(1)).alias("n")).join(named, "target", "left")
    others = rows.where("target IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    found = common.hot_join(revisits, targets, "target").unionByName(others, allowMissingColumns=True)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id")
