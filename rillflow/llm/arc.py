"""Legacy archive conversion: ARC files (both header versions) to WARC files, with revisits for repeated payloads.

An ARC record is one header line, whose fields depend on the version its file declares, and as many bytes as the line
says. A WARC record needs more than that: an identifier, an ISO date, a type and digests, which are synthesised here
in a way that gives the same record the same values whenever the conversion is run again. Archives are written with
Spark's text sink (rows are whole records, compressed by file) and read with its ``binaryFile`` source, so any file
system that Spark reaches will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .common import Batches, query, table, written

# The field lists of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORDS_PER_FILE = 20_000
RECORD = ("file string, place long, record_id string, uri string, ip string, date string, mime string, "
          "http binary, payload binary, payload_bytes long, digest string, rank long, truncated boolean")
READ = ("record_id string, record_type string, rank long, refers_to_id string, payload_bytes long, "
        "payload_digest string, uri string, date string")


# --- ARC -------------------------------------------------------------------------------------------------------------

def arc_record(version: int, uri: str, ip: str, date14: str, mime: str, body: bytes, place: int) -> bytes:
    """One record without the line feed that ends it."""
    uri = quote(uri or "-", safe="%/:=&?~#+!$,;'@()*[]")
    head = [uri, ip, date14, mime]
    if version == 2:
        head += [body[9:12].decode() if body.startswith(b"HTTP/") else "-", "-", "-", str(place), "-"]
    return " ".join([*head, str(len(body))]).encode() + b"\n" + body


def write_arc(rows: DataFrame, path: str) -> None:
    """ARC files from rows (uri, ip, date14, mime, body), one file for each partition, versions 1 and 2 in turn."""

    def run(batches: Batches) -> Batches:
        part, place = TaskContext.get().partitionId(), 0
        version = 1 + part % 2
        about = f"{version} 0 rillflow\n{FIELDS[version]}\n".encode()
        pending = [arc_record(version, f"filedesc://part-{part}.arc", "0.0.0.0", "20200101000000", "text/plain", about,
                              0)]
        for batch in batches:
            for uri, ip, date, mime, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
                place += 1
                pending.append(arc_record(version, uri, ip, date, mime, body, place))
            yield pa.RecordBatch.from_arrays([pa.array(pending, pa.binary())], ["value"])
            pending = []

    lines = rows.select("uri", "ip", "date14", "mime", "body").mapInArrow(run, "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip") \
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


LINE = {
    1: re.compile(rb"(\S.*) (\S+) (\d{8,14}) (?:(\S.*) )?(\d+)"),
    2: re.compile(rb"(\S.*) (\S+) (\d{8,14}) (\S.*?) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)"),
}


def parse_arc(data: bytes) -> Iterator[tuple[int, int, list[str], bytes, bool]]:
    """(version, offset, header fields, body, truncated) of each record but the file's own description.

    The version comes from the file's description; a file that lacks one is read by the longer form if a line fits it.
    Lines that are no header are passed over until one is. A record cut off by the end of the file keeps what is there.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line, start = data[at:end].rstrip(b"\r"), at
        found = None
        for kind in ([version] if version else [2, 1]):
            found = LINE[kind].fullmatch(line)
            if found:
                break
        if line.startswith(b"filedesc://"):
            length = int(line.rsplit(b" ", 1)[-1])
            said = data[end + 1:end + 1 + length].split(b" ", 1)[0]
            version = int(said) if said in (b"1", b"2") else None
            at = end + 1 + length
        elif found:
            length = int(found[found.lastindex])
            body = data[end + 1:end + 1 + length]
            yield kind, start, [(x or b"").decode("utf-8", "replace") for x in found.groups()], body, len(body) < length
            at = end + 1 + length
        else:
            at = end + 1


def iso_date(date: str) -> str:
    """An ARC date, padded to the second."""
    date = (date + "0101000000"[len(date) - 4:])[:14] if len(date) < 14 else date[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload; a body that is no HTTP response is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    head, gap, payload = body.partition(b"\r\n\r\n")
    return head + gap, payload


def http_header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def arc_records(spark: SparkSession, path: str, rank_header: str) -> DataFrame:
    """The records of all ARC files below ``path``, with what a WARC record needs.

    ``rank`` is the whole number in the HTTP header ``rank_header``, null without one.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name, out, size = path.rsplit("/", 1)[-1], [], 0
                for version, place, fields, body, cut in parse_arc(content.as_py()):
                    http, payload = split_http(body)
                    rank = http_header(http, rank_header)
                    out.append((
                        name, place, f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}@{place}')}>", fields[0],
                        fields[1], iso_date(fields[2]), fields[3] or "-", http, payload, len(payload),
                        hashlib.sha1(payload).hexdigest(),
                        int(rank) if rank and re.fullmatch(r"-?\d{1,19}", rank) else None, cut))
                    size += len(body)
                    if size > 8 << 20:
                        yield as_batch(out, RECORD)
                        out, size = [], 0
                if out:
                    yield as_batch(out, RECORD)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD)


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, kinds[kind]) for column, (_, kind) in zip(zip(*rows), fields)],
                                      [name for name, _ in fields])


# --- WARC ------------------------------------------------------------------------------------------------------------

def with_revisits(records: DataFrame, min_bytes: int) -> DataFrame:
    """Adds ``original``: the record that stands for a repeated payload of at least ``min_bytes``, else null.

    The one of highest rank stands for the others (a missing rank is lowest, the record id breaks ties). Only digests
    are grouped, each task's own first, and only their winners meet the payloads; a digest that many records share
    is a long run on the side that adaptive execution splits.
    """
    large = F.col("payload_bytes") >= min_bytes
    best = F.max(F.struct("rank", "record_id", "uri", "date")).alias("original")
    winners = records.where(large).groupBy("digest").agg(best, F.count("*").alias("n")).where("n > 1")
    winners = winners.select("digest", "original").hint("shuffle_hash")
    joined = records.join(winners, "digest", "left")
    other = large & (F.col("original.record_id") != F.col("record_id"))
    return joined.withColumn("original", F.when(other, F.col("original")))


def warc_record(row: dict) -> bytes:
    """A response (or a resource, if the body is no HTTP response) or a revisit, without its last CR LF."""
    first, http = row["original"], row["http"] or b""
    kind = "revisit" if first else "response" if http else "resource"
    block = http if first else http + row["payload"]
    sha1 = lambda data: base64.b32encode(data).decode()
    head = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date']}",
        f"WARC-Target-URI: {row['uri']}",
        f"Content-Type: {'application/http; msgtype=response' if http else row['mime']}",
        f"WARC-Payload-Digest: sha1:{sha1(bytes.fromhex(row['digest']))}",
        f"WARC-Block-Digest: sha1:{sha1(hashlib.sha1(block).digest())}",
        f"X-Payload-Length: {row['payload_bytes']}",
    ]
    if row["ip"] not in ("0.0.0.0", "-"):
        head.append(f"WARC-IP-Address: {row['ip']}")
    if row["truncated"]:
        head.append("WARC-Truncated: unspecified")
    if first:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {first['record_id']}", f"WARC-Refers-To-Target-URI: {first['uri']}",
                 f"WARC-Refers-To-Date: {first['date']}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n"


def write_warc(records: DataFrame, path: str) -> None:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([warc_record(x) for x in batch.to_pylist()], pa.binary())],
                                             ["value"])

    columns = ["record_id", "uri", "ip", "date", "mime", "http", "payload", "payload_bytes", "digest", "truncated",
               "original"]
    lines = records.select(*columns).mapInArrow(run, "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip") \
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, by declared lengths."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        yield headers, data[end + 4:end + 4 + length]
        at = end + 4 + length


def read_warc(spark: SparkSession, path: str, rank_header: str) -> DataFrame:
    """One row per response, resource or revisit record. Digests of stored payloads are taken anew from the payload."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for content in batch.column(1):
                out = []
                for head, block in parse_warc(content.as_py()):
                    kind = head["warc-type"]
                    http, payload = split_http(block)
                    if kind == "revisit":
                        size = int(head["x-payload-length"])
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    else:
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    rank = http_header(http, rank_header)
                    out.append((head["warc-record-id"], kind, int(rank) if rank else None,
                                head.get("warc-refers-to"), size, digest, head["warc-target-uri"], head["warc-date"]))
                if out:
                    yield as_batch(out, READ)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READ)


def convert(spark: SparkSession, arc_path: str, warc_path: str, rank_header: str = "X-Page-Id",
            min_bytes: int = 1000) -> None:
    """All ARC files below ``arc_path`` to WARC files below ``warc_path``."""
    write_warc(with_revisits(arc_records(spark, arc_path, rank_header), min_bytes), warc_path)


# --- pages -----------------------------------------------------------------------------------------------------------

def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as ARC input: the id travels in an HTTP header. Null html is an empty payload, null ids have no header."""
    payload = F.encode(F.coalesce(pages["html"], F.lit("")), "utf-8")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.coalesce(F.concat(F.lit("X-Page-Id: "), pages["page_id"].cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    seconds = F.coalesce(F.pmod(pages["page_id"], F.lit(86_400 * 365)), F.lit(0))
    return pages.select(
        pages["url"].alias("uri"), F.lit("0.0.0.0").alias("ip"),
        F.date_format(F.timestamp_seconds(F.lit(1_500_000_000) + seconds), "yyyyMMddHHmmss").alias("date14"),
        F.lit("text/html").alias("mime"), F.concat(F.encode(head, "utf-8"), payload).alias("body"))


SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
           sha1(coalesce(html, '')) AS payload_digest
    FROM pages),
q AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN first_id END AS refers_to
FROM q"""


@query("op1_arc_to_warc", SQL)
def arc_to_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as ARC files, converted to WARC files, read back: one row per page.

    Repeated page ids are records of their own, equal payloads being told apart by record id; an empty table gives no
    rows.
    """
    arcs, warcs = f"{scratch(spark, 'arc')}/files", f"{scratch(spark, 'warc')}/files"
    write_arc(page_captures(table(spark, folder, "pages")), arcs)
    convert(spark, arcs, warcs)
    records = written(read_warc(spark, warcs, "X-Page-Id"), "records")
    revisits = records.where(F.col("record_type") == "revisit").select("record_id", "refers_to_id")
    targets = records.where(F.col("record_type") == "response").select(
        F.col("record_id").alias("refers_to_id"), F.col("rank").alias("refers_to"))
    named = revisits.join(targets, "refers_to_id").select("record_id", "refers_to")
    return records.join(named, "record_id", "left").select(
        F.col("rank").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
