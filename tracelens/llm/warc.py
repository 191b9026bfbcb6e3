"""WARC archives with segmented records.

write_pages() makes one record per page: an HTTP message in chunked transfer framing, cut into segments of at most
SEGMENT bytes (the first is the record itself, the others are continuations that name their origin). Of pages with
equal payloads of `least` bytes or more, that with the smallest id is a response, the others revisit it. Spark's text
writer lays the records down, each ended by CRLF CRLF, in gzip files of bounded size.

read_pages() parses the files, groups segments by origin, orders them by number, checks that none is missing and that
the total length holds, decodes the chunks and checks the payload digest; a fault raises ValueError. Records that are not
segmented are finished where they are parsed, so only segments travel to their group.

Null html is an empty payload, a null url an empty target; line ends in a url are percent-encoded; null ids read back
as null; rows with equal ids and payloads are all responses where theirs is the smallest id; other columns are
ignored; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, stored

SEGMENT, CHUNK, PER_FILE, LEAST = 16_384, 8_192, 1_000, 100
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
FIELDS = "origin string, number int, type string, page_id long, refers_to long, digest string, total long, payload_bytes long, block binary"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def text(data: Column) -> Column:
    """The same bytes as a string, so that string functions join them."""
    return data.cast("string")


def chunked(payload: Column) -> Column:
    """The payload in chunked transfer framing, as raw bytes in a string."""
    count = F.floor((F.length(payload) + CHUNK - 1) / CHUNK).cast("int")

    def frame(k: Column) -> Column:
        part = F.substring(payload, k * CHUNK + 1, F.lit(CHUNK))
        return F.concat(F.lower(F.hex(F.length(part))), F.lit("\r\n"), text(part), F.lit("\r\n"))

    frames = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), frame)
    return F.concat(F.when(count > 0, F.array_join(frames, "")).otherwise(F.lit("")), F.lit("0\r\n\r\n"))


def segments(records: DataFrame) -> DataFrame:
    """One WARC segment per row, as raw bytes in the string column `record`, without the closing CRLF CRLF."""
    count = F.greatest(F.ceil(F.length("block") / SEGMENT).cast("int"), F.lit(1))
    rows = records.select("*", F.posexplode(F.sequence(F.lit(1), count)).alias("at", "number"), count.alias("segments"))
    part = F.substring("block", (F.col("number") - 1) * SEGMENT + 1, F.lit(SEGMENT))
    own = F.concat(F.lit("<urn:page:"), "record_key", F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    first, last = F.col("number") == 1, F.col("number") == F.col("segments")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise(F.lit("continuation"))),
        line("WARC-Record-ID", F.when(first, own).otherwise(F.concat(F.lit("<urn:page:"), "record_key", F.lit(":"), F.col("number").cast("string"), F.lit(">")))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", F.col("target")),
        F.when(F.col("segments") > 1, line("WARC-Segment-Number", F.col("number"))).otherwise(F.lit("")),
        F.when(~first, line("WARC-Segment-Origin-ID", own)).otherwise(F.lit("")),
        F.when(last & ~first, line("WARC-Segment-Total-Length", F.length("block"))).otherwise(F.lit("")),
        F.when(first, F.concat(line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), F.lit("Content-Type: application/http; msgtype=response\r\n"))).otherwise(F.lit("")),
        F.when(first & (F.col("record_type") == "revisit"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Length", F.length(part)),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, text(part)).alias("record"))


def write_pages(pages: DataFrame, path: str, *, least: int = LEAST, id_col: str = "page_id") -> None:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    repeated = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(stored(repeated, "repeated"), "digest", "left")  # stored: Spark knows its size, and broadcasts it if small
    revisit = F.col("first_id").isNotNull() & F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(True))
    http = F.concat(F.lit(HTTP), chunked(F.col("payload")))
    records = joined.select(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("/"), F.monotonically_increasing_id().cast("string")).alias("record_key"),
        F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("target"),
        "digest",
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.lit(HTTP)).otherwise(http).cast("binary").alias("block"),
    )
    segments(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or head[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in head[1:])
        size = int(fields["Content-Length"])
        block, at = data[end + 4 : end + 4 + size], end + 8 + size
        if len(block) < size or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("cut WARC record")
        yield fields, block


def page_of(name: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)(?:/.*)?>", name)
    return int(found[1]) if found else None


def table_of(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    named = [f.split() for f in fields.split(", ")]
    columns = list(zip(*rows)) or [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named)], names=[n for n, _ in named])


def payload_of(block: bytes, digest: str) -> bytes:
    """The payload in a response's block, held against its digest."""
    payload = dechunk(block.partition(b"\r\n\r\n")[2])
    if "sha256:" + hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload fails its digest")
    return payload


def parsed(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Segments with their blocks; records in one piece have number 0 and, unless `keep`, no block any more."""
    for batch in batches:
        for cell in batch.column(0):
            rows = []
            for f, block in parse(gzip.decompress(cell.as_py())):
                origin, kind, digest = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), f["WARC-Type"], f.get("WARC-Payload-Digest")
                number = int(f.get("WARC-Segment-Number", 0))
                size = len(payload_of(block, digest)) if number == 0 and kind == "response" else None
                rows.append((origin, number, kind, page_of(origin), page_of(f.get("WARC-Refers-To", "")), digest, int(f.get("WARC-Segment-Total-Length", -1)), size, block if number or keep else None))
            yield table_of(rows, FIELDS)


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
        if len(out[-1]) < size or body[at - 2 : at] != b"\r\n":
            raise ValueError("broken chunk framing")


def reassemble(parts: list[dict]) -> bytes:
    """The block of one record from its segments in any order."""
    parts = sorted(parts, key=lambda p: p["number"])
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing or repeated")
    block = b"".join(p["block"] for p in parts)
    if len(parts) > 1 and parts[-1]["total"] != len(block):
        raise ValueError("the segments' total length does not hold")
    return block


def whole(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            parts, kind, page_id, refers_to, digest, size = (c[k].as_py() for c in batch.columns)
            payload = None
            if kind == "response" and (keep or size is None):
                payload = payload_of(reassemble(parts) if parts[0]["number"] else parts[0]["block"], digest)
                size = len(payload)
            rows.append((page_id, size, digest.removeprefix("sha256:"), kind, refers_to, payload if keep else None))
        yield table_of(rows, RECORD)


def read_records(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits, or if not asked for)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = files.mapInArrow(lambda b: parsed(b, payloads), FIELDS)
    first = lambda c: F.max(F.when(F.col("number") < 2, F.col(c))).alias(c)
    groups = rows.groupBy("origin").agg(F.collect_list(F.struct("number", "total", "block")).alias("parts"), first("type"), first("page_id"), first("refers_to"), first("digest"), first("payload_bytes"))
    return groups.drop("origin").mapInArrow(lambda b: whole(b, payloads), RECORD)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The records' facts; a revisit has the length of the response that it refers to."""
    rows = stored(read_records(spark, path, payloads=False).drop("payload"), "warc-records")
    sizes = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("size"))
    return rows.join(sizes, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, *, path: str | None = None) -> DataFrame:
    path = path or shared_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path)
