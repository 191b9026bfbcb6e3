"""Token-id files: documents in ascending id order, ids coded in independent blocks.

A file is a run of records, each `TKC1`, kind, n, payload length and CRC-32 (little-endian), payload, newline.
Kind D lists the documents of the following kind-T records: ids, null marks and token counts, deflated. Kind T
is a block of up to BLOCK ids from the range coder, its CRC over the ids. Spark's text writer lays the records
down, so that its commit protocol covers lost executors; files are ordered by their part number, then their count.

A null text is empty and yields its end id alone; null ids come first; equal ids are ordered by text; other
columns are ignored; an empty table gives no documents. Blocks that fail their checksum raise ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, stored, text_of, writing
from .idcodec import BLOCK, IDS, LANES, decode_blocks, encode_blocks
from .tokens import Memo, memo_of, of_column, proof, same

MAGIC, HEAD = b"TKC1", struct.Struct("<4scIII")
PER_FILE = 2  #: groups of BLOCK * LANES ids in a file, which a reader takes whole


def record(kind: bytes, n: int, payload: bytes, crc: int) -> bytes:
    return HEAD.pack(MAGIC, kind, n, len(payload), crc) + payload


def text_ids(text: bytes, path: str) -> bytes:
    """Little-endian unsigned 32-bit ids of the text."""
    return b"".join(next(memo_of(path, same).of_texts([text])))


def index(docs: list[tuple[int | None, int]]) -> bytes:
    ids = np.array([i or 0 for i, _ in docs], "<i8").tobytes()
    return zlib.compress(ids + np.array([i is None for i, _ in docs], "u1").tobytes() + np.array([n for _, n in docs], "<u4").tobytes(), 1)


def unindex(n: int, payload: bytes) -> list[tuple[int | None, int]]:
    raw = zlib.decompress(payload)
    ids, null, counts = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n), np.frombuffer(raw, "<u4", n, 9 * n)
    return [(None if z else int(i), int(c)) for i, z, c in zip(ids, null, counts)]


def group_records(docs: list[tuple[int | None, int]], ids: np.ndarray) -> Iterator[bytes]:
    """The document list, then the blocks of its ids, LANES of them coded at once."""
    payload = index(docs)
    yield record(b"D", len(docs), payload, zlib.crc32(payload))
    for at in range(0, len(ids), BLOCK * LANES):
        for k, block in enumerate(encode_blocks(ids[at : at + BLOCK * LANES])):
            own = ids[at + k * BLOCK : at + min((k + 1) * BLOCK, BLOCK * LANES)]
            yield record(b"T", len(own), block, zlib.crc32(own.astype("<u4").tobytes()))


def narrow(ids: np.ndarray) -> np.ndarray:
    """Ids in two bytes where all fit; what does not is left for the coder to refuse."""
    return ids.astype(np.uint16) if int(ids.max()) < IDS else ids


def records(batches: Iterator[pa.RecordBatch], path: str, end_id: int, proven: Broadcast) -> Iterator[pa.RecordBatch]:
    memo, end = Memo(path, same, proven.value), end_id.to_bytes(4, "little")
    docs: list[tuple[int | None, int]] = []
    parts: list[np.ndarray] = []
    size = 0

    def group() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        parts.clear()
        out = b"\n".join(group_records(docs, ids))
        docs.clear()
        return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["records"])

    for batch in batches:
        for doc_id, (_, values) in zip(batch.column(0).to_pylist(), of_column(batch.column(1), memo)):
            own = b"".join(values) + end
            docs.append((doc_id, len(own) // 4))
            parts.append(narrow(np.frombuffer(own, "<u4")))
            size += len(own)
            if size >= 4 * BLOCK * LANES:
                yield group()
                size = 0
    if docs:
        yield group()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents into token files under `path`."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text").select("id", F.col("text").cast("binary"))
    proven = proof(docs.sparkSession, tokenizer)
    coded = ordered.mapInArrow(lambda b: records(b, tokenizer, end_id, proven), "records binary")
    with writing(docs.sparkSession):
        coded.select(F.col("records").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", PER_FILE).text(path)


def parse(data: bytes | pa.Buffer) -> Iterator[tuple[list[tuple[int | None, int]], list[tuple[int, bytes, int]]]]:
    """(documents, blocks) of each group in a file."""
    data, at, docs, blocks = memoryview(data), 0, [], []
    while at < len(data):
        magic, kind, n, size, crc = HEAD.unpack_from(data, at)
        payload = data[at + HEAD.size : at + HEAD.size + size]
        at += HEAD.size + size + 1
        if magic != MAGIC or len(payload) < size:
            raise ValueError("not a token file, or a cut one")
        if kind == b"D":
            if docs:
                yield docs, blocks
            if zlib.crc32(payload) != crc:
                raise ValueError("document list fails its checksum")
            docs, blocks = unindex(n, payload), []
        else:
            blocks.append((n, payload, crc))
    if docs:
        yield docs, blocks


def ids_of(blocks: list[tuple[int, bytes, int]]) -> np.ndarray:
    """Two-byte ids of a group, LANES blocks decoded at once."""
    ids, at = np.empty(sum(n for n, _, _ in blocks), np.uint16), 0
    for k in range(0, len(blocks), LANES):
        some = blocks[k : k + LANES]
        for row, (n, _, crc) in zip(decode_blocks([b for _, b, _ in some], max(n for n, _, _ in some)), some):
            if zlib.crc32(row[:n].astype("<u4").tobytes()) != crc:
                raise ValueError("token block fails its checksum")
            ids[at : at + n] = row[:n]
            at += n
    return ids


FIELDS = "file string, row long, doc_id long, start long, n_tokens long, ids_crc32 long"


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each file with their place in it and the checksum of their decoded ids."""
    for batch in batches:
        for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            row = start = 0
            for docs, blocks in parse(data.as_buffer()):
                ids, n = ids_of(blocks), np.array([c for _, c in docs])
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends - n, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(docs)), pa.array(np.arange(row, row + len(docs))), pa.array([i for i, _ in docs], pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["file", "row", "doc_id", "start", "n_tokens", "ids_crc32"],
                )
                row, start = row + len(docs), start + int(ends[-1])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document over all files), n_tokens, ids_crc32, decoded from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = stored(files.mapInArrow(documents, FIELDS), "token-rows")
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy(number(r"part-(\d+)[^/]*$"), number(r"-c(\d+)[^/-]*$")).rowsBetween(Window.unboundedPreceding, -1)  # the job's id between the two may hold a -c1 too
    offsets = totals.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(offsets, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, *, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the token files (a new shared folder unless `path` is given) and return what reading them back finds."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id=end_id)
    return read_tokens(spark, path)
