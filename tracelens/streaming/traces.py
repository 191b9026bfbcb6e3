"""Structured Streaming forms of parsing, of timing and of trace completion.

A capture tool cuts a trace into numbered parts. stream_timed() gives arriving parts the day, the passing of midnight and
the event order that trace_csv.timed() gives to a finished set of files: its state per trace is the next part's number,
the last time of day, the days passed, the reads so far, and the rows of parts that came before their turn. Those wait
for the parts that are missing; a file with nothing but its header counts as a part. A part whose number has already passed
is put out as it is, with `ts` and `event_order` null, so that nothing is lost unseen. A task holds what one trace brings in one
micro-batch, which `files` bounds.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import trace_csv

#: Where the number of a part stands in its file's path: behind the trace's number in the name, or in the name of a folder.
PART_IN_NAME, PART_IN_FOLDER = r"(\d+)[^/\d]*$", r"part=(\d+)/[^/]*$"
TRACE_IN_NAME, TRACE_IN_FOLDER = r"(\d+)-\d+[^/\d]*$", r"trace_id=(\d+)/[^/]*/[^/]*$"


def stream_raw(spark: SparkSession, folder: str, *, trace: str = trace_csv.IN_NAME, part: str | None = None, header: bool = True, files: int = 10_000, packed: bool = False) -> DataFrame:
    """Raw rows of the CSV files that arrive in a folder, `files` of them in a micro-batch at most; with header=False header lines are rows too.

    In `packed` files (trace_csv.pack) the numbers of trace and part are in the row; a part lies in one file.
    """
    rows = spark.readStream.schema(trace_csv.PACKED if packed else trace_csv.RAW).option("header", header).option("quote", '"').option("escape", '"').option("maxFilesPerTrigger", files).csv(folder)
    number = lambda pattern, column: (F.col(column) if packed else F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)).try_cast("long")
    place = [number(part, "Part").alias("part"), F.col("_metadata.file_block_start").alias("block")] if part else []
    return rows.select(number(trace, "Capture").alias("trace_id"), *[F.col(f"`{h}`").alias(n) for h, n in zip(trace_csv.HEADERS, trace_csv.NAMES)], *place)


def stream_reads(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse what has arrived and append it to Parquet; started with the same checkpoint it goes on where it was."""
    return trace_csv.reads(stream_raw(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PARSED = "trace_id LONG, part LONG, block LONG, line LONG, is_header BOOLEAN, process_name STRING, process_id INT, operation STRING, path STRING, result STRING, us_of_day LONG, read_offset LONG, length LONG"
TIMED = "trace_id LONG, event_order LONG, days LONG, us_of_day LONG, process_name STRING, process_id INT, operation STRING, path STRING, result STRING, read_offset LONG, length LONG"
STATE = "next_part LONG, last_us LONG, days LONG, reads LONG, held BINARY"


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`line` rises with the rows that a task reads; a block is read by one task."""
    at = 0
    for batch in batches:
        yield batch.append_column("line", pa.array(np.arange(at, at + len(batch)), pa.int64()))
        at += len(batch)


def walked(rows: pd.DataFrame, last: int | None, days: int, reads: int) -> tuple[pd.DataFrame, int | None, int]:
    """The reads of parts in order with the days passed and their numbers, the last time of day, the days by then."""
    if rows.empty:
        return rows, last, days
    us = rows["us_of_day"].to_numpy(np.int64)
    before = np.concatenate([[us[0] if last is None else last], us[:-1]])
    passed = days + np.cumsum(before - us > trace_csv.DAY_US // 2)
    return rows.assign(days=passed, event_order=np.arange(reads + 1, reads + 1 + len(us))), int(us[-1]), int(passed[-1])


def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a micro-batch adds to a trace: the reads of all parts whose turn has come."""
    next_part, last, days, reads, held = state.get if state.exists else (0, None, 0, 0, b"")
    rows = pd.concat([*([pd.read_parquet(io.BytesIO(held))] if held else []), *frames], ignore_index=True)
    here = set(rows["part"].tolist())
    upto = next_part
    while upto in here:
        upto += 1
    due = rows[(rows["part"] >= next_part) & (rows["part"] < upto) & ~rows["is_header"]].sort_values(["part", "block", "line"], kind="stable")
    passed = rows[(rows["part"] < next_part) & ~rows["is_header"]].assign(days=None, event_order=None)
    out, last, days = walked(due, last, days, reads)
    wait = rows[rows["part"] >= upto]
    sink = io.BytesIO()
    if not wait.empty:
        wait.to_parquet(sink, index=False)
    state.update((upto, last, days, reads + len(due), sink.getvalue()))
    names = [c.split()[0] for c in TIMED.split(", ")]
    for found in (out, passed):
        if not found.empty:
            yield found[names]


def stream_timed(spark: SparkSession, folder: str, captures: DataFrame, *, trace: str = TRACE_IN_NAME, part: str = PART_IN_NAME, files: int = 10_000, packed: bool = False) -> DataFrame:
    """The streaming twin of trace_csv.timed(): reads of arriving parts (numbered from 0) with ts, event_order, file_id and file_size.

    captures: trace_id, day, file_id, file_size, one row per trace. In packed files a part without rows is a line of its numbers and the seven headers.
    """
    raw = stream_raw(spark, folder, trace=trace, part=part, header=False, files=files, packed=packed)
    header = F.coalesce((F.col("time_of_day") == trace_csv.HEADERS[0]) & (F.col("operation") == trace_csv.HEADERS[3]), F.lit(False))
    rows = trace_csv.parsed(raw.withColumn("is_header", header), besides=F.col("is_header")).where("reason IS NULL OR is_header").where("trace_id IS NOT NULL AND part IS NOT NULL")
    names = [c.split()[0] for c in PARSED.split(", ") if not c.startswith("line")]
    placed = rows.select(*names).mapInArrow(numbered, ", ".join([*(c for c in PARSED.split(", ") if not c.startswith("line")), "line LONG"]))
    timed = placed.groupBy("trace_id").applyInPandasWithState(follow, TIMED, STATE, "append", GroupStateTimeout.NoTimeout)
    since = timed.withColumn("us", F.col("days") * trace_csv.DAY_US + F.col("us_of_day")).drop("days", "us_of_day")  # of the day; a join takes no rows straight from Python
    joined = since.join(captures.select("trace_id", "day", "file_id", "file_size"), "trace_id", "left")
    midnight = F.unix_micros(F.coalesce("day", F.lit("1970-01-01").cast("date")).cast("timestamp"))
    return joined.withColumn("ts", F.timestamp_micros(midnight + F.col("us"))).drop("day", "us")


def append_timed(spark: SparkSession, folder: str, captures: DataFrame, out: str, checkpoint: str, **options: str | int) -> StreamingQuery:
    """Append to Parquet what has arrived; started with the same checkpoint it goes on where it was, state included."""
    return stream_timed(spark, folder, captures, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(reads: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Reads and bytes per trace and event-time window; works on batches and streams."""
    return reads.withWatermark("ts", late).groupBy("trace_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("reads"), F.sum("length").alias("bytes"))


def sessions(reads: DataFrame, gap: str | Column = "6 hours", late: str = "1 hour") -> DataFrame:
    """A trace's activity between quiet times of `gap`; a stream emits one once the watermark has passed its end."""
    return reads.withWatermark("ts", late).groupBy("trace_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("reads"), F.sum("length").alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
