"""Streams of arriving trace files against the batch form."""

import datetime as dt

from pyspark.sql import functions as F

from tracelens.operators import statistics as S
from tracelens.sources import trace_csv as V
from tracelens.streaming import traces as T

HEAD = ",".join(f'"{h}"' for h in V.HEADERS)
CAPTURES = "trace_id LONG, day DATE, file_id LONG, file_size LONG"


def write(folder, name, rows):
    lines = [f'"{time}","scanner.exe","12","{op}","C:\\x","SUCCESS","Offset: {at}, Length: 4,096"' for time, op, at in rows]
    (folder / name).write_text("\n".join([HEAD, *lines]) + "\n")


def run(spark, folder, tmp_path):
    captures = spark.createDataFrame([(7, dt.date(2024, 2, 28), 1, 9000), (8, dt.date(2024, 1, 1), 2, 100)], CAPTURES)
    query = T.append_timed(spark, str(folder), captures, str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination()
    assert query.exception() is None
    rows = spark.read.parquet(str(tmp_path / "out")).select("trace_id", "event_order", "read_offset", F.date_format("ts", "MM-dd HH:mm:ss").alias("at"), "file_size")
    return sorted(tuple(r) for r in rows.where("event_order IS NOT NULL").collect()), rows.where("event_order IS NULL").count()


PARTS = {
    "7-0.csv": [("11:59:58.0000000 PM", "ReadFile", 0), ("11:59:59.0000000 PM", "CloseFile", 0), ("12:00:01.0000000 AM", "ReadFile", 1)],
    "7-1.csv": [],
    "7-2.csv": [("11:00:00.0000000 PM", "ReadFile", 2), ("zz", "ReadFile", 9), ("1:00:00.0000000 AM", "ReadFile", 3)],
    "7-3.csv": [("12:30:00.0000000 AM", "ReadFile", 4)],
    "8-0.csv": [("1:00:00.0000000 PM", "ReadFile", 5)],
    "9-1.csv": [("1:00:00.0000000 PM", "ReadFile", 6)],
}
SEVEN = [(7, 1, 0, "02-28 23:59:58", 9000), (7, 2, 1, "02-29 00:00:01", 9000), (7, 3, 2, "02-29 23:00:00", 9000), (7, 4, 3, "03-01 01:00:00", 9000), (7, 5, 4, "03-01 00:30:00", 9000)]


def test_parts_in_three_runs_one_past_midnight_one_late(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("7-0.csv", "7-3.csv", "8-0.csv", "9-1.csv"):
        write(folder, name, PARTS[name])
    first = [*SEVEN[:2], (8, 1, 5, "01-01 13:00:00", 100)]
    assert run(spark, folder, tmp_path) == (first, 0)  # part 3 waits for parts 1 and 2, trace 9 for its part 0
    write(folder, "7-2.csv", PARTS["7-2.csv"])
    assert run(spark, folder, tmp_path) == (first, 0)
    write(folder, "7-1.csv", PARTS["7-1.csv"])  # a header alone
    whole = sorted([*SEVEN, first[-1]])
    assert run(spark, folder, tmp_path) == (whole, 0)
    write(folder, "again-8-0.csv", PARTS["8-0.csv"])  # its turn has passed
    write(folder, "9-0.csv", [])
    assert run(spark, folder, tmp_path) == (sorted([*whole, (9, 1, 6, "01-01 13:00:00", None)]), 1)
    reads = spark.read.parquet(str(tmp_path / "out")).where("event_order IS NOT NULL")
    assert {r.trace_id: r.total_reads for r in S.read_stats(reads).collect()} == {7: 5, 8: 1, 9: 1}


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    parts = [[(f"{1 + (h * 7) % 12}:00:{s:02d}.0000000 {'AM' if h % 3 else 'PM'}", "ReadFile", h * 100 + s) for s in range(5)] for h in range(9)]
    for k, rows in enumerate(parts):
        write(folder, f"7-{k}.csv", rows)
    found, _ = run(spark, folder, tmp_path)
    one = tmp_path / "one"
    one.mkdir()
    write(one, "7.csv", [r for rows in parts for r in rows])
    captures = spark.createDataFrame([(7, dt.date(2024, 2, 28), 1, 9000)], CAPTURES)
    batch = V.timed(V.reads(V.scan(spark, str(one), placed=True)), captures).select("trace_id", "event_order", "read_offset", F.date_format("ts", "MM-dd HH:mm:ss").alias("at"), "file_size")
    assert found == sorted(tuple(r) for r in batch.collect()) and len(found) == 45


def test_windowed_counts(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, h), 10) for h in (1, 2, 23)] + [(1, dt.datetime(2024, 1, 2, 1), 5)], "trace_id LONG, ts TIMESTAMP, length LONG")
    assert sorted((r.w.start.day, r.reads, r.bytes) for r in T.windowed_counts(rows).collect()) == [(1, 3, 30), (2, 1, 5)]
