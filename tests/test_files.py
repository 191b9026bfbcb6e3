"""Capture files judged one by one, listings, and the store of nested results."""

import pytest
from pyspark.sql import functions as F

from tracelens.functions import storage
from tracelens.sources import captures as C
from tracelens.sources import sinks as K
from tracelens.sources import trace_csv as V

HEAD = ",".join(V.HEADERS)
ROW = '"10:30:45.1234567","a.exe","12","ReadFile","C:\\x, ""y""","SUCCESS","Offset: 0, Length: 4,096"'


def test_bad_files_do_not_fail_the_others(spark, tmp_path):
    files = {
        "1.csv": "\ufeff" + HEAD + "\n" + ROW + "\n", "2.csv": HEAD.replace("PID", "Pid No") + "\n" + ROW + "\n", "3.csv": HEAD + "\n" + ROW + "\n" + ROW[:-9], "4.csv": HEAD + "\r\n" + ROW + "\r\n\r\n", "5.csv": "",
        "6.csv": HEAD + "\n", "7.csv": ROW + "\n", "9.csv": HEAD + "\n" + ROW.replace("4,096", "none") + "\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "8.csv").write_bytes(HEAD.encode() + b"\n" + ROW.replace("x", "\u00e9").encode("latin-1") + b"\n")
    checks = V.file_checks(spark, str(tmp_path))
    assert {r.trace_id: (r.rows, r.reason) for r in checks.collect()} == {
        1: (1, None), 2: (2, "header"), 3: (2, "cut line"), 4: (1, None), 6: (0, None), 7: (1, "header"), 8: (1, "encoding"), 9: (1, None)
    }
    reads = V.reads(V.scan_sound(spark, str(tmp_path), checks))
    assert sorted((r.trace_id, r.path, r.length) for r in reads.collect()) == [(1, 'C:\\x, "y"', 4096), (4, 'C:\\x, "y"', 4096)]
    captures = spark.createDataFrame([(k,) for k in range(1, 11)], "capture_id LONG")
    status = {r.capture_id: (r.ok, r.error, r.reads) for r in C.file_status(captures, checks, reads).collect()}
    good, gone, none = (True, "", 1), (False, "no events file", 0), (False, "no reads", 0)
    assert status == {1: good, 4: good, 5: gone, 10: gone, 6: none, 9: none} | {k: (False, e, 0) for k, e in ((2, "header"), (3, "cut line"), (7, "header"), (8, "encoding"))}


def test_placed_rows_of_sound_files_can_be_timed(spark, tmp_path):
    late = [ROW.replace("10:30:45", t) for t in ("23:59:59", "00:00:01")]
    (tmp_path / "4.csv").write_text("\n".join([HEAD, *late]) + "\n")
    checks = V.file_checks(spark, str(tmp_path))
    captures = spark.createDataFrame([(4, None, 1, 10)], "trace_id LONG, day DATE, file_id LONG, file_size LONG")
    timed = V.timed(V.reads(V.scan_sound(spark, str(tmp_path), checks, placed=True)), captures)
    assert [(r.event_order, r.at) for r in timed.select("event_order", F.date_format("ts", "dd HH:mm:ss").alias("at")).orderBy("event_order").collect()] == [(1, "01 23:59:59"), (2, "02 00:00:01")]


def test_listing_opens_no_file(spark, tmp_path):
    for name, content in (("1/a.CSV", b"\xff\xfe"), ("1/s.exe", b"x"), ("2/a.csv", b"1"), ("2/s.exe", b""), ("3/readme.md", b"1")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    found = {r.capture_id: (r.has_events, r.has_sample, r.event_bytes) for r in C.listed(spark, str(tmp_path)).collect()}
    assert found == {1: (True, True, 2), 2: (True, False, 1), 3: (False, False, 0)}
    assert "content" not in C.listed(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_the_store_replaces_single_captures_and_takes_new_fields(spark, tmp_path):
    path = str(tmp_path / "store")
    old = spark.createDataFrame([(k, ([k, k + 1], {"a": k})) for k in range(4)], "trace_id LONG, result STRUCT<list: ARRAY<INT>, map: MAP<STRING, INT>>")
    K.replace(old, path)
    new = spark.createDataFrame([(2, ([9], {"b": 7}, "x"))], "trace_id LONG, result STRUCT<list: ARRAY<INT>, map: MAP<STRING, INT>, note: STRING>")
    K.replace(new, path)
    found = {r.trace_id: (r.result.list, r.result.map, r.result.note) for r in K.load(spark, path).collect()}
    assert found == {0: ([0, 1], {"a": 0}, None), 1: ([1, 2], {"a": 1}, None), 2: ([9], {"b": 7}, "x"), 3: ([3, 4], {"a": 3}, None)}


def test_a_cluster_has_to_name_a_shared_folder(monkeypatch):
    class Cluster:
        conf, sparkContext = type("Conf", (), {"get": staticmethod(lambda key, default: default)}), type("Context", (), {"master": "spark://host:7077"})

    monkeypatch.setattr(storage.scratch, "base", "", raising=False)
    with pytest.raises(ValueError):
        storage.scratch(Cluster, "x")
