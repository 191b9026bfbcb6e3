"""Cases on small frames and randomised runs against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracelens.functions.constants import CHUNK_BANDS
from tracelens.operators import cross as X
from tracelens.operators import regions as R
from tracelens.operators import segments
from tracelens.operators import sequence as Q
from tracelens.operators import statistics as S
from tracelens.operators import timeline as L
from tracelens.sources import captures as C
from tracelens.sources import sinks as K
from tracelens.sources import trace_csv as V
from tracelens.sources.region_catalog import rva_to_offset
from tracelens.streaming import traces as T

START = datetime(2024, 1, 1)
SCHEMA = "trace_id LONG, event_order LONG, ts TIMESTAMP, read_offset LONG, length LONG, result STRING, operation STRING, file_id LONG, file_size LONG"


def reads(spark, traces, size=100_000):
    """traces: trace -> list of (microseconds, offset, length)."""
    rows = [(t, k, START + timedelta(microseconds=us), o, n, "SUCCESS", "ReadFile", 1, size) for t, events in traces.items() for k, (us, o, n) in enumerate(events)]
    return spark.createDataFrame(rows, SCHEMA)


def regions(spark, rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "file_id LONG, region_ord INT, region_name STRING, start_offset LONG, end_offset LONG")


def random_traces(seed, traces=40, most=30):
    rng = random.Random(seed)
    return {t: [(rng.randrange(15), rng.randrange(0, 60_000, 512), rng.choice([1, 512, 4096, 9000])) for _ in range(rng.randrange(1, most))] for t in range(traces)}


def ordered(traces):
    return {t: sorted(e, key=lambda x: x[0]) for t, e in traces.items()}


def test_read_stats_and_repeats(spark):
    row = S.read_stats(reads(spark, {1: [(0, 0, 10), (1, 0, 10), (2, 50, 30)]}, size=100)).first()
    assert (row.total_reads, row.unique_offsets, row.repeated_reads, row.bytes_read, row.read_amplification) == (3, 2, 1, 50, 0.5)


def test_empty_reads_give_no_rows(spark):
    empty, none = reads(spark, {}), regions(spark, [("A", 0, 9)])
    for frame in (S.read_stats(empty), S.read_size_stats(empty), S.byte_coverage(empty), Q.scan_passes(empty), Q.time_stages(empty), R.region_statistics(empty, none), L.detect_phases(L.timeline(empty, none)), S.length_bands(empty)):
        assert frame.count() == 0


@pytest.mark.parametrize("values, q1, q3", [([1, 2, 3, 4, 6], 1.5, 5.0), ([7], 7.0, 7.0), ([1, 2], 0.75, 2.25)])
def test_exclusive_quartiles(spark, values, q1, q3):
    row = S.read_size_stats(reads(spark, {1: [(k, k, v) for k, v in enumerate(values)]})).first()
    assert (row.q1_read, row.q3_read) == (q1, q3)


def test_mode_takes_the_least_of_ties(spark):
    row = S.read_size_stats(reads(spark, {1: [(0, 0, 9), (1, 0, 9), (2, 0, 4), (3, 0, 4), (4, 0, 1)]})).first()
    assert (row.mode_read, row.mode_count) == (4, 2)


def test_boundary_reads_touch_both_regions(spark):
    r = regions(spark, [("DOS Header", 0, 63), ("DOS Stub", 64, 127), ("NT Headers", 128, 151)])
    found = {(x.read_offset, x.region_name) for x in R.overlap(reads(spark, {1: [(0, 60, 8), (1, 124, 8), (2, 127, 1)]}), r).collect()}
    assert found == {(60, "DOS Header"), (60, "DOS Stub"), (124, "DOS Stub"), (124, "NT Headers"), (127, "DOS Stub")}


def test_long_region_that_starts_far_earlier(spark):
    r = regions(spark, [(".text", 1024, 3_638_783), ("TLS Directory", 92_504, 92_527), ("Debug Directory", 238_544, 238_627)])
    assert [x.region_name for x in R.overlap(reads(spark, {1: [(0, 524_288, 4096)]}), r).collect()] == [".text"]


def test_shares_of_reads_may_sum_over_100(spark):
    r = regions(spark, [("A", 0, 99), ("B", 100, 299)])
    rows = {x.region_name: x for x in R.region_statistics(reads(spark, {1: [(0, 50, 100)]}), r).collect()}
    assert rows["A"].pct_reads == rows["B"].pct_reads == 100 and rows["A"].pct_bytes == 50


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_against_brute_force(spark, seed):
    traces, rng = random_traces(seed), random.Random(seed)
    spans = [(f"r{k}", s := rng.randrange(60_000), s + rng.randrange(1, 20_000)) for k in range(12)]
    want = sorted((t, k, n) for t, e in traces.items() for k, (_, o, size) in enumerate(e) for n, s, x in spans if o <= x and o + size - 1 >= s)
    frame, table = reads(spark, traces), regions(spark, spans)
    assert sorted((x.trace_id, x.event_order, x.region_name) for x in R.overlap(frame, table, "inner").collect()) == want
    assert sorted((x.trace_id, x.event_order, x.region_name) for x in R.overlap_binned(frame, table, 4096).collect()) == want
    lone = sum(len(e) for e in traces.values()) - len({(t, k) for t, k, _ in want})
    assert R.unmapped(frame, table).count() == lone
    both = R.overlap_binned(frame, table, 512, "left").collect()
    assert sorted((x.trace_id, x.event_order, x.region_name) for x in both if x.region_name) == want and sum(x.region_name is None for x in both) == lone


@pytest.mark.parametrize("seed", [3, 4])
def test_coverage_against_byte_sets(spark, seed):
    traces = random_traces(seed)
    want = {t: len({b for _, o, n in e for b in range(o, o + n)}) for t, e in traces.items()}
    assert {x.trace_id: x.covered for x in S.byte_coverage(reads(spark, traces)).collect()} == want


@pytest.mark.parametrize("seed", [5, 6])
def test_passes_and_stages_against_loops(spark, seed):
    traces = random_traces(seed)
    passes, stages = {}, {}
    for t, events in ordered(traces).items():
        offsets, most, starts = [o for _, o, _ in events], None, []
        for k, o in enumerate(offsets):
            if k == 0 or (o < most and offsets[k - 1] >= most):
                starts.append(k)
            most = o if most is None else max(most, o)
        passes[t] = ";".join(map(str, starts))
        gaps = sorted(b[0] - a[0] for a, b in zip(events, events[1:]))
        stages[t] = 1
        if len(events) >= 3:
            n = len(gaps)
            middle = (gaps[(n - 1) // 2] + gaps[n // 2]) / 2
            stages[t] += sum(b[0] - a[0] > max(10 * middle, 500) for a, b in zip(events, events[1:]))
    frame = reads(spark, traces)
    assert {x.trace_id: x.pass_starts for x in Q.scan_passes(frame).collect()} == passes
    found = Q.time_stages(frame).groupBy("trace_id").agg(F.max("stage").alias("s")).collect()
    assert {x.trace_id: x.s for x in found} == stages


def test_stage_cut_at_ten_times_the_median_gap(spark):
    rows = Q.time_stages(reads(spark, {1: [(0, 0, 1), (100, 0, 1), (200, 0, 1), (5000, 0, 1), (5100, 0, 1)]})).orderBy("stage").collect()
    assert [(x.start_idx, x.end_idx, x.events) for x in rows] == [(0, 2, 3), (3, 4, 2)]


def test_chunk_cycles_do_not_overlap(spark):
    at, events = 0, []
    for k in range(7):
        events.append((k, at, 8))
        at += 8
    assert Q.chunk_cycle(reads(spark, {1: events, 2: [(0, 0, 8)]}), (8, 8, 8)).orderBy("trace_id").select("cycles").collect() == [(2,), (0,)]


def brute_phases(entries, rules):
    claimed, out = set(), []
    for name, required, optional, least in rules:
        own = [e for e in entries if e[1] in set(required) | set(optional) and e[0] not in claimed]
        seen = list(dict.fromkeys(r for _, r in own if r in optional))
        have = {r for _, r in own}
        if own and len(own) >= least and set(required) <= have and seen == [r for r in optional if r in have]:
            out.append((name, own[0][0], own[-1][0], len(own)))
            claimed |= {us for us, _ in own}
    return sorted(out, key=lambda p: p[1]), claimed


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_phases_against_the_sequential_rules(spark, seed):
    rng = random.Random(seed)
    rules = [("one", ["A", "B"], [], 1), ("two", ["C"], ["A", "D"], 2), ("empty", [], [], 1), ("three", [], ["D", "B"], 3), ("four", ["A"], [], 1)]
    lists = {t: [(rng.randrange(8), rng.choice("ABCDE")) for _ in range(rng.randrange(1, 12))] for t in range(60)}
    lists = {t: sorted(e, key=lambda x: x[0]) for t, e in lists.items()}
    rows = [(t, k + 1, r, us, 0, 1) for t, e in lists.items() for k, (us, r) in enumerate(e)]
    entries = spark.createDataFrame(rows, "trace_id LONG, pos INT, region STRING, us LONG, read_offset LONG, length LONG")
    found = {}
    for x in L.detect_phases(entries, rules).orderBy("trace_id", "phase_ord").collect():
        found.setdefault(x.trace_id, []).append((x.phase, x.start_us, x.end_us, x.entry_count))
    want = {t: p for t, e in lists.items() if (p := brute_phases(e, rules)[0])}
    assert found == want
    score = {x.trace_id: x.confidence for x in L.phase_confidence(entries, rules).collect()}
    for t, e in lists.items():
        phases, claimed = brute_phases(e, rules)
        expected = 0.4 * len(phases) / len(rules) + 0.4 * len(claimed) / len({us for us, _ in e}) + 0.2 / (1 + len(phases)) if phases else 0.0
        assert abs(score[t] - expected) < 1e-9


def test_first_rule_claims_shared_timestamps(spark):
    r = regions(spark, [(".text", 0, 9), ("B", 10, 19)])
    entries = L.timeline(reads(spark, {1: [(0, 5, 10), (1, 3, 1)]}), r)
    found = L.detect_phases(entries, [("first", [".text"], [], 1), ("second", ["B"], [], 1)]).collect()
    assert [x.phase for x in found] == ["first"]


def test_timeline_keeps_input_order_of_ties_and_microseconds(spark):
    r = regions(spark, [("A", 0, 9), ("B", 10, 19)])
    rows = L.timeline(reads(spark, {1: [(1, 10, 1), (0, 0, 1), (1, 0, 1), (2, 50, 1)]}), r).orderBy("pos").collect()
    assert [x.region for x in rows] == ["A", "B", "A", "Unmapped"]
    assert L.timeline_summary(L.timeline(reads(spark, {1: [(0, 0, 1), (1, 10, 1)]}), r)).first().duration_us == 1


RAW_ROW = ("10:30:45.1234567", "scanner.exe", "1234", "ReadFile", "C:\\a\\test.dll", "SUCCESS", "Offset: 0x0, Length: 4,096")


def raw(spark, *changes):
    rows = [(1, *(c.get(n, v) for n, v in zip(V.NAMES, RAW_ROW))) for c in changes]
    return spark.createDataFrame(rows, "trace_id LONG, " + ", ".join(f"{n} STRING" for n in V.NAMES))


@pytest.mark.parametrize(
    "change, us, offset, length",
    [({}, 37_845_123_456, 0, 4096), ({"detail": "Offset: 0x100, Length: 0x1000"}, 37_845_123_456, 256, 4096), ({"detail": "offset: 0, length: 4096"}, 37_845_123_456, 0, 4096), ({"time_of_day": "11:38:55.7784472 PM"}, 85_135_778_447, 0, 4096), ({"time_of_day": "12:00:00 AM"}, 0, 0, 4096), ({"time_of_day": "12:00:00 PM"}, 43_200_000_000, 0, 4096)],
)
def test_parse(spark, change, us, offset, length):
    row = V.reads(raw(spark, change)).first()
    assert (row.us_of_day, row.read_offset, row.length) == (us, offset, length)


@pytest.mark.parametrize(
    "change, reason",
    [({"time_of_day": "not-a-timestamp"}, "timestamp"), ({"pid": "not-a-pid"}, "pid"), ({"pid": "0"}, "pid"), ({"detail": "Length: 0x100"}, "offset"), ({"detail": "Offset: 0x0"}, "length"), ({"detail": "Offset: 0, Length: 0"}, "length"), ({"path": " "}, "empty field"), ({"detail": None}, "offset")],
)
def test_rejects(spark, change, reason):
    frame = raw(spark, change, {})
    assert [x.reason for x in V.rejects(frame).collect()] == [reason]
    assert V.reads(frame).count() == 1
    with pytest.raises(Exception, match="bad row"):
        V.reads(frame, strict=True).collect()


def test_other_operations_are_skipped_not_rejected(spark):
    frame = raw(spark, {"operation": "QueryDirectory", "detail": "Pattern: *.*"}, {"operation": "readfile"})
    assert V.reads(frame).count() == V.rejects(frame).count() == 0


def test_scan_drops_the_byte_order_mark_and_checks_headers(spark, tmp_path):
    good = ",".join(V.HEADERS) + '\n10:30:45.1234567,a.exe,12,ReadFile,C:\\x,SUCCESS,"Offset: 0, Length: 4,096"\n'
    (tmp_path / "000007_filtered.csv").write_text("\ufeff" + good, encoding="utf-8")
    rows = V.reads(V.scan(spark, str(tmp_path))).collect()
    assert [(x.trace_id, x.length) for x in rows] == [(7, 4096)]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "1.csv").write_text(good.replace("PID", "Pid No"))
    with pytest.raises(Exception):
        V.scan(spark, str(bad)).collect()


def test_inventory_and_metadata(spark, tmp_path):
    for name, text in (("a/b/x.exe", "eighteen bytes ok!"), ("a/c/y.SYS", "MZ"), ("z.dll", "1"), ("notes.txt", "no")):
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = C.inventory(spark, str(tmp_path / "tree")).orderBy("relative_path").collect()
    assert [(x.relative_path, x.size, x.category, len(x.sha256)) for x in rows] == [("a/b/x.exe", 18, "a", 64), ("a/c/y.SYS", 2, "a", 64), ("z.dll", 1, "", 64)]
    for k, text in (("000001", '{"experiment_id": 1, "sample": "s", "size": 5}'), ("000002", "{broken")):
        p = tmp_path / "exp" / k
        p.mkdir(parents=True)
        (p / "metadata.json").write_text(text)
        (p / "manifest.json").write_text('{"experiment": 1, "status": "completed"}')
    found = {x.capture_id: x for x in C.metadata(spark, str(tmp_path / "exp")).collect()}
    assert found[1]["sample"] == "s" and found[2]["sample"] == "unknown" and found[1].category == "unknown"
    assert {x.status for x in C.manifests(spark, str(tmp_path / "exp")).collect()} == {"completed"}


def test_store_round_trip_keeps_nested_types(spark, tmp_path):
    frame = S.length_bands(reads(spark, {1: [(0, 0, 600)]})).groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("band", "reads"))).alias("m"))
    K.save(frame, str(tmp_path / "store"))
    assert K.load(spark, str(tmp_path / "store")).first().m["513B-1K"] == 1 and len(frame.first().m) == len(CHUNK_BANDS)
    K.write_csv(frame, str(tmp_path / "csv"))
    assert "513B-1K=1" in "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))


def test_stream_emits_a_quiet_trace_after_the_watermark(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    frame = reads(spark, {1: [(0, 0, 1), (1_000_000, 0, 1)]})
    frame.write.mode("append").parquet(source)

    def step():
        stream = T.sessions(spark.readStream.schema(frame.schema).parquet(source), "10 seconds", "0 seconds")
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()

    step()
    reads(spark, {2: [(3_600_000_000, 0, 1)]}).write.mode("append").parquet(source)
    step()
    rows = spark.read.parquet(out).where("trace_id = 1").collect()
    assert [(x.reads, x.bytes) for x in rows] == [(2, 2)]


def test_correlation_of_a_constant_metric_is_zero(spark):
    metrics = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 3.0, 5.0)], "trace_id LONG, a DOUBLE, b DOUBLE")
    assert X.correlation(metrics, ["a", "b"]).first().r == 0.0


def test_clusters_separate_two_groups(spark):
    rows = [(t, f, v) for t in range(8) for f, v in (("x", 0.0 if t < 4 else 10.0), ("y", float(t % 2)))]
    z = spark.createDataFrame(rows, "trace_id LONG, feature STRING, z DOUBLE")
    label = {x.trace_id: x.cluster for x in X.cluster_traces(z, most=3).collect()}
    assert len({label[t] for t in range(4)} & {label[t] for t in range(4, 8)}) == 0
    assert X.pca_projection(z).count() == 8


def test_quartiles_are_read_off_counts_ranged_over_tasks(spark, monkeypatch):
    import numpy as np

    rng, many = random.Random(21), []
    values = {"a": [rng.random() for _ in range(501)], "b": [float(rng.randrange(-3, 4)) for _ in range(400)], "c": [7.5], "d": [1.0, 2.0]}
    metrics = spark.createDataFrame([(k, *(v[k] if k < len(v) else None for v in values.values())) for k in range(501)], "trace_id LONG, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    monkeypatch.setattr(X, "kept", lambda df, name, kept=X.kept: many.append(kept(df, name)) or many[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summary, extremes, outliers = X.metric_summary(metrics, list(values)), X.metric_extremes(metrics, list(values)), X.iqr_outliers(metrics, list(values))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(df.select("slice").distinct().count() > 1 for df in many if "slice" in df.columns)
    for df in (summary, extremes, outliers):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan
    want = {k: np.percentile(v, [25, 50, 75]) for k, v in values.items()}
    assert {r.metric: (r.q1, r.median, r.q3) for r in summary.collect()} == {k: pytest.approx(tuple(w)) for k, w in want.items()}
    assert {r.metric: r.median for r in extremes.collect()} == {k: pytest.approx(w[1]) for k, w in want.items()}


def test_equal_reads_stay_apart_in_region_lookups(spark):
    reads = spark.createDataFrame([(1, 1, 7, 5)] * 3 + [(1, 2, 7, 999), (1, 3, 8, 5)], "trace_id LONG, event_order LONG, file_id LONG, read_offset LONG")
    regions = spark.createDataFrame([(7, 1, "b", 0, 9), (7, 0, "a", 4, 6)], "file_id LONG, region_ord INT, region_name STRING, start_offset LONG, end_offset LONG")
    found = R.point_region(reads, regions).collect()
    assert sorted((r.event_order, r.region) for r in found) == [(1, "a")] * 3 + [(2, "trailing"), (3, "Unknown")]
    rvas = spark.createDataFrame([(7, 15), (7, 15), (7, 3)], "file_id LONG, rva LONG")
    sections = spark.createDataFrame([(7, 0, 10, 10, 100)], "file_id LONG, section_ord INT, va LONG, vsize LONG, raw_ptr LONG")
    assert sorted(r.file_offset for r in rva_to_offset(rvas, sections).collect()) == [3, 105, 105]


def test_joins_by_bins_equal_joins_by_file(spark, monkeypatch):
    frame = reads(spark, {1: [(0, 0, 10), (1, 9_000_000, 40_000_000), (2, 2**40, 2**33), (3, 65_535, 1), (4, 65_536, 1), (5, 70_000, 5)]})
    table = regions(spark, [("a", 0, 65_535), ("b", 65_536, 65_536), ("c", 10_000_000, 70_000_000), ("d", 2**40 + 2**33 - 1, 2**40 + 2**33), ("none", 5, 4)])
    by_file = sorted(map(str, R.overlap(frame, table).collect())), R.unmapped(frame, table).count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(segments, "MANY", 0)
        assert (sorted(map(str, R.overlap(frame, table).collect())), R.unmapped(frame, table).count()) == by_file
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["c1_map_reads", "c2_unmapped_reads", "c3_range_map", "e1_region_statistics", "g1_timeline"])
def test_queries_by_bins_match_sql(spark, monkeypatch, name):
    from __spark_entry__ import queries
    from tests.conftest import compare

    found = [n for n in queries() if n.startswith(name.split("_")[0] + "_") and not n.endswith("files")]
    monkeypatch.setattr(segments, "MANY", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for each in found:
            compare(spark, each)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clusters_of_few_or_equal_traces_are_one(spark):
    schema = "trace_id LONG, feature STRING, z DOUBLE"
    for rows in ([], [(1, "x", 0.0)], [(1, "x", -1.0), (2, "x", 1.0)], [(t, "x", 0.0) for t in range(4)]):
        z = spark.createDataFrame(rows, schema)
        found = X.cluster_traces(z, traces=spark.createDataFrame([(t,) for t in {r[0] for r in rows} | {9}], "trace_id LONG")).collect()
        assert {(x.trace_id, x.cluster, x.k, x.silhouette) for x in found} == {(t, 0, 1, -1.0) for t in {r[0] for r in rows} | {9}}


def test_distances_in_blocks_against_loops(spark):
    rng = random.Random(3)
    points = {t: {f: rng.uniform(-2, 2) for f in "abc"} for t in range(30)}
    z = spark.createDataFrame([(t, f, v) for t, p in points.items() for f, v in p.items()], "trace_id LONG, feature STRING, z DOUBLE")
    found = {(r.a, r.b): r.distance for r in X.distances(z, F.col("trace_id") % 3 == 0, block=4).collect()}
    want = {(a, b): sum((points[a][f] - points[b][f]) ** 2 for f in "abc") ** 0.5 for a in range(0, 30, 3) for b in range(30) if a != b}
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    assert X.distances(z.where("trace_id < 0"), F.lit(True)).count() == 0


def test_times_of_files_pass_midnight_and_blocks(spark, tmp_path):
    line = '{},a.exe,12,ReadFile,C:\\x,SUCCESS,"Offset: {}, Length: 10"\n'
    times = ["11:59:58.0 PM", "11:59:59.0 PM", "12:00:01.0 AM", "12:00:00.5 AM", "6:00:00.0 PM", "1:00:00.0 AM"] * 40
    for k in ("000003", "000004"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "trace.csv").write_text(",".join(V.HEADERS) + "\n" + "".join(line.format(t, n) for n, t in enumerate(times)))
    (tmp_path / "000003" / "metadata.json").write_text('{"experiment_id": 3, "sample": "s", "size": 5000, "timestamp": "2024-02-28T10:00:00Z"}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = V.reads(V.scan(spark, f"{tmp_path}/*/*.csv", trace=V.IN_FOLDER, placed=True))
        assert rows.select("block").distinct().count() > 4
        found = V.timed(rows, C.facts(C.metadata(spark, str(tmp_path)))).orderBy("trace_id", "event_order").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    of_day = {"11:59:58.0 PM": 86398.0, "11:59:59.0 PM": 86399.0, "12:00:01.0 AM": 1.0, "12:00:00.5 AM": 0.5, "6:00:00.0 PM": 64800.0, "1:00:00.0 AM": 3600.0}
    day, before, want = 0, None, []
    for t in times:
        day += before is not None and before - of_day[t] > 43200
        before = of_day[t]
        want.append(timedelta(days=day, seconds=before))
    three, four = [r for r in found if r.trace_id == 3], [r for r in found if r.trace_id == 4]
    assert [r.ts - datetime(2024, 2, 28) for r in three] == want == [r.ts - datetime(1970, 1, 1) for r in four]
    assert [r.event_order for r in three] == list(range(1, len(times) + 1)) and [r.read_offset for r in three] == list(range(len(times)))
    assert {(r.file_id, r.file_size) for r in three} == {(3, 5000)} and {(r.file_id, r.file_size) for r in four} == {(None, None)}
