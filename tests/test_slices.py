"""Sliced prefix scans against plain windows: one trace has half of all reads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracelens.operators import regions as R
from tracelens.operators import sequence as Q
from tracelens.operators import slices
from tracelens.operators import statistics as S
from tracelens.plans import adapters as A

READS = "trace_id LONG, event_order LONG, ts TIMESTAMP, read_offset LONG, length LONG, file_id LONG, file_size LONG"
OPERATORS = {
    "read_sequence": Q.read_sequence, "sequential_metrics": Q.sequential_metrics, "scan_passes": Q.scan_passes, "pass_labels": Q.pass_labels, "drop_passes": Q.drop_passes, "time_stages": Q.time_stages,
    "byte_coverage": S.byte_coverage, "merge_ranges": S.merge_ranges, "annotated": Q.annotated,
}


def reads(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for trace, n in ((1, 1500), (2, 400), (3, 300), (4, 700), (None, 60), (5, 1), (6, 2)):
        us = 0
        for k in range(n):
            us += rng.choice([0, 0, 1, 3, 40, 90_000])
            rows.append((trace, k, start + dt.timedelta(microseconds=us), rng.choice([0, 4096, 8192, 150_000, rng.randrange(1_000_000)]), rng.choice([512, 4096, 65536]), 1, 1_048_576))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, READS).repartition(5)


@pytest.fixture()
def hot(monkeypatch):
    def switch(on):
        monkeypatch.setattr(slices, "HOT_ROWS", 500 if on else 1 << 40)
        monkeypatch.setattr(slices, "MOST_HOT", 4)
        monkeypatch.setattr(slices, "SLICES", 16)

    return switch


@pytest.mark.parametrize("name", sorted([*OPERATORS, "region_coverage"]))
def test_a_hot_trace_gives_the_same_rows(spark, hot, name):
    frame = reads(spark)
    run = OPERATORS.get(name, lambda f: R.region_coverage(f, A.regions(spark)))
    rows = lambda: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in run(frame).collect()), key=repr)
    hot(False)
    plain = rows()
    hot(True)
    assert rows() == plain and plain


def test_a_hot_trace_is_spread(spark, hot):
    hot(True)
    cut = slices.cut(reads(spark), ["trace_id"], F.unix_micros("ts"))
    counts = {r._slice: r["count"] for r in cut.where("trace_id = 1").groupBy("_slice").count().collect()}
    assert len(counts) >= 14 and max(counts.values()) < 300
    assert cut.where("trace_id <> 1").select("_slice").distinct().count() == 1
    plan = Q.sequential_metrics(reads(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan and "Window [lag" in plan


def test_without_hot_traces_there_are_no_slices(spark, hot):
    hot(False)
    assert "_slice" not in slices.cut(reads(spark), ["trace_id"], F.unix_micros("ts")).columns


def test_components_against_numpy(spark):
    import numpy as np

    from tracelens.operators import cross as X

    rng = np.random.default_rng(5)
    made = rng.normal(size=(80, 4)) @ np.array([[3, 1, 0, 0], [0, 1, 2, 0], [0, 0, 0.3, 1], [1, 0, 0, 0.1]])
    made -= made.mean(axis=0)
    z = spark.createDataFrame([(k, f"f{c}", float(made[k, c])) for k in range(80) for c in range(4)], "trace_id INT, feature STRING, z DOUBLE").repartition(4)
    axes = np.linalg.eigh(made.T @ made / 80)[1][:, ::-1].T
    axes = np.array([v * np.sign(v[np.abs(v).argmax()]) for v in axes])
    assert np.allclose(X.principal_components(z, 3), axes[:3], atol=1e-9)
    found = np.array([(r.pc1, r.pc2) for r in X.pca_projection(z).orderBy("trace_id").collect()])
    assert np.allclose(found, made @ axes[:2].T, atol=1e-9)
    assert X.pca_projection(z.limit(0)).count() == 0
    one = X.pca_projection(z.where("feature = 'f0'")).orderBy("trace_id").collect()
    assert np.allclose([r.pc1 for r in one], made[:, 0]) and {r.pc2 for r in one} == {None}


@pytest.mark.parametrize("on", [False, True])
def test_measures_off_shared_counts_are_those_of_the_operators(spark, hot, on):
    frame = reads(spark).where("trace_id IS NOT NULL")
    hot(False)
    coverage = S.byte_coverage(frame).select("trace_id", (100 * F.col("coverage")).alias("coverage_pct"))
    want = S.read_stats(frame)
    for part in (coverage, S.block_coverage(frame).select("trace_id", "block_coverage_pct"), S.offset_entropy(frame), S.alignment(frame), S.read_size_stats(frame)):
        want = want.join(part, "trace_id")
    rows = lambda df: [{k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.orderBy("trace_id").collect()]
    want = rows(want)
    hot(on)
    assert [r.asDict() for r in S.counted_measures(frame).orderBy("trace_id").collect()] == want
    assert len(want) == 6


def test_trace_metrics_scan_the_reads_once_for_each_order(spark, hot, data):
    from tracelens.operators import cross as X

    hot(False)
    plan = X.trace_metrics(A.completed(spark, data), A.regions(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") <= 3


def test_percentiles_of_lengths_are_interpolated(spark):
    rows = [(1, v) for v in [10, 10, 10, 20, 400]] + [(2, 7), (3, None), (3, 1), (3, 2)]
    found = {r.trace_id: tuple(r)[1:] for r in S.size_distribution(spark.createDataFrame(rows, "trace_id LONG, length LONG")).collect()}
    assert found[1] == pytest.approx((10, 10, 10, 20, 324)) and found[2] == (7.0,) * 5 and found[3] == pytest.approx((1.05, 1.25, 1.5, 1.75, 1.95))
