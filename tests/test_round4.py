"""Whole pair sets, and what bounds disk and driver where captures or pairs are many."""

import random

import pytest

from tests.conftest import compare
from tracelens import registry
from tracelens.functions import storage
from tracelens.operators import cross as X
from tracelens.plans import adapters as A
from tracelens.sources import captures as C
from tracelens.sources import trace_csv as V


def test_every_trace_meets_every_other(spark, data):
    traces = {r.trace_id for r in A.completed(spark, data).select("trace_id").distinct().collect()}
    found = registry.QUERIES["h23_standardised_distance"](spark, data).select("a", "b").collect()
    assert len(found) == len(traces) * (len(traces) - 1) and {(r.a, r.b) for r in found} == {(a, b) for a in traces for b in traces if a != b}


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_pairs_of_blocks_are_made_without_an_exchange(spark, broadcast):
    rng = random.Random(4)
    points = {t: {f: rng.uniform(-2, 2) for f in "abc"} for t in range(41)}
    z = spark.createDataFrame([(t, f, v) for t, p in points.items() for f, v in p.items()], "trace_id LONG, feature STRING, z DOUBLE")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        apart = X.distances(z, block=8)
        assert apart.inputFiles() and "Exchange hashpartitioning" not in apart._jdf.queryExecution().executedPlan().toString()
        found = {(r.a, r.b): r.distance for r in apart.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {(a, b): pytest.approx(sum((points[a][f] - points[b][f]) ** 2 for f in "abc") ** 0.5) for a in points for b in points if a != b}


@pytest.mark.parametrize("name, module, reader, files", [("a7_listed_captures", C, "listed", 3), ("a10_sample_inventory", C, "inventory", 1), ("a8_file_quarantine", V, "file_checks", 1)])
def test_the_driver_lists_the_files_of_a_lot_alone(spark, data, monkeypatch, name, module, reader, files):
    """Lots are dealt by a hash, so that one may have some more keys than others; all files are listed once."""
    seen, read = [], getattr(module, reader)
    monkeypatch.setattr(storage, "PER_LOT", 5)
    monkeypatch.setattr(module, reader, lambda spark, root, *x, **y: seen.append(len(read(spark, root, *x, **y).inputFiles())) or read(spark, root, *x, **y))
    compare(spark, name, data)
    assert len(seen) >= 2 and max(seen) <= 3 * files * 5 and max(seen) < sum(seen)
