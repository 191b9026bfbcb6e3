"""Files with very many regions against brute force and against the path for few."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import compare
from tracelens.operators import regions as R
from tracelens.operators import segments
from tracelens.operators import sequence as Q

REGION = "file_id LONG, region_ord INT, region_name STRING, start_offset LONG, end_offset LONG"
READ = "trace_id LONG, event_order LONG, ts TIMESTAMP_NTZ, file_id LONG, file_size LONG, read_offset LONG, length LONG"


@pytest.fixture()
def many(monkeypatch):
    return lambda most: monkeypatch.setattr(segments, "MANY", most)


def tables(spark, seed):
    rng = random.Random(seed)
    spans = []
    for file, n in ((1, 60), (2, 5), (3, 1), (None, 2)):
        for k in range(n):
            start = rng.randrange(0, 3000)
            spans.append((file, k, f"r{rng.randrange(40)}", start, start + rng.choice([-1, 0, 3, 50, 2000])))
    reads = [(rng.randrange(4), k, None, rng.choice([1, 1, 2, 3, 4, None]), 5000, rng.choice([None, rng.randrange(6000), 0]), rng.choice([0, 1, 7, 400, 5000])) for k in range(400)]
    return spark.createDataFrame(reads + reads[:20], READ), spark.createDataFrame(spans, REGION)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_regions_give_the_rows_of_few(spark, many, seed):
    reads, regions = tables(spark, seed)
    runs = {
        "point": lambda: R.point_region(reads, regions), "inner": lambda: R.overlap(reads, regions, "inner"), "left": lambda: R.overlap(reads, regions), "anti": lambda: R.unmapped(reads, regions),
        "ladder": lambda: Q.access_ladder(reads, regions), "jumps": lambda: Q.jumps(reads.where("read_offset IS NOT NULL"), regions),
    }
    rows = lambda run: sorted((repr(r.asDict()) for r in run().collect()))
    many(1 << 40)
    few = {name: rows(run) for name, run in runs.items()}
    for most in (4, 0):
        many(most)
        assert {name: rows(run) for name, run in runs.items()} == few


def test_segments_against_brute_force(spark, many):
    _, regions = tables(spark, 5)
    spans = [r for r in regions.collect() if r.file_id == 1 and r.start_offset <= r.end_offset]
    found = sorted((r.start, r.region_name) for r in segments.segments(regions, "region_ord").where("file_id = 1").collect())
    bounds = sorted({x for r in spans for x in (r.start_offset, r.end_offset + 1)})
    want = [(b, min(((r.region_ord, r.region_name) for r in spans if r.start_offset <= b <= r.end_offset), default=(0, None))[1]) for b in bounds]
    assert found == want


def test_a_file_of_a_hundred_thousand_regions(spark):
    """Neighbours, one region of 1 TB over all, and short ones nested in it: no lists, no bins by length, no comparison with each region."""
    rows = spark.range(100_000).selectExpr("1L AS file_id", "CAST(id + 1 AS INT) AS region_ord", "concat('r', id) AS region_name", "id * 1000 AS start_offset", "id * 1000 + 899 AS end_offset")
    whole = spark.createDataFrame([(1, 200_000, "whole", 0, 1 << 40)], REGION)
    regions = rows.unionByName(whole)
    rng = random.Random(1)
    offsets = [rng.randrange(100_000_000) for _ in range(2000)] + [1 << 39, (1 << 40) + 1]
    reads = spark.createDataFrame([(1, k, None, 1, 1 << 41, o, 150) for k, o in enumerate(offsets)], READ)
    point = {r.event_order: r.region for r in R.point_region(reads, regions).collect()}
    assert all(point[k] == (f"r{o // 1000}" if o % 1000 < 900 and o < 100_000_000 else "whole" if o <= 1 << 40 else "trailing") for k, o in enumerate(offsets))
    starts = [k * 1000 for k in range(100_000)]

    def hits(o):
        first = max(bisect.bisect_right(starts, o) - 1, 0)
        near = [k for k in range(first, min(first + 3, 100_000)) if starts[k] <= o + 149 and starts[k] + 899 >= o]
        return len(near) + (o <= 1 << 40)

    joined = R.overlap(reads, regions, "inner")
    assert joined.count() == sum(map(hits, offsets))
    assert R.unmapped(reads, regions).count() == sum(hits(o) == 0 for o in offsets) == 1
    listed = segments.touching(reads.limit(0), R._spans(regions))
    assert "collect_list" not in R.point_region(reads, regions)._jdf.queryExecution().optimizedPlan().toString().split("Union")[0] and listed.count() == 0


@pytest.mark.parametrize("name", ["b4_point_region", "c2_unmapped_reads", "f7_jumps", "f10_access_ladder"])
def test_queries_by_segments_match_sql(spark, many, name):
    many(0)
    compare(spark, name)


def test_a_hot_file_is_sliced(spark, many, monkeypatch):
    from tracelens.operators import slices

    reads, regions = tables(spark, 7)
    rows = lambda: sorted(repr(r.asDict()) for r in R.point_region(reads, regions).collect())
    many(1 << 40)
    few = rows()
    many(0)
    monkeypatch.setattr(slices, "HOT_ROWS", 50)
    monkeypatch.setattr(slices, "MOST_HOT", 3)
    monkeypatch.setattr(slices, "SLICES", 8)
    assert rows() == few
    plan = R.point_region(reads, regions).select(F.col("region"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan
