"""What grows with captures, traces or spans: files, dealt rows, texts of doubles, bits and blocks."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import compare
from tracelens.functions.expressions import fixed
from tracelens.functions.storage import dealt
from tracelens.operators import cross as X
from tracelens.operators import statistics as S
from tracelens.plans import adapters as A
from tracelens.sources import captures as C
from tracelens.sources import sinks as K
from tracelens.sources import trace_csv as V
from tracelens.streaming import traces as T


def test_rows_of_a_key_are_in_one_task_over_a_union(spark):
    """Each side of the union is dealt by the key already and merged on its own: a plain repartition(key) is left out."""
    rows = spark.range(20_000).select((F.col("id") % 500).alias("k"), "id", F.lit("x" * 200).alias("text"))
    body = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    both = rows.select("k").distinct().select("k", F.lit(-1).alias("id"), F.lit("").alias("text"), F.lit(0).alias("n")).unionByName(body)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.shuffle.partitions", 4 * spark.sparkContext.defaultParallelism)
    try:
        tasks = lambda df: df.withColumn("task", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("task").alias("t")).where("t > 1").count()
        assert tasks(dealt(both, "k")) == 0
        assert dealt(both, "k").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_files_of_a_quarantine_are_whole_where_sides_are_merged_apart(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        compare(spark, "a8_file_quarantine", "/root/testdata/sf0.01")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")


def test_a_double_as_text_is_rounded_by_its_binary_value(spark):
    rng = random.Random(5)
    values = [None, 0.0625, 0.3125, 1.0005, 2.0015, 0.0005, 12.0625, 1e17, 123456.7895, 0.0, -2.0625, *(rng.randrange(10**9) / 1e4 + 0.00005 for _ in range(500)), *(rng.randrange(10**6) / 16 for _ in range(200))]
    rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select("v", fixed(F.col("v"), 3).alias("t")).collect()
    assert [(r.v, r.t) for r in rows] == [(v, None if v is None else f"{v:.3f}") for v in values]


def test_packed_files_give_the_rows_of_single_ones(spark, tmp_path):
    rows = A.raw_rows(spark, "/root/testdata/sf0.001").withColumn("part", F.lit(0))
    V.pack(rows, str(tmp_path / "packed"), "event_order")
    ours = V.scan_packed(spark, str(tmp_path / "packed"), placed=True)
    assert ours.inputFiles() and len(ours.inputFiles()) <= max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert sorted(map(tuple, ours.select("trace_id", *V.NAMES).collect())) == sorted(map(tuple, rows.select("trace_id", *V.NAMES).collect()))
    days = rows.select("trace_id").distinct().select("trace_id", F.lit(None).cast("date").alias("day"), F.lit(1).alias("file_id"), F.lit(2).alias("file_size"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = V.timed(V.reads(ours), days).select("trace_id", "event_order", "read_offset").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = V.reads(rows).select("trace_id", F.row_number().over(Window.partitionBy("trace_id").orderBy("event_order")).cast("long").alias("event_order"), "read_offset").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want))


def test_packed_parts_wait_for_an_empty_one(spark, tmp_path):
    row = lambda trace, part, at: (trace, part, "1:00:00.0000000 AM", "a.exe", "12", "ReadFile", "C:\\x", "SUCCESS", f"Offset: {at}, Length: 10")
    captures = spark.createDataFrame([(7, None, 1, 2)], "trace_id LONG, day DATE, file_id LONG, file_size LONG")
    schema = ", ".join(["trace_id LONG", "part LONG", *(f"{n} STRING" for n in V.NAMES)])

    def arrive(*rows):
        V.pack(spark.createDataFrame(list(rows), schema), str(tmp_path / "in"))
        query = T.append_timed(spark, str(tmp_path / "in"), captures, str(tmp_path / "out"), str(tmp_path / "mark"), packed=True)
        query.awaitTermination()
        assert query.exception() is None
        return sorted((r.trace_id, r.event_order, r.read_offset) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert arrive(row(7, 0, 1), row(7, 2, 3), row(8, 0, 5)) == [(7, 1, 1), (8, 1, 5)]
    assert arrive((7, 1, *V.HEADERS)) == [(7, 1, 1), (7, 2, 3), (8, 1, 5)]


def test_listing_takes_only_files_right_in_a_capture(spark, tmp_path):
    root = tmp_path / "with space"
    for name in ("1/a.csv", "1/deep/b.csv", "c.csv", "2/manifest.json", "2/deep/manifest.json"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text('{"experiment": 2, "status": "completed"}')
    assert {(r.capture_id, r.event_bytes) for r in C.listed(spark, str(root)).collect()} == {(1, 40), (2, 0)}
    assert [r.capture_id for r in C.manifests(spark, str(root)).collect()] == [2]


def test_the_store_has_files_by_size_and_not_by_capture(spark, tmp_path):
    path = str(tmp_path / "store")
    K.replace(spark.range(300).select(F.col("id").alias("trace_id"), F.lit(1).alias("v")).coalesce(2), path)
    K.replace(spark.range(0, 300, 3).select(F.col("id").alias("trace_id"), F.lit(2).alias("v")).coalesce(1), path)
    K.replace(spark.range(0, 300, 6).select(F.col("id").alias("trace_id"), F.lit(3).alias("v")).coalesce(1), path)
    assert {(r.trace_id, r.v) for r in K.load(spark, path).collect()} == {(k, 3 if k % 6 == 0 else 2 if k % 3 == 0 else 1) for k in range(300)}
    assert len(list((tmp_path / "store").rglob("part-*.parquet"))) == 4 and K.load(spark, path).columns == ["trace_id", "v"]


def test_cells_are_bits_of_one_row_a_group(spark):
    spans = [(1, 0, 9, 100), (1, 95, 99, 100), (2, 0, 999_999, 1_000_000), (3, 5, 5, 7), (4, 3, 2, 10), (5, 599, 700, 1000)]
    for width in (1, 50, 60, 80, 130):
        found = {r.k: (r.filled, r.drawn) for r in S.coverage_cells(spark.createDataFrame(spans, "k LONG, lo LONG, last LONG, size LONG"), ["k"], width).collect()}
        want = {}
        for k, lo, last, size in spans:
            if lo <= last:
                want.setdefault(k, set()).update(range(min(lo * width // size, width - 1), min(last * width // size, width - 1) + 1))
        assert found == {k: (len(c), "".join("#" if i in c else "." for i in range(width))) for k, c in want.items()}
    plan = S.coverage_cells(spark.createDataFrame(spans, "k LONG, lo LONG, last LONG, size LONG"), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "collect_set" not in plan


def test_covariance_makes_no_row_per_trace_and_pair(spark):
    rng = random.Random(1)
    points = {t: {f: rng.uniform(-2, 2) for f in "abcd" if t % 5 or f != "c"} for t in range(40)}
    z = spark.createDataFrame([(t, f, v) for t, p in points.items() for f, v in p.items()], "trace_id LONG, feature STRING, z DOUBLE")
    cov = X.feature_covariance(z)
    pairs = {(a, b): [p[a] * p[b] for p in points.values() if a in p and b in p] for a in "abcd" for b in "abcd" if a <= b}
    assert {(r.a, r.b): r.covariance for r in cov.collect()} == {k: pytest.approx(sum(v) / len(v)) for k, v in pairs.items()}
    assert "Generate" not in cov._jdf.queryExecution().optimizedPlan().toString()
    assert X.feature_covariance(z.limit(0)).count() == 0


def test_a_block_of_distances_is_one_shard_against_one_block(spark):
    rows, asked = pa.table({"b": [1, 2, 3], "vb": [[0.0, 0.0], [3.0, 4.0], [0.0, 0.0]]}), pa.table({"a": [1], "va": [[0.0, 0.0]]})
    assert X._far(rows, asked).to_pylist() == [{"a": 1, "b": 2, "distance": 5.0}, {"a": 1, "b": 3, "distance": 0.0}]
