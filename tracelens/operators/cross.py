"""Cross-trace metrics, summaries, outliers and feature vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CHUNK_BANDS, LIBRARY_BANDS, VECTOR_CLASSES
from ..functions.expressions import band, count_where, fixed, micros, ratio, region_class, top
from ..functions.storage import scratch
from . import regions as R
from . import sequence as Q
from . import statistics as S
from . import timeline as L

SUMMARY = ["file_size", "total_reads", "unique_offsets", "repeated_reads", "bytes_read", "read_amplification", "coverage_pct", "block_coverage_pct", "offset_entropy", "contiguous", "passes", "duration_seconds", "region_count", "mean_read", "median_read", "std_read", "aligned_pct", "avg_jump", "forward"]
CORRELATED = SUMMARY[:13]


def trace_metrics(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """One wide row per trace: one exchange of ordered reads, one of their counts by offset and length, one of the regions that they touch."""
    us = micros()
    ordered = Q.steps(reads).groupBy("trace_id").agg(
        F.max("file_size").alias("file_size"), ((F.max(us) - F.min(us)) / 1e6).alias("duration_seconds"), count_where(F.col("read_offset") + F.col("length") > F.col("file_size")).alias("reads_beyond_eof"),
        *Q.jump_measures(), *Q.pass_measures(),
    )
    out = ordered.join(S.counted_measures(reads), "trace_id")
    touched = R.by_region(reads, regions).groupBy("trace_id").agg(F.count("*").alias("region_count"))
    return out.join(touched, "trace_id", "left").withColumn("region_count", F.coalesce("region_count", F.lit(0)))


def long_metrics(metrics: DataFrame, names: list[str] = SUMMARY) -> DataFrame:
    """trace_id, metric, value."""
    return metrics.select("trace_id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("trace_id", "m.*")


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quantiles(long: DataFrame, shares: dict[str, float]) -> DataFrame:
    """metric and its interpolated quantiles of `value`; shares: name -> share of the values below.

    Values are counted first and ranged over the tasks; a quantile is read off the cumulative counts, so that no task gathers
    a metric's values. Nulls are left out.
    """
    counts = long.where("value IS NOT NULL").groupBy("metric", "value").agg(F.count("*").alias("n"))
    counts = kept(counts.repartitionByRange("metric", "value").withColumn("slice", F.spark_partition_id()), "value-counts")
    by_metric = Window.partitionBy("metric")
    own = counts.groupBy("metric", "slice").agg(F.sum("n").alias("own"))
    sums = own.select("metric", "slice", (F.sum("own").over(by_metric.orderBy("slice")) - F.col("own")).alias("before"), F.sum("own").over(by_metric).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("metric", "slice").orderBy("value"))
    upto = counts.withColumn("inside", inside).join(F.broadcast(sums), ["metric", "slice"]).select("metric", "value", "total", (F.col("before") + F.col("inside")).alias("upto"))

    def quantile(share: float) -> Column:
        place = share * (F.col("total") - 1)
        at = lambda k: F.min(F.when(F.col("upto") > k, F.col("value")))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    return upto.groupBy("metric").agg(*[quantile(share).alias(name) for name, share in shares.items()])


def metric_summary(metrics: DataFrame, names: list[str] = SUMMARY) -> DataFrame:
    v = F.col("value")
    half = 1.96 * F.coalesce(F.when(F.count(v) > 1, F.stddev_samp(v)), F.lit(0.0)) / F.sqrt(F.count(v))
    long = kept(long_metrics(metrics, names), "long-metrics")
    sums = long.groupBy("metric").agg(F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.avg(v) - half).alias("ci_low"), (F.avg(v) + half).alias("ci_high"))
    found = sums.join(quantiles(long, {"median": 0.5, "q1": 0.25, "q3": 0.75}), "metric", "left")
    return found.select("metric", "mean", "median", "variance", "std", "q1", "q3", "min", "max", "ci_low", "ci_high")


def metric_extremes(metrics: DataFrame, names: list[str] = SUMMARY) -> DataFrame:
    """Mean, median and the traces with the greatest and least value; ties go to the lowest trace."""
    long = kept(long_metrics(metrics, names), "long-metrics")
    sums = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.min(F.struct((-F.col("value")).alias("v"), "trace_id")).alias("a"), F.min(F.struct("value", "trace_id")).alias("b"))
    return sums.join(quantiles(long, {"median": 0.5}), "metric", "left").select("metric", "mean", "median", F.col("a.trace_id").alias("argmax"), F.col("b.trace_id").alias("argmin"))


def first_region_counts(entries: DataFrame) -> DataFrame:
    return entries.where("pos = 1").groupBy(F.col("region").alias("first_region")).agg(F.count("*").alias("traces"))


def coverage_matrix(reads: DataFrame, regions: DataFrame, least_share: float = 0.3) -> DataFrame:
    """Long form of the region x trace matrix; only regions that at least this share of the traces touch."""
    keys = ["trace_id", "region_name"]
    cells = R.region_coverage(reads, regions).select(*keys, "coverage_pct").join(R.by_region(reads, regions).select(*keys, "read_count"), keys)
    traces = reads.agg(F.count_distinct("trace_id").alias("all_traces"))
    common = cells.groupBy("region_name").agg(F.count("*").alias("n")).join(traces, F.lit(True)).where(F.col("n") >= least_share * F.col("all_traces")).select("region_name")
    return cells.join(common, "region_name", "left_semi").select(*keys, "coverage_pct", F.log1p("read_count").alias("log_reads"))


def region_totals(reads: DataFrame, regions: DataFrame) -> DataFrame:
    return R.by_region(reads, regions).groupBy("region_name").agg(F.sum("read_count").alias("total_reads"), F.sum("bytes_read").alias("total_bytes"))


def region_frequency(reads: DataFrame, regions: DataFrame) -> DataFrame:
    traces = reads.agg(F.count_distinct("trace_id").alias("all_traces"))
    found = R.by_region(reads, regions).groupBy("region_name").agg(F.count("*").alias("traces"), F.sum("read_count").alias("total_reads"), F.sum("bytes_read").alias("total_bytes"))
    return found.join(traces, F.lit(True)).select("region_name", "traces", (100 * ratio(F.col("traces"), F.col("all_traces"))).alias("pct_traces"), "total_reads", "total_bytes")


def access_ranks(entries: DataFrame) -> DataFrame:
    """trace_id, region, rank of its first access."""
    seen = entries.groupBy("trace_id", "region").agg(F.min("pos").alias("pos"))
    return seen.select("trace_id", "region", F.row_number().over(Window.partitionBy("trace_id").orderBy("pos")).alias("rank"))


def order_consensus(entries: DataFrame, k: int = 3) -> DataFrame:
    """The k most common regions at each access rank; ties go to the one of the lowest trace."""
    counts = access_ranks(entries).groupBy("rank", "region").agg(F.count("*").alias("traces"), F.min("trace_id").alias("first_trace"))
    return top(counts, k, ["rank"], F.desc("traces"), F.col("first_trace")).select("rank", F.col("rn").alias("place"), "region", "traces")


def offset_bins(reads: DataFrame, bins: int = 64) -> DataFrame:
    touched = reads.select("trace_id", S.offset_bin(bins).alias("bin")).distinct().groupBy("bin").agg(F.count("*").alias("n"))
    total = reads.agg(F.count_distinct("trace_id").alias("all_traces"))
    slots = reads.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return slots.join(touched, "bin", "left").join(total, F.lit(True)).select("bin", F.coalesce("n", F.lit(0)).alias("traces"), F.coalesce(ratio(F.col("n"), F.col("all_traces")), F.lit(0.0)).alias("fraction"))


def chunk_frequency(reads: DataFrame) -> DataFrame:
    return S.length_bands(reads).groupBy("band_ord", "band").agg(F.sum("reads").alias("total_reads"), (100 * F.avg(F.when(F.col("reads") > 0, 1.0).otherwise(0.0))).alias("pct_traces"))


def pass_distribution(reads: DataFrame) -> DataFrame:
    return Q.scan_passes(reads).groupBy("passes").agg(F.count("*").alias("traces"))


def repeat_summary(reads: DataFrame) -> DataFrame:
    stats = S.read_stats(reads)
    return stats.agg(F.sum("total_reads").alias("total_reads"), F.sum("unique_offsets").alias("unique_offsets"), F.sum("repeated_reads").alias("repeated_reads"), (100 * ratio(F.sum("repeated_reads"), F.sum("total_reads"))).alias("repeated_pct"), (100 * F.avg(ratio(F.col("repeated_reads"), F.col("total_reads")))).alias("mean_repeated_pct"))


def region_aggregate(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Per region over all traces; the mean read size also counts reads that end right at its start or begin right after it."""
    keys = ["trace_id", "region_name"]
    ranks = access_ranks(L.timeline(reads, regions)).select("trace_id", F.col("region").alias("region_name"), "rank")
    touched = R.by_region(reads, regions).join(ranks, keys)
    near = R.overlap(reads.withColumns({"read_offset": F.col("read_offset") - 1, "length": F.col("length") + 2}), regions, "inner").groupBy(*keys).agg(F.sum(F.col("length") - 2).alias("size_sum"), F.count("*").alias("size_n"))
    total = reads.agg(F.count_distinct("trace_id").alias("all_traces"))
    return touched.join(near, keys).groupBy("region_name").agg(
        F.count("*").alias("traces"), F.sum("read_count").alias("total_reads"), F.sum("bytes_read").alias("total_bytes"), F.sum("repeated_reads").alias("repeated_reads"), F.avg("rank").alias("avg_access_rank"),
        ratio(F.sum("bytes_read"), F.count("*")).alias("avg_bytes_per_trace"), ratio(F.sum("size_sum"), F.sum("size_n")).alias("avg_read_size"),
    ).join(total, F.lit(True)).select("*", (100 * ratio(F.col("traces"), F.col("all_traces"))).alias("pct_traces"), region_class().alias("region_class")).drop("all_traces")


def correlation(metrics: DataFrame, names: list[str] = CORRELATED) -> DataFrame:
    """Pearson r of every pair of metrics, 0 where one does not vary, and whether it is strong."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]

    def r(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        return F.coalesce(F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))), F.lit(0.0))

    row = metrics.agg(*[r(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("c")
    return row.select(cells).select("c.*", (F.abs("c.r") > 0.6).alias("strong"))


def size_group_test(metrics: DataFrame, split: int = 500_000) -> DataFrame:
    """Means of large and small files and Welch's t of their amplification."""
    big = F.col("file_size") >= split
    amp, share = F.col("read_amplification"), 100 * ratio(F.col("repeated_reads"), F.col("total_reads"))
    own = lambda cond, x: F.when(cond, x)
    one = metrics.agg(*[
        f.alias(f"{name}_{side}")
        for side, cond in (("large", big), ("small", ~big))
        for name, f in (("n", F.count(own(cond, 1))), ("amplification", F.avg(own(cond, amp))), ("repeated_pct", F.avg(own(cond, share))), ("passes", F.avg(own(cond, F.col("passes")))), ("variance", F.var_samp(own(cond, amp))))
    ])
    error = F.sqrt(F.col("variance_large") / F.col("n_large") + F.col("variance_small") / F.col("n_small"))
    return one.select("*", F.try_divide(F.col("amplification_large") - F.col("amplification_small"), error).alias("welch_t")).drop("variance_large", "variance_small")


RESEARCH_Z = ["read_amplification", "duration_seconds", "bytes_read", "total_reads", "offset_entropy", "repeated_reads"]
LIBRARY_Z = ["read_amplification", "offset_entropy", "duration_seconds", "bytes_read", "total_reads"]
IQR_METRICS = ["read_amplification", "repeated_reads", "duration_seconds"]


def zscore_outliers(metrics: DataFrame, names: list[str] = RESEARCH_Z, limit: float = 2.5) -> DataFrame:
    stats = long_metrics(metrics, names)
    sums = stats.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    z = F.try_divide(F.col("value") - F.col("mean"), F.nullif("std", F.lit(0.0)))
    return stats.join(sums, "metric").select("trace_id", "metric", "value", z.alias("z")).where(F.abs("z") >= limit)


def iqr_outliers(metrics: DataFrame, names: list[str] = IQR_METRICS) -> DataFrame:
    stats = kept(long_metrics(metrics, names), "long-metrics")
    q = quantiles(stats, {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = q.select("metric", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    return stats.join(fences, "metric").where("value < low OR value > high").select("trace_id", "metric", "value", "low", "high")


def rule_outliers(metrics: DataFrame, phases: DataFrame, overlay: DataFrame, probes: DataFrame) -> DataFrame:
    """trace_id, type, metric, value of the rule-based anomalies of both dialects.

    phases: detected phases; overlay: trace_id, bytes_read of reads that touch the overlay; probes: eof_probes() with has_certificate.
    """
    kind = lambda df, type_, metric, value: df.select("trace_id", F.lit(type_).alias("type"), F.lit(metric).alias("metric"), value.cast("string").alias("value"))
    core = ["Header Inspection", "Directory Parsing"]
    have = phases.groupBy("trace_id").agg(F.collect_set("phase").alias("have"))
    lacking = metrics.select("trace_id").join(have, "trace_id", "left").withColumn("lack", F.array_except(F.array(*[F.lit(x) for x in core]), F.coalesce("have", F.array().cast("array<string>")))).where(F.size("lack") > 0)
    unaligned = F.col("unaligned_reads") * 10 > 3 * F.col("total_reads")
    m = metrics.withColumn("unaligned_reads", F.round(F.col("unaligned_fraction") * F.col("total_reads")).cast("long"))
    parts = [
        kind(m.where("reads_beyond_eof > 0"), "offset beyond EOF", "read_beyond_eof", F.col("reads_beyond_eof")),
        kind(lacking, "missing phase", "phases", F.array_join("lack", ", ")),
        kind(m.where("total_reads <= 2"), "degenerate capture", "total reads", F.col("total_reads")),
        kind(m.where(unaligned), "unaligned reads", "unaligned reads", F.col("unaligned_reads")),
        kind(m.where("total_reads <= 3"), "few reads", "total reads", F.col("total_reads")),
        kind(overlay.select("trace_id", F.col("bytes_read").alias("overlay_bytes")).join(m, "trace_id").where("2 * overlay_bytes > bytes_read"), "overlay streaming", "overlay bytes", F.col("overlay_bytes")),
        kind(probes.where("has_certificate AND NOT tail_probe_library"), "certificate not probed", "certificate", F.lit("present")),
        kind(m.where("bytes_read > 3 * file_size AND repeated_reads = 0"), "amplification without repeats", "bytes read", F.col("bytes_read")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def anomaly_report(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """All anomalies in one schema with their rank in the order (trace, type, metric)."""
    z = zscore_outliers(metrics).select("trace_id", F.lit("z-score outlier").alias("type"), "metric", fixed(F.col("value"), 3).alias("value"))
    iqr = iqr_outliers(metrics).select("trace_id", F.lit("IQR outlier").alias("type"), "metric", fixed(F.col("value"), 3).alias("value"))
    both = z.unionByName(iqr).unionByName(rules)
    return both.select("*", F.row_number().over(Window.partitionBy("trace_id").orderBy("type", "metric", "value")).alias("place"))


def findings(metrics: DataFrame, entries: DataFrame, reads: DataFrame, regions: DataFrame, probes: DataFrame) -> DataFrame:
    """finding, n, detail: six evidence rows over all traces."""
    by_region = R.by_region(reads, regions)
    total = metrics.agg(F.count("*").alias("all_traces"))
    row = lambda name, n, detail: (F.lit(name).alias("finding"), n.cast("long").alias("n"), detail.cast("string").alias("detail"))
    every = by_region.groupBy("region_name").agg(F.count("*").alias("t")).join(total, F.lit(True)).where("t = all_traces")
    wide = S.length_bands(reads, LIBRARY_BANDS).where("band_ord >= 5 AND reads > 0")
    header = by_region.where((region_class() == "headers") & (F.col("repeated_reads") > 1))
    worst = F.min_by("trace_id", F.struct((-F.col("read_amplification")).alias("v"), "trace_id"))
    parts = [
        entries.where("pos = 1 AND region = 'DOS Header'").agg(*row("first region is the DOS header", F.count("*"), F.lit(""))),
        probes.where("tail_probe_library").agg(*row("tail probes", F.count("*"), F.lit(""))),
        metrics.agg(*row("read amplification", F.count("*"), F.concat(F.lit("mean "), fixed(F.avg("read_amplification"), 2), F.lit(", worst trace "), worst.cast("string")))),
        every.agg(*row("regions touched in every trace", F.count("*"), F.array_join(F.array_sort(F.collect_list("region_name")), ", "))),
        wide.agg(*row("trace and band pairs of 256 KiB and more", F.count("*"), F.lit(""))),
        header.agg(*row("headers re-read", F.count("*"), F.lit(""))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def headline_totals(metrics: DataFrame, split: int = 500_000) -> DataFrame:
    share = 100 * ratio(F.col("repeated_reads"), F.col("total_reads"))
    return metrics.agg(
        F.count("*").alias("traces"), F.sum("total_reads").alias("total_reads"), F.sum("bytes_read").alias("total_bytes"), F.avg("read_amplification").alias("mean_amplification"), F.avg("duration_seconds").alias("mean_duration"),
        count_where(F.col("coverage_pct") >= 100).alias("fully_covered"), F.avg(F.when(F.col("file_size") >= split, share)).alias("large_repeated_pct"), F.avg(F.when(F.col("file_size") < split, share)).alias("small_repeated_pct"),
    )


FEATURES = [*(f"bin{k}" for k in range(64)), *(f"cls:{c}" for c in VECTOR_CLASSES), *(name for _, _, name in CHUNK_BANDS), "amp", "sequential", "entropy", "passes"]


def long_features(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """trace_id, feature, value of the 94 features; zeros are left out."""
    n = F.count("*").over(Window.partitionBy("trace_id"))
    share = lambda name: reads.select("trace_id", name.alias("feature"), n.alias("n")).groupBy("trace_id", "feature").agg(ratio(F.count("*"), F.max("n")).alias("value"))
    classes = R.by_region(reads, regions).groupBy("trace_id", region_class().alias("c")).agg(F.sum("read_count").alias("k")).where(F.col("c").isin(VECTOR_CLASSES))
    shares = classes.select("trace_id", F.concat(F.lit("cls:"), "c").alias("feature"), ratio(F.col("k"), F.sum("k").over(Window.partitionBy("trace_id"))).alias("value"))
    scalars = S.read_stats(reads).join(Q.sequential_metrics(reads), "trace_id").join(S.offset_entropy(reads), "trace_id").join(Q.scan_passes(reads), "trace_id")
    four = F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("value")) for k, v in (("amp", F.col("read_amplification")), ("sequential", F.col("contiguous")), ("entropy", F.col("offset_entropy")), ("passes", F.least("passes", F.lit(8)) / 8.0))])
    return share(F.concat(F.lit("bin"), S.offset_bin().cast("string"))).unionByName(shares).unionByName(share(band())).unionByName(scalars.select("trace_id", F.explode(four).alias("f")).select("trace_id", "f.*")).where("value != 0")


def feature_vectors(long: DataFrame) -> DataFrame:
    """trace_id, features (array of doubles in the order of FEATURES)."""
    grouped = long.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    return grouped.select("trace_id", F.array(*[F.coalesce(F.try_element_at("m", F.lit(f)), F.lit(0.0)) for f in FEATURES]).alias("features"))


def standardised(long: DataFrame) -> DataFrame:
    """trace_id, feature, z with the population deviation over all traces, zeros included; constant features are dropped."""
    traces = long.select("trace_id").distinct()
    total = traces.agg(F.count("*").alias("n"))
    stats = long.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).join(total, F.lit(True)).select("feature", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))).alias("std")).where("std > 1e-9")
    slots = traces.join(F.broadcast(stats), F.lit(True))  # at most len(FEATURES) rows
    return slots.join(long, ["trace_id", "feature"], "left").select("trace_id", "feature", ((F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.col("std")).alias("z"))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    values = lists.combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _far(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """a, b and distance of every query of a block with every row of a shard, but itself."""
    if not rows.num_rows or not asked.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
    a, b, left, right = asked["a"].to_numpy(), rows["b"].to_numpy(), _matrix(asked["va"]), _matrix(rows["vb"])
    apart = np.empty((len(a), len(b)))
    for k, v in enumerate(left):
        d = right - v
        np.einsum("ij,ij->i", d, d, out=apart[k])
    others = a[:, None] != b
    pairs = np.nonzero(others)
    return pa.table({"a": a[pairs[0]], "b": b[pairs[1]], "distance": np.sqrt(apart[others])})


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distances of every pair of blocks, 64 queries at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            asked, rows = (pa.RecordBatch.from_struct_array(batch.column(c)[k].values) for c in (0, 1))
            rows = pa.table({"b": rows["trace_id"], "vb": rows["v"]})
            for at in range(0, asked.num_rows, 64):
                some = asked.slice(at, 64)
                yield from _far(rows, pa.table({"a": some["trace_id"], "va": some["v"]})).to_batches()


def distances(z: DataFrame, queries: Column | None = None, block: int = 1024) -> DataFrame:
    """Euclidean distance of every trace, or of those that `queries` selects, to all others.

    The vectors are written once, in rows of about `block` of them. A row of the product of these rows with themselves is two blocks,
    whose distances a task gives out as it goes: nothing is exchanged and the disk holds the vectors once, though the result
    grows with the square of the traces. All traces have the same features, in one order.
    """
    own = z.where("trace_id IS NOT NULL").groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "z"))), lambda x: x["z"]).alias("v"))
    rows = kept(own.select(F.col("trace_id").cast("long").alias("trace_id"), "v"), "feature-vectors")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-df.count() // block))
        packed = df.groupBy(F.pmod(F.xxhash64("trace_id"), F.lit(n)).alias("_block")).agg(F.collect_list(F.struct("trace_id", "v")).alias(name))
        files = min(n, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism))
        return kept(packed.repartition(files, "_block").select(name), f"vector-blocks-{name}")

    others = blocks(rows, "b")
    asked = others.select(F.col("b").alias("a")) if queries is None else blocks(rows.where(queries), "a")
    return asked.crossJoin(others).mapInArrow(_block_pairs, "a LONG, b LONG, distance DOUBLE")


def vectors(z: DataFrame) -> DataFrame:
    """One vector per trace, written once: the models below pass over them many times."""
    rows = z.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("feature", "z"))).alias("f"))
    path = scratch(z.sparkSession, "vectors")
    rows.select("trace_id", F.transform("f", lambda x: x["z"]).alias("z")).write.parquet(path)
    return z.sparkSession.read.parquet(path).select("trace_id", array_to_vector("z").alias("features"))


def cluster_traces(z: DataFrame, most: int = 8, seed: int = 1, traces: DataFrame | None = None) -> DataFrame:
    """k-means labels for the k from 2 to min(`most`, traces - 1) with the best silhouette; trace_id, cluster, k, silhouette.

    Where nothing splits (fewer than three traces, or equal ones) all are in cluster 0, k is 1 and the silhouette -1.
    `traces` (trace_id) adds traces that have no varying feature, and so no row in `z`.
    """
    whole = (z if traces is None else traces).select("trace_id").distinct().select("trace_id", F.lit(0).alias("cluster"), F.lit(1).alias("k"), F.lit(-1.0).alias("silhouette"))
    rows = vectors(z)
    best = None
    for k in range(2, min(most, rows.count() - 1) + 1):
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
        labels = model.transform(rows)
        if labels.select("cluster").distinct().count() < 2:
            continue
        score = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(labels)
        if best is None or score > best[0]:
            best = score, k, model
    if best is None:
        return whole
    found = best[2].transform(rows).select("trace_id", "cluster", F.lit(best[1]).alias("k"), F.lit(float(best[0])).alias("silhouette"))
    return found if traces is None else found.unionByName(whole.join(found, "trace_id", "left_anti"))


def trace_vectors(z: DataFrame) -> DataFrame:
    """trace_id and v: (feature, z) in the order of features."""
    return z.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("feature", "z"))).alias("v"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products and numbers of traces of every pair of features (a <= b) over a task's vectors."""
    place: dict[str, int] = {}
    sums = counts = np.zeros((0, 0))
    for batch in batches:
        lists = batch.column(0)
        entries, lengths = lists.flatten(), np.diff(lists.offsets.to_numpy())
        names = entries.field("feature").dictionary_encode()
        for name in names.dictionary.to_pylist():
            place.setdefault(name, len(place))
        at = np.array([place[name] for name in names.dictionary.to_pylist()], dtype=np.int64)[names.indices.to_numpy()]
        values, here = np.zeros((len(lengths), len(place))), np.zeros((len(lengths), len(place)))
        row = np.repeat(np.arange(len(lengths)), lengths)
        values[row, at], here[row, at] = entries.field("z").to_numpy(), 1.0
        more = len(place) - len(sums)
        sums, counts = (np.pad(m, (0, more)) + x.T @ x for m, x in ((sums, values), (counts, here)))
    names = sorted(place)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:] if counts[place[a], place[b]] > 0]
    total = lambda m: [float(m[place[a], place[b]]) for a, b in pairs]
    yield pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "s": total(sums), "n": total(counts)}, schema=pa.schema([("a", pa.string()), ("b", pa.string()), ("s", pa.float64()), ("n", pa.float64())]))


def feature_covariance(z: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """a, b (features, a <= b) and their population covariance; z is centred already.

    A task multiplies its traces' vectors as a matrix, so that one row per pair of features leaves each and none is made per trace.
    """
    sums = (trace_vectors(z) if vectors is None else vectors).select("v").mapInArrow(_products, "a STRING, b STRING, s DOUBLE, n DOUBLE")
    return sums.groupBy("a", "b").agg((F.sum("s") / F.sum("n")).alias("covariance"))


def principal_components(z: DataFrame, k: int = 2, vectors: DataFrame | None = None) -> np.ndarray:
    """The first k unit eigenvectors of the features' covariance, one per row; the entry of largest size is positive."""
    found = feature_covariance(z, vectors).collect()  # at most one row per pair of FEATURES
    place = {name: n for n, name in enumerate(sorted({r.a for r in found}))}
    matrix = np.zeros((len(place), len(place)))
    for r in found:
        matrix[place[r.a], place[r.b]] = matrix[place[r.b], place[r.a]] = r.covariance
    axes = np.linalg.eigh(matrix)[1][:, ::-1][:, :k].T
    return np.array([v * np.sign(v[np.abs(v).argmax()]) for v in axes])


def pca_projection(z: DataFrame, k: int = 2) -> DataFrame:
    """trace_id and pc1 to pck: the traces' vectors on the first principal components, null where there are fewer."""
    rows = kept(trace_vectors(z), "trace-vectors")  # of the two passes, neither makes the features anew
    axes = principal_components(z, k, rows)
    own = rows.select("trace_id", F.col("v.z").alias("v"))

    def on(axis: np.ndarray) -> Column:
        return F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in axis]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    return own.select("trace_id", *[(on(axes[c]) if c < len(axes) else F.lit(None).cast("double")).alias(f"pc{c + 1}") for c in range(k)])
