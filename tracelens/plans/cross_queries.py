"""Registered queries across traces: metrics, outliers, comparisons, feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import CHUNK_BANDS, VECTOR_CLASSES
from ..functions.expressions import rounded
from ..operators import compare as P
from ..operators import cross as X
from ..operators import regions as R
from ..operators import statistics as S
from ..operators import timeline as L
from . import adapters as A
from .prelude import band_of, big, class_of, names, r6, sql
from .read_queries import PHASES, RULES, mapped, ok, timed
from .scan_queries import ARCHIVES, ENTRIES, MEMBERS


def measured(f):
    """A query of the wide metrics row per trace."""
    return lambda spark, d: rounded(f(X.trace_metrics(A.completed(spark, d), A.regions(spark))))


def vectors(f):
    """A query of the standardised features."""
    return lambda spark, d: rounded(f(X.standardised(X.long_features(A.completed(spark, d), A.regions(spark)))))


def probes(reads):
    """Every fifth trace's file has a certificate."""
    return S.eof_probes(reads, A.LAST_REGION_END).withColumn("has_certificate", F.col("trace_id") % 5 == 0)


def rules(spark, d):
    reads, regions = A.completed(spark, d), A.regions(spark)
    overlay = R.by_region(reads, regions).where("region_name = 'Overlay'").select("trace_id", "bytes_read")
    return X.rule_outliers(X.trace_metrics(reads, regions), L.detect_phases(L.timeline(reads, regions), RULES), overlay, probes(reads))


def c4(spark, d):
    reads = A.completed(spark, d)
    pairs = reads.select(F.expr("trace_id div 2").alias("pair")).distinct().selectExpr("pair", "2 * pair AS left_trace", "2 * pair + 1 AS right_trace")
    return P.trace_pair_diff(reads, pairs)


def c5(spark, d):
    reads = A.completed(spark, d).withColumn("label", F.col("process_name"))
    return rounded(P.label_comparison(reads, ["scanner.exe", "indexer.exe"]).withColumnsRenamed({"scanner.exe": "scanner", "indexer.exe": "indexer"}))


def c6(spark, d):
    from ..sources.region_catalog import regions_from_entries

    entries = A.entries(spark, d)
    return rounded(P.archive_coverage(A.archive_reads(spark, d), regions_from_entries(entries, A.archives(entries))))


def h20(spark, d):
    reads, regions = A.completed(spark, d), A.regions(spark)
    return X.findings(X.trace_metrics(reads, regions), L.timeline(reads, regions), reads, regions, probes(reads))


def h24(spark, d):
    """Clusters of the traces; how many there are, what k was chosen."""
    reads = A.completed(spark, d)
    return X.cluster_traces(X.standardised(X.long_features(reads, A.regions(spark))), traces=reads)


METRIC_COLUMNS = ", ".join(f"{r6(c)} AS {c}" for c in X.SUMMARY if c not in ("total_reads", "unique_offsets", "repeated_reads", "bytes_read", "passes", "region_count", "file_size"))
LONG = ("long_metrics", "SELECT trace_id, metric, CAST(value AS DOUBLE) AS value FROM (" + " UNION ALL ".join(f"SELECT trace_id, '{c}' AS metric, {c} AS value FROM metrics" for c in X.SUMMARY) + ")")
Z_SQL = "SELECT l.trace_id, l.metric, l.value, (l.value - s.m) / s.sd AS z FROM long_metrics l JOIN (SELECT metric, avg(value) AS m, stddev_pop(value) AS sd FROM long_metrics GROUP BY metric) s ON s.metric = l.metric AND s.sd > 0 WHERE l.metric IN ({}) AND abs((l.value - s.m) / s.sd) >= 2.5"
ZS = ("zs", Z_SQL.format(names(X.RESEARCH_Z)))
IQRS = ("iqrs", f"SELECT l.trace_id, l.metric, l.value, q.q1 - 1.5 * (q.q3 - q.q1) AS low, q.q3 + 1.5 * (q.q3 - q.q1) AS high FROM long_metrics l JOIN (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long_metrics GROUP BY metric) q USING (metric) WHERE l.metric IN ({names(X.IQR_METRICS)}) AND (l.value < q.q1 - 1.5 * (q.q3 - q.q1) OR l.value > q.q3 + 1.5 * (q.q3 - q.q1))")
PROBED = ("probed", f"SELECT trace_id, bool_or(read_offset + length > {A.LAST_REGION_END}) AS tail, trace_id % 5 = 0 AS has_certificate FROM ok GROUP BY trace_id")
RULED = ("ruled", """SELECT trace_id, 'offset beyond EOF' AS type, 'read_beyond_eof' AS metric, CAST(beyond AS VARCHAR) AS value FROM metrics WHERE beyond > 0
    UNION ALL SELECT trace_id, 'missing phase', 'phases', l FROM (SELECT m.trace_id, concat_ws(', ', CASE WHEN NOT EXISTS (SELECT 1 FROM phases p WHERE p.trace_id = m.trace_id AND p.phase = 'Header Inspection') THEN 'Header Inspection' END, CASE WHEN NOT EXISTS (SELECT 1 FROM phases p WHERE p.trace_id = m.trace_id AND p.phase = 'Directory Parsing') THEN 'Directory Parsing' END) AS l FROM metrics m) WHERE l <> ''
    UNION ALL SELECT trace_id, 'degenerate capture', 'total reads', CAST(total_reads AS VARCHAR) FROM metrics WHERE total_reads <= 2
    UNION ALL SELECT trace_id, 'unaligned reads', 'unaligned reads', CAST(unaligned AS VARCHAR) FROM metrics WHERE unaligned * 10 > 3 * total_reads
    UNION ALL SELECT trace_id, 'few reads', 'total reads', CAST(total_reads AS VARCHAR) FROM metrics WHERE total_reads <= 3
    UNION ALL SELECT m.trace_id, 'overlay streaming', 'overlay bytes', CAST(b.bytes_read AS VARCHAR) FROM metrics m JOIN byreg b ON b.trace_id = m.trace_id AND b.region_name = 'Overlay' WHERE 2 * b.bytes_read > m.bytes_read
    UNION ALL SELECT trace_id, 'certificate not probed', 'certificate', 'present' FROM probed WHERE has_certificate AND NOT tail
    UNION ALL SELECT trace_id, 'amplification without repeats', 'bytes read', CAST(bytes_read AS VARCHAR) FROM metrics WHERE bytes_read > 3 * file_size AND repeated_reads = 0""")
NEAR_SQL = """SELECT b.region_name, count(*) AS traces, {0} AS total_reads, {1} AS total_bytes, {2} AS repeated_reads, round(avg(k.rank), 6) AS avg_access_rank, round(sum(b.bytes_read) / count(*), 6) AS avg_bytes_per_trace, round(sum(x.s) / sum(x.c), 6) AS avg_read_size,
    round(100.0 * count(*) / (SELECT count(DISTINCT trace_id) FROM ok), 6) AS pct_traces, {3} AS region_class FROM byreg b JOIN ranks k ON k.trace_id = b.trace_id AND k.region = b.region_name
    JOIN (SELECT o.trace_id, r.region_name, sum(o.length) AS s, count(*) AS c FROM ok o JOIN regions r ON r.start_offset <= o.read_offset + o.length AND o.read_offset <= r.end_offset + 1 GROUP BY ALL) x ON x.trace_id = b.trace_id AND x.region_name = b.region_name GROUP BY b.region_name"""
FEATS = (
    "feats",
    f"""SELECT trace_id, feature, value FROM (
    SELECT trace_id, 'bin' || least(read_offset * 64 // file_size, 63) AS feature, count(*) / max(total) AS value FROM seq GROUP BY ALL
    UNION ALL SELECT trace_id, 'cls:' || c, k / sum(k) OVER (PARTITION BY trace_id) FROM (SELECT trace_id, {class_of()} AS c, sum(read_count) AS k FROM byreg GROUP BY ALL) WHERE c IN ({names(VECTOR_CLASSES)})
    UNION ALL SELECT trace_id, {band_of()} AS f, count(*) / max(total) FROM seq GROUP BY trace_id, f
    UNION ALL SELECT trace_id, 'amp', read_amplification FROM metrics UNION ALL SELECT trace_id, 'sequential', contiguous FROM metrics UNION ALL SELECT trace_id, 'entropy', offset_entropy FROM metrics UNION ALL SELECT trace_id, 'passes', least(passes, 8) / 8.0 FROM metrics) WHERE value <> 0""",
)
STD = (
    "std",
    "SELECT t.trace_id, s.feature, (coalesce(f.value, 0.0) - s.m) / s.sd AS z FROM (SELECT DISTINCT trace_id FROM ok) t CROSS JOIN (SELECT feature, sum(value) / n AS m, sqrt(greatest(sum(value * value) / n - pow(sum(value) / n, 2), 0)) AS sd FROM feats, (SELECT count(DISTINCT trace_id) AS n FROM ok) GROUP BY feature, n) s LEFT JOIN feats f ON f.trace_id = t.trace_id AND f.feature = s.feature WHERE s.sd > 1e-9",
)
COR = ", ".join(f"coalesce(CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 0 THEN covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / (stddev_pop({a}) * stddev_pop({b})) END, 0.0)" for i, a in enumerate(X.CORRELATED) for b in X.CORRELATED[i + 1 :])
PAIRS = [(a, b) for i, a in enumerate(X.CORRELATED) for b in X.CORRELATED[i + 1 :]]
COR_SQL = f"SELECT p.metric_a, p.metric_b, round(list_extract(r.rs, p.k), 4) AS r, abs(list_extract(r.rs, p.k)) > 0.6 AS strong FROM (SELECT [{COR}] AS rs FROM metrics) r CROSS JOIN (VALUES {', '.join(f"({k + 1}, '{a}', '{b}')" for k, (a, b) in enumerate(PAIRS))}) p(k, metric_a, metric_b)"
GROUPS = ", ".join(
    f"count(*) FILTER ({c}) AS n_{s}, round(avg(read_amplification) FILTER ({c}), 6) AS amplification_{s}, round(avg(100.0 * repeated_reads / total_reads) FILTER ({c}), 6) AS repeated_pct_{s}, round(avg(passes) FILTER ({c}), 6) AS passes_{s}"
    for s, c in (("large", "file_size >= 500000"), ("small", "file_size < 500000"))
)
WELCH = "round((avg(read_amplification) FILTER (file_size >= 500000) - avg(read_amplification) FILTER (file_size < 500000)) / sqrt(var_samp(read_amplification) FILTER (file_size >= 500000) / count(*) FILTER (file_size >= 500000) + var_samp(read_amplification) FILTER (file_size < 500000) / count(*) FILTER (file_size < 500000)), 6) AS welch_t"
LABEL_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round({e.format("process_name = 'scanner.exe'")}, 6) AS scanner, round({e.format("process_name = 'indexer.exe'")}, 6) AS indexer FROM ok"
    for m, e in (("reads", "CAST(count(*) FILTER ({0}) AS DOUBLE)"), ("mean_length", "avg(length) FILTER ({0})"), ("unique_offsets", "CAST(count(DISTINCT read_offset) FILTER ({0}) AS DOUBLE)"), ("bytes_per_trace", "sum(length) FILTER ({0}) / count(DISTINCT trace_id) FILTER ({0})"))
)
LABEL_SQL += " UNION ALL SELECT 'length ' || rn, CAST(max(CASE WHEN process_name = 'scanner.exe' THEN length END) AS DOUBLE), CAST(max(CASE WHEN process_name = 'indexer.exe' THEN length END) AS DOUBLE) FROM (SELECT process_name, length, row_number() OVER (PARTITION BY process_name ORDER BY count(*) DESC, length) AS rn FROM ok GROUP BY process_name, length) WHERE rn <= 5 GROUP BY rn"
FIND_SQL = """SELECT 'first region is the DOS header' AS finding, count(*) AS n, '' AS detail FROM entries WHERE pos = 1 AND region = 'DOS Header'
    UNION ALL SELECT 'tail probes', count(*), '' FROM probed WHERE tail
    UNION ALL SELECT 'read amplification', count(*), printf('mean %.2f, worst trace ', avg(read_amplification)) || (SELECT trace_id FROM metrics ORDER BY read_amplification DESC, trace_id LIMIT 1) FROM metrics
    UNION ALL SELECT 'regions touched in every trace', count(*), coalesce(string_agg(region_name, ', ' ORDER BY region_name), '') FROM (SELECT region_name FROM byreg GROUP BY region_name HAVING count(*) = (SELECT count(*) FROM metrics))
    UNION ALL SELECT 'trace and band pairs of 256 KiB and more', count(*), '' FROM (SELECT DISTINCT trace_id, length > 524288 FROM ok WHERE length > 262144)
    UNION ALL SELECT 'headers re-read', count(*), '' FROM byreg WHERE {0} = 'headers' AND repeated_reads > 1"""

TABLE = {
    "c4_trace_pair_diff": (c4, sql(f"""SELECT pair, count(lo) AS left_reads, count(ro) AS right_reads, coalesce(min(CASE WHEN NOT same THEN n END), max(n) + 1) - 1 AS common_prefix, count(*) FILTER (same) AS equal_positions, {big('coalesce(sum(ll), 0) - coalesce(sum(rl), 0)')} AS bytes_delta, bool_and(same) AS exact_match FROM
        (SELECT coalesce(a.trace_id, b.trace_id) // 2 AS pair, coalesce(a.n, b.n) AS n, a.read_offset AS lo, b.read_offset AS ro, a.length AS ll, b.length AS rl, coalesce(a.read_offset = b.read_offset AND a.length = b.length, false) AS same FROM (SELECT * FROM seq WHERE trace_id % 2 = 0) a FULL JOIN (SELECT * FROM seq WHERE trace_id % 2 = 1) b ON b.trace_id = a.trace_id + 1 AND a.n = b.n) GROUP BY pair""")),
    "c5_label_comparison": (c5, sql(LABEL_SQL)),
    "c6_archive_coverage": (c6, sql(f"""SELECT m.file_id, m.region_name, split_part(m.region_name, '::', 1) AS kind, regexp_extract(CASE WHEN contains(m.region_name, '::') THEN split_part(m.region_name, '::', 2) ELSE m.region_name END, '\\.([A-Za-z0-9]+)$', 1) AS extension, m.end_offset - m.start_offset + 1 AS size,
        count(k.o) AS events, {big('coalesce(sum(least(k.o + k.l, m.end_offset + 1) - greatest(k.o, m.start_offset)) FILTER (k.o IS NOT NULL), 0)')} AS bytes, round(coalesce(sum(least(k.o + k.l, m.end_offset + 1) - greatest(k.o, m.start_offset)) FILTER (k.o IS NOT NULL), 0) / (m.end_offset - m.start_offset + 1), 6) AS read_ratio
        FROM member_regions m LEFT JOIN (SELECT l_partkey % 50 AS f, (l_orderkey * 37) % 20000 AS o, CAST(l_quantity AS BIGINT) * 8 AS l FROM lineitem) k ON k.f = m.file_id AND k.o <= m.end_offset AND k.o + k.l - 1 >= m.start_offset GROUP BY m.file_id, m.region_name, m.start_offset, m.end_offset""", ENTRIES, ARCHIVES, MEMBERS)),
    "h1_trace_metrics": (measured(lambda m: m.select("trace_id", "total_reads", "unique_offsets", "repeated_reads", "bytes_read", "passes", "region_count", *[F.col(c) for c in X.SUMMARY if c not in ("total_reads", "unique_offsets", "repeated_reads", "bytes_read", "passes", "region_count", "file_size", "std_read")], F.round("std_read", 4).alias("std_read"))), sql("SELECT trace_id, total_reads, unique_offsets, repeated_reads, bytes_read, passes, region_count, " + METRIC_COLUMNS.replace("round(CAST(std_read AS DOUBLE), 6)", "round(CAST(std_read AS DOUBLE), 4)") + " FROM metrics")),
    "h2_metric_summary": (measured(lambda m: X.metric_summary(m).select("metric", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "q1", "q3", "min", "max", "ci_low", "ci_high")])), sql("SELECT metric, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.75), 4) AS q3, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 4) AS ci_low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 4) AS ci_high FROM long_metrics GROUP BY metric", LONG)),
    "h3_aggregate_helpers": (measured(lambda m: X.metric_extremes(m, ["total_reads", "unique_offsets", "repeated_reads", "bytes_read", "passes", "region_count"])), sql("SELECT metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(CASE WHEN value = mx THEN trace_id END) AS argmax, min(CASE WHEN value = mn THEN trace_id END) AS argmin FROM (SELECT *, max(value) OVER (PARTITION BY metric) AS mx, min(value) OVER (PARTITION BY metric) AS mn FROM long_metrics WHERE metric IN ('total_reads', 'unique_offsets', 'repeated_reads', 'bytes_read', 'passes', 'region_count')) GROUP BY metric", LONG)),
    "h4_first_region_counts": (timed(X.first_region_counts), sql("SELECT region AS first_region, count(*) AS traces FROM entries WHERE pos = 1 GROUP BY region")),
    "h5_coverage_matrix": (mapped(X.coverage_matrix), sql("SELECT v.trace_id, v.region_name, round(100.0 * v.covered / v.region_size, 6) AS coverage_pct, round(ln(1 + b.read_count), 6) AS log_reads FROM regcov v JOIN byreg b USING (trace_id, region_name) WHERE v.region_name IN (SELECT region_name FROM byreg GROUP BY region_name HAVING count(*) >= 0.3 * (SELECT count(DISTINCT trace_id) FROM ok))")),
    "h6_region_totals": (mapped(X.region_totals), sql(f"SELECT region_name, {big('sum(read_count)')} AS total_reads, {big('sum(bytes_read)')} AS total_bytes FROM byreg GROUP BY region_name")),
    "h7_region_frequency": (mapped(X.region_frequency), sql(f"SELECT region_name, count(*) AS traces, round(100.0 * count(*) / (SELECT count(DISTINCT trace_id) FROM ok), 6) AS pct_traces, {big('sum(read_count)')} AS total_reads, {big('sum(bytes_read)')} AS total_bytes FROM byreg GROUP BY region_name")),
    "h8_region_order_consensus": (timed(X.order_consensus), sql("SELECT rank, place, region, traces FROM (SELECT rank, region, count(*) AS traces, row_number() OVER (PARTITION BY rank ORDER BY count(*) DESC, min(trace_id)) AS place FROM ranks GROUP BY rank, region) WHERE place <= 3")),
    "h9_offset_bins": (ok(X.offset_bins), sql("SELECT b.bin, count(DISTINCT k.trace_id) AS traces, round(count(DISTINCT k.trace_id) / (SELECT count(DISTINCT trace_id) FROM ok), 6) AS fraction FROM (SELECT unnest(range(64)) AS bin) b LEFT JOIN ok k ON least(k.read_offset * 64 // k.file_size, 63) = b.bin GROUP BY b.bin")),
    "h10_chunk_frequency": (ok(X.chunk_frequency), sql(f"SELECT CAST(b.o AS INT) AS band_ord, b.band, count(k.trace_id) AS total_reads, round(100.0 * count(DISTINCT k.trace_id) / (SELECT count(DISTINCT trace_id) FROM ok), 6) AS pct_traces FROM (VALUES {', '.join(f"({k}, '{n}')" for k, (_, _, n) in enumerate(CHUNK_BANDS))}) b(o, band) LEFT JOIN ok k ON ({band_of()}) = b.band GROUP BY b.o, b.band")),
    "h11_pass_distribution": (ok(X.pass_distribution), sql("SELECT passes, count(*) AS traces FROM passes GROUP BY passes")),
    "h12_repeat_summary": (ok(X.repeat_summary), sql(f"SELECT {big('sum(total_reads)')} AS total_reads, {big('sum(unique_offsets)')} AS unique_offsets, {big('sum(repeated_reads)')} AS repeated_reads, round(100.0 * sum(repeated_reads) / sum(total_reads), 6) AS repeated_pct, round(avg(100.0 * repeated_reads / total_reads), 6) AS mean_repeated_pct FROM stats")),
    "h13_region_aggregate": (mapped(X.region_aggregate), sql(NEAR_SQL.format(big("sum(b.read_count)"), big("sum(b.bytes_read)"), big("sum(b.repeated_reads)"), class_of("b.region_name")))),
    "h14_correlation": (measured(lambda m: X.correlation(m).withColumn("r", F.round("r", 4))), sql(COR_SQL)),
    "h15_size_group_test": (measured(X.size_group_test), sql(f"SELECT {GROUPS}, {WELCH} FROM metrics")),
    "h16_zscore_outliers": (measured(X.zscore_outliers), sql("SELECT trace_id, metric, round(value, 6) AS value, round(z, 6) AS z FROM zs", LONG, ZS)),
    "h16_zscore_outliers_library": (measured(lambda m: X.zscore_outliers(m, X.LIBRARY_Z)), sql("SELECT trace_id, metric, round(value, 6) AS value, round(z, 6) AS z FROM zs", LONG, ("zs", Z_SQL.format(names(X.LIBRARY_Z))))),
    "h17_iqr_outliers": (measured(X.iqr_outliers), sql("SELECT trace_id, metric, round(value, 6) AS value, round(low, 6) AS low, round(high, 6) AS high FROM iqrs", LONG, IQRS)),
    "h18_rule_outliers": (rules, sql("SELECT * FROM ruled", *PHASES, PROBED, RULED)),
    "h19_anomaly_report": (lambda s, d: X.anomaly_report(X.trace_metrics(A.completed(s, d), A.regions(s)), rules(s, d)), sql("SELECT trace_id, type, metric, value, row_number() OVER (PARTITION BY trace_id ORDER BY type, metric, value) AS place FROM (SELECT trace_id, 'z-score outlier' AS type, metric, printf('%.3f', value) AS value FROM zs UNION ALL SELECT trace_id, 'IQR outlier', metric, printf('%.3f', value) FROM iqrs UNION ALL SELECT * FROM ruled)", *PHASES, LONG, ZS, IQRS, PROBED, RULED)),
    "h20_findings": (h20, sql(FIND_SQL.format(class_of()), PROBED)),
    "h21_headline_totals": (measured(X.headline_totals), sql(f"SELECT count(*) AS traces, {big('sum(total_reads)')} AS total_reads, {big('sum(bytes_read)')} AS total_bytes, round(avg(read_amplification), 6) AS mean_amplification, round(avg(duration_seconds), 6) AS mean_duration, count(*) FILTER (coverage_pct >= 100) AS fully_covered, round(avg(100.0 * repeated_reads / total_reads) FILTER (file_size >= 500000), 6) AS large_repeated_pct, round(avg(100.0 * repeated_reads / total_reads) FILTER (file_size < 500000), 6) AS small_repeated_pct FROM metrics")),
    "h22_feature_vectors": (lambda s, d: rounded(X.feature_vectors(X.long_features(A.completed(s, d), A.regions(s))).select("trace_id", F.posexplode("features").alias("k", "value")).where("value != 0").select("trace_id", F.element_at(F.array(*[F.lit(f) for f in X.FEATURES]), F.col("k") + 1).alias("feature"), "value")), sql("SELECT trace_id, feature, round(value, 6) AS value FROM feats", FEATS)),
    "h23_standardised_distance": (vectors(X.distances), sql("SELECT x.trace_id AS a, y.trace_id AS b, round(sqrt(sum(pow(x.z - y.z, 2))), 6) AS distance FROM std x JOIN std y ON x.feature = y.feature AND x.trace_id <> y.trace_id GROUP BY ALL", FEATS, STD)),
    "h24_cluster_traces": (h24, None),
    "h25_feature_covariance": (
        lambda s, d: X.feature_covariance(X.standardised(X.long_features(A.completed(s, d), A.regions(s)))).select("a", "b", (F.round("covariance", 6) + F.lit(0.0)).alias("covariance")),
        sql("SELECT x.feature AS a, y.feature AS b, round(sum(x.z * y.z) / count(*), 6) + 0.0 AS covariance FROM std x JOIN std y ON x.trace_id = y.trace_id AND x.feature <= y.feature GROUP BY ALL", FEATS, STD),
    ),
    "h25_pca_projection": (vectors(X.pca_projection), None),
}
