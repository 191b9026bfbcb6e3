"""Registered queries over reads, regions, sequences and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import BAND_SYSTEMS, PHASE_RULES, READ_OPS
from ..functions.expressions import region_class, rounded
from ..functions.storage import scratch
from ..operators import regions as R
from ..operators import sequence as Q
from ..operators import statistics as S
from ..operators import timeline as L
from . import adapters as A
from .prelude import W, band_of, big, class_of, names, r6, sql

#: Rules with ordered optional regions beside the default ones.
RULES = [*PHASE_RULES, ("Ordered Data", ["Unmapped"], [".rdata", ".rsrc"], 2), ("Empty Rule", [], [], 1)]
#: The contiguous adapter in SQL.
CONTIG = (
    "ok",
    f"SELECT * EXCLUDE (k, raw_length), CAST(coalesce(sum(raw_length) OVER (PARTITION BY trace_id ORDER BY event_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN k >= 40 THEN 512 ELSE 0 END AS BIGINT) AS read_offset, raw_length AS length FROM (SELECT * EXCLUDE (read_offset, length), row_number() OVER (PARTITION BY trace_id ORDER BY event_order) - 1 AS k, CAST(CASE WHEN (row_number() OVER (PARTITION BY trace_id ORDER BY event_order) - 1) % 9 < 7 THEN 65536 WHEN (row_number() OVER (PARTITION BY trace_id ORDER BY event_order) - 1) % 9 = 7 THEN 61440 ELSE 4096 END AS BIGINT) AS raw_length FROM (SELECT * FROM reads WHERE operation IN ({names(READ_OPS)}) AND result = 'SUCCESS'))",
)


def ok(f):
    """A query of the completed reads."""
    return lambda spark, d: rounded(f(A.completed(spark, d)))


def mapped(f):
    """A query of the completed reads and the regions."""
    return lambda spark, d: rounded(f(A.completed(spark, d), A.regions(spark)))


def timed(f):
    """A query of the timeline."""
    return lambda spark, d: rounded(f(L.timeline(A.completed(spark, d), A.regions(spark))))


def long(f):
    return lambda spark, d: rounded(f(A.contiguous(spark, d)))


def b2(spark, d):
    """Zero bands are in all four systems."""
    reads = A.completed(spark, d)
    parts = [S.length_bands(reads, bands).withColumn("system", F.lit(name)) for name, bands in BAND_SYSTEMS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).select("trace_id", "system", "band", "reads")


B2_SQL = " UNION ALL ".join(
    f"SELECT t.trace_id, '{s}' AS system, b.band, count(k.read_offset) AS reads FROM (SELECT DISTINCT trace_id FROM ok) t CROSS JOIN (VALUES {', '.join(f"('{n}')" for *_, n in bands)}) b(band) LEFT JOIN ok k ON k.trace_id = t.trace_id AND ({band_of(s)}) = b.band GROUP BY t.trace_id, b.band"
    for s, bands in BAND_SYSTEMS.items()
)

FEATURES_SQL = (
    "features",
    """SELECT trace_id, count(*) AS reads, count(DISTINCT read_offset) AS offsets, count(*) FILTER (n > 1 AND read_offset = prev_end) / count(*) AS sequential_score,
    coalesce(max(CASE WHEN n = 2 THEN read_offset - prev_end END) <> max(CASE WHEN n = 1 THEN length END), false) AND count(*) > 3 AS early_jump,
    coalesce(max(CASE WHEN read_offset + length > top_offset * 0.95 THEN length END), 0) AS footer_size, count(*) FILTER (n <= 3 AND length <= 4096) > 0 AS small_probe, count(*) FILTER (length >= 262144) AS bulk_reads,
    count(*) FILTER (read_offset = 0) AS zero_reads, 100.0 * count(*) FILTER (read_offset % 4096 = 0) / count(*) AS aligned_pct, count(*) FILTER (n <= 5 AND length <= 4096) AS small_header_reads, max(CASE WHEN n = 1 THEN length END) AS first_length
    FROM (SELECT *, max(read_offset) OVER (PARTITION BY trace_id) AS top_offset FROM seq) GROUP BY trace_id""",
)
CLASS_SQL = """SELECT trace_id, round(sequential_score, 6) AS sequential_score, round(aligned_pct, 6) AS aligned_pct, early_jump, CASE WHEN label = '' THEN 'UNCLEAR' ELSE label END AS classification FROM (SELECT *, concat_ws(' / ',
    CASE WHEN sequential_score > 0.8 THEN 'LINEAR READ' WHEN sequential_score > 0.5 THEN 'CHUNKED LINEAR READ' END,
    CASE WHEN sequential_score <= 0.5 AND early_jump AND zero_reads > 3 AND footer_size > 0 THEN 'MIXED STRATEGY' WHEN sequential_score <= 0.5 AND early_jump AND zero_reads > 2 THEN 'HEADER-FOCUSED READ' END,
    CASE WHEN small_probe AND bulk_reads > 0 THEN 'HYBRID (Probe + Bulk Scan)' END, CASE WHEN aligned_pct > 80 THEN 'PAGE-ALIGNED I/O' END) AS label FROM features)"""
NOTES_SQL = " UNION ALL ".join(
    f"SELECT trace_id, {k} AS note_ord, {text} AS note FROM features WHERE {cond}"
    for k, (cond, text) in enumerate((
        ("zero_reads >= 3", "'several reads at offset 0: header validation'"), ("early_jump", "'early jump to a non-zero offset: a structure pointer is followed'"),
        ("small_header_reads >= 3", "'first ' || small_header_reads || ' reads are small (' || first_length || ' bytes): header parsing'"), ("bulk_reads > 0", "bulk_reads || ' reads of 256 KiB or more: bulk content scan'"),
        ("reads <> offsets", "(reads - offsets) || ' repeated reads: several passes'"), ("footer_size > 0", "'reads near the end: footer inspection'"),
    ))
)
POINT = "coalesce((SELECT arg_min(r.region_name, r.region_ord) FROM regions r WHERE {0} BETWEEN r.start_offset AND r.end_offset), CASE WHEN {0} > 1048575 THEN 'trailing' ELSE 'Unknown' END)"
NOTE_SQL = "CASE WHEN read_offset = 0 AND n <= 2 THEN 'header probe' WHEN read_offset > file_size - 10000 THEN 'footer' WHEN read_offset = 0 THEN 're-read: header validation' WHEN length >= 524288 THEN 'bulk scan chunk' WHEN length <= 4096 AND read_offset < 1536 THEN 'header structure probe' WHEN read_offset BETWEEN 1536 AND 24575 THEN 'early code probe' WHEN read_offset BETWEEN 200000 AND 204095 THEN 'import region probe' WHEN read_offset BETWEEN 524288 AND 786431 THEN 'read-only data' WHEN read_offset BETWEEN 786432 AND 917503 THEN 'resource section' WHEN read_offset BETWEEN 917504 AND 921599 THEN 'relocation section' ELSE '' END"
STATUS_SQL = "CASE WHEN pct >= 100 THEN 'FULLY' WHEN pct > 75 THEN 'HEAVILY' WHEN pct > 25 THEN 'PARTIALLY' WHEN pct > 0 THEN 'LIGHTLY' ELSE 'NOT ACCESSED' END"
SIZE_SQL = """SELECT trace_id, min(length) AS min_read, max(length) AS max_read, round(avg(length), 6) AS mean_read, round(median(length), 6) AS median_read, round(stddev_pop(length), 4) AS std_read,
    round(CASE WHEN count(*) = 1 THEN min(length) ELSE list_extract(l, j1) + (list_extract(l, j1 + 1) - list_extract(l, j1)) * (count(*) + 1 - j1 * 4) / 4.0 END, 6) AS q1_read,
    round(CASE WHEN count(*) = 1 THEN min(length) ELSE list_extract(l, j3) + (list_extract(l, j3 + 1) - list_extract(l, j3)) * (3 * (count(*) + 1) - j3 * 4) / 4.0 END, 6) AS q3_read, max(mode_read) AS mode_read, max(mode_count) AS mode_count
    FROM ok JOIN (SELECT trace_id, list(length ORDER BY length) AS l, greatest(1, least((count(*) + 1) // 4, count(*) - 1)) AS j1, greatest(1, least(3 * (count(*) + 1) // 4, count(*) - 1)) AS j3 FROM ok GROUP BY trace_id) USING (trace_id)
    JOIN (SELECT trace_id, length AS mode_read, n AS mode_count FROM (SELECT trace_id, length, count(*) AS n, row_number() OVER (PARTITION BY trace_id ORDER BY count(*) DESC, length) AS rn FROM ok GROUP BY trace_id, length) WHERE rn = 1) USING (trace_id)
    GROUP BY trace_id, l, j1, j3"""
TOP_SQL = """SELECT trace_id, rn, read_offset, times, l || CASE WHEN times > 8 THEN ' +' || (times - 8) || ' more' ELSE '' END AS read_numbers FROM
    (SELECT trace_id, read_offset, count(*) AS times, row_number() OVER (PARTITION BY trace_id ORDER BY count(*) DESC, read_offset) AS rn FROM ok GROUP BY trace_id, read_offset HAVING count(*) > 1)
    JOIN (SELECT trace_id, read_offset, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS l FROM (SELECT trace_id, read_offset, n, row_number() OVER (PARTITION BY trace_id, read_offset ORDER BY n) AS k FROM seq) WHERE k <= 8 GROUP BY trace_id, read_offset) USING (trace_id, read_offset) WHERE rn <= 10"""
MERGE_SQL = """SELECT trace_id, CAST(island AS BIGINT) AS island, min(read_offset) AS range_start, max(read_offset + length) AS range_end, max(read_offset + length) - min(read_offset) AS range_size, count(*) AS read_count, count(DISTINCT read_offset) AS unique_offsets FROM
    (SELECT *, sum(CASE WHEN reach IS NULL OR read_offset > reach + 4096 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY read_offset, length DESC ROWS UNBOUNDED PRECEDING) AS island FROM
    (SELECT *, max(read_offset + length) OVER (PARTITION BY trace_id ORDER BY read_offset, length DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok)) GROUP BY trace_id, island"""
CELLS = "SELECT {k}, count(*) AS filled, round(count(*) / {w}, 6) AS filled_fraction, array_to_string([CASE WHEN list_contains(list(cell), i) THEN '#' ELSE '.' END FOR i IN range({w})], '') AS drawn FROM (SELECT DISTINCT {k}, unnest(range(least(lo * {w} // size, {w} - 1), least(last * {w} // size, {w} - 1) + 1)) AS cell FROM spans) GROUP BY {k}"
FILE_SPANS = ("spans", "SELECT trace_id, read_offset AS lo, least(read_offset + length, file_size) - 1 AS last, file_size AS size FROM ok WHERE read_offset < file_size")
REGION_SPANS = ("spans", "SELECT trace_id, region_name, greatest(read_offset, start_offset) - start_offset AS lo, least(read_offset + length - 1, end_offset) - start_offset AS last, end_offset - start_offset + 1 AS size FROM mapped")
STAGE_SQL = """SELECT trace_id, CAST(stage AS BIGINT) AS stage, min(n) - 1 AS start_idx, max(n) - 1 AS end_idx, count(*) AS events FROM (SELECT *, 1 + sum(CASE WHEN total >= 3 AND gap > greatest(10 * med, 500) THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS stage
    FROM (SELECT *, epoch_us(ts) - prev_us AS gap, median(epoch_us(ts) - prev_us) OVER (PARTITION BY trace_id) AS med FROM seq)) GROUP BY trace_id, stage"""
CYCLE = ",".join(["65536"] * 7 + ["61440", "4096"])
CYCLE_SQL = f"""SELECT trace_id, CAST(coalesce(c, 0) AS INT) AS cycles FROM (SELECT DISTINCT trace_id FROM ok) LEFT JOIN (SELECT trace_id, count(*) AS c FROM (SELECT trace_id, n, list(length) OVER w AS ls, bool_and(read_offset = prev_end) OVER w2 AS joined FROM seq
    WINDOW w AS (PARTITION BY trace_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING), w2 AS (PARTITION BY trace_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)) WHERE ls = [{CYCLE}] GROUP BY trace_id) USING (trace_id)"""
RUNS_SQL = """SELECT trace_id, CAST(run AS BIGINT) AS run, min(region) AS region, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS entries FROM (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT *, CASE WHEN lag(region) OVER (PARTITION BY trace_id ORDER BY pos) = region THEN 0 ELSE 1 END AS new FROM entries)) GROUP BY trace_id, run"""


def claims(rules) -> list[tuple[str, str]]:
    """One pair of common table expressions per rule: its entries in matching traces, then the timestamps claimed so far."""
    out = []
    for k, (_, required, optional, least) in enumerate(rules):
        relevant = list(dict.fromkeys([*required, *optional]))
        free = f" AND NOT EXISTS (SELECT 1 FROM claimed{k - 1} c WHERE c.trace_id = e.trace_id AND c.us = e.us)" if k else ""
        own = f"SELECT e.* FROM entries e WHERE e.region IN ({names(relevant)}){free}" if relevant else "SELECT e.* FROM entries e WHERE false"
        tests = [f"count(*) >= {max(least, 1)}"] + [f"bool_or(region = '{r}')" for r in required]
        for i, r in enumerate(optional):
            tests += [f"coalesce(min(CASE WHEN region = '{p}' THEN pos END) < min(CASE WHEN region = '{r}' THEN pos END), true)" for p in optional[:i]]
        out.append((f"own{k}", own))
        out.append((f"hit{k}", f"SELECT o.* FROM own{k} o WHERE trace_id IN (SELECT trace_id FROM own{k} GROUP BY trace_id HAVING {' AND '.join(tests)})"))
        out.append((f"claimed{k}", f"SELECT DISTINCT trace_id, us FROM hit{k}" + (f" UNION SELECT trace_id, us FROM claimed{k - 1}" if k else "")))
    out.append(("phases", " UNION ALL ".join(f"SELECT trace_id, {k} AS rule, '{r[0]}' AS phase, min(us) AS start_us, max(us) AS end_us, count(*) AS entry_count FROM hit{k} GROUP BY trace_id" for k, r in enumerate(rules))))
    n = len(rules)
    out.append(("confidence", f"SELECT t.trace_id, coalesce(p.k, 0) AS phases, coalesce(c.n, 0) AS claimed_moments, t.moments, CASE WHEN p.k IS NULL THEN 0.0 ELSE 0.4 * p.k / {n} + 0.4 * c.n / t.moments + 0.2 / (1 + p.k) END AS confidence FROM (SELECT trace_id, count(DISTINCT us) AS moments FROM entries GROUP BY trace_id) t LEFT JOIN (SELECT trace_id, count(*) AS k FROM phases GROUP BY trace_id) p USING (trace_id) LEFT JOIN (SELECT trace_id, count(*) AS n FROM claimed{n - 1} GROUP BY trace_id) c USING (trace_id)"))
    return out


PHASES = claims(RULES)


def rules_from_table(spark, d):
    """Phases by rules that are read from a file."""
    path = scratch(spark, "rules")
    L.rule_table(spark, RULES).write.parquet(path)
    entries = L.timeline(A.completed(spark, d), A.regions(spark))
    return L.detect_phases(entries, spark.read.parquet(path)).drop("phase_ord", "duration_us")


TABLE = {
    "b1_layer_split": (lambda s, d: S.layer_split(A.reads(s, d)), sql(f"SELECT trace_id, count(*) FILTER (operation = 'ReadFile') AS read_ops, count(*) FILTER (operation = 'ReadFile' AND result = 'SUCCESS') AS success_reads, count(*) FILTER (operation = 'ReadFile' AND result <> 'SUCCESS') AS declined_reads, {big("coalesce(sum(length) FILTER (operation = 'ReadFile' AND result <> 'SUCCESS'), 0)")} AS declined_bytes FROM reads GROUP BY trace_id")),
    "b2_length_bands": (b2, sql(B2_SQL)),
    "b3_region_class": (lambda s, d: A.regions(s).select("region_name", region_class().alias("region_class")).join(R.by_region(A.completed(s, d), A.regions(s)), "region_name").groupBy("region_name", "region_class").agg(F.count("*").alias("traces")), sql(f"SELECT region_name, {class_of()} AS region_class, count(*) AS traces FROM byreg GROUP BY ALL")),
    "b4_point_region": (lambda s, d: R.point_region(A.completed(s, d).select("trace_id", "event_order", "file_id", "read_offset"), A.regions(s)).drop("file_id"), sql(f"SELECT trace_id, event_order, read_offset, {POINT.format('read_offset')} AS region FROM ok")),
    "b5_read_annotations": (ok(lambda r: Q.annotated(r, A.NOTE_RANGES)), sql(f"SELECT trace_id, n AS read_number, read_offset, printf('0x%08X', read_offset) AS hex_offset, length, read_offset + length AS read_end, {NOTE_SQL} AS note FROM seq")),
    "b6_coverage_status": (mapped(R.coverage_status), sql(f"SELECT trace_id, region_name, region_size, covered, round(pct, 6) AS coverage_pct, {STATUS_SQL} AS status FROM (SELECT trace_id, coalesce(region_name, 'TOTAL') AS region_name, {big('sum(s)')} AS region_size, {big('sum(c)')} AS covered, 100.0 * sum(c) / sum(s) AS pct FROM (SELECT t.trace_id, r.region_name, r.end_offset - r.start_offset + 1 AS s, coalesce(v.covered, 0) AS c FROM (SELECT DISTINCT trace_id FROM ok) t CROSS JOIN regions r LEFT JOIN regcov v ON v.trace_id = t.trace_id AND v.region_name = r.region_name) GROUP BY GROUPING SETS ((trace_id, region_name), (trace_id)))")),
    "b7_amplification_band": (ok(lambda r: S.read_stats(r).select("trace_id", "read_amplification", F.when(F.col("read_amplification") > 3, "high").when(F.col("read_amplification") > 1.5, "medium").otherwise("low").alias("band"))), sql("SELECT trace_id, round(read_amplification, 6) AS read_amplification, CASE WHEN read_amplification > 3 THEN 'high' WHEN read_amplification > 1.5 THEN 'medium' ELSE 'low' END AS band FROM stats")),
    "b8_pattern_class": (ok(S.pattern_class), sql(CLASS_SQL, FEATURES_SQL)),
    "b9_insights": (ok(S.insights), sql(NOTES_SQL, FEATURES_SQL)),
    "c1_map_reads": (lambda s, d: R.overlap(A.completed(s, d), A.regions(s)).select("trace_id", "event_order", "read_offset", "length", "region_name", "region_rank"), sql("SELECT k.trace_id, k.event_order, k.read_offset, k.length, r.region_name, r.region_rank FROM ok k LEFT JOIN ranked r ON k.read_offset <= r.end_offset AND k.read_offset + k.length - 1 >= r.start_offset")),
    "c1_map_reads_binned": (lambda s, d: R.overlap_binned(A.completed(s, d), A.regions(s)).select("trace_id", "event_order", "region_name", "region_rank"), sql("SELECT trace_id, event_order, region_name, region_rank FROM mapped")),
    "c2_unmapped_reads": (lambda s, d: R.unmapped(A.completed(s, d), A.regions(s)).select("trace_id", "event_order", "read_offset", "length"), sql("SELECT trace_id, event_order, read_offset, length FROM ok k WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE k.read_offset <= r.end_offset AND k.read_offset + k.length - 1 >= r.start_offset)")),
    "c3_region_profile": (mapped(R.region_profile), sql(f"SELECT b.*, v.region_size, v.covered, round(100.0 * v.covered / v.region_size, 6) AS coverage_pct, {class_of('b.region_name')} AS region_class FROM byreg b JOIN regcov v USING (trace_id, region_name)")),
    "d1_read_stats": (ok(S.read_stats), sql("SELECT trace_id, total_reads, unique_offsets, repeated_reads, bytes_read, round(read_amplification, 6) AS read_amplification FROM stats")),
    "d2_read_size_stats": (lambda s, d: S.read_size_stats(A.completed(s, d)).select("trace_id", "min_read", "max_read", *[F.round(c, 6).alias(c) for c in ("mean_read", "median_read")], F.round("std_read", 4).alias("std_read"), *[F.round(c, 6).alias(c) for c in ("q1_read", "q3_read")], "mode_read", "mode_count"), sql(SIZE_SQL)),
    "d3_alignment": (ok(S.alignment), sql("SELECT trace_id, round(100.0 * count(*) FILTER (read_offset % 4096 = 0) / count(*), 6) AS aligned_pct, round(1.0 - count(*) FILTER (read_offset % 4096 = 0) / count(*), 6) AS unaligned_fraction FROM ok GROUP BY trace_id")),
    "d4_offset_entropy": (ok(S.offset_entropy), sql("SELECT trace_id, round(entropy, 6) AS offset_entropy FROM ent")),
    "d5_byte_coverage": (ok(S.byte_coverage), sql("SELECT trace_id, covered, round(least(covered / file_size, 1.0), 6) AS coverage FROM cov")),
    "d6_block_coverage": (ok(S.block_coverage), sql("SELECT trace_id, touched AS blocks_touched, total AS blocks_total, round(100.0 * touched / total, 6) AS block_coverage_pct FROM blockcov")),
    "d7_merge_ranges": (ok(S.merge_ranges), sql(MERGE_SQL)),
    "d8_top_repeated": (ok(S.top_repeated), sql(TOP_SQL)),
    "d9_eof_probes": (ok(lambda r: S.eof_probes(r, A.LAST_REGION_END)), sql(f"SELECT trace_id, count(*) FILTER (read_offset + length > file_size) AS reads_beyond_eof, count(*) FILTER (read_offset + length > file_size) > 0 OR max(read_offset) + max(length) > max(file_size) AS tail_probe_success, bool_or(read_offset + length > {A.LAST_REGION_END}) AS tail_probe_library FROM ok GROUP BY trace_id")),
    "d10_offset_frequency": (ok(S.offset_frequency), sql("SELECT read_offset, count(*) AS reads, count(DISTINCT trace_id) AS traces, read_offset < 20000 AS header_area, read_offset = 0 AS at_zero FROM ok GROUP BY read_offset")),
    "d11_length_frequency": (ok(S.length_frequency), sql(f"SELECT trace_id, length, count(*) AS reads, {big('sum(length)')} AS bytes, round(100.0 * sum(length) / sum(sum(length)) OVER (PARTITION BY trace_id), 6) AS bytes_pct FROM ok GROUP BY trace_id, length")),
    "d12_histograms": (ok(S.offset_histogram), sql("SELECT t.trace_id, b.bin, count(k.read_offset) AS reads, round(ln(1 + count(k.read_offset)), 6) AS log_reads FROM (SELECT DISTINCT trace_id FROM ok) t CROSS JOIN (SELECT unnest(range(64)) AS bin) b LEFT JOIN ok k ON k.trace_id = t.trace_id AND least(k.read_offset * 64 // k.file_size, 63) = b.bin GROUP BY t.trace_id, b.bin")),
    "d13_size_distribution": (ok(S.size_distribution), sql("SELECT trace_id, " + ", ".join(f"round(quantile_cont(length, {q}), 6) AS {n}" for q, n in ((0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"))) + " FROM ok GROUP BY trace_id")),
    "d14_coverage_cells": (ok(S.file_cells), sql(CELLS.format(k="trace_id", w=80), FILE_SPANS)),
    "d14_region_cells": (mapped(R.region_cells), sql(CELLS.format(k="trace_id, region_name", w=50), REGION_SPANS)),
    "e1_region_statistics": (mapped(R.region_statistics), sql("SELECT b.trace_id, region_name, read_count, b.unique_offsets, b.bytes_read, round(100.0 * read_count / s.total_reads, 6) AS pct_reads, round(100.0 * b.bytes_read / sum(b.bytes_read) OVER (PARTITION BY b.trace_id), 6) AS pct_bytes FROM byreg b JOIN stats s USING (trace_id)")),
    "e2_region_repeats": (mapped(lambda r, g: R.by_region(r, g).select("trace_id", "region_name", "repeated_reads")), sql("SELECT trace_id, region_name, repeated_reads FROM byreg")),
    "e3_top_regions": (mapped(R.top_regions), sql(" UNION ALL ".join(f"SELECT trace_id, '{k}' AS ranking, rn AS rank, region_name, {c} AS value FROM (SELECT b.*, row_number() OVER (PARTITION BY b.trace_id ORDER BY {c} DESC, k.pos) AS rn FROM byreg b JOIN ranks k ON k.trace_id = b.trace_id AND k.region = b.region_name) WHERE rn <= 3" for k, c in (("reads", "read_count"), ("bytes", "bytes_read"))))),
    "e4_region_coverage": (mapped(R.region_coverage), sql("SELECT trace_id, region_name, region_size, covered, round(100.0 * covered / region_size, 6) AS coverage_pct FROM regcov")),
    "e5_region_class_rollup": (mapped(R.class_rollup), sql(f"SELECT trace_id, {class_of()} AS region_class, {big('sum(read_count)')} AS reads, {big('sum(bytes_read)')} AS bytes, {big('sum(unique_offsets)')} AS unique_offsets, {big('sum(repeated_reads)')} AS repeated_reads, count(*) AS regions FROM byreg GROUP BY ALL")),
    "f1_read_sequence": (ok(lambda r: Q.read_sequence(r).select("trace_id", "event_order", "read_number", "read_end", "delta")), sql("SELECT trace_id, event_order, n AS read_number, read_offset + length AS read_end, coalesce(read_offset - prev_end, 0) AS delta FROM seq")),
    "f2_sequential_metrics": (long(Q.sequential_metrics), sql(f"SELECT trace_id, {r6('contiguous')} AS contiguous, {r6('forward')} AS forward, {r6('avg_jump')} AS avg_jump FROM seqm", CONTIG)),
    "f3_scan_passes": (ok(Q.scan_passes), sql("SELECT * FROM passes")),
    "f4_pass_labels": (ok(Q.pass_labels), sql("SELECT trace_id, n - 1 AS idx, read_offset, CAST(1 + sum(CASE WHEN read_offset < most THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pass_label FROM seq")),
    "f5_drop_passes": (ok(Q.drop_passes), sql(f"SELECT trace_id, CAST(segment AS BIGINT) AS segment, min(n) - 1 AS first_idx, max(n) - 1 AS last_idx, count(*) AS reads, {big('sum(length)')} AS bytes FROM (SELECT *, 1 + sum(CASE WHEN read_offset < prev AND prev > 100000 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS segment FROM seq) GROUP BY trace_id, segment")),
    "f6_time_stages": (ok(Q.time_stages), sql(STAGE_SQL)),
    "f7_jumps": (mapped(Q.jumps), sql(f"SELECT trace_id, n AS read_number, prev AS from_offset, read_offset AS to_offset, read_offset - prev_end AS gap, abs(read_offset - prev_end) > 50000 AS large, CASE WHEN read_offset >= prev_end THEN 'FWD' ELSE 'BACK' END AS direction, {POINT.format('prev')} AS from_region, {POINT.format('read_offset')} AS to_region FROM seq WHERE n > 1")),
    "f8_interval_distribution": (ok(Q.interval_distribution), sql(f"SELECT trace_id, rn AS rank, interval, times FROM (SELECT trace_id, {big('floor((read_offset - prev) / 4096) * 4096')} AS interval, count(*) AS times, row_number() OVER (PARTITION BY trace_id ORDER BY count(*) DESC, floor((read_offset - prev) / 4096)) AS rn FROM seq WHERE total > 5 AND prev IS NOT NULL GROUP BY trace_id, floor((read_offset - prev) / 4096)) WHERE rn <= 10")),
    "f9_bracket_probes": (ok(Q.bracket_probes), sql("SELECT trace_id, bool_or(n = 1 AND read_offset = 0 AND length = 4096) AS first_is_header, bool_or(n = 2 AND read_offset * 10 > file_size * 9) AS second_is_tail, bool_or(n = total AND read_offset = 0) AS last_is_zero FROM seq GROUP BY trace_id")),
    "f10_access_ladder": (mapped(Q.access_ladder), sql(f"SELECT trace_id, n - 1 AS idx, round((n - 1) / greatest(total - 1, 1), 6) AS position, round(read_offset / file_size, 6) AS offset_fraction, {class_of('name')} AS region_class FROM (SELECT *, (SELECT arg_min(r.region_name, r.start_offset * 100 + r.region_ord) FROM regions r WHERE read_offset BETWEEN r.start_offset AND r.end_offset) AS name FROM seq)")),
    "f11_chunk_cycle": (long(Q.chunk_cycle), sql(CYCLE_SQL.replace("WHERE ls =", "WHERE joined AND ls ="), CONTIG)),
    "g1_timeline": (timed(lambda e: e), sql("SELECT trace_id, pos, region, us, read_offset, length FROM entries")),
    "g2_timeline_summary": (timed(L.timeline_summary), sql("SELECT e.trace_id, e.entries, e.duration_us, e.first_region, e.last_region, k.regions, k.regions_in_order, k.first_ten, k.most_visited FROM (SELECT trace_id, count(*) AS entries, max(us) - min(us) AS duration_us, arg_min(region, pos) AS first_region, arg_max(region, pos) AS last_region FROM entries GROUP BY trace_id) e JOIN (SELECT trace_id, CAST(count(*) AS INT) AS regions, string_agg(region, ' > ' ORDER BY rank) AS regions_in_order, string_agg(region, ' > ' ORDER BY rank) FILTER (rank <= 10) AS first_ten, string_agg(region, ' > ' ORDER BY visits DESC, pos) FILTER (vr <= 3) AS most_visited FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY visits DESC, pos) AS vr FROM ranks) GROUP BY trace_id) k USING (trace_id)")),
    "g3_region_runs": (timed(L.region_runs), sql(RUNS_SQL)),
    "g4_detect_phases": (timed(lambda e: L.detect_phases(e, RULES)), sql("SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY start_us, rule) AS phase_ord, phase, start_us, end_us, end_us - start_us AS duration_us, entry_count FROM phases", *PHASES)),
    "g4_rules_from_table": (rules_from_table, sql("SELECT trace_id, phase, start_us, end_us, entry_count FROM phases", *PHASES)),
    "g5_phase_confidence": (timed(lambda e: L.phase_confidence(e, RULES)), sql("SELECT trace_id, CAST(phases AS INT) AS phases, claimed_moments, moments, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM confidence", *PHASES)),
    "g6_rule_matches": (timed(lambda e: L.rule_matches(e, RULES)), sql(f"SELECT t.trace_id, r.rule_ord, r.phase, p.rule IS NOT NULL AS matched FROM (SELECT DISTINCT trace_id FROM entries) t CROSS JOIN (VALUES {', '.join(f"({k}, '{r[0]}')" for k, r in enumerate(RULES))}) r(rule_ord, phase) LEFT JOIN phases p ON p.trace_id = t.trace_id AND p.rule = r.rule_ord", *PHASES)),
    "g7_phase_summary": (timed(lambda e: L.phase_summary(e, RULES)), sql("SELECT c.trace_id, CASE WHEN c.phases = 0 THEN 'No phases detected.' ELSE 'Detected ' || c.phases || ' phase(s): ' || l || '; confidence ' || CAST(round(100 * CAST(c.confidence AS DOUBLE)) AS INT) || '%' END AS summary FROM confidence c LEFT JOIN (SELECT trace_id, string_agg(phase, ', ' ORDER BY start_us, rule) AS l FROM phases GROUP BY trace_id) USING (trace_id)", *PHASES)),
    "g8_phase_counts": (timed(lambda e: L.phase_counts(e, RULES)), sql("SELECT phase, count(*) AS traces FROM phases GROUP BY phase", *PHASES)),
    "g9_candidate_rules": (ok(lambda r: L.candidate_rules(r, A.IMPORT_RANGE)), sql(" UNION ALL ".join(f"SELECT trace_id, '{k}' AS predicate, {big(f'count(*) FILTER ({t})')} AS hits, round(count(*) FILTER ({t}) / count(*), 6) AS share FROM lagged GROUP BY trace_id" for k, t in (("offset zero", "read_offset = 0"), ("tail read", "read_offset + length >= file_size"), ("import range", "read_offset BETWEEN 200000 AND 204095"), ("bulk 512K", "length = 524288"), ("alternation", "length IN (262144, 258048) AND prev_length IN (262144, 258048) AND length <> prev_length"))), ("lagged", f"SELECT *, lag(length) OVER {W} AS prev_length FROM ok"))),
}
