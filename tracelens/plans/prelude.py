"""Common table expressions of the DuckDB oracles: the adapters' tables in SQL."""

from __future__ import annotations

import re

from ..functions.constants import BAND_SYSTEMS, READ_OPS, REGION_CLASSES
from . import adapters as A


def duck(expr: str) -> str:
    return expr.replace("AS STRING", "AS VARCHAR")


def columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"{duck(e)} AS {c}" for c, e in exprs.items())


def quoted(v) -> str:
    return "'" + v + "'" if isinstance(v, str) else str(v)


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def names(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


def class_of(name: str = "region_name") -> str:
    return "CASE " + " ".join(f"WHEN {name} IN ({names(v)}) THEN '{k}'" for k, v in REGION_CLASSES.items()) + f" WHEN {name} IS NULL THEN NULL ELSE 'section' END"


def band_of(system: str = "chunk", length: str = "length") -> str:
    bands = BAND_SYSTEMS[system]
    return "CASE " + " ".join(f"WHEN {length} <= {hi} THEN '{n}'" for _, hi, n in bands[:-1]) + f" ELSE '{bands[-1][2]}' END"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


W = "(PARTITION BY trace_id ORDER BY ts, event_order)"
TOUCH = "k.read_offset <= r.end_offset AND k.read_offset + k.length - 1 >= r.start_offset"
CTES = {
    "reads": f"SELECT ts, {columns(A.READ_COLUMNS)} FROM events",
    "ok": f"SELECT * FROM reads WHERE operation IN ({names(READ_OPS)}) AND result = 'SUCCESS'",
    "seq": f"SELECT *, row_number() OVER {W} AS n, count(*) OVER (PARTITION BY trace_id) AS total, lag(read_offset) OVER {W} AS prev, lag(read_offset + length) OVER {W} AS prev_end, lag(epoch_us(ts)) OVER {W} AS prev_us, max(read_offset) OVER (PARTITION BY trace_id ORDER BY ts, event_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM ok",
    "regions": f"SELECT * FROM (VALUES {values([(1, k, n, s, e) for k, (n, s, e) in enumerate(A.REGIONS)])}) v(file_id, region_ord, region_name, start_offset, end_offset)",
    "ranked": "SELECT *, row_number() OVER (ORDER BY start_offset, region_ord DESC) AS region_rank FROM regions",
    "mapped": f"SELECT k.*, r.region_name, r.region_ord, r.region_rank, r.start_offset, r.end_offset FROM seq k JOIN ranked r ON {TOUCH}",
    "byreg": "SELECT trace_id, region_name, count(*) AS read_count, count(DISTINCT read_offset) AS unique_offsets, CAST(sum(length) AS BIGINT) AS bytes_read, count(*) - count(DISTINCT read_offset) AS repeated_reads, min(n) - 1 AS first_access FROM mapped GROUP BY ALL",
    "entries": f"SELECT k.trace_id, k.ts, epoch_us(k.ts) AS us, k.read_offset, k.length, coalesce(r.region_name, 'Unmapped') AS region, row_number() OVER (PARTITION BY k.trace_id ORDER BY k.ts, k.event_order, coalesce(r.region_rank, 0)) AS pos FROM ok k LEFT JOIN ranked r ON {TOUCH}",
    "clipped": "SELECT trace_id, region_name, end_offset - start_offset + 1 AS size, greatest(read_offset, start_offset) AS lo, least(read_offset + length, end_offset + 1) AS hi FROM mapped",
    "regcov": "SELECT trace_id, region_name, size AS region_size, CAST(sum(greatest(hi - greatest(lo, coalesce(reach, lo)), 0)) AS BIGINT) AS covered FROM (SELECT *, max(hi) OVER (PARTITION BY trace_id, region_name ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM clipped) GROUP BY ALL",
    "stats": "SELECT trace_id, count(*) AS total_reads, count(DISTINCT read_offset) AS unique_offsets, count(*) - count(DISTINCT read_offset) AS repeated_reads, CAST(sum(length) AS BIGINT) AS bytes_read, sum(length) / max(file_size) AS read_amplification, max(file_size) AS file_size FROM ok GROUP BY trace_id",
    "cov": "SELECT trace_id, file_size, CAST(sum(greatest(read_offset + length - greatest(read_offset, coalesce(reach, read_offset)), 0)) AS BIGINT) AS covered FROM (SELECT *, max(read_offset + length) OVER (PARTITION BY trace_id ORDER BY read_offset, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok) GROUP BY ALL",
    "blockcov": "SELECT trace_id, count(DISTINCT read_offset // 4096) AS touched, max(greatest(1, (file_size + 4095) // 4096)) AS total FROM ok GROUP BY trace_id",
    "ent": "SELECT trace_id, CASE WHEN max(blocks) > 1 THEN -sum(p * log2(p)) / log2(max(blocks)) ELSE 0.0 END AS entropy FROM (SELECT trace_id, blocks, count(*) / sum(count(*)) OVER (PARTITION BY trace_id) AS p FROM (SELECT trace_id, (file_size + 4095) // 4096 AS blocks, least(read_offset // 4096, (file_size + 4095) // 4096 - 1) AS b FROM ok) GROUP BY trace_id, blocks, b) GROUP BY trace_id",
    "seqm": "SELECT trace_id, coalesce(count(*) FILTER (read_offset = prev_end) / nullif(count(prev), 0), 1.0) AS contiguous, coalesce(count(*) FILTER (read_offset >= prev) / nullif(count(prev), 0), 1.0) AS forward, coalesce(sum(abs(read_offset - prev)) / nullif(count(prev), 0), 0.0) AS avg_jump FROM seq GROUP BY trace_id",
    "passes": "SELECT trace_id, count(*) FILTER (n = 1 OR (read_offset < most AND prev >= most)) AS passes, string_agg(CAST(n - 1 AS VARCHAR), ';' ORDER BY n) FILTER (n = 1 OR (read_offset < most AND prev >= most)) AS pass_starts FROM seq GROUP BY trace_id",
    "sizes": "SELECT trace_id, min(length) AS min_read, max(length) AS max_read, avg(length) AS mean_read, median(length) AS median_read, stddev_pop(length) AS std_read FROM ok GROUP BY trace_id",
    "metrics": "SELECT s.trace_id, CAST(s.file_size AS DOUBLE) AS file_size, s.total_reads, s.unique_offsets, s.repeated_reads, s.bytes_read, s.read_amplification, 100 * least(c.covered / c.file_size, 1.0) AS coverage_pct, 100.0 * b.touched / b.total AS block_coverage_pct, e.entropy AS offset_entropy, q.contiguous, p.passes, t.us / 1e6 AS duration_seconds, coalesce(g.k, 0) AS region_count, z.mean_read, z.median_read, z.std_read, t.aligned AS aligned_pct, q.avg_jump, q.forward, t.beyond, t.unaligned FROM stats s JOIN cov c USING (trace_id) JOIN blockcov b USING (trace_id) JOIN ent e USING (trace_id) JOIN seqm q USING (trace_id) JOIN passes p USING (trace_id) JOIN sizes z USING (trace_id) JOIN (SELECT trace_id, max(epoch_us(ts)) - min(epoch_us(ts)) AS us, 100.0 * count(*) FILTER (read_offset % 4096 = 0) / count(*) AS aligned, count(*) FILTER (read_offset % 4096 <> 0) AS unaligned, count(*) FILTER (read_offset + length > file_size) AS beyond FROM ok GROUP BY trace_id) t USING (trace_id) LEFT JOIN (SELECT trace_id, count(*) AS k FROM byreg GROUP BY trace_id) g USING (trace_id)",
    "ranks": "SELECT trace_id, region, row_number() OVER (PARTITION BY trace_id ORDER BY min(pos)) AS rank, count(*) AS visits, min(pos) AS pos FROM entries GROUP BY trace_id, region",
}


def sql(body: str, *extra: tuple[str, str]) -> str:
    """`body` with the common table expressions that it needs, directly or through others."""
    every = CTES | dict(extra)
    needed: list[str] = []

    def need(text: str) -> None:
        for name in every:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(every[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    return ("WITH " + ", ".join(f"{n} AS ({every[n]})" for n in needed) + " " if needed else "") + body
