"""Range joins of reads with regions, and what is counted per region.

`regions`: file_id, region_ord, region_name, start_offset, end_offset (inclusive); a trace reads the file `file_id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import NOTE_RANGES
from ..functions.expressions import ratio, region_class, top
from .intervals import covered
from .segments import BIN, apart, asof, large_files, named_marks, sound, split_reads, touching

def ranked(regions: DataFrame) -> DataFrame:
    """Regions with their rank by start; ties in reverse order of definition."""
    return regions.withColumn("region_rank", F.row_number().over(Window.partitionBy("file_id").orderBy("start_offset", F.desc("region_ord"))))


def _touches() -> Column:
    return (F.col("length") > 0) & (F.col("read_offset") <= F.col("end_offset")) & (F.col("read_offset") + F.col("length") - 1 >= F.col("start_offset"))


def _spans(regions: DataFrame, *others: str) -> DataFrame:
    return sound(regions).select(F.col("file_id").alias("_file"), *others, "start_offset", "end_offset")


def _levels_join(reads: DataFrame, regions: DataFrame, spans: DataFrame, how: str, width: int = BIN) -> DataFrame:
    """Inner, left and anti joins by levels; a left join is the touching reads and the others."""
    if how == "left_anti":
        return apart(reads, regions)
    met = touching(reads, spans, width)
    return met if how == "inner" else met.unionByName(apart(reads, regions), allowMissingColumns=True)


def _join(reads: DataFrame, regions: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """By file, which Spark broadcasts by size, where a file has few regions; by levels where it has many."""
    files = large_files(regions)
    plain = lambda rows: rows.join(spans, (F.col("file_id") == F.col("_file")) & _touches(), how)
    if files is None:
        return plain(reads)
    of_large, others = split_reads(reads, files)
    large = sound(regions).join(files, F.col("file_id") == F.col("_file"), "left_semi")
    return _levels_join(of_large, large, spans.join(files, "_file", "left_semi"), how).unionByName(plain(others))


def overlap(reads: DataFrame, regions: DataFrame, how: str = "left") -> DataFrame:
    """Every read with every region that it touches."""
    return _join(reads, regions, _spans(ranked(regions), "region_name", "region_ord", "region_rank"), how).drop("_file")


def overlap_binned(reads: DataFrame, regions: DataFrame, width: int = BIN, how: str = "inner") -> DataFrame:
    """overlap() by levels, however many regions a file has."""
    return _levels_join(reads, regions, _spans(ranked(regions), "region_name", "region_ord", "region_rank"), how, width).drop("_file")


def unmapped(reads: DataFrame, regions: DataFrame) -> DataFrame:
    return _join(reads, regions, _spans(regions), "left_anti")


def _first_of_few(rows: DataFrame, regions: DataFrame, at: str, out: str, order: tuple[str, ...], outside: tuple[str | None, str | None, str | None]) -> DataFrame:
    """A file's regions (MANY at most) come to its rows as one array."""
    span = F.struct(*order, F.col("start_offset").alias("_s"), F.col("end_offset").alias("_e"), F.col("region_name").alias("_name"))
    lists = sound(regions).groupBy(F.col("file_id").alias("_file")).agg(F.array_sort(F.collect_list(span)).alias("_spans"), F.min("start_offset").alias("_first"), F.max("end_offset").alias("_last"))
    before, between, behind = (F.lit(x).cast("string") for x in outside)
    holding = F.get(F.filter("_spans", lambda r: (F.col(at) >= r["_s"]) & (F.col(at) <= r["_e"])), F.lit(0))["_name"]
    joined = rows.join(lists, F.col("file_id") == F.col("_file"), "left")
    label = F.coalesce(holding, F.when(F.col(at) < F.col("_first"), before).when(F.col(at) > F.col("_last"), behind).otherwise(between))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], label.alias(out))


def first_region(rows: DataFrame, regions: DataFrame, at: str, out: str, order: tuple[str, ...], outside: tuple[str | None, str | None, str | None]) -> DataFrame:
    """`rows` with the first region of their file, in an order, that holds an offset; else what stands for before, between and behind.

    One row for each row, equal ones included: from a list where a file has few regions, by an as-of join with segments where it has many.
    """
    files = large_files(regions)
    if files is None:
        return _first_of_few(rows, regions, at, out, order, outside)
    of_large, others = split_reads(rows, files)
    own = F.col("file_id") == F.col("_file")
    found = asof(of_large, named_marks(regions.join(files, own, "left_semi"), order, outside), at, "_mark")
    named = found.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col("_mark").isNull(), F.lit(outside[1])).otherwise(F.col("_mark.name")).alias(out))
    return named.unionByName(_first_of_few(others, regions.join(files, own, "left_anti"), at, out, order, outside))


def point_region(reads: DataFrame, regions: DataFrame, at: str = "read_offset", out: str = "region") -> DataFrame:
    """The first region by order of definition that holds an offset; header, trailing or Unknown otherwise."""
    return first_region(reads, regions, at, out, ("region_ord",), ("header", "Unknown", "trailing"))


def by_region(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """trace_id, region_name, reads, unique offsets, bytes, repeats; a read's whole length counts in each region it touches."""
    by_offset = overlap(reads, regions, "inner").groupBy("trace_id", "region_name", "read_offset").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    return by_offset.groupBy("trace_id", "region_name").agg(
        F.sum("n").alias("read_count"), F.count("*").alias("unique_offsets"), F.sum("bytes").alias("bytes_read"), (F.sum("n") - F.count("*")).alias("repeated_reads")
    )


def region_statistics(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Shares of the trace's reads (unmapped ones too) and of the bytes summed over its regions."""
    totals = reads.groupBy("trace_id").agg(F.count("*").alias("events"))
    whole = F.sum("bytes_read").over(Window.partitionBy("trace_id"))
    joined = by_region(reads, regions).join(totals, "trace_id")
    return joined.select("trace_id", "region_name", "read_count", "unique_offsets", "bytes_read", (100 * ratio(F.col("read_count"), F.col("events"))).alias("pct_reads"), (100 * ratio(F.col("bytes_read"), whole)).alias("pct_bytes"))


def first_access(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """trace_id, region_name and the 0-based number of the first read that touches it."""
    order = Window.partitionBy("trace_id").orderBy("ts", "event_order")
    numbered = reads.withColumn("idx", F.row_number().over(order) - 1)
    return overlap(numbered, regions, "inner").groupBy("trace_id", "region_name").agg(F.min("idx").alias("first_access"), F.min_by("region_rank", F.struct("idx", "region_rank")).alias("first_rank"))


def top_regions(reads: DataFrame, regions: DataFrame, k: int = 3) -> DataFrame:
    """The first k regions by reads and by bytes; ties go to the one accessed first."""
    stats = by_region(reads, regions).join(first_access(reads, regions), ["trace_id", "region_name"])
    parts = [top(stats, k, ["trace_id"], F.desc(c), F.col("first_access"), F.col("first_rank")).select("trace_id", F.lit(by).alias("ranking"), F.col("rn").alias("rank"), "region_name", F.col(c).alias("value")) for by, c in (("reads", "read_count"), ("bytes", "bytes_read"))]
    return parts[0].unionByName(parts[1])


def region_coverage(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Share of each touched region's bytes that were read; of equal names the first by definition gives the bounds."""
    bounds = regions.groupBy("file_id", "region_name").agg(F.min_by(F.struct("region_ord", "start_offset", "end_offset"), "region_ord").alias("r")).select("file_id", "region_name", "r.*")
    clipped = overlap(reads, bounds, "inner").select(
        "trace_id", "region_name", (F.col("end_offset") - F.col("start_offset") + 1).alias("size"), F.greatest("read_offset", "start_offset").alias("lo"), F.least(F.col("read_offset") + F.col("length"), F.col("end_offset") + 1).alias("hi")
    )
    return covered(clipped, ["trace_id", "region_name", "size"]).select("trace_id", "region_name", F.col("size").alias("region_size"), "covered", (100 * ratio(F.col("covered"), F.col("size"))).alias("coverage_pct"))


def coverage_status(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Status of every region of the trace's file, those never read too, and a TOTAL row."""
    slots = reads.select("trace_id", "file_id").distinct().join(regions.select("file_id", "region_name", (F.col("end_offset") - F.col("start_offset") + 1).alias("region_size")), "file_id")
    filled = slots.join(region_coverage(reads, regions).select("trace_id", "region_name", "covered"), ["trace_id", "region_name"], "left").select("trace_id", "region_name", "region_size", F.coalesce("covered", F.lit(0)).alias("covered"))
    every = filled.rollup("trace_id", "region_name").agg(F.sum("region_size").alias("region_size"), F.sum("covered").alias("covered")).where("trace_id IS NOT NULL")
    pct = 100 * ratio(F.col("covered"), F.col("region_size"))
    status = F.when(pct >= 100, "FULLY").when(pct > 75, "HEAVILY").when(pct > 25, "PARTIALLY").when(pct > 0, "LIGHTLY").otherwise("NOT ACCESSED")
    return every.select("trace_id", F.coalesce("region_name", F.lit("TOTAL")).alias("region_name"), "region_size", "covered", pct.alias("coverage_pct"), status.alias("status"))


def class_rollup(reads: DataFrame, regions: DataFrame) -> DataFrame:
    return by_region(reads, regions).groupBy("trace_id", region_class().alias("region_class")).agg(
        F.sum("read_count").alias("reads"), F.sum("bytes_read").alias("bytes"), F.sum("unique_offsets").alias("unique_offsets"), F.sum("repeated_reads").alias("repeated_reads"), F.count("*").alias("regions")
    )


def region_profile(reads: DataFrame, regions: DataFrame) -> DataFrame:
    keys = ["trace_id", "region_name"]
    return by_region(reads, regions).join(region_coverage(reads, regions), keys).join(first_access(reads, regions).drop("first_rank"), keys).select("*", region_class().alias("region_class"))


def region_cells(reads: DataFrame, regions: DataFrame, width: int = 50) -> DataFrame:
    from .statistics import coverage_cells

    spans = overlap(reads, regions, "inner").select(
        "trace_id", "region_name", (F.greatest("read_offset", "start_offset") - F.col("start_offset")).alias("lo"),
        (F.least(F.col("read_offset") + F.col("length") - 1, F.col("end_offset")) - F.col("start_offset")).alias("last"), (F.col("end_offset") - F.col("start_offset") + 1).alias("size"),
    )
    return coverage_cells(spans, ["trace_id", "region_name"], width)


def annotation(ranges: list[tuple[int, int, str]] = NOTE_RANGES) -> Column:
    """The first note that fits a read, by its number, offset and length, the file's size, and the ranges that are named."""
    at, size = F.col("read_offset"), F.col("length")
    note = (
        F.when((at == 0) & (F.col("read_number") <= 2), "header probe").when(at > F.col("file_size") - 10000, "footer").when(at == 0, "re-read: header validation").when(size >= 524288, "bulk scan chunk")
        .when((size <= 4096) & (at < 1536), "header structure probe")
    )
    for least, greatest, name in ranges:
        note = note.when(at.between(least, greatest), name)
    return note.otherwise("")
