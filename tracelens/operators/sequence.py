"""Operators over the ordered reads of a trace; windows share the partitioning by trace_id, of hot traces that by slice (slices.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.constants import BLOCK, NOTE_RANGES
from ..functions.expressions import in_order, by_trace, count_where, micros, ratio, region_class, top
from .slices import cut, running
from .regions import annotation, first_region, point_region


def end_of() -> Column:
    return F.col("read_offset") + F.col("length")


def steps(reads: DataFrame) -> DataFrame:
    """Reads with idx (from 0), and of the reads before them: offset, end and time of the last one, the greatest offset."""
    rows = cut(reads, ["trace_id"], micros())
    return running(
        rows, ["trace_id"], ["ts", "event_order"], idx=("count", F.lit(1)), previous=("last", F.col("read_offset")), before=("last", end_of()), before_us=("last", micros()), most=("max", F.col("read_offset"))
    )


def read_sequence(reads: DataFrame) -> DataFrame:
    rows = steps(reads)
    return rows.select(*reads.columns, (F.col("idx") + 1).cast("int").alias("read_number"), end_of().alias("read_end"), F.coalesce(F.col("read_offset") - F.col("before"), F.lit(0)).alias("delta"))


def annotated(reads: DataFrame, ranges: list[tuple[int, int, str]] = NOTE_RANGES) -> DataFrame:
    out = read_sequence(reads).withColumn("hex_offset", F.format_string("0x%08X", "read_offset"))
    return out.select("trace_id", "read_number", "read_offset", "hex_offset", "length", "read_end", annotation(ranges).alias("note"))


def jump_measures() -> list[Column]:
    """Aggregates over steps(): contiguous and forward shares and mean start jump over the n - 1 steps; 1, 1, 0 for a single read."""
    n = F.count("before")
    return [
        F.coalesce(ratio(count_where(F.col("read_offset") == F.col("before")), n), F.lit(1.0)).alias("contiguous"),
        F.coalesce(ratio(count_where(F.col("read_offset") >= F.col("previous")), n), F.lit(1.0)).alias("forward"),
        F.coalesce(ratio(F.sum(F.abs(F.col("read_offset") - F.col("previous"))), n), F.lit(0.0)).alias("avg_jump"),
    ]


def sequential_metrics(reads: DataFrame) -> DataFrame:
    return steps(reads).groupBy("trace_id").agg(*jump_measures())


def pass_measures() -> list[Column]:
    """Aggregates over steps(): a pass starts below the greatest offset so far, right after a read at or beyond what was the greatest then."""
    start = (F.col("idx") == 0) | ((F.col("read_offset") < F.col("most")) & (F.col("previous") >= F.col("most")))
    starts = F.array_sort(F.collect_list(F.when(start, F.col("idx"))))
    return [count_where(start).alias("passes"), F.array_join(F.transform(starts, lambda x: x.cast("string")), ";").alias("pass_starts")]


def scan_passes(reads: DataFrame) -> DataFrame:
    return steps(reads).groupBy("trace_id").agg(*pass_measures())


def pass_labels(reads: DataFrame) -> DataFrame:
    below = F.when(F.col("read_offset") < F.col("most"), 1).otherwise(0)
    return numbered_runs(steps(reads).withColumn("_below", below), "_below", "pass_label").select("trace_id", F.col("idx").cast("int").alias("idx"), "read_offset", "pass_label")


def numbered_runs(rows: DataFrame, starts: str, name: str) -> DataFrame:
    """`rows` with the number, from 1, of the run that each is in; `starts` is 1 where one begins."""
    return running(rows, ["trace_id"], ["idx"], **{name: ("sum", F.col(starts))}).withColumn(name, F.col(name) + F.col(starts) + 1)


def drop_passes(reads: DataFrame, least: int = 100_000) -> DataFrame:
    drop = F.when((F.col("read_offset") < F.col("previous")) & (F.col("previous") > least), 1).otherwise(0)
    marked = numbered_runs(steps(reads).withColumn("_drop", drop), "_drop", "segment")
    return marked.groupBy("trace_id", "segment").agg(F.min("idx").cast("int").alias("first_idx"), F.max("idx").cast("int").alias("last_idx"), F.count("*").alias("reads"), F.sum("length").alias("bytes"))


def gap_limits(gaps: DataFrame) -> DataFrame:
    """_trace and limit: ten times the median gap, twice, in whole microseconds so that the median needs no fraction; 1000 at least.

    gaps: trace_id and gap. Medians are read off running counts of the distinct gaps, not off lists.
    """
    counts = gaps.where("gap IS NOT NULL").groupBy("trace_id", "gap").agg(F.count("*").alias("c"))
    upto = running(cut(counts, ["trace_id"], F.col("gap")), ["trace_id"], ["gap"], upto=("sum", F.col("c")))
    n = gaps.groupBy(F.col("trace_id").alias("_trace")).agg(F.count("*").alias("n"))
    holds = lambda k: F.min(F.when((F.col("upto") < F.expr(k)) & (F.expr(k) <= F.col("upto") + F.col("c")), F.col("gap")))
    return upto.join(n, F.col("trace_id").eqNullSafe(F.col("_trace"))).groupBy("_trace").agg(F.max("n").alias("n"), F.greatest(10 * (holds("n div 2") + holds("(n + 1) div 2")), F.lit(1000)).alias("limit")).where("n >= 3").drop("n")


def time_stages(reads: DataFrame) -> DataFrame:
    """Stages cut at gaps over ten times the median gap, 500 microseconds at least; fewer than three reads are one stage."""
    rows = steps(reads).withColumn("gap", micros() - F.col("before_us"))
    cuts = F.when(2 * F.col("gap") > F.col("limit"), 1).otherwise(0)
    if "_slice" not in rows.columns:
        whole = by_trace()
        ranked = rows.select("*", F.count("*").over(whole).alias("n"), F.row_number().over(whole.orderBy(F.col("gap").asc_nulls_last(), "idx")).alias("k"))
        middle = lambda k: F.max(F.when(F.col("k") == F.expr(k), F.col("gap"))).over(whole)
        marked = ranked.withColumn("limit", F.when(F.col("n") >= 3, F.greatest(10 * (middle("n div 2") + middle("(n + 1) div 2")), F.lit(1000))))
    else:
        marked = rows.join(gap_limits(rows.select("trace_id", "gap")), F.col("trace_id").eqNullSafe(F.col("_trace")), "left")
    staged = numbered_runs(marked.withColumn("_cut", cuts), "_cut", "stage")
    return staged.groupBy("trace_id", "stage").agg(F.min("idx").cast("int").alias("start_idx"), F.max("idx").cast("int").alias("end_idx"), F.count("*").alias("events"))


def jumps(reads: DataFrame, regions: DataFrame, large: int = 50_000) -> DataFrame:
    steps = read_sequence(reads).select("trace_id", "file_id", "read_number", F.lag("read_offset").over(in_order()).alias("from_offset"), F.col("read_offset").alias("to_offset"), F.col("delta").alias("gap")).where("read_number > 1")
    placed = point_region(point_region(steps, regions, "from_offset", "from_region"), regions, "to_offset", "to_region")
    return placed.select("trace_id", "read_number", "from_offset", "to_offset", "gap", (F.abs("gap") > large).alias("large"), F.when(F.col("gap") >= 0, "FWD").otherwise("BACK").alias("direction"), "from_region", "to_region")


def interval_distribution(reads: DataFrame, k: int = 10) -> DataFrame:
    steps = reads.select("trace_id", (F.col("read_offset") - F.lag("read_offset").over(in_order())).alias("step"), F.count("*").over(by_trace()).alias("n")).where("n > 5 AND step IS NOT NULL")
    counts = steps.groupBy("trace_id", (F.floor(F.col("step") / BLOCK) * BLOCK).alias("interval")).agg(F.count("*").alias("times"))
    return top(counts, k, ["trace_id"], F.desc("times"), F.col("interval")).select("trace_id", F.col("rn").alias("rank"), "interval", "times")


def bracket_probes(reads: DataFrame) -> DataFrame:
    rows = reads.select("*", F.row_number().over(in_order()).alias("n"), F.count("*").over(by_trace()).alias("total"))
    at = lambda k, c: F.max(F.when(F.col("n") == k, F.col(c)))
    return rows.groupBy("trace_id").agg(
        ((at(1, "read_offset") == 0) & (at(1, "length") == 4096)).alias("first_is_header"),
        F.coalesce(at(2, "read_offset") * 10 > F.max("file_size") * 9, F.lit(False)).alias("second_is_tail"),
        (F.max(F.when(F.col("n") == F.col("total"), F.col("read_offset"))) == 0).alias("last_is_zero"),
    )


def access_ladder(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Normalised offset against index, with the class of the first region by start that holds the offset."""
    rows = reads.select("trace_id", "file_id", "file_size", "read_offset", (F.row_number().over(in_order()) - 1).alias("idx"), F.count("*").over(by_trace()).alias("n"))
    found = first_region(rows, regions, "read_offset", "region_name", ("start_offset", "region_ord"), (None, None, None))
    return found.select("trace_id", "idx", ratio(F.col("idx"), F.greatest(F.col("n") - 1, F.lit(1))).alias("position"), ratio(F.col("read_offset"), F.col("file_size")).alias("offset_fraction"), region_class().alias("region_class"))


def chunk_cycle(reads: DataFrame, motif: tuple[int, ...] = (65536,) * 7 + (61440, 4096)) -> DataFrame:
    """Non-overlapping occurrences of a motif of contiguous lengths per trace."""
    size = len(motif)
    fits = F.lit(True)
    for k, length in enumerate(motif):
        fits = fits & (F.lead("length", k).over(in_order()) == length) if k else F.col("length") == length
        if k:
            fits = fits & (F.lead("read_offset", k).over(in_order()) == F.lead(end_of(), k - 1).over(in_order()) if k > 1 else F.lead("read_offset", 1).over(in_order()) == end_of())
    rows = reads.select("trace_id", F.row_number().over(in_order()).alias("n"), F.coalesce(fits, F.lit(False)).alias("hit"))
    hits = rows.where("hit").groupBy("trace_id").agg(F.array_sort(F.collect_list("n")).alias("at"))
    step = lambda acc, x: F.when(x >= acc["next"], F.struct((acc["times"] + 1).alias("times"), (x + size).alias("next"))).otherwise(acc)
    counted = hits.select("trace_id", F.aggregate("at", F.struct(F.lit(0).alias("times"), F.lit(0).alias("next")), step)["times"].alias("cycles"))
    return reads.select("trace_id").distinct().join(counted, "trace_id", "left").select("trace_id", F.coalesce("cycles", F.lit(0)).alias("cycles"))
