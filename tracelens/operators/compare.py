"""Comparisons of captures and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import in_order, ratio, top
from .regions import overlap


def trace_pair_diff(reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: pair, left_trace, right_trace. Reads are aligned by position with a full outer join."""
    seq = reads.select("trace_id", F.row_number().over(in_order()).alias("n"), "read_offset", "length")
    side = lambda name: seq.join(pairs.select("pair", F.col(f"{name}_trace").alias("trace_id")), "trace_id").select("pair", "n", F.col("read_offset").alias(f"{name}_offset"), F.col("length").alias(f"{name}_length"))
    both = side("left").join(side("right"), ["pair", "n"], "full")
    same = F.coalesce((F.col("left_offset") == F.col("right_offset")) & (F.col("left_length") == F.col("right_length")), F.lit(False))
    return both.groupBy("pair").agg(
        F.count("left_offset").alias("left_reads"), F.count("right_offset").alias("right_reads"), (F.coalesce(F.min(F.when(~same, F.col("n"))), F.max("n") + 1) - 1).cast("long").alias("common_prefix"),
        F.count(F.when(same, 1)).alias("equal_positions"), (F.coalesce(F.sum("left_length"), F.lit(0)) - F.coalesce(F.sum("right_length"), F.lit(0))).alias("bytes_delta"), F.min(same).alias("exact_match"),
    )


def label_comparison(reads: DataFrame, labels: list[str], k: int = 5) -> DataFrame:
    """metric x label: means per read and the k most common lengths; `reads` has a column `label`."""
    base = reads.groupBy("label").agg(F.count("*").cast("double").alias("reads"), F.avg("length").alias("mean_length"), F.count_distinct("read_offset").cast("double").alias("unique_offsets"), ratio(F.sum("length"), F.count_distinct("trace_id")).alias("bytes_per_trace"))
    long = base.unpivot("label", ["reads", "mean_length", "unique_offsets", "bytes_per_trace"], "metric", "value")
    counts = reads.groupBy("label", "length").agg(F.count("*").alias("n"))
    common = top(counts, k, ["label"], F.desc("n"), F.col("length")).select("label", F.concat(F.lit("length "), F.col("rn").cast("string")).alias("metric"), F.col("length").cast("double").alias("value"))
    return long.unionByName(common).groupBy("metric").pivot("label", labels).agg(F.first("value"))


def archive_coverage(reads: DataFrame, entries: DataFrame) -> DataFrame:
    """Bytes, events and coverage per archive member; kind is what stands before `::`; members never read have 0."""
    touched = overlap(reads, entries, "inner").groupBy("file_id", "region_name").agg(F.count("*").alias("events"), F.sum(F.least(F.col("read_offset") + F.col("length"), F.col("end_offset") + 1) - F.greatest("read_offset", "start_offset")).alias("bytes"))
    rows = entries.join(touched, ["file_id", "region_name"], "left")
    name = F.element_at(F.split("region_name", "::"), -1)
    size = F.col("end_offset") - F.col("start_offset") + 1
    return rows.select("file_id", "region_name", F.element_at(F.split("region_name", "::"), 1).alias("kind"), F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1).alias("extension"), size.alias("size"), F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce(ratio(F.col("bytes"), size), F.lit(0.0)).alias("read_ratio"))
