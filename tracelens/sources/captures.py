"""Capture metadata, sample inventories and file kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import MAGICS

METADATA = "experiment_id INT, sample STRING, relative_path STRING, sha256 STRING, size BIGINT, trigger STRING, completion_strategy STRING, collector_version STRING, procmon_profile STRING, category STRING, timestamp TIMESTAMP, result STRING"
MANIFEST = "experiment INT, status STRING, sample STRING, capture STRUCT<pml: STRING, csv: STRING, filtered: STRING>"
INDEX = "samples ARRAY<STRUCT<manifest: STRING, signed: BOOLEAN, sub_category: STRING, category: STRING, sample_id: STRING, path: STRING, size_bytes: BIGINT, sha256: STRING>>, total_samples INT"
SUFFIXES = ["exe", "dll", "sys"]
KB = 1024


#: Where a capture's number stands in its files' paths: the name of the folder, or the end of that name.
IN_FOLDER, IN_PARTITION = r"/(\d+)/[^/]*$", r"(\d+)/[^/]*$"


def _capture_of(capture: str = IN_FOLDER) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), capture, 1).cast("int")


def metadata(spark: SparkSession, root: str) -> DataFrame:
    """One row per capture folder's metadata.json; unreadable files give nulls, absent sample and category `unknown`."""
    rows = spark.read.schema(METADATA).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/metadata.json")
    found = rows.select(_capture_of().alias("capture_id"), *rows.columns)
    return found.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("sample", "category")})


def facts(rows: DataFrame) -> DataFrame:
    """trace_id, day, file_id, file_size of capture metadata, as trace_csv.timed() takes them; a capture's file has its number."""
    return rows.select(F.col("capture_id").cast("long").alias("trace_id"), F.to_date("timestamp").alias("day"), F.col("capture_id").cast("long").alias("file_id"), F.col("size").alias("file_size"))


def _below(path: str | Column, root: str) -> Column:
    """The part of a file's path below `root`."""
    return F.substring_index(path, root.rstrip("/").removeprefix("file://") + "/", -1)


def _in_captures(path: str | Column, root: str) -> Column:
    """Files right in a folder below `root`: `root` is listed as a whole, in tasks, where a pattern would be resolved by the driver, folder by folder."""
    return F.regexp_count(_below(path, root), F.lit("/")) == 1


def manifests(spark: SparkSession, root: str, name: str = "manifest.json", capture: str = IN_FOLDER) -> DataFrame:
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root).where(_in_captures(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), root))
    return rows.select(_capture_of(capture).alias("capture_id"), "status", "sample", "capture")


def listed(spark: SparkSession, root: str, *, events: str = "csv", sample: str = "exe", capture: str = r"(\d+)/[^/]*$") -> DataFrame:
    """capture_id, has_events, has_sample, event_bytes and newest (time) from a listing of the capture folders below `root`: no file is opened.

    A capture has its events or its sample if it has a file of that suffix, any case, which is not empty.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(_in_captures("path", root)).select("path", "length", "modificationTime")
    of = lambda suffix: (F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)) == suffix) & (F.col("length") > 0)
    rows = files.select(F.regexp_extract("path", capture, 1).try_cast("long").alias("capture_id"), of(events).alias("e"), of(sample).alias("s"), "length", "modificationTime").where("capture_id IS NOT NULL")
    return rows.groupBy("capture_id").agg(F.max("e").alias("has_events"), F.max("s").alias("has_sample"), F.coalesce(F.sum(F.when(F.col("e"), F.col("length"))), F.lit(0)).alias("event_bytes"), F.max("modificationTime").alias("newest"))


def file_status(captures: DataFrame, checks: DataFrame, reads: DataFrame) -> DataFrame:
    """capture_id, ok, error and reads of each capture (capture_id): what its files' checks (trace_csv.file_checks) say, or that there is none.

    The first reason in order stands for a capture of several bad files; a capture of sound files without reads is `no reads`.
    """
    by_file = checks.groupBy(F.col("trace_id").alias("capture_id")).agg(F.min("reason").alias("reason"), F.count("*").alias("files"))
    counted = reads.groupBy(F.col("trace_id").alias("capture_id")).agg(F.count("*").alias("reads"))
    joined = captures.select("capture_id").join(by_file, "capture_id", "left").join(counted, "capture_id", "left")
    error = F.when(F.col("files").isNull(), "no events file").when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("reads").isNull(), "no reads").otherwise("")
    return joined.select("capture_id", (error == "").alias("ok"), error.alias("error"), F.coalesce("reads", F.lit(0)).alias("reads"))


def completed(captures: DataFrame) -> DataFrame:
    """captures: has_events, has_sample, manifest_status, metadata_result. Complete: both files and one of the two marks."""
    marked = (F.col("manifest_status") == "completed") | (F.col("metadata_result") == "success")
    return captures.withColumn("completed", F.coalesce(F.col("has_events") & F.col("has_sample") & marked, F.lit(False)))


def batch_status(captures: DataFrame, results: DataFrame) -> DataFrame:
    """One row per capture: ok, or what is missing."""
    joined = captures.join(results.select("capture_id", F.lit(True).alias("analysed")), "capture_id", "left")
    error = F.when(~F.col("has_events"), "no events file").when(~F.col("has_sample"), "no sample file").when(F.col("analysed").isNull(), "no reads")
    return joined.select("capture_id", error.isNull().alias("ok"), F.coalesce(error, F.lit("")).alias("error"))


def collection_summary(captures: DataFrame) -> DataFrame:
    """processed, successful, failed, skipped over `state` (success, failed, skipped)."""
    count = lambda s: F.count(F.when(F.col("state") == s, 1))
    return captures.agg((count("success") + count("failed")).alias("processed"), count("success").alias("successful"), count("failed").alias("failed"), count("skipped").alias("skipped"))


def inventory(spark: SparkSession, root: str, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """relative_path, size, sha256, category (first folder) of the files with these suffixes below `root`, any case; Spark's reader leaves empty files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(suffixes))
    relative = _below("path", root)
    return rows.select(relative.alias("relative_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.when(F.contains(relative, F.lit("/")), F.substring_index(relative, "/", 1)).otherwise("").alias("category"))


def size_class(size: str = "size_bytes") -> Column:
    s = F.col(size)
    return F.when(s < 100 * KB, "tiny").when(s < 500 * KB, "small").when(s < 2 * KB * KB, "medium").when(s < 10 * KB * KB, "large").otherwise("huge")


def sample_index(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(INDEX).option("multiLine", True).json(path)
    return rows.select(F.explode("samples").alias("s")).select("s.*").withColumn("size_class", size_class())


def index_counts(samples: DataFrame) -> DataFrame:
    """Samples per category and size class with category and grand totals (null)."""
    return samples.withColumn("size_class", size_class()).rollup("category", "size_class").agg(F.count("*").alias("samples"), F.sum("size_bytes").alias("bytes"))


def file_kind(content: Column) -> Column:
    """The kind whose magic the first bytes are; null for none."""
    out = F.lit(None).cast("string")
    for kind, magic in reversed(MAGICS):
        out = F.when(F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(magic)), kind).otherwise(out)
    return out
