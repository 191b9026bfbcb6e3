"""The driver's tables as reads, regions, captures and header facts; integer arithmetic only, so that every engine agrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import layer

FILE_SIZE = 1_048_576
LENGTHS = "CAST(CASE CAST(event_id % 13 AS INT) WHEN 0 THEN 512 WHEN 1 THEN 1024 WHEN 2 THEN 2048 WHEN 3 THEN 8192 WHEN 4 THEN 16384 WHEN 5 THEN 32768 WHEN 6 THEN 65536 WHEN 7 THEN 131072 WHEN 8 THEN 262144 WHEN 9 THEN 524288 ELSE 4096 END AS BIGINT)"
#: Column expressions over `events` that Spark and DuckDB read alike.
READ_COLUMNS = {
    "trace_id": "user_id",
    "event_order": "event_id",
    "read_offset": "CAST((event_id * 7919) % 256 AS BIGINT) * 4096 + CASE WHEN event_id % 11 = 0 THEN 512 ELSE 0 END",
    "length": LENGTHS,
    "result": "CASE WHEN event_type = 'error' THEN 'FAST IO DISALLOWED' ELSE 'SUCCESS' END",
    "operation": "CASE WHEN event_type = 'view' THEN 'CreateFile' ELSE 'ReadFile' END",
    "process_name": "CASE WHEN user_id % 2 = 0 THEN 'scanner.exe' ELSE 'indexer.exe' END",
    "path": "CONCAT('C:\\samples\\set', CAST(user_id % 3 AS STRING), '\\sample.exe')",
    "file_id": "CAST(1 AS BIGINT)",
    "file_size": "CAST(CASE WHEN user_id % 4 = 0 THEN 400000 ELSE 1048576 END AS BIGINT)",
}
REGIONS = [
    ("DOS Header", 0, 63), ("DOS Stub", 64, 127), ("NT Headers", 128, 391), ("File Header", 132, 151), ("Optional Header", 152, 391), ("Section Table", 392, 1023), (".text", 1024, 524287), ("Import Directory", 200000, 204095),
    (".rdata", 524288, 786431), (".rsrc", 786432, 917503), ("Resource Directory", 786432, 790527), ("Relocation Directory", 917504, 921599), ("Overlay", 960000, 1048575),
]
#: The adapters' file has its named ranges where its regions are.
NOTE_RANGES = [(1536, 24575, "early code probe"), (200000, 204095, "import region probe"), (524288, 786431, "read-only data"), (786432, 917503, "resource section"), (917504, 921599, "relocation section")]
IMPORT_RANGE = (200000, 204095)
LAST_REGION_END = max(end for _, _, end in REGIONS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of `events` as reads of both layers and other operations."""
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), *[F.expr(e.replace("\\", "\\\\")).alias(c) for c, e in READ_COLUMNS.items()])


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(reads(spark, sf_dir))


def contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that follow each other: lengths go round 7 x 65536, 61440, 4096 and offsets are their running sum, with a break every 40th read."""
    order = Window.partitionBy("trace_id").orderBy("event_order")
    rows = completed(spark, sf_dir).withColumn("k", F.row_number().over(order) - 1)
    length = F.expr("CAST(CASE WHEN k % 9 < 7 THEN 65536 WHEN k % 9 = 7 THEN 61440 ELSE 4096 END AS BIGINT)")
    sized = rows.withColumn("length", length)
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("read_offset", before + F.expr("CASE WHEN k >= 40 THEN 512 ELSE 0 END")).drop("k")


def lineitem_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as reads: a trace is a supplier, days tie, order is by all columns."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("trace_id"), F.row_number().over(order).cast("long").alias("event_order"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_partkey") * 4096).alias("read_offset"),
        (F.col("l_quantity").cast("long") * 1024).alias("length"), F.when(F.col("l_returnflag") == "R", "FAST IO DISALLOWED").otherwise("SUCCESS").alias("result"), F.lit("ReadFile").alias("operation"), F.lit(1).cast("long").alias("file_id"),
        F.lit(1_048_576 * 64).cast("long").alias("file_size"),
    )


def regions(spark: SparkSession) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("region_ord"), F.lit(n).alias("region_name"), F.lit(s).cast("long").alias("start_offset"), F.lit(e).cast("long").alias("end_offset")) for k, (n, s, e) in enumerate(REGIONS)])).alias("r")
    return spark.range(1, 2).select(F.col("id").alias("file_id"), each).select("file_id", "r.*")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as raw trace rows: hexadecimal offsets in every second one, some offsets and lengths spoilt."""
    rows = reads(spark, sf_dir)
    offset = F.expr("CASE WHEN event_order % 97 = 0 THEN 'zz' WHEN event_order % 2 = 0 THEN concat('0x', lower(hex(read_offset))) ELSE CAST(read_offset AS STRING) END")
    length = F.expr("CASE WHEN event_order % 89 = 0 THEN '' ELSE concat(', Length: ', regexp_replace(CAST(length AS STRING), '([0-9])([0-9]{3})$', '$1,$2')) END")
    extra = F.expr("CASE WHEN event_order % 5 = 0 THEN ', Priority: Normal' ELSE '' END")
    return rows.select(
        "trace_id", "event_order", F.concat(F.date_format("ts", "h:mm:ss.SSSSSS"), F.lit("7 "), F.date_format("ts", "a")).alias("time_of_day"), "process_name", F.expr("CASE WHEN event_order % 83 = 0 THEN 'none' ELSE CAST(1000 + trace_id AS STRING) END").alias("pid"),
        "operation", "path", "result", F.concat(F.lit("Offset: "), offset, length, extra).alias("detail"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in HEADER_COLUMNS.items()])


HEADER_COLUMNS = {
    "file_id": "CAST(p_partkey AS BIGINT)", "file_size": "CAST(30000 + p_size * 100 AS BIGINT)", "machine": "CAST(CASE p_partkey % 3 WHEN 0 THEN 332 WHEN 1 THEN 34404 ELSE 43620 END AS BIGINT)",
    "opt_magic": "CAST(CASE p_partkey % 2 WHEN 0 THEN 523 ELSE 267 END AS BIGINT)", "lfanew": "CAST(64 + (p_partkey % 5) * 32 AS BIGINT)", "file_hdr_size": "CAST(20 AS BIGINT)", "opt_hdr_size": "CAST(CASE p_partkey % 7 WHEN 0 THEN 0 ELSE 224 END AS BIGINT)",
    "overlay_start": "CAST(CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 30000 END AS BIGINT)",
}
#: (section_ord, name, va, vsize, raw_ptr, raw_size)
SECTIONS = [(0, ".text", 4096, 8192, 1024, 8192), (1, ".rdata", 16384, 4096, 9216, 4096), (2, ".bss", 24576, 4096, 13312, 0), (3, ".rsrc", 32768, 16384, 13312, 16384)]
#: (dir_ord, name, va, size, is_file_offset); directory 1 and 4 are absent in some files.
DIRECTORIES = [(0, "Export Directory", 17000, 120, False), (1, "Import Directory", 16500, 400, False), (2, "Resource Directory", 32768, 9000, False), (4, "Certificate Table", 30000, 64, True), (5, "Relocation Directory", 90000, 16, False)]


def _per_file(df: DataFrame, names: list[str], rows: list[tuple], keep: str) -> DataFrame:
    value = lambda v: F.lit(v) if isinstance(v, (str, bool)) else F.lit(v).cast("long")
    each = F.explode(F.array(*[F.struct(*[value(v).alias(n) for n, v in zip(names, r)]) for r in rows])).alias("x")
    return df.select("file_id", each).select("file_id", "x.*").where(keep)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_file(headers(spark, sf_dir), ["section_ord", "name", "va", "vsize", "raw_ptr", "raw_size"], SECTIONS, SECTION_KEPT)


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_file(headers(spark, sf_dir), ["dir_ord", "name", "va", "size", "is_file_offset"], DIRECTORIES, DIRECTORY_KEPT)


SECTION_KEPT = "file_id % 11 > 0 OR section_ord < 2"
DIRECTORY_KEPT = "(dir_ord != 1 OR file_id % 3 > 0) AND (dir_ord != 4 OR file_id % 4 > 1)"
ENTRY_COLUMNS = {
    "file_id": "CAST(p_partkey % 50 AS BIGINT)", "name": "CONCAT('f', CAST(p_partkey AS STRING), CASE p_size % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.bin' ELSE '' END)", "header_offset": "CAST((p_partkey - p_partkey % 50) / 50 * 1000 AS BIGINT)",
    "name_len": "CAST(8 AS BIGINT)", "extra_len": "CAST(p_size % 4 AS BIGINT)", "compressed_size": "CAST(700 + p_size AS BIGINT)",
}


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in ENTRY_COLUMNS.items()])


def archives(entry_rows: DataFrame) -> DataFrame:
    """The central directory stands 500 bytes after the last member's start and a thousand more; its end record follows."""
    return entry_rows.groupBy("file_id").agg((F.max("header_offset") + 1500).alias("cd_offset"), (46 * F.count("*")).alias("cd_size")).withColumn("eocd_offset", F.col("cd_offset") + F.col("cd_size"))


def archive_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS trace_id", "CAST(l_partkey % 50 AS BIGINT) AS file_id", "CAST((l_orderkey * 37) % 20000 AS BIGINT) AS read_offset", "CAST(l_quantity AS BIGINT) * 8 AS length")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captures."""
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {c}" for c, e in CAPTURE_COLUMNS.items()])


CAPTURE_COLUMNS = {
    "capture_id": "o_orderkey", "category": "o_orderpriority", "has_events": "o_orderkey % 13 > 0", "has_sample": "o_orderkey % 17 > 0", "manifest_status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' END",
    "metadata_result": "CASE WHEN o_orderkey % 3 = 0 THEN 'success' ELSE 'error' END", "state": "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'skipped' END",
}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS sample_id", "p_brand AS category", "CAST(p_size AS BIGINT) * p_size * 10000 AS size_bytes")
