"""Region intervals: catalogues, and regions built from parsed header or archive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG = "Region STRING, StartDecimal BIGINT, EndDecimal BIGINT, StartHex STRING, EndHex STRING, Size BIGINT"
DOS = 64


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).option("header", True).csv(path)


def catalog(rows: DataFrame) -> DataFrame:
    """Inclusive intervals from rows with an exclusive end; hexadecimal bounds stand in for absent decimals; empty ones are left out."""
    hexed = lambda c: F.conv(F.regexp_replace(F.col(c), "(?i)^0x", ""), 16, 10).cast("long")
    out = rows.withColumns({"start_offset": F.coalesce("StartDecimal", hexed("StartHex")), "end_offset": F.coalesce("EndDecimal", hexed("EndHex")) - 1})
    return out.where("end_offset >= start_offset")


def rva_to_offset(rvas: DataFrame, sections: DataFrame) -> DataFrame:
    """`rvas` (file_id, rva, ...) with file_offset: by the first section that holds the address, else the address itself."""
    span = F.struct("section_ord", "va", "vsize", "raw_ptr")
    lists = sections.groupBy(F.col("file_id").alias("_file")).agg(F.array_sort(F.collect_list(span)).alias("_sections"))
    holds = F.get(F.filter("_sections", lambda x: (F.col("rva") >= x["va"]) & (F.col("rva") < x["va"] + x["vsize"])), F.lit(0))
    joined = rvas.join(lists, F.col("file_id") == F.col("_file"), "left").withColumn("_in", holds)
    return joined.select(*rvas.columns, F.coalesce(F.col("rva") - F.col("_in.va") + F.col("_in.raw_ptr"), "rva").alias("file_offset"))


def regions_from_headers(headers: DataFrame, sections: DataFrame, directories: DataFrame) -> DataFrame:
    """file_id, region_ord, region_name, start_offset, end_offset in the order of the file.

    headers: file_id, file_size, lfanew, file_hdr_size, opt_hdr_size, overlay_start; sections: file_id, section_ord, name,
    va, vsize, raw_ptr, raw_size; directories: file_id, dir_ord, name, va, size, is_file_offset.
    """
    nt = F.col("lfanew")
    file_start = nt + 4
    opt_start = file_start + F.col("file_hdr_size")
    opt_end = opt_start + F.col("opt_hdr_size")

    def part(df: DataFrame, build: Column, name: Column, start: Column, end: Column) -> DataFrame:
        return df.select("file_id", build.cast("int").alias("build_ord"), name.alias("region_name"), start.cast("long").alias("start_offset"), end.cast("long").alias("end_offset"))

    lit = F.lit
    first = sections.groupBy("file_id").agg(F.min_by("raw_ptr", "section_ord").alias("first_raw"))
    raw = directories.where("is_file_offset").select("file_id", "dir_ord", "name", "size", F.col("va").alias("rva"), F.col("va").alias("file_offset"))
    mapped = rva_to_offset(directories.where("NOT is_file_offset").select("file_id", "dir_ord", "name", "size", F.col("va").alias("rva")), sections)
    placed = raw.unionByName(mapped).where("rva > 0 AND size > 0")
    parts = [
        part(headers, lit(0), lit("DOS Header"), lit(0), lit(DOS - 1)),
        part(headers.where(nt > DOS), lit(1), lit("DOS Stub"), lit(DOS), nt - 1),
        part(headers, lit(2), lit("NT Headers"), nt, opt_end - 1),
        part(headers, lit(3), lit("File Header"), file_start, opt_start - 1),
        part(headers.where("opt_hdr_size > 0"), lit(4), lit("Optional Header"), opt_start, opt_end - 1),
        part(headers.join(first, "file_id"), lit(5), lit("Section Table"), opt_end, F.col("first_raw") - 1).where("end_offset >= start_offset"),
        part(placed, 100 + F.col("dir_ord"), F.col("name"), F.col("file_offset"), F.col("file_offset") + F.col("size") - 1),
        part(sections.where("raw_size > 0"), 1000 + F.col("section_ord"), F.col("name"), F.col("raw_ptr"), F.col("raw_ptr") + F.col("raw_size") - 1),
        part(headers.where("overlay_start IS NOT NULL AND overlay_start < file_size"), lit(1_000_000), lit("Overlay"), F.col("overlay_start"), F.col("file_size") - 1),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("start_offset", "build_ord")) - 1).alias("region_ord"), "region_name", "start_offset", "end_offset")


def regions_from_entries(entries: DataFrame, archives: DataFrame) -> DataFrame:
    """Local headers, file data, central directory and end record of archives, by start."""
    head = F.col("header_offset") + 30 + F.col("name_len") + F.col("extra_len")
    row = lambda df, name, start, end: df.select("file_id", name.alias("region_name"), start.alias("start_offset"), (end - 1).alias("end_offset"))
    out = (
        row(entries, F.concat(F.lit("LocalHeader::"), "name"), F.col("header_offset"), head)
        .unionByName(row(entries, F.concat(F.lit("FileData::"), "name"), head, head + F.col("compressed_size")))
        .unionByName(row(archives, F.lit("CentralDirectory"), F.col("cd_offset"), F.col("cd_offset") + F.col("cd_size")))
        .unionByName(row(archives, F.lit("EOCD"), F.col("eocd_offset"), F.col("eocd_offset") + 22))
        .where("end_offset >= start_offset")
    )
    return out.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("start_offset", "region_name")) - 1).alias("region_ord"), "region_name", "start_offset", "end_offset")


def file_facts(headers: DataFrame, sections: DataFrame, directories: DataFrame) -> DataFrame:
    code = lambda c, names: F.coalesce(*[F.when(F.col(c) == v, n) for v, n in names], F.concat(F.lit("0x"), F.hex(F.col(c).cast("long"))))
    named = sections.groupBy("file_id").agg(F.count("*").alias("n_sections"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "name"))), lambda x: x["name"]), ",").alias("section_names"))
    has = lambda n: F.max((F.col("dir_ord") == n) & (F.col("size") > 0))
    flags = directories.groupBy("file_id").agg(has(0).alias("has_exports"), has(1).alias("has_imports"), has(2).alias("has_resources"), has(4).alias("has_certificate"), has(5).alias("has_reloc"), has(6).alias("has_debug"))
    out = headers.select("file_id", code("machine", [(0x14C, "x86"), (0x8664, "x64")]).alias("machine"), code("opt_magic", [(0x20B, "PE32+"), (0x10B, "PE32")]).alias("opt_format"), F.coalesce(F.col("file_size") > F.col("overlay_start"), F.lit(False)).alias("has_overlay"))
    joined = out.join(named, "file_id", "left").join(flags, "file_id", "left")
    return joined.fillna(0, ["n_sections"]).fillna("", ["section_names"]).fillna(False)
