"""Trace CSV scans, parsing with quarantine, and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import PROFILES, READ_OPS
from ..functions.storage import dealt

HEADERS = ["Time of Day", "Process Name", "PID", "Operation", "Path", "Result", "Detail"]
NAMES = ["time_of_day", "process_name", "pid", "operation", "path", "result", "detail"]
RAW = T.StructType([T.StructField(h, T.StringType()) for h in HEADERS])
#: Columns before the seven in packed files, which hold many captures, each in one piece.
PACK = ["Capture", "Part"]
PACKED = T.StructType([T.StructField(h, T.StringType()) for h in PACK + HEADERS])
#: Where the number of a trace stands in its file's path: in the file's name, or in the name of its folder.
IN_NAME, IN_FOLDER = r"(\d+)[^/]*$", r"(\d+)/[^/]*$"
DAY_US = 86_400_000_000
TIME = r"^\s*(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,6})\d*)?\s*([AP]M)?\s*$"


def scan(spark: SparkSession, path: str, *, trace: str = IN_NAME, placed: bool = False) -> DataFrame:
    """Raw rows with trace_id, the number in the file's name. A header that differs from the seven names fails the read.

    `path` may be a folder or a pattern; quoted fields may hold commas, a byte order mark is dropped. With `placed` rows
    say where they stand, as timed() needs it: `block`, the file and the start of the part that one task read, and `line`,
    which rises within a block.
    """
    rows = spark.read.schema(RAW).option("header", True).option("enforceSchema", False).option("quote", '"').option("escape", '"').csv(path)
    place = [F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    found = F.regexp_extract(F.col("_metadata.file_path"), trace, 1).cast("long").alias("trace_id")
    return rows.select(found, *[F.col(f"`{h}`").alias(n) for h, n in zip(HEADERS, NAMES)], *(place if placed else []))


def pack(rows: DataFrame, path: str, *order: str) -> None:
    """Append raw rows (trace_id, part and the seven) to a folder of packed files: a part lies in one file, its rows in the given order.

    The number of files is that of the tasks, not that of the captures, of which each costs a folder, a file and its checksum otherwise.
    """
    rows = dealt(rows, "trace_id").sortWithinPartitions("trace_id", "part", *order)
    named = [F.col("trace_id").alias("Capture"), F.col("part").alias("Part"), *[F.col(n).alias(h) for h, n in zip(HEADERS, NAMES)]]
    rows.select(*named).write.mode("append").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def scan_packed(spark: SparkSession, path: str, *, placed: bool = False) -> DataFrame:
    """Raw rows of packed files, as scan() gives them: the number of the trace is in the row."""
    rows = spark.read.schema(PACKED).option("header", True).option("enforceSchema", False).option("quote", '"').option("escape", '"').csv(path)
    place = [F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    return rows.select(F.col("Capture").try_cast("long").alias("trace_id"), *[F.col(f"`{h}`").alias(n) for h, n in zip(HEADERS, NAMES)], *(place if placed else []))


#: A line of seven fields, each plain or quoted with doubled quotes inside.
WHOLE_LINE = r'^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*)){6}$'


def lines(spark: SparkSession, path: str, trace: str = IN_NAME) -> DataFrame:
    """trace_id, path, block, line and value of every line of the files, the header lines too (is_header); is_text where its bytes are UTF-8.

    A folder is listed with all below it, in tasks; a pattern is resolved by the driver, folder by folder.
    """
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.is_valid_utf8("value").alias("is_text"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"), F.col("_metadata.file_path").alias("path"), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    header = F.regexp_replace("value", '"', "") == ",".join(HEADERS)
    return rows.select(F.regexp_extract("path", trace, 1).try_cast("long").alias("trace_id"), "*", ((F.col("block.file_block_start") == 0) & header).alias("is_header"))


def file_checks(spark: SparkSession, path: str, *, trace: str = IN_NAME) -> DataFrame:
    """trace_id, path, rows and reason of each file that has any line; reason is null where the file is sound.

    `encoding`: bytes that are no UTF-8; `header`: no header of the seven names; `cut line`: a line without all its fields.
    """
    all_ = lines(spark, path, trace)
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    broken = (F.col("value") != "") & ~F.col("value").rlike(WHOLE_LINE)
    facts = all_.groupBy("trace_id", "path").agg((F.count_if(F.col("value") != "") - F.count_if("is_header")).alias("rows"), some(~F.col("is_text")).alias("_bytes"), some(F.col("is_header")).alias("_header"), some(broken).alias("_cut"))
    return facts.select("trace_id", "path", "rows", F.when(F.col("_bytes"), "encoding").when(~F.col("_header"), "header").when(F.col("_cut"), "cut line").alias("reason"))


def scan_sound(spark: SparkSession, path: str, checks: DataFrame, *, trace: str = IN_NAME, placed: bool = False) -> DataFrame:
    """Raw rows, as scan() gives them, of the files without a reason in `checks`: one bad file never fails the read of the others."""
    good = lines(spark, path, trace).join(checks.where("reason IS NOT NULL").select("path"), "path", "left_anti").where("NOT is_header AND value <> ''")
    fields = F.from_csv("value", ", ".join(f"{n} STRING" for n in NAMES), {"quote": '"', "escape": '"'})
    return good.select("trace_id", fields.alias("f"), *(["block", "line"] if placed else [])).select("trace_id", "f.*", *(["block", "line"] if placed else []))


def plain(raw: Column) -> Column:
    return F.lower(F.replace(F.trim(raw), F.lit(","), F.lit("")))


def number(text: str) -> Column:
    """The value of the plain text in a column: hexadecimal with 0x or decimal; null for anything else."""
    c = F.col(text)
    return F.when(F.startswith(c, F.lit("0x")), F.when(c.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(c, 3, 16), 16, 10).cast("long"))).when(c.rlike("^[0-9]{1,18}$"), c.cast("long"))


def field(name: str) -> Column:
    """The value after `name:` in the detail, up to the next comma and blank; empty where absent."""
    return F.regexp_extract(F.coalesce("detail", F.lit("")), rf"(?i){name}:\s*([0-9a-fA-Fx,]*[0-9a-zA-Z])", 1)


def time_of_day() -> Column:
    """Microseconds since midnight from the parts h, m, s, f, half of a time; null where they are no time."""
    hour, minute, second = (F.col(c).try_cast("int") for c in ("_h", "_m", "_s"))
    hours = F.when((F.col("_half") == "PM") & (hour < 12), hour + 12).when((F.col("_half") == "AM") & (hour == 12), 0).otherwise(hour)
    fraction = F.coalesce(F.rpad("_f", 6, "0").try_cast("long"), F.lit(0))
    return F.when((hour < 24) & (minute < 60) & (second < 60), (hours.cast("long") * 3600 + minute * 60 + second) * 1_000_000 + fraction)


def parsed(raw: DataFrame, *, besides: Column | None = None) -> DataFrame:
    """Rows of read operations (and those `besides`) with their values and `reason`, null where the row is good.

    Texts are cut out below a generator of one row: filters on `reason` stay above it, so that no pattern runs twice.
    """
    wanted = F.trim("operation").isin(READ_OPS)
    rows = raw.where(wanted if besides is None else wanted | besides)
    parts = {c: F.regexp_extract("time_of_day", TIME, k) for k, c in enumerate(("_h", "_m", "_s", "_f", "_half"), 1)}
    trimmed = {c: F.trim(c) for c in ("process_name", "operation", "path", "result")}
    texts = parts | trimmed | {"_o": plain(field("Offset")), "_l": plain(field("Length"))}
    others = [c for c in rows.columns if c not in trimmed]
    cut = rows.select(*others, F.explode(F.array(F.struct(*[e.alias(n) for n, e in texts.items()]))).alias("_t")).select(*others, "_t.*")
    out = cut.withColumns({"process_id": F.trim("pid").try_cast("int"), "us_of_day": time_of_day(), "read_offset": number("_o"), "length": number("_l")}).drop(*parts, "_o", "_l")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(F.col("us_of_day").isNull(), "timestamp").when(empty("process_name") | empty("path") | empty("result"), "empty field").when(~F.coalesce(F.col("process_id") > 0, F.lit(False)), "pid")
        .when(F.col("read_offset").isNull(), "offset").when(~F.coalesce(F.col("length") > 0, F.lit(False)), "length")
    )
    return out.withColumn("reason", reason)


def reads(raw: DataFrame, *, strict: bool = False) -> DataFrame:
    """Parsed reads; strict raises on the first bad row, else bad rows are left to rejects()."""
    rows = parsed(raw)
    if strict:
        rows = rows.where(F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("bad row: "), "reason")).cast("boolean")).otherwise(F.lit(True)))
    return rows.where("reason IS NULL").drop("reason", "time_of_day", "pid", "detail")


def timed(rows: DataFrame, captures: DataFrame) -> DataFrame:
    """Parsed reads of a placed scan with ts, event_order (from 1, in file order) and the file_id and file_size of `captures`.

    captures: trace_id, day, file_id, file_size. The first read is on the capture's day (1970-01-01 where it is not known);
    where the time falls by more than half a day from one read to the next, midnight has passed. Blocks are walked on their
    own, then joined with what passed in the blocks before: no task holds a whole trace.
    """
    in_block, in_trace = Window.partitionBy("trace_id", "block").orderBy("line"), Window.partitionBy("trace_id").orderBy("block")
    falls = lambda now, before: F.coalesce(before - now > DAY_US // 2, F.lit(False)).cast("long")
    fallen = rows.withColumn("_fall", falls(F.col("us_of_day"), F.lag("us_of_day").over(in_block)))
    marked = fallen.withColumns({"_days": F.sum("_fall").over(in_block), "_n": F.row_number().over(in_block)})
    blocks = marked.groupBy("trace_id", "block").agg(F.max("_n").alias("n"), F.max("_days").alias("days"), F.min_by("us_of_day", "line").alias("first"), F.max_by("us_of_day", "line").alias("last"))
    steps = blocks.withColumn("step", F.coalesce(F.lag("days").over(in_trace), F.lit(0)) + falls(F.col("first"), F.lag("last").over(in_trace)))
    before = steps.select("trace_id", "block", F.sum("step").over(in_trace).alias("_days_before"), (F.sum("n").over(in_trace) - F.col("n")).alias("_n_before"))
    joined = marked.join(before, ["trace_id", "block"]).join(captures.select("trace_id", "day", "file_id", "file_size"), "trace_id", "left")
    midnight = F.unix_micros(F.coalesce("day", F.lit("1970-01-01").cast("date")).cast("timestamp"))
    us = midnight + (F.col("_days_before") + F.col("_days")) * DAY_US + F.col("us_of_day")
    out = joined.withColumns({"ts": F.timestamp_micros(us), "event_order": (F.col("_n_before") + F.col("_n")).cast("long")})
    return out.drop("block", "line", "day", "us_of_day", "_fall", "_days", "_n", "_days_before", "_n_before")


def rejects(raw: DataFrame) -> DataFrame:
    return parsed(raw).where("reason IS NOT NULL")


def detail_fields(raw: DataFrame) -> DataFrame:
    """Offset, length and priority of a detail, null where absent."""
    priority = F.nullif(F.regexp_extract(F.coalesce("detail", F.lit("")), r"Priority:\s*([A-Za-z ]*[A-Za-z])", 1), F.lit(""))
    cut = raw.withColumns({"_o": plain(field("Offset")), "_l": plain(field("Length"))})
    return cut.withColumns({"read_offset": number("_o"), "length": number("_l"), "priority": priority}).drop("_o", "_l")


def matches(process: str, sample: str, profile: str) -> Column:
    """Rows of a process whose path contains the sample's name and whose operation is in the profile (unknown: minimal)."""
    kept = PROFILES.get(profile, PROFILES["minimal"])
    own = (F.lower(F.trim("process_name")) == process) & F.contains(F.lower("path"), F.lit(sample.lower()))
    return own if kept is None else own & F.lower(F.trim("operation")).isin(kept)


def filter_counts(raw: DataFrame, process: str, sample: str) -> DataFrame:
    """profile, input_rows and output_rows of each trace under every profile; blank rows do not count."""
    blank = F.coalesce(F.concat_ws("", *[F.trim(c) for c in ("process_name", "operation", "path")]), F.lit("")) == ""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.coalesce(matches(process, sample, p), F.lit(False)).alias("hit")) for p in PROFILES])).alias("p")
    return raw.where(~blank).select("trace_id", each).groupBy("trace_id", "p.profile").agg(F.count("*").alias("input_rows"), F.count(F.when(F.col("p.hit"), 1)).alias("output_rows"))


def survey(raw: DataFrame) -> DataFrame:
    """Rows, the four most frequent operations, the three most frequent results, parsed and skipped reads per trace."""

    def most(column: str, k: int) -> DataFrame:
        counts = raw.groupBy("trace_id", column).agg(F.count("*").alias("n"))
        ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("n"), column))).where(F.col("rn") <= k)
        text = F.concat(F.col(column), F.lit(":"), F.col("n").cast("string"))
        lists = ranked.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))).alias("l"))
        return lists.select("trace_id", F.array_join(F.transform("l", lambda x: x["t"]), ",").alias(f"top_{column}s"))

    rows = raw.groupBy("trace_id").agg(F.count("*").alias("rows"))
    counts = parsed(raw).groupBy("trace_id").agg(F.count(F.when(F.col("reason").isNull(), 1)).alias("parsed_reads"), F.count("reason").alias("skipped_reads"))
    out = rows.join(most("operation", 4), "trace_id").join(most("result", 3), "trace_id").join(counts, "trace_id", "left")
    return out.fillna(0, ["parsed_reads", "skipped_reads"])
