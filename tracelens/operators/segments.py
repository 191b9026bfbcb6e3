"""Files with very many regions: disjoint segments, as-of lookups by one merged sort, and overlaps by levels on both sides.

segments() cuts the overlapping regions of a file at all their bounds. Every piece between two bounds gets the first region
that covers it: a region names at most two nodes per level of a binary tree over the pieces, and a piece asks its ancestors.
asof() sorts marks and rows by file and offset in one sliced scan (slices.py) and gives each row the last mark before it:
no row carries a list. touching() meets reads and regions where either starts inside the other, on the level of the
longer one's length: a region takes one row per level and two more, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import islands
from .slices import cut, running

#: Files with more regions than this are looked up here; below it a read meets each region of its file.
MANY = 256
#: Width of the narrowest bins of touching(); each further level is 16 times as wide.
BIN, LEVELS = 65_536, 12
#: Levels of the tree over a file's pieces.
TREE = 40

_large: dict[tuple, DataFrame | None] = {}


def sound(regions: DataFrame) -> DataFrame:
    return regions.where("file_id IS NOT NULL AND start_offset <= end_offset")


def large_files(regions: DataFrame) -> DataFrame | None:
    """_file: the files with more than MANY regions; None where there are none. The answer picks a path, never a result."""
    key = regions.sparkSession.sparkContext.applicationId, regions.semanticHash(), MANY
    if key not in _large:
        if len(_large) > 1000:
            _large.clear()
        found = sound(regions).groupBy(F.col("file_id").alias("_file")).agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("_file")
        _large[key] = None if found.isEmpty() else found
    return _large[key]


def split_reads(reads: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reads of the files named, and the others."""
    own = F.col("file_id") == F.col("_file")
    return reads.join(files, own, "left_semi"), reads.join(files, own, "left_anti")


def segments(regions: DataFrame, *order: str) -> DataFrame:
    """file_id, start and region_name of each piece between two bounds of a file: the first region in order that covers it, or null.

    The last piece begins behind the greatest end.
    """
    regions = sound(regions)
    by_file = Window.partitionBy("file_id")
    ends = regions.select("file_id", F.explode(F.array("start_offset", F.col("end_offset") + 1)).alias("start")).distinct()
    pieces = ends.withColumn("piece", F.row_number().over(by_file.orderBy("start")) - 1)
    place = lambda at, name: pieces.select("file_id", F.col("start").alias(at), F.col("piece").alias(name))
    spans = regions.withColumn("_after", F.col("end_offset") + 1).join(place("start_offset", "_a"), ["file_id", "start_offset"]).join(place("_after", "_b"), ["file_id", "_after"])
    left, right = lambda k: F.expr(f"(_a + {(1 << k) - 1}L) div {1 << k}L"), lambda k: F.expr(f"_b div {1 << k}L")
    node = lambda k, at, odd: F.when((left(k) < right(k)) & (odd % 2 == 1), F.struct(F.lit(k).alias("level"), at.alias("at")))
    listed = F.filter(F.array(*[n for k in range(TREE) for n in (node(k, left(k), left(k)), node(k, right(k) - 1, right(k)))]), lambda x: x.isNotNull())
    winner = F.min(F.struct(*order, F.col("region_name").alias("name")))
    nodes = spans.select("*", F.explode(listed).alias("_n")).groupBy("file_id", "_n.level", "_n.at").agg(winner.alias("winner"))
    levels = nodes.groupBy("file_id").agg(F.collect_set("level").alias("levels"))
    asked = pieces.join(levels, "file_id").withColumn("level", F.explode("levels")).withColumn("at", F.expr("CAST(piece div shiftleft(1L, level) AS BIGINT)"))
    found = asked.join(nodes, ["file_id", "level", "at"]).groupBy("file_id", "piece").agg(F.min("winner")["name"].alias("region_name"))
    return pieces.join(found, ["file_id", "piece"], "left").select("file_id", "start", "region_name")


def asof(rows: DataFrame, marks: DataFrame, at: str, out: str) -> DataFrame:
    """`rows` with the `value` of the last mark (file_id, start, value) of their file at or before an offset; null before the first."""
    kind = marks.schema["value"].dataType
    held = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
    own = rows.select(F.col("file_id").alias("_file"), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_value"), held)
    theirs = marks.select(F.col("file_id").alias("_file"), F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("value").alias("_value"))
    merged = cut(own.unionByName(theirs, allowMissingColumns=True), ["_file"], F.col("_at"))
    ran = running(merged, ["_file"], ["_at", "_kind"], _found=("latest", F.col("_value")))
    return ran.where("_kind = 1").select("_row.*", F.col("_found").alias(out))


def named_marks(regions: DataFrame, order: tuple[str, ...], outside: tuple[str | None, str | None, str | None]) -> DataFrame:
    """Marks whose value is {name}: the first region's name; else what stands for before, between, and behind a file's regions."""
    before, between, behind = (F.lit(x).cast("string") for x in outside)
    pieces = segments(regions, *order).withColumn("_last", F.max("start").over(Window.partitionBy("file_id")))
    name = F.when(F.col("start") == F.col("_last"), behind).otherwise(F.coalesce("region_name", between))
    first = pieces.select("file_id").distinct().select("file_id", F.lit(-(1 << 63)).alias("start"), before.alias("name"))
    return pieces.select("file_id", "start", name.alias("name")).unionByName(first).select("file_id", "start", F.struct("name").alias("value"))


def _level(length: Column, wide: list[int]) -> Column:
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        out = F.when(length <= wide[k], k).otherwise(out)
    return out


def touching(reads: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """Every read with every span (_file, start_offset, end_offset and more) of its file that it touches."""
    wide = [width * 16**k for k in range(LEVELS)]
    widths = "element_at(array(" + ", ".join(f"{w}L" for w in wide) + "), {} + 1)"
    bins = lambda at, level: F.expr(f"CAST(({at}) div {widths.format(level)} AS BIGINT)")
    same = (F.col("file_id") == F.col("_file")) & (F.col("_level") == F.col("_level2")) & (F.col("_bin") == F.col("_bin2"))
    last = F.col("read_offset") + F.col("length") - 1
    reads_columns, spans_columns = [F.col(f"`{c}`") for c in reads.columns], [F.col(f"`{c}`") for c in spans.columns]

    # a span starts inside the read: the read has a level, the span's start is on all
    leveled = reads.where("length > 0").withColumn("_level", _level(F.col("length"), wide))
    two = F.array_distinct(F.array(bins("read_offset", "_level"), bins("read_offset + length - 1", "_level")))
    starts = spans.withColumn("_level2", F.explode(F.array(*map(F.lit, range(LEVELS))))).withColumn("_bin2", bins("start_offset", "_level2"))
    first = leveled.withColumn("_bin", F.explode(two)).join(starts, same & (F.col("start_offset") >= F.col("read_offset")) & (F.col("start_offset") <= last))

    # the read starts inside a span, behind its start: the span has a level, the read's start is on those that its file's spans have
    own = spans.withColumn("_level2", _level(F.col("end_offset") - F.col("start_offset") + 1, wide))
    ends = own.withColumn("_bin2", F.explode(F.array_distinct(F.array(bins("start_offset", "_level2"), bins("end_offset", "_level2")))))
    used = own.groupBy(F.col("_file").alias("_file3")).agg(F.collect_set("_level2").alias("_levels"))
    asked = reads.where("length > 0").join(used, F.col("file_id") == F.col("_file3")).withColumn("_level", F.explode("_levels")).withColumn("_bin", bins("read_offset", "_level"))
    second = asked.join(ends, same & (F.col("read_offset") > F.col("start_offset")) & (F.col("read_offset") <= F.col("end_offset")))
    return first.select(*reads_columns, *spans_columns).unionByName(second.select(*reads_columns, *spans_columns))


def apart(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """The reads that touch no region: those that start and end in one gap between the unions of a file's regions."""
    spans = sound(regions).select("file_id", F.col("start_offset").alias("lo"), (F.col("end_offset") + 1).alias("hi"))
    unions = islands(spans, ["file_id"], "lo", "hi").groupBy("file_id", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    order = Window.partitionBy("file_id").orderBy("lo")
    follows = F.coalesce(F.lead("lo").over(order), F.lit((1 << 63) - 1))
    gaps = unions.select("file_id", F.col("hi").alias("start"), F.struct(follows.alias("free_to")).alias("value"))
    filled = unions.select("file_id", F.col("lo").alias("start"), F.struct(F.col("lo").alias("free_to")).alias("value"))
    ahead = unions.groupBy("file_id").agg(F.min("lo").alias("lo")).select("file_id", F.lit(-(1 << 63)).alias("start"), F.struct(F.col("lo").alias("free_to")).alias("value"))
    # a union that begins where another ends would make two marks of one place; islands of half-open spans never do
    marks = gaps.unionByName(filled).unionByName(ahead)
    found = asof(reads, marks, "read_offset", "_free")
    free = F.col("_free").isNull() | (F.col("read_offset") + F.col("length") <= F.col("_free.free_to")) | (F.col("length") <= 0) | F.col("read_offset").isNull() | F.col("length").isNull()
    return found.where(free).select(*[F.col(f"`{c}`") for c in reads.columns])
