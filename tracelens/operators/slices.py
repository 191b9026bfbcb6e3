"""Prefix scans over the ordered rows of a group in two levels, so that no task has to hold the rows of a hot group.

cut() looks for groups with many rows and cuts their order into slices at quantiles. running() then works within slices,
sums each slice up in one row, runs over those rows, and adds what stands before a slice to what it found inside. Groups
that are not hot are one slice, as in a plain window; where no group is hot, plain windows are all there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import scratch

#: A group is hot with more rows than this and more than one MOST_HOT-th of all rows: fewer than MOST_HOT groups.
HOT_ROWS, MOST_HOT = 500_000, 4096
#: Slices of a hot group; with MOST_HOT groups that is a million rows of sums at most.
SLICES = 256

_known: dict[tuple, DataFrame | None] = {}


def hot_bounds(rows: DataFrame, keys: list[str], by: Column) -> DataFrame | None:
    """keys and the SLICES - 1 values of `by` that cut each hot group, written once; None without hot groups."""
    spark = rows.sparkSession
    key = spark.sparkContext.applicationId, rows.semanticHash(), tuple(keys), str(by), HOT_ROWS, MOST_HOT, SLICES
    if key not in _known:
        if len(_known) > 1000:
            _known.clear()
        counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
        found = counts.agg(F.sum("_n").alias("total"), F.max("_n").alias("most")).first()
        least = max(HOT_ROWS, (found.total or 0) // MOST_HOT)
        _known[key] = None
        if (found.most or 0) > least:
            hot = F.broadcast(counts.where(F.col("_n") > least).select(*keys))
            fractions = [k / SLICES for k in range(1, SLICES)]
            bounds = rows.select(*keys, by.cast("long").alias("_by")).join(hot, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx("_by", fractions, 10_000).alias("_bounds"))
            path = scratch(spark, "slice-bounds")
            bounds.write.parquet(path)
            _known[key] = spark.read.parquet(path)
    return _known[key]


def cut(rows: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """`rows` with `_slice` if any group is hot; `by` (a number) has to rise with the order that running() is given."""
    bounds = hot_bounds(rows, keys, by)
    if bounds is None:
        return rows
    below = F.size(F.filter("_bounds", lambda b: b < by.cast("long")))
    return rows.join(F.broadcast(bounds), keys, "left").withColumn("_slice", F.when(F.col("_bounds").isNull() | by.isNull(), 0).otherwise(below)).drop("_bounds")


def running(rows: DataFrame, keys: list[str], order: list[str], **wanted: tuple[str, Column]) -> DataFrame:
    """`rows` with a column for each name: what (kind, column) gives over the rows of the group before this one.

    Kinds: `count` (its column does not matter) and `sum` (0 for the first row), `max`, `last`, and `latest`, the last that is not null (null for the first row).
    """
    sliced = "_slice" in rows.columns
    group = Window.partitionBy(*keys, *(["_slice"] if sliced else []))
    own = group.orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    found = {"count": lambda c: F.row_number().over(own).cast("long") - 1, "sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "max": lambda c: F.max(c).over(before), "last": lambda c: F.lag(c).over(own), "latest": lambda c: F.last(c, True).over(before)}
    inside = {name: found[kind](c) for name, (kind, c) in wanted.items()}
    if not sliced:
        return rows.withColumns(inside)
    # one row per slice, of hot groups alone: the others have one slice, before which nothing stands
    hot = rows.where(F.col("_slice") > 0).select(*keys).distinct()
    place = F.struct(*order)
    latest = lambda c: F.max_by(F.struct(c.alias("v")), F.when(c.isNotNull(), place))
    total = {"count": lambda c: F.count("*"), "sum": F.sum, "max": F.max, "last": lambda c: F.max_by(F.struct(c.alias("v")), place), "latest": latest}
    sums = rows.join(F.broadcast(hot), keys, "left_semi").groupBy(*keys, "_slice").agg(
        *[total[kind](c).alias(f"_{name}") for name, (kind, c) in wanted.items()]
    )
    slices = Window.partitionBy(*keys).orderBy("_slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    over = {"count": lambda c: F.sum(c).over(earlier), "sum": lambda c: F.sum(c).over(earlier), "max": lambda c: F.max(c).over(earlier), "last": lambda c: F.lag(c).over(slices), "latest": lambda c: F.last(F.when(c["v"].isNotNull(), c), True).over(earlier)}
    ahead = sums.select(*keys, "_slice", *[over[kind](F.col(f"_{name}")).alias(f"_{name}") for name, (kind, _) in wanted.items()])
    first = F.row_number().over(own) == 1
    joined = rows.withColumns(inside | {"_first": first}).join(F.broadcast(ahead), [*keys, "_slice"], "left")
    whole = {
        name: F.col(name) + F.coalesce(f"_{name}", F.lit(0)) if kind in ("sum", "count") else F.greatest(name, f"_{name}") if kind == "max" else F.coalesce(F.col(name), F.col(f"_{name}")["v"]) if kind == "latest" else F.when(F.col("_first"), F.col(f"_{name}")["v"]).otherwise(F.col(name))
        for name, (kind, _) in wanted.items()
    }
    return joined.withColumns(whole).drop("_first", *[f"_{name}" for name in wanted])
