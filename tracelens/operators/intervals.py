"""Unions and islands of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import cut, running


def covered(df: DataFrame, keys: list[str], low: str = "lo", high: str = "hi") -> DataFrame:
    """keys, covered: length of the union of the half-open [low, high) of each group.

    An interval adds what lies beyond the greatest end before it, so one ordered scan and one sum do. Where a group is hot,
    intervals of one start are merged first.
    """
    rows = cut(df, keys, F.col(low))
    if "_slice" in rows.columns:
        rows = rows.groupBy(*keys, "_slice", low).agg(F.max(high).alias(high))
    ran = running(rows, keys, [low, high], _reach=("max", F.col(high)))
    beyond = F.col(high) - F.greatest(F.col(low), F.coalesce("_reach", F.col(low)))
    return ran.withColumn("_beyond", F.greatest(beyond, F.lit(0))).groupBy(*keys).agg(F.sum("_beyond").alias("covered"))


def islands(df: DataFrame, keys: list[str], *order: str, low: str = "lo", high: str = "hi", gap: int = 0) -> DataFrame:
    """`df` with `island`: intervals that start at most `gap` after the greatest end so far belong together; `order` begins with `low`."""
    rows = df if "_slice" in df.columns else cut(df, keys, F.col(low))
    ran = running(rows, keys, list(order), _reach=("max", F.col(high)))
    new = F.when(F.col("_reach").isNull() | (F.col(low) > F.col("_reach") + gap), 1).otherwise(0)
    counted = running(ran.withColumn("_new", new), keys, list(order), island=("sum", F.col("_new")))
    return counted.withColumn("island", F.col("island") + F.col("_new")).drop("_new", "_reach", "_slice")
