"""Column expressions shared by the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import CHUNK_BANDS, READ_OPS, REGION_CLASSES


def by_trace() -> WindowSpec:
    return Window.partitionBy("trace_id")


def in_order() -> WindowSpec:
    """A trace's reads in order of time."""
    return by_trace().orderBy("ts", "event_order")


def earlier() -> WindowSpec:
    """All reads of the trace before this one."""
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def layer(reads: DataFrame, which: str = "success") -> DataFrame:
    """The read operations of one layer: `success` has the completed ones, `all` both layers."""
    own = reads.where(F.col("operation").isin(READ_OPS))
    return own if which == "all" else own.where("result = 'SUCCESS'")


def band(length: str = "length", bands: list[tuple[int, int, str]] = CHUNK_BANDS) -> Column:
    out = F.lit(bands[-1][2])
    for _, most, name in reversed(bands[:-1]):
        out = F.when(F.col(length) <= most, name).otherwise(out)
    return out


def region_class(name: str = "region_name") -> Column:
    out = F.lit("section")
    for kind, names in REGION_CLASSES.items():
        out = F.when(F.col(name).isin(names), kind).otherwise(out)
    return F.when(F.col(name).isNotNull(), out)


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def fixed(value: Column, places: int) -> Column:
    """A double as text with so many decimals, as C's printf writes it: its binary value is rounded, ties to even. format_string rounds its shortest decimal form, ties up."""

    def texts(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.{places}f}", na_action="ignore").astype(object)

    return F.pandas_udf(texts, "string")(value)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.select(*[F.round(f.name, places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def top(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group with their rank `rn`."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)
