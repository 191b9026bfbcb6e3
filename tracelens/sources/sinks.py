"""Result products: CSV files for readers, Parquet for the store."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_form(df: DataFrame, separator: str = " > ") -> DataFrame:
    """Lists joined with the separator, maps as key=value lists, so that every column is a plain value."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType):
            out.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), separator).alias(f.name))
        elif isinstance(f.dataType, T.MapType):
            pairs = F.transform(F.array_sort(F.map_entries(f.name)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))
            out.append(F.array_join(pairs, separator).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    csv_form(df).write.mode("overwrite").option("header", True).csv(path)


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Nested types are kept as they are."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _generations(spark: SparkSession, path: str) -> DataFrame | None:
    """All results that the store was given, with their `_generation`; None where there is no store yet."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace(df: DataFrame, path: str) -> None:
    """Write the captures that `df` has and leave all others of the store as they are.

    Each call adds a generation, in files by size and not by capture; load() takes a capture's rows of its last one. Of two
    calls at once one raises, for they write the same generation.
    """
    known = _generations(df.sparkSession, path)
    last = known.agg(F.max("_generation")).first()[0] if known is not None else None
    df.write.mode("error").parquet(f"{path.rstrip('/')}/_generation={0 if last is None else last + 1}")


def load(spark: SparkSession, path: str, key: str = "trace_id") -> DataFrame:
    """The store, of each capture its last generation; fields that later results have are null in earlier ones, inside structs too."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    if "_generation" not in rows.columns:
        return rows
    latest = F.max("_generation").over(Window.partitionBy(key))
    return rows.withColumn("_latest", latest).where("_generation = _latest").drop("_generation", "_latest")
