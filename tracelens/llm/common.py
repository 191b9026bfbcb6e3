"""Shared storage and small expressions of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the word separators of every operator here.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a temporary folder stands in on one machine; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or getattr(shared_path, "base", "")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = shared_path.base = "file://" + tempfile.mkdtemp(prefix="tracelens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """For a write whose plan nothing reads again: Spark may remove its shuffle files at once, and hands texts to Python few at a time."""
    wanted = {CLEANUP: "true", BATCH: str(min(2000, int(spark.conf.get(BATCH, "10000")))), BATCH_BYTES: "4m"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: it cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    with writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that end together: clear() leaves them empty, once nothing reads them any more."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(stored(df, name))
        return self.tables[-1]

    def clear(self) -> None:
        for table_ in self.tables:
            for folder in {x.rpartition("/")[0] for x in table_.inputFiles()}:
                table_.sparkSession.range(0).write.mode("overwrite").parquet(folder)
        self.tables = []


def texts_of(column: pa.Array, step: int = 500) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a column of strings, a few rows at a time: a batch may hold many long texts."""
    for k in range(0, len(column), step):
        yield from column.slice(k, step).cast(pa.binary()).to_pylist()


def text_of(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
