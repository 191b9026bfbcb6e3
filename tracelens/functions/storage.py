"""A scratch folder that driver and executors share, and how rows are dealt over the files of one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset a temporary folder stands in on one machine, a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", "") or getattr(scratch, "base", "")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = scratch.base = "file://" + tempfile.mkdtemp(prefix="tracelens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` with all rows of a key in one task, over a stated number of tasks.

    A repartition by the keys themselves is left out over a union whose sides are dealt by them, and then each side gets files of its
    own; without a number it is merged to few tasks by bytes, whatever number of files these have to write.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), F.xxhash64(*keys))


#: Captures whose files are written, listed and read at a time: the driver holds some kilobytes of every file that it knows.
PER_LOT = 10_000


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """For many small files: as many tasks list folders as cores can take, by default it is one a folder, a task reads hundreds of files,
    and the driver keeps no listing once its frame is gone (else 250 MB of them)."""
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": "256k", "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def in_lots(rows: DataFrame, key: str, name: str, run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What `run` gives of the rows and a folder of its own, lot by lot of PER_LOT keys at most or about, stored after each.

    The folders of all lots lie below one. No lot knows the files of another, so that the driver's memory does not grow with the keys;
    the rows are dealt to the lots once.
    """
    spark = rows.sparkSession
    lots = max(1, -(-rows.select(key).distinct().count() // PER_LOT))
    root, out = scratch(spark, name), scratch(spark, f"{name}-found")
    if lots > 1:
        path, tasks = scratch(spark, f"{name}-rows"), int(spark.conf.get("spark.sql.shuffle.partitions"))
        place = F.pmod(F.xxhash64(F.col(key)), F.lit(lots)), F.pmod(F.hash(F.col(key)), F.lit(max(1, tasks // lots)))
        rows.withColumn("_lot", place[0]).repartition(max(tasks, lots), "_lot", place[1]).write.partitionBy("_lot").parquet(path)
        rows = spark.read.schema(rows.withColumn("_lot", place[0]).schema).parquet(path)
    for lot in range(lots):
        own = rows.where(F.col("_lot") == lot).drop("_lot") if lots > 1 else rows
        with small_files(spark):
            found = run(own, f"{root}/lot{lot:05d}")
            found.write.mode("append").parquet(out)
    return spark.read.schema(found.schema).parquet(out)
