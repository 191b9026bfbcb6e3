"""Embedding whitening by weighted multiplicity covariance.

Entries become whole numbers (floor(scale * c) + shift), equal vectors are grouped once, and everything that follows works
on distinct vectors with a weight each: their count, or one. Tasks sum and multiply blocks of vectors in NumPy (sums in
whole numbers, products of centred entries in doubles); their matrices are added row by row in two grouped steps. The
driver sees D sums and one D x D matrix, of which it takes the eigenvectors; every distinct vector is whitened once, and
the rows take its values by a join on the vector. Vectors that many rows share (at most HEAVY of them) are broadcast, so
that no task has to join all rows of one vector.

Defined results: rows go if their vector is null or holds a null or an entry that is not finite; repeated rows and null ids each
keep their rows; of vectors of different lengths those of the most frequent length stay (ties: the longer). A scaled entry beyond 2^45
counts as 2^45. A component without variance has null `whitened`, explained 0 (null if nothing varies), and no part in the
identity error. `deviation` is null where no long can hold it, `deviation_exact` has the decimal then. Empty tables and
vectors of length 0 give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT, MOST_COMPONENTS = 64, 1_000_000, 32
LARGEST = 1 << 45  #: of a scaled entry
#: Vectors held by more than one HEAVY-th of all rows are broadcast: fewer than HEAVY vectors.
HEAVY = 512
#: Partial matrices are added by row and by one of so many lots first.
LOTS = 64


def whole_numbers(column: str, scale: int = SCALE, shift: int = SHIFT) -> Column:
    held = lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(F.col(column), lambda c: held(c) + F.lit(shift).cast("long"))


def clean_vectors(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """id and x of the rows whose vector is whole and has the usual length."""
    bad = F.exists(F.col(column), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = rows.where(F.col(column).isNotNull()).where(~bad)
    lengths = whole.groupBy(F.size(column).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    usual = lengths.length if lengths else 0
    return whole.where(F.size(column) == usual).where(F.lit(usual > 0)).select(F.col(id_col).alias("id"), whole_numbers(column).alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def exact(x: np.ndarray, factor: int) -> np.ndarray:
    """x as Python's whole numbers where products with `factor` might not fit into a long."""
    return x if int(np.abs(x).max(initial=0)) * factor < 1 << 62 else x.astype(object)


def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, count = None, 0
    for batch in batches:
        x, weight = matrix_of(batch.column("x")), batch.column("weight").to_numpy()
        of_batch = int(weight.sum())
        sums = (exact(x, of_batch) * weight[:, None]).sum(axis=0).astype(object)
        total, count = sums if total is None else total + sums, count + of_batch
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([count] * len(total), pa.int64()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))], ["dim", "n", "total"])


def centre(x: np.ndarray, n: int, totals: list[int]) -> np.ndarray:
    """x - S/n in doubles: the whole part of the mean goes first, so that no digit is lost."""
    near = np.array([t // n for t in totals])
    rest = np.array([(t - n * int(k)) / n for t, k in zip(totals, near, strict=True)])
    return (x - near).astype(np.float64) - rest


def add_products(frame: DataFrame, make: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum over all rows of weight * z'z, where make(batch) gives z and the weights."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z, weight = make(batch)
            product = (z * weight[:, None]).T @ z
            total = product if total is None else total + product
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["row", "cells"])

    def added(table: pa.Table) -> pa.Table:
        cells = np.zeros(len(table["cells"][0].as_py()) // 8)
        for part in table["cells"]:
            cells = cells + np.frombuffer(part.as_py())
        return pa.table({"row": pa.array([table["row"][0].as_py()], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

    parts = frame.mapInArrow(partial, "row INT, cells BINARY").withColumn("lot", F.spark_partition_id() % LOTS)
    lots = parts.groupBy("row", "lot").applyInArrow(added, "row INT, cells BINARY")
    rows = lots.groupBy("row").applyInArrow(added, "row INT, cells BINARY").orderBy("row").collect()
    return np.array([np.frombuffer(r.cells) for r in rows])


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) by falling eigenvalue, the entry of largest size positive; values without variance are 0."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.where(values > np.trace(covariance) * len(covariance) * np.finfo(float).eps, values, 0.0), vectors


def deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int]:
    """Sum over dimensions of (n*x - S)^2, exact."""
    most = max(max(abs(n * int(x[:, d].max()) - t), abs(n * int(x[:, d].min()) - t)) for d, t in enumerate(totals)) if len(x) else 0
    small = len(totals) * most * most < 1 << 62 and n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, totals)) < 1 << 62
    gap = x * n - np.array(totals) if small else x.astype(object) * n - np.array(totals, object)
    return [int(v) for v in (gap * gap).sum(axis=1)]


def whitened_vectors(distinct: DataFrame, n: int, totals: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """x, weight, deviation, deviation_exact and the array `white` of each distinct vector."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = np.sqrt(np.where(values > 0, values, np.nan))
        for batch in batches:
            x = matrix_of(batch.column("x"))
            white = centre(x, n, totals) @ vectors / root
            gaps = deviations(x, n, totals)
            flat = pa.array(white.ravel(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("x"), batch.column("weight"), pa.array([g if g < 1 << 63 else None for g in gaps], pa.int64()),
                    pa.array([Decimal(g) if g < 10**38 else None for g in gaps], pa.decimal128(38, 0)), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], flat),
                ],
                ["x", "weight", "deviation", "deviation_exact", "white"],
            )

    return distinct.mapInArrow(made, "x ARRAY<BIGINT>, weight BIGINT, deviation BIGINT, deviation_exact DECIMAL(38,0), white ARRAY<DOUBLE>")


def join_back(rows: DataFrame, white: DataFrame, n: int, *columns: str) -> DataFrame:
    """Rows with the values of their vector: frequent vectors by broadcast (fewer than HEAVY), the others by a shuffle."""
    often = F.col("copies") * HEAVY > n
    frequent, rare = F.broadcast(white.where(often).select("x", *columns)), white.where(~often).select("x", *columns)
    return rows.join(frequent, "x").unionByName(rows.join(frequent.select("x"), "x", "left_anti").join(rare, "x"))


def whiten(rows: DataFrame, *, id_col: str = "vec_id", column: str = "embedding", most: int = MOST_COMPONENTS, weights: str = "count") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error, deviation_exact, copies of each clean row and component.

    weights: `count` fits on all rows, `one` on distinct vectors.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights: count or one")
    clean = clean_vectors(rows, id_col, column)
    grouped = clean.groupBy("x").agg(F.count("*").alias("copies"))
    distinct = stored(grouped.select("x", "copies", (F.col("copies") if weights == "count" else F.lit(1).cast("long")).alias("weight")), "distinct-vectors")
    shape = "id LONG, component INT, n LONG, deviation LONG, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE, deviation_exact DECIMAL(38,0), copies LONG"
    sums = distinct.select("x", "weight").mapInArrow(partial_sums, "dim INT, n BIGINT, total DECIMAL(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).orderBy("dim").collect()
    if not sums:
        return rows.sparkSession.createDataFrame([], shape).withColumnRenamed("id", id_col)
    n, totals = sums[0].n, [int(r.total) for r in sums]
    # two-pass covariance: centred before multiplying, over distinct vectors
    covariance = add_products(distinct, lambda b: (centre(matrix_of(b.column("x")), n, totals), b.column("weight").to_numpy())) / n
    values, vectors = components_of(covariance, most)
    white = whitened_vectors(distinct.select("x", "weight"), n, totals, values, vectors)
    white = stored(white.join(distinct.select("x", "copies"), "x") if weights == "one" else white.withColumn("copies", F.col("weight")), "white-vectors")
    varies = np.flatnonzero(values > 0)
    error = None
    if len(varies):
        own = white.select("white", "weight")
        identity = add_products(own, lambda b: (matrix_of(b.column("white"))[:, varies], b.column("weight").to_numpy())) / n
        error = float(np.abs(identity - np.eye(len(varies))).max())
    trace = float(np.trace(covariance))
    explained = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values])
    whole = n if weights == "count" else white.agg(F.sum("copies")).first()[0]
    joined = join_back(clean, white, whole, "deviation", "white", "deviation_exact", "copies")
    each = joined.select("id", "deviation", "deviation_exact", "copies", F.posexplode("white").alias("k", "whitened"))
    return each.select(
        F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact", "copies",
    )
