"""Principal axes by a seeded randomised range finder.

Rows stay in the executors.  A pass multiplies the covariance by a thin matrix:
each task sums its rows' part and sends one matrix, matrices are added up in
groups of tasks, and the driver gets a few, each the size of the model
(dimensions by axes), however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.session import checkpointed, ship_package

#: Matrices added by one task, and sent to the driver at most.
AT_ONCE = 32


@dataclass
class Projection:
    """Mean, axes as columns, the variance along each, and the variance of all."""

    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    total: float

    @property
    def explained(self) -> np.ndarray:
        return self.variance / self.total if self.total else self.variance


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column that have no nulls, one below the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def product(rows: DataFrame, vector: str, mean: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """The scatter matrix of the rows times ``thin``, in one pass."""
    width, kind = thin.shape[0], "part int, m binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(thin.shape), None
        for batch in batches:
            part = batch.column(1)[0].as_py() if batch.num_rows else part
            centred = matrix(batch.column(0), width) - mean
            total += centred.T @ (centred @ thin)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "m"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table["m"])
        return pa.table({"part": pa.array([table["g"][0].as_py()], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select(vector, F.spark_partition_id().alias("part")).mapInArrow(partial, kind)
    n = rows.rdd.getNumPartitions()
    while n > AT_ONCE:
        parts = parts.select(F.floor(F.col("part") / AT_ONCE).cast("int").alias("g"), "m").groupBy("g").applyInArrow(added, kind)
        n = -(-n // AT_ONCE)
    return sum((np.frombuffer(r["m"]) for r in parts.select("m").collect()), np.zeros(thin.size)).reshape(thin.shape)


def fit_projection(train: DataFrame, vector: str, k: int, *, oversample: int = 10, powers: int = 4, seed: int = 42) -> Projection:
    """The ``k`` axes of greatest variance.  ``powers`` passes sharpen the range
    that ``oversample`` more axes span; with as many axes as dimensions it is
    exact.  Null vectors, and those of another length than most, are left out;
    signs are such that each axis's largest component is positive."""
    ship_package(train.sparkSession)
    sized = train.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    if sized is None or not sized["n"]:
        raise ValueError("no vectors to fit axes on")
    rows = train.where((F.size(vector) == sized["n"]) & ~F.exists(vector, lambda x: x.isNull())).select(vector)
    rows = checkpointed(rows)  # read by every pass
    row = rows.select(Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(vector)).alias("s")).select("s.*").first()
    mean, n, width = row["mean"].toArray(), row["count"], sized["n"]
    thin = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + oversample))))[0]
    for _ in range(powers):
        thin = np.linalg.qr(product(rows, vector, mean, thin))[0]
    values, turned = np.linalg.eigh(thin.T @ product(rows, vector, mean, thin))
    axes = (thin @ turned)[:, ::-1][:, :k]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    free = max(1, n - 1)
    return Projection(mean, axes, np.maximum(values[::-1][:k], 0.0) / free, float(row["variance"].toArray().sum()))


def projected(df: DataFrame, vector: str, model: Projection, name: str) -> DataFrame:
    """``df`` with ``name``, the coordinates along the axes; null where the
    vector is null, holds a null, or has another length."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    width = len(model.mean)

    @F.pandas_udf("array<double>")
    def along(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list((np.stack(vectors.to_list()).astype(np.float64) - shared.value.mean) @ shared.value.axes))

    fits = (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull())
    safe = F.when(fits, F.col(vector)).otherwise(F.array_repeat(F.lit(0.0), width))
    return df.withColumn(name, F.when(fits, along(safe)))


def variances(df: DataFrame, model: Projection) -> DataFrame:
    """(axis, variance, explained) of a fitted projection."""
    rows = [(i, float(v), float(e)) for i, (v, e) in enumerate(zip(model.variance, model.explained, strict=True))]
    return df.sparkSession.createDataFrame(rows, "axis int, variance double, explained double")
