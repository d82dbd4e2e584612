"""Tables at rest: partitioned Parquet, arrays of other tools, metrics and
nested documents as JSON, models with their threshold."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.operators.boosting import Tree, Trees
from foldspark.session import shared_folder


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of shuffled rows for one file.
FILE_BYTES = 256 << 20


def write_by(df: DataFrame, path: str, by: Sequence[str], *, columns: Sequence[str] | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Partitioned Parquet; only the partitions present in ``df`` are replaced.

    Rows are rebalanced by partition first: small partitions share a task, and
    one with most of the rows is split over as many tasks, and files, as it has
    ``file_bytes``."""
    chosen = df.select(*columns) if columns else df
    conf = df.sparkSession.conf
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = conf.get(size, None)
    conf.set(size, str(file_bytes))  # read when the write runs, which is here
    try:
        evened = chosen.hint("rebalance", *(F.col(c) for c in by))
        evened.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.unset(size) if before is None else conf.set(size, before)


def stored_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The table written by partition in the shared folder, for many readers
    that each want some of its partitions."""
    path = f"{shared_folder(df.sparkSession)}/by-{uuid.uuid4().hex}"
    write_by(df, path, by)
    return df.sparkSession.read.parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def npz_rows(spark: SparkSession, path: str, array: str = "features") -> DataFrame:
    """(pdb_id, ord, features) from numpy archives, for migration."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    values = held[array].astype(np.float64)
                entity = name.rsplit("/", 1)[-1].split(".")[0].split("_")[0].upper()
                yield pd.DataFrame({"pdb_id": entity, "ord": range(len(values)), "features": list(values)})

    return files.mapInPandas(run, "pdb_id string, ord int, features array<double>")


def threshold(spark: SparkSession, path: str, default: float = 0.5) -> float:
    """``optimal_threshold`` of a results document, or the default."""
    rows = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.optimal_threshold").try_cast("double").alias("t")).take(1)
    return rows[0]["t"] if rows and rows[0]["t"] is not None else default


def write_metrics(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def nested(df: DataFrame, keys: Sequence[str], order: str, fields: dict[str, str], name: str = "residues") -> DataFrame:
    """One row a key with its rows as an ordered array of structs."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*(F.col(c).alias(a) for a, c in fields.items())).alias("_r"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["_r"]).alias(name))


def save_model(spark: SparkSession, model: Trees, value: float, path: str) -> None:
    """Boosted trees with the threshold that belongs to them: one row a tree."""
    rows = [(k, t.feature.tolist(), t.threshold.tolist(), t.value.tolist(), t.gain.tolist()) for k, t in enumerate(model.trees)]
    spark.createDataFrame(rows, "tree int, feature array<int>, threshold array<double>, value array<double>, gain array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    spark.createDataFrame([(float(model.base), float(value))], "base double, threshold double").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> tuple[Trees, float]:
    head = spark.read.parquet(f"{path}/model").first()
    rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
    trees = [Tree(np.array(r["feature"]), np.array(r["threshold"], np.float32), np.array(r["value"]), np.array(r["gain"])) for r in rows]
    return Trees(head["base"], trees), head["threshold"]
