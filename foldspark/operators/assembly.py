"""From feature blocks to a data set: alignment, coverage, scaling, axes, sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark import schema
from foldspark.operators import align, learning, projection
from foldspark.sources.tables import write_by


def block_columns(name: str) -> list[str]:
    return [f"{name}_{k}" for k in range(schema.BLOCKS[name])]


def padded(block: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """A block with all columns of its name; those it lacks are 0.0 (a
    frustration block without the mutational three, for one)."""
    return block.select(*keys, *(F.col(c).cast("double").alias(c) if c in block.columns else F.lit(0.0).alias(c) for c in block_columns(name)))


def assemble(base: DataFrame, blocks: Mapping[str, DataFrame], keys: Sequence[str], entity: str, order: Sequence[str] = tuple(schema.BLOCKS)) -> DataFrame:
    """All blocks of ``schema.BLOCKS`` on one base, by name: a block that is
    missing, or whose rows do not number the entity's, is 0.0 there, and
    ``has_<block>`` tells.  Training and evaluation differ only in ``order``."""
    named = {n: (padded(blocks[n], n, list(dict.fromkeys([*keys, entity]))), dict.fromkeys(block_columns(n), 0.0)) for n in order if n in blocks}
    out = align.assembled(base, named, keys, entity)
    absent = {c: F.lit(v) for n in order if n not in blocks for c, v in [(f"has_{n}", False), *((c, 0.0) for c in block_columns(n))]}
    out = out.withColumns(absent) if absent else out
    return out.select(*base.columns, *(c for n in order for c in (f"has_{n}", *block_columns(n))))


def covered(rows: DataFrame, entity: str, least: float = 0.5, order: Sequence[str] = tuple(schema.BLOCKS)) -> DataFrame:
    """Rows of the entities that have at least that share of the blocks."""
    has = sum((F.col(f"has_{n}").cast("int") for n in order), F.lit(0))
    gate = rows.groupBy(entity).agg((F.min(has) / len(order)).alias("_share")).where(F.col("_share") >= least).select(entity)
    return rows.join(gate, entity, "left_semi")


def library_frustration(high: Column, neutral: Column, minimal: Column) -> list[Column]:
    """The four configurational columns from a library's class densities; it
    gives no index, so a weighted difference of the densities stands for it."""
    return [x.alias(f"frustration_{k}") for k, x in enumerate((high, neutral, minimal, -2.0 * high + 1.5 * minimal))]


def elastic_constant() -> Column:
    """The anisotropic fluctuation of the feature layout: constant 0, as it is
    reserved there and never computed."""
    return F.lit(0.0)


def build(rows: DataFrame, splits: DataFrame, entity: str, features: Sequence[str], vector: str | None = None, axes: int = 128) -> tuple[DataFrame, dict]:
    """Assembled rows with their split, scaled (and ``vector`` projected) by
    what the train part says; and the metadata that goes with them."""
    joined = rows.join(splits.select(entity, "split"), entity)
    train = joined.where("split = 'train'")
    scaler = learning.fit_scaler(train, features)
    out = learning.scaled(joined, scaler)
    metadata = {"features": list(features), "scaler": scaler, "axes": 0, "explained": None}
    if vector:
        model = projection.fit_projection(train, vector, axes)
        out = projection.projected(out, vector, model, "axes").drop(vector)
        metadata |= {"axes": axes, "explained": float(model.explained.sum())}
    return out, metadata


def write_dataset(rows: DataFrame, metadata: dict, path: str) -> None:
    """The data set by split, with one metadata row beside it."""
    write_by(rows, f"{path}/data", ["split"])
    spark = rows.sparkSession
    scaler = [(c, float(m), float(s)) for c, (m, s) in metadata["scaler"].items()]
    kind = "features array<string>, scaler array<struct<feature: string, mean: double, deviation: double>>, axes int, explained double"
    spark.createDataFrame([(metadata["features"], scaler, metadata["axes"], metadata["explained"])], kind).write.mode("overwrite").parquet(f"{path}/metadata")
