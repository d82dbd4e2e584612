"""Joins that align feature tables with a base table on composite keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_each(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of greatest ``order`` for each key, by a partial aggregate: a
    key held by many rows is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, "_row.*")


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def aligned(base: DataFrame, features: DataFrame, keys: Sequence[str], values: Mapping[str, object], order: str | None = None) -> DataFrame:
    """``base`` with ``values`` of ``features``; a miss takes the given fill.
    With ``order``, the last of duplicate keys counts.  Base rows all stay."""
    right = last_of_each(features, keys, order) if order else features
    out = base.join(right.select(*keys, *values), list(keys), "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(fill)) for n, fill in values.items()})


def aligned_inner(base: DataFrame, features: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    right = last_of_each(features, keys, order) if order else features
    return base.join(right, list(keys))


def flagged(df: DataFrame, members: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """1 where the key is among the members, else 0."""
    there = members.select(*keys).distinct().withColumn("_there", F.lit(1))
    return df.join(there, list(keys), "left").withColumn(name, F.coalesce("_there", F.lit(0))).drop("_there")


def assembled(base: DataFrame, blocks: Mapping[str, tuple[DataFrame, Mapping[str, object]]], keys: Sequence[str], entity: str, order: str | None = None) -> DataFrame:
    """Many blocks on one base.  A block fits an entity if its keys there are
    the base's, no fewer and no others; where it does not, it is filled for the
    whole entity, and ``has_<block>`` tells.  Of a block's duplicate keys the
    last counts (of greatest ``order``, or else of greatest values).

    All blocks and the base's keys meet in one union and one aggregate by key,
    so each block is read and shuffled once, however many there are; whether
    they fit is one more aggregate, by entity, over its result.
    """
    ident = list(dict.fromkeys([*keys, entity]))
    known = base.select(*ident, F.lit(1).alias("_in_base"))
    for name, (block, values) in blocks.items():
        last = F.col(order) if order else F.struct(*values)
        rows = block.select(*ident, F.struct(last.alias("last"), F.struct(*values).alias("row")).alias(f"_b_{name}"))
        known = known.unionByName(rows, allowMissingColumns=True)
    picked = [F.max_by(f"_b_{n}.row", f"_b_{n}.last").alias(f"_b_{n}") for n in blocks]
    met = known.groupBy(*ident).agg(F.max("_in_base").alias("_in_base"), *picked, *(F.count(f"_b_{n}").alias(f"_c_{n}") for n in blocks))
    here = F.col("_in_base").isNotNull()
    same = [F.bool_and(here == (F.col(f"_c_{n}") > 0)).alias(f"_fits_{n}") for n in blocks]
    fits = met.groupBy(entity).agg(*same)
    out = base.join(met.where(here).drop("_in_base", *(f"_c_{n}" for n in blocks)), ident, "left").join(fits, entity, "left")
    made = {f"has_{n}": F.coalesce(f"_fits_{n}", F.lit(False)) for n in blocks}
    for n, (_, values) in blocks.items():
        made |= {c: F.when(F.col(f"_fits_{n}"), F.coalesce(F.col(f"_b_{n}.{c}"), F.lit(v))).otherwise(F.lit(v)) for c, v in values.items()}
    return out.select(*base.columns, *(c.alias(n) for n, c in made.items()))


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """What a resumed stage still has to do.  ``version`` (a hash of code and
    parameters) keeps results of older versions from counting as done."""
    ready = done.where(F.col("version") == version) if version is not None else done
    return todo.join(ready.select(*keys), list(keys), "left_anti")
