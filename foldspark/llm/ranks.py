"""Ranks and running sums without one task per group.

Rows of a group are dealt into many buckets by a hash; a bucket is ordered by
one task, and what lies before it in its group is the running sum over the
small table of bucket totals.  The number of buckets grows with the rows, so
a group that holds a third of all rows still spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket holds on average: the square root of all, within these.
FEWEST, MOST = 128, 65_536


def bucketed(df: DataFrame, key: Column, n_rows: Column) -> DataFrame:
    size = F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.floor(F.sqrt(n_rows))))
    return df.withColumn("_bucket", F.pmod(key, F.greatest(F.lit(1), F.ceil(n_rows / size)).cast("long")))


def before_bucket(df: DataFrame, group: list[str], total: Column) -> DataFrame:
    """(group, _bucket, _before): the total over the group's earlier buckets."""
    sums = df.groupBy(*group, "_bucket").agg(total.alias("_total"))
    w = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, "_bucket", F.coalesce(F.sum("_total").over(w), F.lit(0)).cast("long").alias("_before"))


def ranked(df: DataFrame, group: list[str], key: Column, order: list[Column], n_rows: Column, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each group, gapless, in the
    order of (hash bucket of ``key``, ``order``).  Group columns are not null;
    ``n_rows`` is about how many rows the row's group has."""
    dealt = bucketed(df, key, n_rows)
    offsets = before_bucket(dealt, group, F.count(F.lit(1)))
    own = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    return dealt.withColumn(name, own.cast("long")).join(offsets, [*group, "_bucket"]).withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before")
