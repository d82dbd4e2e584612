"""Running totals over a global order, without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.session import checkpointed

ROWS_A_TASK = 200_000


def running_totals(df: DataFrame, group: Sequence[str], order: str, values: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``df`` with ``before_<v>``: the sum of ``v`` over the group's rows of
    greater ``order``.  (group, order) is unique.

    A prefix scan in two passes: rows are ranged by (group, order) into
    partitions of about ``ROWS_A_TASK`` rows (or ``buckets`` of them), each
    sums its own, and the totals of a group's earlier partitions, one row for
    each partition it lies in, are added.  The input is computed once; no
    expression grows with the number of partitions, and a group of any size
    spreads over as many as it fills.
    """
    df = checkpointed(df)
    if buckets is None:
        buckets = max(1, -(-df.count() // ROWS_A_TASK))
    if buckets > 1:
        ranged = checkpointed(df.repartitionByRange(buckets, *group, F.col(order).desc()).withColumn("_part", F.spark_partition_id()))
    else:
        ranged = df.withColumn("_part", F.lit(0))
    totals = ranged.groupBy("_part", *group).agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *group, *(F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values))
    inside = Window.partitionBy("_part", *group).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({f"_w_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    out = own.join(offsets, ["_part", *group]).withColumns({f"before_{v}": F.col(f"_w_{v}") + F.col(f"_o_{v}") for v in values})
    return out.select(*df.columns, *(f"before_{v}" for v in values))
