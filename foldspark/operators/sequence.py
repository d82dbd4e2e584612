"""Ordered sequences within entities: positions, neighbours, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """0-based ``pos`` in the sequence and ``rel`` = pos / max(length - 1, 1)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    pos = F.row_number().over(w) - 1
    return df.withColumns({"pos": pos, "rel": pos / F.greatest(n - 1, F.lit(1))})


def directions(df: DataFrame, keys: Sequence[str], order: Sequence[str], coords: Sequence[str]) -> DataFrame:
    """``dir_<c>``: unit vector from the previous to the next neighbour, with
    the residue itself at an end; (.., 0, 0, 1) for a lone or degenerate one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    raw = {f"dir_{c}": F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c)) for c in coords}
    out = df.withColumns(raw)
    total = None
    for c in coords:
        t = F.col(f"dir_{c}") * F.col(f"dir_{c}")
        total = t if total is None else total + t
    out = out.withColumn("_norm", F.sqrt(total))
    fixed = {
        f"dir_{c}": F.when(F.col("_norm") > 1e-8, F.try_divide(F.col(f"dir_{c}"), F.col("_norm"))).otherwise(1.0 if k == len(coords) - 1 else 0.0)
        for k, c in enumerate(coords)
    }
    return out.withColumns(fixed).drop("_norm")


def window_starts(length: Column, size: int, stride: int) -> Column:
    """Starts of overlapping windows: one if the sequence fits, else every
    stride until a window reaches the end."""
    more = F.greatest(F.lit(0), F.ceil((length - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), more), lambda k: k * stride)


def window_mean(df: DataFrame, keys: Sequence[str], pos: str, value: str, size: int, stride: int) -> DataFrame:
    """Each position's mean, over the windows that hold it, of the window's
    mean: a per-window model followed by overlap averaging."""
    length = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    with_windows = df.join(length, list(keys)).withColumn("_start", F.explode(F.filter(window_starts(F.col("_n"), size, stride), lambda s: (s <= F.col(pos)) & (F.col(pos) < s + size))))
    per_window = with_windows.groupBy(*keys, "_start").agg(F.avg(value).alias("_m"))
    return with_windows.join(per_window, [*keys, "_start"]).groupBy(*keys, pos).agg(F.avg("_m").alias("smoothed"), F.count(F.lit(1)).alias("n_windows"))


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), Window.currentRow)
    return df.withColumn("rolling", F.avg(value).over(w))


def chain_text(df: DataFrame, keys: Sequence[str], order: str, letter: str, name: str = "sequence") -> DataFrame:
    """One text per key from its letters in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(letter).alias("l"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["l"]), "").alias(name))


def split_by_lengths(flat: DataFrame, lengths: DataFrame, entity: str, part: str, order: str, n: str, at: str) -> DataFrame:
    """Cuts one flat run of rows (numbered by ``at``) into parts of given
    lengths; entities whose lengths do not add up are left out."""
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spans = lengths.withColumn("_from", F.coalesce(F.sum(n).over(w), F.lit(0)))
    total = lengths.groupBy(entity).agg(F.sum(n).alias("_total"))
    fits = flat.groupBy(entity).agg(F.count(F.lit(1)).alias("_own")).join(total, entity).where("_own = _total").select(entity)
    rows = spans.join(fits, entity).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col(n) - 1))).where(F.col(n) > 0)
    keyed = rows.select(entity, part, F.col("_i").alias("pos"), (F.col("_from") + F.col("_i")).alias(at))
    return flat.join(keyed, [entity, at])
