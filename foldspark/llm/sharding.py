"""Sharding by sampled splitters (DataFrame functions only).

Records have a key, the digest of their text, so equal texts share one.  A
size-weighted sample of keys is drawn, its quantiles become the boundaries of
many more key ranges than shards, and records are range-partitioned by them.
The exact bytes of every range are then summed; a range fuller than
``overfull`` of a shard's share is subdivided: keys that are half as large by
themselves become parts of their own, and the rest is dealt by further digits
of the key, so that equal texts stay together.  Only a single key that is
itself overfull (a hot text) is dealt by a hash of the record id.  Parts,
fullest first, go to the shard with the fewest bytes, so shard sizes are
nearly equal.

The law that holds is ``bytes``.  Groups of equal texts stay in one shard
unless they are larger than ``overfull`` of a shard's share.

Defined cases: a null text has size 1 and counts as empty; rows that repeat
each get a slot of their own; a null id is a record like any other; rows of a
hot text that share an id too are dealt by their place in the table, as no
column tells them apart; an empty table gives an empty table; input columns
named like computed ones are replaced.

Shape at scale: the driver sees the sample (``samples`` keys, a documented
bound), one sum per range and part, and the keys and (key, id) pairs that are
large by themselves (at most ``shards * 2 / overfull`` of each).  Records are
shuffled narrow, by fine buckets; slots come from ranks in those buckets plus
offsets, not from one task per shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import cut
from foldspark.llm.ranks import ranked


def record_columns(text: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    return {"size": (F.octet_length(whole) + 1).cast("long"), "text_crc32": F.crc32(whole.cast("binary")), "_key": F.md5(whole.cast("binary"))}


def splitters(records: DataFrame, total: int, samples: int, ranges: int) -> list[str]:
    """Quantile boundaries of a sample in which a key is as likely as its
    record is large.  A record's draw is a hash of key and id: reruns agree."""
    draw = F.pmod(F.xxhash64(F.lit(17), "_key", "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chance = F.col("size") * F.lit(samples / max(total, 1))
    times = F.floor(chance + draw).cast("long")  # whole expectation, and the rest by the draw
    drawn = sorted((r["_key"], r["times"]) for r in records.withColumn("times", times).where("times > 0").groupBy("_key").agg(F.sum("times").alias("times")).collect())
    step = sum(n for _, n in drawn) / ranges
    bounds, seen, due = [], 0, step
    for key, n in drawn:
        seen += n
        if seen >= due:
            bounds.append(key)
            due = (seen // step + 1) * step  # a heavy key may pass several quantiles
    return bounds


def range_of(key: Column, bounds: list[str]) -> Column:
    """Index of the first boundary that is not below the key: two look-ups in
    sorted literal arrays, of about the square root of their number each."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    heads = [bounds[min(i + width, len(bounds)) - 1] for i in range(0, len(bounds), width)]
    below = lambda values: F.size(F.filter(values, lambda b: b < key))
    blocks = F.array(*(F.array(*map(F.lit, bounds[i : i + width])) for i in range(0, len(bounds), width)))
    block = below(F.array(*map(F.lit, heads)))
    within = F.coalesce(below(F.get(blocks, block)), F.lit(0))
    return F.least(block * width + within, F.lit(len(bounds))).cast("int")


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def least_loaded(sizes: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """Each part to the least loaded shard, largest part first."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for part, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[part] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", samples: int = 16_384, ranges: int = 512, overfull: float = 1 / 16) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    # digests are taken once; everything after reads these narrow rows
    place = F.monotonically_increasing_id().alias("_place")
    records = cut(docs.select(F.col(id_col).alias("_id"), place, *(c.alias(n) for n, c in record_columns(F.col(text_col)).items())))
    row = records.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    n, total = row["n"], row["bytes"] or 0
    bounds = splitters(records, total, samples, ranges)
    ranged = records.withColumn("_range", range_of(F.col("_key"), bounds))
    bytes_by = lambda rows, *by: rows.groupBy(*by).agg(F.sum("size").alias("bytes"))
    sizes = {(r["_range"], 0): r["bytes"] for r in bytes_by(ranged, "_range").collect()}
    limit = overfull * total / shards
    half = max(1, int(limit / 2))
    full = {k: v for (k, _), v in sizes.items() if v > limit}
    # a row's part within its range, and what deals rows that nothing tells apart
    part, spread = F.lit(0), F.lit(0).cast("long")
    if full:
        within = ranged.where(F.col("_range").isin(list(full)))
        large = [(r["_range"], r["_key"], r["bytes"]) for r in bytes_by(within, "_range", "_key").where(F.col("bytes") > half).collect()]
        hot = [key for _, key, size in large if size > limit]
        named = F.concat_ws(":", F.col("_key"), F.col("_id").cast("string"))
        if hot and (same := [r["_name"] for r in bytes_by(within.where(F.col("_key").isin(hot)), named.alias("_name")).where(F.col("bytes") > half).collect()]):
            spread = F.when(F.col("_key").isin(hot) & named.isin(same), F.col("_place")).otherwise(spread)
        first: dict[int, int] = {}  # the part that is free next
        parts: dict[str, tuple[int, int]] = {}
        for r, size in full.items():
            rest = size - sum(b for q, _, b in large if q == r)
            first[r] = max(1, -(-rest // half))
        ways = dict(first)
        for r, key, size in sorted(large):
            n_ways = -(-size // half) if size > limit else 1
            parts[key], first[r] = (first[r], n_ways), first[r] + n_ways
        digits = F.conv(F.substring("_key", 17, 15), 16, 10).cast("long")
        part = F.pmod(digits, F.coalesce(F.try_element_at(literal_map(ways), F.col("_range")), F.lit(1)))
        if parts:
            own = F.try_element_at(literal_map({k: v[0] for k, v in parts.items()}), F.col("_key"))
            n_ways = F.try_element_at(literal_map({k: v[1] for k, v in parts.items()}), F.col("_key"))
            part = F.when(own.isNotNull(), own + F.pmod(F.xxhash64(F.lit(29), "_id", "_key", "_spread"), n_ways)).otherwise(part)
    parted = ranged.withColumn("_spread", spread).withColumn("_part", part.cast("int"))
    if full:
        fine = bytes_by(parted.where(F.col("_range").isin(list(full))), "_range", "_part").collect()
        sizes = {k: v for k, v in sizes.items() if k[0] not in full} | {(r["_range"], r["_part"]): r["bytes"] for r in fine}
    placed = least_loaded(sizes, shards)
    by_range: dict[int, list[int]] = {}
    for r, p in sorted(placed):
        row_of = by_range.setdefault(r, [])
        row_of += [0] * (p + 1 - len(row_of))
        row_of[p] = placed[r, p]
    table = F.array(*(F.array(*map(F.lit, by_range.get(r, [0]))) for r in range(len(bounds) + 1)))
    sharded = parted.withColumn("shard", F.get(F.get(table, F.col("_range")), F.col("_part")).cast("int")).drop("_range", "_part")
    order = [F.col("_id"), F.col("_key"), F.col("_spread")]
    slots = ranked(sharded, ["shard"], F.xxhash64("_key", "_id", "_spread"), order, F.lit(n / shards), "slot")
    return slots.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
