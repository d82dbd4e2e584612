"""Packing token sequences by cutting-stock column generation.

Documents are tokenized (with an end token each) and cut at multiples of the
sequence length; what is left of a document is one piece.  Lengths are counted
in classes of ``unit`` tokens, rounded up.  The number of sequences is
minimised over patterns (how many pieces of each class a sequence takes) by a
linear program with column generation: the simplex multipliers of the present
patterns price the classes, and a knapsack by dynamic programming finds the
pattern that is worth most.  Pattern counts are rounded down, and what they
leave of the histogram is filled greedily, largest class first.  Pieces of a
class are ranked, and ranks are handed out to patterns in stretches.

Defined cases: a null text is empty and holds only the end token; rows that
repeat are packed row by row; an empty table gives an empty table; other
input columns are ignored, whatever their names.

Shape at scale: one scan tokenizes; from there on rows are (id, start,
length, ...), written once to the shared folder.  The driver sees the
histogram, which has at most ``length / unit`` rows, and gives back the
patterns, at most about twice as many.  Ranks within a class are two-step, so
a class may hold any share of the pieces; a sequence holds at most
``length / unit`` pieces, so the running offset is a window over a bounded
group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm._common import cut, prepare
from foldspark.llm.ranks import ranked
from foldspark.llm.token_counts import compiled, portions

# ---- pieces -----------------------------------------------------------------


def piece_rows(path: str, length: int, end_id: int):
    """(id, text) to one row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducers = compiled(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            held: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for rows, texts in portions(batch.column(1)):
                for row, ids in zip(rows.tolist(), transducers.ids(texts), strict=True):
                    held[row].append(ids)
            out: list[tuple[int, int, int, int, int]] = []
            for row, parts in enumerate(held):
                ids = np.concatenate([*parts, end]).astype("<u4")
                for at in range(0, len(ids), length):
                    own = ids[at : at + length]
                    out.append((row, at, len(own), zlib.crc32(own.tobytes()), len(ids)))
            cols = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), *map(pa.array, cols[1:])], ["_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


# ---- the linear program -----------------------------------------------------


def best_patterns(value: np.ndarray, size: np.ndarray, room: int, most: int) -> tuple[float, list[np.ndarray]]:
    """Unbounded knapsack: the most valuable multiset of classes in ``room``,
    and the best ones that hold some other class, from one table."""
    worth, taken = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(size, np.arange(room + 1), "right")
    for w in range(1, room + 1):
        worth[w] = worth[w - 1]
        if fits[w]:
            with_one = value[: fits[w]] + worth[w - size[: fits[w]]]
            i = int(with_one.argmax())
            if with_one[i] > worth[w] + 1e-12:
                worth[w], taken[w] = with_one[i], i
    found: dict[bytes, np.ndarray] = {}
    for first in np.argsort(-(value + worth[room - size]), kind="stable")[:most].tolist():
        pattern, w = np.zeros(len(size), np.int64), room - int(size[first])
        pattern[first] = 1
        while w > 0:
            if taken[w] < 0:
                w -= 1
            else:
                pattern[taken[w]] += 1
                w -= int(size[taken[w]])
        found.setdefault(pattern.tobytes(), pattern)
    return float(worth[room]), list(found.values())


def cutting_stock(size: np.ndarray, demand: np.ndarray, room: int, *, gap: float = 2e-3, rounds: int = 20_000, columns: int = 24) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, by the revised simplex method.
    Sizes ascend.  Stops when Farley's bound, or the bound by content, is
    within ``gap``."""
    m, least = len(size), float(size @ demand) / room
    patterns = np.diag(room // size).astype(np.float64)
    inverse = np.diag(1.0 / (room // size))
    used = inverse @ demand
    for _ in range(rounds):
        worth, found = best_patterns(np.maximum(inverse.sum(axis=0), 0.0), size, room, columns)
        if worth <= 1 + gap or used.sum() <= (1 + gap) * least:
            break
        moved = False
        for pattern in found:
            held = np.flatnonzero(pattern)
            change = inverse[:, held] @ pattern[held]
            if change.sum() <= 1 + gap / 2:  # what it is worth by now
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(change > 1e-9, used / change, np.inf)
            leave = int(np.argmin(ratio))
            if not np.isfinite(ratio[leave]):
                continue
            step = ratio[leave]
            used -= step * change
            used[leave] = step
            row = inverse[leave] / change[leave]
            moving, wide = np.flatnonzero(change), np.flatnonzero(row)
            if 2 * len(moving) < m or 2 * len(wide) < m:  # most of the inverse stays
                inverse[np.ix_(moving, wide)] -= change[moving, None] * row[wide]
            else:
                inverse -= change[:, None] * row
            inverse[leave] = row
            patterns[:, leave] = pattern
            moved = True
        if not moved:
            break
    return [(patterns[:, j].astype(np.int64), max(0.0, float(used[j]))) for j in range(m)]


def whole_patterns(size: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that take every piece exactly once."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, used in cutting_stock(size, demand.astype(np.float64), room):
        some = pattern > 0
        times = min(int(used + 1e-9), int((left[some] // pattern[some]).min())) if some.any() else 0
        if times > 0:
            left -= times * pattern
            out.append((pattern, times))
    while left.any():
        pattern, space = np.zeros(len(size), np.int64), room
        for i in np.flatnonzero(left)[::-1]:
            n = min(int(left[i]), int(space // size[i]))
            pattern[i], space = n, space - n * size[i]
        some = pattern > 0
        times = int((left[some] // pattern[some]).min())
        left -= times * pattern
        out.append((pattern, times))
    return out


def stretches(sizes: np.ndarray, patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, list[int], list[int], list[int]]]:
    """By class: first ranks, pieces a sequence, and first sequences of the
    stretches of its ranks."""
    by: dict[int, tuple[list[int], list[int], list[int]]] = {}
    seen, base = np.zeros(len(sizes), np.int64), 0
    for pattern, times in patterns:
        for i in np.flatnonzero(pattern).tolist():
            first, each, sequence = by.setdefault(i, ([], [], []))
            first.append(int(seen[i]))
            each.append(int(pattern[i]))
            sequence.append(base)
        seen += pattern * times
        base += times
    return [(int(sizes[i]), *lists) for i, lists in sorted(by.items())]


# ---- the operator -----------------------------------------------------------


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, unit: int = 8, end_id: int = 2) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    pieces = cut(narrow.mapInArrow(piece_rows(path, length, end_id), f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"))
    classed = pieces.withColumn("_class", F.ceil(F.col("length") / unit).cast("int"))
    counted = sorted((r["_class"], r["n"]) for r in classed.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect())
    sizes, demand = np.array([c for c, _ in counted], np.int64), np.array([n for _, n in counted], np.int64)
    patterns = whole_patterns(sizes, demand, length // unit) if counted else []
    counts = dict(counted)
    rows = [(c, counts[c], *lists) for c, *lists in stretches(sizes, patterns)]
    # at most length / unit rows, each with the stretches of its class
    plan = F.broadcast(spark.createDataFrame(rows, "_class int, _n long, _first array<long>, _each array<long>, _base array<long>"))
    joined = classed.join(plan, "_class")
    key = F.xxhash64("_id", "start", "ids_crc32")
    placed = ranked(joined, ["_class"], key, [F.col("_id"), F.col("start"), F.col("ids_crc32")], F.col("_n"), "_rank")
    at = F.size(F.filter("_first", lambda x: x <= F.col("_rank"))) - 1
    placed = placed.withColumn("_at", at)
    within = F.col("_rank") - F.get(F.col("_first"), F.col("_at"))
    sequence = F.get(F.col("_base"), F.col("_at")) + F.floor(within / F.get(F.col("_each"), F.col("_at")))
    packed = placed.withColumn("sequence_id", sequence.cast("long"))
    w = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "_id", "start", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long")
    return packed.select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
