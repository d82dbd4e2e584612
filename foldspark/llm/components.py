"""Connected components of an edge table by alternating large and small stars.

Edges are contracted inside each task first: what a task holds becomes stars
around the least node of each of its components, without Python code per edge.
If one task holds them all, that is the result.  Otherwise each round replaces
edges by edges to the least neighbour; the table never grows, and a node with
very many neighbours only takes part in aggregates (pre-aggregated in each
task) and in plain joins, which AQE splits.  Rounds are cut in the shared
folder.  The driver sees one count and one checksum a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import ROWS_A_TASK, cut, release, slim


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, ascending, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        x, y = up[x], up[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (higher := up[up]).tobytes() != up.tobytes():
            up = higher
    return nodes, nodes[up]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task to stars, some rows at a time."""

    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        nodes, least = least_reachable(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        return nodes[nodes != least], least[nodes != least]

    held, n = [], 0
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in (0, 1)))
        n += batch.num_rows
        if n >= 4 * ROWS_A_TASK:
            u, v = stars(held)
            if 2 * len(u) > n:  # little to contract: pass it on
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                held, n = [], 0
            else:
                held, n = [(u, v)], len(u)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(held)], ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for nodes with an edge."""
    spark = edges.sparkSession
    whole = cut(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v"))
    n_edges = whole.count()
    now = cut(slim(whole, n_edges).mapInArrow(contracted, "u long, v long"))
    seen = mark(now)
    settled = n_edges <= ROWS_A_TASK  # in one task
    while not settled:  # edges only ever sink, so this ends
        n = seen[0]
        now = slim(now, n)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))) if n else now
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = slim(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), n)
        down = large.where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(slim(small, n).distinct())
        new = mark(now)
        settled, seen = new == seen, new
    now = slim(now, seen[0])
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = cut(slim(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads), 2 * seen[0]))
    release(spark)
    return out


def mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")).first()
    return tuple(row)
