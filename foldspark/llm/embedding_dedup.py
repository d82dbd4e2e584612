"""Embedding near-dedup by an epsilon grid order join.

Unit vectors of cosine at least c lie within eps = sqrt(2 - 2c) of each other.
Vectors are rotated onto principal axes, their leading coordinates fall into
grid cells of side eps / 2, and all vectors are sorted by cell (epsilon grid
order).  The sequence is cut into leaves of ``LEAF`` vectors, leaves form
blocks, and blocks are the lowest level of a tree of longer intervals.  Pairs
of intervals are joined recursively from the top; a pair whose bounding boxes
are further than eps apart is skipped with everything below it.  Boxes bound
the leading coordinates and the norm of all the others, and the width, so that
vectors of different lengths are far apart.  Pairs of blocks that remain meet
in one task, where the recursion goes on to pairs of leaves; those that remain
are compared as matrices, in double precision on the vectors as given.

The axes come from a bounded sample (``sample`` vectors of each of the most
common lengths; others are not rotated): any rotation keeps distances, so the
sample has no bearing on the result, only on how much is skipped.

Links are counted, not listed: a pair of blocks returns, for each vector with
a link, the number of its links and one edge that keeps the pair's components.
Equal vectors are one node with a multiplicity, so copies cost nothing.

Defined cases: a vector that is null or empty, has a null or non-finite
component, or is all zeros links with nothing; vectors of different lengths do
not link; rows that repeat are vectors of their own and link with each other;
a row with a null id links with nothing and has a null component; an empty
table gives an empty table; other input columns are ignored.

Shape at scale: one range partitioning by (cell, id), so a hot cell spreads
over tasks; the tree's pairs are plain joins on parents; a pair of blocks is a
bounded group, and a vector travels once for each block that its own cannot
be told apart from (blocks, not leaves, so that these are few).  What is
skipped depends on the vectors: in clusters, nearly everything; vectors spread
evenly in many dimensions lie within eps of each other in any few leading
ones, and there every pair of blocks is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm._common import cut, prepare
from foldspark.llm.components import components

GRID_DIMS, BOX_DIMS = 8, 12
#: A box has the leading coordinates, the norm of the others, and the width.
BOX = BOX_DIMS + 2
FANOUT = 16
LEAF = 256
#: There are at least so many blocks, and a block has so many vectors, and bytes
#: of them in double precision, at most.
BLOCKS, BLOCK_ROWS, BLOCK_BYTES = 8, 65_536, 32 << 20
#: Columns compared with a leaf at once.
TILE = 8192
#: Lengths of vectors that have their own axes.
ROTATED = 32


def usable(vector: Column) -> Column:
    """Whether a vector can link at all (null counts as false)."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length, and their vectors as a matrix."""
    kind = np.float64 if pa.types.is_float64(column.type.value_type) else np.float32
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(kind)
    widths = np.diff(at)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield rows, flat[at[rows][:, None] + np.arange(width)]


def axes_of(drawn: np.ndarray) -> np.ndarray:
    centred = drawn - drawn.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(axes[:, ::-1])


def principal_axes(vectors: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Axes for the most common lengths."""
    sized = vectors.withColumn("_n", F.size("_vector"))
    common = [r["_n"] for r in sized.groupBy("_n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "_n").limit(ROTATED).collect()]
    out = {}
    for width in common:
        rows = sized.where(F.col("_n") == width).orderBy(F.xxhash64(F.lit(3), "_id")).limit(sample).select("_vector").toArrow()
        out[width] = axes_of(unit(np.array(rows["_vector"].to_pylist(), np.float64)))
    return out


def turned(units: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Leading coordinates (``BOX_DIMS`` at most), the norm of the others, and
    the width on a scale that sets lengths apart."""
    n, width = units.shape
    lead = min(BOX_DIMS, width)
    out = np.zeros((n, BOX))
    out[:, :lead] = units @ axes[width][:, :lead] if width in axes else units[:, :lead]
    out[:, BOX_DIMS] = np.sqrt(np.maximum(0.0, 1.0 - (out[:, :lead] ** 2).sum(axis=1))) if width > lead else 0.0
    out[:, BOX_DIMS + 1] = 10.0 * width
    return out


def gridded(axes: dict[int, np.ndarray], eps: float):
    """Rows plus their length and the cells of their leading coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.zeros((batch.num_rows, GRID_DIMS + 1), np.int32)
            for rows, vectors in by_width(batch.column(2)):
                at[rows, 0] = vectors.shape[1]
                at[rows, 1:] = np.floor(turned(unit(vectors), axes)[:, :GRID_DIMS] / (eps / 2))
            for j in range(GRID_DIMS + 1):
                batch = batch.append_column(f"_c{j}", pa.array(at[:, j]))
            yield batch

    return run


def boxes(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high corners of stretches of rows."""
    at = np.arange(0, len(points), size)
    return np.minimum.reduceat(points, at), np.maximum.reduceat(points, at)


def intervals(axes: dict[int, np.ndarray], block: int):
    """A sorted partition to blocks: (part, seq, width, ids, sizes, vectors, low, high)."""
    kinds = [*[pa.int32()] * 3, *[pa.binary()] * 3, *[pa.list_(pa.float64())] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def whole() -> pa.RecordBatch:
            ids, sizes, vectors = (np.concatenate([r[i] for r in held]) for i in range(3))
            low, high = boxes(turned(unit(vectors), axes), len(ids))
            values = [[part], [seq], [vectors.shape[1]], [ids.tobytes()], [sizes.tobytes()], [vectors.tobytes()], [low[0].tolist()], [high[0].tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "seq", "width", "ids", "sizes", "vectors", "low", "high"])

        n = 0
        for batch in batches:
            for rows, vectors in by_width(batch.column(2)):
                ids, sizes = (batch.column(i).to_numpy()[rows] for i in (0, 1))
                if n and held[0][2].shape[1] != vectors.shape[1]:
                    yield whole()
                    held, n, seq = [], 0, seq + 1
                while len(ids):
                    take = min(block - n, len(ids))
                    held.append((ids[:take], sizes[:take], vectors[:take]))
                    ids, sizes, vectors, n = ids[take:], sizes[take:], vectors[take:], n + take
                    if n == block:
                        yield whole()
                        held, n, seq = [], 0, seq + 1
        if n:
            yield whole()

    return run


def apart(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Squared distance of two boxes (low, high)."""
    gap = lambda low, high: F.zip_with(low, high, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    both = F.zip_with(gap(a[0], b[1]), gap(b[0], a[1]), lambda x, y: F.pow(F.greatest(x, y), 2))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def corner(of: str) -> Column:
    fold = F.min if of == "low" else F.max
    return F.array(*(fold(F.get(F.col(of), j)) for j in range(BOX))).alias(of)


def block_pairs(blocks: DataFrame, eps: float, n_blocks: int) -> DataFrame:
    """(a, b), a <= b, of blocks that may hold linked vectors."""
    heights = max(0, math.ceil(math.log(max(n_blocks, 1), FANOUT)) - 1)
    limit = (eps + 1e-6) ** 2
    boxes = blocks.select("rank", "low", "high")
    pairs = None
    for height in range(heights, -1, -1):
        span = FANOUT**height
        level = boxes.groupBy(F.floor(F.col("rank") / span).cast("long").alias("at")).agg(corner("low"), corner("high")) if height else boxes.withColumnRenamed("rank", "at")
        side = lambda x: level.select(F.col("at").alias(x), F.floor(F.col("at") / FANOUT).cast("long").alias(f"up_{x}"), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"))  # noqa: B023, E731
        if pairs is None:  # the top has at most FANOUT intervals
            top = max(1, -(-n_blocks // span))
            pairs = side("a").withColumn("b", F.explode(F.sequence("a", F.lit(top - 1).cast("long")))).join(side("b"), "b")
        else:
            up = pairs.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"))
            pairs = up.join(side("a"), "up_a").join(side("b"), "up_b").where("a <= b")
        pairs = pairs.where(apart((F.col("low_a"), F.col("high_a")), (F.col("low_b"), F.col("high_b"))) <= limit).select("a", "b")
        pairs = cut(pairs)
    return pairs


def near_leaves(a: np.ndarray, b: np.ndarray, eps: float, same: bool, leaf: int = LEAF) -> np.ndarray:
    """Which pairs of leaves of two blocks (as turned points) may hold links.
    Each level halves both sides of the pairs that the level above left."""
    n, m = -(-len(a) // leaf), -(-len(b) // leaf)
    limit = (eps + 1e-6) ** 2
    size = leaf
    while size < max(len(a), len(b)):
        size *= 2
    i = j = np.zeros(1, np.int64)
    while True:
        (low_a, high_a), (low_b, high_b) = boxes(a, size), boxes(b, size)
        gap = np.maximum(np.maximum(low_a[i] - high_b[j], low_b[j] - high_a[i]), 0.0)
        ok = (gap * gap).sum(axis=1) <= limit
        if same:
            ok &= i <= j
        i, j = i[ok], j[ok]
        if size == leaf:
            break
        size //= 2
        i, j = (2 * i[:, None] + [0, 0, 1, 1]).ravel(), (2 * j[:, None] + [0, 1, 0, 1]).ravel()
        inside = (i * size < len(a)) & (j * size < len(b))
        i, j = i[inside], j[inside]
    out = np.zeros((n, m), bool)
    out[i, j] = True
    return out


def stretches(chosen: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of true values."""
    edge = np.flatnonzero(np.diff(np.r_[0, chosen.astype(np.int8), 0]))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def compared(kind: str, cosine: float, eps: float, axes):
    """The blocks of one pair to (vec, links, root)."""
    dtype = np.float64 if kind == "double" else np.float32

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
        ids = [np.frombuffer(r["ids"], np.int64) for r in rows]
        sizes = [np.frombuffer(r["sizes"], np.int64) for r in rows]
        units = [unit(np.frombuffer(r["vectors"], dtype).reshape(-1, r["width"])) for r in rows]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        same = len(rows) == 1
        a, b = 0, len(rows) - 1
        near = near_leaves(turned(units[a], axes.value), turned(units[b], axes.value), eps, same)
        for leaf, chosen in enumerate(near):
            x = slice(leaf * LEAF, (leaf + 1) * LEAF)
            for first, last in stretches(chosen):
                for j in range(first * LEAF, min(last * LEAF, len(ids[b])), TILE):
                    y = slice(j, min(j + TILE, last * LEAF))
                    linked = units[a][x] @ units[b][y].T >= cosine
                    if same:  # a pair once: what lies behind its own leaf, and above the diagonal in it
                        linked &= np.arange(x.start, x.start + linked.shape[0])[:, None] < np.arange(j, j + linked.shape[1])
                    r, c = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                    if not len(r):
                        continue
                    small = linked[np.ix_(r, c)]
                    to_rows, to_cols = roots(small, ids[a][x][r], ids[b][y][c])
                    out.append((ids[a][x][r], small @ sizes[b][y][c], to_rows))
                    out.append((ids[b][y][c], small.T @ sizes[a][x][r], to_cols))
        empty = np.zeros(0, np.int64)
        vec, links, root = (np.concatenate([o[k] for o in out]) if out else empty for k in range(3))
        return pa.table({"vec": pa.array(vec, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    return run


def roots(linked: np.ndarray, row_ids: np.ndarray, col_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id in the component of every row and column of a tile."""
    rows, cols = row_ids.copy(), col_ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(linked, cols[None, :], top).min(axis=1))
        new_cols = np.minimum(cols, np.where(linked, new_rows[:, None], top).min(axis=0))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def joined(vectors: DataFrame, kind: str, cosine: float, block_rows: int, sample: int) -> DataFrame:
    """(vec, links, root) over nodes (_id, _size, _vector)."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    axes = principal_axes(vectors, sample)
    names = [f"_c{j}" for j in range(GRID_DIMS + 1)]
    layout = f"_id long, _size long, _vector array<{kind}>, " + ", ".join(f"{c} int" for c in names)
    placed = vectors.select("_id", "_size", "_vector").mapInArrow(gridded(axes, eps), layout)
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("_vector")), F.lit(1))).first()
    n_blocks = max(BLOCKS, -(-n // max(1, min(block_rows, BLOCK_BYTES // (8 * width)))))
    n_rows = -(-n // n_blocks)
    ordered = placed.repartitionByRange(*names, "_id").sortWithinPartitions(*names, "_id").select("_id", "_size", "_vector").coalesce(n_blocks)
    blocks = cut(ordered.mapInArrow(intervals(axes, max(1, n_rows)), "part int, seq int, width int, ids binary, sizes binary, vectors binary, low array<double>, high array<double>"))
    # the rank of a block: its place in its partition, after all earlier ones
    per_part = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = blocks.join(before, "part").withColumn("rank", F.col("before") + F.col("seq"))
    pairs = block_pairs(ranked, eps, blocks.count())
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("rank"))
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    return sides.join(ranked.select("rank", "width", "ids", "sizes", "vectors"), "rank").groupBy("a", "b").applyInArrow(compared(kind, cosine, eps, shared), "vec long, links long, root long")


def near_duplicates(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, block: int = BLOCK_ROWS, sample: int = 2048) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.  ``id_col`` holds whole
    numbers; ``block`` bounds the vectors of one side of a task."""
    prepare(table.sparkSession)
    kind = "double" if dict(table.dtypes)[vector_col] == "array<double>" else "float"
    rows = table.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast(f"array<{kind}>").alias("_vector"))
    rows = rows.withColumn("_vector", F.when(F.col("_id").isNotNull() & usable(F.col("_vector")), F.col("_vector")))
    nodes = cut(rows.where("_vector is not null").groupBy("_vector").agg(F.min("_id").alias("_node"), F.count(F.lit(1)).alias("_size")))
    found = cut(joined(nodes.select(F.col("_node").alias("_id"), "_size", "_vector"), kind, cosine, block, sample))
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    groups = components(found.where("vec <> root").select(F.col("vec").alias("a"), F.col("root").alias("b")))
    print_of = F.xxhash64("_vector")
    known = (
        nodes.join(links, F.col("_node") == F.col("vec"), "left")
        .join(groups, F.col("_node") == F.col("node"), "left")
        .select(F.col("_vector").alias("_of"), print_of.alias("_print"), (F.coalesce("links", F.lit(0)) + F.col("_size") - 1).alias("_links"), F.coalesce("component", "_node").alias("_component"))
    )
    out = rows.withColumn("_key", print_of).join(known, (F.col("_key") == F.col("_print")) & (F.col("_vector") == F.col("_of")), "left")
    component = F.coalesce("_component", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("_id") == component).alias("kept"))
