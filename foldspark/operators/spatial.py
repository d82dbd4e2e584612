"""Range self-joins within entities, and what is computed from their edges."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.session import checkpointed


def distance(coords: Sequence[str], a: str = "a", b: str = "b") -> Column:
    total = None
    for c in coords:
        d = F.col(f"{a}.{c}") - F.col(f"{b}.{c}")
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def pairs_within(points: DataFrame, entity: str, ident: str, coords: Sequence[str], radius: float, *, inclusive: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(entity, i, j, d, a, b) for each unordered pair i < j within the radius.

    A grid turns the range join into an equi-join: a point is filed under its
    cell, and again under the neighbouring cells on the other side.  Only half
    of the neighbours (and the own cell) are needed for unordered pairs.  Up
    to three coordinates make the grid; the exact predicate uses all.
    ``a`` and ``b`` are structs of the coordinates and ``carry``.
    """
    grid = list(coords[:3])
    cell = [F.floor(F.col(c) / radius).cast("long") for c in grid]
    row = F.struct(F.col(ident).alias("id"), *coords, *carry)
    left = points.select(F.col(entity).alias("_e"), *(x.alias(f"_c{k}") for k, x in enumerate(cell)), row.alias("a"))
    half = [s for s in product((-1, 0, 1), repeat=len(grid)) if s >= (0,) * len(grid)]
    shifts = F.array(*(F.struct(*(F.lit(x).cast("long").alias(f"s{k}") for k, x in enumerate(s)), F.lit(not any(s)).alias("own")) for s in half))
    right = left.select("_e", *(f"_c{k}" for k in range(len(grid))), F.col("a").alias("b"), F.explode(shifts).alias("_s"))
    right = right.select("_e", *((F.col(f"_c{k}") - F.col(f"_s.s{k}")).alias(f"_c{k}") for k in range(len(grid))), "b", F.col("_s.own").alias("_own"))
    joined = left.join(right, ["_e", *(f"_c{k}" for k in range(len(grid)))])
    once = ~F.col("_own") | (F.col("a.id") < F.col("b.id"))
    d = distance(coords)
    near = joined.where(once).withColumn("d", d).where(F.col("d") <= radius if inclusive else F.col("d") < radius)
    swap = F.col("a.id") > F.col("b.id")
    ordered = near.select(F.col("_e").alias(entity), "d", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    return ordered.select(entity, F.col("a.id").alias("i"), F.col("b.id").alias("j"), "d", "a", "b")


def both_ways(pairs: DataFrame, entity: str) -> DataFrame:
    """Every edge seen from either end: (entity, i, j, d, a, b), one pass."""
    seen = F.array(F.struct("i", "j", "d", "a", "b"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "d", F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(entity, F.inline(seen))


def counts_within(edges: DataFrame, entity: str, cutoffs: Sequence[float], name: str = "n") -> DataFrame:
    """Contacts at several cutoffs from one edge table."""
    return edges.groupBy(entity, "i").agg(*(F.sum((F.col("d") < c).cast("long")).alias(f"{name}_{k}") for k, c in enumerate(cutoffs)))


def class_shares(edges: DataFrame, entity: str, label: str, classes: Sequence, prefix: str) -> DataFrame:
    """Share of each class among neighbours at a positive distance."""
    near = edges.where("d > 0")
    n = F.count(F.lit(1))
    return near.groupBy(entity, "i").agg(*((F.sum((F.col(f"b.{label}") == c).cast("long")) / n).alias(f"{prefix}_{c}") for c in classes))


#: Halvings of an entity's box: a cell of the last level has 2^-20 of its side.
LEVELS = 20


def at_level(cells: Sequence[str], level: Column) -> list[Column]:
    """Cell coordinates of the last level as those of a level above."""
    return [F.call_function("shiftright", F.col(c), F.lit(LEVELS) - level) for c in cells]


def with_cells(places: DataFrame, cells: Sequence[str]) -> DataFrame:
    """``places`` with ``cells``, their cell of the last level, and ``_side``,
    the longest side of their entity's box."""
    low, high = ([f(F.get("at", n)).alias(f"{a}{n}") for n in range(len(cells))] for f, a in ((F.min, "_l"), (F.max, "_h")))
    spread = [F.col(f"_h{n}") - F.col(f"_l{n}") for n in range(len(cells))]
    boxes = places.groupBy("_e").agg(*low, *high, F.sum("w").alias("_n"))
    boxes = boxes.withColumn("_side", F.greatest(*spread, F.lit(1e-300)))
    scale = F.lit(float(1 << LEVELS)) / F.col("_side")
    cell = {c: F.least(F.floor((F.get("at", n) - F.col(f"_l{n}")) * scale).cast("long"), F.lit((1 << LEVELS) - 1)) for n, c in enumerate(cells)}
    return places.join(boxes, "_e").withColumns(cell).drop(*(f"{a}{n}" for n in range(len(cells)) for a in ("_l", "_h")))


def deepest_levels(places: DataFrame, cells: Sequence[str], least: int) -> DataFrame:
    """(_e, cells, level): the smallest cell around each that holds ``least``
    points, by counts of all cells of all levels; 0, the whole box, if none does."""
    ends = places.groupBy("_e", *cells).agg(F.sum("w").alias("w"))
    every = ends.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    up = [c.alias(f"_u{n}") for n, c in enumerate(at_level(cells, F.col("level")))]
    full = every.groupBy("_e", "level", *up).agg(F.sum("w").alias("c")).where(F.col("c") >= least).drop("c")
    met = every.select("_e", "level", *cells, *up).join(full, ["_e", "level", *(f"_u{n}" for n in range(len(cells)))])
    best = met.groupBy("_e", *cells).agg(F.max("level").alias("level"))
    return ends.drop("w").join(best, ["_e", *cells], "left").withColumn("level", F.coalesce("level", F.lit(0)))


def near_places(todo: DataFrame, places: DataFrame, cells: Sequence[str]) -> DataFrame:
    """(_e, level, all, d, w) of places within one side of a cell of the level
    of each place to do, by the cells around it.  Places are filed under the
    levels that their entity has to do, and no others."""
    steps = F.array(*(F.array(*(F.lit(x).cast("long") for x in s)) for s in product((-1, 0, 1), repeat=len(cells))))
    asked = todo.select("_e", "level", F.col("all").alias("a"), "_side", *(c.alias(f"_u{n}") for n, c in enumerate(at_level(cells, F.col("level")))), F.explode(steps).alias("_s"))
    asked = asked.select("_e", "level", "a", "_side", *((F.col(f"_u{n}") + F.get("_s", n)).alias(f"_u{n}") for n in range(len(cells))))
    filed = places.join(todo.select("_e", "level").distinct(), "_e")
    filed = filed.select("_e", "level", F.col("all").alias("b"), "w", *(c.alias(f"_u{n}") for n, c in enumerate(at_level(cells, F.col("level")))))
    met = asked.join(filed, ["_e", "level", *(f"_u{n}" for n in range(len(cells)))])
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    # at level 0 the box is one cell, and all of it counts
    reach = F.when(F.col("level") > 0, F.col("_side") / F.pow(F.lit(2.0), F.col("level"))).otherwise(F.lit(float("inf")))
    return met.withColumn("d", F.sqrt(gap)).where(F.col("d") <= reach).select("_e", F.col("a").alias("all"), "d", "w")


def packing_density(points: DataFrame, entity: str, ident: str, coords: Sequence[str], k: int = 12) -> DataFrame:
    """1 / (mean distance of the k nearest + 1e-8), by entity.  Points without
    a coordinate, and those alone in their entity, have none.

    Cells adapt to the points: a box is halved as long as the half around a
    point holds more than k, so a dense region has small cells and an outlier a
    large one, and neither makes the other look far.  Neighbours within a
    cell's side are in it and the cells around it; points with fewer than k
    there look again in cells twice as large.  Points at one place are one row
    with a weight, however many they are.
    """
    cells = [f"_q{n}" for n in range(min(3, len(coords)))]
    known = points.where(" and ".join(f"`{c}` is not null" for c in coords)).select(F.col(entity).alias("_e"), F.col(ident).alias("i"), F.array(*(F.col(c).cast("double") for c in coords)).alias("all"))
    weighed = known.groupBy("_e", "all").agg(F.count(F.lit(1)).alias("w"))
    places = checkpointed(with_cells(weighed.withColumn("at", F.slice("all", 1, len(cells))), cells).where("_n > 1"))
    todo = places.join(deepest_levels(places, cells, k + 1), ["_e", *cells]).select("_e", "all", "_side", "_n", "level", *cells)
    wanted, found = F.least(F.lit(k), F.col("_n") - 1).cast("long"), None
    while True:
        # each has a point at least, so k + 1 places are enough; Spark limits groups before it shuffles them
        first = F.row_number().over(Window.partitionBy("_e", "all").orderBy("d"))
        some = near_places(todo, places, cells).withColumn("_k", first).where(F.col("_k") <= k + 1)
        near = some.groupBy("_e", "all").agg(F.sum("w").alias("_c"), F.array_sort(F.collect_list(F.struct("d", "w"))).alias("_near"))
        judged = checkpointed(todo.join(near, ["_e", "all"], "left"))
        # the place itself is among those found, and one of its points is the one that asks
        done = (F.coalesce("_c", F.lit(0)) > wanted) | (F.col("level") == 0)
        part = judged.where(done).select("_e", "all", wanted.alias("k"), "_near")
        found = part if found is None else found.unionByName(part)
        todo = judged.where(~done).select("_e", "all", "_side", "_n", (F.col("level") - 1).alias("level"), *cells)
        if todo.isEmpty():
            break
    # the k + 1 nearest, the first of them at no distance
    take = "aggregate(_near, named_struct('s', 0.0D, 'open', k + 1), (a, x) -> named_struct('s', a.s + x.d * least(x.w, a.open), 'open', a.open - least(x.w, a.open))).s"
    density = found.select("_e", "all", (1.0 / (F.expr(take) / F.col("k") + 1e-8)).alias("density"))
    return known.join(density, ["_e", "all"]).select(F.col("_e").alias(entity), "i", "density")


def centroid_distance(points: DataFrame, entity: str, coords: Sequence[str]) -> DataFrame:
    """``points`` with the distance to their entity's centroid; the centroids
    are an aggregate joined back, not a window over whole entities."""
    means = points.groupBy(entity).agg(*(F.avg(c).alias(f"_m_{c}") for c in coords))
    total = None
    for c in coords:
        d = F.col(c) - F.col(f"_m_{c}")
        total = d * d if total is None else total + d * d
    return points.join(means, entity).withColumn("centroid_d", F.sqrt(total)).drop(*(f"_m_{c}" for c in coords))


def half_spheres(edges: DataFrame, directions: DataFrame, entity: str, coords: Sequence[str]) -> DataFrame:
    """(entity, i, up, down): neighbours on either side of a residue's direction."""
    dot = None
    for c in coords:
        t = (F.col(f"b.{c}") - F.col(f"a.{c}")) * F.col(f"dir_{c}")
        dot = t if dot is None else dot + t
    seen = edges.where("d > 0").join(directions.withColumnRenamed("ident", "i"), [entity, "i"])
    return seen.groupBy(entity, "i").agg(F.sum((dot > 0).cast("long")).alias("up"), F.sum((dot <= 0).cast("long")).alias("down"))
