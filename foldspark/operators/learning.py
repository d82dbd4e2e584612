"""Scaling, projection, boosted trees and their search."""

from __future__ import annotations

import math
import pickle
import random
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foldspark.functions.scalar import clean
from foldspark.operators import boosting
from foldspark.operators.running import running_totals
from foldspark.session import checkpointed, ship_package


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of cleaned columns, from one aggregate."""
    row = train.agg(*(f(clean(F.col(c))).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"{c}_m"] or 0.0, row[f"{c}_s"] or 1.0) for c in columns}


def scaled(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (clean(F.col(c)) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def class_weight(df: DataFrame, truth: str) -> float:
    """sqrt(negatives / positives)."""
    row = df.agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    return math.sqrt((row["n"] - row["p"]) / row["p"]) if row["p"] else 1.0


# ---- boosted trees ----------------------------------------------------------


def edges_over(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """``boosting.edges_of`` each feature over all rows: values are counted, a
    prefix scan places them, and those at the quantiles are read."""
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(c).alias("x")) for k, c in enumerate(features))))
    counts = checkpointed(rows.select(values.alias("_v")).groupBy("_v.f", "_v.x").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("f").agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_values"))
    placed = running_totals(counts, ["f"], "x", ["n"]).join(F.broadcast(sizes), "f")
    last = F.col("_rows") - F.col("before_n") - 1  # places of a value: from last - n + 1 to last
    spots = F.transform(F.sequence(F.lit(1), F.lit(boosting.BINS - 1)), lambda k: F.ceil(k * (F.col("_rows") - 1) / boosting.BINS))
    wanted = (F.col("_values") <= boosting.BINS) | F.exists(spots, lambda at: (at <= last) & (at > last - F.col("n")))
    found = placed.where(wanted).select("f", "x", (F.col("_values") > boosting.BINS).alias("cut")).toPandas()  # at most BINS rows a feature
    out = []
    for k in range(len(features)):
        own = found[found["f"] == k].sort_values("x")
        out.append(own["x"].to_numpy(np.float32)[0 if own["cut"].any() else 1 :])
    return out


def gathered(df: DataFrame, features: Sequence[str], truth: str, edges: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """All rows with a truth, as kinds that trees can't tell apart: a row of
    each (single precision, ``clean``), its truth, how many they are, and the
    edges of the bins (of these rows, unless given).

    Rows are counted by bins and truth in Spark; the driver gets the kinds, at
    most 2 * 64 ^ features and as many as there are rows."""
    names = [f"_f{k}" for k in range(len(features))]
    rows = df.where(F.col(truth).isNotNull()).select(*(clean(F.col(c)).cast("float").alias(n) for n, c in zip(names, features, strict=True)), F.col(truth).cast("int").alias("_t"))
    if edges is None:
        rows = checkpointed(rows)
        edges = edges_over(rows, names)
    ship_package(df.sparkSession)
    layout = df.sparkSession.createDataFrame([], ", ".join(f"{n} int" for n in names) + ", _t int, _n long").schema
    schema = to_arrow_schema(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch[n].to_numpy() for n in names])
            bins, _, own, times = boosting.distinct(x, batch["_t"].to_numpy(), edges)
            columns = [*bins.T.astype(np.int32), own.astype(np.int32), times.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=schema)

    kinds = rows.mapInArrow(run, layout).groupBy(*names, "_t").agg(F.sum("_n").alias("_n")).toArrow()
    held = np.column_stack([kinds[c].to_numpy() for c in (*names, "_t", "_n")]).astype(np.int64)
    held = held[np.lexsort(held.T[::-1])]
    return boosting.standing(held[:, :-2], edges), held[:, -2], held[:, -1], edges


def both(train: DataFrame, validation: DataFrame, features: Sequence[str], truth: str) -> dict:
    """What ``boosting.fit`` takes: kinds of all rows of both, by the edges of the first."""
    x, own, times, edges = gathered(train, features, truth)
    x_held, own_held, times_held, _ = gathered(validation, features, truth, edges)
    return {"x": x, "truth": own, "x_held": x_held, "truth_held": own_held, "edges": edges, "times": times, "times_held": times_held}


def fit_trees(
    train: DataFrame, validation: DataFrame, features: Sequence[str], truth: str, *, weight: float | None = None, **params
) -> tuple[boosting.Trees, int]:
    """Boosted trees cut to the prefix to use, and its length: that of greatest
    validation average precision before ``patience`` rounds without gain.

    They are fitted on all rows, in one task that has them as kinds
    (``gathered``).  Positives weigh sqrt(negatives / positives) of all rows
    unless ``weight`` is given."""
    if weight is None:
        weight = class_weight(train, truth)
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(both(train, validation, features, truth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            model = boosting.fit(**shared.value, weight=weight, **params)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    ship_package(spark)
    model = pickle.loads(spark.range(1, numPartitions=1).mapInArrow(run, "model binary").first()["model"])
    return model, len(model.trees)


def tree_scores(df: DataFrame, model: boosting.Trees, features: Sequence[str], name: str = "y_prob") -> DataFrame:
    """``df`` with the model's probability, by batches."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(shared.value.probability(np.column_stack(columns).astype(np.float32)))

    return df.withColumn(name, score(*(clean(F.col(c)) for c in features)))


def importances(df: DataFrame, model: boosting.Trees, features: Sequence[str]) -> DataFrame:
    """(rank, feature, importance): shares of the gain of all splits."""
    rows = sorted(zip(features, model.importances(len(features)).tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(rows)], "rank int, feature string, importance double")


# ---- search -----------------------------------------------------------------

#: Name, bounds, kind: log scale, linear, or whole numbers.
SPACE = [
    ("depth", 3, 8, "whole"),
    ("rate", 0.005, 0.3, "log"),
    ("min_child", 5, 100, "whole"),
    ("gamma", 0.0, 1.0, "linear"),
    ("subsample", 0.5, 1.0, "linear"),
    ("columns", 0.3, 1.0, "linear"),
    ("alpha", 1e-8, 10.0, "log"),
    ("lam", 1e-8, 10.0, "log"),
]
TRIALS = "trial int, ap double, auroc double, n_trees int, " + ", ".join(f"{n} {'int' if kind == 'whole' else 'double'}" for n, _, _, kind in SPACE) + ", weight double"


def proposed(trial: int, done: list[dict], heaviest: float, trials: int, seed: int) -> dict:
    """Parameters of a trial: the first half at random, then a kernel draw
    around one of the best tenth of the trials done, favouring the better."""
    rng = random.Random(f"{seed}:{trial}")
    space = [*SPACE, ("weight", 1.0, max(1.0, heaviest), "linear")]
    ranked = sorted(done, key=lambda r: (-r["ap"], r["trial"]))
    near = None if trial < trials // 2 or not ranked else ranked[min(len(ranked) - 1, int(rng.random() ** 2 * max(1, len(ranked) // 10)))]
    out = {}
    for name, low, high, kind in space:
        to, back = (math.log, math.exp) if kind == "log" else (float, float)
        a, b = to(low), to(high)
        x = rng.uniform(a, b) if near is None else min(b, max(a, rng.gauss(to(near[name]), 0.12 * (b - a))))
        out[name] = round(back(x)) if kind == "whole" else min(high, max(low, back(x)))
    return out


def search(
    train: DataFrame, validation: DataFrame, features: Sequence[str], truth: str, *, trials: int = 100, at_once: int = 20, rounds: int = 2000, patience: int = 50, seed: int = 42, study: str | None = None
) -> DataFrame:
    """One row a trial: a seeded search over nine parameters for the greatest
    validation average precision.  ``at_once`` trials run side by side, one a
    task, and later ones learn from all before them.

    ``study`` is a folder of Parquet to which every batch of trials is
    appended; a search that finds trials there goes on behind them."""
    spark = train.sparkSession
    data = both(train, validation, features, truth)
    positives = int(data["times"][data["truth"] == 1].sum())
    heaviest = (int(data["times"].sum()) - positives) / max(positives, 1)
    shared = spark.sparkContext.broadcast(data)
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            held, truth_of, times = (shared.value[k] for k in ("x_held", "truth_held", "times_held"))
            for row in batch.to_pylist():
                params = {n: row[n] for n in ("depth", "rate", "min_child", "gamma", "subsample", "columns", "alpha", "lam", "weight")}
                model = boosting.fit(**shared.value, rounds=rounds, patience=patience, seed=seed, **params)
                scores = model.probability(held)
                out.append(row | {"ap": boosting.average_precision(truth_of, scores, times), "auroc": boosting.auroc(truth_of, scores, times), "n_trees": len(model.trees)})
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(layout))

    layout = spark.createDataFrame([], TRIALS).schema
    done = [r.asDict() for r in spark.read.schema(layout).parquet(study).orderBy("trial").collect()] if study and stored(spark, study) else []
    while len(done) < trials:
        batch = [proposed(t, done, heaviest, trials, seed) | {"trial": t, "ap": None, "auroc": None, "n_trees": None} for t in range(len(done), min(trials, len(done) + at_once))]
        asked = spark.createDataFrame(batch, layout).repartitionByRange(len(batch), "trial")
        new = checkpointed(asked.mapInArrow(run, layout))
        if study:
            new.coalesce(1).write.mode("append").parquet(study)
        done += [r.asDict() for r in new.orderBy("trial").collect()]
    return spark.createDataFrame(done[:trials], layout)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def retrained(train: DataFrame, validation: DataFrame, features: Sequence[str], truth: str, trials: DataFrame, *, rounds: int = 2000, patience: int = 50, seed: int = 42) -> tuple[boosting.Trees, int]:
    """The trees of the best trial, the first of equals, fitted again."""
    best = trials.orderBy(F.col("ap").desc(), "trial").first()
    params = {n: best[n] for n in ("depth", "rate", "min_child", "gamma", "subsample", "columns", "alpha", "lam", "weight")}
    return fit_trees(train, validation, features, truth, rounds=rounds, patience=patience, seed=seed, **params)
