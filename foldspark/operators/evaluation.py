"""The evaluation flow: homology, strata, baselines, counts and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators.metrics import best_threshold, confusion, nested_strata, ranking, threshold_scores
from foldspark.operators.sequence import positions


def with_homology(rows: DataFrame, homology: DataFrame, entity: str, name: str = "max_identity") -> DataFrame:
    """``rows`` with the greatest identity of their entity; 0.0 without a hit.
    Repeated entities of the homology table count once."""
    best = homology.groupBy(entity).agg(F.max(name).alias(name))
    return rows.join(best, entity, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def with_baseline(table: DataFrame) -> DataFrame:
    """A ranking table with the average precision of a random order (the share
    of positives of the same rows) and the lift over it."""
    base = F.try_divide(F.col("positives").cast("double"), F.col("n").cast("double"))
    return table.withColumns({"baseline": base, "lift": F.try_divide(F.col("ap"), base)})


def report(rows: DataFrame, homology: DataFrame, entity: str, score: str, truth: str, limits: Sequence[float]) -> DataFrame:
    """(stratum, n, positives, auroc, ap, baseline, lift) of nested strata by
    identity to the training data."""
    return with_baseline(nested_strata(with_homology(rows, homology, entity), "max_identity", limits, score, truth))


def model_report(scored: DataFrame, split: str, truth: str, score: str, *, chosen_on: str = "val") -> DataFrame:
    """(split, n, positives, auroc, ap, baseline, lift, threshold, tn, fp, fn,
    tp, precision, recall, f1, mcc): how a model does on each part, at the
    threshold of greatest F1 on the part ``chosen_on``.  A score of at least
    the threshold counts as positive; without one (the part is empty or has no
    positives) the columns from ``threshold`` on are null."""
    chosen = best_threshold(scored.where(F.col(split) == chosen_on), [], score, truth).first()
    ranks = with_baseline(ranking(scored, [split], score, truth))
    if chosen is None:
        whole = {c: F.lit(None).cast("long") for c in ("tn", "fp", "fn", "tp")}
        return ranks.withColumns({"threshold": F.lit(None).cast("double"), **whole, **{c: F.lit(None).cast("double") for c in ("precision", "recall", "f1", "mcc")}})
    table = confusion(scored, [split], truth, F.col(score).cast("double") >= chosen["threshold"])
    made = threshold_scores(*(F.col(c) for c in ("tn", "fp", "fn", "tp")))
    return ranks.join(table.withColumn("threshold", F.lit(chosen["threshold"])).select(split, "threshold", "tn", "fp", "fn", "tp").withColumns(made), split)


def counts_by_threshold(rows: DataFrame, value: str, limits: Sequence[float]) -> DataFrame:
    """(threshold, below, at_least), nulls left out, from one aggregate."""
    col = F.col(value)
    wide = rows.agg(*(F.count(F.when(c, 1)).alias(f"{n}_{k}") for k, t in enumerate(limits) for n, c in (("below", col < t), ("at_least", col >= t))))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"below_{k}").alias("below"), F.col(f"at_least_{k}").alias("at_least")) for k, t in enumerate(limits)))))


def status_counts(rows: DataFrame, keys: Sequence[str] = (), status: str = "status") -> DataFrame:
    """(keys, status, n): what became of each item of a stage."""
    return rows.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n"))


def zipped(a: DataFrame, b: DataFrame, entity: str, order_a: Sequence[str], order_b: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of two tables side by side by their place in the entity, and
    (entity, n_a, n_b, status): entities whose lengths differ are left out and
    say so."""
    left, right = (positions(x, [entity], order) for x, order in ((a, order_a), (b, order_b)))
    n = F.count(F.lit(1))
    sizes = a.groupBy(entity).agg(n.alias("n_a")).join(b.groupBy(entity).agg(n.alias("n_b")), entity, "full")
    sizes = sizes.select(entity, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b")))
    checked = sizes.withColumn("status", F.when(F.col("n_a") == F.col("n_b"), "ok").otherwise("length mismatch"))
    rows = left.drop("rel").join(right.select(entity, "pos", *values), [entity, "pos"])
    return rows.join(checked.where("status = 'ok'").select(entity), entity, "left_semi"), checked


def largest_first(items: DataFrame, key: str, size: str, workers: int) -> DataFrame:
    """``items`` (one row an entity) with ``place``, largest first, and
    ``worker``: dealt back and forth, so that each has some of every size.
    Sizes are ranked in ranges of powers of two, not by one task."""
    dealt = items.withColumn("_r", F.when(F.col(size) > 0, F.floor(F.log2(size)).cast("int")).otherwise(-1))
    above = Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_r").agg(F.count(F.lit(1)).alias("_c")).select("_r", F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_r").orderBy(F.col(size).desc(), key)) - 1
    out = dealt.withColumn("_own", own).join(F.broadcast(parts), "_r").withColumn("place", (F.col("_own") + F.col("_o")).cast("long")).drop("_r", "_own", "_o")
    at = F.col("place") % (2 * workers)
    return out.withColumn("worker", F.least(at, 2 * workers - 1 - at).cast("int"))


def manifest(documents: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(entity document as JSON) for ``write.text``: one line an entity."""
    return documents.select(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()))).alias("value"))
