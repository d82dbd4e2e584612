"""Ranking metrics, thresholds and roll-ups, exact and with ties.

All start from one aggregate to distinct (group, score): the many rows of a
group meet in partial sums, and running totals over scores are two-step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators.running import running_totals


def counted(df: DataFrame, keys: Sequence[str], score: str, truth: str) -> DataFrame:
    """(keys, score, n, pos): rows and positives of each distinct score."""
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(truth).cast("long")).alias("pos"))


def score_table(df: DataFrame, group: Sequence[str], score: str, truth: str, buckets: int | None = None) -> DataFrame:
    """(group, score, n, pos, before_n, before_pos), scores descending."""
    return running_totals(counted(df, group, score, truth), group, "score", ["n", "pos"], buckets)


def ranking(df: DataFrame, group: Sequence[str], score: str, truth: str, buckets: int | None = None) -> DataFrame:
    """(group, n, positives, auroc, ap); null metrics for a single class."""
    return ranked(score_table(df, group, score, truth, buckets), group)


def ranked(t: DataFrame, group: Sequence[str]) -> DataFrame:
    """``ranking`` of a score table."""
    neg = F.col("n") - F.col("pos")
    # pairs won, doubled: whole numbers until the last division
    won = F.sum(neg * (2 * F.col("before_pos") + F.col("pos")))
    hits = F.sum(F.col("pos") * (F.col("before_pos") + F.col("pos")).cast("double") / (F.col("before_n") + F.col("n")))
    out = t.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("pos").alias("positives"), won.alias("_won"), hits.alias("_hits"))
    p, q = F.col("positives"), F.col("n") - F.col("positives")
    return out.select(
        *group,
        "n",
        "positives",
        F.try_divide(F.col("_won").cast("double"), (2 * p * q).cast("double")).alias("auroc"),
        F.when((p > 0) & (q > 0), F.col("_hits") / p).alias("ap"),
    )


def confusion(df: DataFrame, group: Sequence[str], truth: str, predicted: Column) -> DataFrame:
    """(group, tn, fp, fn, tp)."""
    count = lambda t, p: F.sum(F.when((F.col(truth) == t) & (predicted == bool(p)), 1).otherwise(0)).cast("long")
    return df.groupBy(*group).agg(count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(1, 1).alias("tp"))


def threshold_scores(tn: Column, fp: Column, fn: Column, tp: Column, *, undefined: float | None = 0.0) -> dict[str, Column]:
    """Precision, recall, F1 and MCC; ``undefined`` (0, or null for a report
    that must not show a number) where a denominator is 0."""
    tn, fp, fn, tp = (x.cast("double") for x in (tn, fp, fn, tp))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(undefined))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "mcc": ratio(tp * tn - fp * fn, spread),
    }


def best_threshold(df: DataFrame, group: Sequence[str], score: str, truth: str, buckets: int | None = None) -> DataFrame:
    """(group, threshold, f1): the score of greatest F1, the lowest of equals."""
    keys = list(group) or ["_all"]
    t = score_table(df if group else df.withColumn("_all", F.lit(0)), keys, score, truth, buckets)
    t = t.join(t.groupBy(*keys).agg(F.sum("pos").alias("_p")), keys)
    tp, shown = F.col("before_pos") + F.col("pos"), F.col("before_n") + F.col("n")
    precision, recall = tp / shown, F.try_divide(tp.cast("double"), F.col("_p").cast("double"))
    f1 = 2 * precision * recall / (precision + recall + 1e-8)
    best = F.max_by(F.struct(F.col("score").alias("threshold"), F.col("_f1").alias("f1")), F.struct(F.col("_f1"), -F.col("score")))
    return t.withColumn("_f1", f1).where("_f1 is not null").groupBy(*keys).agg(best.alias("_b")).select(*group, "_b.threshold", "_b.f1")


def nested_strata(df: DataFrame, by: str, limits: Sequence[float], score: str, truth: str, buckets: int | None = None) -> DataFrame:
    """``ranking`` by ``stratum``, each limit having the rows with ``by`` below
    it.  Rows become distinct scores of the narrowest stratum before they are
    expanded to the wider ones."""
    bounds = F.array(*map(F.lit, sorted(map(float, limits))))
    above = F.filter(bounds, lambda t: F.col(by) < t)
    narrow = df.select(F.get(above, F.lit(0)).alias("_narrowest"), F.col(score).alias("_score"), F.col(truth).alias("_truth")).where("_narrowest is not null")
    finest = counted(narrow, ["_narrowest"], "_score", "_truth")
    wide = finest.withColumn("stratum", F.explode(F.filter(bounds, lambda t: t >= F.col("_narrowest"))))
    merged = wide.groupBy("stratum", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return ranked(running_totals(merged, ["stratum"], "score", ["n", "pos"], buckets), ["stratum"])


def binned(col: Column, edges: Sequence[float]) -> Column:
    """Lower edge of the half-open bin a value falls in; null outside."""
    out = F.lit(None).cast("double")
    for low, high in zip(edges, edges[1:], strict=False):
        out = F.when((col >= low) & (col < high), F.lit(float(low))).otherwise(out)
    return out


def summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean, median, std): nulls left out, sample deviation."""
    wide = df.agg(
        *(f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.percentile(m, 0.5).alias(f"{m}_median"), F.stddev_samp(m).alias(f"{m}_std")))
    )
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), *(F.col(f"{m}_{s}").alias(s) for s in ("mean", "median", "std"))) for m in metrics))
    return wide.select(F.inline(rows))


def rolled_up(df: DataFrame, levels: Sequence[Sequence[str]], score: str, truth: str, buckets: int | None = None) -> DataFrame:
    """``ranking`` at several groupings at once (grouping sets): distinct
    scores are expanded, with nulls for what a level leaves out."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    kinds = dict(df.dtypes)
    sets = F.array(
        *(F.struct(F.lit(i).alias("level"), *(F.col(c).alias(c) if c in level else F.lit(None).cast(kinds[c]).alias(c) for c in names)) for i, level in enumerate(levels))
    )
    # rows become distinct scores of the finest grouping before they are expanded
    finest = counted(df, names, score, truth).select("score", "n", "pos", F.inline(sets))
    # keys with nulls join null-safely as one text
    keyed = finest.withColumn("_key", F.to_json(F.struct("level", *names)))
    merged = keyed.groupBy("_key", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    out = ranked(running_totals(merged, ["_key"], "score", ["n", "pos"], buckets), ["_key"])
    shape = f"level int, {', '.join(f'`{c}` {kinds[c]}' for c in names)}"
    return out.withColumn("_k", F.from_json("_key", shape)).select("_k.*", "n", "positives", "auroc", "ap")


def top_and_bottom(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The k greatest and k least rows (nulls left out), as two sorted takes."""
    known = df.where(F.col(by).isNotNull())
    top = known.orderBy(F.col(by).desc(), F.col(key)).limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(known.orderBy(F.col(by), F.col(key).desc()).limit(k).withColumn("side", F.lit("bottom")))
