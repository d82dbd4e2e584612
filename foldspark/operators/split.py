"""Leakage-safe splits by cluster, and clustering by shared word k-grams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import NGram, RegexTokenizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators.graph import checkpointed


def cluster_split(members: DataFrame, cluster: str, shares: Sequence[tuple[str, float]] = (("train", 0.70), ("val", 0.15), ("test", 0.15)), seed: str = "42") -> DataFrame:
    """``members`` with ``split``.  Clusters are ordered by a seeded digest and
    cut by count, rounded down; the last part takes the rest.  Only the
    cluster table (one row a cluster) is ordered, by the first digits of the
    digest in 4096 parts, each with the clusters of earlier parts before it."""
    clusters = members.select(cluster).distinct().withColumn("_h", F.md5(F.concat(F.col(cluster).cast("string"), F.lit(":" + seed))))
    dealt = clusters.withColumn("_b", F.substring("_h", 1, 3))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # 4096 rows at most
    parts = parts.select("_b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_h", cluster)) - 1
    numbered = dealt.withColumn("_own", own).join(F.broadcast(parts), "_b").withColumn("_r", F.col("_own") + F.col("_o"))
    split, reach = F.lit(shares[-1][0]), 0.0
    bounds = []
    for _, share in shares[:-1]:
        bounds.append(F.floor(F.col("_n") * share))
    edges = [sum(bounds[: k + 1], F.lit(0)) for k in range(len(bounds))]
    for (name, _), edge in reversed(list(zip(shares[:-1], edges, strict=True))):
        split = F.when(F.col("_r") < edge, name).otherwise(split)
    return members.join(numbered.select(cluster, split.alias("split")), cluster)


def shuffled_split(clusters: Sequence[str], seed: int = 42, train: float = 0.70, val: float = 0.15) -> dict[str, str]:
    """The same cut in numpy's legacy shuffle order, for a bounded list of
    cluster names on the driver."""
    order = sorted(clusters)
    np.random.RandomState(seed).shuffle(order)
    a = int(len(order) * train)
    b = a + int(len(order) * val)
    return {c: "train" if i < a else "val" if i < b else "test" for i, c in enumerate(order)}


#: Rows of about 30 bytes.
BROADCAST_GRAMS = 500_000


def shingled(df: DataFrame, text: str, k: int) -> DataFrame:
    """``df`` with ``_grams``, the distinct k-grams of words; too short texts are left out."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\s+").transform(df.where(F.col(text).isNotNull()))
    grams = NGram(n=k, inputCol="_words", outputCol="_ngrams").transform(words).where(F.size("_ngrams") > 0)
    return grams.withColumn("_grams", F.array_distinct("_ngrams")).drop("_words", "_ngrams")


def similar_pairs(a: DataFrame, b: DataFrame, text: str, ids: tuple[str, str], *, k: int = 3, distance: float = 0.8) -> DataFrame:
    """(id_a, id_b, distance): all pairs within a Jaccard distance over word
    k-grams, exactly, by a join on grams.

    A gram is a 128-bit digest.  Only grams that both sides have are counted;
    what a set has besides is in its size.  Repeated rows count once; of several
    texts under one id the nearest counts.  ``b`` is the small side: a gram
    meets as many rows as texts of ``b`` have it, and up to a counted
    ``BROADCAST_GRAMS`` its grams are broadcast."""
    left, right = (shingled(df, text, k).select(F.col(i).alias("id"), F.size("_grams").alias("n"), F.explode("_grams").alias("_g")) for df, i in ((a, ids[0]), (b, ids[1])))
    left, right = (df.select("id", "n", F.xxhash64("_g").alias("g"), F.xxhash64(F.reverse("_g")).alias("h")) for df in (left, right))
    right = F.broadcast(right) if right.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else right
    met = left.select(F.col("id").alias("id_a"), F.col("n").alias("n_a"), "g", "h").join(right.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), "g", "h"), ["g", "h"])
    # distinct grams, as rows may be repeated on either side
    shared = met.groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count_distinct("g", "h").alias("c"))
    apart = F.lit(1.0) - F.try_divide(F.col("c").cast("double"), (F.col("n_a") + F.col("n_b") - F.col("c")).cast("double"))
    near = shared.select("id_a", "id_b", apart.alias("distance")).where(F.col("distance") <= distance)
    return near.groupBy("id_a", "id_b").agg(F.min("distance").alias("distance"))  # several texts under one id


def clusters(pairs: DataFrame) -> DataFrame:
    """(side, id, component) for the texts of ``similar_pairs``: the parts of
    the graph of pairs, named by their least id of ``a``.  Each round a text
    of ``b`` takes the least name of its texts, and these the least of theirs."""
    links = checkpointed(pairs.select("id_a", "id_b").distinct(), 0)
    now = links.select("id_a", F.col("id_a").alias("c")).distinct()
    settled, r = False, 0
    while not settled:  # names only ever sink
        by_b = links.join(now, "id_a").groupBy("id_b").agg(F.min("c").alias("c"))
        by_a = links.join(by_b, "id_b").groupBy("id_a").agg(F.min("c").alias("c"))
        hop = by_a.select(F.col("id_a").alias("c"), F.col("c").alias("further"))
        new = by_a.join(hop, "c").select("id_a", F.col("further").alias("c"))
        new = checkpointed(new.join(now.select("id_a", F.col("c").alias("was")), "id_a"), r)
        settled = new.where("c <> was").isEmpty()
        now, r = new.drop("was"), r + 1
    by_b = links.join(now, "id_a").groupBy("id_b").agg(F.min("c").alias("component"))
    return now.select(F.lit("a").alias("side"), F.col("id_a").cast("string").alias("id"), F.col("c").alias("component")).unionByName(by_b.select(F.lit("b").alias("side"), F.col("id_b").cast("string").alias("id"), "component"))


def best_hits(hits: DataFrame) -> DataFrame:
    """(pdb_id, max_identity, closest, n_chains): the best hit of each chain,
    then of each entity; the first seen (least ``ord``) wins ties."""
    rank = F.struct("fident", -F.col("ord"))
    chains = hits.groupBy("query").agg(F.max_by(F.struct("target", "fident", "ord"), rank).alias("h")).select("query", "h.*")
    entity = F.regexp_replace("query", "_[^_]*$", "")
    return chains.groupBy(entity.alias("pdb_id")).agg(
        F.max("fident").alias("max_identity"), F.max_by("target", rank).alias("closest_training_pdb"), F.count(F.lit(1)).alias("n_chains_checked")
    )
