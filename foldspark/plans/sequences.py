"""Sequence clustering and search queries: texts as sequences of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.operators import homology, split
from foldspark.plans.registry import query
from foldspark.sources.tables import read


@query("sequence_clusters")
def sequence_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by 30 % identity over 80 % of both, longest first."""
    return homology.sequence_clusters(homology.words(read(spark, sf, "documents"), "doc_id", "text")).select(F.col("id").alias("doc_id"), "cluster")


@query("homology_search")
def homology_search(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items aligned with documents over 80 % of the item."""
    items, docs = homology.words(read(spark, sf, "benchmark"), "item_id", "text"), homology.words(read(spark, sf, "documents"), "doc_id", "text")
    found = homology.search(items, docs, cover="query")
    return found.select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), "score", "identity", "cover_a")


@query("homology_best")
def homology_best(spark: SparkSession, sf: str) -> DataFrame:
    """Each item's closest document."""
    hits = homology_search(spark, sf)
    name = F.concat(F.col("item_id").cast("string"), F.lit("_A"))
    return split.best_hits(hits.select(name.alias("query"), F.col("doc_id").alias("target"), F.col("identity").alias("fident"), F.col("doc_id").alias("ord")))
