"""From raw documents to packed training sequences.

Each stage takes what the one before it kept, and all but the last return the
columns of ``documents``.  ``n_chars`` follows the text.

Defined cases: a null or empty text fails the quality rules; texts that reach a
later stage without words pass line dedup as they are, link with nothing, are
not taken by the mixture (it has no word of theirs to take), and pack as an end
token alone.  A null source is a host and a source of its own.  Rows that repeat
are judged row by row, until the near-copy stage keeps one of them.  Rows with a
null id stay documents of their own, of which equal texts keep one.  Empty
tables give empty tables, and columns named like computed ones stay as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm._common import prepare, remove, shared_folder
from foldspark.llm.line_dedup import line_dedup
from foldspark.llm.mixing import mixture as mixed
from foldspark.llm.ngram_join import one_of_each
from foldspark.llm.packing import pack
from foldspark.llm.quality_rules import quality_rules
from foldspark.llm.queries import vocabulary


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail their own rules, or whose host fails, go."""
    prepare(spark)
    return quality_rules(docs).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters in five documents stay in one."""
    prepare(spark)
    return measured(line_dedup(docs), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by five-word shingles at 0.8 or more, one stays."""
    prepare(spark)
    return one_of_each(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    prepare(spark)
    return measured(mixed(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixture),
    ("packing", packed),
]

#: Packing depends on a tokenizer, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each written and read again."""
    prepare(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # written whole, so nothing reads the table before any more
            remove(spark, f"{folder}/{k - 1}")
    return docs
