"""What the operators of this subpackage share: session set-up, cutting of
lineage in the shared folder, and small column helpers."""

from __future__ import annotations

import gc
import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the sense of every contract here: the space and \t to \r.
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Rows in one Arrow batch.  Texts are long, so batches are kept short; one
#: batch and its temporary arrays must fit beside the other worker of a core.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound Arrow batches."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read and write."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master.startswith("local[") or master == "local":  # one process: tests
        return tempfile.mkdtemp(prefix="checkpoints-")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder by Spark's own file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint: computed once, read back from the shared folder, so that a
    lost executor costs a re-read and not a recomputation."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def size_of_text(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words without keeping them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Narrow rows that one task takes in the rounds of an iterative operator.
ROWS_A_TASK = 200_000


def slim(df: DataFrame, n_rows: int) -> DataFrame:
    """As few partitions as that many narrow rows need, without a shuffle."""
    return df.coalesce(max(1, -(-n_rows // ROWS_A_TASK)))


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints of rounds that are
    over: it does so when the driver's references to them are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
