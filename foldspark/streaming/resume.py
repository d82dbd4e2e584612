"""Stages over newly arrived files: batches that are published once and whole.

A batch is written to a folder of its own beside the output and becomes part of
it by one rename, to ``version=.../stream=.../batch=...``.  That folder is the
commit: a batch that died before it is written again, and what it left is never
read; a batch that died after it, before the stream noted it, is found done.
(The rename is atomic on HDFS and local file systems; on object stores it is
as safe as their committer.)
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from foldspark.operators.align import not_done


def path_of(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = path_of(spark, path)
    return files.exists(where)


def publish(spark: SparkSession, written: str, target: str) -> None:
    """Makes a finished folder the target, by one rename."""
    source, files = path_of(spark, written)
    goal, _ = path_of(spark, target)
    files.mkdirs(goal.getParent())
    if not files.rename(source, goal):
        raise OSError(f"could not publish {target}")


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What a stream is called in its checkpoint; a new checkpoint is another stream."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def published(spark: SparkSession, output: str, version: str, but: str | None = None) -> DataFrame | None:
    """All published rows of a version (of other streams than ``but``), if there are any."""
    root = f"{output}/version={version}"
    if not exists(spark, root):
        return None
    where, files = path_of(spark, root)
    streams = [s.getPath().toString() for s in files.listStatus(where) if s.getPath().getName() != f"stream={but}"]
    return spark.read.option("basePath", root).parquet(*streams) if streams else None


def staged(source: DataFrame, stage: Callable[[DataFrame], DataFrame], output: str, keys: Sequence[str], checkpoint: str, version: str = "1") -> StreamingQuery:
    """Runs ``stage`` on each micro-batch and publishes its result under
    ``version``, once for each key.  Keys of this stream are in its state, so
    its own output is never read again; only what other streams published is,
    its keys alone."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        own = stream_id(spark, checkpoint)
        target = f"{output}/version={version}/stream={own}/batch={number}"
        if exists(spark, target):
            rows.write.format("noop").mode("overwrite").save()  # the stream's state must still move on
            return
        others = published(spark, output, version, but=own)
        fresh = rows if others is None else not_done(rows, others, keys)
        written = f"{output}/_written/{uuid.uuid4().hex}"
        stage(fresh).write.parquet(written)
        publish(spark, written, target)

    once = source.dropDuplicates(list(keys))
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving(spark: SparkSession, folder: str, kind: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def resumed(spark: SparkSession, folder: str, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], first: DataFrame) -> DataFrame:
    """``first`` through all stages, each published under its number and name;
    a run that died goes on after the last stage it published."""
    rows = first
    for k, (name, stage) in enumerate(stages):
        target = f"{folder}/{k}-{re.sub('[^A-Za-z0-9]+', '_', name)}"
        if not exists(spark, target):
            written = f"{folder}/_written/{uuid.uuid4().hex}"
            stage(rows).write.parquet(written)
            publish(spark, written, target)
        rows = spark.read.parquet(target)
    return rows
