"""Per-entity documents and their manifest, and the log of a stage."""

from __future__ import annotations

import logging
import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESIDUE = "struct<c: string, n: int, r: string, t: int, a: int, p: double>"
DOCUMENT = f"pdb_id string, n_residues int, n_true_allosteric int, n_active_site int, residues array<{RESIDUE}>"
MANIFEST = "threshold double, proteins array<struct<pdb_id: string, category: string, family: string, title: string, blurb: string, n_residues: int, n_true_allosteric: int>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row an entity; a document is one JSON value a file, on any lines."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True, recursiveFileLookup=True).where("residues is not null")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(threshold, pdb_id, category, family, ...), one row an entity."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select("threshold", F.inline("proteins"))


def residue_rows(documents: DataFrame) -> DataFrame:
    """(pdb_id, ord, chain, resnum, resname, y_true, is_active_site, y_prob)."""
    rows = documents.select("pdb_id", F.posexplode("residues").alias("ord", "_r"))
    named = {"c": "chain", "n": "resnum", "r": "resname", "t": "y_true", "a": "is_active_site", "p": "y_prob"}
    return rows.select("pdb_id", "ord", *(F.col(f"_r.{k}").alias(v) for k, v in named.items()))


def write_documents(rows: DataFrame, path: str) -> None:
    """(pdb_id, ord, ...) as one compact JSON document an entity, and a
    manifest line for each; scores have four digits."""
    named = {"c": "chain", "n": "resnum", "r": "resname", "t": "y_true", "a": "is_active_site"}
    residue = F.struct("ord", F.struct(*(F.col(v).alias(k) for k, v in named.items()), F.round("y_prob", 4).alias("p")).alias("r"))
    whole = rows.groupBy("pdb_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_residues"),
        F.sum("y_true").cast("int").alias("n_true_allosteric"),
        F.sum("is_active_site").cast("int").alias("n_active_site"),
        F.transform(F.array_sort(F.collect_list(residue)), lambda x: x["r"]).alias("residues"),
    )
    whole.select("pdb_id", F.to_json(F.struct(*whole.columns)).alias("value")).write.mode("overwrite").partitionBy("pdb_id").text(f"{path}/documents")
    whole.drop("residues").select(F.to_json(F.struct("pdb_id", "n_residues", "n_true_allosteric")).alias("value")).repartition(1).write.mode("overwrite").text(f"{path}/manifest")


@contextmanager
def logged(path: str, name: str = "foldspark") -> Iterator[logging.Logger]:
    """A logger that writes to the console and to a file, for one stage."""
    log = logging.getLogger(name)
    handlers = [logging.StreamHandler(sys.stdout), logging.FileHandler(path, encoding="utf-8")]
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(handler)
    before = log.level
    log.setLevel(logging.INFO)
    try:
        yield log
    finally:
        log.setLevel(before)
        for handler in handlers:
            log.removeHandler(handler)
            handler.flush()
        handlers[1].close()
