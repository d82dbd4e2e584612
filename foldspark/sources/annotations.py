"""Annotation tables: typed scans and the parsing of lists kept as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark import schema
from foldspark.functions.scalar import leading_int, normal_id
from foldspark.operators.align import first_of_each, flagged


def annotations(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schema.ANNOTATIONS).csv(path, header=True, escape='"', multiLine=True)
    # multi-line files are never split, so a row's place follows from its file
    return rows.withColumn("_at", F.struct(F.input_file_name().alias("file"), (F.monotonically_increasing_id() % (1 << 33)).alias("row")))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files; the entity comes from the file name, chain ids stay text."""
    rows = spark.read.schema(schema.LABELS).csv(path, header=True, recursiveFileLookup=True)
    return rows.withColumn("pdb_id", F.regexp_extract(F.input_file_name(), r"([^/]+)_labels\.csv$", 1))


def tsv(spark: SparkSession, path: str, kind) -> DataFrame:
    """Tab-separated pairs or hits; short lines are dropped."""
    return spark.read.schema(kind).csv(path, sep="\t", mode="DROPMALFORMED").where(F.col(kind.fieldNames()[-1]).isNotNull())


def residue_keys(text: Column, *, signed: bool = True) -> Column:
    """``['A-PHE-157', 'B-9']`` to an array of (chain, resnum).

    Parts are separated by dashes: the chain is the first, the number the last
    (an insertion code behind it is dropped).  A doubled dash is a minus sign;
    with ``signed=False`` it is lost, as a plain split on dashes loses it.
    """
    items = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("'([^']+)'"), F.lit(1))
    pattern = r"-(-?\d+)[A-Za-z]?$" if signed else r"-(\d+)[A-Za-z]?$"
    keyed = F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"^([^-]*)-", 1).alias("chain"), F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).try_cast("int").alias("resnum")))
    return F.array_distinct(F.filter(keyed, lambda k: k["resnum"].isNotNull()))


def residue_numbers(text: Column) -> Column:
    """``[63, 94]`` to its integers."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(-?\d+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda x: x.isNotNull()))


def entities(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Allosteric keys (pdb_id, chain, resnum), active numbers (pdb_id,
    resnum), and the metadata of each entity's first row, over all its cases."""
    at = F.col("_at") if "_at" in rows.columns else F.monotonically_increasing_id()
    ids = rows.withColumns({"pdb_id": normal_id(F.col("allosteric_pdb")), "_at": at}).where("pdb_id is not null")
    sites = ids.select("pdb_id", F.inline(residue_keys(F.col("allosteric_site_residue")))).distinct()
    active = ids.select("pdb_id", F.explode(residue_numbers(F.col("active_site_residue"))).alias("resnum")).distinct()
    meta = first_of_each(ids.select("pdb_id", "_at", "sequence", "organism", "target_gene"), ["pdb_id"], ["_at"]).drop("_at")
    return sites, active, meta


def labelled(residue_rows: DataFrame, sites: DataFrame, active: DataFrame, *, active_keys: tuple[str, ...] = ("pdb_id", "resnum")) -> DataFrame:
    """Residues with both flags.  Active sites match on any chain in training;
    pass (pdb_id, chain, resnum) for tables that know the chain."""
    first = flagged(residue_rows, sites, ["pdb_id", "chain", "resnum"], "is_allosteric")
    return flagged(first, active, list(active_keys), "is_active_site")


def site_lines(spark: SparkSession, path: str) -> DataFrame:
    """``LABEL Res Chain Resnum`` lines; others are skipped."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(part, 0).alias("label"), F.get(part, 2).alias("chain"), leading_int(F.get(part, 3)).alias("resnum"))
    return rows.where("chain is not null and resnum is not null").distinct()


def discovered(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, family, pdb_id) of files two levels down, from a listing only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.select("path", "length", F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("family"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("pdb_id"))
