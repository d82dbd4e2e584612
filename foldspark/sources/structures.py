"""Structure files: fixed-width text to atoms and residues, FASTA out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldspark.functions.scalar import is_residue, one_letter, standard_residue

# Columns of the published text format (first, length), 1-based.
FIELDS = {"atom": (13, 4), "altloc": (17, 1), "resname": (18, 3), "chain": (22, 1), "resnum": (23, 4), "icode": (27, 1), "x": (31, 8), "y": (39, 8), "z": (47, 8), "occupancy": (55, 6), "bfactor": (61, 6)}
NUMBERS = {"resnum": "int", "x": "double", "y": "double", "z": "double", "occupancy": "double", "bfactor": "double"}


def entity_of(path: Column) -> Column:
    """File name without folder and ending, in upper case."""
    return F.upper(F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(pdb_id, ord, line): each file is one row until its lines are numbered,
    so the order within a file is certain."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(entity_of(F.input_file_name()).alias("pdb_id"), "value")
    return files.select("pdb_id", F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))


def parsed_atoms(rows: DataFrame) -> DataFrame:
    """(pdb_id, line) with ``ord`` to the atoms of the first model."""
    ends = rows.where(F.col("line").startswith("ENDMDL")).groupBy("pdb_id").agg(F.min("ord").alias("_end"))
    kept = rows.where(F.col("line").rlike("^(ATOM|HETATM)")).join(ends, "pdb_id", "left").where(F.col("_end").isNull() | (F.col("ord") < F.col("_end")))
    cut = lambda n: F.trim(F.substring("line", *FIELDS[n]))
    typed = {n: cut(n).try_cast(NUMBERS[n]) if n in NUMBERS else cut(n) for n in FIELDS}
    return kept.select("pdb_id", "ord", F.when(F.col("line").startswith("HETATM"), "H").otherwise("").alias("het"), *(c.alias(n) for n, c in typed.items())).where("resnum is not null")


def atoms(spark: SparkSession, path: str) -> DataFrame:
    return parsed_atoms(lines(spark, path))


def one_location(atom_rows: DataFrame) -> DataFrame:
    """Of an atom's alternate locations the one of greatest occupancy, the
    first of equals; an aggregate, so that it is partly done in each task."""
    keys = ["pdb_id", "chain", "resnum", "icode", "resname", "atom"]
    rest = [c for c in atom_rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce("occupancy", F.lit(0.0)), -F.col("ord")))
    return atom_rows.groupBy(*keys).agg(best.alias("_a")).select(*keys, "_a.*").select(*atom_rows.columns)


def residues(atom_rows: DataFrame) -> DataFrame:
    """One row a residue (insertion codes stay apart), hetero stand-ins mapped,
    with mean B-factor and the position of its CA atom, else the atoms' mean."""
    known = one_location(atom_rows.where(is_residue(F.col("het"), F.col("resname"))).withColumn("resname", standard_residue(F.col("resname"))))
    ca = F.min_by(F.struct("x", "y", "z"), F.when(F.col("atom") == "CA", F.col("ord"))).alias("_ca")
    grouped = known.groupBy("pdb_id", "chain", "resnum", "icode", "resname").agg(F.min("ord").alias("_first"), F.avg("bfactor").alias("bfactor"), ca, *(F.avg(c).alias(f"_{c}") for c in "xyz"))
    grouped = grouped.select("pdb_id", "chain", "resnum", "icode", "resname", "_first", "bfactor", *(F.coalesce(f"_ca.{c}", f"_{c}", F.lit(99999.0)).alias(c) for c in "xyz"))
    w = Window.partitionBy("pdb_id").orderBy("_first")
    return grouped.withColumn("ord", F.row_number().over(w) - 1).drop("_first")


def sizes(rows: DataFrame) -> DataFrame:
    """(pdb_id, n): CA atoms, a cheap estimate of size from the raw lines."""
    ca = F.col("line").startswith("ATOM") & (F.trim(F.substring("line", *FIELDS["atom"])) == "CA")
    return rows.groupBy("pdb_id").agg(F.count(F.when(ca, 1)).alias("n"))


def sequences(residue_rows: DataFrame, keys: list[str], shortest: int = 10) -> DataFrame:
    """(keys, sequence) from residues in order; short ones are left out."""
    from foldspark.operators.sequence import chain_text

    lettered = residue_rows.withColumn("_letter", one_letter(F.col("resname")))
    return chain_text(lettered, keys, "ord", "_letter").where(F.length("sequence") >= shortest)


def fasta(df: DataFrame, name: str, sequence: str) -> DataFrame:
    """Rows for ``write.text``."""
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(sequence)).alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, lineSep="\n>")
    record = F.split(F.regexp_replace("value", "^>", ""), "\r?\n", 2)
    return whole.where(F.length("value") > 0).select(F.split(F.get(record, 0), r"\s").getItem(0).alias("name"), F.regexp_replace(F.coalesce(F.get(record, 1), F.lit("")), r"\s", "").alias("sequence"))
