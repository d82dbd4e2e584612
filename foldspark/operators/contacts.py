"""Contact energies and frustration from side-chain contacts.

The residue-pair energy table is a parameter (``schema.ENERGY`` rows: a, b,
energy, both orders); ``energy_table`` reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark import schema
from foldspark.operators.spatial import both_ways, pairs_within

CONTACT_RADIUS, MIN_SEPARATION = 6.5, 3
HIGHLY, MINIMALLY = -1.0, 0.78


def energy_table(spark: SparkSession, path: str) -> DataFrame:
    """A published pair-energy matrix as CSV rows a, b, energy."""
    return spark.read.schema(schema.ENERGY).csv(path, header=True)


def side_chain_centre(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of side-chain atoms; the CA for glycine or without any; residues
    with neither are left out.  Of an atom's alternate locations the one of
    greatest occupancy counts, the first of equals, then the least position."""
    ranks = [F.coalesce("occupancy", F.lit(0.0))] if "occupancy" in atoms.columns else []
    ranks += [-F.col("ord")] if "ord" in atoms.columns else []
    one = atoms.groupBy(*dict.fromkeys([*keys, "resname", "atom"])).agg(F.max_by(F.struct("x", "y", "z"), F.struct(*ranks, *(-F.col(c) for c in "xyz"))).alias("at")).select("*", "at.*")
    side = ~F.col("atom").isin("N", "CA", "C", "O", "OXT") & ~F.col("atom").startswith("H") & (F.col("resname") != "GLY")
    means = one.groupBy(*keys).agg(*(f for c in "xyz" for f in (F.avg(F.when(side, F.col(c))).alias(f"_{c}"), F.max(F.when(F.col("atom") == "CA", F.col(c))).alias(f"_ca_{c}"))))
    return means.select(*keys, *(F.coalesce(f"_{c}", f"_ca_{c}").alias(c) for c in "xyz")).where("x is not null")


def contacts(residues: DataFrame, entity: str, ident: str, radius: float = CONTACT_RADIUS) -> DataFrame:
    """Pairs within the radius (inclusive), unless near in the same chain."""
    near = pairs_within(residues, entity, ident, ["x", "y", "z"], radius, inclusive=True, carry=["chain", "resnum", "resname"])
    close = (F.col("a.chain") == F.col("b.chain")) & (F.abs(F.col("a.resnum") - F.col("b.resnum")) < MIN_SEPARATION)
    return near.where(~close)


def with_energy(pairs: DataFrame, energies: DataFrame, label: str, default: float = 0.0) -> DataFrame:
    """``energy`` of each pair by its two labels.  The table is one row per
    ordered pair of residue kinds; Spark broadcasts it by its own size check."""
    table = energies.select(F.col("a").alias("_ka"), F.col("b").alias("_kb"), "energy")
    keyed = pairs.withColumns({"_ka": F.col(f"a.{label}"), "_kb": F.col(f"b.{label}")})
    return keyed.join(table, ["_ka", "_kb"], "left").withColumn("energy", F.coalesce("energy", F.lit(default))).drop("_ka", "_kb")


def energy_by_residue(pairs: DataFrame, entity: str) -> DataFrame:
    """Sum and mean of the energies of a residue's contacts."""
    ends = pairs.select(entity, F.explode(F.array("i", "j")).alias("i"), "energy")
    return ends.groupBy(entity, "i").agg(F.sum("energy").alias("energy_sum"), F.avg("energy").alias("energy_mean"), F.count(F.lit(1)).alias("n_contacts"))


def frustration_index(energies: DataFrame) -> DataFrame:
    """(a, b, energy, fi): energies against the table's mean, in units of its
    population deviation; unfavourable contacts are negative."""
    stats = energies.agg(F.avg("energy").alias("_m"), F.stddev_pop("energy").alias("_s"))
    keyed = energies.withColumn("_one", F.lit(1)).join(stats.withColumn("_one", F.lit(1)), "_one")
    return keyed.withColumn("fi", F.try_divide(F.col("_m") - F.col("energy"), F.col("_s"))).drop("_one", "_m", "_s")


def frustration_by_residue(pairs: DataFrame, entity: str, fi: Column) -> DataFrame:
    """Shares of highly, neutrally and minimally frustrated contacts, and the mean index."""
    ends = pairs.select(entity, F.explode(F.array("i", "j")).alias("i"), fi.alias("fi"))
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    high, low = F.col("fi") < HIGHLY, F.col("fi") > MINIMALLY
    return ends.groupBy(entity, "i").agg(share(high).alias("high"), share(~high & ~low).alias("neutral"), share(low).alias("minimal"), F.avg("fi").alias("mean_fi"))


def flows(edges: DataFrame, entity: str, value: Column) -> DataFrame:
    """(entity, i, flow_out, flow_in, net): row and column sums of a directed
    table, and their difference over the entity's greatest."""
    v = edges.select(entity, "i", "j", value.alias("_v"))
    ends = v.select(entity, F.inline(F.array(F.struct(F.col("i"), F.col("_v").alias("o"), F.lit(0.0).alias("n")), F.struct(F.col("j").alias("i"), F.lit(0.0).alias("o"), F.col("_v").alias("n")))))
    sums = ends.groupBy(entity, "i").agg(F.sum("o").alias("flow_out"), F.sum("n").alias("flow_in"))
    top = sums.groupBy(entity).agg(F.max(F.abs(F.col("flow_out") - F.col("flow_in"))).alias("_top"))
    return sums.join(top, entity).withColumn("net", F.coalesce(F.try_divide(F.col("flow_out") - F.col("flow_in"), F.col("_top")), F.lit(0.0))).drop("_top")


__all__ = ["both_ways", "contacts", "energy_by_residue", "energy_table", "flows", "frustration_by_residue", "frustration_index", "side_chain_centre", "with_energy"]
