"""Queries of the data set's assembly and of its evaluation.

Documents stand for residues and their sources for entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark import schema
from foldspark.functions.scalar import half_up
from foldspark.operators import assembly, evaluation, metrics, placement
from foldspark.plans.registry import query
from foldspark.plans.science import _f6, _ranking_sql
from foldspark.sources.tables import read

#: By block: a filter that leaves rows of some entities out, and how many of
#: its columns the block has.
PRESENT = {
    "structural": ("true", 64),
    "graph": ("source <> 'src3'", 11),
    "pocket": ("source <> 'src1' OR doc_id % 2 = 0", 8),
    "index": ("true", 6),
    "entropy": ("source IN ('src0', 'src2', 'src4', 'src6', 'src8')", 3),
    "response": ("source <> 'src5' OR n_chars > 500", 3),
    "energy": ("source <> 'src7'", 2),
    "frustration": ("true", 4),
}
NAMES = list(schema.BLOCKS)
EVALUATED = ["structural", "graph", "pocket", "index", *NAMES[4:]]


def value(name: str, k: int) -> str:
    """The k-th column of a block, in either engine's SQL."""
    return f"CAST((doc_id * {2 * NAMES.index(name) + 3} + {k * 7}) % 101 AS DOUBLE)"


def blocks(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    docs = read(spark, sf, "documents").select("doc_id", "source", "n_chars")
    made = {n: docs.where(cond).selectExpr("doc_id", "source", *(f"{value(n, k)} AS {n}_{k}" for k in range(width))) for n, (cond, width) in PRESENT.items()}
    made["graph"] = made["graph"].withColumn("graph_10", assembly.elastic_constant())
    return docs.select("doc_id", "source"), made


def _assembly_sql(order: list[str]) -> str:
    fits = ", ".join(f"count(*) = count(CASE WHEN {PRESENT[n][0]} THEN 1 END) AS f_{n}" for n in NAMES)
    shown = []
    for n in order:
        shown.append(f"f_{n} AS has_{n}")
        for k in range(schema.BLOCKS[n]):
            own = "0.0" if k >= PRESENT[n][1] or (n, k) == ("graph", 10) else value(n, k)
            shown.append(f"CASE WHEN f_{n} THEN {own} ELSE 0.0 END::DOUBLE AS {n}_{k}")
    return f"WITH f AS (SELECT source, {fits} FROM documents GROUP BY source) SELECT doc_id, source, {', '.join(shown)} FROM documents JOIN f USING (source)"


@query("dataset_assembly", _assembly_sql(NAMES))
def dataset_assembly(spark: SparkSession, sf: str) -> DataFrame:
    base, made = blocks(spark, sf)
    return assembly.assemble(base, made, ["doc_id"], "source")


@query("evaluation_assembly", _assembly_sql(EVALUATED))
def evaluation_assembly(spark: SparkSession, sf: str) -> DataFrame:
    base, made = blocks(spark, sf)
    return assembly.assemble(base, made, ["doc_id"], "source", EVALUATED)


_HAS = " + ".join(f"CAST(has_{n} AS INTEGER)" for n in NAMES)


@query("covered_entities", f"WITH a AS ({_assembly_sql(NAMES)}), g AS (SELECT source, min({_HAS}) / 8.0 AS share FROM a GROUP BY source) SELECT doc_id, source FROM a JOIN g USING (source) WHERE share >= 0.9")
def covered_entities(spark: SparkSession, sf: str) -> DataFrame:
    base, made = blocks(spark, sf)
    return assembly.covered(assembly.assemble(base, made, ["doc_id"], "source"), "source", 0.9).select("doc_id", "source")


@query("library_frustration", "SELECT l_orderkey, l_linenumber, l_discount AS frustration_0, 1 - l_discount - l_tax AS frustration_1, l_tax AS frustration_2, -2.0::DOUBLE * l_discount + 1.5::DOUBLE * l_tax AS frustration_3 FROM lineitem")
def library_frustration(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem")
    high, low = F.col("l_discount"), F.col("l_tax")
    return rows.select("l_orderkey", "l_linenumber", *assembly.library_frustration(high, 1 - high - low, low))


# ---- evaluation -------------------------------------------------------------

LIMITS = [1.01, 0.7, 0.5, 0.3]


def predictions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Scored rows by source, and a homology table that lacks some sources and
    repeats others."""
    rows = read(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("s")).join(read(spark, sf, "labels").select("doc_id", F.col("quality").alias("t")), "doc_id")
    hits = read(spark, sf, "part").select(F.concat(F.lit("src"), F.col("p_size").cast("string")).alias("source"), (F.col("p_size") * 7 % 50 / 50.0).alias("max_identity"))
    return rows, hits


_EVALUATED_SQL = (
    "WITH h AS (SELECT 'src' || p_size AS source, max((p_size * 7 % 50) / 50.0::DOUBLE) AS identity FROM part GROUP BY 1), "
    "src AS (SELECT doc_id, source, CAST(n_chars AS DOUBLE) AS s, quality AS t, coalesce(identity, 0.0) AS identity FROM documents JOIN labels USING (doc_id) LEFT JOIN h USING (source)), "
    "x AS (SELECT stratum, s, t FROM src JOIN (SELECT unnest([1.01, 0.7, 0.5, 0.3]::DOUBLE[]) AS stratum) ON identity < stratum)"
)


@query(
    "evaluation_report",
    f"{_EVALUATED_SQL}, {_ranking_sql('stratum', 'x')} SELECT stratum, n, positives, {_f6('auroc')} AS auroc, {_f6('ap')} AS ap, "
    f"{_f6('positives / CAST(n AS DOUBLE)')} AS baseline, {_f6('ap / (positives / CAST(n AS DOUBLE))')} AS lift FROM m",
)
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    rows, homology = predictions(spark, sf)
    out = evaluation.report(rows, homology, "source", "s", "t", LIMITS)
    return out.select("stratum", "n", "positives", *(half_up(F.col(c)).alias(c) for c in ("auroc", "ap", "baseline", "lift")))


@query(
    "threshold_counts",
    " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(CASE WHEN l_discount < {t} THEN 1 END) AS below, count(CASE WHEN l_discount >= {t} THEN 1 END) AS at_least FROM lineitem" for t in (0.03, 0.05, 0.07)),
)
def threshold_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.counts_by_threshold(read(spark, sf, "lineitem"), "l_discount", [0.03, 0.05, 0.07])


@query(
    "ratios_or_null",
    "WITH k AS (SELECT source, CAST(sum(CASE WHEN quality = 1 AND n_chars >= 9000 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN quality = 0 AND n_chars >= 9000 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, "
    "CAST(sum(CASE WHEN quality = 1 AND n_chars < 9000 THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY source) "
    f"SELECT source, {_f6('tp / nullif(tp + fp, 0)')} AS precision, {_f6('tp / nullif(tp + fn, 0)')} AS recall, {_f6('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM k",
)
def ratios_or_null(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select("doc_id", "source", "n_chars").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    table = metrics.confusion(rows, ["source"], "quality", F.col("n_chars") >= 9000)
    made = metrics.threshold_scores(*(F.col(c) for c in ("tn", "fp", "fn", "tp")), undefined=None)
    return table.select("source", *(half_up(made[n]).alias(n) for n in ("precision", "recall", "f1")))


@query(
    "status_counts",
    "SELECT lang, CASE WHEN text IS NULL OR length(text) = 0 THEN 'skipped' WHEN n_chars > 10000 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY ALL",
)
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("text").isNull() | (F.length("text") == 0), "skipped").when(F.col("n_chars") > 10000, "failed").otherwise("ok")
    return evaluation.status_counts(read(spark, sf, "documents").select("lang", status.alias("status")), ["lang"])


_SIDES = "a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant')"


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf, "conversations")
    answers = rows.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answer"), F.col("text").alias("reply"))
    zipped = evaluation.zipped(rows.where("role = 'user'").select("conv_id", "turn", "text"), answers, "conv_id", ["turn", "text"], ["answer", "reply"], ["answer", "reply"])
    return zipped


@query("zip_checked", f"WITH {_SIDES} SELECT a.conv_id AS conv_id, a.pos AS pos, a.turn AS turn, b.turn AS answer FROM a JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos AND a.n = b.n")
def zip_checked(spark: SparkSession, sf: str) -> DataFrame:
    return sides(spark, sf)[0].select("conv_id", F.col("pos").cast("long").alias("pos"), "turn", "answer")


@query(
    "zip_status",
    "WITH s AS (SELECT conv_id, count(CASE WHEN role = 'user' THEN 1 END) AS n_a, count(CASE WHEN role = 'assistant' THEN 1 END) AS n_b FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1) "
    "SELECT conv_id, n_a, n_b, CASE WHEN n_a = n_b THEN 'ok' ELSE 'length mismatch' END AS status FROM s",
)
def zip_status(spark: SparkSession, sf: str) -> DataFrame:
    return sides(spark, sf)[1]


@query(
    "largest_first",
    "WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) - 1 AS place FROM s) "
    "SELECT user_id, n, place, CAST(least(place % 12, 11 - place % 12) AS INTEGER) AS worker FROM r",
)
def largest_first(spark: SparkSession, sf: str) -> DataFrame:
    sizes = read(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return evaluation.largest_first(sizes, "user_id", "n", 6).select("user_id", "n", "place", "worker")


@query("size_placement")
def size_placement(spark: SparkSession, sf: str) -> DataFrame:
    """Users to six workers by the number of their events, longest first."""
    sizes = read(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return placement.placed(sizes, "user_id", F.col("n"), 6)


@query(
    "manifest_lines",
    "SELECT to_json({'conv_id': conv_id, 'n_turns': n_turns, 'first_role': first_role}) AS value FROM (SELECT conv_id, count(*) AS n_turns, arg_min(role, (turn, role)) AS first_role FROM conversations GROUP BY conv_id)",
)
def manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    per = read(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.min_by("role", F.struct("turn", "role")).alias("first_role"))
    return evaluation.manifest(per, {n: F.col(n) for n in ("conv_id", "n_turns", "first_role")})
