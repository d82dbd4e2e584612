"""Scans, scalar functions, joins, aggregates and windows on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldspark.functions import scalar as S
from foldspark.operators import align, sequence
from foldspark.operators.metrics import top_and_bottom
from foldspark.plans.registry import query
from foldspark.sources import tables
from foldspark.sources.tables import nested, read

# ---- scans and filters ------------------------------------------------------


@query("scan_nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_nation(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("scan_orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_orders(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("filter_in", "SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY event_type LIMIT 2) AND value > 1")
def filter_in(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").where("value > 1").select("event_id", "event_type")
    kinds = read(spark, sf, "events").select("event_type").distinct().orderBy("event_type").limit(2)
    return events.join(kinds, "event_type", "left_semi").select("event_id", "event_type")


@query("str_norm", "SELECT c_custkey, upper(trim(c_mktsegment)) AS segment FROM customer WHERE length(trim(c_name)) >= 10")
def str_norm(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").where(F.length(F.trim("c_name")) >= 10).select("c_custkey", S.normal_id(F.col("c_mktsegment")).alias("segment"))


@query("distinct", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL")
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").where("p_brand IS NOT NULL").select("p_brand").distinct()


@query("part_prune", "SELECT doc_id, n_chars FROM documents WHERE source = 'src3'")
def part_prune(spark: SparkSession, sf: str) -> DataFrame:
    """One partition of the table as the partitioned sink writes it."""
    stored = tables.stored_by(read(spark, sf, "documents").select("doc_id", "n_chars", "source"), ["source"])
    return stored.where("source = 'src3'").select("doc_id", "n_chars")


@query(
    "text_fixed_width",
    "SELECT lang, count(*) AS n_docs, CAST(count(CASE WHEN trim(substr(text, 13, 4)) <> '' THEN 1 END) AS BIGINT) AS n_field, "
    "CAST(count(DISTINCT substr(text, 1, 6)) AS BIGINT) AS n_tags FROM documents GROUP BY lang",
)
def text_fixed_width(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count(F.when(F.trim(F.substring("text", 13, 4)) != "", 1)).alias("n_field"),
        F.count_distinct(F.substring("text", 1, 6)).alias("n_tags"),
    )


# ---- scalar functions -------------------------------------------------------


@query(
    "regex_extract",
    r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(substr(source, 4), '^\s*(-?\d+)', 1), '') AS INTEGER) AS n, "
    r"regexp_replace(source || '_' || lang, '_[^_]*$', '') AS entity FROM documents",
)
def regex_extract(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.select(
        "doc_id",
        S.leading_int(F.substring("source", 4, 100)).alias("n"),
        S.without_last_part(F.concat("source", F.lit("_"), "lang")).alias("entity"),
    )


@query("regex_explode", r"SELECT page_id, CAST(unnest(regexp_extract_all(url, '(\d+)', 1)) AS BIGINT) AS number FROM pages")
def regex_explode(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("url", F.lit(r"(\d+)"), F.lit(1))
    return read(spark, sf, "pages").select("page_id", F.explode(F.transform(found, lambda x: x.cast("long"))).alias("number"))


@query("json_get", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.4) AS k FROM events")
def json_get(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.4)).alias("k"))


@query(
    "map_lookup",
    "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE 'X' END AS code, "
    "CASE c_nationkey WHEN 1 THEN 2.5 WHEN 2 THEN 1.5 ELSE 0.0 END AS prop FROM customer",
)
def map_lookup(spark: SparkSession, sf: str) -> DataFrame:
    props = F.map_from_entries(F.filter(F.array(F.struct(F.lit("Drug Score"), F.when(F.col("c_nationkey") == 1, 2.5)), F.struct(F.lit("Score"), F.when(F.col("c_nationkey") == 2, 1.5))), lambda e: e["col2"].isNotNull()))
    return read(spark, sf, "customer").select(
        "c_custkey", S.mapped(F.col("c_mktsegment"), {"BUILDING": "B", "MACHINERY": "M"}, F.lit("X")).alias("code"), S.first_property(props, ["Druggability Score", "Drug Score", "Score"]).alias("prop")
    )


@query(
    "minmax_norm",
    "SELECT p_partkey, coalesce((p_retailprice - lo) / nullif(hi - lo, 0), 0.5) AS scaled "
    "FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)",
)
def minmax_norm(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    row = part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).first()
    return part.select("p_partkey", S.min_max(F.col("p_retailprice"), row["lo"], row["hi"]).alias("scaled"))


@query(
    "onehot_pivot",
    "SELECT l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS flag_A, "
    "CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS flag_N, "
    "CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS flag_R FROM lineitem GROUP BY l_linenumber",
)
def onehot_pivot(spark: SparkSession, sf: str) -> DataFrame:
    hot = read(spark, sf, "lineitem").select("l_linenumber", *S.one_hot(F.col("l_returnflag"), ["A", "N", "R"], "flag"))
    return hot.groupBy("l_linenumber").agg(*(F.sum(f"flag_{v}").alias(f"flag_{v}") for v in "ANR"))


@query("clamp", "SELECT p_partkey, least(p_retailprice / 1500.0, 1.0) AS rel, greatest(5, least(40, p_size)) AS size FROM part")
def clamp(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.least(F.col("p_retailprice") / F.lit(1500.0), F.lit(1.0)).alias("rel"), F.greatest(F.lit(5), F.least(F.lit(40), F.col("p_size"))).alias("size"))


@query("nan_fill", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS filled FROM customer")
def nan_fill(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("c_acctbal") < -500, F.lit(float("nan"))).when(F.col("c_acctbal") < 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal"))
    return read(spark, sf, "customer").select("c_custkey", S.clean(x).alias("filled"))


@query(
    "case_class",
    "SELECT doc_id, CASE WHEN quality = 1 AND n_chars >= 1500 THEN 'tp' WHEN quality = 1 THEN 'fn' WHEN n_chars >= 1500 THEN 'fp' WHEN toxic = 1 THEN 'act' ELSE 'base' END AS class, "
    "CAST(floor(CASE WHEN x <= 0.5 THEN 0.0 + (x - 0.0) / 0.5 * 200.0 ELSE 200.0 + (x - 0.5) / 0.5 * 55.0 END + 0.5) AS INTEGER) AS r "
    "FROM (SELECT *, greatest(0.0, least(1.0, n_chars / 3000.0)) AS x FROM documents JOIN labels USING (doc_id))",
)
def case_class(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", "n_chars").join(read(spark, sf, "labels"), "doc_id")
    red = S.ramp(F.col("n_chars") / F.lit(3000.0), [(0.0, (0, 0, 0)), (0.5, (200, 0, 0)), (1.0, (255, 0, 0))])[0]
    return d.select("doc_id", S.outcome(F.col("quality"), F.col("toxic"), F.col("n_chars") >= 1500).alias("class"), red.alias("r"))


@query("arr_slice", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[9] AS DOUBLE) AS other, len(embedding[9:16]) AS n FROM embeddings")
def arr_slice(spark: SparkSession, sf: str) -> DataFrame:
    head, tail = F.slice("embedding", 1, 8), F.slice("embedding", 9, 8)
    return read(spark, sf, "embeddings").select("vec_id", F.get(head, 0).cast("double").alias("first"), F.get(tail, 0).cast("double").alias("other"), F.size(tail).cast("long").alias("n"))


@query("arr_concat", "SELECT vec_id, len(list_concat(embedding[1:4], embedding[61:64])) AS n, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def arr_concat(spark: SparkSession, sf: str) -> DataFrame:
    both = F.concat(F.slice("embedding", 1, 4), F.slice("embedding", 61, 4))
    return read(spark, sf, "embeddings").select("vec_id", F.size(both).cast("long").alias("n"), F.element_at(both, -1).cast("double").alias("last"))


# ---- joins ------------------------------------------------------------------


@query(
    "align_zero_fill",
    "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def align_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return align.aligned(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "labels"), ["doc_id"], {"quality": 0, "toxic": 0}, order="quality")


@query("join_inner", "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return align.aligned_inner(read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"])


@query(
    "left_join_agg",
    "SELECT o_orderpriority, count(*) AS n_orders, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents "
    "FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1) "
    "ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
)
def left_join_agg(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    joined = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey", "left")
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))


@query(
    "semi_flag",
    "SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS INTEGER) AS has_closed, "
    "CAST(c_nationkey IN (SELECT s_nationkey FROM supplier) AS INTEGER) AS has_supplier FROM customer",
)
def semi_flag(spark: SparkSession, sf: str) -> DataFrame:
    closed = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    places = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    first = align.flagged(read(spark, sf, "customer").select("c_custkey", "c_nationkey"), closed, ["c_custkey"], "has_closed")
    return align.flagged(first, places, ["c_nationkey"], "has_supplier").select("c_custkey", "has_closed", "has_supplier")


@query("semi_anti", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1")
def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    there = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    flagged = align.flagged(read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), there, ["c_custkey"], "overlap")
    return flagged.where("overlap = 0").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("set_intersect", "SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where("n_chars > 1000").select("doc_id").intersect(read(spark, sf, "labels").select("doc_id"))


@query("union_sets", "SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n FROM orders GROUP BY 1")
def union_sets(spark: SparkSession, sf: str) -> DataFrame:
    sets = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))
    return sets.select("o_custkey", F.size("s").cast("long").alias("n"))


@query("union_all", "SELECT c_nationkey AS nation, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    both = read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))
    return both.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "multiway_assembly",
    "WITH o AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1), "
    "hit AS (SELECT c_custkey, c_nationkey, n_orders FROM customer LEFT JOIN o ON o_custkey = c_custkey), "
    "fit AS (SELECT c_nationkey, count(*) = count(n_orders) AS fits FROM hit GROUP BY 1) "
    "SELECT c_custkey, n_name, r_name, fits AS has_orders, CASE WHEN fits THEN n_orders ELSE 0 END AS n_orders "
    "FROM hit JOIN fit USING (c_nationkey) JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
)
def multiway_assembly(spark: SparkSession, sf: str) -> DataFrame:
    customers = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    counts = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders")).join(customers, "c_custkey")
    block = counts.select("c_custkey", "c_nationkey", "n_orders")
    built = align.assembled(customers, {"orders": (block, {"n_orders": 0})}, ["c_custkey"], "c_nationkey")
    nations = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return built.join(nations, "c_nationkey").select("c_custkey", "n_name", "r_name", "has_orders", "n_orders")


@query(
    "bridge_join",
    "WITH b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), n AS (SELECT count(*) AS n FROM supplier), "
    "g AS (SELECT l_partkey, min(l_suppkey) AS best, count(*) AS n_pockets FROM b JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) "
    "SELECT l_partkey, best, n_pockets, (n - best + 1) / CAST(greatest(n, 1) AS DOUBLE) AS rank FROM g, n",
)
def bridge_join(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    n = suppliers.count()
    joined = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().join(suppliers, "l_suppkey")
    best = joined.groupBy("l_partkey").agg(F.min("l_suppkey").alias("best"), F.count(F.lit(1)).alias("n_pockets"))
    return best.withColumn("rank", (F.lit(n) - F.col("best") + 1) / F.lit(float(max(n, 1))))


@query(
    "position_zip",
    "WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ord FROM conversations) "
    "SELECT conv_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(turn = ord AS INTEGER)) AS BIGINT) AS same FROM a GROUP BY 1",
)
def position_zip(spark: SparkSession, sf: str) -> DataFrame:
    placed = sequence.positions(read(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"])
    return placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("turn") == F.col("pos")).cast("long")).alias("same"))


# ---- aggregates -------------------------------------------------------------


@query(
    "group_stats",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, "
    "CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS discounted, "
    "floor(100.0 * sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / count(*) * 10 + 0.5) / 10 AS pct FROM lineitem GROUP BY 1, 2",
)
def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0))
    n = F.count(F.lit(1))
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        n.alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"), hit.alias("discounted"), S.half_up(F.lit(100.0) * hit / n, 1).alias("pct")
    )


@query(
    "global_totals",
    "SELECT count(*) AS n, CAST(sum(quality) AS BIGINT) AS pos, coalesce(100.0 * sum(quality) / nullif(count(*), 0), 0) AS pct FROM labels",
)
def global_totals(spark: SparkSession, sf: str) -> DataFrame:
    n, pos = F.count(F.lit(1)), F.sum("quality")
    return read(spark, sf, "labels").agg(n.alias("n"), pos.alias("pos"), F.coalesce(F.try_divide(F.lit(100.0) * pos, n.cast("double")), F.lit(0.0)).alias("pct"))


@query("first_by", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, min(ts) AS first_ts FROM events GROUP BY 1")
def first_by(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return align.first_of_each(rows, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("first_type"), F.col("ts").alias("first_ts"))


@query("argmax_group", "SELECT user_id, event_type, max(value) AS top, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY 1, 2")
def argmax_group(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.struct("value", -F.col("event_id"))
    return read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("top"), F.max_by("event_id", rank).alias("event_id"))


@query("dedup_first", "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY md5(text)")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id")
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("bool_and", "SELECT source, bool_and(doc_id IN (SELECT doc_id FROM labels)) AS all_labelled, bool_or(n_chars > 5000) AS any_long FROM documents GROUP BY 1")
def bool_and(spark: SparkSession, sf: str) -> DataFrame:
    d = align.flagged(read(spark, sf, "documents").select("doc_id", "source", "n_chars"), read(spark, sf, "labels"), ["doc_id"], "overlap")
    return d.groupBy("source").agg(F.bool_and(F.col("overlap") == 1).alias("all_labelled"), F.bool_or(F.col("n_chars") > 5000).alias("any_long"))


@query("coverage_gate", "SELECT lang, avg(CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END) > 0.5 AS covered FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def coverage_gate(spark: SparkSession, sf: str) -> DataFrame:
    d = align.flagged(read(spark, sf, "documents").select("doc_id", "lang"), read(spark, sf, "labels"), ["doc_id"], "has")
    return d.groupBy("lang").agg((F.avg("has") > 0.5).alias("covered"))


@query(
    "cluster_sizes",
    "SELECT min(n) AS smallest, max(n) AS largest, avg(n) AS mean, quantile_cont(n, 0.5) AS median, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons "
    "FROM (SELECT count(*) AS n FROM documents GROUP BY source)",
)
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = read(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("singletons"))


# ---- windows ----------------------------------------------------------------


@query(
    "seqpos",
    "SELECT conv_id, turn, role, row_number() OVER w - 1 AS pos, (row_number() OVER w - 1) / CAST(greatest(count(*) OVER (PARTITION BY conv_id) - 1, 1) AS DOUBLE) AS rel "
    "FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)",
)
def seqpos(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.positions(read(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role", F.col("pos").cast("long"), "rel")


@query(
    "lag_lead",
    "SELECT event_id, coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def lag_lead(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select("event_id", (F.coalesce(F.lead("value").over(w), F.col("value")) - F.coalesce(F.lag("value").over(w), F.col("value"))).alias("step"))


@query(
    "rolling_avg",
    "SELECT event_id, floor(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * 1e6 + 0.5) / 1e6 AS rolling FROM events",
)
def rolling_avg(spark: SparkSession, sf: str) -> DataFrame:
    out = sequence.rolling_mean(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value", 5)
    return out.select("event_id", S.half_up(F.col("rolling")).alias("rolling"))


@query(
    "sliding_mean",
    "WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events), "
    "w AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - 16) / 8.0)) AS BIGINT) + 1)) * 8 AS s FROM p), "
    "x AS (SELECT user_id, pos, value, s FROM w WHERE s <= pos AND pos < s + 16), m AS (SELECT user_id, s, avg(value) AS m FROM x GROUP BY 1, 2) "
    "SELECT user_id, pos, floor(avg(m) * 1e6 + 0.5) / 1e6 AS smoothed, count(*) AS n_windows FROM x JOIN m USING (user_id, s) GROUP BY 1, 2",
)
def sliding_mean(spark: SparkSession, sf: str) -> DataFrame:
    placed = sequence.positions(read(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    out = sequence.window_mean(placed, ["user_id"], "pos", "value", 16, 8)
    return out.select("user_id", F.col("pos").cast("long"), S.half_up(F.col("smoothed")).alias("smoothed"), "n_windows")


@query(
    "topk",
    "(SELECT c_custkey, c_acctbal, 'top' AS side FROM customer WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL "
    "(SELECT c_custkey, c_acctbal, 'bottom' AS side FROM customer WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal, c_custkey DESC LIMIT 5)",
)
def topk(spark: SparkSession, sf: str) -> DataFrame:
    return top_and_bottom(read(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 5)


# ---- nested export, resuming ------------------------------------------------


@query(
    "nested_export",
    "SELECT conv_id, len(list(role)) AS n_turns, string_agg(role || ':' || CAST(turn AS VARCHAR), '|' ORDER BY turn, role) AS turns FROM conversations GROUP BY conv_id",
)
def nested_export(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").withColumn("_o", F.struct("turn", "role"))
    docs = nested(rows, ["conv_id"], "_o", {"r": "role", "t": "turn"})
    text = F.array_join(F.transform("residues", lambda x: F.concat(x["r"], F.lit(":"), x["t"].cast("string"))), "|")
    return docs.select("conv_id", F.size("residues").cast("long").alias("n_turns"), text.alias("turns"))


@query("resume_antijoin", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    done = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("string").alias("version"))
    return align.not_done(read(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"], version="1")
