"""Line dedup.

Every text is exploded into lines; a line's key is the line without blanks at
its ends and with A-Z lower-cased.  Keys are hashed to 128 bits, the distinct
documents of each hash are counted, and keys of at least ``min_chars`` code
points in at least ``min_docs`` documents lose all their lines except in the
largest document id holding it.  The surviving lines are put together again
by position.

Defined cases: a null or empty text has one empty line and becomes the empty
text; rows that share an id are one document for counting, and each keeps its
own text; a row with a null id is never counted and loses nothing; an empty
table gives an empty table; input columns named like computed ones are
replaced.

Shape at scale: lines travel as (id, position, two longs), never as text, and
are exploded and hashed once, into a written table.  Distinct documents are
counted in two exchanges, by (line, document) and then by line, so that a line
held by a third of all documents is one row a task in the second.  Frequent
lines are counted, and broadcast up to ``BROADCAST_LINES`` of them (32 bytes
each); more are joined plainly, which AQE splits for a hot line.  Texts are
shuffled once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import BLANKS, cut

BROADCAST_LINES = 200_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text_col`` reduced, and ``n_lines``, ``n_dropped``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    print_of = F.xxhash64(text)
    lines = docs.select(
        F.col(id_col).alias("__ld_doc"), print_of.alias("__ld_print"), F.posexplode(F.split(text, "\n", -1)).alias("__ld_pos", "__ld_line")
    ).where(F.col("__ld_doc").isNotNull() & (F.length("__ld_line") >= min_chars))
    keyed = cut(
        lines.withColumn("__ld_key", line_key(F.col("__ld_line")))
        .where(F.length("__ld_key") >= min_chars)
        # a leading constant makes the second hash independent of the first
        .select("__ld_doc", "__ld_print", "__ld_pos", F.xxhash64("__ld_key").alias("__ld_h1"), F.xxhash64(F.lit(1), "__ld_key").alias("__ld_h2"))
    )
    frequent = cut(
        keyed.select("__ld_h1", "__ld_h2", "__ld_doc")
        .distinct()
        .groupBy("__ld_h1", "__ld_h2")
        .agg(F.count(F.lit(1)).alias("__ld_n"), F.max("__ld_doc").alias("__ld_holder"))
        .where(F.col("__ld_n") >= min_docs)
        .drop("__ld_n")
    )
    few = dict(docs.dtypes)[id_col] not in ("string", "binary") and frequent.count() <= BROADCAST_LINES
    dropped = (
        keyed.join(F.broadcast(frequent) if few else frequent, ["__ld_h1", "__ld_h2"])
        .where(F.col("__ld_doc") != F.col("__ld_holder"))
        .groupBy("__ld_doc", "__ld_print")
        .agg(F.collect_set("__ld_pos").alias("__ld_dropped"))
        .hint("shuffle_hash")
    )
    left = docs.withColumns({"__ld_doc": F.col(id_col), "__ld_print": print_of})
    joined = left.join(dropped, ["__ld_doc", "__ld_print"], "left").drop("__ld_doc", "__ld_print")
    split = joined.withColumns({"__ld_lines": F.split(text, "\n", -1)})
    n = F.size("__ld_lines").cast("long")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), F.col("__ld_dropped"))
    rebuilt = F.when(F.col("__ld_dropped").isNull(), text).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("__ld_lines"), i)), "\n")
    )
    return split.withColumns(
        {text_col: rebuilt, "n_lines": n, "n_dropped": F.coalesce(F.size("__ld_dropped"), F.lit(0)).cast("long")}
    ).drop("__ld_lines", "__ld_dropped")
