"""Mixing sources to target weights by capped water-filling.

The size of a document is its number of words.  Sources, in code point order
with null last, have the weights 5, 2, 1, repeating, and share all words by
weight; a target stops at ``max_epochs`` times its source's size, and what is
cut off is shared again by weight until no target is above its cap.

With all caps known, the result is targets min(cap, weight * level) for one
level; each round clamps the sources above their caps at the present level
and raises the level for the rest.  Sums are whole numbers, so the level is
the same on every run.

A target is met by whole repetitions of every document and a fractional one:
documents of a source are ordered by a seeded hash, and the first of them,
as far as the fraction of the source's words goes, are taken once more.  The
last of these is taken in part (its first words), so a source's taken words
are its target rounded to a word.

Defined cases: a null text has no words; a null source is one source, last;
sources without words have target 0; rows that repeat are documents of their
own (equal rows may exchange their takes); an empty table gives an empty
table; input columns named like computed ones are replaced.

Shape at scale: words are counted once, into a written table of narrow rows.
One aggregate by source gives the source table.  Its rounds are aggregates
that return two numbers.  Source positions and the words before a document
are two-step ranks (``ranks``), so a source that holds a third of all rows is
dealt over all tasks.  ``mixture`` carries the documents through the same
steps, so that no take has to find its document again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm._common import cut, n_words_of, words_of
from foldspark.llm.ranks import before_bucket, bucketed

WEIGHTS = (5, 2, 1)


def positions(sources: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """The source table with ``_at``: its place by code point, null last.

    UTF-8 sorts by code point.  The names are cut into sorted ranges, each
    ordered by one task, with the rows of earlier ranges added.
    """
    some = [r["k"] for r in sources.select(F.col(key).alias("k")).where("k is not null").orderBy(F.xxhash64("k")).limit(8 * parts).collect()]
    some = sorted(some, key=lambda s: s.encode())[8::8]
    bucket = F.when(F.col(key).isNull(), len(some) + 1).otherwise(F.size(F.filter(F.array(*map(F.lit, some)).cast("array<string>"), lambda b: b <= F.col(key))))
    dealt = sources.withColumns({"_bucket": bucket.cast("long"), "_all": F.lit(0)})
    before = before_bucket(dealt, ["_all"], F.count(F.lit(1)))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_last())) - 1
    return dealt.withColumn("_at", own).join(before, ["_all", "_bucket"]).withColumn("_at", (F.col("_at") + F.col("_before")).cast("long")).drop("_all", "_bucket", "_before")


def fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """``target`` for the table (source_size, _weight, ...)."""
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        free = F.lit(True) if level is None else cap > F.col("_weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(free, F.col("_weight"))).alias("w"), F.sum(F.when(~free, cap)).alias("c")).first()
        if not row["w"]:
            break
        new = (total - (row["c"] or 0)) / row["w"]
        if level is not None and new <= level:
            break
        level = new
    target = cap.cast("double") if level is None or not row["w"] else F.least(cap.cast("double"), F.col("_weight") * F.lit(float(level)))
    return sources.withColumn("target", target)


def drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, carry: list[str]) -> DataFrame:
    """(carried columns, _id, _source, size, _row, _draw) of every document."""
    text, own = F.col(text_col), F.col(id_col)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return docs.select(
        *(F.col(c).alias(f"_c_{c}") for c in carry), own.alias("_id"), F.col(source_col).alias("_source"), n_words_of(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_row"), draw.alias("_draw")
    )


def dealt(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with what their source has, and their bucket."""
    named = rows.join(sources, F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    named = named.withColumn("_src", F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("?")))
    return bucketed(named, F.shiftright(F.col("_draw"), 20), F.col("_n"))


def takes(rows: DataFrame, before: DataFrame) -> DataFrame:
    """``taken`` for dealt rows, from the words before their buckets."""
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    # words of the fractional repetition, over the whole source
    extra = F.greatest(F.lit(0).cast("long"), F.floor(F.col("target") + 0.5).cast("long") - (whole * F.col("source_size")).cast("long"))
    w = Window.partitionBy("_src", "_bucket").orderBy("_draw", "_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_own", F.coalesce(F.sum("size").over(w), F.lit(0))).join(before, ["_src", "_bucket"])
    more = F.greatest(F.lit(0), F.least(F.col("size"), extra - F.col("_own") - F.col("_before")))
    return placed.withColumn("taken", F.coalesce(F.when(F.col("source_size") > 0, whole * F.col("size") + more), F.lit(0)).cast("long"))


def planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Narrow rows, the source table, and the words before each bucket."""
    narrow = cut(drawn(docs, id_col, text_col, source_col, seed, []))
    sources = cut(narrow.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")))
    cycle: Column = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("_at"), F.lit(len(weights))).cast("int"))
    filled = fill(cut(positions(sources, "_source").withColumn("_weight", cycle.cast("long"))), max_epochs)
    filled = cut(filled.select(F.col("_source").alias("_name"), "source_size", "target", "_n"))
    return narrow, filled, cut(before_bucket(dealt(narrow, filled), ["_src"], F.sum("size")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken."""
    narrow, sources, before = planned(docs, id_col, text_col, source_col, weights, max_epochs, seed)
    out = takes(dealt(narrow, sources), before)
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """The mix itself: every document as often as it is taken, the last time
    perhaps in part (its first words, joined by one space).  Documents of no
    words, and those never taken, are absent."""
    _, sources, before = planned(docs, id_col, text_col, source_col, weights, max_epochs, seed)
    taken = takes(dealt(drawn(docs, id_col, text_col, source_col, seed, docs.columns), sources), before).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    copies = taken.withColumn("_left", F.explode(F.transform(F.sequence(F.lit(0), times - 1), lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size")))))
    text = F.col(f"_c_{text_col}")
    part = F.array_join(F.slice(words_of(text), F.lit(1), F.col("_left").cast("int")), " ")
    whole_or_part = F.when(F.col("_left") == F.col("size"), text).otherwise(part)
    return copies.select(*((whole_or_part if c == text_col else F.col(f"_c_{c}")).alias(c) for c in docs.columns))
