"""Filter interaction audit.

Five filters judge every document.  One pass turns texts into flags; joint
failures are then counted for all 32 sets of filters, as sums of products of
flags (a document counts for a set if it fails every filter of the set).
Everything asked about any order of the filters follows from these 32 numbers
a part by inclusion-exclusion:

*   survivors of a set P: the sum of (-1)^|T| J(T) over all T in P;
*   removed at a step: survivors before less survivors after;
*   redundant at a step: J({f}) less what f removed;
*   unique failures of f: survivors of all but f, less survivors of all;
*   120 times the Shapley value of f: the sum over T holding f of the Harsanyi
    dividends (-1)^(|T|+1) J(T), each shared by |T|.

The filters: A fewer than 100 words, B fewer than 80 % of words distinct,
C more than 10 % of code points in A-Z, D any of ``#$%&*|``, E a text equal to
that of a smaller document id.

Defined cases: a null text is the empty text (it fails A, and E if a smaller
id has none either); a null part is the empty part; a row with a null id fails
E never, and no other row fails E by it; rows that share an id are documents
of their own, and none of them is a copy of another; several labels of a
document count as one if any says so; an empty table gives no rows; other
columns, whatever their names, are left behind.

Shape at scale: texts are read once and never shuffled.  What is shuffled are
ids, digests and flags, by id to meet the labels, then by text: documents of
one text that are alike in part, flags and labels are one row a task there,
with the least id among them, so a text in a third of all documents is a few
rows.  Counts by part and flags are combined in the task again: at most 128
rows a part and task.  The 600 steps are made from 32 counts, a part at a time.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm._common import words_of

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
#: What is counted: all documents, those of quality 1, toxic ones.
WEIGHTS = ("docs", "good", "toxic")


def flags(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, f0 to f4, good, toxic, n): documents alike in all of these, and
    how many; f0 to f4, good and toxic are 0 or 1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size("words")
    judged = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        # a leading constant makes the second digest independent of the first
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        words_of(text).alias("words"),
        (F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(10) * F.length(text)).cast("int").alias("f2"),
        text.rlike(r"[#$%&*|]").cast("int").alias("f3"),
    ).select(
        "id", "part", "h1", "h2", "f2", "f3",
        (n < 100).cast("int").alias("f0"),
        (F.lit(100) * F.size(F.array_distinct("words")) < F.lit(80) * n).cast("int").alias("f1"),
    )
    one = F.lit(1).eqNullSafe
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(one(F.col("quality")).cast("int")).alias("good"), F.max(one(F.col("toxic")).cast("int")).alias("toxic"))
    marks = ["part", "f0", "f1", "f2", "f3", "good", "toxic"]
    labelled = judged.join(known, "id", "left").withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})
    held = labelled.groupBy("id", "h1", "h2", *marks).agg(F.count(F.lit(1)).alias("n"))
    # of each text and all marks: rows, rows with an id, the least id and its rows
    alike = held.groupBy("h1", "h2", *marks).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("h1", "h2"))
    copies = F.col("known") - F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = alike.withColumn("least", least).withColumn("copies", F.coalesce(copies, F.lit(0)))
    each = F.array(F.struct(F.lit(0).alias("f4"), (F.col("n") - F.col("copies")).alias("n")), F.struct(F.lit(1).alias("f4"), F.col("copies").alias("n")))
    return split.select(*marks, F.explode(each).alias("e")).select(*marks, "e.*")


def joint_failures(flagged: DataFrame) -> DataFrame:
    """(part, docs, good, toxic): each an array of the 32 joint counts."""
    alike = flagged.groupBy("part", *(f"f{k}" for k in range(len(FILTERS))), "good", "toxic").agg(F.sum("n").alias("n"))

    def product(members: int) -> Column:
        out = F.col("n")
        for k in range(len(FILTERS)):
            if members >> k & 1:
                out = out * F.col(f"f{k}")
        return out

    sums = [F.sum(product(s) * F.col(w) if w != "docs" else product(s)).alias(f"{w}{s}") for w in WEIGHTS for s in SETS]
    joint = alike.groupBy("part").agg(*sums)
    return joint.select("part", *(F.array(*(F.col(f"{w}{s}") for s in SETS)).alias(w) for w in WEIGHTS))


def survivors(joint: str) -> Column:
    """Möbius inversion: how many fail no filter of a set, for all 32 sets."""
    signed = f"{joint}[t] * IF(bit_count(t) % 2 = 0, 1, -1)"
    return F.expr(f"transform(sequence(0, {len(SETS) - 1}), s -> aggregate(sequence(0, {len(SETS) - 1}), 0L, (a, t) -> a + IF(t & s = t, {signed}, 0L)))")


def shapley(joint: str) -> Column:
    """Each filter's value times the number of orders: a set's dividend is
    shared by its members."""
    orders = factorial(len(FILTERS))
    share = f"{joint}[t] * IF(bit_count(t) % 2 = 0, -1, 1) * ({orders} div bit_count(t))"
    return F.expr(
        f"transform(sequence(0, {len(FILTERS) - 1}), k -> aggregate(sequence(1, {len(SETS) - 1}), 0L, (a, t) -> a + IF(t & shiftleft(1, k) > 0, {share}, 0L)))"
    )


def filter_audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step."""
    joint = joint_failures(flags(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col))
    left = joint.select("part", F.col("docs").alias("joint"), shapley("docs").alias("values"), *(survivors(w).alias(w) for w in WEIGHTS))
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    rows = (
        left.withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("which", F.expr(f"instr('{FILTERS}', substring(filter_order, step, 1)) - 1"))
        .withColumn("after", F.expr(f"aggregate(sequence(1, step), 0, (a, i) -> a | shiftleft(1, instr('{FILTERS}', substring(filter_order, i, 1)) - 1))"))
    )
    bit = F.expr("shiftleft(1, which)")
    after, before = F.col("after"), F.col("after") - bit
    at = lambda name, where: F.get(F.col(name), where)
    everything = F.lit(len(SETS) - 1)
    removed = at("docs", before) - at("docs", after)
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("docs", after).alias("kept"),
        removed.alias("removed"),
        (at("joint", bit) - removed).alias("redundant"),
        (at("docs", everything - bit) - at("docs", everything)).alias("unique_fails"),
        (at("good", before) - at("good", after)).alias("good_lost"),
        (at("toxic", before) - at("toxic", after)).alias("toxic_lost"),
        at("values", F.col("which")).alias("shapley"),
    )
