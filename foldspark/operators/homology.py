"""Sequence search and clustering by aligned identity and coverage.

A sequence is an array of letters (residues, or words of a text), each with a
class of letters that count as similar.  Seeds are k-mers of classes, so a
k-mer meets its whole neighbourhood of similar k-mers under one key.

*   ``search``: seeds of queries and targets join on the k-mer; a pair goes on
    if two seeds that do not overlap lie on one diagonal (or within a few of
    it); its best diagonal is aligned.
*   ``sequence_clusters``: each sequence sends its few seeds of least hash; under
    a k-mer (and a class of length, as coverage asks for like lengths) all
    meet the longest only, so pairs grow with the sequences and not with their
    square.  Aligned pairs are covered greedily from the longest sequence on.

Alignment is local (Smith-Waterman, linear gaps) inside a band around the
diagonal, vectorised over batches of pairs.  Identity is equal letters over
columns of the alignment, coverage the aligned range over the length.

Defined cases: null and empty sequences are in no pair, and are clusters of
their own; equal sequences are united before seeds are sent, so repeated rows
add nothing; ties fall to the longer sequence, then to the least id.  Seeds
limit what is found: see the README for measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.session import checkpointed, ship_package

#: Classes of similar residues: the ten-letter alphabet of Murphy, Wallqvist
#: and Levy (2000).  Fixed values.
RESIDUE_CLASSES = ("LVIM", "C", "A", "G", "ST", "P", "FYW", "EDNQ", "KR", "H")

#: Seeds of queries (about 40 bytes each) up to which they are broadcast, and
#: occurrences of a k-mer in targets from which it is subdivided.
BROADCAST_SEEDS, HOT_SEEDS = 500_000, 100_000
#: Pairs aligned at once.
PAIRS_AT_ONCE = 256


@dataclass(frozen=True)
class Scoring:
    match: int = 2
    mismatch: int = 1
    gap: int = 2
    #: Diagonals on either side of the seeds' diagonal.
    band: int = 12


# ---- sequences and seeds ----------------------------------------------------


def residues(df: DataFrame, ident: str, sequence: str) -> DataFrame:
    """(id, letters, classes) of sequences of one-letter residues."""
    upper = F.upper(F.coalesce(F.col(sequence), F.lit("")))
    alike = F.translate(upper, "".join(RESIDUE_CLASSES), "".join(c[0] * len(c) for c in RESIDUE_CLASSES))
    codes = lambda s: F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: F.ascii(x))
    return df.select(F.col(ident).alias("id"), codes(upper).alias("letters"), codes(alike).alias("classes"))


def words(df: DataFrame, ident: str, text: str, stem: int = 6) -> DataFrame:
    """(id, letters, classes) of texts as sequences of words; words that agree
    in their first letters, case aside, are similar."""
    found = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    split = df.select(F.col(ident).alias("id"), found.alias("w"))
    return split.select("id", F.transform("w", lambda w: F.hash(w)).alias("letters"), F.transform("w", lambda w: F.hash(F.lower(F.left(w, F.lit(stem))))).alias("classes"))


def kmers(k: int) -> Column:
    """Array of (h, p): hash and position of every k-mer of classes."""
    at = F.sequence(F.lit(0), F.size("classes") - k)
    return F.when(F.size("classes") >= k, F.transform(at, lambda i: F.struct(F.xxhash64(*(F.get("classes", i + j) for j in range(k))).alias("h"), i.alias("p"))))


# ---- alignment --------------------------------------------------------------


def aligned_pairs(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, diagonal: np.ndarray, s: Scoring) -> dict[str, np.ndarray]:
    """Best local alignment of each pair inside its band: score, equal letters,
    columns, and half-open ranges in both.  Sequences lie one after the other
    in ``a`` and ``b``; ``diagonal`` is the position in b less that in a.  Among
    equals the earliest end, and diagonal before gaps."""
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    order = np.argsort(-n_a, kind="stable")
    n, m, begin_a, begin_b, off = n_a[order], n_b[order], a_at[:-1][order], b_at[:-1][order], diagonal[order] - s.band
    width, pairs = 2 * s.band + 1, len(order)
    steps, one = np.arange(width), 1 << 32
    tilt, bits = s.gap * steps, width.bit_length()
    # cells of the row before: score, columns and equal letters, first position in b and in a
    score, passed, begun = (np.zeros((pairs, width), np.int64) for _ in range(3))
    top_score, top_passed, top_begun, top_ended = (np.zeros(pairs, np.int64) for _ in range(4))
    live, rows = pairs, np.arange(pairs)
    for i in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n[:live], -i, "left"))  # pairs with more than i letters
        at = (off[:live] + i)[:, None] + steps
        inside = (at >= 0) & (at < m[:live, None])
        same = inside & (a[begin_a[:live] + i][:, None] == b[np.where(inside, begin_b[:live, None] + at, 0)])
        h, c, f = score[:live], passed[:live], begun[:live]
        new, new_c, new_f = h + np.where(same, s.match, -s.mismatch), c + same, np.where(h == 0, (at << 32) + i, f)
        up = h[:, 1:] - s.gap  # a gap in b: the same column, one row before
        better = up > new[:, :-1]
        np.copyto(new[:, :-1], up, where=better)
        np.copyto(new_c[:, :-1], c[:, 1:], where=better)
        np.copyto(new_f[:, :-1], f[:, 1:], where=better)
        new_c += one
        filled = inside & (new > 0)
        new *= filled
        new_c *= filled
        # gaps in a: the best of all earlier columns less its distance
        reach = np.maximum.accumulate((new + tilt << bits) + steps, axis=1)
        source = np.where(inside, reach & ((1 << bits) - 1), steps)
        new = np.where(inside, (reach >> bits) - tilt, 0)
        cell = source + rows[:live, None] * width
        new_c = new_c.ravel()[cell] + (steps - source << 32)
        new_f = new_f.ravel()[cell]
        h[:], c[:], f[:] = new, new_c, new_f
        best = new.argmax(1)
        won = np.flatnonzero(new[rows[:live], best] > top_score[:live])
        k = best[won]
        top_score[won], top_passed[won], top_begun[won], top_ended[won] = new[won, k], new_c[won, k], new_f[won, k], (at[won, k] + 1) * one + i + 1
    found = {
        "score": top_score, "equal": top_passed % one, "columns": top_passed // one,
        "a_start": top_begun % one, "a_end": top_ended % one, "b_start": top_begun // one, "b_end": top_ended // one,
    }
    back = np.empty(pairs, np.int64)
    back[order] = rows
    return {c: v[back] for c, v in found.items()}


def aligner(s: Scoring):
    """Rows (a, b, a_letters, b_letters, diagonal) to aligned pairs."""

    def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = column.offsets.to_numpy().astype(np.int64)
        return column.flatten().to_numpy(zero_copy_only=False), at - at[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(begin, PAIRS_AT_ONCE)
                (a, a_at), (b, b_at) = (letters(pa.concat_arrays([part.column(i)])) for i in (2, 3))
                got = aligned_pairs(a, a_at, b, b_at, part.column(4).to_numpy().astype(np.int64), s)
                share = lambda x, y: pa.array(np.divide(x, y, out=np.zeros(len(x)), where=y > 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(got["score"]),
                        share(got["equal"], got["columns"]),
                        share(got["a_end"] - got["a_start"], np.diff(a_at)),
                        share(got["b_end"] - got["b_start"], np.diff(b_at)),
                    ],
                    ["a", "b", "score", "identity", "cover_a", "cover_b"],
                )

    return run


def letters_of(sequences: DataFrame, wanted: DataFrame, few: int) -> DataFrame:
    """(id, letters), one row an id, of the wanted ids; a counted few are
    picked where the sequences are read."""
    wanted = checkpointed(wanted.distinct())
    picked = F.broadcast(wanted) if wanted.count() <= few else wanted
    return sequences.select("id", "letters").join(picked, "id", "left_semi").dropDuplicates(["id"])


def aligned(pairs: DataFrame, left: DataFrame, right: DataFrame, scoring: Scoring, few: int = BROADCAST_SEEDS) -> DataFrame:
    """(a, b, score, identity, cover_a, cover_b) of pairs (a, b, diagonal)."""
    ship_package(pairs.sparkSession)
    pairs = checkpointed(pairs)
    kinds = dict(left.dtypes)["id"], dict(right.dtypes)["id"]
    sides = [pairs.select(F.col(c).alias("id")) for c in "ab"]
    if left is right:
        own = other = checkpointed(letters_of(left, sides[0].unionByName(sides[1]), few))
    else:
        own, other = letters_of(left, sides[0], few), letters_of(right, sides[1], few)
    with_a = pairs.join(own.select(F.col("id").alias("a"), F.col("letters").alias("a_letters")), "a")
    both = with_a.join(other.select(F.col("id").alias("b"), F.col("letters").alias("b_letters")), "b")
    # like lengths side by side, as a batch takes as many steps as its longest pair
    rows = both.select("a", "b", "a_letters", "b_letters", "diagonal").sortWithinPartitions(F.size("a_letters"))
    return rows.mapInArrow(aligner(scoring), f"a {kinds[0]}, b {kinds[1]}, score long, identity double, cover_a double, cover_b double")


# ---- search -----------------------------------------------------------------


def seed_hits(queries: DataFrame, targets: DataFrame, k: int, hot: int = HOT_SEEDS, few: int = BROADCAST_SEEDS) -> DataFrame:
    """(a, b, p_a, diagonal) for seeds that a query and a target share.  Few
    counted query seeds are broadcast, and no target seed is shuffled; many
    are dealt by k-mer, and a hot k-mer's targets over several tasks each of
    which has the query seeds."""
    mine = queries.select(F.col("id").alias("a"), F.inline(kmers(k))).withColumnRenamed("p", "p_a")
    theirs = targets.select(F.col("id").alias("b"), F.inline(kmers(k))).withColumnRenamed("p", "p_b")
    if mine.limit(few + 1).count() <= few:
        met = theirs.join(F.broadcast(mine), "h")
    else:
        wanted = theirs.join(mine.select("h").distinct(), "h", "left_semi")
        busy = wanted.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("h", F.ceil(F.col("c") / hot).cast("int").alias("parts"))
        busy = checkpointed(busy)
        busy = F.broadcast(busy) if busy.count() <= few else busy
        parts = F.coalesce("parts", F.lit(1))
        dealt = wanted.join(busy, "h", "left").withColumn("part", F.pmod(F.xxhash64("b", "p_b"), parts).cast("int"))
        spread = mine.join(busy, "h", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        met = dealt.drop("parts").join(spread.drop("parts"), ["h", "part"])
    return met.select("a", "b", "p_a", (F.col("p_b") - F.col("p_a")).alias("diagonal"))


def search(queries: DataFrame, targets: DataFrame, *, k: int = 3, drift: int = 8, least_cover: float = 0.8, cover: str = "both", least_identity: float = 0.0, scoring: Scoring = Scoring(), hot: int = HOT_SEEDS, few: int = BROADCAST_SEEDS) -> DataFrame:
    """(a, b, score, identity, cover_a, cover_b) of query-target pairs whose
    best seeded diagonal aligns over ``least_cover`` of both (or of the query:
    ``cover="query"``).  Two seeds count as on one diagonal if they are in one
    stretch of ``drift`` diagonals; stretches overlap by half."""
    hits = seed_hits(queries, targets, k, hot, few)
    stretch = F.floor(F.col("diagonal") / (drift // 2)).cast("int")
    filed = hits.select("a", "b", "p_a", "diagonal", F.explode(F.array(stretch, stretch - 1)).alias("s"))
    runs = filed.groupBy("a", "b", "s").agg(F.count(F.lit(1)).alias("c"), F.min("p_a").alias("low"), F.max("p_a").alias("high"), F.avg("diagonal").alias("d"))
    twice = runs.where(F.col("high") - F.col("low") >= k)
    pairs = twice.groupBy("a", "b").agg(F.max_by(F.round("d").cast("int"), F.struct("c", -F.abs("s"), "s")).alias("diagonal"))
    found = aligned(pairs, queries, targets, scoring)
    good = (F.col("cover_a") >= least_cover) & (F.col("identity") >= least_identity)
    return found.where(good & (F.col("cover_b") >= least_cover) if cover == "both" else good)


# ---- clusters ---------------------------------------------------------------


def twins(sequences: DataFrame) -> DataFrame:
    """(id, least, n): the least id of an equal sequence, and the length."""
    # a leading constant makes the second digest independent of the first
    print_of = [F.xxhash64("letters").alias("h1"), F.xxhash64(F.lit(1), "letters").alias("h2"), F.size("letters").alias("n")]
    named = checkpointed(sequences.where(F.col("id").isNotNull()).select("id", *print_of))
    least = named.groupBy("h1", "h2", "n").agg(F.min("id").alias("least"))
    return checkpointed(named.join(least, ["h1", "h2", "n"]).select("id", "least", "n")).distinct()


def seeds_of(sequences: DataFrame, k: int, seeds: int) -> DataFrame:
    """(id, n, h, p): about ``seeds`` k-mers of each sequence, those of least
    hash; the share of hashes kept follows the length, so like sequences keep
    the same.  No sequence is sorted."""
    n = F.size("letters")
    share = F.least(F.lit(1.0), F.lit(float(seeds)) / F.greatest(n - k + 1, F.lit(1)))
    limit = (share * F.lit(float((1 << 63) - 1))).cast("long")
    low = lambda x: F.call_function("shiftrightunsigned", x["h"], F.lit(1))
    every = sequences.where(n >= k).select("id", n.alias("n"), kmers(k).alias("all"), limit.alias("limit"))
    kept = F.array_append(F.filter("all", lambda x: low(x) <= F.col("limit")), F.array_min("all"))
    return every.select("id", "n", F.inline(kept)).distinct()


def candidate_pairs(sequences: DataFrame, known: DataFrame, k: int, seeds: int, cover: float) -> DataFrame:
    """(a, b, diagonal): sequences with the longest one of a k-mer and class of
    length; b is the longer.  Lengths of a class differ by a factor 1 / cover,
    and each sequence also meets the class above its own.  Of equal sequences
    (``known``: ``twins``) only the one of least id is sent."""
    own = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(cover))).cast("int")
    # read twice below: kept, as texts would be split and hashed again
    once = checkpointed(seeds_of(sequences, k, seeds).join(known.where("id = least").select("id"), "id", "left_semi"))
    sent = once.withColumn("own", own).withColumn("kind", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    first = F.struct(-F.col("n"), F.col("id"))
    longest = sent.where("kind = own").groupBy("h", "kind").agg(F.min_by(F.struct("id", "p"), first).alias("top"))
    met = sent.join(longest, ["h", "kind"]).where(F.col("id") != F.col("top.id"))
    lines = met.groupBy(F.col("id").alias("a"), F.col("top.id").alias("b"), F.col("n"), (F.col("top.p") - F.col("p")).alias("diagonal")).agg(F.count_distinct("h").alias("c"))
    pairs = lines.groupBy("a", "b").agg(
        F.max_by("diagonal", F.struct("c", -F.abs("diagonal"), "diagonal")).alias("diagonal"), F.sum("c").alias("c"), F.first("n").alias("n")
    )
    # one common k-mer says little, unless the sequence has no more of them
    return pairs.where(F.col("c") >= F.least(F.lit(2), F.col("n") - k + 1)).select("a", "b", "diagonal")


def set_cover(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster): nodes (id, n) taken longest first, then by least id; each
    that no representative has taken becomes one, and takes all its neighbours
    that are left.  Done in rounds: a node is settled once all its earlier
    neighbours are."""
    rank = lambda side: F.struct((-F.col(f"n_{side}")).alias("m"), F.col(side).alias("i"))
    sized = [nodes.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}")) for s in "ab"]
    ranked = links.select("a", "b").where("a <> b").join(sized[0], "a").join(sized[1], "b")
    swap = rank("b") < rank("a")
    edges = checkpointed(ranked.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v")).distinct())
    open_nodes = checkpointed(nodes.select("id"))
    heads, live = None, edges
    while not live.isEmpty():
        # no earlier neighbour is open, and none is a representative (its neighbours have left)
        new = checkpointed(open_nodes.join(live.select(F.col("v").alias("id")), "id", "left_anti"))
        heads = new if heads is None else heads.unionByName(new)
        taken = live.join(new.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        gone = new.unionByName(taken)
        open_nodes = checkpointed(open_nodes.join(gone, "id", "left_anti"))
        live = checkpointed(live.join(open_nodes.select(F.col("id").alias("u")), "u", "left_semi").join(open_nodes.select(F.col("id").alias("v")), "v", "left_semi"))
    heads = checkpointed(open_nodes if heads is None else heads.unionByName(open_nodes))
    owner = edges.join(heads.select(F.col("id").alias("u")), "u", "left_semi").join(heads.select(F.col("id").alias("v")), "v", "left_anti")
    owner = owner.join(nodes.select(F.col("id").alias("u"), "n"), "u").groupBy("v").agg(F.min_by("u", F.struct(-F.col("n"), F.col("u"))).alias("cluster"))
    return heads.select("id", F.col("id").alias("cluster")).unionByName(owner.select(F.col("v").alias("id"), "cluster"))


def cluster_links(sequences: DataFrame, known: DataFrame, *, k: int = 3, seeds: int = 20, least_identity: float = 0.3, least_cover: float = 0.8, scoring: Scoring = Scoring()) -> DataFrame:
    """Aligned pairs of distinct sequences, identical and covering enough."""
    found = aligned(candidate_pairs(sequences, known, k, seeds, least_cover), sequences, sequences, scoring)
    return found.where((F.col("identity") >= least_identity) & (F.col("cover_a") >= least_cover) & (F.col("cover_b") >= least_cover))


def sequence_clusters(sequences: DataFrame, *, k: int = 3, seeds: int = 20, least_identity: float = 0.3, least_cover: float = 0.8, scoring: Scoring = Scoring()) -> DataFrame:
    """(id, cluster): clusters are named by their representative's id.  Empty
    sequences are clusters of their own; a row without an id is in none."""
    known = twins(sequences)
    links = cluster_links(sequences, known, k=k, seeds=seeds, least_identity=least_identity, least_cover=least_cover, scoring=scoring)
    found = set_cover(known.where("id = least and n > 0").select("id", "n"), links)
    joined = known.join(found.withColumnRenamed("id", "least"), "least", "left")
    return joined.select("id", F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("cluster", "least")).alias("cluster"))
