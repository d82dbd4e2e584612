"""Spelling variant grouping.

Runs of letters are counted over all texts, with one letter of some of them
deleted (planted misspellings, by a checksum of document id and run).  Words
one edit apart are found by letter parity: bit b of a word's mask is the parity
of the letters with that bit, so that an inserted or deleted letter flips one
bit and a replaced letter two or none.  Masks are split into three bands of 21
bits; two flips leave one band alone.  Words are joined on an equal band, the
length of the shorter one (own length, or one less), and on the half of the
word that the edit leaves alone, so that a common band value is no large
group.  Among words of a key the second band is probed with each bit flipped,
and what is found is verified letter by letter.

Of the up to six keys under which a pair may meet only the first counts, so
sums over keys are exact.  A word's form is its near word of largest count, if
that is at least ten times its own; forms are followed to the root by pointer
doubling (counts grow tenfold a step, so a few rounds do).

Defined cases: null and empty texts have no words; a null id counts as the
empty string in the checksum; repeated rows count again; words of any length
are compared whole; an empty table gives an empty table; other columns,
whatever their names, are left behind.

Shape at scale: runs are counted in the task before they are shuffled, so a
word in every document is one row a task.  The vocabulary (which grows more
slowly than the texts) is sent twelve times: three bands, two lengths, two
halves.  Groups of an exchange are dealt by a hash of the whole key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import cut, prepare
from foldspark.llm.line_dedup import UPPER
from foldspark.llm.words import mixed

LETTER = "A-Za-zÀ-ÿ"
BANDS, BAND_BITS = 3, 21
#: Words and variants in one exchange group, on average; pairs held at once.
GROUP_ROWS, PAIRS_AT_ONCE = 100_000, 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, one_in: int = 31) -> DataFrame:
    """(word, n): words of at least ``min_chars`` letters and how often they occur."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        # a run shorter than this is shorter still with a letter less
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTER}]{{{min_chars},}})"), F.lit(1))).alias("run"),
    ).select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word begins."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat, np.r_[0, np.cumsum(size)]


def masks(words: pa.Array) -> np.ndarray:
    """Parity of letters: neighbours in the alphabet are in different bands."""
    flat, at = letters(words)
    index = np.where(flat < 0xC0, flat - ord("a"), flat - 0xC0 + 26) % (BANDS * BAND_BITS)
    bit = np.left_shift(np.uint64(1), (index % BANDS * BAND_BITS + index // BANDS).astype(np.uint64))
    return np.bitwise_xor.reduceat(bit, at[:-1]) if len(bit) else np.zeros(0, np.uint64)


def with_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("mask", pa.array(masks(batch.column(0)).view(np.int64)))


def keyed(words: DataFrame, groups: int) -> DataFrame:
    """A row for each band, length and half: (g, key, band, side, word, mask, n)."""
    n = F.length("word")
    every = [(k, d, s) for k in range(BANDS) for d in (0, 1) for s in (0, 1)]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.lit(d).alias("less"), F.lit(s).alias("side")) for k, d, s in every)))
    rows = words.select("word", "n", "mask", each.alias("e")).select("word", "n", "mask", "e.*", (n - F.col("e.less")).alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    own = F.expr(f"shiftright(mask, {BAND_BITS} * band) & {(1 << BAND_BITS) - 1}")
    kept = F.when(F.col("side") == 0, F.substring(F.col("word"), F.lit(1), half)).otherwise(F.substring(F.col("word"), n - half + 1, half))
    key = F.xxhash64("band", own, "size", "side", kept)
    return rows.withColumn("key", key).select(F.pmod("key", F.lit(groups)).cast("int").alias("g"), "key", "band", "less", "side", "word", "mask", "n")


def one_edit(flat: np.ndarray, at: np.ndarray, short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are exactly one edit apart, ``long`` being as long as
    ``short`` or one longer; and how many leading letters they share."""
    size = at[short + 1] - at[short]
    equal_size = at[long + 1] - at[long] == size
    begin = np.cumsum(size) - size
    index = np.arange(int(size.sum())) - np.repeat(begin, size)
    a = flat[np.repeat(at[short], size) + index]
    ahead = np.repeat(at[long], size) + index
    same = a == flat[ahead]
    shifted = a == flat[np.minimum(ahead + np.repeat(~equal_size, size), len(flat) - 1)]
    lead = np.minimum.reduceat(np.where(same, np.repeat(size, size), index), begin)
    trail = size - 1 - np.maximum.reduceat(np.where(shifted, -1, index), begin)
    # equal lengths: one letter lies between what leads and what trails
    return np.where(equal_size, (lead + trail + 1 == size) & (lead < size), lead + trail >= size), lead


def near_words(table: pa.Table) -> pa.Table:
    """Group side: for words with near words here, (word, n_near, best n, best)."""
    column = lambda name: table[name].to_numpy()
    words = table["word"].combine_chunks()
    flat, at = letters(words)
    band, side, less, n = column("band"), column("side"), column("less").astype(bool), column("n")
    key, mask = column("key").view(np.uint64), column("mask").view(np.uint64)
    field = np.uint64((1 << BAND_BITS) - 1)
    second = (mask >> ((band + 1) % BANDS * BAND_BITS).astype(np.uint64)) & field
    filed = mixed(key ^ (second * _ODD))
    order = np.argsort(filed, kind="stable")
    ordered = filed[order]
    seen = int(np.bitwise_or.reduce(second)) if len(second) else 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # the shorter word (or either of equal length) probes
    probing = np.flatnonzero(~less)
    for flip in [0, *(1 << b for b in range(BAND_BITS) if seen >> b & 1)]:
        wanted = mixed(key[probing] ^ ((second[probing] ^ np.uint64(flip)) * _ODD))
        low, high = np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")
        for some in portions(high - low):
            many = (high - low)[some]
            u = np.repeat(probing[some], many)
            v = order[np.repeat(low[some] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            unlike = (key[u] == key[v]) & (u != v)
            u, v = u[unlike], v[unlike]
            if not len(u):
                continue
            near, lead = one_edit(flat, at, u, v)
            near &= first_meeting(mask[u] ^ mask[v], band[u], side[u], lead, (at[u + 1] - at[u]) // 2)
            found.append((u[near], v[near]))
    if not found:
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "form_n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
    u, v = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    longer = less[v]  # equal lengths meet both ways, others once
    a, b = np.r_[u, v[longer]], np.r_[v, u[longer]]
    # rows of one word in this group: count by the word itself, later
    rank = pc.rank(words, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    by = np.lexsort((rank[b], -n[b], rank[a]))
    a, b = a[by], b[by]
    new = np.flatnonzero(np.r_[True, rank[a][1:] != rank[a][:-1]]) if len(a) else np.zeros(0, np.int64)
    return pa.table(
        {
            "word": words.take(pa.array(a[new])),
            "n_near": pa.array(np.diff(np.r_[new, len(a)]), pa.int64()),
            "form_n": pa.array(n[b[new]], pa.int64()),
            "form": words.take(pa.array(b[new])),
        }
    )


def portions(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indices with pairs, so many that they have PAIRS_AT_ONCE pairs or one index."""
    have = np.flatnonzero(sizes)
    total = np.cumsum(sizes[have])
    while len(have):
        upto = max(1, int(np.searchsorted(total, PAIRS_AT_ONCE, "right")))
        yield have[:upto]
        have, total = have[upto:], total[upto:] - total[upto - 1]


def first_meeting(flips: np.ndarray, band: np.ndarray, side: np.ndarray, lead: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether a pair that meets under this band and half meets under no
    earlier one: the first band that is equal and followed by a band with at
    most one flip, and the front half if it is equal."""
    field = np.uint64((1 << BAND_BITS) - 1)
    bits = np.stack([np.bitwise_count((flips >> np.uint64(k * BAND_BITS)) & field) for k in range(BANDS)])
    valid = np.stack([(bits[k] == 0) & (bits[(k + 1) % BANDS] <= 1) for k in range(BANDS)])
    return (valid.argmax(0) == band) & ((side == 0) | (lead < half))


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_n: int = 2, times: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    prepare(docs.sparkSession)
    counted = variants(docs, id_col=id_col, text_col=text_col, min_chars=min_chars).where(F.col("n") >= min_n)
    words = cut(counted.mapInArrow(with_masks, "word string, n long, mask long"))
    groups = max(32, -(-words.count() * 4 * BANDS // GROUP_ROWS))
    met = (
        keyed(words, groups)
        .groupBy("g")
        .applyInArrow(near_words, "word string, n_near long, form_n long, form string")
        .groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best"))
        .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))
    )
    far = F.col("form_n") >= times * F.col("n")
    told = cut(
        words.select("word", "n")
        .join(met, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n"))
    )
    roots = told.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    return told.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
