"""Language identification by multinomial naive Bayes.

A text's features are its hashed character n-grams (of one, two and three
lower-cased code points).  Training counts features by language on labelled
rows; the log-probability matrix (buckets by languages, add-one smoothed) is
broadcast, and a batch is scored by gathering the matrix rows of its n-grams
and summing them by text.

Training rows are those that ``training`` marks, with a label and a text.  At
most about ``max_rows`` of them are used, chosen by a hash of the id: a
documented bound on the cost of fitting.  Scoring covers whole texts of all
rows.  Only the text enters a prediction.

Defined cases: a null text, or one without any letter, is ``und`` with score
0; so is every text if there is nothing to learn from; equal scores go to the
language that sorts first; rows that repeat are scored row by row; an empty
table gives an empty table; input columns named like computed ones are
replaced.

Shape at scale: fitting sums (language, bucket) counts in Spark from a
bounded sample and brings at most ``languages * buckets`` numbers to the
driver at a time: languages go in blocks of ``languages``, each with its own
matrix, and a row carries its best language, score and sum from block to
block.  Scoring is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import cut, prepare
from foldspark.llm.words import _STEPS, mixed

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Characters held at once; fewer if there are many languages to score.
CHARACTERS = 1 << 19


@cache
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of lower-cased texts: for each order, the bucket at every character (``BUCKETS`` where the
    n-gram would leave its text); where texts begin; which have a letter."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    wide = chars.astype(np.uint64)
    buckets = []
    for n in ORDERS:
        out = np.full(len(chars), BUCKETS, np.int64)
        if len(chars) >= n:
            end = len(chars) - n + 1
            h = np.full(end, n, np.uint64)
            for j in range(n):
                h += wide[j : j + end] * _STEPS[j]
            inside = row[:end] == row[n - 1 :]
            out[:end] = np.where(inside, (mixed(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), BUCKETS)
        buckets.append(out)
    lettered = np.zeros(len(texts), bool)
    if len(chars):
        lettered[row[letters()[chars]]] = True
    return buckets, at, lettered


def pieces(texts: pa.Array, most: int) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """(rows, pieces, own): lower-cased texts, the long ones cut into pieces of
    ``most`` characters and the two after them, of which the first ``own``
    begin n-grams here; about ``most`` characters at a time."""
    rows: list[int] = []
    held: list[str] = []
    owns: list[int] = []
    size = 0
    for row, text in enumerate(texts.to_pylist()):
        whole = (text or "").lower()
        for begin in range(0, max(1, len(whole)), most):
            rows.append(row)
            held.append(whole[begin : begin + most + max(ORDERS) - 1])
            owns.append(min(most, len(whole) - begin))
            size += owns[-1]
            if size >= most:
                yield rows, held, owns
                rows, held, owns, size = [], [], [], 0
    if held:
        yield rows, held, owns


def own_features(held: list[str], owns: list[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``features`` without the n-grams that begin in the piece after."""
    buckets, at, lettered = features(held)
    for k, (text, own) in enumerate(zip(held, owns, strict=True)):
        if len(text) > own:
            for b in buckets:
                b[at[k] + own : at[k] + len(text)] = BUCKETS
    return buckets, at, lettered


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of rows ``at[i]`` to ``at[i + 1]``; empty stretches give 0."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values, at[:-1][full], axis=0)
    return out


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, language) to (language, bucket, n), summed in the task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), object)
        for rows, held, owns in pieces(batch.column(0), CHARACTERS):
            buckets, at, _ = own_features(held, owns)
            own = labels[rows]
            for label in set(own.tolist()):
                chosen = np.repeat(own == label, np.diff(at))
                into = total.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
                for b in buckets:
                    into += np.bincount(b[chosen], minlength=BUCKETS + 1)
    for label, n in total.items():
        some = np.flatnonzero(n[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["language", "bucket", "n"])


def languages_of(labelled: DataFrame) -> list[tuple[str, float]]:
    """Languages and log priors, in order."""
    classes = labelled.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in classes)
    return sorted((r["language"], float(np.log(r["n"] / total))) for r in classes)


def fit(counts: DataFrame, names: list[str]) -> np.ndarray:
    """Log probabilities (bucket by language) of some languages, from rows
    (language, bucket, n)."""
    at = {name: i for i, name in enumerate(names)}
    found = counts.where(F.col("language").isin(names)).toArrow()
    total = np.zeros((BUCKETS + 1, len(names)))
    named = found["language"].combine_chunks().dictionary_encode() if found.num_rows else None
    if named is not None:
        column = np.array([at[x] for x in named.dictionary.to_pylist()])[named.indices.to_numpy()]
        total[found["bucket"].to_numpy(), column] = found["n"].to_numpy()
    smooth = total[:BUCKETS] + 1
    total[:BUCKETS] = np.log(smooth / smooth.sum(axis=0))
    return total


def scores(texts: pa.Array, prior: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log scores (text by language), and which texts have a letter."""
    score, lettered = np.repeat(prior[None, :], len(texts), axis=0), np.zeros(len(texts), bool)
    for rows, held, owns in pieces(texts, max(1 << 12, CHARACTERS * 4 // len(prior))):
        buckets, at, found = own_features(held, owns)
        for b in buckets:
            np.add.at(score, rows, sums(matrix[b], at))
        np.logical_or.at(lettered, rows, found)
    return score, lettered


def identify(
    docs: DataFrame,
    training: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 60_000,
    languages: int = 64,
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    prepare(spark)
    usable = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = usable.count()
    draw = F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1_000_000))
    labelled = usable.where(draw < F.lit(int(1e6 * min(1.0, max_rows / max(n, 1))))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("language"))
    names = languages_of(labelled)
    counts = labelled.mapInArrow(bucket_counts, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    if len(names) > languages:  # read once for each block
        counts = cut(counts)
    docs = docs.drop("lang_pred", "score")
    at, width = docs.columns.index(text_col), len(docs.columns)

    def scored(model):
        """Rows with the best language so far, its log score (null before the
        first block), and the sum of all scores relative to it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, prior, matrix = model.value
            for batch in batches:
                best, top, total = (batch.column(width + i).to_pylist() for i in range(3))
                score, lettered = scores(batch.column(at), prior, matrix)
                peak, high = score.argmax(axis=1), score.max(axis=1)
                share = np.exp(score - high[:, None]).sum(axis=1)
                for row in np.flatnonzero(lettered).tolist():
                    if top[row] is None:
                        best[row], top[row], total[row] = names[peak[row]], float(high[row]), float(share[row])
                    elif high[row] > top[row]:  # of equals, the one that sorts first
                        best[row], total[row] = names[peak[row]], float(share[row] + total[row] * np.exp(top[row] - high[row]))
                        top[row] = float(high[row])
                    else:
                        total[row] += float(share[row] * np.exp(high[row] - top[row]))
                carried = [pa.array(best, pa.string()), pa.array(top, pa.float64()), pa.array(total, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *carried], batch.schema.names)

        return run

    out = docs.withColumns({"__lid_best": F.lit(UNDETERMINED), "__lid_top": F.lit(None).cast("double"), "__lid_total": F.lit(None).cast("double")})
    schema = ", ".join(f"`{n}` {t}" for n, t in out.dtypes)
    for first in range(0, len(names), languages):
        block = names[first : first + languages]
        own = [name for name, _ in block]
        out = out.mapInArrow(scored(spark.sparkContext.broadcast((own, np.array([p for _, p in block]), fit(counts, own)))), schema)
    return out.select(*(F.col(f"`{n}`") for n in docs.columns), F.col("__lid_best").alias("lang_pred"), F.coalesce(1 / F.col("__lid_total"), F.lit(0.0)).alias("score"))

