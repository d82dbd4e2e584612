"""Quality rules with host-level verdicts (DataFrame functions only).

Document rules give counts and ``base_failed``.  Failures are aggregated by
host (``host_col``), host rates are shrunk with a beta prior whose parameters
are estimated from all hosts by the method of moments (beta-binomial: what
hosts differ by beyond the sampling of their documents), and the verdict on a
host is joined back to its documents: a document is kept if it passes its own
rules and its host's shrunken failure rate is at most ``max_host_rate``.

Defined cases: a null or blank text has no words and fails; a null host is no
host and is never judged; with a single host, hosts of one document each, or
none or all of the documents failing, spread cannot be told and the prior is
the pooled rate with the weight of ``flat_weight`` documents; hosts that differ
by no more than sampling does get the greatest weight, 1e6 documents; an empty table gives an empty table; rows that share an id are
judged row by row; input columns named like computed ones are replaced.

Shape at scale: the rules are computed once, row by row inside the scan, and
written to the shared folder; without ``keep_text`` that table is narrow.  Of
the host statistics one row per task and host leaves a task.  Nothing wide is
shuffled unless the host table is too large to broadcast: its rows are counted,
and above ``broadcast_hosts`` hosts a plain join is used, which AQE splits for
a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import BLANKS, cut, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_chars(text: Column, chars: str) -> Column:
    """Occurrences of the (one-byte) characters in a text."""
    total = F.lit(0)
    for c in chars:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return total.cast("long")


def repeated_words(windows: Column, ordered: Column, starts: Column) -> tuple[Column, Column, Column]:
    """Columns for three projections, each built from the one before:
    the windows as sorted (hash, start); the starts of windows that occur at
    least twice, ascending; the number of words these windows cover."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.filter(
        ordered,
        lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)),
    )
    starting = F.array_sort(F.transform(again, lambda x: x["i"]))
    # least() passes over the null that stands behind the last start
    covered = F.aggregate(
        F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.get(starts, k + 1) - s)), F.lit(0), lambda a, b: a + b
    )
    return pairs, starting, covered


def document_rules(docs: DataFrame, text_col: str = "text", *, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """``docs`` with the five counts and ``base_failed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))
    df = docs.withColumns({"__qr_hashes": hashes, "__qr_lines": lines})
    h = F.col("__qr_hashes")
    windows = F.when(
        F.size(h) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumns(
        {
            "n_words": F.size(h).cast("long"),
            "word_chars": F.length(text) - count_chars(text, BLANKS),
            "n_symbols": count_chars(text, SYMBOLS),
            "n_dup_lines": (F.size("__qr_lines") - F.size(F.array_distinct("__qr_lines"))).cast("long"),
            "__qr_windows": windows,
        }
    ).drop("__qr_hashes", "__qr_lines")
    w, o, s = F.col("__qr_windows"), F.col("__qr_ordered"), F.col("__qr_starts")
    pairs, starts, covered = repeated_words(w, o, s)
    df = df.withColumn("__qr_ordered", F.when(F.size(F.array_distinct(w)) < F.size(w), pairs)).drop("__qr_windows")
    df = df.withColumn("__qr_starts", F.when(o.isNotNull(), starts)).drop("__qr_ordered")
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__qr_starts")
    # A generator of one row: a filter on the counts stays above it, where it
    # would otherwise be pushed down with all their expressions written out.
    others = [c for c in df.columns if c not in METRICS]
    df = df.select(*others, F.inline(F.array(F.struct(*METRICS))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_rates(judged: DataFrame, host_col: str, *, flat_weight: float = 10.0) -> DataFrame:
    """One row per host: host, documents, failures, shrunken failure rate.

    Moments over hosts of n_i documents, f_i failed: the pooled rate m, and
    what sum n_i (f_i / n_i - m)^2 exceeds its expectation under one rate by.
    """
    hosts = cut(
        judged.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )
    sums = {"n": F.col("n_docs"), "f": F.col("n_failed"), "nn": F.col("n_docs") * F.col("n_docs"), "ff": F.col("n_failed") * F.col("n_failed") / F.col("n_docs"), "k": F.lit(1)}
    row = hosts.agg(*(F.sum(x.cast("double")).alias(name) for name, x in sums.items())).first()
    a, b = beta_prior(*row, flat_weight=flat_weight)
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b)))


def beta_prior(n: float | None, f: float, nn: float, ff: float, k: float, *, flat_weight: float) -> tuple[float, float]:
    """Parameters from sums over k hosts of n_i, f_i, n_i^2 and f_i^2 / n_i.

    With rates drawn from a beta distribution of weight a + b, the expectation
    of S = sum n_i (f_i / n_i - m)^2 is m (1 - m) (k - 1 + r (n - nn / n - k + 1))
    for r = 1 / (a + b + 1).
    """
    if not n:
        return 0.0, flat_weight
    m = f / n
    binomial, room = m * (1 - m), n - nn / n - (k - 1)
    if binomial <= 0 or room <= 1e-9:
        weight = flat_weight
    else:
        r = ((ff - n * m * m) / binomial - (k - 1)) / room
        weight = min(max(1 / r - 1, 1.0), 1e6) if r > 1e-6 else 1e6
    return m * weight, (1 - m) * weight


def quality_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    host_col: str = "source",
    keep_text: bool = True,
    max_host_rate: float = 0.5,
    broadcast_hosts: int = 50_000,
    **rules: int,
) -> DataFrame:
    """``docs`` (without the text, unless ``keep_text``) with the counts,
    ``base_failed``, ``host_rate`` and ``kept``."""
    judged = document_rules(docs.withColumn("__qr_host", F.col(host_col)), text_col, **rules).drop("host_rate")
    judged = cut(judged if keep_text else judged.drop(text_col))
    hosts = host_rates(judged, "__qr_host").select(F.col("host").alias("__qr_host"), F.col("rate").alias("host_rate"))
    # names longer than 256 characters would undo the bound on the broadcast
    fits = hosts.where(F.length("__qr_host") > 256).isEmpty() and hosts.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    joined = judged.join(F.broadcast(hosts) if fits else hosts, "__qr_host", "left").drop("__qr_host")
    host_ok = F.coalesce(F.col("host_rate") <= max_host_rate, F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & host_ok)
