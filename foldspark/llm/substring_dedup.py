"""Substring dedup.

A window is ``k`` consecutive words of one document.  Every word covered by a
window whose word sequence also starts in a document of smaller id is removed;
windows are judged on the input.

Windows are compared by Rabin-Karp hashes, in two exchanges:

1.  Anchors.  Each window is filed under the least hash among its 5-word
    subwindows (a minimizer): equal windows have equal anchors, and
    neighbouring windows mostly share one, so about a fifth as many anchors
    as windows are counted.  Only anchors found in two documents go on.
2.  Windows.  Documents that hold repeated anchors send the windows filed
    under them, as runs of neighbouring windows.  For each window the least
    document id is found, windows of larger ids are repeated, and repeated
    windows merge into maximal removal intervals, which go back to their
    documents.

A window is identified by its anchor and its own hash together (128 bits).

Both exchanges combine inside the task first, as a partial aggregate does: of
all documents of a task that hold one anchor (or one run of windows) a single
record is sent, whatever the number of holders; the others are settled on the
spot.  So a passage in a third of all documents is a few records a task.
Records of a task are packed by exchange group into binary columns; the
number of groups follows the bytes of the table.

Defined cases: a null text has no words and stays without any; rows that
share an id never remove each other's words, and each row is judged on its
own text; a row with a null id neither removes nor loses words; an empty
table gives an empty table; input columns named like computed ones are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import prepare
from foldspark.llm.words import Block, Words, blocks, mixed, windows, word_hashes, words

ANCHOR_WORDS = 5
#: Records gathered in a task before they are combined and sent.
ANCHORS_AT_ONCE, WINDOWS_AT_ONCE = 1 << 20, 1 << 20
#: Bytes of text for one exchange group.
GROUP_BYTES = 16 << 20


def anchored(data_hashes: np.ndarray, w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: hash, first word, anchor."""
    whole, first = windows(data_hashes, w, k)
    if not len(first):
        return whole, first, whole
    grams = np.zeros(len(data_hashes), np.uint64)
    own, at = windows(data_hashes, w, min(ANCHOR_WORDS, k))
    grams[at] = own
    span, least = 1, grams
    width = k - min(ANCHOR_WORDS, k) + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return whole, first, least[first]


def packed(columns: dict[str, np.ndarray], groups: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The rows of each group as one compressed binary value a column."""
    if not len(groups):
        return
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    for i, j in zip(at, np.r_[at[1:], len(ordered)], strict=True):
        own = order[i:j]
        yield int(ordered[i]), [squeezed(c[own].tobytes()) for c in columns.values()]


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    parts = [np.frombuffer(expand(x.as_buffer()), kind) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins."""
    if not len(sorted_keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(sorted_keys[0]), bool)
    new[0] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Length of each stretch that ``heads`` begins."""
    at = heads(*keys)
    return np.diff(np.r_[at, len(keys[0])]) if len(at) else at


# ---- zipped texts -----------------------------------------------------------


def zipped(docs: DataFrame, text_col: str) -> DataFrame:
    """The table with its texts as compressed binary, for the exchanges."""
    at = docs.columns.index(text_col)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = pa.array([None if x is None else squeezed(x.encode()) for x in batch.column(at).to_pylist()], pa.binary())
            yield batch.set_column(at, text_col, small)

    schema = ", ".join(f"`{n}` {'binary' if n == text_col else t}" for n, t in docs.dtypes)
    return docs.mapInArrow(squeeze, schema)


def unzipped(column: pa.Array) -> pa.Array:
    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([None if x is None else expand(x).decode() for x in column.to_pylist()], pa.string())


# ---- first exchange: anchors ------------------------------------------------


def combined(held: list[tuple[np.ndarray, np.ndarray]], groups: int) -> pa.RecordBatch:
    """(key, holder) pairs of a task as packed rows (g, a, d, s).  Groups 0 to
    groups - 1 have, by key, one holder of each key and whether the key is
    repeated already; groups above have all holders of those that are."""
    key = np.concatenate([a for a, _ in held])
    holder = np.concatenate([d for _, d in held])
    order = np.lexsort((holder, key))
    key, holder = key[order], holder[order]
    one = heads(key, holder)
    key, holder = key[one], holder[one]
    at, size = heads(key), runs_of(key)
    several = np.repeat(size > 1, size)
    first = key[at]
    sent = {"a": first, "d": holder[at], "s": (size > 1).astype(np.uint8)}
    known = {"a": key[several], "d": holder[several], "s": np.ones(int(several.sum()), np.uint8)}
    rows = [*packed(sent, (first % np.uint64(groups)).astype(np.int64)), *packed(known, groups + (mixed(known["d"].astype(np.uint64)) % np.uint64(groups)).astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), *(pa.array([c[i] for _, c in rows], pa.binary()) for i in range(3))], ["g", "a", "d", "s"])


def repeated_keys(table: pa.Table, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Group side of ``combined``: (key, holder) of the keys that two hold."""
    key, holder, settled = unpacked(table["a"], np.uint64), unpacked(table["d"], np.int64), unpacked(table["s"], np.uint8)
    if table["g"][0].as_py() < groups:
        order = np.lexsort((holder, key))
        key, holder, settled = key[order], holder[order], settled[order]
        at, size = heads(key), runs_of(key)
        again = (np.maximum.reduceat(settled, at) > 0) | (holder[at] != holder[at + size - 1])
        out = np.repeat(again, size) & (settled == 0)
        key, holder = key[out], holder[out]
    return key, holder


def anchor_blobs(k: int, groups: int):
    """Task side: (anchor, doc), combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                w = words(block)
                _, first, anchor = anchored(word_hashes(block.data, w), w, k)
                doc = ids[block.first + w.row[first]]
                at = heads(anchor, doc)
                held.append((anchor[at], doc[at].astype(np.int64)))
                n += len(at)
                if n >= ANCHORS_AT_ONCE:
                    yield combined(held, groups)
                    held, n = [], 0
        if n:
            yield combined(held, groups)

    return run


def repeated_anchors(groups: int):
    """Group side: (doc, anchor) of the anchors found in two documents."""

    def run(table: pa.Table) -> pa.Table:
        anchor, doc = repeated_keys(table, groups)
        return pa.table({"__sd_doc": pa.array(doc, pa.int64()), "__sd_anchor": pa.array(anchor.view(np.int64), pa.int64())})

    return run


# ---- second exchange: windows -----------------------------------------------


def window_blobs(k: int, groups: int):
    """Task side.  Input rows: doc, print, zipped text, repeated anchors."""

    def send(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        col = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
        sized = col["n"].astype(np.int64)
        at = np.cumsum(sized) - sized
        # equal runs: the first document settles all larger ones
        step = np.arange(len(col["w"])) - np.repeat(at, sized)
        whole = np.add.reduceat(mixed(col["w"] + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at)
        order = np.lexsort((col["d"], whole, col["a"]))
        first, size = heads(col["a"][order], whole[order]), runs_of(col["a"][order], whole[order])
        beaten = np.zeros(len(order), bool)
        beaten[order] = col["d"][order] > np.repeat(col["d"][order][first], size)
        rows = []
        known = {n: col[n][beaten] for n in ("a", "d", "p", "s", "n")} | {"w": np.zeros(int(beaten.sum()), np.uint64)}
        for g, blobs in packed(known, groups + (mixed(known["d"].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)):
            rows.append((g, blobs))
        live = np.flatnonzero(~beaten)
        live = live[np.argsort(col["a"][live] % np.uint64(groups), kind="stable")]
        group = (col["a"][live] % np.uint64(groups)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(live) else []
        for i, j in zip(cuts, np.r_[cuts[1:], len(live)] if len(live) else [], strict=True):
            own = live[i:j]
            reach = sized[own]
            index = np.repeat(at[own] - (np.cumsum(reach) - reach), reach) + np.arange(int(reach.sum()))
            rows.append((int(group[i]), [*(squeezed(col[n][own].tobytes()) for n in ("a", "d", "p", "s", "n")), squeezed(col["w"][index].tobytes())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([g for g, _ in rows], pa.int32()), *(pa.array([c[i] for _, c in rows], pa.binary()) for i in range(6))], ["g", "a", "d", "p", "s", "n", "w"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(3)
            list_at = lists.offsets.to_numpy().astype(np.int64)
            listed = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for block in blocks(unzipped(batch.column(2))):
                w = words(block)
                whole, first, anchor = anchored(word_hashes(block.data, w), w, k)
                if not len(first):
                    continue
                row = w.row[first]
                reach = np.diff(list_at[block.first : block.last + 1])
                of_row = np.repeat(np.arange(len(reach), dtype=np.uint64), reach)
                wanted = listed[list_at[block.first] : list_at[block.last]] + of_row * np.uint64(0x9E3779B97F4A7C15)
                own = np.flatnonzero(np.isin(anchor + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), wanted))
                if not len(own):
                    continue
                a, r, f = anchor[own], row[own], first[own]
                new = np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (f[1:] != f[:-1] + 1)]
                at = np.flatnonzero(new)
                held.append(
                    {
                        "a": a[at],
                        "d": ids[block.first + r[at]].astype(np.int64),
                        "p": prints[block.first + r[at]].astype(np.int64),
                        "s": (f[at] - w.row_at[r[at]]).astype(np.uint32),
                        "n": np.diff(np.r_[at, len(own)]).astype(np.uint32),
                        "w": whole[own],
                    }
                )
                n += len(own)
                if n >= WINDOWS_AT_ONCE:
                    yield from send(held)
                    held, n = [], 0
        if n:
            yield from send(held)

    return run


def removals(groups: int):
    """Group side: (doc, print, start, length) of stretches of windows to remove."""

    def run(table: pa.Table) -> pa.Table:
        anchor, doc, owner = unpacked(table["a"], np.uint64), unpacked(table["d"], np.int64), unpacked(table["p"], np.int64)
        start, size = unpacked(table["s"], np.uint32).astype(np.int64), unpacked(table["n"], np.uint32).astype(np.int64)
        if table["g"][0].as_py() < groups:
            window = unpacked(table["w"], np.uint64)
            of = np.repeat(np.arange(len(doc)), size)
            at = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size) + start[of]
            order = np.lexsort((window, anchor[of]))
            first, many = heads(anchor[of][order], window[order]), runs_of(anchor[of][order], window[order])
            least = np.empty(len(order), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(doc[of][order], first), many) if len(order) else 0
            out = np.flatnonzero(doc[of] > least)
            of, at = of[out], at[out]
            new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)]) if len(out) else np.zeros(0, np.int64)
            doc, owner, start, size = doc[of[new]], owner[of[new]], at[new], np.diff(np.r_[new, len(out)]) if len(out) else new
        return pa.table({"__sd_doc": pa.array(doc, pa.int64()), "__sd_print": pa.array(owner, pa.int64()), "__sd_start": pa.array(start, pa.int64()), "__sd_size": pa.array(size, pa.int64())})

    return run


# ---- the kept words ---------------------------------------------------------


def covered(block: Block, w: Words, spans: list[list[tuple[int, int]]], k: int) -> np.ndarray:
    """Which words the windows of the spans cover."""
    edge = np.zeros(len(w.start) + 1, np.int32)
    for row, own in enumerate(spans):
        for start, size in own or ():
            first = w.row_at[row] + start
            edge[first] += 1
            edge[min(first + size + k - 1, w.row_at[row + 1])] -= 1
    return np.cumsum(edge[:-1]) > 0


def reducer(columns: list[str], text_col: str, k: int):
    """Rows (columns of the table, spans) to rows with the text reduced."""
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = unzipped(batch.column(at))
            spans = [None if x is None else [(y["__sd_start"], y["__sd_size"]) for y in x] for x in batch.column(len(columns)).to_pylist()]
            kept, total, removed = [], [], []
            for block in blocks(texts):
                w = words(block)
                gone = covered(block, w, spans[block.first : block.last], k)
                for row in range(block.last - block.first):
                    i, j = int(w.row_at[row]), int(w.row_at[row + 1])
                    own = np.flatnonzero(~gone[i:j]) + i
                    data = block.data
                    kept.append(b" ".join([data[s:e].tobytes() for s, e in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)]).decode())
                    total.append(j - i)
                    removed.append(j - i - len(own))
            out = batch.select(columns).set_column(at, text_col, pa.array(kept, pa.string()))
            yield out.append_column("n_words", pa.array(total, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64()))

    return run


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """``docs`` with ``text_col`` as the kept words joined by one space, and
    ``n_words``, ``n_removed``.  ``id_col`` holds whole numbers."""
    prepare(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed")
    owned = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("__sd_doc"), F.col(text_col).alias("__sd_text"))
    total = owned.agg(F.sum(F.octet_length("__sd_text"))).first()[0] or 0
    groups = max(64, -(-total // GROUP_BYTES))
    found = (
        owned.mapInArrow(anchor_blobs(k, groups), "g int, a binary, d binary, s binary")
        .groupBy("g")
        .applyInArrow(repeated_anchors(groups), "__sd_doc long, __sd_anchor long")
        .groupBy("__sd_doc")
        .agg(F.collect_list("__sd_anchor").alias("__sd_anchors"))
    )
    with_print = owned.select("__sd_doc", F.xxhash64("__sd_text").alias("__sd_print"), "__sd_text")
    spans = (
        zipped(with_print, "__sd_text")
        .join(found, "__sd_doc")
        .select("__sd_doc", "__sd_print", "__sd_text", "__sd_anchors")
        .mapInArrow(window_blobs(k, groups), "g int, a binary, d binary, p binary, s binary, n binary, w binary")
        .groupBy("g")
        .applyInArrow(removals(groups), "__sd_doc long, __sd_print long, __sd_start long, __sd_size long")
        .groupBy("__sd_doc", "__sd_print")
        .agg(F.collect_list(F.struct("__sd_start", "__sd_size")).alias("__sd_spans"))
    )
    columns = docs.columns
    keyed = docs.withColumns({"__sd_doc": F.col(id_col).cast("long"), "__sd_print": F.xxhash64(text_col)})
    joined = zipped(keyed, text_col).join(spans, ["__sd_doc", "__sd_print"], "left").select(*columns, "__sd_spans")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return joined.mapInArrow(reducer(columns, text_col, k), f"{schema}, n_words long, n_removed long")
