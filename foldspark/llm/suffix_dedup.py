"""Suffix-array dedup.

Texts are bytes.  Every byte covered by a string of ``k`` bytes that also starts
in a document of smaller id is removed; strings are judged on the input.  Equal
strings are found as neighbours in a suffix array built by difference cover.

1.  Pieces.  A suffix can only have an equal neighbour where text repeats, so
    the suffix array is built over the text that may.  Each string of ``k``
    bytes is filed under its anchor, the least hash among its 20-byte
    substrings: equal strings have equal anchors, and neighbouring strings
    mostly share one.  Strings in a row under one anchor are a piece.  Anchors
    of one document alone are dropped, and equal pieces are united.  A text that
    a smaller document has as a whole sends none.
2.  Suffixes.  Anchors deal pieces over the tasks.  A task sorts the suffixes
    of its pieces by difference cover: letters are eight bytes, sampled
    suffixes (two of three) are named by sorted triples of letters; names are
    the letters of the recursion, which ends when triples span ``k`` bytes or
    all names differ; the other third is ordered by first letter and rank of
    the rest, and merged with the sample.  Neighbours that agree in ``k`` bytes
    form a class, whose least document keeps the string.
3.  Removal.  Strings of larger ids go back to their documents as intervals.

Anchors only decide where to look; whether strings are equal is read from the
sorted suffixes, and for united pieces and whole texts from 112 or more bits of hash.

Defined cases: a null text is empty; the result's text is binary, as a
character may lose some of its bytes; rows that share an id never remove each
other's bytes, and each is judged on its own text; a row with a null id neither
removes nor loses bytes; texts under ``k`` bytes stay whole; an empty table
gives an empty table; input columns named like computed ones are replaced.

Shape at scale: both exchanges are combined inside the task, so a passage in a
third of all documents is a few records a task.  An anchor of very many
documents, each with its own surroundings, would be a large group: beyond
``hot`` documents its strings are filed one by one under their own hash, which
deals them over all groups.  Hot anchors are broadcast; ``hot`` is raised with
the table so that there are a million at most.  Suffixes are sorted two
megabytes of pieces at a time, cut between anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm._common import cut, prepare
from foldspark.llm.substring_dedup import ANCHORS_AT_ONCE, heads, runs_of, squeezed, unzipped, zipped
from foldspark.llm.words import _BYTE_CODE, _UNDO, BLOCK_BYTES, Block, blocks, mixed, powers

#: Bytes of an anchor, and of a letter of the suffix sort; bits of an anchor's hash.
ANCHOR_BYTES, LETTER, ANCHOR_BITS = 20, 8, 48
#: Bytes of text for one exchange group, of pieces held in a task before they
#: are sent, and of pieces whose suffixes are sorted together.
GROUP_BYTES, HELD_BYTES, SORT_BYTES = 4 << 20, 16 << 20, 2 << 20
#: Documents from which an anchor counts as hot, and how many hot anchors there may be.
HOT_DOCS, HOT_ANCHORS = 100_000, 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---- suffixes by difference cover -------------------------------------------


def dense(*parts: np.ndarray) -> np.ndarray:
    """Ranks from 1 of tuples, equal tuples having equal ranks."""
    whole, top = parts[0], int(parts[0].max(initial=0)) + 1
    for part in parts[1:]:
        here = int(part.max(initial=0)) + 1
        if top * here >= 1 << 63:
            whole = dense(whole)
            top = int(whole.max(initial=0)) + 1
        whole, top = whole * here + part, top * here
    order = np.argsort(whole)
    ordered = whole[order]
    out = np.empty(len(whole), np.int64)
    out[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else 0
    return out


def below(ranks: np.ndarray, among: np.ndarray) -> np.ndarray:
    """How many of ``among`` are smaller than each of ``ranks``, all dense."""
    counts = np.bincount(among, minlength=int(ranks.max(initial=0)) + 1)
    return (np.cumsum(counts) - counts)[ranks]


def ranked(at: np.ndarray, wanted: np.ndarray, letter: np.ndarray, step: int, need: int) -> np.ndarray:
    """By position, for the suffixes ``wanted`` among those at ``at``: a rank
    that orders them.  ``letter[i]`` orders suffixes by their first ``step``
    bytes, and the letter after it is ``letter[i + step]``.  Suffixes that agree
    in ``need`` bytes are neighbours, in any order."""
    rest, one, two = (wanted[wanted // step % 3 == c] for c in range(3))
    # sampled suffixes by which the wanted ones are compared
    flag = np.zeros(len(letter), bool)
    for p in (one, two, rest + step, rest + 2 * step, one + step, two + 2 * step):
        flag[p] = True
    used = np.flatnonzero(flag)
    used = used[letter[used] > 0]
    names = np.zeros(len(letter), np.int64)
    sample = at[at // step % 3 > 0] if 3 * step < need else used
    names[sample] = dense(letter[sample], letter[sample + step], letter[sample + 2 * step])
    if 3 * step < need and len(sample) and names.max() < len(sample):
        names = ranked(sample, used, names, 3 * step, need)
    # merge: the rest meets class one by (letter, name), class two by (letter, letter, name)
    first = np.concatenate([rest, one])
    key = dense(letter[first], names[first + step])
    rest_1, one_1 = key[: len(rest)], key[len(rest) :]
    second = np.concatenate([rest, two])
    key = dense(letter[second], letter[second + step], names[second + 2 * step])
    rest_2, two_2 = key[: len(rest)], key[len(rest) :]
    out = np.zeros(len(letter), np.int64)
    sampled = np.concatenate([one, two])
    out[rest] = below(rest_1, rest_1) + below(rest_1, one_1) + below(rest_2, two_2) + 1
    out[sampled] = below(names[sampled], names[sampled]) + 1
    out[one] += below(one_1, rest_1)
    out[two] += below(two_2, rest_2)
    return out


def letters(data: np.ndarray, need: int) -> np.ndarray:
    """Codes of the eight bytes from each position on, in their order; zeros follow."""
    wide = np.zeros(len(data) + LETTER, np.uint64)
    wide[: len(data)] = data
    whole = np.zeros(len(data), np.uint64)
    for j in range(LETTER):
        whole = whole << np.uint64(8) | wide[j : j + len(data)]
    out = np.zeros(len(data) + 9 * max(need, LETTER), np.int64)
    out[: len(data)] = dense(whole)
    return out


def classes(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of ``k`` bytes at ``starts`` in suffix order, and where in
    that order another string begins."""
    code = letters(data, k)
    order = starts[np.argsort(ranked(np.arange(len(data)), starts, code, LETTER, k)[starts])]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for j in [*range(0, k - LETTER, LETTER), k - LETTER]:
        here = code[order + j]
        new[1:] |= here[1:] != here[:-1]
    return order, np.flatnonzero(new)


# ---- strings and their anchors ----------------------------------------------


def slices(texts: pa.Array, k: int) -> Iterator[tuple[Block, int]]:
    """Blocks of whole texts; a longer text in parts that overlap by k - 1
    bytes, with the byte at which each begins."""
    for block in blocks(texts):
        if block.last - block.first > 1 or len(block.data) <= BLOCK_BYTES:
            yield block, 0
            continue
        for begin in range(0, len(block.data) - k + 1, BLOCK_BYTES):
            part = block.data[begin : begin + BLOCK_BYTES + k - 1]
            yield Block(block.first, block.last, part, np.array([0, len(part)])), begin


def rolled(data: np.ndarray) -> np.ndarray:
    """Running sum from which the hash of any substring can be had."""
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers(len(data), _UNDO), out=running[1:])
    return running


def substring_hashes(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((running[end] - running[start]) * powers(len(running))[end - 1] + (end - start).astype(np.uint64))


def anchored(block: Block, running: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every string of k bytes inside a row: first byte, row, anchor."""
    n = len(block.data) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    q = min(ANCHOR_BYTES, k)
    least = mixed((running[q:] - running[:-q]) * powers(len(running))[q - 1 : len(running) - 1])
    span, width = 1, k - q + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    row = np.repeat(np.arange(len(block.at) - 1, dtype=np.int32), np.diff(block.at))
    first = np.flatnonzero(row[:n] == row[k - 1 :])
    return first, row[first], least[first] >> np.uint64(64 - ANCHOR_BITS)


# ---- blobs: rows of an exchange group as one binary value a column ----------


def put(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, as most are zero or nearly sorted."""
    return squeezed(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def taken(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    expand, wide = zstandard.ZstdDecompressor().decompress, np.dtype(kind).itemsize
    parts = [np.frombuffer(expand(x.as_buffer()), np.uint8).reshape(wide, -1).T.copy().view(kind).ravel() for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def grouped(group: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``rows`` by their group."""
    if not len(rows):
        return
    rows = rows[np.argsort(group[rows], kind="stable")]
    first = heads(group[rows])
    for i, j in zip(first, np.r_[first[1:], len(rows)], strict=True):
        yield int(group[rows[i]]), rows[i:j]


def of_document(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def blob_batch(rows: list[tuple[int, list[bytes]]], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = [pa.array([c[i] for _, c in rows], pa.binary()) for i in range(len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), *columns], names)


# ---- anchors ----------------------------------------------------------------

ANCHOR_SCHEMA = "g int, a binary, d binary, c binary"


def combined(held: list[tuple[np.ndarray, np.ndarray]], groups: int) -> pa.RecordBatch:
    """(anchor, doc) pairs of a task.  Groups below ``groups`` get, by anchor,
    its least holder here and how many hold it; groups above get, by document,
    the anchors that several hold, which are settled."""
    key, holder = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    order = np.lexsort((holder, key))
    order = order[heads(key[order], holder[order])]
    key, holder = key[order], holder[order]
    at, many = heads(key), runs_of(key)
    count = np.zeros(len(key), np.uint32)
    count[at] = many
    rows = [(g, [put(x[own]) for x in (key, holder, count)]) for g, own in grouped((key % np.uint64(groups)).astype(np.int64), at)]
    several = np.flatnonzero(np.repeat(many > 1, many))
    rows += [(g, [put(x[own]) for x in (key, holder, count)]) for g, own in grouped(groups + of_document(holder, groups), several)]
    return blob_batch(rows, ANCHOR_SCHEMA)


def anchor_blobs(k: int, groups: int):
    """Task side: (anchor, doc), combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block, _ in slices(batch.column(1), k):
                _, row, anchor = anchored(block, rolled(block.data), k)
                at = heads(anchor, row)
                held.append((anchor[at], ids[block.first + row[at]].astype(np.int64)))
                n += len(at)
                if n >= ANCHORS_AT_ONCE:
                    yield combined(held, groups)
                    held, n = [], 0
        if n:
            yield combined(held, groups)

    return run


def held_anchors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group side: anchors in order, one holder each, counts, and holders in all."""
    key, holder, count = taken(table["a"], np.uint64), taken(table["d"], np.int64), taken(table["c"], np.uint32)
    order = np.lexsort((holder, key))
    key, holder, count = key[order], holder[order], count[order]
    return key, holder, count, np.add.reduceat(count, heads(key), dtype=np.int64) if len(key) else np.zeros(0, np.int64)


def repeated_anchors(groups: int):
    """Group side: (doc, anchor) of the anchors found in two documents."""

    def run(table: pa.Table) -> pa.Table:
        if table["g"][0].as_py() < groups:
            key, holder, count, _ = held_anchors(table)
            at, many = heads(key), runs_of(key)
            again = (np.maximum.reduceat(count, at) > 1) | (holder[at] != holder[at + many - 1])
            out = np.repeat(again, many) & (count == 1)  # greater counts are settled in their task
            key, holder = key[out], holder[out]
        else:
            key, holder = taken(table["a"], np.uint64), taken(table["d"], np.int64)
        return pa.table({"__sx_doc": pa.array(holder, pa.int64()), "__sx_anchor": pa.array(key.view(np.int64), pa.int64())})

    return run


def hot_anchors(groups: int, hot: int):
    """Group side: the anchors that at least ``hot`` documents hold."""

    def run(table: pa.Table) -> pa.Table:
        found = np.zeros(0, np.uint64)
        if table["g"][0].as_py() < groups:
            key, _, _, total = held_anchors(table)
            found = key[heads(key)][total >= hot]
        return pa.table({"__sx_anchor": pa.array(found.view(np.int64), pa.int64()), "hot": pa.array(np.ones(len(found), bool))})

    return run


# ---- pieces -----------------------------------------------------------------

#: A piece: key it is filed under, document, print of the text, first byte,
#: number of strings; its bytes are sent beside these.
PIECE = {"a": np.uint64, "d": np.int64, "p": np.int32, "s": np.int64, "n": np.uint32}
PIECE_SCHEMA = "g int, a binary, d binary, p binary, s binary, n binary, b binary"
SPAN_SCHEMA = "g int, d binary, p binary, s binary, e binary"


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of ``data``, one after the other."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def beaten_by_equals(piece: dict[str, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a smaller document holds an equal piece, and which piece stands
    for each: one of the smallest document."""
    order = np.lexsort((piece["d"], piece["n"], hashes, piece["a"]))
    keys = [c[order] for c in (piece["a"], hashes, piece["n"])]
    stands = np.empty(len(order), np.int64)
    stands[order] = np.repeat(order[heads(*keys)], runs_of(*keys)) if len(order) else order
    return piece["d"] > piece["d"][stands], stands


def piece_blobs(k: int, groups: int):
    """Task side.  Input rows: doc, print, zipped text, its repeated anchors, the hot ones."""

    def send(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        piece = {c: np.concatenate([h[c] for h in held]) for c in PIECE}
        data, hashes = (np.concatenate([h[c] for h in held]) for c in ("b", "h"))
        size = piece["n"].astype(np.int64) + k - 1
        at = np.cumsum(size) - size
        beaten, _ = beaten_by_equals(piece, hashes)
        rows = [(g, [*(put(piece[c][own]) for c in PIECE), squeezed(b"")]) for g, own in grouped(groups + of_document(piece["d"], groups), np.flatnonzero(beaten))]
        for g, own in grouped((piece["a"] % np.uint64(groups)).astype(np.int64), np.flatnonzero(~beaten)):
            rows.append((g, [*(put(piece[c][own]) for c in PIECE), squeezed(gathered(data, at[own], size[own]).tobytes())]))
        return blob_batch(rows, PIECE_SCHEMA)

    def listed(column: pa.Array, block: Block) -> np.ndarray:
        """The lists of a block's rows, each value made its row's own."""
        at = column.offsets.to_numpy().astype(np.int64)
        values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        own = np.repeat(np.arange(block.last - block.first, dtype=np.uint64), np.diff(at[block.first : block.last + 1]))
        return values[at[block.first] : at[block.last]] + own * _ODD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for block, begin in slices(unzipped(batch.column(2)), k):
                running = rolled(block.data)
                first, row, anchor = anchored(block, running, k)
                if not len(first):
                    continue
                # neighbours mostly share an anchor: look each stretch up once
                at = heads(anchor, row)
                of_row = anchor[at] + row[at].astype(np.uint64) * _ODD
                cold, hot = (np.repeat(np.isin(of_row, listed(batch.column(c), block)), np.diff(np.r_[at, len(first)])) for c in (3, 4))
                own = np.flatnonzero(cold | hot)
                if not len(own):
                    continue
                f, r = first[own], row[own]
                a = np.where(hot[own], substring_hashes(running, f, f + k), anchor[own])
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1]) | (f[1:] != f[:-1] + 1)])
                size = np.diff(np.r_[new, len(own)])
                f, r = f[new], r[new]
                doc = block.first + r
                held.append(
                    {
                        "a": a[new],
                        "h": substring_hashes(running, f, f + size + k - 1),
                        "d": ids[doc].astype(np.int64),
                        "p": prints[doc].astype(np.int32),
                        "s": begin + f - block.at[r],
                        "n": size.astype(np.uint32),
                        "b": gathered(block.data, f, size + k - 1),
                    }
                )
                n += len(held[-1]["b"])
                if n >= HELD_BYTES:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    return run


def least_documents(piece: dict[str, np.ndarray], data: np.ndarray, at: np.ndarray, chosen: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For pieces that are one of several under their key: positions in
    ``data`` where strings start, and the least document of each string."""
    chosen = chosen[np.argsort(piece["a"][chosen], kind="stable")]
    key = piece["a"][chosen]
    first, many = heads(key), runs_of(key)
    first, many = first[many > 1], many[many > 1]
    size = piece["n"].astype(np.int64) + k - 1
    total = np.r_[0, np.cumsum(size[chosen])]
    i = 0
    while i < len(first):
        j = i + 1
        while j < len(first) and total[first[j] + many[j]] - total[first[i]] <= SORT_BYTES:
            j += 1
        own = chosen[np.concatenate([np.arange(a, a + b) for a, b in zip(first[i:j], many[i:j], strict=True)])]
        text = gathered(data, at[own], size[own])
        n = piece["n"][own].astype(np.int64)
        begin = np.cumsum(size[own]) - size[own]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(begin, n) + within
        origin, holder = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        origin[starts], holder[starts] = np.repeat(at[own], n) + within, np.repeat(piece["d"][own], n)
        order, new = classes(text, starts, k)
        yield origin[order], np.repeat(np.minimum.reduceat(holder[order], new), np.diff(np.r_[new, len(order)]))
        i = j


def removals(k: int, groups: int):
    """Group side: stretches of strings to remove as byte ranges, by document group."""

    def run(table: pa.Table) -> pa.Table:
        piece = {c: taken(table[c], kind) for c, kind in PIECE.items()}
        doc, print_, start, size = piece["d"], piece["p"], piece["s"], piece["n"].astype(np.int64)
        if table["g"][0].as_py() < groups:
            data = taken(table["b"], np.uint8)
            at = np.cumsum(size + k - 1) - (size + k - 1)
            beaten, stands = beaten_by_equals(piece, substring_hashes(rolled(data), at, at + size + k - 1))
            least = np.full(len(data), np.iinfo(np.int64).max)
            for place, holder in least_documents(piece, data, at, np.unique(stands), k):
                least[place] = holder
            live = np.flatnonzero(~beaten)
            n = size[live]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            gone = np.flatnonzero(least[np.repeat(at[stands[live]], n) + within] < np.repeat(doc[live], n))
            of, within = np.repeat(live, n)[gone], within[gone]
            new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (within[1:] != within[:-1] + 1)]) if len(of) else of
            part = of[new]
            lost = np.flatnonzero(beaten)
            doc, print_ = np.r_[doc[lost], doc[part]], np.r_[print_[lost], print_[part]]
            start, size = np.r_[start[lost], start[part] + within[new]], np.r_[size[lost], np.diff(np.r_[new, len(of)])]
        end = start + size + k - 1
        return pa.Table.from_batches([blob_batch([(g, [put(x[own]) for x in (doc, print_, start, end)]) for g, own in grouped(of_document(doc, groups), np.arange(len(doc)))], SPAN_SCHEMA)])

    return run


def merged(table: pa.Table) -> pa.Table:
    """Group side: (doc, print, starts, ends) of maximal removed ranges."""
    doc, print_, start, end = (taken(table[c], kind) for c, kind in (("d", np.int64), ("p", np.int32), ("s", np.int64), ("e", np.int64)))
    order = np.lexsort((start, print_, doc))
    doc, print_, start, end = doc[order], print_[order], start[order], end[order]
    text = np.zeros(len(doc), np.int64)
    text[heads(doc, print_)] = 1
    text = np.cumsum(text) << 40  # a text has less than 2^31 bytes
    reach = np.maximum.accumulate(end + text)
    new = np.r_[True, (start + text)[1:] > reach[:-1]] if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    own = heads(doc[first], print_[first])
    lists = pa.array(np.r_[own, len(first)].astype(np.int32))
    ranges = [pa.ListArray.from_arrays(lists, pa.array(x, pa.int64())) for x in (start[first], (reach - text)[last])]
    return pa.table({"__sx_doc": pa.array(doc[first][own]), "__sx_print": pa.array(print_[first][own]), "__sx_starts": ranges[0], "__sx_ends": ranges[1]})


# ---- the kept bytes ---------------------------------------------------------


def reducer(columns: list[str], text_col: str):
    """Rows (columns of the table, starts, ends) to rows with the text reduced."""
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, ends = unzipped(batch.column(at)), batch.column(len(columns)), batch.column(len(columns) + 1)
            kept, total, removed, spans = [], [], [], []
            for row, text in enumerate(texts):
                whole = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                edge = np.zeros(len(whole) + 1, np.int32)
                if starts[row].is_valid:
                    edge[starts[row].values.to_numpy()] = 1
                    edge[ends[row].values.to_numpy()] = -1
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(whole[~gone].tobytes())
                total.append(len(whole))
                removed.append(int(gone.sum()))
                spans.append(len(starts[row].values) if starts[row].is_valid else 0)
            out = batch.select(columns).set_column(at, text_col, pa.array(kept, pa.binary()))
            for name, values in (("n_bytes", total), ("n_removed", removed), ("n_spans", spans)):
                out = out.append_column(name, pa.array(values, pa.int64()))
            yield out

    return run


def whole_copies(owned: DataFrame) -> DataFrame:
    """(doc, print, size) of texts that a smaller document has as a whole: they
    go as one range and send no pieces."""
    # a leading constant makes the second digest independent of the first
    digests = owned.select(
        "__sx_doc", F.hash("__sx_text").alias("__sx_print"), F.octet_length("__sx_text").cast("long").alias("__sx_size"), F.xxhash64("__sx_text").alias("h1"), F.xxhash64(F.lit(1), "__sx_text").alias("h2")
    )
    held = digests.groupBy("h1", "h2").agg(F.min("__sx_doc").alias("least"), F.max("__sx_doc").alias("most")).where("least < most").drop("most")
    # nothing above the join needs a text's documents together, so a hot text is split
    found = cut(digests.join(held, ["h1", "h2"]).where("__sx_doc > least").select("__sx_doc", "__sx_print", "__sx_size"))
    return found.distinct()


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 50, hot: int = HOT_DOCS) -> DataFrame:
    """``docs`` with ``text_col`` as the kept bytes, and ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal runs of removed bytes).  ``id_col``
    holds whole numbers; ``k`` is eight or more."""
    if k < LETTER:
        raise ValueError(f"k is at least {LETTER}")
    prepare(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_removed", "n_spans")
    owned = docs.where(F.col(id_col).isNotNull() & (F.octet_length(text_col) >= k)).select(F.col(id_col).cast("long").alias("__sx_doc"), F.col(text_col).alias("__sx_text"))
    total = owned.agg(F.sum(F.octet_length("__sx_text"))).first()[0] or 0
    groups = max(64, -(-total // GROUP_BYTES))
    anchors = owned.mapInArrow(anchor_blobs(k, groups), ANCHOR_SCHEMA).groupBy("g")
    found = anchors.applyInArrow(repeated_anchors(groups), "__sx_doc long, __sx_anchor long")
    # documents have no more anchors in all than bytes, so this bounds the hot ones
    busy = anchors.applyInArrow(hot_anchors(groups, max(hot, -(-total // HOT_ANCHORS))), "__sx_anchor long, hot boolean")
    flagged = found.join(F.broadcast(busy), "__sx_anchor", "left")
    copies = whole_copies(owned)
    lists = flagged.groupBy("__sx_doc").agg(
        F.collect_list(F.when(F.col("hot").isNull(), F.col("__sx_anchor"))).alias("__sx_cold"), F.collect_list(F.when(F.col("hot"), F.col("__sx_anchor"))).alias("__sx_hot")
    )
    with_print = owned.select("__sx_doc", F.hash("__sx_text").alias("__sx_print"), "__sx_text")
    found_whole = copies.groupBy("__sx_doc").agg(F.collect_set("__sx_print").alias("__sx_whole"))
    spans = (
        zipped(with_print, "__sx_text")
        .join(lists.join(found_whole, "__sx_doc", "left"), "__sx_doc")
        .where(~F.coalesce(F.array_contains("__sx_whole", F.col("__sx_print")), F.lit(False)))
        .select("__sx_doc", "__sx_print", "__sx_text", "__sx_cold", "__sx_hot")
        .mapInArrow(piece_blobs(k, groups), PIECE_SCHEMA)
        .groupBy("g")
        .applyInArrow(removals(k, groups), SPAN_SCHEMA)
        .groupBy("g")
        .applyInArrow(merged, "__sx_doc long, __sx_print int, __sx_starts array<long>, __sx_ends array<long>")
        .unionByName(copies.select("__sx_doc", "__sx_print", F.array(F.lit(0).cast("long")).alias("__sx_starts"), F.array("__sx_size").alias("__sx_ends")))
    )
    columns = docs.columns
    keyed = docs.withColumns({"__sx_doc": F.col(id_col).cast("long"), "__sx_print": F.hash(text_col)})
    joined = zipped(keyed, text_col).join(spans, ["__sx_doc", "__sx_print"], "left").select(*columns, "__sx_starts", "__sx_ends")
    schema = ", ".join(f"`{n}` {'binary' if n == text_col else t}" for n, t in docs.dtypes)
    return joined.mapInArrow(reducer(columns, text_col), f"{schema}, n_bytes long, n_removed long, n_spans long")
