"""N-gram Jaccard join by multiple-global-order filtering.

A document's set holds its distinct word shingles; two documents link when the
Jaccard similarity of their sets is at least ``percent``.  What is returned is
each document's set size and its connected component.  Links are not listed:
a pair inside one component needs no verification, and a large group of
copies has more pairs than any table can hold.

1.  Orders.  A global token order ranks shingles by how common they are and
    then by a hash.  How common is read from a count sketch over all shingles
    of all documents, rounded to powers of two, so that it only sinks shingles
    of widely shared passages.  Three orders with other hashes are independent
    of each other.
2.  Sets.  One scan gives each document its set size, a digest of the set
    (equal sets are one node from here on), a parity bitmap of four to eight
    bits a shingle, and its prefix under each order.  Linked sets share a
    token among their prefixes under every one of the orders.
3.  Lists.  Prefix tokens under the first order that two nodes hold are lists;
    every linked pair is in one.  Lists of nearly the same members (by
    min-hash) are united.  A list is dealt into parts of about ``part`` members, and within a part all
    pairs are compared by bitmap (the distance of bitmaps is at most the
    symmetric difference).
4.  Forests.  Of the pairs that may link, a task sends on a spanning forest,
    nearest pairs first: as many pairs as it has members at most, whatever the
    size of a group.  Pairs of the forests must share prefix tokens under the
    further orders too; those that do are verified on their whole sets, and
    verified links give components.
5.  Rounds.  Lists of several parts, and lists that had more pairs than their
    forest, go on while they have members of several components: each member
    outside a list's main component is compared with all members of other
    components, in blocks, and more forests are sent each round, until no
    pair that may link is left between components.

Defined cases: a document without words has size 0 and links with nothing; a
row with a null id links with nothing and has a null component; a very long
text is handled whole; rows that share an id stay rows of their own but share
their least id as documents do when their sets link; an empty table gives an
empty table; other input columns are ignored, whatever their names.

Shape at scale: four scans.  Tokens of a task are combined before they are
sent, so that a token in a third of all documents is one record a task, and
packed by exchange group.  Blocks of a list are bounded on both sides.  Texts
of nodes that a candidate pair holds are shuffled once, compressed; the sketch
(``1 << MOST_BITS`` classes of one byte at most) is all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm._common import cut, prepare, slim
from foldspark.llm.components import components
from foldspark.llm.substring_dedup import combined, heads, repeated_keys, runs_of, squeezed, unpacked, unzipped, zipped
from foldspark.llm.words import Block, blocks, mixed, windows, word_hashes, words

#: The sketch has about one counter for each shingle, within these powers of
#: two: its size is bounded whatever the corpus.
LEAST_BITS, MOST_BITS = 14, 24
SKETCH_PARTS = 64
#: Tasks that each send a sketch; more partitions than that are read by fewer
#: tasks, so that sketches stay a small part of what is moved.
SKETCH_TASKS = 4096
ORDERS = (0, 1, 2)
#: Members in a part of a list.
PART = 1024
#: Forests that a round sends, as a multiple of the round before.
MORE = 256
TOKENS_AT_ONCE = 1 << 20
GROUP_BYTES = 32 << 20
#: Bytes of bitmaps in one exchange group, and pairs compared at once.
BLOCK_BYTES, PAIRS_AT_ONCE = 8 << 20, 1 << 18
#: Nodes whose ids are broadcast to pick their texts; more are joined plainly.
BROADCAST_ROWS = 200_000
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# ---- sets -------------------------------------------------------------------


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, sorted within rows; where rows begin."""
    w = words(block)
    h = word_hashes(block.data, w, lower=True)
    shingle, first = windows(h, w, k)
    row = w.row[first]
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        step = np.arange(len(h)) - np.repeat(w.row_at[:-1], counts)
        whole = mixed(h * (step.astype(np.uint64) * np.uint64(2) + np.uint64(3)))
        own = [mixed(np.array([whole[w.row_at[r] : w.row_at[r + 1]].sum() + np.uint64(counts[r])], np.uint64))[0] for r in short]
        shingle, row = np.r_[shingle, np.array(own, np.uint64)], np.r_[row, short]
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    one = heads(row, shingle)
    shingle, row = shingle[one], row[one]
    return shingle, np.searchsorted(row, np.arange(len(counts) + 1))


def digest(tokens: np.ndarray) -> int:
    """63 bits of a set."""
    return int(mixed(np.array([mixed(tokens ^ _SALTS[0]).sum() + np.uint64(len(tokens)), 0], np.uint64))[0] >> np.uint64(1))


def n_bits(n: int) -> int:
    """Bits of a set's bitmap: a power of two, four to eight for a shingle."""
    return max(256, 1 << (4 * n - 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    """Every shingle flips one bit."""
    size = n_bits(len(tokens))
    at = (mixed(tokens ^ _SALTS[1]) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size) & 1).tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of bytes) of half the size; parity survives folding.  Bit
    i of the larger belongs to bit i modulo the smaller size."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def may_link(difference: np.ndarray | int, both: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """100 * i >= percent * u, for i = (both - difference) / 2, u = (both + difference) / 2."""
    return 100 * (both - difference) >= percent * (both + difference)


# ---- orders -----------------------------------------------------------------


def sketch_bits(tokens: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, tokens.bit_length()))


def counting(k: int, size: int):
    """Task side of the sketch: counts of all shingles, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        some = False
        for batch in batches:
            for block in blocks(batch.column(0)):
                tokens, _ = shingle_sets(block, k)
                np.add.at(total, counter(tokens, size), np.uint32(1))
                some = True
        if some:
            parts = total.reshape(SKETCH_PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([squeezed(p.tobytes()) for p in parts], pa.binary())], ["part", "counts"])

    return run


def counter(tokens: np.ndarray, size: int) -> np.ndarray:
    return (mixed(tokens ^ _SALTS[2]) & np.uint64(size - 1)).astype(np.int64)


def adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group side: parts summed as they stream in."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = unpacked([counts], np.uint32).astype(np.int64)
            total[part] = total[part] + own if part in total else own
    for part, own in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([squeezed(np.minimum(own, 2**32 - 1).astype(np.uint32).tobytes())], pa.binary())], ["part", "counts"])


def commonness(texts: DataFrame, k: int, size: int) -> np.ndarray:
    """For each counter, how many powers of two lie between twice the mean
    count and its own."""
    few = texts.coalesce(SKETCH_TASKS)
    rows = few.mapInArrow(counting(k, size), "part int, counts binary").repartition(SKETCH_PARTS, "part").mapInArrow(adding, "part int, counts binary").collect()
    # one part at a time: the driver holds the classes, never all counts
    counts = lambda row: unpacked([pa.scalar(bytes(row["counts"]), pa.binary())], np.uint32)
    level = max(8.0, 2.0 * sum(int(counts(row).sum(dtype=np.int64)) for row in rows) / size)
    out = np.zeros((SKETCH_PARTS, size // SKETCH_PARTS), np.uint8)
    for row in rows:
        own = counts(row)
        for power in range(32):
            out[row["part"]] += own >= level * (2.0**power)
    return out.ravel()


def prefix_size(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Tokens of which a linked set shares one: n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def place_in(tokens: np.ndarray, order: int) -> np.ndarray:
    """59 bits: the place of tokens among equally common ones."""
    return mixed(tokens + np.uint64((order + 1) * int(_SALTS[0]) % (1 << 64))) >> np.uint64(5)


# ---- documents --------------------------------------------------------------


def prefixes(tokens: np.ndarray, at: np.ndarray, order: int, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of every row under an order; where rows begin in it."""
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(tokens)) - np.repeat(at[:-1], size)
    key = place_in(tokens, order) | (common[counter(tokens, len(common))].astype(np.uint64) << np.uint64(59))
    first = place < prefix_size(size, percent)[row]
    return tokens[np.lexsort((key, row))[first]], np.r_[0, np.cumsum(np.where(size > 0, prefix_size(size, percent), 0))]


def described(k: int, percent: int, common):
    """(id, text, keys) to (id, keys, node, n, bits, prefix under the first order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bits, prefix = [], [], [], []
            for block in blocks(batch.column(1)):
                tokens, at = shingle_sets(block, k)
                chosen, of = prefixes(tokens, at, ORDERS[0], percent, common.value)
                for i, j, p, q in zip(at[:-1].tolist(), at[1:].tolist(), of[:-1].tolist(), of[1:].tolist(), strict=True):
                    own = tokens[i:j]
                    nodes.append(digest(own) if j > i else None)
                    bits.append(bitmap(own) if j > i else None)
                    prefix.append(chosen[p:q].tobytes() if j > i else None)
                    sizes.append(j - i)
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefix, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns], ["_id", "_key_1", "_key_2", "node", "n", "bits", "prefix"])

    return run


def posting_blobs(groups: int):
    """Task side: (node, prefix) to (token, node), combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            node, prefix = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            token = np.frombuffer(b"".join(prefix), np.uint64)
            held.append((token, np.repeat(node, [len(x) // 8 for x in prefix])))
            n += len(token)
            if n >= TOKENS_AT_ONCE:
                yield combined(held, groups)
                held, n = [], 0
        if n:
            yield combined(held, groups)

    return run


def members_of_lists(groups: int):
    """Group side: (token, node) of the tokens that two nodes hold."""

    def run(table: pa.Table) -> pa.Table:
        token, node = repeated_keys(table, groups)
        return pa.table({"token": pa.array(token.view(np.int64)), "node": pa.array(node, pa.int64())})

    return run


# ---- candidates -------------------------------------------------------------


class Forest:
    """Components as they would be if all pairs accepted so far were links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            higher = self.up[self.up]
            if (higher == self.up).all():
                return higher
            self.up = higher

    def accept(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs in their order, those of a spanning forest (Boruvka)."""
        accepted, live, none = np.zeros(len(a), bool), np.arange(len(a)), len(a)
        while True:
            root = self.roots()
            live = live[root[a[live]] != root[b[live]]]
            if not len(live):
                return accepted
            nearest = np.full(len(root), none)
            np.minimum.at(nearest, root[a[live]], live)
            np.minimum.at(nearest, root[b[live]], live)
            for pair in np.unique(nearest[nearest < none]).tolist():
                x, y = a[pair], b[pair]
                while self.up[x] != x:
                    x = self.up[x]
                while self.up[y] != y:
                    y = self.up[y]
                if x != y:
                    self.up[max(x, y)] = min(x, y)
                    accepted[pair] = True


def pairs_in(at: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within stretches, in portions."""
    for n in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(n, 1)
        own = at[size == n]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for s in range(0, len(own), step):
            yield (own[s : s + step, None] + i).ravel(), (own[s : s + step, None] + j).ravel()


class Bitmaps:
    """Bitmaps of rows, by size, with the distances of pairs of rows."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(x) for x in raw], np.int64)
        self.place = np.zeros(len(raw), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == size)
            self.place[own] = np.arange(len(own))
            self.rows[size] = np.frombuffer(b"".join(raw[i] for i in own.tolist()), np.uint8).reshape(-1, size)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lower bounds of symmetric differences; the larger bitmap is folded."""
        out = np.zeros(len(i), np.int64)
        swap = self.size[i] > self.size[j]
        low, high = np.where(swap, j, i), np.where(swap, i, j)
        for other in self.rows:
            against = self.rows[other]
            for size in sorted((x for x in self.rows if x <= other), reverse=True):
                own = np.flatnonzero((self.size[low] == size) & (self.size[high] == other))
                if not len(own):
                    continue
                while against.shape[1] > size:
                    against = folded(against)
                step = max(1, (4 << 20) // size)
                for s in range(0, len(own), step):
                    some = own[s : s + step]
                    differ = self.rows[size][self.place[low[some]]] ^ against[self.place[high[some]]]
                    out[some] = np.bitwise_count(differ.view(np.uint64)).sum(axis=1, dtype=np.int64)
        return out


def forest_pairs(percent: int, layers: int):
    """(token, block, side, node, comp, n, bits) to rows (token, a, b, apart):
    pairs of forests, and (token, null, null, null) for lists with more pairs
    that may link.  Rows of a block are compared with each other if one has
    side 1 (outlier) or 2 (both), and the other 0 (member) or 2."""

    def run(table: pa.Table) -> pa.Table:
        token, block, side, node, comp, n = (table[c].to_numpy() for c in ("token", "block", "side", "node", "comp", "n"))
        order = np.lexsort((node, block, token))
        token, block, side, node, comp, n = (x[order] for x in (token, block, side, node, comp, n))
        raw = table["bits"].to_pylist()
        bitmaps = Bitmaps([raw[i] for i in order.tolist()])
        labels, comp = np.unique(comp, return_inverse=True)
        forests = [Forest(len(labels)) for _ in range(layers)]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        more: list[np.ndarray] = []
        for i, j in pairs_in(heads(token, block), runs_of(token, block)):
            ok = (comp[i] != comp[j]) & (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
            ok &= ((side[i] > 0) & (side[j] != 1)) | ((side[j] > 0) & (side[i] != 1))
            i, j = i[ok], j[ok]
            # what the last forest connects, all forests connect
            root = forests[-1].roots()
            through = root[comp[i]] == root[comp[j]]
            more.append(np.unique(token[i[through]]))
            i, j = i[~through], j[~through]
            apart = bitmaps.apart(i, j)
            may = may_link(apart, n[i] + n[j], percent)
            i, j, apart = i[may], j[may], apart[may]
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            nearest = np.lexsort((token[i], b, a, apart))
            nearest = nearest[heads(apart[nearest], a[nearest], b[nearest])]
            i, j, a, b, apart = i[nearest], j[nearest], a[nearest], b[nearest], apart[nearest]
            left = np.ones(len(i), bool)
            for forest in forests:
                own = np.flatnonzero(left)
                sent = own[forest.accept(comp[i[own]], comp[j[own]])]
                found.append((a[sent], b[sent], apart[sent]))
                left[sent] = False
            more.append(np.unique(token[i[left]]))
        a, b, apart = (np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in range(3))
        again = np.unique(np.concatenate(more)) if more else np.zeros(0, np.int64)
        none = pa.nulls(len(again), pa.int64())
        column = lambda x: pa.concat_arrays([pa.array(x, pa.int64()), none])
        return pa.table({"token": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(again, pa.int64())]), "a": column(a), "b": column(b), "apart": column(apart)})

    return run


PROPOSED = "token long, a long, b long, apart long"


def united(rows: DataFrame) -> DataFrame:
    """(token, node) to (token, node, size) with one token for lists of nearly
    the same members: those that agree in two min-hashes of their members.
    Near copies share most of their tokens, so that such lists would compare
    the same pairs again and again; a union holds every pair of its lists."""
    least = [F.min(F.xxhash64(F.lit(seed), "node")).alias(f"least_{seed}") for seed in (1, 2)]
    lists = rows.groupBy("token").agg(*least)
    names = lists.join(lists.groupBy("least_1", "least_2").agg(F.min("token").alias("name")), ["least_1", "least_2"]).select("token", "name")
    members = cut(rows.join(names, "token").select(F.col("name").alias("token"), "node").distinct())
    return members.join(members.groupBy("token").agg(F.count(F.lit(1)).alias("size")), "token")


def part_of(n: str):
    """The part of a list that a node is in."""
    return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")


def compared(dealt: DataFrame, records: DataFrame, percent: int, layers: int, groups: int) -> DataFrame:
    """Proposals from rows (token, block, side, node, comp)."""
    rows = dealt.join(records.select("node", "n", "bits"), "node")
    return cut(
        rows.withColumn("_g", F.pmod(F.xxhash64("token", "block"), F.lit(groups)))
        .select("_g", "token", "block", "side", "node", "comp", "n", "bits")
        .groupBy("_g")
        .applyInArrow(lambda table: forest_pairs(percent, layers)(table), PROPOSED)
    )


def first_round(members: DataFrame, records: DataFrame, percent: int, groups: int, part: int) -> DataFrame:
    """Proposals from every part of every list."""
    dealt = members.withColumn("parts", F.ceil(F.col("size") / part)).withColumn("block", part_of("parts").cast("long"))
    return compared(dealt.select("token", "block", F.lit(2).alias("side"), "node", F.col("node").alias("comp")), records, percent, 1, groups)


def next_round(members: DataFrame, todo: DataFrame, labels: DataFrame, records: DataFrame, percent: int, layers: int, groups: int, part: int) -> DataFrame:
    """Proposals from the lists ``todo`` that have several components: members
    outside the main one against all, in blocks of parts on both sides."""
    own = members.join(todo, "token", "left_semi").join(labels, "node", "left")
    own = own.select("token", "node", "size", F.coalesce("component", "node").alias("comp"))
    main = own.groupBy("token", "size", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("token", "size").agg(F.max(F.struct("n", "comp")).alias("m")).where("m.n < size")
    main = main.select("token", F.col("m.comp").alias("main"), *(F.ceil(n / part).cast("int").alias(x) for n, x in ((F.col("size"), "parts"), (F.col("size") - F.col("m.n"), "outer"))))
    both = own.join(main, "token").withColumns({"out": F.col("comp") != F.col("main"), "mine": part_of("parts"), "row": part_of("outer")})
    block = lambda i, j: (F.col(i).cast("long") * F.col("parts") + F.col(j)).alias("block")
    others = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).select("token", block("i", "mine"), F.lit(0).alias("side"), "node", "comp")
    outer = both.where("out").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("token", block("row", "j"), F.lit(1).alias("side"), "node", "comp")
    return compared(others.unionByName(outer), records, percent, layers, groups)


# ---- verification -----------------------------------------------------------


def token_sets(k: int, percent: int, common):
    """(node, zipped text) to (node, tokens as 8-byte values, prefixes under
    the further orders).  Rows that share an id may have other sets; the
    digest tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for block in blocks(unzipped(batch.column(1))):
                tokens, at = shingle_sets(block, k)
                further = [prefixes(tokens, at, order, percent, common.value) for order in ORDERS[1:]]
                for row, node in enumerate(names[block.first : block.last]):
                    own = tokens[at[row] : at[row + 1]]
                    if digest(own) == node:
                        out.append((node, own.tobytes(), *(chosen[of[row] : of[row + 1]].tobytes() for chosen, of in further)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.binary()] * 3], strict=True)], ["node", "tokens", "p1", "p2"])

    return run


def common_tokens(x: bytes, y: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))


def shared_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, p1 and p2 of a, p1 and p2 of b) to the pairs with a common
    prefix token under each further order."""
    for batch in batches:
        sides = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
        yield batch.select([0, 1]).filter(pa.array([bool(common_tokens(x1, y1) and common_tokens(x2, y2)) for x1, x2, y1, y2 in sides], pa.bool_()))


def verification(percent: int):
    """(a, b, tokens_a, tokens_b) to the linked pairs."""

    def linked(x: bytes, y: bytes) -> bool:
        n, m = len(x) // 8, len(y) // 8
        shared = common_tokens(x, y)
        return 100 * shared >= percent * (n + m - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class Links:
    """Components of the links verified so far."""

    def __init__(self, none: DataFrame, verify):
        self.tested = none
        self.verify = verify
        self.labels = none.select(F.col("a").alias("node"), F.col("b").alias("component"))
        self.n_tested = 0

    def named(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with the components of both sides."""
        side = lambda x: self.labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return both.withColumns({"c_a": F.coalesce("c_a", "a"), "c_b": F.coalesce("c_b", "b")})

    def open(self, pool: DataFrame) -> DataFrame:
        """Pairs of the pool between components, not tested before."""
        fresh = pool.join(self.tested, ["a", "b"], "left_anti")
        return self.named(fresh).where("c_a <> c_b").select("a", "b", "apart")

    def test(self, pairs: DataFrame, n: int) -> None:
        """Only the graph between components grows: its own components rename
        those so far."""
        self.n_tested += n
        self.tested = cut(slim(self.tested.unionByName(pairs), self.n_tested))
        links = slim(self.named(slim(self.verify(pairs), n)).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")), n)
        found = components(links)
        renamed = found.select(F.col("node").alias("component"), F.col("component").alias("new"))
        old = self.labels.join(renamed, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        # every node was in a tested pair
        self.labels = cut(slim(old.unionByName(found.join(self.labels, "node", "left_anti")), 2 * self.n_tested))

    def settle(self, pool: DataFrame, nearest_first: bool) -> None:
        """Verifies pairs until none is left between components.  A node's
        nearest partner may go first: what that connects needs no more tests,
        so a group costs about as many verifications as it has members."""
        for nearest in (True, False) if nearest_first else (False,):
            pairs = self.open(pool)
            if nearest:
                pairs = pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a"))
            pairs = cut(pairs.select("a", "b"))
            if n := pairs.count():
                self.test(slim(pairs, n), n)


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, part: int = PART) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    return joined(docs, id_col, text_col, k, percent, part).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("_least", "_id").alias("component_id"))


def row_keys(id_col: str, text_col: str) -> list:
    """128 bits that rows of equal id and text share."""
    return [F.xxhash64(F.lit(seed), F.col(id_col).isNull(), F.col(id_col), F.col(text_col)).alias(f"_key_{seed}") for seed in (1, 2)]


def joined(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, part: int = PART) -> DataFrame:
    """(_id, _key_1, _key_2, n, _group, _least) for every row: its component,
    which is null without words, and the least id there.  A row without an id
    is in the component of equal sets, but connects nothing."""
    spark = docs.sparkSession
    prepare(spark)
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *row_keys(id_col, text_col))
    # a word has six bytes or so
    total = (own.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // 6
    common = spark.sparkContext.broadcast(commonness(own.where("_text is not null").select("_text"), k, 1 << sketch_bits(total)))
    documents = cut(own.mapInArrow(described(k, percent, common), f"_id {kind}, _key_1 long, _key_2 long, node long, n long, bits binary, prefix binary"))
    named = documents.where("node is not null and _id is not null")
    groups = max(48, -(-total * 8 // GROUP_BYTES))
    listed = cut(
        named.select("node", "prefix")
        .mapInArrow(posting_blobs(groups), "g int, a binary, d binary, s binary")
        .groupBy("g")
        .applyInArrow(members_of_lists(groups), "token long, node long")
        .distinct()
    )
    members = cut(united(listed))
    records = named.select("_id", "node", "n", "bits").join(listed.select("node").distinct(), "node").groupBy("node").agg(F.min("_id").alias("keeper"), F.first(F.struct("n", "bits")).alias("r"))
    records = cut(records.select("node", "keeper", "r.*"))
    held = members.join(records.select("node", F.octet_length("bits").alias("bytes")), "node").agg(F.sum("bytes")).first()[0] or 0
    groups = max(48, -(-held // BLOCK_BYTES))
    proposed = first_round(members, records, percent, groups, part)
    flagged = lambda rows: rows.where("a is null").select("token").distinct()
    todo = cut(flagged(proposed).unionByName(members.where(F.col("size") > part).select("token")).distinct())
    # one document stands for all of a node
    wanted = proposed.where("a is not null").select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.join(todo, "token", "left_semi").select("node")).distinct()
    keepers = cut(records.join(wanted, "node", "left_semi").select("node", F.col("keeper").alias("_id")))
    if kind not in ("string", "binary") and keepers.count() <= BROADCAST_ROWS:  # picked where they are read
        picked = zipped(own.join(F.broadcast(keepers), "_id").select("node", "_text"), "_text")
    else:
        picked = zipped(own, "_text").join(keepers, "_id").select("node", "_text")
    sets = picked.mapInArrow(token_sets(k, percent, common), "node long, tokens binary, p1 binary, p2 binary")
    sets = cut(sets.groupBy("node").agg(F.first(F.struct("tokens", "p1", "p2")).alias("s")).select("node", "s.*"))
    of = lambda table, x, *columns: table.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(of(sets, "a", "p1", "p2"), "a").join(of(sets, "b", "p1", "p2"), "b")
        passed = both.select("a", "b", "p1_a", "p2_a", "p1_b", "p2_b").mapInArrow(shared_prefixes, "a long, b long")
        whole = passed.join(of(sets, "a", "tokens"), "a").join(of(sets, "b", "tokens"), "b")
        return cut(whole.select("a", "b", "tokens_a", "tokens_b").mapInArrow(verification(percent), "a long, b long"))

    graph = Links(proposed.select("a", "b").limit(0), verify)
    pool = lambda rows: rows.where("a is not null").groupBy("a", "b").agg(F.min("apart").alias("apart"))
    graph.settle(pool(proposed), True)
    layers = 1
    while not todo.isEmpty():
        proposed = next_round(members, todo, graph.labels, records, percent, layers, groups, part)
        graph.settle(pool(proposed), layers == 1)
        todo, layers = cut(flagged(proposed)), layers * MORE
    labels = documents.select("_id", "_key_1", "_key_2", "n", "node").join(graph.labels, "node", "left")
    grouped = labels.select("_id", "_key_1", "_key_2", "n", F.coalesce("component", "node").alias("_group"))
    least = grouped.where("_group is not null and _id is not null").groupBy(F.col("_group").alias("_of")).agg(F.min("_id").alias("_least"))
    return grouped.join(least, (F.col("_group") == F.col("_of")) & F.col("_id").isNotNull(), "left").drop("_of")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays: the one of the least id, ids
    before nulls; of rows that share it one by a digest of the text, and one
    of equal rows.  Documents without words stay."""
    labels = joined(docs, id_col, text_col, k, percent)
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_key_1", "_key_2")).alias("w")
    winners = labels.where("_group is not null").groupBy("_group").agg(first).select("w._key_1", "w._key_2", F.lit(True).alias("_single"))
    wordless = labels.where("_group is null").select("_key_1", "_key_2", F.lit(False).alias("_single")).distinct()
    keyed = docs.select("*", *row_keys(id_col, text_col))
    kept = zipped(keyed, text_col).join(winners.unionByName(wordless), ["_key_1", "_key_2"])
    # equal rows lie side by side behind the join
    place = F.row_number().over(Window.partitionBy("_key_1", "_key_2").orderBy("_key_1"))
    kept = kept.withColumn("_place", place).where(~F.col("_single") | (F.col("_place") == 1)).select(*docs.columns)
    at = docs.columns.index(text_col)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, text_col, unzipped(batch.column(at)))

    return kept.mapInArrow(expand, docs.schema)
