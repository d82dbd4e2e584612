"""Sequence search and clustering against plain dynamic programming."""

from __future__ import annotations

import random

import numpy as np
import pytest

from foldspark.operators import homology
from foldspark.operators.homology import Scoring

AMINO = "ACDEFGHIKLMNPQRSTVWY"


def plain(a, b, s: Scoring, diagonal: int | None = None) -> dict:
    """Local alignment cell by cell; with a diagonal, inside its band."""
    best = dict(score=0, equal=0, columns=0, a_start=0, a_end=0, b_start=0, b_end=0)
    zero = (0, 0, 0, 0, 0)
    last = {}
    for i, x in enumerate(a):
        row = {}
        for j, y in enumerate(b):
            if diagonal is not None and abs(j - i - diagonal) > s.band:
                continue
            h, e, c, fa, fb = last.get(j - 1, zero)
            if h == 0:
                e, c, fa, fb = 0, 0, i, j
            cell = (h + (s.match if x == y else -s.mismatch), e + (x == y), c + 1, fa, fb)
            for other in (last.get(j, zero), row.get(j - 1, zero)):
                if other[0] - s.gap > cell[0]:
                    cell = (other[0] - s.gap, other[1], other[2] + 1, *other[3:])
            row[j] = cell if cell[0] > 0 else zero
            if row[j][0] > best["score"]:
                best = dict(score=cell[0], equal=cell[1], columns=cell[2], a_start=cell[3], a_end=i + 1, b_start=cell[4], b_end=j + 1)
        last = row
    return best


def mutated(rng: random.Random, seq: str, rate: float) -> str:
    out = []
    for x in seq:
        r = rng.random()
        if r < rate * 0.8:
            out.append(rng.choice(AMINO))
        elif r < rate * 0.9:
            out += [x, rng.choice(AMINO)]
        elif r >= rate:
            out.append(x)
    return "".join(out)


@pytest.fixture(scope="module")
def families() -> list[tuple[int, str]]:
    rng = random.Random(3)
    out = []
    for f in range(12):
        base = "".join(rng.choice(AMINO) for _ in range(rng.randint(60, 160)))
        out += [(100 * f + m, mutated(rng, base, 0.06 * m)) for m in range(5)]
    out += [(5000 + i, "".join(rng.choice(AMINO) for _ in range(80))) for i in range(10)]
    return out


def test_banded_alignment_equals_plain():
    rng = random.Random(1)
    s = Scoring(band=4)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        b = mutated(rng, a, 0.3) if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        pairs.append((a, b, rng.randint(-3, 3)))
    flat = lambda i: np.array([ord(x) for p in pairs for x in p[i]])
    at = lambda i: np.r_[0, np.cumsum([len(p[i]) for p in pairs])]
    got = homology.aligned_pairs(flat(0), at(0), flat(1), at(1), np.array([p[2] for p in pairs]), s)
    for k, (a, b, d) in enumerate(pairs):
        want = plain(a, b, s, d)
        assert {c: int(v[k]) for c, v in got.items()} == want, (a, b, d)


def reach(seqs: dict[int, str], scoring: Scoring) -> dict[tuple[int, int], tuple[float, float, float]]:
    """All pairs, aligned without a band: identity and both coverages."""
    out = {}
    for a in seqs:
        for b in seqs:
            if a < b:
                r = plain(seqs[a], seqs[b], scoring)
                out[a, b] = (r["equal"] / max(1, r["columns"]), (r["a_end"] - r["a_start"]) / len(seqs[a]), (r["b_end"] - r["b_start"]) / len(seqs[b]))
    return out


@pytest.fixture(scope="module")
def truth(families):
    return reach(dict(families), Scoring())


def test_clusters_are_a_set_cover_of_found_links(spark, families, truth):
    rows = [*families, families[7], (9001, families[3][1]), (9002, ""), (9003, None)]  # repeated rows, equal and empty sequences
    df = spark.createDataFrame(rows, "id long, seq string")
    seqs = homology.residues(df, "id", "seq")
    got = dict(homology.sequence_clusters(seqs, k=5, seeds=40).collect())
    assert set(got) == {r[0] for r in rows}
    assert got[9001] == got[families[3][0]] and (got[9002], got[9003]) == (9002, 9003)
    # links are what plain alignment says, and most of its links are kept together
    linked = {(a, b) for (a, b), (i, x, y) in truth.items() if i >= 0.3 and x >= 0.8 and y >= 0.8}
    together = {(a, b) for a, b in truth if got[a] == got[b]}
    assert len(together & linked) >= 0.9 * len(linked)
    links = {tuple(sorted((r["a"], r["b"]))): r for r in homology.cluster_links(seqs, homology.twins(seqs), k=5, seeds=40).collect()}
    assert set(links) <= linked
    seq = dict(families)
    for r in links.values():  # equal scores may lie elsewhere the other way round
        by_hand = plain(seq[r["a"]], seq[r["b"]], Scoring())
        assert (r["score"], r["identity"]) == (by_hand["score"], pytest.approx(by_hand["equal"] / by_hand["columns"]))
    # the greedy cover, one sequence at a time
    length, near = dict((i, len(s)) for i, s in families), {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want: dict[int, int] = {}
    for i in sorted(length, key=lambda x: (-length[x], x)):
        if i not in want:
            want |= {j: i for j in [i, *near.get(i, ())] if j not in want}
    assert {i: got[i] for i in length} == want


@pytest.mark.parametrize("hot,few", [(100_000, 500_000), (3, 0)])
def test_search_finds_the_best_hits_of_plain_alignment(spark, families, truth, hot, few):
    queries = [f for f in families if f[0] % 100 in (1, 3) or f[0] >= 5000]
    targets = [f for f in families if f[0] % 100 in (0, 2, 4) and f[0] < 5000]
    tables = [homology.residues(spark.createDataFrame(x, "id long, seq string"), "id", "seq") for x in (queries, targets)]
    found = {(r["a"], r["b"]): r for r in homology.search(*tables, hot=hot, few=few).collect()}
    seq = dict(families)
    want = {}
    for a, _ in queries:
        for b, _ in targets:
            i, x, y = truth[min(a, b), max(a, b)]
            if x >= 0.8 and y >= 0.8 and i >= 0.3:
                want[a, b] = i
    assert len(found.keys() & want.keys()) >= 0.9 * len(want) > 30
    best = lambda hits: {a: max(b for (x, b), i in hits.items() if x == a and i == max(i for (x, _), i in hits.items() if x == a)) for a, _ in hits}
    by_hand = {p: plain(seq[p[0]], seq[p[1]], Scoring()) for p in found}
    got = {p: r["equal"] / r["columns"] for p, r in by_hand.items()}
    assert {p: r["identity"] for p, r in found.items()} == pytest.approx(got)
    assert best({p: i for p, i in got.items() if p in want}) == best(want)


def test_empty_tables(spark):
    none = homology.residues(spark.createDataFrame([], "id long, seq string"), "id", "seq")
    some = homology.words(spark.createDataFrame([(1, "one two three four five six"), (2, None)], "id long, text string"), "id", "text")
    assert homology.sequence_clusters(none).count() == 0
    assert homology.search(none, none).count() == 0 and homology.search(some, none).count() == 0
    assert dict(homology.sequence_clusters(some).collect()) == {1: 1, 2: 2}


def test_seeds_are_made_once(spark, families):
    """Both readers of the seeds get them kept: neither splits texts again."""
    seqs = homology.residues(spark.createDataFrame(families, "id long, seq string"), "id", "seq")
    pairs = homology.candidate_pairs(seqs, homology.twins(seqs), 5, 40, 0.8)
    assert "xxhash64" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() > 0
