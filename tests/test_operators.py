from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldspark import schema
from foldspark.functions import scalar as S
from foldspark.operators import align, assembly, boosting, contacts, evaluation, graph, kernels, learning, metrics, placement, projection, running, sequence, spatial, split
from foldspark.sources import tables


def test_leading_int_and_ids(spark):
    rows = spark.createDataFrame([("157A",), ("-5",), ("x",), (None,)], "t string").select(S.leading_int(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [157, -5, None, None]
    row = spark.createDataFrame([(" 1abc",)], "t string").select(S.normal_id(F.col("t")).alias("a"), S.without_last_part(F.lit("a_b_c")).alias("b")).first()
    assert (row["a"], row["b"]) == ("1ABC", "a_b")


def test_clean_zeroes_all_three(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.5,)], "x double").select(S.clean(F.col("x")).alias("x")).collect()
    assert [r["x"] for r in rows] == [0.0, 0.0, 0.0, 2.5]


def test_residue_functions(spark):
    df = spark.createDataFrame([("H", "MSE"), ("H", "HOH"), ("", "GLY"), ("", "XXX")], "het string, resname string")
    assert [r[0] for r in df.select(S.is_residue(F.col("het"), F.col("resname"))).collect()] == [True, False, True, False]
    row = df.where("resname = 'GLY'").select(*S.physical(F.col("resname")), *S.index_columns(F.col("resname"))).first()
    assert row["glycine"] == 1.0 and row["hydrophobicity"] == pytest.approx((4.5 - 0.4) / 9) and row["vdw_volume"] == 0.0


def test_aligned_takes_the_last_duplicate_and_fills(spark):
    base = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A")], "n int, c string")
    right = spark.createDataFrame([(1, "A", 5.0, 1), (1, "A", 7.0, 2)], "n int, c string, x double, ord int")
    rows = align.aligned(base, right, ["n", "c"], {"x": 0.0}, order="ord").orderBy("n").collect()
    assert [r["x"] for r in rows] == [7.0, 7.0, 0.0]


def test_assembled_fills_whole_entities_that_do_not_fit(spark):
    base = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "e string, i int")
    block = spark.createDataFrame([("p", 1, 3.0), ("q", 1, 4.0)], "e string, i int, x double")
    rows = align.assembled(base, {"b": (block, {"x": 0.0})}, ["e", "i"], "e").orderBy("e", "i").collect()
    assert [(r["x"], r["has_b"]) for r in rows] == [(0.0, False), (0.0, False), (4.0, True)]


def test_assembled_takes_the_last_of_repeated_keys_and_adds_no_rows(spark):
    base = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1), ("q", 2), ("r", 1), ("r", 1), (None, 1)], "e string, i int")
    # p: a repeated key and a missing one; q: a repeated key, all there; r: a repeated base row and a foreign key
    rows = [("p", 1, 1.0, 1), ("p", 1, 2.0, 2), ("q", 1, 3.0, 2), ("q", 1, 4.0, 1), ("q", 2, None, 1), ("r", 1, 5.0, 1), ("r", 9, 6.0, 1)]
    block = spark.createDataFrame(rows, "e string, i int, x double, ord int")
    other = spark.createDataFrame([("r", 1, 7.0)], "e string, i int, y double")
    out = align.assembled(base, {"b": (block, {"x": 0.0}), "c": (other.withColumn("ord", F.lit(0)), {"y": -1.0})}, ["e", "i"], "e", order="ord")
    got = sorted((str(r["e"]), r["i"], r["x"], r["has_b"], r["y"], r["has_c"]) for r in out.collect())
    assert got == [
        ("None", 1, 0.0, False, -1.0, False), ("p", 1, 0.0, False, -1.0, False), ("p", 2, 0.0, False, -1.0, False), ("q", 1, 3.0, True, -1.0, False),
        ("q", 2, 0.0, True, -1.0, False), ("r", 1, 0.0, False, 7.0, True), ("r", 1, 0.0, False, 7.0, True),
    ]


def test_assembly_reads_each_block_once(spark):
    base = spark.range(10).select((F.col("id") % 2).alias("e"), F.col("id").alias("i"))
    blocks = {n: (base.withColumn(f"{n}_x", F.lit(1.0)), {f"{n}_x": 0.0}) for n in "abcdefgh"}
    plan = align.assembled(base, blocks, ["i"], "e")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2 + plan.count("AdaptiveSparkPlan") and plan.count("Union") <= 2


def test_side_chain_centre_of_alternate_locations(spark):
    atoms = [("GLY", 1, "CA", 1.0, 0.4, 0), ("GLY", 1, "CA", 2.0, 0.6, 1), ("SER", 2, "CB", 4.0, 0.5, 2), ("SER", 2, "CB", 6.0, 0.5, 3), ("SER", 2, "OG", 8.0, 1.0, 4)]
    df = spark.createDataFrame(atoms, "resname string, resnum int, atom string, x double, occupancy double, ord int").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    for n in (1, 3):
        got = {r["resnum"]: r["x"] for r in contacts.side_chain_centre(df.repartition(n), ["resname", "resnum"]).collect()}
        assert got == {1: 2.0, 2: 6.0}


def test_similar_pairs_of_repeated_rows(spark):
    text = "one two three four five six seven"
    a = spark.createDataFrame([(1, text), (1, text), (2, text + " eight nine"), (3, None), (4, "one two")], "id long, text string")
    b = spark.createDataFrame([(7, text), (7, text)], "id long, text string")
    got = {(r["id_a"], r["id_b"]): r["distance"] for r in split.similar_pairs(a, b, "text", ("id", "id")).collect()}
    assert got == {(1, 7): 0.0, (2, 7): pytest.approx(1 - 5 / 7)}


def test_class_weight(spark):
    df = spark.createDataFrame([(1,)] * 4 + [(0,)] * 36, "t int")
    assert learning.class_weight(df, "t") == 3.0 and learning.class_weight(df.where("t = 0"), "t") == 1.0


def test_not_done_respects_versions(spark):
    todo = spark.createDataFrame([(1,), (2,)], "k int")
    done = spark.createDataFrame([(1, "old")], "k int, version string")
    assert align.not_done(todo, done, ["k"], "new").count() == 2
    assert align.not_done(todo, done, ["k"], "old").count() == 1


def test_grid_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    xyz = rng.uniform(-3, 3, (300, 3))
    xyz[:40] = np.round(xyz[:40])  # on cell borders
    xyz[40:45] = 9.0  # coincident
    df = spark.createDataFrame([(i % 2, i, *map(float, p)) for i, p in enumerate(xyz)], "e int, id int, x double, y double, z double")
    for inclusive in (False, True):
        got = {(r["i"], r["j"]) for r in spatial.pairs_within(df, "e", "id", ["x", "y", "z"], 1.0, inclusive=inclusive).collect()}
        d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
        near = d <= 1.0 if inclusive else d < 1.0
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if near[i, j] and i % 2 == j % 2}
        assert got == want


def test_window_starts(spark):
    for n in (10, 1022, 1023, 1534, 1535, 5000):
        got = spark.range(1).select(sequence.window_starts(F.lit(n), 1022, 512).alias("s")).first()["s"]
        want = 1 if n <= 1022 else -(-(n - 1022) // 512) + 1
        assert len(got) == want and got[-1] + 1022 >= n


def test_split_by_lengths(spark):
    flat = spark.createDataFrame([("p", k) for k in range(5)] + [("q", 0)], "e string, at int")
    lengths = spark.createDataFrame([("p", 0, "A", 2), ("p", 1, "B", 3), ("q", 0, "A", 2)], "e string, ord int, chain string, n int")
    rows = sequence.split_by_lengths(flat, lengths, "e", "chain", "ord", "n", "at").orderBy("at").collect()
    assert [(r["chain"], r["pos"]) for r in rows] == [("A", 0), ("A", 1), ("B", 0), ("B", 1), ("B", 2)]


def test_running_totals_do_not_depend_on_buckets(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("s"), (F.col("id") % 7).alias("v"))
    one = {tuple(r) for r in running.running_totals(df, ["g"], "s", ["v"], 1).collect()}
    assert one == {tuple(r) for r in running.running_totals(df, ["g"], "s", ["v"], 16).collect()}


def test_running_totals_over_two_thousand_ranges(spark):
    """One group in half of all ranges, and no expression that grows with them."""
    df = spark.range(8000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 50).alias("g"), F.col("id").cast("double").alias("s"), (F.col("id") % 7).alias("v"))
    out = running.running_totals(df, ["g"], "s", ["v"], 2000)
    got = {(r["g"], r["s"]): r["before_v"] for r in out.collect()}
    total: dict[int, int] = {}
    for i in range(7999, -1, -1):
        g = -1 if i % 2 == 0 else i % 50
        assert got[g, float(i)] == total.get(g, 0)
        total[g] = total.get(g, 0) + i % 7
    assert len(out._jdf.queryExecution().toString()) < 50_000


def test_rankings_by_strata_and_levels_equal_those_of_expanded_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(float(i), float(s), int(t), "ab"[int(g)]) for i, s, t, g in zip(rng.random(400), rng.integers(0, 40, 400), rng.integers(0, 2, 400), rng.integers(0, 2, 400), strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1, "a")], "near double, s double, t int, g string")
    got = {r["stratum"]: tuple(r)[1:] for r in metrics.nested_strata(df, "near", [0.9, 0.3, 0.6], "s", "t", 3).collect()}
    for limit in (0.3, 0.6, 0.9):
        own = df.where(F.col("near") < limit).withColumn("stratum", F.lit(limit))
        assert got[limit] == pytest.approx(tuple(metrics.ranking(own, ["stratum"], "s", "t").first())[1:])
    levels = {(r["level"], r["g"]): r["auroc"] for r in metrics.rolled_up(df, [["g"], []], "s", "t").collect()}
    assert levels[1, None] == pytest.approx(metrics.ranking(df.withColumn("x", F.lit(0)), ["x"], "s", "t").first()["auroc"])
    assert {k for k in levels} == {(0, "a"), (0, "b"), (1, None)}


def test_ranking_flips_with_the_score(spark):
    rng = np.random.default_rng(2)
    rows = [(int(t), float(s)) for t, s in zip(rng.integers(0, 2, 200), rng.permutation(200), strict=True)]
    df = spark.createDataFrame(rows, "t int, s double").withColumn("g", F.lit("a"))
    a = metrics.ranking(df, ["g"], "s", "t").first()["auroc"]
    b = metrics.ranking(df.withColumn("s", -F.col("s")), ["g"], "s", "t").first()["auroc"]
    assert a + b == pytest.approx(1.0)


def test_single_class_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.6), ("b", 1, 0.5), ("b", 0, 0.5)], "g string, t int, s double")
    got = {r["g"]: r for r in metrics.ranking(df, ["g"], "s", "t").collect()}
    assert got["a"]["auroc"] is None and got["a"]["ap"] is None and got["b"]["auroc"] == 0.5 and got["b"]["ap"] == 0.5


@pytest.mark.parametrize(
    ("matrix", "f1", "mcc"),
    [
        ((1130336, 14766, 6380, 12284), 0.537428, 0.537968),
        ((243869, 3847, 2385, 1460), 0.319056, 0.310907),
        ((361322, 6233, 3851, 3997), 0.442195, 0.432635),
        ((1126345, 18757, 55, 18609), 0.664251, 0.698818),
        ((243819, 3897, 2284, 1561), 0.335591, 0.328619),
        ((361592, 5963, 3706, 4142), 0.461427, 0.452211),
        ((0, 0, 0, 0), 0.0, 0.0),
    ],
)
def test_published_confusion_matrices(spark, matrix, f1, mcc):
    made = metrics.threshold_scores(*map(F.lit, matrix))
    row = spark.range(1).select(*(c.alias(n) for n, c in made.items())).first()
    assert row["f1"] == pytest.approx(f1, abs=1e-6) and row["mcc"] == pytest.approx(mcc, abs=1e-6)


def test_ranking_equals_its_definitions(spark):
    """Pairs won with half for ties, and the step-wise area, by brute force."""
    rng = np.random.default_rng(11)
    truth, score = rng.integers(0, 2, 300), np.round(rng.uniform(0, 1, 300), 2)
    df = spark.createDataFrame([("a", int(t), float(s)) for t, s in zip(truth, score, strict=True)], "g string, t int, p double")
    got = metrics.ranking(df, ["g"], "p", "t").first()
    pos, neg = score[truth == 1], score[truth == 0]
    won = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    area = sum((pos == s).sum() / len(pos) * (pos >= s).sum() / (score >= s).sum() for s in np.unique(score))
    assert got["auroc"] == pytest.approx(won) and got["ap"] == pytest.approx(area)
    table = metrics.confusion(df, ["g"], "t", F.col("p") >= 0.4).first()
    assert table["tp"] == (pos >= 0.4).sum() and table["fp"] == (neg >= 0.4).sum()


def test_best_threshold_takes_the_lowest_of_equals(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.4), ("a", 0, 0.3), ("b", 1, 0.5)], "g string, t int, s double")
    got = {r["g"]: r["threshold"] for r in metrics.best_threshold(df, ["g"], "s", "t").collect()}
    assert got == {"a": 0.9, "b": 0.5}
    assert metrics.best_threshold(df, [], "s", "t").count() == 1


def test_side_chain_centres_and_contacts(spark):
    atoms = [("p", 1, "GLY", "CA", 0.0, 0.0, 0.0), ("p", 1, "GLY", "CB", 9.0, 0.0, 0.0), ("p", 2, "ALA", "CB", 2.0, 0.0, 0.0), ("p", 2, "ALA", "HB", 9.0, 9.0, 9.0), ("p", 3, "ALA", "N", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(atoms, "e string, r int, resname string, atom string, x double, y double, z double")
    got = {r["r"]: r["x"] for r in contacts.side_chain_centre(df, ["e", "r", "resname"]).collect()}
    assert got == {1: 0.0, 2: 2.0}
    rows = [("p", i, c, n, "ALA", float(x), 0.0, 0.0) for i, (c, n, x) in enumerate([("A", 1, 0), ("A", 3, 1), ("A", 4, 6.5), ("B", 2, 1)])]
    res = spark.createDataFrame(rows, "e string, id int, chain string, resnum int, resname string, x double, y double, z double")
    pairs = {(r["i"], r["j"]) for r in contacts.contacts(res, "e", "id").collect()}
    assert pairs == {(0, 2), (0, 3), (1, 3), (2, 3)}


def centralities_by_hand(n: int, links: set[tuple[int, int]]) -> tuple[list[float], list[float]]:
    """Breadth-first from each node, with path counts and dependencies."""
    near = {v: set() for v in range(n)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    close, between = [], [0.0] * n
    for s in range(n):
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        r, t = len(order) - 1, sum(dist.values())
        close.append(r / t * r / (n - 1) if t else 0.0)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            between[w] += share[w] if w != s else 0.0
    return close, [b / ((n - 1) * (n - 2)) for b in between]


def test_centralities_equal_searches_by_hand(spark):
    rng = np.random.default_rng(4)
    graphs = {
        "star": (5, {(0, k) for k in range(1, 5)}),
        "path": (4, {(0, 1), (1, 2), (2, 3)}),
        "ring": (5, {(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)}),
        "parts": (9, {(0, 1), (1, 2), (3, 4), (4, 5), (5, 6), (3, 6)}),  # two parts and lone nodes
        "random": (150, {tuple(sorted(map(int, rng.choice(150, 2, replace=False)))) for _ in range(260)}),
        "two": (2, {(0, 1)}),
    }
    nodes = spark.createDataFrame([(e, i) for e, (n, _) in graphs.items() for i in range(n)] + [("bare", i) for i in range(4)], "e string, i int")
    rows = [(e, a, b) for e, (_, links) in graphs.items() for a, b in links]
    edges = spark.createDataFrame([*rows, rows[0], ("star", 2, 2)], "e string, i int, j int")  # a repeated edge and a loop
    got = {(r["e"], r["i"]): r for r in graph.centralities(edges, nodes, "e").collect()}
    assert len(got) == nodes.count()
    for e, (n, links) in graphs.items():
        if e == "two":
            continue
        close, between = centralities_by_hand(n, links)
        assert [got[e, i]["closeness"] for i in range(n)] == pytest.approx(close), e
        assert [got[e, i]["betweenness"] for i in range(n)] == pytest.approx(between), e
    assert {r["status"] for (e, _), r in got.items() if e in ("two", "bare")} == {"too small"}
    # from 60 of 150 sources: the mean error is a small part of the greatest value
    some = {r["i"]: r for r in graph.centralities(edges.where("e = 'random'"), nodes.where("e = 'random'"), "e", exact_up_to=100, pivots=60).collect()}
    exact = np.array(centralities_by_hand(*graphs["random"])[1])
    sampled = np.array([some[i]["betweenness"] for i in range(150)])
    assert {r["status"] for r in some.values()} == {"sampled"} and np.abs(sampled - exact).mean() < 0.1 * exact.max()
    assert np.corrcoef(sampled, exact)[0, 1] > 0.9
    assert graph.centralities(edges.limit(0), nodes.limit(0), "e").count() == 0


def test_graph_tables(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(5)], "e int, i int")
    links = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 0, 2), (0, 2, 3)], "e int, i int, j int")
    deg = {r["i"]: r["degree"] for r in graph.degree(nodes, links, "e").collect()}
    assert sum(deg.values()) == 8 and deg[4] == 0
    clus = {r["i"]: r["clustering"] for r in graph.clustering(nodes, links, "e").collect()}
    assert clus == pytest.approx({0: 1.0, 1: 1.0, 2: 1 / 3, 3: 0.0, 4: 0.0})
    rank = [r["rank"] for r in graph.pagerank(nodes, links, "e", rounds=5).collect()]
    assert sum(rank) == pytest.approx(1.0)


def dense_pagerank(n, links, rounds=1000):
    a = np.zeros((n, n))
    for i, j in links:
        a[i, j] = a[j, i] = 1.0
    k = a.sum(axis=1)
    move = np.where(k[:, None] > 0, a / np.maximum(k, 1)[:, None], 1.0 / n)
    r = np.full(n, 1.0 / n)
    for _ in range(rounds):
        r = 0.15 / n + 0.85 * r @ move
    return r


def test_pagerank_converges(spark):
    path = [(i, i + 1) for i in range(39)]
    star = [(0, i) for i in range(1, 30)] + [(29, 30), (30, 31)]
    sizes = {0: (45, path), 1: (33, star)}  # 5 and 1 nodes without links
    nodes = spark.createDataFrame([(e, i) for e, (n, _) in sizes.items() for i in range(n)], "e int, i int")
    links = spark.createDataFrame([(e, i, j) for e, (_, own) in sizes.items() for i, j in own], "e int, i int, j int")
    got = {(r["e"], r["i"]): r["rank"] for r in graph.pagerank(nodes, links, "e").collect()}
    for e, (n, own) in sizes.items():
        want = dense_pagerank(n, own)
        assert np.abs(np.array([got[e, i] for i in range(n)]) - want).sum() < 1e-6 * n * 0.85 / 0.15
    cut_short = [r["rank"] for r in graph.pagerank(nodes.where("e = 1"), links.where("e = 1"), "e", rounds=4, tolerance=0).orderBy("i").collect()]
    assert np.abs(np.array(cut_short) - dense_pagerank(33, star, 4)).sum() < 1e-12


def test_kernels_on_known_shapes():
    xyz = np.random.default_rng(3).normal(0, 6, (40, 3))
    flow = kernels.transfer_entropy(xyz)
    assert flow[:, 1].sum() == pytest.approx(flow[:, 2].sum()) and np.abs(flow[:, 0]).max() == pytest.approx(1.0)
    fluct = kernels.fluctuations(xyz)
    near = kernels.distances(xyz) <= 10.0
    np.fill_diagonal(near, False)
    kirchhoff = np.diag(near.sum(1).astype(float)) - near
    assert np.allclose(fluct[:, 0], np.diag(np.linalg.pinv(kirchhoff)), atol=1e-6)
    assert (kernels.perturbation_response(xyz)[:, :2] >= 0).all()
    assert kernels.fluctuations(xyz[:4]).sum() == 0
    lone = kernels.accessible_area(np.zeros((1, 3)), np.array([1.6]))
    assert lone[0] == pytest.approx(4 * np.pi * 9)
    two = kernels.accessible_area(np.array([[0.0, 0, 0], [0.5, 0, 0]]), np.array([1.6, 1.6]))
    assert (two < lone[0]).all()


def test_an_ideal_helix_is_a_helix():
    k = np.arange(20)
    turn, rise = np.deg2rad(100) * k, 1.5 * k
    at = lambda r, phase, up: np.column_stack([r * np.cos(turn + np.deg2rad(phase)), r * np.sin(turn + np.deg2rad(phase)), rise + up])
    code = kernels.secondary_structure(at(1.55, -27.6, -0.87), at(2.28, 0, 0), at(1.66, 26.3, 1.11), at(1.95, 20.0, 2.30))
    assert (code == "H").sum() >= 12


def test_cluster_split_keeps_clusters_whole(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).alias("c"))
    rows = split.cluster_split(df, "c").collect()
    by = {}
    for r in rows:
        by.setdefault(r["c"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    counts = [next(iter(v)) for v in by.values()]
    assert (counts.count("train"), counts.count("val"), counts.count("test")) == (7, 1, 2)
    numpy_cut = list(split.shuffled_split([str(i) for i in range(10)]).values())
    assert (numpy_cut.count("train"), numpy_cut.count("val"), numpy_cut.count("test")) == (7, 1, 2)


def test_best_hits_first_seen_wins(spark):
    rows = [("1abc_x_A", "t1", 0.5, 1), ("1abc_x_A", "t2", 0.5, 2), ("1abc_x_B", "t3", 0.4, 3)]
    got = split.best_hits(spark.createDataFrame(rows, "query string, target string, fident double, ord int")).first()
    assert (got["pdb_id"], got["max_identity"], got["closest_training_pdb"], got["n_chains_checked"]) == ("1abc_x", 0.5, "t1", 2)


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert learning.fit_scaler(df, ["x"]) == {"x": (2.0, 1.0)}
    assert [r["x"] for r in learning.scaled(df, {"x": (2.0, 1.0)}).collect()] == [-1.0, 1.0]


def test_projection_is_centred(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(5, 1, (60, 4)))], "id int, v array<double>")
    model = projection.fit_projection(df, "v", 2)
    axes = np.array([r["p"] for r in projection.projected(df, "v", model, "p").collect()])
    assert np.allclose(axes.mean(axis=0), 0, atol=1e-9)


def test_trees_stop_where_validation_turns(spark):
    rows = [(i, float(i % 20), int(i % 20 >= 10)) for i in range(200)]
    train = spark.createDataFrame(rows, "id int, x double, t int")
    turned = train.withColumn("t", 1 - F.col("t"))
    model, n = learning.fit_trees(train, turned, ["x"], "t", rounds=30, depth=2, patience=2, columns=1.0, min_child=1.0)
    assert n == len(model.trees) < 5
    whole, m = learning.fit_trees(train, train.limit(0), ["x"], "t", rounds=6, depth=2, patience=2, columns=1.0, min_child=1.0)
    assert m == 6 == len(whole.trees)
    scores = {r["x"]: r["y_prob"] for r in learning.tree_scores(train, whole, ["x"]).collect()}
    assert all((p > 0.5) == (x >= 10) for x, p in scores.items())


def test_boosted_trees_learn_and_their_loss_falls():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    truth = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(np.int64)
    model = boosting.fit(x[:2000], truth[:2000], x[2000:], truth[2000:], rounds=200, depth=4, rate=0.2)
    assert boosting.auroc(truth[2000:], model.probability(x[2000:])) > 0.98
    share = model.importances(5)
    assert share.sum() == pytest.approx(1.0) and set(np.argsort(-share)[:2].tolist()) == {0, 1}
    loss = []
    for n in (1, 5, 20):
        p = boosting.Trees(0.0, model.trees[:n]).probability(x[:2000])
        loss.append(-(truth[:2000] * np.log(p) + (1 - truth[:2000]) * np.log(1 - p)).mean())
    assert loss[0] > loss[1] > loss[2]


def test_a_single_split_is_the_one_of_greatest_gain():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2)).astype(np.float32)
    truth = rng.integers(0, 2, 300)
    tree = boosting.fit(x, truth, x[:0], truth[:0], rounds=1, depth=1, rate=1.0, subsample=1.0, columns=1.0, min_child=5.0, gamma=0.0, lam=2.0, alpha=0.1).trees[0]
    g, h = 0.5 - truth, np.full(300, 0.25)
    part = lambda m: max(0.0, abs(g[m].sum()) - 0.1) ** 2 / (h[m].sum() + 2.0)
    best = -1.0
    for f in range(2):
        for edge in boosting.edges_of(x[:, f]):
            low = x[:, f] < edge
            if min(h[low].sum(), h[~low].sum()) >= 5.0:
                best = max(best, 0.5 * (part(low) + part(~low) - part(np.ones(300, bool))))
    assert tree.gain[0] == pytest.approx(best)
    low = x[:, tree.feature[0]] < tree.threshold[0]
    s = g[low].sum()
    assert tree.value[1] == pytest.approx(-np.sign(s) * max(0.0, abs(s) - 0.1) / (h[low].sum() + 2.0))


def test_metrics_of_trees_equal_the_engine(spark):
    rng = np.random.default_rng(7)
    truth, score = rng.integers(0, 2, 200), np.round(rng.uniform(0, 1, 200), 2)
    df = spark.createDataFrame([("a", int(t), float(s)) for t, s in zip(truth, score, strict=True)], "g string, t int, p double")
    got = metrics.ranking(df, ["g"], "p", "t").first()
    assert boosting.auroc(truth, score) == pytest.approx(got["auroc"]) and boosting.average_precision(truth, score) == pytest.approx(got["ap"])


def test_search_resumes_its_study_and_its_best_trial_is_fitted_again(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), int(a + 0.3 * b > 0)) for i, (a, b) in enumerate(rng.normal(size=(2500, 2)))]
    train = spark.createDataFrame(rows, "id int, x double, y double, t int")
    study = str(tmp_path / "study")
    args = (train, train, ["x", "y"], "t")
    first = learning.search(*args, trials=4, at_once=2, rounds=20, study=study).collect()
    more = learning.search(*args, trials=6, at_once=2, rounds=20, study=study).collect()
    assert more[:4] == first and len(more) == 6 and spark.read.parquet(study).count() == 6
    assert all(3 <= r["depth"] <= 8 and 0.3 <= r["columns"] <= 1 and 1 <= r["weight"] for r in more)
    best = max(more, key=lambda r: (r["ap"], -r["trial"]))
    model, n = learning.retrained(*args, spark.createDataFrame(more), rounds=20)
    assert n == best["n_trees"] == len(model.trees)
    top = learning.importances(train, model, ["x", "y"]).collect()
    assert [r["rank"] for r in top] == [1, 2] and sum(r["importance"] for r in top) == pytest.approx(1.0)


def test_similar_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(7)
    host = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, 60)) for _ in range(30)]
    # passages of a text of 60 words: Jaccard from below 0.2 to 1
    part = [" ".join(t.split()[: 10 + 2 * k % 50]) for k, t in enumerate(host)]
    a = spark.createDataFrame([*enumerate(host), (98, None), (99, "too short")], "x int, text string")
    b = spark.createDataFrame([*enumerate(part), (40, host[0] + " " + host[1])], "y int, text string")
    grams = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}
    own, other = {i: grams(t) for i, t in enumerate(host)}, {i: grams(t) for i, t in enumerate(part)} | {40: grams(host[0] + " " + host[1])}
    apart = {(i, j): 1 - len(x & y) / len(x | y) for i, x in own.items() for j, y in other.items()}
    want = {p: d for p, d in apart.items() if d <= 0.8}
    pairs = split.similar_pairs(a, b, "text", ("x", "y"))
    got = {(r["id_a"], r["id_b"]): r["distance"] for r in pairs.collect()}
    assert got == pytest.approx(want) and 15 < len(want) < len(own) + 2
    parts = {(r["side"], r["id"]): r["component"] for r in split.clusters(pairs).collect()}
    assert parts["a", "0"] == parts["a", "1"] == parts["b", "40"] == 0
    assert {(s, i) for s, i in parts} == {("a", str(i)) for i, _ in want} | {("b", str(j)) for _, j in want}
    chain = spark.createDataFrame([(i, i + d) for i in range(40) for d in (0, 1)] + [(70, 90)], "id_a int, id_b int")
    assert {(r["side"], r["id"]): r["component"] for r in split.clusters(chain).collect()} == {("a", str(i)): 0 for i in range(40)} | {("b", str(i)): 0 for i in range(41)} | {("a", "70"): 70, ("b", "90"): 70}


def test_rounding_to_even_on_the_binary_value(spark):
    rng = np.random.default_rng(9)
    values = [2.675, 0.125, 0.375, -2.5, 2.5, 1.005, 0.45, 1e-9, 12345.6785, -0.00005, 1e17, *rng.uniform(-50, 50, 400).round(4).tolist(), *(k / 32 for k in range(-64, 64))]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for digits in (0, 1, 2, 4):
        got = [tuple(r) for r in df.select("v", S.half_even(F.col("v"), digits).alias("r")).collect()]
        assert all(r == round(v, digits) for v, r in got)


def test_mode_shares_by_a_general_solver():
    k = np.arange(30)
    xyz = np.column_stack([4 * np.cos(1.7 * k), 4 * np.sin(1.7 * k), 1.5 * k])  # a coil: no two modes of one value
    near = np.array([[i != j and np.linalg.norm(xyz[i] - xyz[j]) <= 10 for j in range(30)] for i in range(30)])
    values, vectors = np.linalg.eig(np.diag(near.sum(axis=1)) - near.astype(float))
    order = np.argsort(values.real)[1:]
    assert values.real[order[0]] > 1e-3 and np.diff(values.real[order]).min() > 1e-6
    share = vectors.real[:, order] ** 2 / values.real[order]
    total, slow, fast = share.sum(axis=1), share[:, :3].sum(axis=1), share[:, -2:].sum(axis=1)
    want = np.column_stack([total, slow, fast, 1 / (total + 1e-8), slow / (fast + 1e-8)])
    assert np.allclose(kernels.fluctuations(xyz), want)


def test_transfer_entropy_by_determinants():
    """Ratios of determinants of covariances, element by element."""
    k = np.arange(16)
    xyz = np.column_stack([4 * np.cos(1.7 * k), 4 * np.sin(1.7 * k), 1.5 * k])  # a coil: one connected network
    values, vectors = kernels.modes(xyz, 7.0)
    now = sum(np.outer(v, v) / w for w, v in zip(values, vectors.T, strict=True))
    later = sum(np.outer(v, v) * np.exp(-0.2 * w) / w for w, v in zip(values, vectors.T, strict=True))
    flow = np.zeros((16, 16))
    for i in range(16):
        for j in range(16):
            if i != j:
                pair = np.array([[now[j, j], now[i, j]], [now[i, j], now[i, i]]])
                own = np.array([[now[j, j], later[j, j]], [later[j, j], now[j, j]]])
                three = np.array([[now[j, j], later[j, j], later[i, j]], [later[j, j], now[j, j], now[i, j]], [later[i, j], now[i, j], now[i, i]]])
                flow[i, j] = max(0.0, 0.5 * np.log(np.linalg.det(own) * np.linalg.det(pair) / (now[j, j] * np.linalg.det(three))))
    got = kernels.transfer_entropy(xyz, tau=0.2)
    assert flow.sum() > 0.01 and np.allclose(got[:, 1], flow.sum(axis=1), atol=1e-6) and np.allclose(got[:, 2], flow.sum(axis=0), atol=1e-6)


def test_perturbation_response_by_loops():
    xyz = np.random.default_rng(16).normal(0, 5, (9, 3))
    hessian = np.zeros((27, 27))
    for i in range(9):
        for j in range(9):
            r = xyz[i] - xyz[j]
            if i != j and r @ r <= 225:
                block = np.outer(r, r) / (r @ r)
                hessian[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] -= block
                hessian[3 * i : 3 * i + 3, 3 * i : 3 * i + 3] += block
    cov = np.linalg.pinv(hessian, rcond=1e-9)
    strength = np.array([[(cov[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] ** 2).sum() for j in range(9)] for i in range(9)])
    response = strength / np.diag(strength)[:, None]
    np.fill_diagonal(response, 0.0)
    got = kernels.perturbation_response(xyz)
    assert np.allclose(got[:, 0], response.sum(axis=1) / 8) and np.allclose(got[:, 1], response.sum(axis=0) / 8)


def test_secondary_structure_by_loops():
    """Bonds, turns and bridges written out, on crowded random backbones."""
    seen = set()
    for seed in range(12):
        rng = np.random.default_rng(seed)
        n, ca, c, o = (rng.uniform(0, 6, (18, 3)) for _ in range(4))
        h = n.copy()
        for i in range(1, 18):
            h[i] = n[i] + (c[i - 1] - o[i - 1]) / np.linalg.norm(c[i - 1] - o[i - 1])
        far = lambda a, b: 1 / (np.linalg.norm(a - b) + 1e-9)
        bond = {(i, j) for i in range(1, 18) for j in range(18) if abs(i - j) > 1 and 27.9 * (far(n[i], o[j]) + far(h[i], c[j]) - far(h[i], o[j]) - far(n[i], c[j])) < -0.5}
        want = ["-"] * 18
        for s in range(1, 14):
            if (s + 4, s) in bond and (s + 3, s - 1) in bond:
                want[s : s + 4] = ["H"] * len(want[s : s + 4])
        for i in range(1, 17):
            for j in range(1, 17):
                if abs(i - j) > 2 and want[i] == "-":
                    side = ((j, i - 1) in bond and (i + 1, j) in bond) or ((i, j - 1) in bond and (j + 1, i) in bond)
                    across = ((i, j) in bond and (j, i) in bond) or ((i + 1, j - 1) in bond and (j + 1, i - 1) in bond)
                    if side or across:
                        want[i] = "E"
        assert kernels.secondary_structure(n, ca, c, o).tolist() == want
        seen |= set(want)
    assert seen == {"-", "H", "E"}


def test_projection_equals_the_singular_vectors(spark):
    rng = np.random.default_rng(17)
    v = rng.normal(size=(80, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, v array<double>")
    model = projection.fit_projection(df, "v", 3)
    got = np.array([r["p"] for r in projection.projected(df, "v", model, "p").orderBy("id").collect()])
    centred = v - v.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(centred @ axes[:3].T), atol=1e-8)


def test_kernels_say_what_is_too_small(spark):
    rows = [("a", i, float(i), 0.0, 0.0) for i in range(3)] + [("b", i, float(i), float(i % 3), float(i % 2)) for i in range(9)]
    df = spark.createDataFrame(rows, "e string, i int, x double, y double, z double")
    got = placement.per_entity(df, "e", "i", ["x", "y", "z"], kernels.fluctuations, ["f", "s", "h", "k", "r"], least=5).collect()
    assert {(r["e"], r["status"], r["f"] is None) for r in got} == {("a", "too small", True), ("b", "ok", False)}


def test_nearest_neighbours_equal_brute_force_at_any_density(spark):
    rng = np.random.default_rng(18)
    xyz = np.concatenate([rng.normal(0, 0.01, (60, 3)), rng.uniform(-50, 50, (40, 3)), np.zeros((3, 3))])
    rows = [("a", i, *map(float, p)) for i, p in enumerate(xyz)] + [("b", 0, 0.0, 0.0, 0.0), ("b", 1, 3.0, 4.0, 0.0), ("c", 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "e string, i int, x double, y double, z double")
    got = {(r["e"], r["i"]): r["density"] for r in spatial.packing_density(df, "e", "i", ["x", "y", "z"], 5).collect()}
    d = np.sort(np.linalg.norm(xyz[:, None] - xyz[None], axis=2) + np.diag(np.full(103, np.inf)), axis=1)[:, :5].mean(axis=1)
    want = {("a", i): 1 / (x + 1e-8) for i, x in enumerate(d)} | {("b", i): 1 / (5.0 + 1e-8) for i in (0, 1)}
    assert got == pytest.approx(want)


def test_randomised_axes_equal_the_singular_vectors_of_many_partitions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 40)) * np.r_[9.0, 6.0, 4.0, np.full(37, 0.5)] + 3.0
    table = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*table, (900, None), (901, [1.0]), (902, [None] * 40)], "id int, v array<double>").repartition(70)  # added up in two steps
    model = projection.fit_projection(df, "v", 3)
    centred = x - x.mean(0)
    _, values, rows = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(np.sum(model.axes * rows[:3].T, axis=0)), 1.0, atol=1e-9)
    assert np.allclose(model.variance, values[:3] ** 2 / 599, rtol=1e-9) and model.explained.sum() == pytest.approx((values[:3] ** 2).sum() / (values**2).sum())
    got = {r["id"]: r["p"] for r in projection.projected(df, "v", model, "p").collect()}
    assert got[900] is None and got[901] is None and got[902] is None
    assert np.allclose([got[i] for i in range(600)], centred @ model.axes)


def test_model_report_chooses_the_threshold_on_the_validation_part(spark):
    rng = np.random.default_rng(31)
    rows = [(p, int(t), float(np.clip(0.3 * t + rng.normal(0.4, 0.2), 0, 1))) for p, n in (("train", 200), ("val", 120), ("test", 80)) for t in rng.integers(0, 2, n)]
    df = spark.createDataFrame(rows, "split string, t int, s double")
    got = {r["split"]: r for r in evaluation.model_report(df, "split", "t", "s").collect()}
    val = [(t, s) for p, t, s in rows if p == "val"]

    def f1(at, part):
        tp, fp, fn = (sum(1 for t, s in part if (t, s >= at) == c) for c in ((1, True), (0, True), (1, False)))
        return 2 * tp / (2 * tp + fp + fn)

    best = max(f1(s, val) for _, s in val)
    for part in ("train", "val", "test"):
        own = [(t, s) for p, t, s in rows if p == part]
        assert got[part]["threshold"] == got["val"]["threshold"] and got[part]["f1"] == pytest.approx(f1(got["val"]["threshold"], own))
        assert got[part]["auroc"] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for t, a in own if t for u, b in own if not u]))
        assert got[part]["tn"] + got[part]["fp"] + got[part]["fn"] + got[part]["tp"] == len(own)
    assert got["val"]["f1"] == pytest.approx(best)
    bare = evaluation.model_report(df.where("split = 'test'"), "split", "t", "s").first()
    assert bare["threshold"] is None and bare["f1"] is None and bare["auroc"] == pytest.approx(got["test"]["auroc"])


def test_placement_is_within_four_thirds_of_the_best(spark):
    rng = np.random.default_rng(11)
    costs = [*map(float, rng.integers(1, 40, 300)), 400.0, 390.0, *[25.0] * 5000]  # some large ones, and a hot size
    df = spark.createDataFrame(list(enumerate(costs)), "k int, c double").repartition(4)
    before = placement.RANKED_AT_ONCE
    placement.RANKED_AT_ONCE = 700  # the hot size is ranked by several tasks
    try:
        out = placement.placed(df, "k", F.col("c"), 7).collect()
    finally:
        placement.RANKED_AT_ONCE = before
    assert sorted(r["k"] for r in out) == list(range(len(costs)))
    load = np.zeros(7)
    for r in out:
        load[r["worker"]] += r["c"]
    best = max(sum(costs) / 7, max(costs))
    assert load.max() <= 4 / 3 * best
    few = placement.placed(spark.createDataFrame([(k, c) for k, c in enumerate([9.0, 9.0, 8.0, 3.0, 3.0, 1.0])], "k int, c double"), "k", F.col("c"), 2).collect()
    assert max(sum(r["c"] for r in few if r["worker"] == w) for w in (0, 1)) <= 4 / 3 * 17
    assert placement.placed(df.limit(0), "k", F.col("c"), 3).count() == 0


def test_equal_items_fill_the_least_loaded():
    rng = np.random.default_rng(12)
    for _ in range(200):
        load, cost, count = rng.random(5) * 10, float(rng.random() * 3 + 0.1), int(rng.integers(0, 60))
        own = load.copy()
        for _ in range(count):
            own[np.argmin(own)] += cost
        got = placement.levelled(load, cost, count)
        assert got.sum() == count and (load + got * cost).max() == pytest.approx(max(own.max(), load.max()) if count else load.max())


def test_kernels_run_on_whole_entities_wherever_batches_end(spark):
    rows = [(e, i, float(i), 0.0, 0.0) for e, n in enumerate([1, 40, 3, 500, 7]) for i in range(n)]
    df = spark.createDataFrame(rows, "e int, i int, x double, y double, z double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = placement.per_entity(df, "e", "i", ["x", "y", "z"], lambda xyz: np.full(len(xyz), xyz[:, 0].sum()), ["total"], workers=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["e"], r["i"]): r["total"] for r in got} == {(e, i): float(sum(range(n))) for e, n in enumerate([1, 40, 3, 500, 7]) for i in range(n)}


def density_by_hand(xyz: np.ndarray, k: int) -> np.ndarray:
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2) + np.diag(np.full(len(xyz), np.inf))
    return 1 / (np.sort(d, axis=1)[:, :k].mean(axis=1) + 1e-8)


@pytest.mark.parametrize("dims", [1, 2, 4])
def test_nearest_neighbours_in_any_number_of_dimensions(spark, dims):
    rng = np.random.default_rng(dims)
    xyz = np.concatenate([rng.normal(0, 1, (80, dims)), rng.normal(5, 1e-4, (40, dims)), np.full((9, dims), 7.0)])
    names = [f"x{n}" for n in range(dims)]
    df = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(xyz)] + [("a", 999, *[None] * dims)], f"e string, i int, {', '.join(f'{n} double' for n in names)}")
    got = {r["i"]: r["density"] for r in spatial.packing_density(df, "e", "i", names, 6).collect()}
    assert got == pytest.approx(dict(enumerate(density_by_hand(xyz, 6))))
    assert spatial.packing_density(df.limit(0), "e", "i", names, 6).count() == 0


def test_an_outlier_does_not_make_other_points_look_far(spark):
    rng = np.random.default_rng(9)
    even = rng.uniform(0, 1, (4000, 3))
    far = np.concatenate([even, [[1e5, 0, 0]]])
    compared = {}
    for name, xyz in (("even", even), ("far", far)):
        df = spark.createDataFrame(pd.DataFrame({"e": "a", "i": range(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))
        got = {r["i"]: r["density"] for r in spatial.packing_density(df, "e", "i", ["x", "y", "z"]).collect()}
        assert got == pytest.approx(dict(enumerate(density_by_hand(xyz, 12))))
        places = spatial.with_cells(df.select(F.col("e").alias("_e"), F.array("x", "y", "z").alias("at"), F.array("x", "y", "z").alias("all"), F.lit(1).alias("w")), ["_q0", "_q1", "_q2"])
        todo = places.join(spatial.deepest_levels(places, ["_q0", "_q1", "_q2"], 13), ["_e", "_q0", "_q1", "_q2"])
        joined = spatial.near_places(todo, places, ["_q0", "_q1", "_q2"])
        compared[name] = joined.count()
    assert compared["far"] <= 2 * compared["even"] + 2 * len(far)


def test_data_set_from_blocks_to_files(spark, tmp_path):
    base = spark.createDataFrame([(e, i) for e in "abcdefghij" for i in range(6)], "pdb_id string, resnum int")
    wide = lambda n, drop="": base.where(f"pdb_id <> '{drop}'").select("*", *((F.col("resnum") * (k + 1)).cast("double").alias(f"{n}_{k}") for k in range(4 if n == "frustration" else schema.BLOCKS[n])))
    blocks = {n: wide(n, "b" if n == "energy" else "") for n in schema.BLOCKS if n != "pocket"}
    rows = assembly.assemble(base, blocks, ["pdb_id", "resnum"], "pdb_id")
    got = {(r["pdb_id"], r["resnum"]): r for r in rows.collect()}
    assert len(got) == 60 and got["a", 2]["frustration_3"] == 8.0 and got["a", 2]["frustration_6"] == 0.0
    assert not got["a", 1]["has_pocket"] and not got["b", 1]["has_energy"] and got["b", 3]["energy_1"] == 0.0 and got["a", 3]["energy_1"] == 6.0
    assert {r["pdb_id"] for r in assembly.covered(rows, "pdb_id", 0.8).collect()} == set("acdefghij")
    splits = split.cluster_split(base.select("pdb_id").distinct(), "pdb_id")
    out, metadata = assembly.build(rows, splits, "pdb_id", ["structural_0", "energy_0"])
    assembly.write_dataset(out, metadata, str(tmp_path / "set"))
    back = spark.read.parquet(str(tmp_path / "set/data"))
    assert back.count() == 60 and {r["split"] for r in back.select("split").distinct().collect()} == {"train", "val", "test"}
    held = spark.read.parquet(str(tmp_path / "set/metadata")).first()
    assert held["features"] == ["structural_0", "energy_0"] and held["scaler"][0]["mean"] == 2.5
    plan = tables.read_split(spark, str(tmp_path / "set/data"), "val")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_lift_counts_and_zip(spark):
    table = spark.createDataFrame([("a", 10, 2, 0.5), ("b", 4, 0, None)], "g string, n long, positives long, ap double")
    got = {r["g"]: (r["baseline"], r["lift"]) for r in evaluation.with_baseline(table).collect()}
    assert got == {"a": (0.2, 2.5), "b": (0.0, None)}
    rows = spark.createDataFrame([(x,) for x in (0.1, 0.3, 0.3, 0.9, None)], "v double")
    assert [tuple(r) for r in evaluation.counts_by_threshold(rows, "v", [0.3, 0.5]).collect()] == [(0.3, 1, 3), (0.5, 3, 1)]
    a = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 1, "z")], "e string, o int, t string")
    b = spark.createDataFrame([("p", 5, 0.1), ("p", 9, 0.2), ("q", 1, 0.3), ("q", 2, 0.4), ("r", 1, 0.5)], "e string, k int, s double")
    rows, checked = evaluation.zipped(a, b, "e", ["o"], ["k"], ["s"])
    assert {(r["e"], r["t"], r["s"]) for r in rows.collect()} == {("p", "x", 0.1), ("p", "y", 0.2)}
    assert {tuple(r) for r in checked.collect()} == {("p", 2, 2, "ok"), ("q", 1, 2, "length mismatch"), ("r", 0, 1, "length mismatch")}
    hits = spark.createDataFrame([("p", 0.4), ("p", 0.6)], "e string, max_identity double")
    assert {(r["e"], r["max_identity"]) for r in evaluation.with_homology(a, hits, "e").collect()} == {("p", 0.6), ("q", 0.0)}
    undefined = spark.range(1).select(metrics.threshold_scores(*map(F.lit, (5, 0, 0, 0)), undefined=None)["precision"].alias("p")).first()
    assert undefined["p"] is None
