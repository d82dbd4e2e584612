from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldspark.llm import embedding_dedup, language_id
from foldspark.llm import quality_rules as rules
from foldspark.llm.components import components
from foldspark.llm.embedding_dedup import axes_of, near_duplicates, near_leaves, turned, unit
from foldspark.llm.filter_audit import filter_audit
from foldspark.llm.language_id import identify
from foldspark.llm.line_dedup import line_dedup
from foldspark.llm.mixing import mix, mixture
from foldspark.llm.ngram_join import Bitmaps, Forest, bitmap, ngram_join, one_of_each
from foldspark.llm.packing import cutting_stock, pack, whole_patterns
from foldspark.llm.queries import vocabulary
from foldspark.llm.sharding import shard
from foldspark.llm.spelling import spelling_variants
from foldspark.llm.substring_dedup import substring_dedup
from foldspark.llm.suffix_dedup import classes, suffix_dedup
from foldspark.llm.token_counts import Compiled, token_counts
from foldspark.llm.words import _STEPS, mixed
from tests.llm import cases


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.rows(), cases.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(scope="module")
def vocab():
    return vocabulary("word_bpe_49k.json")


PAIRS = [(r[0], r[1]) for r in cases.rows()]


def bag(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def test_line_dedup(docs, empty):
    out = line_dedup(docs)
    assert out.columns == [c for c in docs.columns] + ["n_lines", "n_dropped"]
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256))
    assert bag(got.collect()) == bag(cases.line_dedup(PAIRS))
    assert line_dedup(empty).count() == 0


def test_ngram_join(docs, empty):
    for k, percent in ((4, 85), (5, 80)):
        assert bag(ngram_join(docs, k=k, percent=percent).collect()) == bag(cases.ngram_join(PAIRS, k, percent))
    assert ngram_join(empty).count() == 0


def test_ngram_join_in_a_large_loose_group(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):  # edits of one text: not all pairs link
        own = list(base)
        for p in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            own[p] = f"e{i}x{p}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"u{i}v{j}" for j in range(40)) + " " + " ".join(base[:40])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (1024, 7):  # lists whole, and in parts that meet in later rounds
        assert bag(ngram_join(df, part=part).collect()) == bag(cases.ngram_join(rows, 4, 85))


def test_forests_span_what_may_link_and_no_more():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, 500), rng.integers(60, 120, 500)
    accepted = Forest(120).accept(a, b)
    roots = list(range(120))

    def find(x: int) -> int:
        while roots[x] != x:
            x = roots[x]
        return x

    for x, y, taken in zip(a.tolist(), b.tolist(), accepted.tolist(), strict=True):
        assert taken == (find(x) != find(y))  # the nearest pairs first
        roots[find(x)] = find(y)


def test_bitmaps_bound_the_symmetric_difference():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 40, int(rng.integers(1, 400))).astype(np.uint64)) for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    apart = Bitmaps([bitmap(x) for x in sets]).apart(i, j)
    assert all(d <= len(np.setxor1d(sets[x], sets[y])) for d, x, y in zip(apart.tolist(), i.tolist(), j.tolist(), strict=True))
    assert (Bitmaps([bitmap(x) for x in sets[:1] * 2]).apart(np.array([0]), np.array([1])) == 0).all()


def test_one_of_each_keeps_columns_and_texts(docs, empty):
    kept = one_of_each(docs, k=4, percent=85)
    assert kept.columns == docs.columns
    want = {i for i, _, c in cases.ngram_join(PAIRS, 4, 85) if i == c}
    rows = kept.collect()
    assert bag((r["doc_id"],) for r in rows) == bag((i,) for i in want)  # the repeated row once
    texts = dict(PAIRS)
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)
    assert one_of_each(empty).count() == 0


def test_one_of_each_among_rows_without_ids_or_with_one_id(spark):
    a, b, c = (cases.text_of(seed, 40) for seed in (21, 22, 23))
    rows = [(None, a), (None, a), (None, b), (7, b + " more"), (7, b + " more"), (7, c), (8, c + " z"), (9, None), (None, ""), (None, " ")]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect()
    assert bag(got) == bag([(None, a), (None, b), (7, b + " more"), (7, c), (9, None), (None, ""), (None, " ")])


def test_substring_dedup(docs, empty):
    for k in (13, 5):
        out = substring_dedup(docs, k=k)
        got = out.select("doc_id", F.col("n_words"), "n_removed", F.sha2(F.col("text").cast("binary"), 256))
        assert bag(got.collect()) == bag(cases.substring_dedup(PAIRS, k))
    assert substring_dedup(empty).count() == 0


def test_substring_dedup_on_random_texts(spark):
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(40):
        own = [f"w{rng.integers(0, 6)}" for _ in range(int(rng.integers(5, 60)))]
        at = int(rng.integers(0, len(own)))
        rows.append((int(rng.integers(0, 35)), " ".join(own[:at] + passage[: int(rng.integers(0, 30))] + own[at:])))
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k=6)
    got = got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256))
    assert bag(got.collect()) == bag(cases.substring_dedup(rows, 6))


def test_packing(docs, empty, vocab):
    library = Compiled(vocab).whole
    want = Counter()
    for i, t in PAIRS:
        want[i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    out = pack(docs, vocab, length=64, unit=4).toPandas()
    assert out.length.sum() == sum(len(ids) * n for (_, ids), n in want.items())
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.r_[0, np.cumsum(own.length)[:-1]].tolist() and own.length.sum() <= 64
    assert sorted(out.sequence_id.unique()) == list(range(out.sequence_id.nunique()))
    crcs = Counter()
    for (i, ids), n in want.items():
        for s in range(0, len(ids), 64):
            part = np.array(ids[s : s + 64], "<u4")
            crcs[i if i is not None else -1, s, len(part), cases.crc(part.tobytes()), len(ids)] += n
    got = Counter((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.itertuples())
    assert got == crcs
    assert pack(empty, vocab).count() == 0


def test_patterns_take_every_piece_once():
    rng = np.random.default_rng(7)
    sizes = np.arange(1, 65)
    demand = rng.integers(0, 400, 64)
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    patterns = whole_patterns(sizes, demand, 64)
    assert (sum(p * n for p, n in patterns) == demand).all()
    assert all((p * sizes).sum() <= 64 for p, _ in patterns)
    used = sum(n for _, n in patterns)
    least = sum(n for _, n in cutting_stock(sizes, demand.astype(float), 64, gap=1e-6))
    assert least - 1e-6 <= used <= least * 1.01 + 20


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(12, 16))
    rows = []
    for i in range(300):
        v = centre[i % 12] + rng.normal(scale=rng.choice([0.02, 0.4]), size=16) if i < 150 else rng.normal(size=16)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, [None] + [1.0] * 15, 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, block=32).collect()}
    ok = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links: dict[int, set] = {i: set() for i, _, _ in rows if i is not None}
    for i, a in ok:
        for j, b in ok:
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[i].add(j)
    for i, near in links.items():
        seen, todo = {i}, [i]
        while todo:
            todo += [x for x in links[todo.pop()] - seen if not seen.add(x)]
        assert got[i] == (len(near), min(seen), i == min(seen))
    assert got[None] == (0, None, None)
    assert near_duplicates(df.limit(0)).count() == 0


def test_clustered_vectors_are_mostly_skipped():
    rng = np.random.default_rng(13)
    centre = rng.normal(size=(40, 64)) * np.linspace(3, 0.2, 64)
    points = unit(centre[rng.integers(0, 40, 8192)] + rng.normal(scale=0.05, size=(8192, 64)))
    axes = {64: axes_of(points[:2048])}
    at = turned(points, axes)
    eps = (2 - 2 * 0.95) ** 0.5
    at = at[np.lexsort(np.floor(at[:, :8] / (eps / 2)).T[::-1])]
    near = near_leaves(at, at, eps, True, 64)
    assert near.sum() < 0.15 * 128 * 129 / 2
    # and what is skipped is far apart
    for i, j in zip(*np.nonzero(~near & (np.arange(128)[:, None] < np.arange(128))), strict=True):
        x, y = at[64 * i : 64 * i + 64, :13], at[64 * j : 64 * j + 64, :13]
        assert ((x[:, None] - y[None]) ** 2).sum(axis=2).min() > eps**2


def test_wide_embeddings_are_blocked_by_bytes(spark, monkeypatch):
    rng = np.random.default_rng(15)
    centre = rng.normal(size=(10, 1536))
    own = centre[rng.integers(0, 10, 90)] + rng.normal(scale=0.2, size=(90, 1536))
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 8 * 1536 * 7)  # seven vectors a block
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(df).collect()}
    u = unit(own)
    assert got == dict(enumerate(((u @ u.T) >= 0.95).sum(axis=1) - 1))


def test_embeddings_over_many_leaves_and_blocks(spark):
    rng = np.random.default_rng(14)
    centre = rng.normal(size=(60, 24))
    own = centre[rng.integers(0, 60, 3000)] + rng.normal(scale=0.28, size=(3000, 24))
    own[:300, 20:] = 0
    rows = [(i, [float(x) for x in v[: 20 if i < 300 else 24]]) for i, v in enumerate(own)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=700).collect()}
    u = unit(own)
    linked = u @ u.T >= 0.95
    linked[:300, 300:] = linked[300:, :300] = False
    np.fill_diagonal(linked, False)
    least = np.arange(3000)
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], 3000).min(axis=1))
        if (new == least).all():
            break
        least = new
    assert linked.sum() > 3000
    assert got == {i: (int(n), int(c)) for i, (n, c) in enumerate(zip(linked.sum(axis=1), least, strict=True))}


def test_sharding(docs, empty):
    out = shard(docs, samples=64, ranges=16).toPandas()
    assert len(out) == len(PAIRS) and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    want = Counter((-1 if i is None else i, len((t or "").encode()) + 1, cases.crc((t or "").encode())) for i, t in PAIRS)
    assert Counter((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.size, r.text_crc32) for r in out.itertuples()) == want
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert shard(empty).count() == 0


def test_shards_are_near_equal_with_a_hot_text(spark):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(3000)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() <= 1.02 * loads.mean()
    again = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).toPandas()
    assert out.set_index("doc_id").shard.to_dict() == again.set_index("doc_id").shard.to_dict()


def test_only_a_text_that_is_overfull_itself_is_torn(spark):
    rows = [(i, "hot text " * 20) for i in range(2000)] + [(10_000 + i, f"group {i // 4} " * 15) for i in range(4000)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string"), ranges=32).toPandas()
    torn = out.groupby("text_crc32").shard.nunique()
    assert (torn > 1).sum() == 1 and out["size"].groupby(out.shard).sum().max() <= 1.02 * out["size"].sum() / 8
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_a_hot_text_under_one_id_is_spread_too(spark):
    rows = [(None, "hot text " * 20)] * 1500 + [(5, "warm text " * 20)] * 1500 + [(i, f"text {i} " * 15) for i in range(100, 2100)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() <= 1.03 * loads.mean()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_token_counts(docs, empty, vocab):
    out = token_counts(docs, vocab, limit=100)
    library = Compiled(vocab).whole
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in PAIRS)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out.collect()) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in out.collect())
    assert token_counts(empty, vocab).count() == 0


def test_transducers_equal_the_library_on_odd_texts(vocab):
    rng = np.random.default_rng(9)
    letters = list("abrvlestmd' !.1<|>") + ["é", "İ", "Σ", "́", "１", "　", "🙂", "Å", "'re", "'ll", "<|endoftext|>", "\n", "\x00", "\x85"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 300)))) for _ in range(800)]
    texts.append(" ".join(texts) * 3)
    c = Compiled(vocab)
    for ids, want in zip(c.ids(texts), c.whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids


def test_a_word_of_any_length_equals_the_library(vocab):
    rng = np.random.default_rng(23)
    words = ["".join(rng.choice(list("etaoinshrdlucmfw"), n).tolist()) for n in (1, 2, 7, 400, 200_000)] + ["ab" * 50_000, "e" * 99_999, "é" * 3001]
    c = Compiled(vocab)
    for ids, want in zip(c.ids(words), c.whole.encode_batch(words, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids


def test_texts_of_many_blocks(spark, vocab):
    """Texts above a block's bytes: cut at blanks, or without any blank."""
    rng = np.random.default_rng(19)
    letters = np.array(list("abcdefgh'Éü 1") + ["<|endoftext|>"])
    spaced = "".join(rng.choice(letters, 1_500_000).tolist()) + "\n" + " ".join(f"w{i}" for i in range(60_000))
    solid = "xy" * 700_000
    rows = [(1, spaced), (2, solid), (3, "short one"), (4, spaced)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    library = Compiled(vocab).whole
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, vocab).collect()} == {i: len(x) for i, x in ids.items()}
    pieces = pack(df, vocab).collect()
    assert {(r["doc_id"], r["start"], r["ids_crc32"]) for r in pieces} == {(i, s, cases.crc(np.array([*x, 2][s : s + 4096], "<u4").tobytes())) for i, x in ids.items() for s in range(0, len(x) + 1, 4096)}
    got = line_dedup(df, min_docs=2).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256))
    counted = {i: n for i, n, *_ in got.collect()}
    assert counted == {1: 2, 2: 1, 3: 1, 4: 2}
    assert bag(ngram_join(df).select("doc_id", "component_id").collect()) == bag([(1, 1), (2, 2), (3, 3), (4, 1)])
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup(df).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: len(cases.words(spaced))}


def test_windows_of_many_words(spark):
    rows = [(i, cases.text_of(30 + i // 2, 200) + (" tail" if i % 2 else "")) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(df, k=90).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256))
    assert bag(got.collect()) == bag(cases.substring_dedup(rows, 90))
    assert bag(ngram_join(df, k=70).collect()) == bag(cases.ngram_join(rows, 70, 85))


def test_quality_rules(docs, empty):
    out = rules.document_rules(docs.select("doc_id", "text"))
    got = [tuple(r) for r in out.select("doc_id", *rules.METRICS, "base_failed").collect()]
    assert bag(got) == bag((i, *cases.quality(t)) for i, t in PAIRS)
    judged = rules.quality_rules(docs)
    assert judged.where("source is null and not base_failed and not kept").count() == 0
    assert rules.quality_rules(empty).count() == 0


def test_host_verdicts(spark):
    good, bad = cases.text_of(2, 50), "no"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(100)] + [(200 + i, bad if i % 10 else good, "foul") for i in range(100)] + [(400, good, None), (401, bad, "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in rules.quality_rules(df).where("kept").collect()}
    assert kept == {i for i in range(100) if i % 10} | {400}
    plain = {r["doc_id"] for r in rules.quality_rules(df, broadcast_hosts=1).where("kept").collect()}
    assert plain == kept


def test_host_prior_leaves_out_sampling():
    """Hosts of one failure rate are shrunk hard, those that differ little."""
    rng = np.random.default_rng(12)

    def weight(rates: np.ndarray, n: np.ndarray) -> float:
        f = rng.binomial(n, rates)
        return sum(rules.beta_prior(float(n.sum()), float(f.sum()), float((n * n).sum()), float((f * f / n).sum()), float(len(n)), flat_weight=10.0))

    n = rng.integers(5, 20, 400)
    assert weight(np.full(400, 0.3), n) > 100
    assert weight(rng.beta(1.5, 3.5, 400), n) == pytest.approx(5, rel=0.4)
    assert rules.beta_prior(10.0, 4.0, 100.0, 1.6, 1.0, flat_weight=10.0) == (4.0, 6.0)


def test_language_id(spark, docs, empty):
    rows = [(i, ("der die das und nicht ein schule " if i % 2 else "the and of that with is school ") * (1 + i % 5), "de" if i % 2 else "en") for i in range(120)]
    rows += [(500, None, "de"), (501, "123 !!", "en"), (502, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df, F.col("doc_id") % 4 != 2).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows if i % 4 == 2 and i < 500)
    assert got[500] == got[501] == got[502] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in identify(df, F.lit(False)).collect()} == {"und"}
    assert identify(docs, F.lit(True)).count() == len(PAIRS)
    assert identify(empty, F.lit(True)).count() == 0


def test_pieces_of_long_texts_have_the_n_grams_of_the_whole():
    rng = np.random.default_rng(21)
    texts = pa.array(["", None, "a", "AB", "\u039f\u03a3 \u0130x", *("".join(rng.choice(list("abc \u00c9\u03a3"), int(n))) for n in rng.integers(0, 300, 12))])
    for most in (1, 2, 3, 7, 64, 10_000):
        got, lettered = np.zeros((len(texts), language_id.BUCKETS + 1), int), np.zeros(len(texts), bool)
        for rows, held, owns in language_id.pieces(texts, most):
            assert sum(map(len, held)) <= 2 * most + 300
            buckets, at, found = language_id.own_features(held, owns)
            np.logical_or.at(lettered, rows, found)
            for b in buckets:
                np.add.at(got, (np.repeat(rows, np.diff(at)), b), 1)
        for row, text in enumerate(texts.to_pylist()):
            buckets, _, found = language_id.features([(text or "").lower()])
            want = sum(np.bincount(b, minlength=language_id.BUCKETS + 1) for b in buckets)
            assert (got[row, :-1] == want[:-1]).all() and lettered[row] == found[0]


def test_language_of_very_long_texts(spark):
    long = {1: "der die das und nicht " * 100_000, 2: "the and of that with " * 100_000}
    rows = [(i + 10, ("der die das und nicht ein schule " if i % 2 else "the and of that with is school ") * 3, "de" if i % 2 else "en") for i in range(40)]
    df = spark.createDataFrame([*rows, *((i, t, None) for i, t in long.items())], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df, F.lit(True)).collect()}
    assert got[1] == ("de", 1.0) and got[2] == ("en", 1.0)


def test_language_of_odd_rows(spark, docs):
    got = bag(identify(docs, F.lit(True)).select("doc_id", "lang_pred", "lang").collect())
    assert sum(got.values()) == len(PAIRS) and {(6, "und"), (7, "und"), (8, "und"), (16, "und")} <= {k[:2] for k in got}
    assert all(pred in ("de", "en") for (i, pred, _) in got if i not in (6, 7, 8, 16))
    tied = spark.createDataFrame([(1, "abc", "zz"), (2, "abc", "yy"), (3, "cba", None), (4, "cba", None)], "doc_id long, text string, lang string")
    for k in (64, 1):  # equal scores, in one block of languages and across blocks
        assert {r["lang_pred"] for r in identify(tied, F.lit(True), languages=k).collect()} == {"yy"}


def test_language_scores_equal_naive_bayes_in_plain_python(spark):
    rng = np.random.default_rng(20)
    letters = {"xx": "aabbccdd éß", "yy": "aaccddee fñ", "zz": "abcdefgh 🙂"}
    rows = [(i, "".join(rng.choice(list(letters[lang]), int(rng.integers(0, 60)))), lang) for i, lang in enumerate(rng.choice(list(letters), 90).tolist())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, parted = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df, F.col("doc_id") < 60, languages=k).collect()} for k in (64, 2))
    assert {i: lang for i, (lang, _) in got.items()} == {i: lang for i, (lang, _) in parted.items()}
    assert all(parted[i][1] == pytest.approx(score) for i, (_, score) in got.items())

    def grams(text: str) -> list[int]:
        t, out = text.lower(), []
        for n in (1, 2, 3):
            for s in range(len(t) - n + 1):
                h = n
                for j in range(n):
                    h = (h + ord(t[s + j]) * int(_STEPS[j])) % (1 << 64)
                out.append(int(mixed(np.array([h], np.uint64))[0]) >> 49)
        return out

    counts, docs_of = {lang: Counter() for lang in letters}, Counter()
    for i, t, lang in rows:
        if i < 60:
            counts[lang].update(grams(t))
            docs_of[lang] += 1
    total = {lang: sum(c.values()) + 32768 for lang, c in counts.items()}
    for i, t, _ in rows:
        score = {lang: np.log(docs_of[lang] / 60) + sum(np.log((counts[lang][b] + 1) / total[lang]) for b in grams(t)) for lang in sorted(letters)}
        best = max(sorted(letters), key=lambda x: score[x])
        if any(c.isalpha() for c in t):
            assert got[i][0] == best and got[i][1] == pytest.approx(1 / sum(np.exp(x - score[best]) for x in score.values()))
        else:
            assert got[i] == ("und", 0.0)


def fill(sizes: dict, cap: int = 3) -> dict:
    """Water-filling by rounds, in plain Python."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > cap * sizes[s]}
        target |= {s: cap * sizes[s] for s in (full or open_)} if full else share
        open_ = open_ - full if full else set()
    return target


def test_mixing(docs, empty):
    out = mix(docs).toPandas()
    assert len(out) == len(PAIRS)
    sizes: dict = {}
    for r in cases.rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(cases.words(r[1]))
    target = fill(sizes)
    for source, own in out.groupby(out.source.where(out.source.notna(), None), dropna=False):
        source = None if source != source else source
        assert own.source_size.iloc[0] == sizes[source] and own.target.iloc[0] == pytest.approx(target[source])
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 1
    assert (out.taken <= 3 * out["size"]).all()
    again = mix(docs.repartition(5)).toPandas()
    assert Counter(zip(out.doc_id.fillna(-1), out.taken, strict=True)) == Counter(zip(again.doc_id.fillna(-1), again.taken, strict=True))
    assert mix(empty).count() == 0


def test_mixed_documents_have_the_words_taken(spark):
    rows = [(i, " ".join(f"a{i}b{j}" for j in range(1 + i % 17)), f"s{i % 4}") for i in range(200)] + [(900, None, "s0"), (901, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got: Counter = Counter()
    for r in mixture(df).collect():
        got[r["doc_id"]] += len(cases.words(r["text"]))
    assert got == Counter({r["doc_id"]: r["taken"] for r in mix(df).collect() if r["taken"]})


def test_mixed_words_are_those_taken_on_odd_rows(spark, docs, empty):
    """Null ids and sources, repeated rows with unequal takes, no words."""
    text = cases.text_of(4, 13)
    rows = [(None, text, "a")] * 3 + [(5, text, "a")] * 4 + [(5, text, "b"), (5, text + " x", "b"), (None, text, None), (6, None, "b"), (7, " ", None)]
    rows += [(100 + i, cases.text_of(i, 11), "c") for i in range(30)]
    for df in (docs, spark.createDataFrame(rows, "doc_id long, text string, source string")):
        plan = mix(df).collect()
        out = mixture(df)
        assert out.columns == df.columns
        want, got = Counter(), Counter()
        for r in plan:
            want[r["doc_id"], r["source"]] += r["taken"]
        for r in out.collect():
            got[r["doc_id"], r["source"]] += len(cases.words(r["text"]))
        assert got == +want
        assert sum(got.values()) == sum(r["taken"] for r in plan) > 0
    assert mixture(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101 + i) for i in range(40)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(41)}


def test_components_over_several_tasks(spark, monkeypatch):
    from foldspark.llm import _common
    from foldspark.llm import components as module

    for where in (_common, module):
        monkeypatch.setattr(where, "ROWS_A_TASK", 40)
    rng = np.random.default_rng(11)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, 500) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    nodes, least = module.least_reachable(np.array([a for a, b in edges if a != b]), np.array([b for a, b in edges if a != b]))
    assert got == dict(zip(nodes.tolist(), least.tolist(), strict=True))
    root = {n: n for n in nodes.tolist()}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


DIGEST = ["doc_id", "n_bytes", "n_removed", "n_spans", "sha2(text, 256)"]


def test_suffixes_by_difference_cover():
    rng = np.random.default_rng(1)
    for trial in range(60):
        k = int(rng.choice([8, 9, 20, 50]))
        data = rng.integers(97, 97 + int(rng.choice([1, 2, 26])), int(rng.integers(60, 400))).astype(np.uint8)
        data = np.concatenate([data, data[5:55], data[:30], data])
        starts = np.arange(len(data) - k + 1)[:: 1 + trial % 2]
        order, new = classes(data, starts, k)
        strings = [data[i : i + k].tobytes() for i in order]
        assert sorted(order) == sorted(starts) and strings == sorted(strings)
        assert new.tolist() == [i for i, x in enumerate(strings) if i == 0 or x != strings[i - 1]]


def test_suffix_dedup(docs, empty, spark):
    out = suffix_dedup(docs)
    assert out.columns == [*docs.columns, "n_bytes", "n_removed", "n_spans"]
    want = bag(cases.suffix_dedup(PAIRS, 50))
    assert bag(out.selectExpr(*DIGEST).collect()) == want
    assert bag(suffix_dedup(docs, hot=2).selectExpr(*DIGEST).collect()) == want  # every anchor is hot
    assert bag(suffix_dedup(docs, k=20).selectExpr(*DIGEST).collect()) == bag(cases.suffix_dedup(PAIRS, 20))
    assert suffix_dedup(empty).count() == 0


def test_suffix_dedup_of_long_texts_and_cut_characters(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = word(400_000)
    rows = [(1, "\u00e9" * 40 + "a" * 30), (2, "\u00e8" + "\u00a9" * 39 + "a" * 30), (3, "ab" * 700_000), (4, "ab" * 600 + word(50))]
    rows += [(10 + i, word(900_000) + shared[i * 1000 :] + word(10)) for i in range(3)]  # over a block each
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r) for r in suffix_dedup(df).selectExpr(*DIGEST).collect()}
    assert all(got[r[0]] == r for r in cases.suffix_dedup(rows[:4], 50))
    assert [got[10 + i][1:4] for i in range(3)] == [(1_300_010, 0, 0), (1_299_010, 399_000, 1), (1_298_010, 398_000, 1)]


def test_spelling_variants(docs, empty, spark):
    rng = np.random.default_rng(4)
    rows = [(r[0], r[1]) for r in cases.rows()]
    base = ["abcdefgh", "\u00c9tudiants", "Stra\u00dfenbahn", "mmmmmmmmm", "conversation", "x" * 3000]
    for i in range(400):
        out = []
        for w in rng.choice(base, 12):
            if rng.random() < 0.2:
                p = int(rng.integers(0, len(w)))
                w = [w[:p] + w[p + 1 :], w[:p] + "z" + w[p:], w[:p] + "\u00fe" + w[p + 1 :]][int(rng.integers(0, 3))]
            out.append(w)
        rows.append((1000 + i, "-".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' AS n", "'w' AS word", "'k' AS key")
    got = spelling_variants(df)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert bag(got.collect()) == bag(cases.spelling(rows))
    assert bag(spelling_variants(docs).collect()) == bag(cases.spelling(PAIRS))
    assert spelling_variants(empty).count() == 0


def test_filter_audit(docs, empty, spark):
    table = cases.rows() + [(20, "Word " * 120, "en", "s", 0, "s", "n", "d", "t"), (21, None, None, "s", 0, "s", "n", "d", "t"), (22, "LOUD # " * 60, "en", "s", 0, "s", "n", "d", "t")]
    df = spark.createDataFrame(table, cases.SCHEMA).withColumn("first", F.lit("x"))
    marks = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, None, 1), (10, 1, 1), (None, 1, 1), (20, 0, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("part", F.lit("p"))
    known = {1: (1, 0), 2: (1, 1), 4: (0, 1), 10: (1, 1)}
    got = filter_audit(df, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert bag(got.collect()) == bag(cases.filter_audit([(r[0], r[1], r[2]) for r in table], known))
    assert filter_audit(empty, labels).count() == 0
    assert filter_audit(df, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
