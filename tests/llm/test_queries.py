from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from foldspark.llm import queries
from tests.llm import cases
from tests.oracle import connection, same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, FOLDER), connection(FOLDER), queries.ORACLE_SQL[name])


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id").where("lang is not null")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k < 3:
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.agg({"length": "max"}).first()[0] <= 4096


def test_pipeline_equals_brute_force_up_to_the_mixture(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean = stages["quality rules"](spark, docs, FOLDER).cache()
    kept = pairs(clean)
    assert set(kept) <= {p for p in pairs(docs) if not cases.quality(p[1])[-1]}
    lined = stages["line dedup"](spark, clean, FOLDER).cache()
    rows = pairs(lined)
    assert sorted((i, cases.sha(t or "")) for i, t in rows) == sorted((i, sha) for i, _, _, sha in cases.line_dedup(kept))
    stay = {i for i, _, least in cases.ngram_join(rows, 5, 80) if i == least}
    assert pairs(stages["n-gram Jaccard join"](spark, lined, FOLDER)) == [p for p in rows if p[0] in stay]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_rows_and_empty_tables(spark, stage):
    """Nulls, empty and long texts, repeated rows, and more columns with
    clashing names: a stage returns its columns, and of whole rows only those
    that its rule removes are missing."""
    import corpus_pipeline

    name, apply = corpus_pipeline.STAGES[stage]
    table = cases.rows()
    if name == "quality rules":  # sound documents, or all hosts fail
        table += [(1000 + i, cases.text_of(i, 50), "en", f"src{i % 3}", 0, "s", "n", "d", "t") for i in range(180)]
    docs = spark.createDataFrame(table, cases.SCHEMA)
    out, none = (apply(spark, df, FOLDER) for df in (docs, docs.limit(0)))
    assert none.count() == 0 and none.columns == out.columns
    rows = [(r[0], r[1]) for r in table]
    if name == "packing":
        got = Counter((r["doc_id"], r["doc_tokens"]) for r in out.collect() if r["start"] == 0)
        assert sum(got.values()) == len(rows) and {i for i, _ in got} == {i for i, _ in rows}
        return
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    if name == "quality rules":
        assert got == Counter(r for r in rows if not cases.quality(r[1])[-1])
    elif name == "line dedup":
        assert Counter((i, cases.sha(t or "")) for i, t in got.elements()) == Counter((i, sha) for i, _, _, sha in cases.line_dedup(rows))
    elif name == "n-gram Jaccard join":
        stay = {i for i, _, least in cases.ngram_join(rows, 5, 80) if i == least}
        assert set(got.values()) == {1} and {i for i, _ in got if i is not None} == stay - {None}
    else:
        whole = dict(rows)
        assert all(t is None or whole[i].startswith(t) or t in whole[i] for i, t in got if i is not None)


def test_pipeline_packs_every_token_of_the_mixture_once(spark):
    """From the mixture on, against the library; and ``run`` as a whole."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, FOLDER).cache()
    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want: Counter = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.update((r["doc_id"], s, cases.crc(ids[s : s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096))
    out = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert Counter(zip(out.doc_id, out.start, out.ids_crc32, out.doc_tokens, strict=True)) == want
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1].tolist()] and own.length.sum() <= 4096
