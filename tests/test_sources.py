from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldspark import schema
from foldspark.operators import boosting
from foldspark.sources import annotations, documents, structures, tables, tools
from foldspark.streaming import resume


def atom(kind, name, res, chain, num, x, icode=" ", model_b=10.0):
    return f"{kind:<6}{1:>5} {name:<4} {res:>3} {chain}{num:>4}{icode}   {x:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{model_b:6.2f}"


def test_structure_scan(spark, tmp_path):
    text = [
        atom("ATOM", " N", "ALA", "1", 1, 1.0),
        atom("ATOM", " CA", "ALA", "1", 1, 2.0, model_b=30.0),
        atom("HETATM", " CA", "MSE", "1", 2, 3.0),
        atom("HETATM", " O", "HOH", "1", 3, 4.0),
        atom("ATOM", " CB", "GLY", "B", -5, 6.0),
        "ENDMDL",
        atom("ATOM", " CA", "ALA", "1", 9, 9.0),
    ]
    (tmp_path / "1abc.pdb").write_text("\n".join(text))
    rows = structures.lines(spark, str(tmp_path))
    res = structures.residues(structures.parsed_atoms(rows)).orderBy("ord").collect()
    assert [(r["pdb_id"], r["chain"], r["resnum"], r["resname"], r["x"]) for r in res] == [("1ABC", "1", 1, "ALA", 2.0), ("1ABC", "1", 2, "MET", 3.0), ("1ABC", "B", -5, "GLY", 6.0)]
    assert res[0]["bfactor"] == 20.0
    assert structures.sizes(rows).first()["n"] == 2
    seq = structures.sequences(structures.residues(structures.parsed_atoms(rows)), ["pdb_id"], shortest=2).first()["sequence"]
    assert seq == "AMG"


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "MKV"), ("b", "GG")], "n string, s string")
    structures.fasta(df, "n", "s").coalesce(1).write.text(str(tmp_path / "f"))
    assert {tuple(r) for r in structures.read_fasta(spark, str(tmp_path / "f")).collect()} == {("a", "MKV"), ("b", "GG")}


def test_residue_lists(spark):
    df = spark.createDataFrame([("['A-PHE-157','B-ILE-12']",), ("['A-SER-157A', 'A-9']",), ("['A-PHE--5']",), ("[]",), (None,), ("oops",)], "t string")
    got = [[tuple(k) for k in r["k"]] for r in df.select(annotations.residue_keys(F.col("t")).alias("k")).collect()]
    assert got == [[("A", 157), ("B", 12)], [("A", 157), ("A", 9)], [("A", -5)], [], [], []]
    lost = df.where("t like '%--5%'").select(annotations.residue_keys(F.col("t"), signed=False).alias("k")).first()["k"]
    assert [tuple(k) for k in lost] == [("A", 5)]
    assert df.select(annotations.residue_numbers(F.lit("[63, 94, 63]")).alias("n")).first()["n"] == [63, 94]


def test_annotations_and_labels(spark, tmp_path):
    (tmp_path / "a.csv").write_text("allosteric_pdb,allosteric_site_residue,active_site_residue,sequence,organism,target_gene\n 1abc,\"['1-ALA-1']\",\"[2]\",S1,o1,g1\n1ABC,\"['1-MET-2']\",[],S2,o2,g2\n,[],[],,,\n")
    sites, active, meta = annotations.entities(annotations.annotations(spark, str(tmp_path / "a.csv")))
    assert {tuple(r) for r in sites.collect()} == {("1ABC", "1", 1), ("1ABC", "1", 2)}
    assert meta.count() == 1 and meta.first()["organism"] == "o1"
    res = spark.createDataFrame([("1ABC", "1", 1), ("1ABC", "2", 2)], "pdb_id string, chain string, resnum int")
    got = {(r["chain"], r["is_allosteric"], r["is_active_site"]) for r in annotations.labelled(res, sites, active).collect()}
    assert got == {("1", 1, 0), ("2", 0, 1)}


def test_site_lines_and_tsv(spark, tmp_path):
    (tmp_path / "s.txt").write_text("ALLOSTERIC_SITE_0 Thr A 106\nALLOSTERIC_SITE_0 Thr A 106A\nX Y Z\n\n")
    assert {(r["chain"], r["resnum"]) for r in annotations.site_lines(spark, str(tmp_path / "s.txt")).collect()} == {("A", 106)}
    (tmp_path / "c.tsv").write_text("r\tm1\nr\tm2\nshort\n")
    assert annotations.tsv(spark, str(tmp_path / "c.tsv"), schema.CLUSTERS).count() == 2


def test_pocket_sections(spark):
    raw = (
        "===INFO_START===\nPocket 1 :\n\tScore : \t0.5\n\tDrug Score : 0.25\n\tVolume Score: x\nPocket 2 :\n\tScore : 0.1\n===INFO_END===\n"
        "===POCKET_1_START===\n" + atom("ATOM", " CA", "MSE", "A", 7, 1.0) + "\n===POCKET_1_END===\n"
        "===POCKET_2_START===\n" + atom("ATOM", " CA", "MSE", "A", 7, 1.0) + "\nHETATM\n===POCKET_2_END===\n"
        "===POCKET_9_START===\n" + atom("ATOM", " CA", "ALA", "A", 8, 1.0) + "\n===POCKET_9_END===\n"
    )
    df = spark.createDataFrame([("P", raw)], "pdb_id string, raw string")
    pockets = df.select("pdb_id", F.inline(tools.pocket_properties(F.col("raw"))))
    bridge = df.select("pdb_id", F.inline(tools.pocket_residues(F.col("raw"))))
    assert {r["pocket"]: r["props"] for r in pockets.collect()} == {1: {"Score": 0.5, "Drug Score": 0.25}, 2: {"Score": 0.1}}
    rows = tools.pocket_features(pockets, bridge).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["resname"], r["score"], r["druggability"], r["volume"], r["rank"], r["n_pockets"]) == ("MET", 0.5, 0.25, 0.0, 1.0, 2.0)


def test_tools_report_status(spark):
    files = spark.createDataFrame([("1abc", "x")], "pdb_id string, content string")
    assert tools.run_tool(files, ["no-such-program"], lambda p: "").first()["status"].startswith("failed")
    got = {r["pdb_id"]: r["status"] for r in tools.fetch(spark.createDataFrame([("1abc",), ("toolong",), ("2abc",)], "pdb_id string"), lambda n: b"x" * (2000 if n == "1abc" else 3)).collect()}
    assert got == {"1abc": "ok", "toolong": "refused", "2abc": "too short"}


def test_embedding_windows_average(spark):
    df = spark.createDataFrame([("p", "A" * 20)], "pdb_id string, sequence string")
    out = tools.embedded(df, lambda parts: [[[float(len(p))] for _ in p] for p in parts], size=16, stride=8).orderBy("pos").collect()
    assert len(out) == 20 and out[0]["emb"] == [16.0] and out[10]["emb"] == [14.0] and out[19]["emb"] == [12.0]


def test_tables_at_rest(spark, tmp_path):
    df = spark.createDataFrame([("train", 1, 2.0), ("val", 2, 3.0)], "split string, k int, x double")
    path = str(tmp_path / "t")
    tables.write_by(df, path, ["split"])
    tables.write_by(df.where("split = 'val'").withColumn("x", F.lit(9.0)), path, ["split"])
    assert tables.read_split(spark, path, "train").first()["x"] == 2.0 and tables.read_split(spark, path, "val").first()["x"] == 9.0
    np.savez(tmp_path / "1abc_features.npz", features=np.arange(6.0).reshape(3, 2))
    rows = tables.npz_rows(spark, str(tmp_path / "1abc_features.npz")).orderBy("ord").collect()
    assert rows[0]["pdb_id"] == "1ABC" and rows[2]["features"] == [4.0, 5.0]
    (tmp_path / "r.json").write_text('{"optimal_threshold": 0.4}')
    (tmp_path / "e.json").write_text("{}")
    assert tables.threshold(spark, str(tmp_path / "r.json")) == 0.4 and tables.threshold(spark, str(tmp_path / "e.json")) == 0.5


def test_stream_skips_what_is_done(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    df.write.parquet(src)
    run = lambda m: resume.staged(resume.arriving(spark, src, df.schema), lambda d: d, out, ["k"], m).awaitTermination()
    run(mark)
    run(mark + "2")  # everything comes again
    df.withColumn("k", F.col("k") + 10).write.mode("append").parquet(src)
    run(mark)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 11, 12]


def test_a_batch_that_dies_is_published_once(spark, tmp_path, monkeypatch):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df = spark.createDataFrame([(i, "a") for i in range(20)], "k int, v string")
    df.where("k < 10").write.parquet(src)
    whole = resume.publish
    run = lambda: resume.staged(resume.arriving(spark, src, df.schema, 1), lambda d: d, out, ["k"], mark).awaitTermination()
    keys = lambda: sorted(r["k"] for r in resume.published(spark, out, "1").collect())

    def before(spark, written, target):
        raise RuntimeError("killed after its write")

    def after(spark, written, target):
        whole(spark, written, target)
        raise RuntimeError("killed before the stream notes it")

    for kill in (before, after):
        monkeypatch.setattr(resume, "publish", kill)
        with pytest.raises(Exception, match="killed"):
            run()
    assert len(list((tmp_path / "out" / "_written").iterdir())) == 1  # left by the first, never read
    monkeypatch.setattr(resume, "publish", whole)
    run()
    assert keys() == list(range(10))
    df.where("k >= 5").write.mode("append").parquet(src)  # some keys come again
    run()
    run()
    assert keys() == list(range(20))


def test_stages_resume_after_the_last_published_one(spark, tmp_path):
    calls = []

    def step(name, fail=False):
        def run(rows):
            calls.append(name)
            if fail:
                raise RuntimeError("died")
            return rows.withColumn("x", F.col("x") + 1)

        return name, run

    first = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(RuntimeError):
        resume.resumed(spark, str(tmp_path / "p"), [step("a b"), step("c", fail=True)], first)
    assert resume.resumed(spark, str(tmp_path / "p"), [step("a b"), step("c"), step("d")], first).first()["x"] == 4
    assert calls == ["a b", "c", "c", "d"]


def test_documents_manifest_and_log(spark, tmp_path):
    rows = spark.createDataFrame([("1ABC", i, "A", 10 + i, "GLY", int(i == 1), 0, 0.123456 * i) for i in range(3)] + [("2DEF", 0, "B", -5, "ALA", 0, 1, 0.5)], "pdb_id string, ord int, chain string, resnum int, resname string, y_true int, is_active_site int, y_prob double")
    documents.write_documents(rows, str(tmp_path))
    back = spark.read.schema(documents.DOCUMENT).json(str(tmp_path / "documents")).collect()
    held = {r["pdb_id"]: r for r in back}
    assert held["1ABC"]["n_true_allosteric"] == 1 and [x["n"] for x in held["1ABC"]["residues"]] == [10, 11, 12]
    assert held["1ABC"]["residues"][2]["p"] == 0.2469 and held["2DEF"]["n_active_site"] == 1
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.json").write_text('{"pdb_id": "1ABC", "n_residues": 1,\n "residues": [{"c": "A", "n": 7, "r": "GLY", "t": 1, "a": 0, "p": 0.5}]}')
    flat = documents.residue_rows(documents.read_documents(spark, str(tmp_path / "one"))).collect()
    assert [(r["pdb_id"], r["ord"], r["resnum"], r["y_true"], r["y_prob"]) for r in flat] == [("1ABC", 0, 7, 1, 0.5)]
    (tmp_path / "manifest.json").write_text('{"threshold": 0.25, "proteins": [{"pdb_id": "1ABC", "category": "win", "n_residues": 3}]}')
    entry = documents.read_manifest(spark, str(tmp_path / "manifest.json")).first()
    assert (entry["threshold"], entry["pdb_id"], entry["category"], entry["title"]) == (0.25, "1ABC", "win", None)
    with documents.logged(str(tmp_path / "log.txt")) as log:
        log.info("one %d", 1)
    log.info("not kept")
    assert (tmp_path / "log.txt").read_text().strip().endswith("one 1")


def test_models_and_metrics_at_rest(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    model = boosting.fit(x, (x[:, 0] > 0).astype(int), x[:0], np.zeros(0, int), rounds=8, min_child=1.0)
    tables.save_model(spark, model, 0.4, str(tmp_path / "m"))
    back, threshold = tables.load_model(spark, str(tmp_path / "m"))
    assert threshold == 0.4 and np.allclose(back.probability(x), model.probability(x)) and len(back.trees) == 8
    tables.write_metrics(spark.createDataFrame([(0.5, 0.25)], "optimal_threshold double, ap double"), str(tmp_path / "metrics"))
    assert tables.threshold(spark, str(tmp_path / "metrics")) == 0.5


def test_of_alternate_locations_one_atom_counts(spark):
    line = lambda k, alt, x, y, occ: f"ATOM  {k:5d}  CA {alt}ALA A   7    {x:8.3f}{y:8.3f}{0.0:8.3f}{occ:6.2f}{10.0:6.2f}"
    rows = spark.createDataFrame([("p", k, text) for k, text in enumerate([line(1, "A", 5, -3, 0.4), line(2, "B", 1, 7, 0.6)])], "pdb_id string, ord int, line string")
    got = structures.residues(structures.parsed_atoms(rows)).first()
    assert (got["x"], got["y"], got["z"]) == (1.0, 7.0, 0.0)


def test_fetch_skips_what_is_there(spark):
    ids = spark.createDataFrame([("1abc",), ("2abc",), ("toolong",), ("3abc",)], "pdb_id string")
    there = spark.createDataFrame([("1abc", bytearray(b"x" * 2000)), ("2abc", bytearray(b"x"))], "pdb_id string, content binary")
    got = {r["pdb_id"]: r["status"] for r in tools.fetch(ids, lambda name: b"y" * (2000 if name == "2abc" else 5), there=there, tasks=2).collect()}
    assert got == {"2abc": "ok", "toolong": "refused", "3abc": "too short"}


def test_embeddings_are_means_over_windows(spark):
    sequences = spark.createDataFrame([("p", "ABCDEFGHIJ")], "pdb_id string, sequence string")
    model = lambda parts: [[[float(ord(c)), float(len(part))] for c in part] for part in parts]
    rows = {r["pos"]: list(r["emb"]) for r in tools.embedded(sequences, model, size=6, stride=3).collect()}
    assert {i: emb[0] for i, emb in rows.items()} == {i: float(ord(c)) for i, c in enumerate("ABCDEFGHIJ")}
    # windows start at 0, 3 and 6; the last has four letters
    assert {i: emb[1] for i, emb in rows.items()} == {0: 6, 1: 6, 2: 6, 3: 6, 4: 6, 5: 6, 6: 5, 7: 5, 8: 5, 9: 4}


def test_a_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 10 < 7 else f"cold{i % 3}", i, rng.bytes(200).hex()) for i in range(20_000)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["split", "i", "x"])).repartition(4)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    tables.write_by(df, f"{tmp_path}/t", ["split"], columns=["split", "i", "x"], file_bytes=1 << 20)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) == before
    sizes = sorted(p.stat().st_size for p in (tmp_path / "t/split=hot").glob("*.parquet"))
    assert len(sizes) >= 3 and sizes[-1] <= 2.5 * sizes[len(sizes) // 2]
    assert len(list((tmp_path / "t/split=cold1").glob("*.parquet"))) <= 2
    back = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(map(tuple, back.select("split", "i", "x").collect())) == sorted(rows)
    # only the partitions at hand are replaced, and only the columns chosen are written
    tables.write_by(df.where("split = 'hot'").limit(5), f"{tmp_path}/t", ["split"], columns=["split", "i"])
    assert spark.read.parquet(f"{tmp_path}/t/split=hot").columns == ["i"] and back.where("split <> 'hot'").count() == 6000


def test_files_are_discovered_by_family_and_entity(spark, tmp_path):
    for family, entity in (("f1", "1ABC"), ("f1", "2XYZ"), ("f2", "3DEF")):
        (tmp_path / family / entity).mkdir(parents=True)
        (tmp_path / family / entity / "model.pdb").write_text("x")
        (tmp_path / family / entity / "notes.txt").write_text("x")
    found = annotations.discovered(spark, str(tmp_path), "*.pdb").select("family", "pdb_id").collect()
    assert sorted(map(tuple, found)) == [("f1", "1ABC"), ("f1", "2XYZ"), ("f2", "3DEF")]


def test_hits_of_a_search(spark, tmp_path):
    (tmp_path / "hits.tsv").write_text("1ABC_A\t9XYZ\t0.95\n1ABC_B\t8XYZ\t0.5\nbroken\n")
    rows = annotations.tsv(spark, f"{tmp_path}/hits.tsv", schema.HITS).collect()
    assert [tuple(r)[:3] for r in rows] == [("1ABC_A", "9XYZ", 0.95), ("1ABC_B", "8XYZ", 0.5)]
