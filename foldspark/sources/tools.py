"""Output of external tools, and the interfaces that run or fetch them."""

from __future__ import annotations

import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions.scalar import first_property, leading_int, standard_residue


def pocket_properties(raw: Column) -> Column:
    """Array of (pocket, props map) from the tagged information section."""
    info = F.regexp_extract(raw, r"(?s)===INFO_START===\n(.*?)===INFO_END===", 1)
    heads = F.regexp_extract_all(info, F.lit(r"(?s)Pocket (\d+)[^\n]*\n(?:(?!\s*Pocket \d).)*"), F.lit(1))
    bodies = F.regexp_extract_all(info, F.lit(r"(?s)Pocket \d+[^\n]*\n((?:(?!\s*Pocket \d).)*)"), F.lit(1))

    def props(body: Column) -> Column:
        found = F.transform(F.filter(F.split(body, "\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1), F.lit(" \t\r")).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1), F.lit(" \t\r")).try_cast("double").alias("v")))
        return F.map_from_entries(F.filter(found, lambda e: e["v"].isNotNull()))

    return F.zip_with(heads, bodies, lambda h, b: F.struct(h.cast("int").alias("pocket"), props(b).alias("props")))


def pocket_residues(raw: Column) -> Column:
    """Array of (pocket, chain, resnum, resname) from the pocket sections."""
    pattern = r"(?s)===POCKET_(\d+)_START===\n(.*?)===POCKET_\1_END==="
    number, body = (F.regexp_extract_all(raw, F.lit(pattern), F.lit(g)) for g in (1, 2))

    def rows(n: Column, b: Column) -> Column:
        atoms = F.filter(F.split(b, "\n"), lambda x: x.startswith("ATOM"))
        return F.transform(
            atoms,
            lambda x: F.struct(
                n.cast("int").alias("pocket"), F.substring(x, 22, 1).alias("chain"), leading_int(F.trim(F.substring(x, 23, 4))).alias("resnum"), standard_residue(F.trim(F.substring(x, 18, 3))).alias("resname")
            ),
        )

    return F.array_distinct(F.filter(F.flatten(F.zip_with(number, body, rows)), lambda r: r["resnum"].isNotNull()))


def pocket_features(pockets: DataFrame, bridge: DataFrame) -> DataFrame:
    """Eight columns for each residue in a pocket; the best pocket is the one
    of least number, and rank 1.0 is best."""
    count = pockets.groupBy("pdb_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = bridge.distinct().join(pockets, ["pdb_id", "pocket"])
    best = joined.groupBy("pdb_id", "chain", "resnum", "resname").agg(F.min_by(F.struct("pocket", "props"), "pocket").alias("b"), F.count(F.lit(1)).alias("n_pockets"))
    p = F.col("b.props")
    return best.join(count, "pdb_id").select(
        "pdb_id",
        "chain",
        "resnum",
        "resname",
        F.lit(1.0).alias("in_pocket"),
        first_property(p, ["Score"]).alias("score"),
        first_property(p, ["Druggability Score", "Drug Score"]).alias("druggability"),
        first_property(p, ["Volume", "Pocket volume (Monte Carlo)", "Volume Score"]).alias("volume"),
        first_property(p, ["Hydrophobicity score", "Hydrophobicity Score"]).alias("hydrophobicity"),
        first_property(p, ["Polarity score", "Polarity Score"]).alias("polarity"),
        ((F.col("_n") - F.col("b.pocket") + 1) / F.greatest("_n", F.lit(1))).alias("rank"),
        F.col("n_pockets").cast("double").alias("n_pockets"),
    )


def run_tool(files: DataFrame, command: Sequence[str], collect: Callable[[Path], str], *, timeout: int = 600) -> DataFrame:
    """(pdb_id, content) to (pdb_id, raw, status): an external program on each
    file, in a folder of its own that goes with the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["pdb_id"], batch["content"], strict=True):
                with tempfile.TemporaryDirectory() as folder:
                    path = Path(folder, f"{name}.pdb")
                    path.write_bytes(content if isinstance(content, bytes) else str(content).encode())
                    try:
                        subprocess.run([*command, str(path)], cwd=folder, timeout=timeout, check=True, capture_output=True)
                        rows.append((name, collect(Path(folder)), "ok"))
                    except (OSError, subprocess.SubprocessError) as e:
                        rows.append((name, None, f"failed: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["pdb_id", "raw", "status"])

    return files.mapInPandas(run, "pdb_id string, raw string, status string")


def fetch(ids: DataFrame, get: Callable[[str], bytes], *, least: int = 1000, there: DataFrame | None = None, pause: float = 0.0, tasks: int | None = None) -> DataFrame:
    """(pdb_id) to (pdb_id, content, status) with a given downloader; ids that
    are not four characters long are refused, short answers fail.  Ids whose
    content in ``there`` (pdb_id, content) is long enough are not asked for
    again; ``tasks`` at most ask at once, each with a ``pause`` in between."""
    wanted = ids.select("pdb_id").distinct()
    if there is not None:
        wanted = wanted.join(there.where(F.octet_length("content") > least).select("pdb_id"), "pdb_id", "left_anti")
    if tasks:
        wanted = wanted.repartition(tasks, "pdb_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["pdb_id"]:
                try:
                    content = get(name) if len(name) == 4 else None
                    time.sleep(pause if len(name) == 4 else 0.0)
                    ok = content is not None and len(content) > least
                    rows.append((name, content if ok else None, "ok" if ok else "refused" if content is None else "too short"))
                except Exception as e:  # any failure of a foreign downloader is a status
                    rows.append((name, None, f"failed: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["pdb_id", "content", "status"])

    return wanted.mapInPandas(run, "pdb_id string, content binary, status string")


def embedded(sequences: DataFrame, model: Callable[[list[str]], list[list[list[float]]]], size: int = 1022, stride: int = 512) -> DataFrame:
    """(pdb_id, sequence) to (pdb_id, pos, emb): a per-residue model over
    overlapping windows, averaged where they overlap.  The model is a
    parameter; batches go to it whole."""
    from foldspark.operators.sequence import window_starts

    windows = sequences.withColumn("_start", F.explode(window_starts(F.length("sequence"), size, stride)))
    windows = windows.select("pdb_id", "_start", F.substring(F.col("sequence"), F.col("_start") + 1, F.lit(size)).alias("_part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start, emb in zip(batch["pdb_id"], batch["_start"], model(batch["_part"].tolist()), strict=True):
                yield pd.DataFrame({"pdb_id": name, "pos": range(start, start + len(emb)), "emb": list(emb)})

    parts = windows.mapInPandas(run, "pdb_id string, pos int, emb array<float>")
    # ceil(size / stride) windows at most hold a residue
    held = parts.groupBy("pdb_id", "pos").agg(F.collect_list("emb").alias("held"))
    total = F.aggregate(F.slice("held", 2, F.size("held")), F.transform(F.get("held", 0), lambda x: x.cast("double")), lambda s, e: F.zip_with(s, e, lambda x, y: x + y))
    return held.select("pdb_id", "pos", F.transform(total, lambda x: (x / F.size("held")).cast("float")).alias("emb"))
