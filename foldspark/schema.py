"""Schemas of the engine's tables, feature lists, and lookup tables.

The grain is one residue of one entity; ``ord`` is materialised because rows
have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


ANNOTATIONS = _struct(*((n, _S) for n in ("allosteric_pdb", "allosteric_site_residue", "active_site_residue", "sequence", "organism", "target_gene")))
LABELS = _struct(("chain", _S), ("resnum", _I), ("resname", _S), ("is_allosteric", _I), ("is_active_site", _I))
SPLITS = _struct(("pdb_id", _S), ("split", _S), ("cluster_rep", _S))
CLUSTERS = _struct(("rep", _S), ("member", _S))
HITS = _struct(("query", _S), ("target", _S), ("fident", _D))
HOMOLOGY = _struct(("pdb_id", _S), ("max_identity", _D), ("closest_training_pdb", _S), ("n_chains_checked", _I))
ENERGY = _struct(("a", _S), ("b", _S), ("energy", _D))

# Names, codes and physical constants of residues.
AMINO_ACIDS = ["ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL"]
ONE_LETTER = dict(zip(AMINO_ACIDS, "ARNDCQEGHILKMFPSTWYV", strict=True))
STANDARD_OF = {"MSE": "MET", "HYP": "PRO", "SEP": "SER", "TPO": "THR", "PTR": "TYR", "CSE": "CYS"}
HYDROPHOBICITY = dict(zip(AMINO_ACIDS, [1.8, -4.5, -3.5, -3.5, 2.5, -3.5, -3.5, -0.4, -3.2, 4.5, 3.8, -3.9, 1.9, 2.8, -1.6, -0.8, -0.7, -0.9, -1.3, 4.2], strict=True))
CHARGE = {"ARG": 1.0, "LYS": 1.0, "ASP": -1.0, "GLU": -1.0}
WEIGHT = dict(zip(AMINO_ACIDS, [89, 174, 132, 133, 121, 146, 147, 75, 155, 131, 131, 146, 149, 165, 115, 105, 119, 204, 181, 117], strict=True))
AROMATIC = ["PHE", "TRP", "TYR", "HIS"]
POLAR = ["SER", "THR", "ASN", "GLN", "TYR", "CYS", "HIS"]
MAX_AREA = dict(zip(AMINO_ACIDS, [129, 274, 195, 193, 167, 225, 223, 104, 224, 197, 201, 236, 224, 240, 159, 155, 172, 285, 263, 174], strict=True))
INDICES = {
    "vdw_volume": [1.00, 6.13, 2.95, 2.78, 2.43, 3.95, 3.78, 0.00, 4.66, 4.00, 4.00, 4.77, 4.43, 5.89, 2.72, 1.60, 2.60, 8.08, 6.47, 3.00],
    "flexibility": [0.357, 0.529, 0.463, 0.511, 0.346, 0.493, 0.497, 0.544, 0.323, 0.462, 0.365, 0.466, 0.295, 0.314, 0.509, 0.507, 0.444, 0.305, 0.420, 0.386],
    "polarity": [8.1, 10.5, 11.6, 13.0, 5.5, 10.5, 12.3, 9.0, 10.4, 5.2, 4.9, 11.3, 5.7, 5.2, 8.0, 9.2, 8.6, 5.4, 6.2, 5.9],
    "bulkiness": [11.50, 14.28, 12.82, 11.68, 13.46, 14.45, 13.57, 3.40, 13.69, 21.40, 21.40, 15.71, 16.25, 19.80, 17.43, 9.47, 15.77, 21.67, 18.03, 21.57],
    "helix_propensity": [1.42, 0.98, 0.67, 1.01, 0.70, 1.11, 1.51, 0.57, 1.00, 1.08, 1.21, 1.16, 1.45, 1.13, 0.57, 0.77, 0.83, 1.08, 0.69, 1.06],
    "sheet_propensity": [0.83, 0.93, 0.89, 0.54, 1.19, 1.10, 0.37, 0.75, 0.87, 1.60, 1.30, 0.74, 1.05, 1.38, 0.55, 0.75, 1.19, 1.37, 1.47, 1.70],
}

BLOCKS = {
    "structural": 64,
    "graph": 11,
    "pocket": 8,
    "index": 6,
    "entropy": 3,
    "response": 3,
    "energy": 2,
    "frustration": 7,
}
