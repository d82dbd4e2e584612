"""Column functions.  All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldspark import schema


def literal_map(values: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def mapped(col: Column, values: Mapping, default: Column | None = None) -> Column:
    """Look-up in a small constant table; a miss gives ``default`` (null)."""
    hit = F.try_element_at(literal_map(values), col)
    return hit if default is None else F.coalesce(hit, default)


def normal_id(col: Column) -> Column:
    return F.upper(F.trim(col))


def leading_int(col: Column) -> Column:
    """The integer a text begins with (an insertion code behind it is dropped)."""
    return F.nullif(F.regexp_extract(col, r"^\s*(-?\d+)", 1), F.lit("")).try_cast("int")


def standard_residue(resname: Column) -> Column:
    return mapped(resname, schema.STANDARD_OF, resname)


def one_letter(resname: Column) -> Column:
    return mapped(resname, schema.ONE_LETTER, F.lit("X"))


def is_residue(het: Column, resname: Column) -> Column:
    """Standard residues, and hetero ones that stand for a standard one."""
    known = resname.isin(list(schema.STANDARD_OF))
    return ((F.trim(het) == "") | known) & standard_residue(resname).isin(schema.AMINO_ACIDS)


def clean(col: Column) -> Column:
    """Null, NaN and infinities become 0."""
    x = col.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def min_max(col: Column, low: Column | float, high: Column | float, default: float = 0.5) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.coalesce(F.try_divide(col - low, high - low), F.lit(default))


def one_hot(col: Column, values: Sequence, prefix: str) -> list[Column]:
    return [F.when(col == v, 1.0).otherwise(0.0).alias(f"{prefix}_{v}") for v in values]


def relative_area(area: Column, resname: Column) -> Column:
    return F.least(area / mapped(resname, {k: float(v) for k, v in schema.MAX_AREA.items()}, F.lit(200.0)), F.lit(1.0))


def physical(resname: Column) -> list[Column]:
    """Hydrophobicity and weight scaled, charge, and four kinds."""
    flag = lambda cond, name: F.when(cond, 1.0).otherwise(0.0).alias(name)
    return [
        ((mapped(resname, schema.HYDROPHOBICITY, F.lit(0.0)) + 4.5) / 9.0).alias("hydrophobicity"),
        mapped(resname, schema.CHARGE, F.lit(0.0)).alias("charge"),
        (mapped(resname, {k: float(v) for k, v in schema.WEIGHT.items()}, F.lit(130.0)) / 204.0).alias("weight"),
        flag(resname.isin(schema.AROMATIC), "aromatic"),
        flag(resname.isin(schema.POLAR), "polar"),
        flag(resname == "GLY", "glycine"),
        flag(resname == "PRO", "proline"),
    ]


def index_columns(resname: Column) -> list[Column]:
    """Published residue indices, each scaled to 0..1 over the twenty residues."""
    out = []
    for name, values in schema.INDICES.items():
        low, high = min(values), max(values)
        table = {a: (v - low) / (high - low) for a, v in zip(schema.AMINO_ACIDS, values, strict=True)}
        out.append(mapped(resname, table, F.lit(0.5)).alias(name))
    return out


def without_last_part(col: Column) -> Column:
    """``a_b_c`` to ``a_b``."""
    return F.regexp_replace(col, "_[^_]*$", "")


def first_property(props: Column, names: Iterable[str], default: float = 0.0) -> Column:
    return F.coalesce(*(F.try_element_at(props, F.lit(n)) for n in names), F.lit(default))


def outcome(truth: Column, active: Column, predicted: Column) -> Column:
    """tp / fn / fp, then active site, else base."""
    return (
        F.when((truth == 1) & predicted, "tp").when(truth == 1, "fn").when(predicted, "fp").when(active == 1, "act").otherwise("base")
    )


def ramp(x: Column, stops: Sequence[tuple[float, tuple[int, int, int]]]) -> list[Column]:
    """Piecewise-linear colour (r, g, b) of a value, clamped to the stops."""
    at = clamp(x, stops[0][0], stops[-1][0])
    out = []
    for c, name in enumerate("rgb"):
        expr = F.lit(float(stops[-1][1][c]))
        for (x0, c0), (x1, c1) in reversed(list(zip(stops, stops[1:], strict=False))):
            part = F.lit(float(c0[c])) + (at - x0) / (x1 - x0) * float(c1[c] - c0[c])
            expr = F.when(at <= x1, part).otherwise(expr)
        out.append(F.floor(expr + 0.5).cast("int").alias(name))
    return out


def half_up(x: Column, digits: int = 6) -> Column:
    """Rounding by floor: the same bits in any engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def half_even(x: Column, digits: int) -> Column:
    """Rounding to nearest on the binary value, as a language with correctly
    rounded decimals does it: ties, which are exact, go to the even digit.
    The product with 10^digits is kept with its error (Dekker's splitting), so
    a value that only looks like a tie falls on its true side."""
    scale = float(10**digits)

    def halves(v: Column | float) -> tuple:
        c = v * 134217729.0
        high = c - (c - v)
        return high, v - high

    product = x * scale
    (xh, xl), (sh, sl) = halves(x), halves(scale)
    error = ((xh * sh - product) + xh * sl + xl * sh) + xl * sl
    low = F.floor(product).cast("double")
    side = (product - low - 0.5) + error
    even = F.when(F.pmod(low, F.lit(2.0)) == 0, low).otherwise(low + 1)
    rounded = F.when(side > 0, low + 1).when(side < 0, low).otherwise(even)
    return F.when(F.abs(product) < 2.0**52, rounded / scale).otherwise(x)
