"""Elements, masses, labels of groups and fits of decays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masses of elements in dalton; others have 0.
MASSES = {
    "H": 1.008, "He": 4.0026, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "P": 30.974, "S": 32.06, "Cl": 35.45, "Br": 79.904, "I": 126.904, "Na": 22.99, "K": 39.098, "Mg": 24.305, "Ca": 40.078,
    "Zn": 65.38, "Fe": 55.845,
}


def element_of(name: Column) -> Column:
    """The first two letters of a name or symbol, the first in upper and the second in lower case; null without a letter."""
    letters = F.regexp_replace(name, "[^A-Za-z]", "")
    return F.when(letters != "", F.concat(F.upper(F.substring(letters, 1, 1)), F.lower(F.substring(letters, 2, 1))))


def mass_of(element: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MASSES.items() for x in kv])
    return F.coalesce(F.element_at(table, element), F.lit(0.0))


#: Elements that a mass may stand for.
BY_MASS = ("H", "C", "N", "O", "P", "S", "Cl", "Na", "K", "Ca", "Mg")


def element_by_mass(mass: Column) -> Column:
    """The nearest of BY_MASS, where it is less than 1 away; null elsewhere."""
    near = F.array_min(F.array(*[F.struct(F.abs(mass - MASSES[x]).alias("off"), F.lit(i).alias("at"), F.lit(x).alias("element")) for i, x in enumerate(BY_MASS)]))
    return F.when(near["off"] < 1.0, near["element"])


def group_label(resname: Column, resid: Column, chain: Column | None = None) -> Column:
    """ALA12, and ALA12@A with a chain that has a name."""
    own = F.concat(resname, resid.cast("string"))
    return own if chain is None else F.when(F.coalesce(chain, F.lit("")) != "", F.concat(own, F.lit("@"), chain)).otherwise(own)


def decay_length(x: Column, y: Column) -> Column:
    """An aggregate: -1 / slope of the line through (x, ln y) for positive y; null with fewer than two places or where nothing decays."""
    slope = F.regr_slope(F.when(y > 0, F.log(y)), F.when(y > 0, x.cast("double")))
    return F.when(slope < 0, -1.0 / slope)
