"""Solvent around a solute: orientation, polarisation, ion pairs, contacts of a ligand, grids of orientation and free volume."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import Vec, clamp, cross, dot, min_image, norm, sub, vec
from driftline.functions.selection import select
from driftline.model import Selection, Trajectory, box_columns
from driftline.operators.common import centers, filled, indexed, lagged, pairs

#: Fixed value: debye of an electron charge over a nanometre, by the constants that results are to agree with.
DEBYE_PER_E_NM = 1.60217733 / 3.336e-2


def molecules(traj: Trajectory, parts: dict[str, Selection], by: str = "resid", needed: tuple[str, ...] | None = None) -> DataFrame:
    """frame, by, box lengths and the mean place of each part ({part}x ...) of every group that has all of them, or the ``needed`` ones."""
    flags = [select(s).alias(f"in_{k}") for k, s in parts.items()]
    wanted = traj.atoms.select("atom", by, *flags).where(reduce(Column.__or__, [F.col(f"in_{k}") for k in parts]))
    places = [F.avg(F.when(F.col(f"in_{k}"), F.col(c))).alias(f"{k}{c}") for k in parts for c in "xyz"]
    rows = traj.frames.join(wanted, "atom").groupBy("frame", by).agg(*places)
    return rows.dropna(subset=[f"{k}x" for k in needed or parts]).join(traj.boxes.select("frame", "lx", "ly", "lz"), "frame")


def _unit(v: Vec) -> Vec:
    """Null for a vector without length."""
    n = norm(v)
    return tuple(F.when(n > 0, c / n) for c in v)


def _named(v: Vec, prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{k}") for c, k in zip(v, "xyz", strict=True)]


def _oriented(traj: Trajectory, solute: Selection, atoms: tuple[Selection, Selection, Selection], reach: float, by: str, vector23: bool) -> DataFrame:
    """dist, cos1, p2, cos2 of each solute atom and solvent molecule whose first atom is within ``reach`` of it."""
    mol = molecules(traj, dict(zip("abc", atoms, strict=True)), by)
    box = box_columns()
    bond = lambda p, q: min_image(sub(vec(q), vec(p)), box)
    mol = mol.select("frame", by, *_named(bond("a", "b"), "e"), *_named(bond("a", "c"), "f"), *_named(bond("b", "c"), "g"))
    mol = mol.select("*", *_named(_unit(tuple(p + q for p, q in zip(vec("e"), vec("f"), strict=True))), "u"))
    mol = mol.select("frame", F.col(by).alias(f"b_{by}"), "ux", "uy", "uz", *_named(_unit(vec("g") if vector23 else cross(vec("u"), vec("f"))), "v"))
    near = pairs(traj, solute, atoms[0], pbc=True, cutoff=reach, attributes=(by,)).where("dist > 0").join(mol, ["frame", f"b_{by}"])
    cosine = lambda p: F.coalesce(clamp(-dot(vec("d"), vec(p)) / F.col("dist")), F.lit(0.0))
    rows = near.select("dist", cosine("u").alias("cos1"), F.when(F.col("ux").isNotNull(), cosine("v")).otherwise(F.lit(0.0)).alias("cos2"))
    return rows.withColumn("p2", 3.0 * F.col("cos2") * F.col("cos2") - 1.0)


def sorient(traj: Trajectory, solute: Selection, atoms: tuple[Selection, Selection, Selection], bins: int, rbin: float, by: str = "resid", vector23: bool = False) -> DataFrame:
    """Radial profile of the solvent's orientation: bin, r, n, cos1, p2, running sums a solute atom and frame, count_density.

    The first angle lies between the direction to the solute and the bisector
    of the bonds 1-2 and 1-3, the second between that direction and the normal
    of the plane (or the vector 2-3); p2 is 3 cos^2 - 1. Empty bins hold zeros.
    """
    rows = _oriented(traj, solute, atoms, bins * rbin, by, vector23)
    sums = rows.groupBy(F.least(F.floor(F.col("dist") / rbin), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum("cos1").alias("s1"), F.sum("p2").alias("s2"))
    one = traj.boxes.agg(F.count("*").alias("frames")).crossJoin(traj.atoms.where(select(solute)).agg(F.count("*").alias("refs")))
    rows = filled(sums, bins, fill={"n": 0, "s1": 0.0, "s2": 0.0}).crossJoin(F.broadcast(one))  # one row
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row for each of the bins
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(F.lit(0.0))
    running = lambda c: F.sum(c).over(w) / (F.col("refs") * F.col("frames"))
    return rows.select("bin", ((F.col("bin") + 0.5) * rbin).alias("r"), "n", mean("s1").alias("cos1"), mean("s2").alias("p2"), running("s1").alias("sum_cos1"), running("s2").alias("sum_p2"), (F.col("n") / (rbin * F.col("frames"))).alias("count_density"))


def sorient_histogram(traj: Trajectory, solute: Selection, atoms: tuple[Selection, Selection, Selection], r_min: float, r_max: float, cbin: float = 0.1, by: str = "resid", vector23: bool = False) -> DataFrame:
    """kind (cos1, abs_cos2), bin, center, density of the two cosines in the shell from ``r_min`` to ``r_max``, which is outside."""
    rows = _oriented(traj, solute, atoms, r_max, by, vector23).where((F.col("dist") >= r_min) & (F.col("dist") < r_max))
    shell = rows.select(F.explode(F.array(F.struct(F.lit("cos1").alias("kind"), ((F.col("cos1") + 1.0) / 2.0).alias("at")), F.struct(F.lit("abs_cos2").alias("kind"), F.abs("cos2").alias("at")))).alias("c")).select("c.*")
    spark, every = traj.frames.sparkSession, None
    for kind, low, width in (("cos1", -1.0, 2.0), ("abs_cos2", 0.0, 1.0)):
        n = max(round(width / cbin), 1)
        part = shell.where(F.col("kind") == kind).groupBy(F.least(F.floor(F.col("at") * n), F.lit(n - 1)).alias("bin")).agg(F.count("*").alias("n"))
        total = part.agg(F.sum("n").alias("total"))
        step = width / n
        share = F.when(F.col("total") > 0, F.col("n") / (F.col("total") * step)).otherwise(F.lit(0.0))
        part = spark.range(n).select(F.col("id").alias("bin")).join(part, "bin", "left").fillna(0, ["n"]).crossJoin(F.broadcast(total))  # one row
        part = part.select(F.lit(kind).alias("kind"), "bin", (low + (F.col("bin") + 0.5) * step).alias("center"), share.alias("density"))
        every = part if every is None else every.unionByName(part)
    return every


def _polar(traj: Trajectory, solute: Selection, solvent: Selection, atoms: tuple[Selection, Selection, Selection], reach: float, by: str, scale: float) -> DataFrame:
    """frame, by, dist, mu, and the dipole's and the direction's parts along the vector from each molecule's first atom to the nearest solute atom."""
    near = pairs(traj, solute, atoms[0], pbc=True, cutoff=reach, attributes=(by,)).groupBy("frame", F.col(f"b_{by}").alias(by)).agg(F.min(F.struct("dist", "a", "dx", "dy", "dz")).alias("to"))
    rows = traj.points(solvent, by, "charge", box=True)
    w = Window.partitionBy("frame", by).orderBy("atom")
    box = box_columns()
    off = min_image(tuple(F.col(c) - F.first(c).over(w) for c in "xyz"), box)
    flags = [select(s).alias(f"in_{k}") for k, s in zip("abc", atoms, strict=True)]
    rows = rows.select("frame", by, "atom", "charge", *_named(off, "o")).join(traj.atoms.select("atom", *flags), "atom")
    place = [F.avg(F.when(F.col(f"in_{k}"), F.col(f"o{c}"))).alias(f"{k}{c}") for k in "abc" for c in "xyz"]
    whole = rows.groupBy("frame", by).agg(*place, *[((F.sum(F.col("charge") * F.col(f"o{c}")) - F.avg("charge") * F.sum(f"o{c}")) * DEBYE_PER_E_NM * scale).alias(f"m{c}") for c in "xyz"])
    along = lambda v: -dot(tuple(F.col(f"to.d{c}") for c in "xyz"), v) / F.col("to.dist")
    direction = tuple(F.coalesce(c, F.lit(0.0)) for c in _unit(tuple((F.col(f"b{c}") + F.col(f"c{c}")) / 2.0 - F.col(f"a{c}") for c in "xyz")))
    return whole.join(near, ["frame", by]).select("frame", by, F.col("to.dist").alias("dist"), norm(vec("m")).alias("mu"), along(vec("m")).alias("radial"), along(direction).alias("turn"))


def spol(traj: Trajectory, solute: Selection, solvent: Selection, atoms: tuple[Selection, Selection, Selection], bins: int, width: float, by: str = "resid") -> DataFrame:
    """bin, r (outer edge), n, per_frame, cumulative: molecules by the distance of their first atom to the nearest solute atom."""
    rows = _polar(traj, solute, solvent, atoms, bins * width, by, 0.1).where(F.col("dist") < bins * width)
    counts = rows.groupBy(F.least(F.floor(F.col("dist") / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    frames = traj.boxes.agg(F.count("*").alias("frames"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row for each of the bins
    rows = filled(counts, bins).crossJoin(F.broadcast(frames))  # one row
    return rows.select("bin", ((F.col("bin") + 1.0) * width).alias("r"), "n", (F.col("n") / F.col("frames")).alias("per_frame"), (F.sum("n").over(w) / F.col("frames")).alias("cumulative"))


def spol_shell(traj: Trajectory, solute: Selection, solvent: Selection, atoms: tuple[Selection, Selection, Selection], r_min: float, r_max: float, refdip: float = 0.0, by: str = "resid", length_scale: float = 0.1) -> DataFrame:
    """One row for the shell: n, shell_size a frame, mean dipole (debye) and its deviation, radial dipole, radial polarisation beyond ``refdip``; zeros without molecules."""
    rows = _polar(traj, solute, solvent, atoms, r_max, by, length_scale).where((F.col("dist") >= r_min) & (F.col("dist") < r_max) & (F.col("dist") > 0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = rows.agg(F.count("*").alias("n"), zero(F.avg("mu")).alias("dipole"), zero(F.stddev_pop("mu")).alias("dipole_std"), zero(F.avg("radial")).alias("radial_dipole"), zero(F.avg(F.col("radial") - refdip * F.col("turn"))).alias("radial_polarization"))
    return sums.crossJoin(traj.boxes.agg(F.count("*").alias("frames"))).select("n", (F.col("n") / F.col("frames")).alias("shell_size"), "dipole", "dipole_std", "radial_dipole", "radial_polarization")


def ion_pair_corr(traj: Trajectory, cations: Selection, anions: Selection, r_cation: float, r_anion: float, max_lag: int | None = None, by: str = "resid") -> DataFrame:
    """lag, and for all ions, cations and anions how often the nearest counter-ion (ip) and the whole set of near ones (cp) are the same after it.

    An ion is a group's mass center; having none nearby at both times counts as the same. Sets are compared whole.
    """
    parts = []
    for kind, s in (("cation", cations), ("anion", anions)):
        g = traj.points(s, "mass", by).groupBy("frame", by).agg(*[(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(c) for c in "xyz"])
        parts.append(g.select("frame", F.col(by).alias("atom"), "x", "y", "z", F.lit(kind).alias("kind")))
    ions = parts[0].unionByName(parts[1])
    table = [traj.atoms.where(select(s)).select(F.col(by).alias("atom"), F.lit(kind).alias("kind")).distinct() for kind, s in (("cation", cations), ("anion", anions))]
    groups = Trajectory(ions.drop("kind"), table[0].unionByName(table[1]), traj.boxes)
    near = pairs(groups, F.col("kind") == "cation", F.col("kind") == "anion", pbc=True, cutoff=max(r_cation, r_anion))
    both = near.select("frame", F.explode(F.array(*[F.struct(F.col(p).alias("atom"), F.col(q).alias("other"), F.lit(r).alias("reach")) for p, q, r in (("a", "b", r_cation), ("b", "a", r_anion))])).alias("e"), "dist").select("frame", "e.*", "dist")
    held = both.where(F.col("dist") < F.col("reach")).groupBy("frame", "atom").agg(F.min_by("other", F.struct("dist", "other")).alias("pair"), F.sort_array(F.collect_list("other")).alias("cluster"))
    rows = indexed(ions.select("frame", "atom", "kind").join(held, ["frame", "atom"], "left"), ["kind", "atom"])
    rows = lagged(rows, ["kind", "atom"], "idx", ["pair", "cluster"], max_lag)
    same = lambda c: F.col(f"0_{c}").eqNullSafe(F.col(f"1_{c}")).cast("double")
    of = lambda kind, c: F.avg(F.when(F.col("kind") == kind, same(c)))
    return rows.groupBy("lag").agg(*[x for n, c in (("ip", "pair"), ("cp", "cluster")) for x in (F.avg(same(c)).alias(n), of("cation", c).alias(f"{n}_cation"), of("anion", c).alias(f"{n}_anion"))])


#: Elements by their part in contacts.
METALS = ("LI", "NA", "K", "MG", "CA", "MN", "FE", "CO", "NI", "CU", "ZN", "CD", "HG")
HALOGENS = ("CL", "BR", "I")
POLAR = ("N", "O", "S")


def docking_contacts(traj: Trajectory, receptor: Selection, ligand: Selection, close: float, hydrophobic: float, hbond: float, clash: float, metal: float = 2.8, halogen: float = 4.0, salt: float = 4.0) -> DataFrame:
    """frame, receptor, ligand, code, dist, strength of each contact of two atoms; without periodic images.

    Codes: 1 hydrogen bond (hydrogens not looked at, strength 0.5), 2 hydrophobic,
    3 close, 4 clash, 6 halogen, 7 metal; the first that holds of clash, metal,
    halogen, hydrogen bond, hydrophobic, close. Opposite charges within ``salt``
    give no row after those. Strength is 1 - dist / cutoff otherwise. Group
    terms (salt bridges, rings) are not among them.
    """
    reach = max(close, hydrophobic, hbond, clash, metal, halogen, salt)
    p = pairs(traj, receptor, ligand, cutoff=reach, attributes=("element", "charge"))
    kind = lambda names: [F.upper(f"{s}_element").isin(*names) for s in "ab"]
    d, (ma, mb), (ha, hb), (pa, pb), (ca, cb), (ya, yb) = F.col("dist"), *map(kind, (METALS, HALOGENS, POLAR, ("C",), ("H",)))
    code, heavy = F.lit(None).cast("int"), ~ya & ~yb
    rules = [
        (d <= clash, 4), ((d <= metal) & ((ma & pb) | (mb & pa)), 7), ((d <= halogen) & ((ha & pb) | (hb & pa)), 6),
        ((d <= salt) & (F.col("a_charge") * F.col("b_charge") < 0), 0), ((d <= hbond) & pa & pb, 1), ((d <= hydrophobic) & ca & cb, 2), ((d <= close) & heavy, 3),
    ]
    for rule, value in reversed(rules):
        code = F.when(rule, F.lit(value)).otherwise(code)
    cutoff = F.element_at(F.create_map(*[F.lit(x) for k, v in ((2, hydrophobic), (3, close), (4, clash), (6, halogen), (7, metal)) for x in (k, float(v))]), F.col("code"))
    rows = p.withColumn("code", code).where("code > 0")
    strength = F.when(F.col("code") == 1, F.lit(0.5)).otherwise(clamp(1.0 - d / cutoff, 0.0, 1.0))
    return rows.select("frame", F.col("a").alias("receptor"), F.col("b").alias("ligand"), "code", "dist", strength.alias("strength"))


def _voxel(at: Vec, dims: tuple[int, int, int]) -> Column:
    """x first; null outside."""
    inside = reduce(Column.__and__, [(a >= 0) & (a < n) for a, n in zip(at, dims, strict=True)])
    return F.when(inside, at[0] + dims[0] * (at[1] + dims[1] * at[2])).cast("long")


def gist_grid(traj: Trajectory, atoms: tuple[Selection, Selection, Selection], solute: Selection, origin: tuple[float, float, float], dims: tuple[int, int, int], spacing: float, bins: int, by: str = "resid") -> DataFrame:
    """voxel, orientation, n: molecules by the voxel of their first atom and by the cosine of its vector to the middle of the others with that from the solute's center.

    Molecules without an angle have the orientation -1, so the voxel's count is the sum of its rows.
    """
    mol = molecules(traj, dict(zip("abc", atoms, strict=True)), by, ("a",)).join(centers(traj, {"s": solute}), "frame")
    h = tuple((F.col(f"b{c}") + F.col(f"c{c}")) / 2.0 - F.col(f"a{c}") for c in "xyz")
    r = sub(vec("a"), vec("s"))
    n = norm(h) * norm(r)
    turn = F.when(n > 0, F.least(F.floor((clamp(dot(h, r) / n) + 1.0) / 2.0 * bins), F.lit(bins - 1))).otherwise(F.lit(-1))
    at = tuple(F.floor((F.col(f"a{c}") - float(o)) / spacing) for c, o in zip("xyz", origin, strict=True))
    return mol.select(_voxel(at, dims).alias("voxel"), turn.cast("long").alias("orientation")).where("voxel is not null").groupBy("voxel", "orientation").agg(F.count("*").alias("n"))


#: Fixed value: kJ/mol of two unit charges a nanometre apart.
COULOMB = 138.935456


def pair_energy(exceptions: bool = False, coulomb: float = COULOMB) -> tuple[Column, Column]:
    """Lennard-Jones and Coulomb energy of a row of ``pairs`` with charge, sigma and epsilon of both; a pair's own values, where given, instead."""
    mixed = {"q": F.col("a_charge") * F.col("b_charge"), "s": (F.col("a_sigma") + F.col("b_sigma")) / 2.0, "e": F.sqrt(F.col("a_epsilon") * F.col("b_epsilon"))}
    q, s, e = (F.when(F.col("own_q").isNotNull(), F.col(f"own_{k}")).otherwise(v) if exceptions else v for k, v in mixed.items())
    sixth = F.pow(s / F.col("dist"), 6.0)
    apart = lambda v: F.when(F.col("dist") > 0, v).otherwise(0.0)
    return apart(4.0 * e * (sixth * sixth - sixth)), apart(coulomb * q / F.col("dist"))


def _with_exceptions(p: DataFrame, exceptions: DataFrame | None) -> DataFrame:
    if exceptions is None:
        return p
    own = exceptions.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.col("q").alias("own_q"), F.col("sigma").alias("own_s"), F.col("epsilon").alias("own_e"))
    return p.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")}).join(own, ["low", "high"], "left")


def interaction_energy(traj: Trajectory, selection: Selection, cutoff: float | None = None, pbc: bool = True, exceptions: DataFrame | None = None, coulomb: float = COULOMB) -> DataFrame:
    """frame, vdw, ele, total of the selected atoms with all others; parameters as in ``gist_energies``. Without a cutoff every such pair of a frame is made."""
    p = pairs(traj, selection, ~select(selection), pbc=pbc, cutoff=cutoff, attributes=("charge", "sigma", "epsilon"))
    vdw, ele = pair_energy(exceptions is not None, coulomb)
    sums = _with_exceptions(p, exceptions).groupBy("frame").agg(F.sum(vdw).alias("vdw"), F.sum(ele).alias("ele"))
    out = traj.boxes.select("frame").join(sums, "frame", "left").fillna(0.0)
    return out.select("frame", "vdw", "ele", (F.col("vdw") + F.col("ele")).alias("total"))


def gist_energies(traj: Trajectory, solvent: Selection, oxygen: Selection, solute: Selection, cutoff: float, pbc: bool = True, by: str = "resid", exceptions: DataFrame | None = None, coulomb: float = COULOMB) -> DataFrame:
    """frame, by, place of the oxygen, sw, ww of each solvent molecule: its energy with the solute, and half of that with other solvent.

    ``atoms`` has sigma and epsilon beside charge; ``exceptions`` (a, b, q,
    sigma, epsilon) replaces what the atoms say, for a pair in either order.
    Pairs come from cells not narrower than the cutoff. ``coulomb`` is in the
    units of lengths and energies at hand (here nm and kJ/mol).
    """
    attributes = ("charge", "sigma", "epsilon", by)

    def total(other: Selection, name: str, half: bool) -> DataFrame:
        p = pairs(traj, solvent, other, pbc=pbc, cutoff=cutoff, attributes=attributes)
        if half:
            p = p.where(F.col(f"a_{by}") != F.col(f"b_{by}"))
        energy = sum(pair_energy(exceptions is not None, coulomb))
        return _with_exceptions(p, exceptions).groupBy("frame", F.col(f"a_{by}").alias(by)).agg((F.sum(energy) * (0.5 if half else 1.0)).alias(name))

    places = traj.points(oxygen, by).select("frame", by, "x", "y", "z")
    out = places.join(total(solute, "sw", False), ["frame", by], "left").join(total(solvent, "ww", True), ["frame", by], "left")
    return out.fillna(0.0, ["sw", "ww"])


def gist_direct(traj: Trajectory, solvent: Selection, oxygen: Selection, solute: Selection, cutoff: float, origin: tuple[float, float, float], dims: tuple[int, int, int], spacing: float, **options) -> DataFrame:
    """voxel, n, sw, ww: molecules by the voxel of their oxygen, and the sums of their energies over all frames; orientations are in ``gist_grid``."""
    at = tuple(F.floor((F.col(c) - float(o)) / spacing) for c, o in zip("xyz", origin, strict=True))
    rows = gist_energies(traj, solvent, oxygen, solute, cutoff, **options).withColumn("voxel", _voxel(at, dims)).where("voxel is not null")
    return rows.groupBy("voxel").agg(F.count("*").alias("n"), F.sum("sw").alias("sw"), F.sum("ww").alias("ww"))


def gist_frames(traj: Trajectory, solvent: Selection, oxygen: Selection, solute: Selection, cutoff: float, origin: tuple[float, float, float], dims: tuple[int, int, int], spacing: float, **options) -> DataFrame:
    """frame, sw, ww of the molecules inside the grid, total_sw, total_ww of all."""
    at = tuple(F.floor((F.col(c) - float(o)) / spacing) for c, o in zip("xyz", origin, strict=True))
    rows = gist_energies(traj, solvent, oxygen, solute, cutoff, **options).withColumn("inside", _voxel(at, dims).isNotNull())
    return rows.groupBy("frame").agg(*[F.coalesce(F.sum(F.when(F.col("inside"), F.col(k))), F.lit(0.0)).alias(k) for k in ("sw", "ww")], *[F.sum(k).alias(f"total_{k}") for k in ("sw", "ww")])


def free_volume(traj: Trajectory, selection: Selection, center: Selection, unit: float, dims: tuple[int, int, int], probe: float = 0.0) -> DataFrame:
    """voxel, mean, std (population), first, last, min, max of being free, in a region about a center.

    An atom in the region occupies the voxels whose centers are within ``probe`` of it, or its own if ``probe`` is 0.
    """
    spark = traj.frames.sparkSession
    rows = traj.points(selection).join(centers(traj, {"c": center}), "frame")
    place = tuple(F.col(c) - F.col(f"c{c}") + n * unit / 2.0 for c, n in zip("xyz", dims, strict=True))
    rows = rows.select("frame", *_named(place, "p"), *_named(tuple(F.floor(x / unit) for x in place), "i"))
    rows = rows.where(_voxel(vec("i"), dims).isNotNull())
    if probe > 0:
        reach = -int(-probe // unit)
        for c in "xyz":
            rows = rows.withColumn(f"i{c}", F.explode(F.sequence(F.col(f"i{c}") - reach, F.col(f"i{c}") + reach)))
        off = tuple((F.col(f"i{c}") + 0.5) * unit - F.col(f"p{c}") for c in "xyz")
        rows = rows.where(dot(off, off) <= probe * probe)
    taken = rows.select("frame", _voxel(vec("i"), dims).alias("voxel")).where("voxel is not null").distinct()
    ends = traj.boxes.agg(F.count("*").alias("frames"), F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    n = taken.crossJoin(F.broadcast(ends)).groupBy("voxel").agg(F.count("*").alias("n"), F.max((F.col("frame") == F.col("f0")).cast("long")).alias("n0"), F.max((F.col("frame") == F.col("f1")).cast("long")).alias("n1"))  # one row
    every = spark.range(dims[0] * dims[1] * dims[2]).select(F.col("id").alias("voxel")).join(n, "voxel", "left").fillna(0).crossJoin(F.broadcast(ends))  # one row
    mean = 1.0 - F.col("n") / F.col("frames")
    return every.select("voxel", mean.alias("mean"), F.sqrt(F.greatest(mean - mean * mean, F.lit(0.0))).alias("std"), (1 - F.col("n0")).alias("first"), (1 - F.col("n1")).alias("last"), (F.col("n") == 0).cast("long").alias("min"), (F.col("n") < F.col("frames")).cast("long").alias("max"))


#: Grams a cubic centimetre of one dalton a cubic angstrom.
DALTON_DENSITY = 1.66053906660


def bondi_ffv(traj: Trajectory, selection: Selection = None, scale: float = 1.3, probe: float = 0.0, points_per_nm3: int = 1000, seed: int = 0) -> DataFrame:
    """frame, total, occupied and free volume, free_fraction, ffv (1 - scale * occupied fraction), density of each frame.

    Points drawn uniformly in the box are free where no atom's radius, and the
    probe's, reaches them. Every draw is numbered (SplitMix64 by frame), so it
    doesn't matter where it is made; a frame's points are dealt into blocks, and
    each is one row of the function, with the frame's atoms.
    """
    from driftline.operators.linear import OTHER_RADIUS, RADII

    radius = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RADII.items() for x in kv]), F.upper("element")), F.lit(OTHER_RADIUS)) + float(probe)
    volume = F.col("lx") * F.col("ly") * F.col("lz")
    boxes = traj.boxes.select("frame", "lx", "ly", "lz", volume.alias("total"), F.greatest(F.round(volume / 1000.0 * points_per_nm3), F.lit(1.0)).cast("long").alias("n"))
    order = traj.boxes.select("frame", (F.row_number().over(Window.orderBy("frame")) - 1).cast("long").alias("place"))  # a row for each frame
    atoms = traj.points(selection, "element", "mass").groupBy("frame").agg(F.collect_list(F.array(F.col("x"), F.col("y"), F.col("z"), radius)).alias("atoms"), F.sum("mass").alias("mass"))
    blocks = boxes.join(order, "frame").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / POINT_BLOCK))))
    rows = blocks.join(atoms.select("frame", "atoms"), "frame", "left").select("frame", "place", "lx", "ly", "lz", "n", "block", "atoms")

    def free(parts):
        for d in parts:
            counts = []
            for r in d.itertuples():
                k = np.arange(r.block * POINT_BLOCK, min((r.block + 1) * POINT_BLOCK, r.n), dtype=np.uint64)
                box = np.array([r.lx, r.ly, r.lz])
                points = uniform(seed, r.place, k[:, None] * np.uint64(3) + np.arange(3, dtype=np.uint64)) * box
                open_ = np.ones(len(points), bool)
                for x, y, z, reach in [] if r.atoms is None else r.atoms:
                    apart = np.abs(points - (x, y, z))
                    apart = np.minimum(apart, box - apart)
                    open_ &= (apart * apart).sum(axis=1) >= reach * reach
                counts.append(int(open_.sum()))
            yield pd.DataFrame({"frame": d["frame"], "free": counts})

    share = rows.mapInPandas(free, "frame long, free long").groupBy("frame").agg(F.sum("free").alias("free"))
    out = boxes.join(share, "frame").join(atoms.select("frame", "mass"), "frame", "left")
    fraction = F.col("free") / F.col("n")
    return out.select("frame", "total", (F.col("total") * (1.0 - fraction)).alias("occupied"), (F.col("total") * fraction).alias("free"), fraction.alias("free_fraction"), (1.0 - scale * (1.0 - fraction)).alias("ffv"), (F.coalesce("mass", F.lit(0.0)) * DALTON_DENSITY / F.col("total")).alias("density"))


#: Points of a block of draws.
POINT_BLOCK = 1 << 14


def uniform(seed: int, stream: int, k: np.ndarray) -> np.ndarray:
    """The numbers ``k`` (from 0) of SplitMix64's doubles in [0, 1), seeded by ``seed`` and a multiple of ``stream``."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        begin = np.uint64(seed & (1 << 64) - 1) ^ np.uint64(stream) * step
        z = begin + (k + np.uint64(1)) * step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) / float(1 << 53)
