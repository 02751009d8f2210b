"""Time correlation: pairs of frames a lag apart inside each stream."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import dot, norm, sub, vec
from driftline.functions.selection import select
from driftline.model import Selection, Trajectory
from driftline.operators.common import centers, indexed, lagged, multi_tau
from driftline.operators.transforms import get_velocity, unwrap

XYZ = ["x", "y", "z"]


def require_uniform(traj: Trajectory, tolerance: float = 1e-6) -> None:
    """Raises unless all frames are as far apart in time; reads the box table only."""
    steps = traj.boxes.select("frame", "time_ps").withColumn("dt", F.col("time_ps") - F.lag("time_ps").over(Window.orderBy("frame")))
    r = steps.agg(F.min("dt").alias("low"), F.max("dt").alias("high")).collect()[0]
    if r["low"] is not None and r["high"] - r["low"] > tolerance:
        raise ValueError("frames are not evenly spaced in time")


def group_centers(traj: Trajectory, selection: Selection = None, by: str = "resid", unwrapped: bool = True) -> DataFrame:
    rows = traj.points(selection, "mass", by).groupBy("frame", by).agg(*[(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(c) for c in "xyz"])
    return unwrap(traj, rows, [by]) if unwrapped else rows


def msd(traj: Trajectory, selection: Selection = None, by: str = "resid", max_lag: int | None = None, unwrapped: bool = True, types: str | None = None, mode: str = "exact", m: int = 16, levels: int = 20) -> DataFrame:
    """lag, x, y, z, total: mean squared displacement of the groups' centers.

    With ``types``, an attribute that the atoms of a group share, there is a row
    for each type as well, and the one of all has a null type. ``multi_tau``
    takes lags up to (m - 1) * 2^(levels - 1), further apart the longer they
    are, from means of as many frames.
    """
    require_uniform(traj)
    rows = indexed(group_centers(traj, selection, by, unwrapped), [by])
    if mode == "multi_tau":
        most = max(1, math.ceil(math.log2(max(traj.boxes.count(), 2))))
        rows = multi_tau(rows, [by], "idx", XYZ, m, min(levels, most))
    elif mode == "exact":
        rows = lagged(rows, [by], "idx", XYZ, max_lag).where("lag > 0")
    else:
        raise ValueError(f"no mode {mode}")
    square = lambda c: (F.col(f"1_{c}") - F.col(f"0_{c}")) * (F.col(f"1_{c}") - F.col(f"0_{c}"))
    means = [F.avg(square(c)).alias(c) for c in "xyz"] + [F.avg(sum(square(c) for c in "xyz")).alias("total")]
    if types is None:
        return rows.groupBy("lag").agg(*means)
    kinds = traj.atoms.where(select(selection)).groupBy(by).agg(F.first(types).alias("type"))
    return rows.join(kinds, by).groupingSets([["lag", "type"], ["lag"]], "lag", "type").agg(*means)


def lipid_msd(traj: Trajectory, selection: Selection = None, max_lag: int | None = None) -> DataFrame:
    """Lateral, for each residue, without unwrapping."""
    rows = traj.points(selection, "resid").groupBy("frame", "resid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    rows = lagged(indexed(rows, ["resid"]), ["resid"], "idx", ["x", "y"], max_lag).where("lag > 0")
    d = lambda c: (F.col(f"1_{c}") - F.col(f"0_{c}")) * (F.col(f"1_{c}") - F.col(f"0_{c}"))
    return rows.groupBy("resid", "lag").agg(F.avg(d("x") + d("y")).alias("msd"))


def atomiccorr(traj: Trajectory, selection: Selection = None, reference: int | None = None, max_lag: int | None = None) -> DataFrame:
    """Mean over origins of the sum over atoms of d(t).d(t + lag), d being the displacement from the reference."""
    ref = traj.at(reference).select("atom", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    rows = traj.points(selection).join(ref, "atom").select("frame", "atom", *[(F.col(c) - F.col(f"r{c}")).alias(c) for c in "xyz"])
    rows = lagged(indexed(rows, ["atom"]), ["atom"], "idx", XYZ, max_lag)
    sums = rows.groupBy("lag", "idx").agg(F.sum(dot(vec("0_"), vec("1_"))).alias("s"))
    return sums.groupBy("lag").agg(F.avg("s").alias("corr"))


def xcorr(traj: Trajectory, sel_a: Selection, sel_b: Selection, max_lag: int | None = None) -> DataFrame:
    """Of the displacements of two centers from where they are in the first frame."""
    rows = centers(traj, {"a": sel_a, "b": sel_b}).withColumn("stream", F.lit(0))
    w = Window.partitionBy("stream").orderBy("frame")
    rows = rows.select("frame", "stream", *[(F.col(f"{s}{c}") - F.first(f"{s}{c}").over(w)).alias(f"{s}{c}") for s in "ab" for c in "xyz"])
    rows = lagged(indexed(rows, ["stream"]), ["stream"], "idx", [f"{s}{c}" for s in "ab" for c in "xyz"], max_lag)
    return rows.groupBy("lag").agg(F.avg(dot(vec("0_a"), vec("1_b"))).alias("corr"))


def velocityautocorr(traj: Trajectory, selection: Selection = None, max_lag: int | None = None, normalize: bool = False) -> DataFrame:
    v = get_velocity(traj, selection)
    first = v.groupBy("atom").agg(F.min("frame").alias("first"))
    rows = v.join(first, "atom").where("frame > first").drop("first")
    rows = lagged(indexed(rows, ["atom"]), ["atom"], "idx", ["vx", "vy", "vz"], max_lag)
    out = rows.groupBy("lag").agg(F.avg(dot(vec("0_v"), vec("1_v"))).alias("vacf"))
    # a row for each lag
    return out.withColumn("vacf", F.col("vacf") / F.first("vacf").over(Window.orderBy("lag"))) if normalize else out


def rotacf(traj: Trajectory, first: Selection, last: Selection, by: str = "resid", max_lag: int | None = None) -> DataFrame:
    """P1 and P2 of the unit vectors from the center of ``first`` to that of ``last`` in each group."""
    ends = [traj.points(sel, by).groupBy("frame", by).agg(*[F.avg(c).alias(f"{s}{c}") for c in "xyz"]) for s, sel in (("a", first), ("b", last))]
    d = sub(vec("b"), vec("a"))
    rows = ends[0].join(ends[1], ["frame", by]).select("frame", by, *[(c / norm(d)).alias(n) for c, n in zip(d, "xyz", strict=True)])
    rows = lagged(indexed(rows, [by]), [by], "idx", XYZ, max_lag)
    c = dot(vec("0_"), vec("1_"))
    return rows.groupBy("lag").agg(F.avg(c).alias("p1"), F.avg(1.5 * c * c - 0.5).alias("p2"))


def vanhove(traj: Trajectory, selection: Selection = None, r_bin: float = 1.0, r_max: float = 50.0, max_lag: int | None = None) -> DataFrame:
    """lag, bin, g: share of the displacements of a lag in each bin."""
    rows = lagged(indexed(traj.points(selection), ["atom"]), ["atom"], "idx", XYZ, max_lag).withColumn("r", norm(sub(vec("1_"), vec("0_"))))
    total = rows.groupBy("lag").agg(F.count("*").alias("total"))
    counts = rows.where(F.col("r") < r_max).groupBy("lag", F.floor(F.col("r") / r_bin).alias("bin")).agg(F.count("*").alias("n"))
    return counts.join(total, "lag").select("lag", "bin", (F.col("n") / F.col("total")).alias("g"))


#: Elementary charge (C) and the Boltzmann constant (J/K).
E_CHARGE, K_BOLTZMANN, EPSILON_0 = 1.602176634e-19, 1.380649e-23, 8.8541878128e-12


def conductivity(traj: Trajectory, selection: Selection = None, by: str = "resid", temperature: float = 300.0, max_lag: int | None = None) -> DataFrame:
    """Squared displacement of the summed dipole of unwrapped charged centers against lag, over 6 kB T V (V in nm^3)."""
    require_uniform(traj)
    charge = traj.points(selection, by, "charge").groupBy("frame", by).agg(F.sum("charge").alias("q"))
    rows = group_centers(traj, selection, by).join(charge, ["frame", by])
    total = rows.groupBy("frame").agg(*[F.sum(F.col("q") * F.col(c)).alias(c) for c in "xyz"]).withColumn("stream", F.lit(0))
    rows = lagged(indexed(total, ["stream"]), ["stream"], "idx", XYZ, max_lag).where("lag > 0")
    d = sub(vec("1_"), vec("0_"))
    v = traj.boxes.agg(F.avg(F.col("lx") * F.col("ly") * F.col("lz")).alias("v"))
    out = rows.groupBy("lag").agg(F.avg(dot(d, d)).alias("m2")).join(F.broadcast(v))  # one row
    return out.select("lag", "m2", (F.col("m2") / F.col("v") * (E_CHARGE**2 / (6 * K_BOLTZMANN * temperature * 1e-27))).alias("sigma"))


def dipole_moments(traj: Trajectory, selection: Selection = None, by: str = "resid") -> DataFrame:
    return traj.points(selection, by, "charge").groupBy("frame", by).agg(*[F.sum(F.col("charge") * F.col(c)).alias(f"d{c}") for c in "xyz"])


def dipole_alignment(traj: Trajectory, selection: Selection = None, by: str = "resid") -> DataFrame:
    """Means of the dipoles' direction cosines and of their squares in each frame."""
    d = dipole_moments(traj, selection, by).withColumn("n", norm(vec("d"))).where("n > 0")
    cos = lambda c: F.col(f"d{c}") / F.col("n")
    return d.groupBy("frame").agg(*[F.avg(cos(c)).alias(f"cos_{c}") for c in "xyz"], *[F.avg(cos(c) * cos(c)).alias(f"cos2_{c}") for c in "xyz"])


def dielectric(traj: Trajectory, selection: Selection = None, by: str = "resid", temperature: float = 300.0) -> DataFrame:
    """One row: mean squared rotational, translational and crossed dipole, and the static constant."""
    g = traj.points(selection, by, "charge", "mass").groupBy("frame", by).agg(F.sum("charge").alias("q"), *[F.sum(F.col("charge") * F.col(c)).alias(f"d{c}") for c in "xyz"], *[(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(f"m{c}") for c in "xyz"])
    t = g.groupBy("frame").agg(*[F.sum(F.col(f"d{c}") - F.col("q") * F.col(f"m{c}")).alias(f"r{c}") for c in "xyz"], *[F.sum(F.col("q") * F.col(f"m{c}")).alias(f"t{c}") for c in "xyz"])
    v = traj.boxes.agg(F.avg(F.col("lx") * F.col("ly") * F.col("lz")).alias("v"))
    m = [F.col(f"r{c}") + F.col(f"t{c}") for c in "xyz"]
    fluctuation = sum(F.var_pop(c) for c in m)
    out = t.agg(F.avg(dot(vec("r"), vec("r"))).alias("rot2"), F.avg(dot(vec("t"), vec("t"))).alias("trans2"), F.avg(dot(vec("r"), vec("t"))).alias("cross"), fluctuation.alias("f")).join(F.broadcast(v))  # one row
    factor = (E_CHARGE * 1e-10) ** 2 / (3 * EPSILON_0 * K_BOLTZMANN * temperature * 1e-30)
    return out.select("rot2", "trans2", "cross", (1.0 + F.col("f") * factor / F.col("v")).alias("epsilon"))


def dipole_squares(traj: Trajectory, selection: Selection = None, by: str = "resid") -> DataFrame:
    """frame, rot2, trans2, cross: of each frame's summed dipole about the groups' centers and of the centers' charges."""
    g = traj.points(selection, by, "charge", "mass").groupBy("frame", by).agg(F.sum("charge").alias("q"), *[F.sum(F.col("charge") * F.col(c)).alias(f"d{c}") for c in "xyz"], *[(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(f"m{c}") for c in "xyz"])
    t = g.groupBy("frame").agg(*[F.sum(F.col(f"d{c}") - F.col("q") * F.col(f"m{c}")).alias(f"r{c}") for c in "xyz"], *[F.sum(F.col("q") * F.col(f"m{c}")).alias(f"t{c}") for c in "xyz"])
    return t.select("frame", dot(vec("r"), vec("r")).alias("rot2"), dot(vec("t"), vec("t")).alias("trans2"), dot(vec("r"), vec("t")).alias("cross"))


def current(traj: Trajectory, selection: Selection = None, by: str = "resid", temperature: float = 300.0, max_lag: int | None = None) -> DataFrame:
    """quantity, idx, value: conductivity by lag, the dipole's squares by frame, and as idx 0 the static conductivity (of the last lag) and dielectric constant."""
    sigma = conductivity(traj, selection, by, temperature, max_lag).select("lag", "sigma")
    squares = dipole_squares(traj, selection, by)
    one = lambda df, name, idx, value: df.select(F.lit(name).alias("quantity"), F.col(idx).cast("long").alias("idx"), F.col(value).cast("double").alias("value"))
    out = one(sigma, "conductivity", "lag", "sigma")
    for name, column in (("md_sq", "rot2"), ("mj_sq", "trans2"), ("md_mj", "cross")):
        out = out.unionByName(one(squares, name, "frame", column))
    last = sigma.agg(F.max_by("sigma", "lag").alias("value")).withColumn("idx", F.lit(0))
    epsilon = dielectric(traj, selection, by, temperature).select(F.col("epsilon").alias("value"), F.lit(0).alias("idx"))
    return out.unionByName(one(last, "conductivity_static", "idx", "value")).unionByName(one(epsilon, "dielectric_total", "idx", "value"))


def equipartition(traj: Trajectory, selection: Selection = None, by: str = "chain") -> DataFrame:
    """Temperature of each group and frame with the coordinates read as velocities (nm/ps)."""
    kb = 0.00831446261815324  # kJ/mol/K
    rows = traj.points(selection, by, "mass")
    ke = F.sum(0.5 * F.col("mass") * (F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    return rows.groupBy("frame", by).agg((2.0 * ke / (3.0 * F.count("*") * kb)).alias("temperature"))


def wavelet(traj: Trajectory, sel_a: Selection, sel_b: Selection) -> DataFrame:
    """level, k, smooth, detail of the Haar pyramid (a +- b) / 2 of the centers' distance."""
    from driftline.operators.distances import distance

    row = distance(traj, sel_a, sel_b).select("frame", F.col("dist").alias("s"))
    n = traj.boxes.count()
    level, out = row.select(F.col("frame").alias("k"), "s"), None
    for k in range(1, max(1, math.floor(math.log2(max(n, 1)))) + 1):
        side = lambda r: F.max(F.when(F.col("k") % 2 == r, F.col("s")))
        half = level.groupBy(F.floor(F.col("k") / 2).alias("k")).agg(side(0).alias("a"), side(1).alias("b")).where("b is not null")
        half = half.select("k", ((F.col("a") + F.col("b")) / 2).alias("s"), ((F.col("a") - F.col("b")) / 2).alias("detail"))
        step = half.select(F.lit(k).cast("long").alias("level"), "k", F.col("s").alias("smooth"), "detail")
        out, level = step if out is None else out.unionByName(step), half.select("k", "s")
    return out
