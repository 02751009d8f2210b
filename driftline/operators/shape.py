"""Size and shape of a selection in each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.geometry import eigenvalues
from driftline.model import Selection, Trajectory

TENSOR = ("xx", "yy", "zz", "xy", "xz", "yz")


def centered(traj: Trajectory, selection: Selection, mass_weighted: bool, keys: tuple[str, ...] = ("frame",), *more: str) -> DataFrame:
    """Points with w (weight) and x, y, z about the center of their frame (and further keys)."""
    points = traj.points(selection, *dict.fromkeys(("mass", *more, *[k for k in keys if k != "frame"])))
    points = points.withColumn("w", F.col("mass") if mass_weighted else F.lit(1.0))
    middle = points.groupBy(*keys).agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"c{c}") for c in "xyz"])
    return points.join(middle, list(keys)).withColumns({c: F.col(c) - F.col(f"c{c}") for c in "xyz"})


def _tensor() -> list[Column]:
    return [(F.sum(F.col("w") * F.col(t[0]) * F.col(t[1])) / F.sum("w")).alias(t) for t in TENSOR]


def _rg() -> Column:
    return F.coalesce(F.sqrt(F.sum(F.col("w") * (F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)) / F.sum("w")), F.lit(0.0))


def rg(traj: Trajectory, selection: Selection = None, mass_weighted: bool = False) -> DataFrame:
    return centered(traj, selection, mass_weighted).groupBy("frame").agg(_rg().alias("rg"))


def radgyr_tensor(traj: Trajectory, selection: Selection = None, mass_weighted: bool = False) -> DataFrame:
    return centered(traj, selection, mass_weighted).groupBy("frame").agg(_rg().alias("rg"), *_tensor())


def radgyr(traj: Trajectory, selection: Selection = None, mass_weighted: bool = False) -> DataFrame:
    """rg, the largest distance from the center, and the radii about the three axes."""
    out = centered(traj, selection, mass_weighted).groupBy("frame").agg(_rg().alias("rg"), F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("r_max"), *_tensor())
    return out.select("frame", "rg", "r_max", F.sqrt(F.col("yy") + F.col("zz")).alias("rg_x"), F.sqrt(F.col("xx") + F.col("zz")).alias("rg_y"), F.sqrt(F.col("xx") + F.col("yy")).alias("rg_z"))


def shape_descriptors(traj: Trajectory, selection: Selection = None, mass_weighted: bool = False) -> DataFrame:
    t = radgyr_tensor(traj, selection, mass_weighted)
    low, mid, top = eigenvalues(*[F.col(c) for c in TENSOR])
    t = t.select("frame", "rg", low.alias("l1"), mid.alias("l2"), top.alias("l3"))
    total = F.col("l1") + F.col("l2") + F.col("l3")
    squares = F.col("l1") ** 2 + F.col("l2") ** 2 + F.col("l3") ** 2
    return t.select("*", (F.col("l3") - 0.5 * (F.col("l1") + F.col("l2"))).alias("asphericity"), (F.col("l2") - F.col("l1")).alias("acylindricity"), (1.5 * squares / (total * total) - 0.5).alias("anisotropy"))


def center_of_mass(traj: Trajectory, selection: Selection = None) -> DataFrame:
    points = traj.points(selection, "mass")
    return points.groupBy("frame").agg(*[(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(c) for c in "xyz"])


def center_of_geometry(traj: Trajectory, selection: Selection = None) -> DataFrame:
    return traj.points(selection).groupBy("frame").agg(*[F.avg(c).alias(c) for c in "xyz"])


def chain_rg(traj: Trajectory, selection: Selection = None) -> DataFrame:
    return centered(traj, selection, False, ("frame", "chain")).groupBy("frame", "chain").agg(_rg().alias("rg"))


def check_structure(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """Atoms whose coordinates are not finite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return traj.points(selection).groupBy("frame").agg(F.sum((bad("x") | bad("y") | bad("z")).cast("long")).alias("n_bad"))
