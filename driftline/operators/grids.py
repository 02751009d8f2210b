"""Histograms along an axis and on voxel grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import norm, periodic_bin, sub, vec
from driftline.model import Selection, Trajectory
from driftline.operators.common import centers, filled


def lineardensity(traj: Trajectory, selection: Selection = None, axis: str = "z", bins: int = 50, weight: str = "number") -> DataFrame:
    """Mean weight of each slice in a frame, over the slice's mean volume."""
    rows = traj.points(selection, "mass", "charge", box=True)
    w = {"number": F.lit(1.0), "mass": F.col("mass"), "charge": F.col("charge")}[weight]
    sums = rows.groupBy(periodic_bin(F.col(axis), F.col(f"l{axis}"), bins).alias("bin")).agg(F.sum(w).alias("w"))
    box = traj.boxes.agg(F.count("*").alias("frames"), F.avg(F.col("lx") * F.col("ly") * F.col("lz")).alias("v"), F.avg(f"l{axis}").alias("l"))
    out = filled(sums, bins, fill={"w": 0.0}).join(F.broadcast(box))  # one row
    return out.select("bin", ((F.col("bin") + 0.5) * F.col("l") / bins).alias("center"), (F.col("w") / F.col("frames") / (F.col("v") / bins)).alias("density"))


def densmap(traj: Trajectory, selection: Selection = None, axis: str = "z", bins: int = 10) -> DataFrame:
    """Number density on the plane across ``axis``, mean over frames."""
    i, j = [c for c in "xyz" if c != axis]
    rows = traj.points(selection, box=True)
    sums = rows.groupBy(*[periodic_bin(F.col(c), F.col(f"l{c}"), bins).alias(f"i{c}") for c in (i, j)]).agg(F.count("*").alias("n"))
    box = traj.boxes.agg(F.count("*").alias("frames"), F.avg(F.col("lx") * F.col("ly") * F.col("lz")).alias("v"))
    out = sums.join(F.broadcast(box))  # one row
    return out.select(F.col(f"i{i}").alias("i"), F.col(f"i{j}").alias("j"), (F.col("n") / F.col("frames") / (F.col("v") / (bins * bins))).alias("density"))


def water_count(traj: Trajectory, water: Selection, center: Selection, unit: float, dims: tuple[int, int, int], shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """voxel (x first), mean, std (population), first, last, min, max of the atoms in each voxel about a center."""
    rows = traj.points(water).join(centers(traj, {"c": center}), "frame")
    at = [F.floor((F.col(c) - F.col(f"c{c}") + float(s)) / unit) for c, s in zip("xyz", shift, strict=True)]
    inside = [(a >= 0) & (a < n) for a, n in zip(at, dims, strict=True)]
    counts = rows.where(inside[0] & inside[1] & inside[2]).groupBy("frame", (at[0] + dims[0] * (at[1] + dims[1] * at[2])).alias("voxel")).agg(F.count("*").alias("n"))
    frames = traj.boxes.agg(F.count("*").alias("frames"), F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    counts = counts.join(F.broadcast(frames))  # one row
    n = F.col("n")
    g = counts.groupBy("voxel").agg(F.first("frames").alias("frames"), F.count("*").alias("seen"), F.sum(n).alias("s"), F.sum(n * n).alias("q"), F.max(F.when(F.col("frame") == F.col("f0"), n)).alias("first"), F.max(F.when(F.col("frame") == F.col("f1"), n)).alias("last"), F.min(n).alias("low"), F.max(n).alias("high"))
    mean = F.col("s") / F.col("frames")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return g.select("voxel", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("frames") - mean * mean, F.lit(0.0))).alias("std"), zero("first"), zero("last"), F.when(F.col("seen") < F.col("frames"), F.lit(0)).otherwise(F.col("low")).cast("long").alias("min"), F.col("high").alias("max"))


def density(traj: Trajectory, water: Selection, center: Selection, unit: float, dims: tuple[int, int, int], shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    v = unit**3
    return water_count(traj, water, center, unit, dims, shift).select("voxel", (F.col("mean") / v).alias("mean"), (F.col("std") / v).alias("std"))


def potential(traj: Trajectory, selection: Selection = None, axis: str = "z", bins: int = 50) -> DataFrame:
    """Charge density, field and potential along an axis, by two trapezoid sums."""
    from driftline.operators.correlation import E_CHARGE, EPSILON_0

    rho = lineardensity(traj, selection, axis, bins, "charge")
    length = traj.boxes.agg((F.avg(f"l{axis}") / bins).alias("d"))
    w = Window.orderBy("bin")  # a row for each of the bins
    trapezoid = lambda c: F.sum(F.coalesce((F.col(c) + F.lag(c).over(w)) / 2.0 * F.col("d"), F.lit(0.0)))
    k = E_CHARGE * 1e9 / EPSILON_0
    step = rho.join(F.broadcast(length)).withColumn("half", F.coalesce((F.col("density") + F.lag("density").over(w)) / 2.0 * F.col("d"), F.lit(0.0)))  # one row
    step = step.withColumn("sum1", F.sum("half").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = step.withColumn("half2", F.coalesce((F.col("sum1") + F.lag("sum1").over(w)) / 2.0 * F.col("d"), F.lit(0.0)))
    return step.select("bin", "density", (F.col("sum1") * k).alias("field"), (-k * F.sum("half2").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("potential"))


def h2order(traj: Trajectory, selection: Selection = None, axis: str = "z", slices: int = 10) -> DataFrame:
    """Mean cosine of the residues' dipoles with an axis, in slices by the residues' centers."""
    rows = traj.points(selection, "resid", "charge", box=True)
    g = rows.groupBy("frame", "resid").agg(F.first(f"l{axis}").alias("l"), F.avg(axis).alias("at"), *[F.sum(F.col("charge") * F.col(c)).alias(f"d{c}") for c in "xyz"])
    g = g.withColumn("n", norm(vec("d"))).where("n > 0")
    return g.groupBy(periodic_bin(F.col("at"), F.col("l"), slices).alias("bin")).agg(F.avg(F.col(f"d{axis}") / F.col("n")).alias("cos"), F.avg("n").alias("dipole"))


def hydorder(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """Tetrahedral order of each atom from its four nearest: sg (angles) and sk (distances)."""
    from driftline.operators.common import pairs

    near = pairs(traj, selection, selection, pbc=True)
    rank = F.row_number().over(Window.partitionBy("frame", "a").orderBy("dist", "b"))
    near = near.withColumn("rank", rank).where("rank <= 4").select("frame", "a", "rank", "dist", *[(F.col(f"d{c}") / F.col("dist")).alias(f"u{c}") for c in "xyz"])
    mean = near.groupBy("frame", "a").agg(F.avg("dist").alias("m"), F.count("*").alias("n")).where("n = 4")
    d = F.col("dist") - F.col("m")
    sk = near.join(mean, ["frame", "a"]).groupBy("frame", "a").agg((F.sum(d * d) / (12.0 * F.first("m") * F.first("m"))).alias("sk"))
    i, j = (near.select("frame", "a", F.col("rank").alias(f"r{k}"), *[F.col(f"u{c}").alias(f"u{k}{c}") for c in "xyz"]) for k in (1, 2))
    c = sum(F.col(f"u1{x}") * F.col(f"u2{x}") for x in "xyz") + 1.0 / 3.0
    sg = i.join(j, ["frame", "a"]).where("r1 < r2").groupBy("frame", "a").agg((3.0 / 32.0 * F.sum(c * c)).alias("sg"))
    return sg.join(sk, ["frame", "a"]).select("frame", F.col("a").alias("atom"), "sg", "sk")


def distance_vectors(traj: Trajectory, listed: list[tuple[int, int]]) -> DataFrame:
    """Unit vectors of atom pairs."""
    table = traj.frames.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(listed)], "pair int, a long, b long")
    side = lambda s: traj.frames.select("frame", F.col("atom").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in "xyz"])
    d = sub(vec("b_"), vec("a_"))
    return side("a").join(table, "a").join(side("b"), ["frame", "b"]).select("frame", "pair", *[(x / norm(d)).alias(f"u{c}") for x, c in zip(d, "xyz", strict=True)])
