"""Pair-distance histograms, radial distributions and the structure factor."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.model import Selection, Trajectory
from driftline.operators.common import filled, pairs


def _counts(traj: Trajectory, sel_a: Selection, sel_b: Selection, width: float, r_max: float, pbc: bool, keys: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    found = pairs(traj, sel_a, sel_b, pbc=pbc, cutoff=r_max, unique=unique).where(F.col("dist") < r_max)
    return found.groupBy(*keys, F.floor(F.col("dist") / width).alias("bin")).agg(F.count("*").alias("n"))


def _totals(traj: Trajectory, sel_a: Selection, sel_b: Selection) -> DataFrame:
    """One row: frames, mean volume, atoms of either side, pairs of different atoms."""
    from driftline.functions.selection import select

    a, b = select(sel_a), select(sel_b)
    n = traj.atoms.agg(F.sum(a.cast("long")).alias("n_a"), F.sum(b.cast("long")).alias("n_b"), F.sum((a & b).cast("long")).alias("n_both"))
    box = traj.boxes.agg(F.count("*").alias("frames"), F.avg(F.col("lx") * F.col("ly") * F.col("lz")).alias("volume"))
    return n.join(F.broadcast(box))  # one row each


def pairdist_histogram(traj: Trajectory, sel_a: Selection, sel_b: Selection, bins: int, r_max: float, pbc: bool = False) -> DataFrame:
    return filled(_counts(traj, sel_a, sel_b, r_max / bins, r_max, pbc), bins)


def rdf(traj: Trajectory, sel_a: Selection, sel_b: Selection, bins: int, r_max: float, pbc: bool = True) -> DataFrame:
    """bin, r, n, g, integral (mean number of b within the bin's outer edge of an a)."""
    width = r_max / bins
    rows = pairdist_histogram(traj, sel_a, sel_b, bins, r_max, pbc).join(F.broadcast(_totals(traj, sel_a, sel_b)))  # one row
    shell = F.lit(4.0 / 3.0 * math.pi) * (F.pow((F.col("bin") + 1) * width, F.lit(3.0)) - F.pow(F.col("bin") * width, F.lit(3.0)))
    per = F.col("frames") * F.col("n_a")
    g = F.col("n") / (per * shell * F.col("n_b") / F.col("volume"))
    # the bins are few, whatever the trajectory
    running = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("bin", ((F.col("bin") + 0.5) * width).alias("r"), "n", g.alias("g"), (running / per).alias("integral"))


def pairdist(traj: Trajectory, sel_a: Selection, sel_b: Selection, bins: int, r_max: float, pbc: bool = False, unique: bool = False) -> DataFrame:
    """Mean per frame and width, and the sample deviation of it over frames, zeros counted."""
    width = r_max / bins
    counts = _counts(traj, sel_a, sel_b, width, r_max, pbc, ("frame",), unique)
    frames = traj.boxes.agg(F.count("*").alias("frames"))
    sums = counts.groupBy("bin").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    rows = filled(sums, bins).join(F.broadcast(frames))  # one row
    mean = F.col("s") / F.col("frames")
    var = (F.col("q") - F.col("s") * mean) / (F.col("frames") - 1)
    return rows.select("bin", (mean / width).alias("mean"), (F.sqrt(F.greatest(var, F.lit(0.0))) / width).alias("std"))


def pairdist_dynamic(traj: Trajectory, sel_a: Selection, sel_b: Selection, delta: float, pbc: bool = False) -> DataFrame:
    found = pairs(traj, sel_a, sel_b, pbc=pbc)
    return found.groupBy(F.floor(F.col("dist") / delta).alias("bin")).agg(F.count("*").alias("n"))


def structure_factor(traj: Trajectory, selection: Selection, bins: int, r_max: float, q_bins: int, q_max: float, pbc: bool = True) -> DataFrame:
    """1 + 4 pi rho sum of (g - 1) sinc(q r) r^2 dr, with shells 4 pi r^2 dr at the middle of each bin."""
    width = r_max / bins
    rows = pairdist_histogram(traj, selection, selection, bins, r_max, pbc).join(F.broadcast(_totals(traj, selection, selection)))  # one row
    r = (F.col("bin") + 0.5) * width
    rho = F.col("n_a") / F.col("volume")
    g = F.col("n") / (F.col("frames") * F.col("n_a") * rho * 4.0 * math.pi * r * r * width)
    rows = rows.select(r.alias("r"), g.alias("g"), rho.alias("rho"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(q_bins).cast("long"))).alias("k"))
    qr = F.col("k") * (q_max / q_bins) * F.col("r")
    term = (F.col("g") - 1.0) * F.sin(qr) / qr * F.col("r") * F.col("r") * width
    return rows.groupBy("k").agg((1.0 + 4.0 * math.pi * F.first("rho") * F.sum(term)).alias("s"))
