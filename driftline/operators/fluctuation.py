"""Fluctuations over frames, and deviations from a reference."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.model import Selection, Trajectory
from driftline.operators.common import pairs


def rmsf(traj: Trajectory, selection: Selection = None) -> DataFrame:
    return traj.points(selection).groupBy("atom").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"))


def bfactors(traj: Trajectory, selection: Selection = None) -> DataFrame:
    return rmsf(traj, selection).select("atom", (8 * math.pi**2 / 3 * F.col("rmsf") ** 2).alias("bfactor"))


def atomic_adp(traj: Trajectory, selection: Selection = None) -> DataFrame:
    held = [F.greatest(F.var_pop(c), F.lit(0.0)).alias(f"u{c}{c}") for c in "xyz"]
    return traj.points(selection).groupBy("atom").agg(*held, *[F.covar_pop(a, b).alias(f"u{a}{b}") for a, b in ("xy", "xz", "yz")])


def mean_structure(traj: Trajectory, selection: Selection = None) -> DataFrame:
    return traj.points(selection).groupBy("atom").agg(*[F.avg(c).alias(c) for c in "xyz"])


def _against(traj: Trajectory, selection: Selection, reference: int | None, *attributes: str) -> DataFrame:
    ref = traj.at(reference).select("atom", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    square = sum((F.col(c) - F.col(f"r{c}")) * (F.col(c) - F.col(f"r{c}")) for c in "xyz")
    return traj.points(selection, *attributes).join(ref, "atom").withColumn("square", square)


def rmsd(traj: Trajectory, selection: Selection = None, reference: int | None = None) -> DataFrame:
    """Without fit; see linear.rmsd_aligned."""
    return _against(traj, selection, reference).groupBy("frame").agg(F.sqrt(F.avg("square")).alias("rmsd"))


def rmsd_perres(traj: Trajectory, selection: Selection = None, reference: int | None = None, align: bool = False) -> DataFrame:
    """With ``align``, frames are first fitted to the reference by the selection."""
    if align:
        from driftline.operators.linear import superpose

        fixed = traj.at(reference)
        traj = replace(traj, frames=superpose(traj, selection, reference), reference=fixed)
        reference = None
    return _against(traj, selection, reference, "resid").groupBy("frame", "resid").agg(F.sqrt(F.avg("square")).alias("rmsd"))


def distance_rmsd(traj: Trajectory, selection: Selection = None, reference: int | None = None, pbc: bool = False) -> DataFrame:
    fixed = traj.with_frames(traj.at(reference).withColumn("frame", F.lit(0).cast("long")))
    known = pairs(fixed, selection, selection, pbc=pbc, unique=True).select("a", "b", F.col("dist").alias("was"))
    d = F.col("dist") - F.col("was")
    return pairs(traj, selection, selection, pbc=pbc, unique=True).join(known, ["a", "b"]).groupBy("frame").agg(F.sqrt(F.avg(d * d)).alias("rmsd"))


def pairwise_rmsd(traj: Trajectory, selection: Selection = None, metric: str = "nofit") -> DataFrame:
    """f1, f2, rmsd of all pairs of frames, by a join on the atom with sums combined before the shuffle.

    ``nofit`` compares coordinates, ``rms`` after the best fit, and ``dme`` the
    distances between atoms (for each pair of frames all pairs of atoms).
    """
    p = traj.points(selection)
    if metric == "dme":
        d = pairs(traj, selection, selection, unique=True)
        a, b = (d.select("a", "b", F.col("frame").alias(f"f{i}"), F.col("dist").alias(f"d{i}")) for i in (1, 2))
        apart = F.col("d1") - F.col("d2")
        return a.join(b, ["a", "b"]).where("f1 < f2").groupBy("f1", "f2").agg(F.sqrt(F.avg(apart * apart)).alias("rmsd"))
    if metric not in ("nofit", "rms"):
        raise ValueError(f"no metric {metric}")
    if metric == "rms":
        mean = p.groupBy("frame").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
        p = p.join(mean, "frame").select("frame", "atom", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"])
    a, b = (p.select("atom", F.col("frame").alias(f"f{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]) for i in (1, 2))
    both = a.join(b, "atom").where("f1 < f2").groupBy("f1", "f2")
    if metric == "nofit":
        square = sum((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz")
        return both.agg(F.sqrt(F.avg(square)).alias("rmsd"))
    h = F.array(*[F.avg(F.col(f"{c}1") * F.col(f"{d}2")) for c in "xyz" for d in "xyz"])
    sums = both.agg(h.alias("h"), F.avg(sum(F.col(f"{c}{i}") * F.col(f"{c}{i}") for c in "xyz" for i in (1, 2))).alias("e"))

    def fit(parts):
        import numpy as np
        import pandas as pd

        from driftline.operators.linear import kabsch

        for d in parts:
            if len(d):
                m = np.stack(d["h"].to_numpy()).reshape(-1, 3, 3)
                left = d["e"].to_numpy() - 2.0 * np.einsum("nij,nji->n", kabsch(m), m)
                yield pd.DataFrame({"f1": d["f1"], "f2": d["f2"], "rmsd": np.sqrt(np.maximum(left, 0.0))})

    return sums.mapInPandas(fit, "f1 long, f2 long, rmsd double")


def symmrmsd(traj: Trajectory, groups: list[list[int]], selection: Selection = None, reference: int | None = None, max_permutations: int = 720) -> DataFrame:
    """The least deviation, without fit, over permutations inside each group of equivalent atoms."""
    from itertools import permutations, product

    images = [dict(pair for g, p in zip(groups, choice, strict=True) for pair in zip(g, p, strict=True)) for choice in product(*[list(permutations(g)) for g in groups])]
    if len(images) > max_permutations:
        raise ValueError(f"{len(images)} permutations, more than {max_permutations}")
    spark = traj.frames.sparkSession
    moved = spark.createDataFrame([(k, a, b) for k, image in enumerate(images) for a, b in image.items()], "image int, atom long, source long")
    p = _against(traj, selection, reference)
    still = p.join(moved.select("atom").distinct(), "atom", "left_anti").groupBy("frame").agg(F.sum("square").alias("still"), F.count("*").alias("n_still"))
    ref = traj.at(reference).select("atom", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    square = sum((F.col(c) - F.col(f"r{c}")) * (F.col(c) - F.col(f"r{c}")) for c in "xyz")
    swapped = traj.points(selection).withColumnRenamed("atom", "source").join(moved, "source").join(ref, "atom")
    least = swapped.groupBy("frame", "image").agg(F.sum(square).alias("moved"), F.count("*").alias("n_moved")).groupBy("frame").agg(F.min("moved").alias("moved"), F.first("n_moved").alias("n_moved"))
    return least.join(still, "frame", "left").select("frame", F.sqrt((F.col("moved") + F.coalesce("still", F.lit(0.0))) / (F.col("n_moved") + F.coalesce("n_still", F.lit(0)))).alias("rmsd"))


def features(traj: Trajectory, selection: Selection = None, mass_weighted: bool = False) -> DataFrame:
    """Long form: frame, feature (3 atom + axis), value."""
    scale = F.sqrt("mass") if mass_weighted else F.lit(1.0)
    return traj.points(selection, "mass").select("frame", F.posexplode(F.array(*[F.col(c) * scale for c in "xyz"])).alias("axis", "value"), "atom").select("frame", (F.col("atom") * 3 + F.col("axis")).alias("feature"), "value")


def matrix_covariance(traj: Trajectory, selection: Selection = None, mass_weighted: bool = False) -> DataFrame:
    f = features(traj, selection, mass_weighted)
    i, j = (f.select("frame", F.col("feature").alias(k), F.col("value").alias(f"v{k}")) for k in "ij")
    return i.join(j, "frame").groupBy("i", "j").agg(F.covar_pop("vi", "vj").alias("cov"))


def matrix_correlation(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """Sum of the covariances of the axes over the root of both variances."""
    p = traj.points(selection)
    a, b = (p.select("frame", F.col("atom").alias(s), *[F.col(c).alias(f"{s}{c}") for c in "xyz"]) for s in "ab")
    total = lambda s, t: sum(F.covar_pop(f"{s}{c}", f"{t}{c}") for c in "xyz")
    return a.join(b, "frame").groupBy("a", "b").agg((total("a", "b") / F.sqrt(total("a", "a") * total("b", "b"))).alias("corr"))
