"""The longest alpha helix of a backbone, and its measures by frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import dihedral, norm, sub, vec
from driftline.model import Selection, Trajectory
from driftline.operators.linear import backbone, kabsch

#: Phi and psi of a helix, the squared distance from them that counts as helical, and the longest O(i)-N(i+4) of a seed.
PHI, PSI, NEAR, SEED = -55.0, -45.0, 2500.0, 3.6
#: Radius, rise and twist of the ideal helix of CA atoms.
RADIUS, RISE, TWIST = 2.3, 1.5, 100.0
#: Phi, psi and weight in the ellipticity, the first one less than eight degrees away counts.
WEIGHTS = (
    (-67.0, -44.0, 0.31), (-66.0, -41.0, 0.31), (-59.0, -44.0, 0.44), (-57.0, -47.0, 0.56), (-53.0, -52.0, 0.78), (-48.0, -57.0, 1.00),
    (-70.5, -35.8, 0.15), (-57.0, -79.0, 0.23), (-38.0, -78.0, 1.20), (-60.0, -30.0, 0.24), (-54.0, -28.0, 0.46), (-44.0, -33.0, 0.68),
)
#: Charges of the backbone's dipole.
CHARGES = {"c": 0.42, "o": -0.42, "n": -0.20, "h": 0.20}

MEASURES = ("radius", "twist", "rise", "length", "rmsd", "ca_phi")


def turns(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """The backbone's residues with phi, psi, and d3, d4, d5, the distances of O to N so many residues on; null across segments."""
    w = Window.partitionBy("frame", "segment").orderBy("pos")
    res = backbone(traj, selection)
    res = res.select("*", *[F.lead(f"n_{c}", k).over(w).alias(f"n{k}_{c}") for k in (1, 3, 4, 5) for c in "xyz"])
    phi = dihedral([vec("p_"), vec("n_"), vec("ca_"), vec("c_")])
    psi = dihedral([vec("n_"), vec("ca_"), vec("c_"), vec("n1_")])
    gone = [f"n{k}_{c}" for k in (1, 3, 4, 5) for c in "xyz"]
    return res.select("*", phi.alias("phi"), psi.alias("psi"), *[norm(sub(vec(f"n{k}_"), vec("o_"))).alias(f"d{k}") for k in (3, 4, 5)]).drop(*gone)


def fragments(residues: DataFrame, frames: DataFrame, every_frame: bool, between: tuple[int, int] | None) -> DataFrame:
    """frame, start, end (places) of the longest helix, the first of equals.

    A helix begins at a residue with helical angles whose O is near the N four
    residues on, and goes on as long as angles are helical. Unless
    ``every_frame``, the first one found holds for all later frames.
    ``between`` are two residue numbers instead, of one segment.
    """
    if between is not None:
        first, last = (F.min(F.when(F.col("resid") == r, F.col("pos"))).alias(n) for r, n in zip(between, ("start", "end"), strict=True))
        return residues.groupBy("frame", "segment").agg(first, last).where("start <= end").groupBy("frame").agg(F.min("start").alias("start"), F.min_by("end", "start").alias("end"))
    w = Window.partitionBy("frame", "segment").orderBy("pos")
    helical = F.coalesce((F.col("phi") - PHI) ** 2 + (F.col("psi") - PSI) ** 2 < NEAR, F.lit(False))
    runs = residues.withColumn("helical", helical).withColumn("run", F.sum(F.when(F.col("helical"), 0).otherwise(1)).over(w)).where("helical")
    runs = runs.groupBy("frame", "segment", "run").agg(F.min(F.when(F.col("d4") < SEED, F.col("pos"))).alias("start"), F.max("pos").alias("end")).where("start is not null")
    best = runs.groupBy("frame").agg(F.max(F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("back"))).alias("b"))
    best = best.select("frame", (-F.col("b.back")).alias("start"), (F.col("b.size") - F.col("b.back")).alias("end"))
    if every_frame:
        return best
    held = best.agg(F.min_by(F.struct("frame", "start", "end"), "frame").alias("h")).select(F.col("h.frame").alias("since"), "h.start", "h.end")
    return frames.select("frame").join(F.broadcast(held), F.col("frame") >= F.col("since")).select("frame", "start", "end")  # one row


def weight(phi: Column, psi: Column) -> Column:
    """Null where no weight's angles are near."""
    return F.coalesce(*[F.when((phi - a) ** 2 + (psi - b) ** 2 < 64.0, F.lit(w)) for a, b, w in WEIGHTS])


def measures(x: np.ndarray, fit: bool) -> tuple[list[float], list[float]]:
    """MEASURES of CA places in order, and each one's distance from the fitted ideal helix; with ``fit`` along its axis, else along the line between the ends."""
    n = len(x)
    turn = np.radians(TWIST) * np.arange(n)
    ideal = np.column_stack([RADIUS * np.cos(turn), RADIUS * np.sin(turn), RISE * np.arange(n)])
    rotation = kabsch((x - x.mean(0)).T[None] @ (ideal - ideal.mean(0))[None])[0]
    fitted = (x - x.mean(0)) @ rotation.T + ideal.mean(0)
    off = np.linalg.norm(fitted - ideal, axis=1)
    if fit:
        p = fitted
    else:
        y = x - x.mean(0)
        axis = (x[-1] - x[0]) / max(np.linalg.norm(x[-1] - x[0]), 1e-300)
        side = y[0] - (y[0] @ axis) * axis
        if np.linalg.norm(side) < 1e-12:
            side = np.cross(axis, np.eye(3)[np.argmin(np.abs(axis))])
        side /= max(np.linalg.norm(side), 1e-300)
        p = y @ np.column_stack([side, np.cross(axis, side), axis])
    angle = np.degrees(np.arctan2(p[:, 1], p[:, 0]))
    step = (np.diff(angle) + 90.0) % 360.0 - 90.0
    b = np.diff(x, axis=0)
    c = np.cross(b[:-1], b[1:])
    dihedrals = np.degrees(np.arctan2(np.linalg.norm(b[1:-1], axis=1) * (b[:-2] * c[1:]).sum(1), (c[:-1] * c[1:]).sum(1)))
    out = [np.hypot(p[:, 0], p[:, 1]).mean(), step.mean(), (p[-1, 2] - p[0, 2]) / (n - 1), np.linalg.norm(x[-1] - x[0]), np.sqrt((off**2).mean()), dihedrals.mean() if len(dihedrals) else None]
    return [None if v is None else float(v) for v in out], off.tolist()


def _chosen(traj: Trajectory, selection: Selection, every_frame: bool, between: tuple[int, int] | None) -> tuple[DataFrame, DataFrame]:
    residues = turns(traj, selection)
    inside = residues.join(fragments(residues, traj.boxes, every_frame, between), "frame").where("pos between start and end")
    return residues, inside


def helix(traj: Trajectory, selection: Selection = None, fit: bool = True, every_frame: bool = False, between: tuple[int, int] | None = None) -> DataFrame:
    """frame, first, last (residues; -1 without a helix), radius, twist, rise, length, dipole, rmsd, ca_phi, phi, psi, hb3, hb4, hb5, ellipticity, residue_rmsd (a list from first to last).

    Measures are null without a helix or with fewer than two CA atoms. The
    function sees one row for each frame.
    """
    _, inside = _chosen(traj, selection, every_frame, between)
    total = lambda c: sum(F.coalesce(F.sum(F.col(f"{k}_{c}") * q), F.lit(0.0)) for k, q in CHARGES.items())
    rows = inside.groupBy("frame").agg(
        F.min_by("resid", "pos").alias("first"), F.max_by("resid", "pos").alias("last"),
        F.sqrt(sum(total(c) * total(c) for c in "xyz")).alias("dipole"), F.avg("phi").alias("phi"), F.avg("psi").alias("psi"),
        *[F.avg(f"d{k}").alias(f"hb{k}") for k in (3, 4, 5)], F.coalesce(F.sum(weight(F.col("phi"), F.col("psi"))), F.lit(0.0)).alias("ellipticity"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("ca_x").isNotNull(), F.struct("pos", "ca_x", "ca_y", "ca_z")))), lambda s: F.array(s["ca_x"], s["ca_y"], s["ca_z"])).alias("ca"),
    )

    def one(parts):
        for d in parts:
            found = [measures(np.array([list(p) for p in ca], float), fit) if len(ca) > 1 else ([None] * len(MEASURES), None) for ca in d["ca"]]
            out = pd.DataFrame([m for m, _ in found], columns=MEASURES, dtype=object)
            yield out.assign(frame=d["frame"].to_numpy(), residue_rmsd=pd.Series([r for _, r in found], dtype=object))[["frame", *MEASURES, "residue_rmsd"]]

    shape = rows.select("frame", "ca").mapInPandas(one, "frame long, " + ", ".join(f"{m} double" for m in MEASURES) + ", residue_rmsd array<double>")
    out = traj.boxes.select("frame").join(rows.join(shape, "frame"), "frame", "left")
    kept = lambda c: F.when(F.size("ca") > 1, F.col(c)).alias(c)
    return out.select(
        "frame", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("first", "last")],
        *[kept(c) for c in ("radius", "twist", "rise", "length", "dipole", "rmsd", "ca_phi", "phi", "psi", "hb3", "hb4", "hb5", "ellipticity")], "residue_rmsd",
    )


def helix_residues(traj: Trajectory, selection: Selection = None, every_frame: bool = False, between: tuple[int, int] | None = None) -> DataFrame:
    """chain, resid, helicity (share of frames inside the helix), jcaha (the mean CA-HA shift from phi and psi; null without both)."""
    residues, inside = _chosen(traj, selection, every_frame, between)
    a, b = F.radians(F.col("psi") + 138.0), F.radians(F.col("phi") + 30.0)
    shift = 1.4 * F.sin(a) - 4.1 * F.cos(2.0 * a) + 2.0 * F.cos(2.0 * b)
    n = inside.groupBy("chain", "resid").agg(F.count("*").alias("n"))
    out = residues.groupBy("chain", "resid").agg((140.3 + F.avg(shift)).alias("jcaha")).join(n, ["chain", "resid"], "left")
    frames = traj.boxes.agg(F.count("*").alias("frames"))
    return out.crossJoin(F.broadcast(frames)).select("chain", "resid", (F.coalesce("n", F.lit(0)) / F.col("frames")).alias("helicity"), "jcaha")  # one row
