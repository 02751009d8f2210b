"""Coordinate transforms, periodic images and running series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import cell_coordinates, cell_volume, from_cell, min_image, nearest_integer, sub, vec, wrap
from driftline.functions.selection import select
from driftline.model import Selection, Trajectory, box_columns, box_of, cell_column, skewed
from driftline.operators.common import centers


def strip(traj: Trajectory, selection: Selection, invert: bool = False) -> DataFrame:
    """Keeps the selected atoms, or with ``invert`` all others."""
    return traj.frames.join(traj.atoms.where(select(selection)).select("atom"), "atom", "left_anti" if invert else "left_semi")


def common_atoms(traj: Trajectory, sel_a: Selection, sel_b: Selection) -> DataFrame:
    """The atoms that are in both selections."""
    a, b = (traj.atoms.where(select(s)).select("atom") for s in (sel_a, sel_b))
    return a.intersect(b)


def per_frame(traj: Trajectory, f, schema: str, selection: Selection = None, *attributes: str) -> DataFrame:
    """A function of one frame's points (a pandas frame, by atom) as an analysis: it returns a pandas frame of ``schema``."""

    def call(part: pd.DataFrame) -> pd.DataFrame:
        return f(part.sort_values("atom").reset_index(drop=True))

    return traj.points(selection, *attributes).groupBy("frame").applyInPandas(call, schema)


def translate(traj: Trajectory, delta: tuple[float, float, float]) -> DataFrame:
    return traj.frames.select("frame", "atom", *[(F.col(c) + float(d)).alias(c) for c, d in zip("xyz", delta, strict=True)])


def scale(traj: Trajectory, factor: float) -> DataFrame:
    return traj.frames.select("frame", "atom", *[(F.col(c) * float(factor)).alias(c) for c in "xyz"])


def transform(traj: Trajectory, rotation: list[float], translation: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    r = [rotation[0:3], rotation[3:6], rotation[6:9]]
    new = [sum(F.col(c) * float(m) for c, m in zip("xyz", row, strict=True)) + float(t) for row, t in zip(r, translation, strict=True)]
    return traj.frames.select("frame", "atom", *[v.alias(c) for v, c in zip(new, "xyz", strict=True)])


def rotate(traj: Trajectory, rotation: list[float]) -> DataFrame:
    return transform(traj, rotation)


def center(traj: Trajectory, selection: Selection = None, mode: str = "origin", point: tuple[float, float, float] = (0.0, 0.0, 0.0), mass_weighted: bool = False) -> DataFrame:
    """Brings the selection's center to the origin, a point or the middle of the box."""
    rows = traj.frames.join(centers(traj, {"c": selection}, mass_weighted), "frame")
    if mode == "box":
        rows = rows.join(traj.boxes.select("frame", "lx", "ly", "lz"), "frame")
        goal = [b / 2.0 for b in box_columns()]
    else:
        goal = [F.lit(0.0 if mode == "origin" else float(p)) for p in point]
    return rows.select("frame", "atom", *[(F.col(c) + g - F.col(f"c{c}")).alias(c) for c, g in zip("xyz", goal, strict=True)])


def image(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """Wraps the selected atoms into the box or skewed cell; a frame without a box is an error."""
    rows = traj.frames.join(traj.atoms.select("atom", select(selection).alias("chosen")), "atom")
    boxes, box = box_of(traj)
    rows = rows.join(boxes, "frame")
    if skewed(traj):
        missing, inside = box.isNull(), from_cell([x - F.floor(x) for x in cell_coordinates(vec(), box)], box)
    else:
        missing, inside = F.col("lx").isNull(), tuple(wrap(x, b) for x, b in zip(vec(), box, strict=True))
    error = F.raise_error(F.lit("image: no box")).cast("double")
    return rows.select("frame", "atom", *[F.when(F.col("chosen"), F.when(missing, error).otherwise(new)).otherwise(F.col(c)).alias(c) for c, new in zip("xyz", inside, strict=True)])


def replicate_cell(traj: Trajectory, repeats: tuple[int, int, int], selection: Selection = None) -> DataFrame:
    rows = traj.points(selection, box=True)
    for c, n in zip("xyz", repeats, strict=True):
        rows = rows.withColumn(f"i{c}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return rows.select("frame", "atom", "ix", "iy", "iz", *[(F.col(c) + F.col(f"i{c}") * b).alias(c) for c, b in zip("xyz", box_columns(), strict=True)])


def xtalsymm(traj: Trajectory, operations: list[list[float]], selection: Selection = None) -> DataFrame:
    """Each operation is a row-major 3 x 4 matrix."""
    ops = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in op[4 * i : 4 * i + 4]]) for i in range(3)]) for op in operations])
    rows = traj.points(selection).select("*", F.posexplode(ops).alias("op", "m"))
    new = [sum(F.col(c) * F.col("m")[i][k] for k, c in enumerate("xyz")) + F.col("m")[i][3] for i in range(3)]
    return rows.select("frame", "atom", F.col("op").cast("long").alias("op"), *[v.alias(c) for v, c in zip(new, "xyz", strict=True)])


def volume(traj: Trajectory) -> DataFrame:
    if skewed(traj):
        return traj.boxes.select("frame", F.abs(cell_volume(cell_column())).alias("volume"))
    return traj.boxes.select("frame", (F.col("lx") * F.col("ly") * F.col("lz")).alias("volume"))


def count_frames(traj: Trajectory) -> DataFrame:
    """n_frames, n_atoms: one row."""
    return traj.frames.agg(F.count_distinct("frame").alias("n_frames"), F.count_distinct("atom").alias("n_atoms"))


def decimate_frames(traj: Trajectory, start: int = 0, every: int = 1) -> DataFrame:
    """The first ``start`` frames, and after those the ones whose place, from 1, is a multiple of ``every``."""
    if every <= 0:
        raise ValueError("every must be positive")
    order = traj.boxes.select("frame", F.row_number().over(Window.orderBy("frame")).alias("place"))  # a row for each frame
    return traj.frames.join(order.where((F.col("place") <= start) | (F.col("place") % every == 0)).select("frame"), "frame", "left_semi")


def decimate_time(traj: Trajectory, step_ps: float, window: float = 1e-6) -> DataFrame:
    """Frames whose time since the first is a multiple of ``step_ps``, within ``window``."""
    if step_ps <= 0:
        raise ValueError("step_ps must be positive")
    first = traj.boxes.agg(F.min("time_ps").alias("begin"))
    since = (F.col("time_ps") - F.col("begin")) / float(step_ps)
    near = traj.boxes.join(F.broadcast(first)).where(F.abs(since - nearest_integer(since)) * float(step_ps) <= window)  # one row
    return traj.frames.join(near.select("frame"), "frame", "left_semi")


def map_beads(traj: Trajectory, beads: DataFrame, mass_weighted: bool = True) -> DataFrame:
    """frame, bead, x, y, z, n: the centers of the atoms of each bead (atom, bead)."""
    w = F.col("mass") if mass_weighted else F.lit(1.0)
    rows = traj.points(None, "mass").join(beads.select("atom", "bead"), "atom")
    return rows.groupBy("frame", "bead").agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in "xyz"], F.count("*").alias("n"))


def get_velocity(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """Finite differences; zero in the first frame."""
    rows = traj.points(selection).join(traj.boxes.select("frame", "time_ps"), "frame")
    w = Window.partitionBy("atom").orderBy("frame")
    rows = rows.withColumn("dt", F.col("time_ps") - F.lag("time_ps").over(w))
    return rows.select("frame", "atom", *[F.coalesce((F.col(c) - F.lag(c).over(w)) / F.col("dt"), F.lit(0.0)).alias(f"v{c}") for c in "xyz"])


def runningavg(traj: Trajectory, selection: Selection = None, window: int = 0) -> DataFrame:
    w = Window.partitionBy("atom").orderBy("frame").rowsBetween(-(window - 1) if window else Window.unboundedPreceding, 0)
    return traj.points(selection).select("frame", "atom", *[F.avg(c).over(w).alias(c) for c in "xyz"])


def unwrap(traj: Trajectory, points: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of minimum-image steps along the frames, from the first place on."""
    w = Window.partitionBy(*keys).orderBy("frame")
    boxes, box = box_of(traj)
    rows = points.join(boxes, "frame")
    rows = rows.select("*", *[F.lag(c).over(w).alias(f"before_{c}") for c in "xyz"])
    steps = min_image(sub(vec(), vec("before_")), box)
    rows = rows.select("frame", *keys, *[F.coalesce(s, F.col(c)).alias(c) for s, c in zip(steps, "xyz", strict=True)])
    return rows.select("frame", *keys, *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in "xyz"])


def select_frames(traj: Trajectory, begin: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    if step <= 0:
        raise ValueError("step must be positive")
    f = F.col("frame")
    return traj.frames.where((f >= begin) & ((f - begin) % step == 0) & (F.lit(True) if end is None else f < end))


def pick_frames(traj: Trajectory, indices: list[int]) -> DataFrame:
    """Frames by index in the order given, repeats kept; negative ones count from the end, others out of range go."""
    n = traj.frames.agg(F.max("frame").alias("n")).select((F.col("n") + 1).alias("n"))
    wanted = traj.frames.sparkSession.createDataFrame([(k, i) for k, i in enumerate(indices)], "position long, index long").join(F.broadcast(n))  # one row
    wanted = wanted.select("position", F.when(F.col("index") < 0, F.col("index") + F.col("n")).otherwise(F.col("index")).alias("frame"))
    return traj.frames.join(wanted, "frame").select("position", "frame", "atom", "x", "y", "z")


def set_velocity(traj: Trajectory, selection: Selection = None, temperature: float = 300.0, seed: int = 0) -> DataFrame:
    """Maxwellian velocities, normal with variance T / m in each component; the same seed, frame and atom give the same draw wherever they are computed."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.col("frame"), F.col("atom"), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    draw = lambda k: F.sqrt(-2.0 * F.log(u(2 * k))) * F.cos(2.0 * math.pi * u(2 * k + 1))
    rows = traj.points(selection, "mass")
    width = F.when(F.col("mass") > 0, F.sqrt(F.lit(float(temperature)) / F.col("mass"))).otherwise(F.lit(0.0))
    return rows.select("frame", "atom", *[(draw(k) * width).alias(f"v{c}") for k, c in enumerate("xyz")])


def randomize_ions(traj: Trajectory, ions: Selection, solvent: Selection, around: Selection = None, by: float = 0.0, overlap: float = 0.0, seed: int = 0, max_attempts: int = 1000) -> DataFrame:
    """frame, atom, x, y, z with each ion's residue swapped with a random residue of solvent.

    Solvent counts where it is ``by`` or more from ``around``; ions stay
    ``overlap`` or more apart. Draws depend on the seed and the frame. A frame
    is one group of the function, since each swap depends on those before it.
    """
    kind = F.when(select(ions), "ion").when(select(solvent), "solvent").otherwise("rest")
    near = F.lit(False) if around is None else select(around)
    rows = traj.frames.join(traj.atoms.select("atom", "resid", kind.alias("kind"), near.alias("around")), "atom").join(traj.boxes.select("frame", "lx", "ly", "lz"), "frame")

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("atom").reset_index(drop=True)
        at, rng = part[["x", "y", "z"]].to_numpy(copy=True), np.random.default_rng([seed, int(key[0]) & 0x7FFFFFFF])
        box = part[["lx", "ly", "lz"]].iloc[0].fillna(0.0).to_numpy(dtype=float)
        period = np.where(box > 0, box, np.inf)

        def apart(p: np.ndarray, q: np.ndarray) -> float:
            d = p - q
            d = d - np.where(np.isfinite(period), np.round(d / period) * np.where(np.isfinite(period), period, 0.0), 0.0)
            return float(np.sqrt((d * d).sum(axis=-1)).min()) if len(d) else np.inf

        rows_of = {k: [g.to_numpy() for _, g in part[part["kind"] == k].groupby("resid").groups.items()] for k in ("ion", "solvent")}
        solute = at[part["around"].to_numpy()]
        free = [r for r in rows_of["solvent"] if not len(solute) or min(apart(at[i], solute) for i in r) >= by]
        placed: list[np.ndarray] = []
        for ion in rows_of["ion"]:
            here = at[ion].mean(axis=0)
            for _ in range(max_attempts):
                if not free:
                    raise ValueError("no residue of solvent is left for an ion")
                pick = int(rng.integers(len(free)))
                there = at[free[pick]].mean(axis=0)
                if not placed or apart(there, np.array(placed)) >= overlap:
                    break
            else:
                raise ValueError("no place for an ion was found")
            at[ion] += there - here
            at[free[pick]] += here - there
            placed.append(there)
            free.pop(pick)
        return pd.DataFrame({"frame": part["frame"], "atom": part["atom"], "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]})

    return rows.groupBy("frame").applyInPandas(one, "frame long, atom long, x double, y double, z double")
