"""Lipid membranes: residues are lipids, z is the normal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import clamp, dot, nearest_integer, norm, periodic_bin, sub, vec
from driftline.functions.selection import select
from driftline.model import Selection, Trajectory
from driftline.operators.common import pairs


def _cells(rows: DataFrame, bins: int) -> DataFrame:
    return rows.withColumns({f"i{c}": periodic_bin(F.col(c), F.col(f"l{c}"), bins) for c in "xy"})


def _heights(traj: Trajectory, membrane: Selection, selection: Selection, bins: int) -> DataFrame:
    """frame, resid, z, mid: a residue's mean z and that of the membrane's atoms in its cell, or in the whole frame where the cell is empty."""
    atoms = _cells(traj.points(membrane, box=True), bins)
    local = atoms.groupBy("frame", "ix", "iy").agg(F.avg("z").alias("local"))
    whole = atoms.groupBy("frame").agg(F.avg("z").alias("whole"))
    res = traj.points(selection, "resid", box=True).groupBy("frame", "resid").agg(*[F.avg(c).alias(c) for c in "xyz"], F.first("lx").alias("lx"), F.first("ly").alias("ly"))
    res = _cells(res, bins).join(local, ["frame", "ix", "iy"], "left").join(whole, "frame")
    return res.select("frame", "resid", "z", F.coalesce("local", "whole").alias("mid"))


def leaflets(traj: Trajectory, selection: Selection = None, bins: int = 1) -> DataFrame:
    h = _heights(traj, selection, selection, bins)
    return h.select("frame", "resid", F.when(F.col("z") > F.col("mid"), 1).otherwise(-1).alias("leaflet"))


def z_positions(traj: Trajectory, membrane: Selection, selection: Selection, bins: int = 1) -> DataFrame:
    return _heights(traj, membrane, selection, bins).select("frame", "resid", (F.col("z") - F.col("mid")).alias("height"))


def z_thickness(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """Largest minus smallest z of a residue, across the boundary where that is shorter."""
    d = F.max("z") - F.min("z")
    half = F.first("lz") / 2.0
    return traj.points(selection, "resid", box=True).groupBy("frame", "resid").agg(F.when(d > half, F.first("lz") - d).otherwise(d).alias("thickness"))


def z_angles(traj: Trajectory, atom_a: Selection, atom_b: Selection) -> DataFrame:
    """Degrees between the vector from b to a and +z; images in x and y only."""
    a, b = (traj.points(s, "resid").select("frame", "resid", *[F.col(c).alias(f"{k}{c}") for c in "xyz"]) for k, s in (("a", atom_a), ("b", atom_b)))
    rows = a.join(b, ["frame", "resid"]).join(traj.boxes.select("frame", "lx", "ly"), "frame")
    d = [F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]
    d = [d[0] - nearest_integer(d[0] / F.col("lx")) * F.col("lx"), d[1] - nearest_integer(d[1] / F.col("ly")) * F.col("ly"), d[2]]
    return rows.select("frame", "resid", F.degrees(F.acos(clamp(d[2] / norm(tuple(d))))).alias("angle"))


def scc(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """Mean of P2 of the angle between consecutive tail vectors and z."""
    w = Window.partitionBy("frame", "resid").orderBy("atom")
    rows = traj.points(selection, "resid").select("frame", "resid", *[(F.lead(c).over(w) - F.col(c)).alias(f"d{c}") for c in "xyz"]).where("dx is not null")
    c = F.col("dz") / norm(vec("d"))
    return rows.where(norm(vec("d")) > 0).groupBy("frame", "resid").agg(F.avg(1.5 * c * c - 0.5).alias("scc"))


def contacts(traj: Trajectory, selection: Selection, cutoff: float) -> DataFrame:
    """frame, a_resid, b_resid of residues in contact, both ways round."""
    return pairs(traj, selection, selection, pbc=True, cutoff=cutoff, attributes=("resid",)).where("a_resid != b_resid").select("frame", "a_resid", "b_resid").distinct()


def neighbours(traj: Trajectory, selection: Selection, cutoff: float) -> DataFrame:
    n = contacts(traj, selection, cutoff).groupBy("frame", F.col("a_resid").alias("resid")).agg(F.count("*").alias("n"))
    every = traj.points(selection, "resid").select("frame", "resid").distinct()
    return every.join(n, ["frame", "resid"], "left").fillna(0, ["n"])


def neighbour_matrix(traj: Trajectory, selection: Selection, cutoff: float) -> DataFrame:
    every = traj.points(selection, "resid").select("frame", "resid").distinct()
    both = every.select("frame", F.col("resid").alias("a_resid")).join(every.select("frame", F.col("resid").alias("b_resid")), "frame")
    held = contacts(traj, selection, cutoff).withColumn("contact", F.lit(1).cast("long"))
    return both.join(held, ["frame", "a_resid", "b_resid"], "left").fillna(0, ["contact"])


def largest_cluster(traj: Trajectory, selection: Selection, cutoff: float) -> DataFrame:
    """Residues of the largest group in contact; a frame's contacts are one group of the function."""
    every = traj.points(selection, "resid").select("frame", F.col("resid").alias("a_resid"), F.col("resid").alias("b_resid")).distinct()

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(part["a_resid"], part["b_resid"], strict=True):
            parent[root(a)] = root(b)
        sizes = pd.Series([root(x) for x in list(parent)]).value_counts()
        return pd.DataFrame({"frame": [key[0]], "n": [int(sizes.max())]})

    return every.unionByName(contacts(traj, selection, cutoff)).groupBy("frame").applyInPandas(one, "frame long, n long")


def membrane_thickness(traj: Trajectory, selection: Selection, leaflet: DataFrame, bins: int = 1) -> DataFrame:
    """Mean over cells with both leaflets of the difference of their mean heights."""
    rows = _cells(traj.points(selection, "resid", box=True).join(leaflet, ["frame", "resid"]), bins)
    cell = rows.groupBy("frame", "ix", "iy").agg(*[F.avg(F.when(F.col("leaflet") == s, F.col("z"))).alias(n) for s, n in ((1, "up"), (-1, "down"))])
    return cell.groupBy("frame").agg(F.avg(F.col("up") - F.col("down")).alias("thickness"))


def registration(traj: Trajectory, upper: Selection, lower: Selection, leaflet: DataFrame, bins: int = 4, sd: float = 1.0) -> DataFrame:
    """Pearson correlation of the two leaflets' densities on a grid, smoothed by a periodic Gaussian of ``sd`` cells."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))
    grid = traj.boxes.select("frame", every.alias("ix")).select("*", every.alias("iy"))
    for name, sel, sign in (("up", upper, 1), ("down", lower, -1)):
        rows = _cells(traj.points(sel, "resid", box=True).join(leaflet.where(F.col("leaflet") == sign), ["frame", "resid"]), bins)
        raw = rows.groupBy("frame", F.col("ix").alias("jx"), F.col("iy").alias("jy")).agg(F.count("*").alias("n"))
        d = lambda a, b: F.least(F.abs(F.col(a) - F.col(b)), bins - F.abs(F.col(a) - F.col(b)))
        kernel = F.exp(-(d("ix", "jx") ** 2 + d("iy", "jy") ** 2) / (2.0 * sd * sd))
        smooth = grid.select("frame", "ix", "iy").join(raw, "frame").groupBy("frame", "ix", "iy").agg(F.sum(F.col("n") * kernel).alias(name))
        grid = grid.join(smooth, ["frame", "ix", "iy"], "left")
    return grid.fillna(0.0, ["up", "down"]).groupBy("frame").agg(F.corr("up", "down").alias("registration"))


def crossings(states: list[int], cutoff: int) -> list[tuple[int, int, int, str]]:
    """(start, end, leaflet, outcome) of each crossing in one lipid's leaflets."""
    out: list[tuple[int, int, int, str]] = []
    home, start = (states[0] if states else 0), None
    outside = opposite = inside = 0  # frames in a row
    for i in range(1, len(states)):
        if start is None:
            outside = outside + 1 if states[i] != home else 0
            if outside == cutoff:
                start = i - cutoff
        opposite = opposite + 1 if states[i] == -home else 0
        if start is None:
            continue
        inside = inside + 1 if states[i] == home else 0
        if cutoff in (opposite, inside):
            crossed = opposite == cutoff
            home = -home if crossed else home
            out.append((start, i - cutoff + 1, home, "Success" if crossed else "Fail"))
            start, outside, opposite, inside = None, 0, 0, 0
    if start is not None:
        out.append((start, len(states) - 1, states[-1], "Ongoing"))
    return out


def flip_flop(leaflet: DataFrame, cutoff: int = 1) -> DataFrame:
    """resid, start, end, leaflet, outcome of each crossing.

    A lipid leaves when it has been outside its leaflet for ``cutoff`` frames;
    it succeeds when it stays in the other for as long, fails when it comes
    back for as long, and is ongoing, in its last leaflet, where the series ends.
    """

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame")
        frames = part["frame"].tolist()
        found = [(key[0], frames[a], frames[b], s, outcome) for a, b, s, outcome in crossings(part["leaflet"].tolist(), cutoff)]
        return pd.DataFrame(found, columns=["resid", "start", "end", "leaflet", "outcome"])

    return leaflet.groupBy("resid").applyInPandas(one, "resid long, start long, end long, leaflet long, outcome string")


def nematic(traj: Trajectory, tails: Selection, heads: Selection, by: str = "resid") -> DataFrame:
    """Six elements of Q and its largest eigenvalue, from the vectors of each group's tail to its head."""
    from driftline.functions.geometry import eigenvalues

    a, b = (traj.points(s, by).groupBy("frame", by).agg(*[F.avg(c).alias(f"{k}{c}") for c in "xyz"]) for k, s in (("a", tails), ("b", heads)))
    d = sub(vec("b"), vec("a"))
    rows = a.join(b, ["frame", by]).select("frame", *[x.alias(f"d{c}") for x, c in zip(d, "xyz", strict=True)]).where(dot(vec("d"), vec("d")) > 0)
    u = lambda c: F.col(f"d{c}") / norm(vec("d"))
    terms = [(F.avg(1.5 * u(p[0]) * u(p[1])) - (0.5 if p[0] == p[1] else 0.0)).alias(f"q{p}") for p in ("xx", "yy", "zz", "xy", "xz", "yz")]
    q = rows.groupBy("frame").agg(F.count("*").alias("n"), *terms)
    return q.withColumn("order", eigenvalues(*[F.col(f"q{p}") for p in ("xx", "yy", "zz", "xy", "xz", "yz")])[2])


def curved_leaflets(traj: Trajectory, selection: Selection, cutoff: float) -> DataFrame:
    """frame, resid, leaflet (1, -1) from groups of residues in contact.

    The two largest groups (ties: smaller resid) are the leaflets, the one
    farther from the box's middle 1 (as far: the higher); each other residue
    joins the nearer, as near the positive. With a single group, z against the mean tells.
    A frame is one group of the function.
    """
    res = traj.points(selection, "resid", box=True).groupBy("frame", "resid").agg(*[F.avg(c).alias(c) for c in "xyz"], *[F.first(c).alias(c) for c in ("lx", "ly", "lz")], F.collect_list(F.array("x", "y", "z")).alias("atoms"))
    links = contacts(traj, selection, cutoff).groupBy("frame", F.col("a_resid").alias("resid")).agg(F.collect_list("b_resid").alias("near"))

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("resid").reset_index(drop=True)
        place = {r: i for i, r in enumerate(part["resid"])}
        group = np.full(len(part), -1)
        for i in range(len(part)):
            if group[i] >= 0:
                continue
            group[i], todo = i, [i]
            while todo:
                near = part["near"].iloc[todo.pop()]
                for r in near if near is not None else ():
                    j = place[r]
                    if group[j] < 0:
                        group[j] = i
                        todo.append(j)
        xyz, box = part[["x", "y", "z"]].to_numpy(), part[["lx", "ly", "lz"]].iloc[0].to_numpy(dtype=float)
        names, sizes = np.unique(group, return_counts=True)
        if len(names) < 2:
            return pd.DataFrame({"frame": key[0], "resid": part["resid"], "leaflet": np.where(xyz[:, 2] >= xyz[:, 2].mean(), 1, -1)})
        first, second = names[np.argsort(-sizes, kind="stable")][:2]
        image = lambda d: d - np.round(d / box) * box
        out = np.sqrt((image(xyz - box / 2.0) ** 2).sum(axis=1))
        far, high = ([v[group == g].mean() for g in (first, second)] for v in (out, xyz[:, 2]))
        if far[0] < far[1] - 1e-6 or (abs(far[0] - far[1]) <= 1e-6 and high[0] < high[1]):
            first, second = second, first
        atoms = [np.array(list(map(list, a)), dtype=float) for a in part["atoms"]]
        sides = [np.concatenate([a for a, g in zip(atoms, group, strict=True) if g == s]) for s in (first, second)]
        nearest = lambda a, side: min(float((image(p - side) ** 2).sum(axis=1).min()) for p in a)
        signs = [1 if g == first else -1 if g == second else 1 if nearest(a, sides[0]) <= nearest(a, sides[1]) else -1 for a, g in zip(atoms, group, strict=True)]
        return pd.DataFrame({"frame": key[0], "resid": part["resid"], "leaflet": signs})

    return res.join(links, ["frame", "resid"], "left").groupBy("frame").applyInPandas(one, "frame long, resid long, leaflet long")


def area(traj: Trajectory, selection: Selection, leaflet: DataFrame) -> DataFrame:
    """frame, resid, area of each residue's Voronoi cell in the periodic plane of its leaflet; null outside leaflets.

    Cells are cut from the box by the bisectors with the other residues' images,
    nearest first, until the rest are too far to cut. A leaflet of a frame is
    one group of the function.
    """
    res = traj.points(selection, "resid", box=True).groupBy("frame", "resid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.first("lx").alias("lx"), F.first("ly").alias("ly"))
    res = res.join(leaflet.select("frame", "resid", "leaflet"), ["frame", "resid"], "left").fillna(0, ["leaflet"])

    def one(key, part: pd.DataFrame) -> pd.DataFrame:
        if key[1] == 0:
            return pd.DataFrame({"frame": part["frame"], "resid": part["resid"], "area": None})
        seeds, box = part[["x", "y"]].to_numpy(), part[["lx", "ly"]].iloc[0].to_numpy(dtype=float)
        shifts = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]) * box
        areas = []
        for i, p in enumerate(seeds):
            others = np.delete(seeds, i, axis=0) - p
            others = (others - np.round(others / box) * box)[:, None, :] + shifts[None]
            others = others.reshape(-1, 2)
            others = others[np.argsort((others**2).sum(axis=1), kind="stable")]
            cell = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)]) * box / 2.0
            for q in others:
                if len(cell) < 3 or q @ q > 4.0 * (cell**2).sum(axis=1).max():
                    break
                side = cell @ q - q @ q / 2.0
                kept = []
                for k in range(len(cell)):
                    a, b, sa, sb = cell[k], cell[(k + 1) % len(cell)], side[k], side[(k + 1) % len(cell)]
                    if sa <= 0:
                        kept.append(a)
                    if (sa < 0 < sb) or (sb < 0 < sa):
                        kept.append(a + (b - a) * (sa / (sa - sb)))
                cell = np.array(kept).reshape(-1, 2)
            x, y = cell[:, 0], cell[:, 1]
            areas.append(float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2.0) if len(cell) > 2 else 0.0)
        return pd.DataFrame({"frame": part["frame"], "resid": part["resid"], "area": areas})

    return res.groupBy("frame", "leaflet").applyInPandas(one, "frame long, resid long, area double")


def neighbour_composition(traj: Trajectory, selection: Selection, cutoff: float, label: str = "resname") -> DataFrame:
    """frame, resid, label, n: residues in contact by their label."""
    names = traj.atoms.where(select(selection)).groupBy(F.col("resid").alias("b_resid")).agg(F.min(label).alias(label))
    return contacts(traj, selection, cutoff).join(names, "b_resid").groupBy("frame", F.col("a_resid").alias("resid"), label).agg(F.count("*").alias("n"))


def scc_weighted(first: DataFrame, second: DataFrame, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Weighted mean of two tails' order by frame and residue; the one there is where the other is missing."""
    a, b = (d.select("frame", "resid", F.col("scc").alias(f"scc_{k}")) for k, d in (("a", first), ("b", second)))
    w = [F.when(F.col(f"scc_{k}").isNotNull(), F.lit(float(v))).otherwise(F.lit(0.0)) for k, v in zip("ab", weights, strict=True)]
    top = sum(F.coalesce(F.col(f"scc_{k}"), F.lit(0.0)) * v for k, v in zip("ab", w, strict=True))
    return a.join(b, ["frame", "resid"], "full").select("frame", "resid", (top / F.nullif(w[0] + w[1], F.lit(0.0))).alias("scc"))
