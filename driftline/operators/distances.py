"""Distances, neighbours and contacts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import dot, min_image, norm, sub, vec
from driftline.functions.selection import select
from driftline.model import Selection, Trajectory
from driftline.operators.common import centers, pairs, with_box

Point = tuple[float, float, float]


def _to(point: Point) -> tuple:
    return tuple(F.lit(float(c)) for c in point)


def distance_to_point(traj: Trajectory, selection: Selection, point: Point, pbc: bool = False) -> DataFrame:
    rows, box = with_box(traj, traj.points(selection), pbc)
    return rows.select("frame", "atom", norm(min_image(sub(vec(), _to(point)), box)).alias("dist"))


def distance_to_reference(traj: Trajectory, selection: Selection, reference: int | None = None, pbc: bool = False) -> DataFrame:
    ref = traj.at(reference).select("atom", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    rows, box = with_box(traj, traj.points(selection).join(ref, "atom"), pbc)
    return rows.select("frame", "atom", norm(min_image(sub(vec(), vec("r")), box)).alias("dist"))


def distance_vector(traj: Trajectory, sel_a: Selection, sel_b: Selection, mass_weighted: bool = False, pbc: bool = False) -> DataFrame:
    rows, box = with_box(traj, centers(traj, {"a": sel_a, "b": sel_b}, mass_weighted), pbc)
    d = min_image(sub(vec("b"), vec("a")), box)
    return rows.select("frame", *[x.alias(f"d{c}") for x, c in zip(d, "xyz", strict=True)])


def distance(traj: Trajectory, sel_a: Selection, sel_b: Selection, mass_weighted: bool = False, pbc: bool = False) -> DataFrame:
    return distance_vector(traj, sel_a, sel_b, mass_weighted, pbc).select("frame", norm(vec("d")).alias("dist"))


def multi_distance(traj: Trajectory, terms: list[tuple[Selection, Selection]], mass_weighted: bool = False, pbc: bool = False) -> DataFrame:
    """frame, dist_0, dist_1, ...; all centers come from one pass."""
    named = {f"{s}{i}_": sel for i, pair in enumerate(terms) for s, sel in zip("ab", pair, strict=True)}
    rows, box = with_box(traj, centers(traj, named, mass_weighted), pbc)
    return rows.select("frame", *[norm(min_image(sub(vec(f"b{i}_"), vec(f"a{i}_")), box)).alias(f"dist_{i}") for i in range(len(terms))])


def multi_vector(traj: Trajectory, between: list[tuple[Selection, Selection]], center: list[Selection], mass_weighted: bool = False) -> DataFrame:
    named = {f"{s}{i}_": sel for i, pair in enumerate(between) for s, sel in zip("ab", pair, strict=True)} | {f"c{i}_": sel for i, sel in enumerate(center)}
    rows = centers(traj, named, mass_weighted)
    out = [x.alias(f"v{i}_{c}") for i in range(len(between)) for x, c in zip(sub(vec(f"b{i}_"), vec(f"a{i}_")), "xyz", strict=True)]
    return rows.select("frame", *out, *[f"c{i}_{c}" for i in range(len(center)) for c in "xyz"])


def distance_center_to_point(traj: Trajectory, selection: Selection, point: Point, mass_weighted: bool = False, pbc: bool = False) -> DataFrame:
    rows, box = with_box(traj, centers(traj, {"a": selection}, mass_weighted), pbc)
    return rows.select("frame", norm(min_image(sub(vec("a"), _to(point)), box)).alias("dist"))


def distance_center_to_reference(traj: Trajectory, selection: Selection, reference: int | None = None, mass_weighted: bool = False, pbc: bool = False) -> DataFrame:
    fixed = traj.with_frames(traj.at(reference).withColumn("frame", F.lit(0).cast("long")))
    ref = centers(fixed, {"r": selection}, mass_weighted).drop("frame")
    rows, box = with_box(traj, centers(traj, {"a": selection}, mass_weighted).join(F.broadcast(ref)), pbc)  # one row
    return rows.select("frame", norm(min_image(sub(vec("a"), vec("r")), box)).alias("dist"))


def lowestcurve(traj: Trajectory, sel_a: Selection, sel_b: Selection, mass_weighted: bool = False, pbc: bool = False) -> DataFrame:
    return distance(traj, sel_a, sel_b, mass_weighted, pbc).agg(F.min("dist").alias("lowest"))


def pairwise_distance(traj: Trajectory, sel_a: Selection, sel_b: Selection, pbc: bool = False) -> DataFrame:
    return pairs(traj, sel_a, sel_b, pbc=pbc, same=True).select("frame", "a", "b", "dist")


def pair_list_distance(traj: Trajectory, listed: list[tuple[int, int]], pbc: bool = False) -> DataFrame:
    spark = traj.frames.sparkSession
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(listed)], "pair int, a long, b long")
    side = lambda s: traj.frames.select("frame", F.col("atom").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in "xyz"])
    rows, box = with_box(traj, side("a").join(table, "a").join(side("b"), ["frame", "b"]), pbc)
    return rows.select("frame", "pair", norm(min_image(sub(vec("b_"), vec("a_")), box)).alias("dist"))


def drid(traj: Trajectory, selection: Selection = None, exclude_bonds: bool = False) -> DataFrame:
    """Three moments of the reciprocal distances of each atom to the others."""
    found = pairs(traj, selection, selection)
    if exclude_bonds and traj.bonds is not None:
        both = traj.bonds.select("a", "b").unionByName(traj.bonds.select(F.col("b").alias("a"), F.col("a").alias("b")))
        found = found.join(both, ["a", "b"], "left_anti")
    r = F.lit(1.0) / F.col("dist")
    means = found.groupBy("frame", "a").agg(F.avg(r).alias("m1"))
    d = r - F.col("m1")
    out = found.join(means, ["frame", "a"]).groupBy("frame", F.col("a").alias("atom")).agg(F.first("m1").alias("m1"), F.avg(d * d).alias("v"), F.avg(d * d * d).alias("t"))
    return out.select("frame", "atom", "m1", F.sqrt("v").alias("m2"), F.cbrt("t").alias("m3"))


def mindist(traj: Trajectory, sel_a: Selection, sel_b: Selection, pbc: bool = False) -> DataFrame:
    """An atom in both selections gives 0, as does a frame without a pair."""
    found = pairs(traj, sel_a, sel_b, pbc=pbc, same=True).groupBy("frame").agg(F.min("dist").alias("dist"))
    return traj.boxes.select("frame").join(found, "frame", "left").select("frame", F.coalesce("dist", F.lit(0.0)).alias("dist"))


def pairdist_extrema(traj: Trajectory, sel_a: Selection, sel_b: Selection, largest: bool = False, pbc: bool = False, cutoff: float | None = None, empty: float | None = None) -> DataFrame:
    found = pairs(traj, sel_a, sel_b, pbc=pbc, cutoff=cutoff).groupBy("frame").agg((F.max if largest else F.min)("dist").alias("dist"))
    out = traj.boxes.select("frame").join(found, "frame", "left")
    return out.select("frame", F.coalesce("dist", F.lit(float("nan") if empty is None else empty)).alias("dist"))


def hausdorff(traj: Trajectory, sel_a: Selection, sel_b: Selection, pbc: bool = False) -> DataFrame:
    found = pairs(traj, sel_a, sel_b, pbc=pbc, same=True)
    side = lambda c: found.groupBy("frame", c).agg(F.min("dist").alias("near")).groupBy("frame").agg(F.max("near").alias(f"from_{c}"))
    return side("a").join(side("b"), "frame").select("frame", F.greatest("from_a", "from_b").alias("dist"))


def closest_atom(traj: Trajectory, selection: Selection, point: Point, pbc: bool = False) -> DataFrame:
    near = distance_to_point(traj, selection, point, pbc).groupBy("frame").agg(F.min(F.struct("dist", "atom")).alias("best"))
    return traj.boxes.select("frame").join(near, "frame", "left").select("frame", F.coalesce("best.atom", F.lit(-1)).alias("atom"))


def neighbours(traj: Trajectory, target: Selection, probe: Selection, cutoff: float, pbc: bool = False) -> DataFrame:
    """frame, atom of the probes within the cutoff of any target atom."""
    return pairs(traj, target, probe, pbc=pbc, cutoff=cutoff, same=True).select("frame", F.col("b").alias("atom")).distinct()


def search_neighbors(traj: Trajectory, target: Selection, probe: Selection, cutoff: float, pbc: bool = False) -> DataFrame:
    found = neighbours(traj, target, probe, cutoff, pbc).groupBy("frame").agg(F.count("*").alias("n"))
    return traj.boxes.select("frame").join(found, "frame", "left").fillna(0, ["n"])


def search_neighbor_list(traj: Trajectory, target: Selection, probe: Selection, cutoff: float, pbc: bool = False) -> DataFrame:
    found = neighbours(traj, target, probe, cutoff, pbc).groupBy("frame").agg(F.sort_array(F.collect_list("atom")).alias("atoms"), F.count("*").alias("n"))
    return found


def watershell(traj: Trajectory, target: Selection, probe: Selection, lower: float, upper: float, pbc: bool = False) -> DataFrame:
    near = lambda c, name: search_neighbors(traj, target, probe, c, pbc).select("frame", F.col("n").alias(name))
    return near(lower, "n_lower").join(near(upper, "n_upper"), "frame")


def closest(traj: Trajectory, target: Selection, probe: Selection, n: int, pbc: bool = False) -> DataFrame:
    near = pairs(traj, target, probe, pbc=pbc, same=True).groupBy("frame", F.col("b").alias("atom")).agg(F.min("dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("frame").orderBy("dist", "atom"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).select("frame", "rank", "atom", "dist")


def closest_coords(traj: Trajectory, target: Selection, probe: Selection, n: int, pbc: bool = False) -> DataFrame:
    kept = traj.points(target).select("frame", "atom").unionByName(closest(traj, target, probe, n, pbc).select("frame", "atom")).distinct()
    return traj.frames.join(kept, ["frame", "atom"], "left_semi")


def native_contacts(traj: Trajectory, sel_a: Selection, sel_b: Selection, cutoff: float, min_cutoff: float = 0.0, reference: int | None = None, unique: bool = False, pbc: bool = False) -> DataFrame:
    """Fraction of the reference's contacts that hold in each frame."""
    fixed = traj.with_frames(traj.at(reference).withColumn("frame", F.lit(0).cast("long")))
    known = pairs(fixed, sel_a, sel_b, pbc=pbc, cutoff=cutoff, unique=unique).where(F.col("dist") >= min_cutoff).select("a", "b")
    now = pairs(traj, sel_a, sel_b, pbc=pbc, cutoff=cutoff, unique=unique).where(F.col("dist") >= min_cutoff)
    held = now.join(known, ["a", "b"], "left_semi").groupBy("frame").agg(F.count("*").alias("held"))
    total = known.agg(F.count("*").alias("total"))
    rows = traj.boxes.select("frame").join(held, "frame", "left").join(F.broadcast(total))  # one row
    return rows.select("frame", F.when(F.col("total") > 0, F.coalesce("held", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0)).alias("fraction"))


def atom_map(traj: Trajectory, sel_a: Selection, sel_b: Selection, pbc: bool = False) -> DataFrame:
    near = pairs(traj, sel_a, sel_b, pbc=pbc, same=True).groupBy("frame", F.col("a").alias("atom")).agg(F.min(F.struct("dist", "b")).alias("best"))
    return near.select("frame", "atom", F.col("best.b").alias("nearest"))


def hbond(traj: Trajectory, donors: Selection, acceptors: Selection, cutoff: float, hydrogens: Selection = None, angle_cutoff: float | None = None) -> DataFrame:
    """Donor-acceptor pairs within the cutoff, no periodic images.

    With ``hydrogens``, the k-th of which belongs to the k-th donor, the angle
    from the hydrogen between donor and acceptor must be ``angle_cutoff`` degrees
    at most.
    """
    found = pairs(traj, donors, acceptors, cutoff=cutoff)
    if hydrogens is not None and angle_cutoff is not None:
        order = Window.orderBy("atom")  # the atoms of a selection, not their frames
        turn = lambda sel, name: traj.atoms.where(select(sel)).select(F.col("atom").alias(name), F.row_number().over(order).alias("k"))
        bonded = turn(donors, "a").join(turn(hydrogens, "h"), "k").drop("k")
        at = lambda name: traj.frames.select("frame", F.col("atom").alias(name), *[F.col(c).alias(f"{name}{c}") for c in "xyz"])
        found = found.join(bonded, "a").join(at("a"), ["frame", "a"]).join(at("b"), ["frame", "b"]).join(at("h"), ["frame", "h"])
        u, v = sub(vec("a"), vec("h")), sub(vec("b"), vec("h"))
        found = found.where((norm(u) > 0) & (norm(v) > 0)).where(dot(u, v) / (norm(u) * norm(v)) >= math.cos(math.radians(angle_cutoff)))
    counts = found.groupBy("frame").agg(F.count("*").alias("n"))
    return traj.boxes.select("frame").join(counts, "frame", "left").fillna(0, ["n"])


def mdmat(traj: Trajectory, selection: Selection = None, pbc: bool = False, truncate: float | None = None) -> DataFrame:
    """Smallest distance between residues, mean over frames."""
    found = pairs(traj, selection, selection, pbc=pbc, attributes=("resid",)).where("a_resid != b_resid")
    near = found.groupBy("frame", "a_resid", "b_resid").agg(F.min("dist").alias("dist"))
    value = F.least("dist", F.lit(truncate)) if truncate is not None else F.col("dist")
    return near.groupBy("a_resid", "b_resid").agg(F.avg(value).alias("dist"))


def matrix_distance(traj: Trajectory, selection: Selection = None, pbc: bool = False) -> DataFrame:
    return pairs(traj, selection, selection, pbc=pbc).groupBy("a", "b").agg(F.avg("dist").alias("dist"))


def saltbr(traj: Trajectory, selection: Selection = None, contact: float = 10.0) -> DataFrame:
    """Distances between charge centers of residues by class, mean and frames in contact."""
    rows = traj.points(selection, "resid", "charge").withColumn("w", F.abs("charge"))
    groups = rows.groupBy("frame", "resid").agg(F.sum("charge").alias("q"), *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in "xyz"])
    side = lambda s: groups.select("frame", *[F.col(c).alias(f"{s}_{c}") for c in ("resid", "q", "x", "y", "z")])
    found = side("a").join(side("b"), "frame").where("a_resid < b_resid").withColumn("dist", norm(sub(vec("b_"), vec("a_"))))
    kind = F.when((F.col("a_q") > 0) & (F.col("b_q") > 0), "++").when((F.col("a_q") < 0) & (F.col("b_q") < 0), "--").otherwise("+-")
    return found.groupBy("a_resid", "b_resid").agg(F.first(kind).alias("kind"), F.avg("dist").alias("dist"), F.sum((F.col("dist") <= contact).cast("long")).alias("n_contact"))
