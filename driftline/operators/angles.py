"""Angles, dihedrals and what follows from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import angle as between
from driftline.functions.geometry import cross, dihedral as torsion
from driftline.functions.geometry import clamp, dot, eigenvalues, min_image, norm, rotate_about, signed, sub, vec, wrapped_difference
from driftline.functions.selection import select
from driftline.model import Selection, Trajectory
from driftline.operators.common import centers, with_box

Quad = tuple[Selection, Selection, Selection, Selection]


def multi_angle(traj: Trajectory, terms: list[tuple[Selection, Selection, Selection]], mass_weighted: bool = False, pbc: bool = False, degrees: bool = True) -> DataFrame:
    named = {f"{s}{i}_": sel for i, t in enumerate(terms) for s, sel in zip("abc", t, strict=True)}
    rows, box = with_box(traj, centers(traj, named, mass_weighted), pbc)
    one = lambda i: between(min_image(sub(vec(f"a{i}_"), vec(f"b{i}_")), box), min_image(sub(vec(f"c{i}_"), vec(f"b{i}_")), box), degrees)
    return rows.select("frame", *[one(i).alias(f"angle_{i}") for i in range(len(terms))])


def angle(traj: Trajectory, sel_a: Selection, sel_b: Selection, sel_c: Selection, **options) -> DataFrame:
    return multi_angle(traj, [(sel_a, sel_b, sel_c)], **options).withColumnRenamed("angle_0", "angle")


def multidihedral(traj: Trajectory, terms: list[Quad], mass_weighted: bool = False, pbc: bool = False, degrees: bool = True, range360: bool = False) -> DataFrame:
    named = {f"{s}{i}_": sel for i, t in enumerate(terms) for s, sel in zip("abcd", t, strict=True)}
    rows, box = with_box(traj, centers(traj, named, mass_weighted), pbc)
    return rows.select("frame", *[torsion([vec(f"{s}{i}_") for s in "abcd"], box, degrees, range360).alias(f"dihedral_{i}") for i in range(len(terms))])


def dihedral(traj: Trajectory, *quad: Selection, **options) -> DataFrame:
    return multidihedral(traj, [tuple(quad)], **options).withColumnRenamed("dihedral_0", "dihedral")


def dihedral_rms(traj: Trajectory, terms: list[Quad], reference: int | None = None) -> DataFrame:
    """Root mean square of the wrapped differences to the reference's dihedrals, in degrees."""
    fixed = traj.with_frames(traj.at(reference).withColumn("frame", F.lit(0).cast("long")))
    ref = multidihedral(fixed, terms).drop("frame")
    ref = ref.toDF(*[f"ref_{c}" for c in ref.columns])
    rows = multidihedral(traj, terms).join(F.broadcast(ref))  # one row
    squares = [wrapped_difference(F.col(f"dihedral_{i}"), F.col(f"ref_dihedral_{i}")) ** 2 for i in range(len(terms))]
    return rows.select("frame", F.sqrt(sum(squares) / len(terms)).alias("rms"))


def check_chirality(traj: Trajectory, groups: list[Quad], mass_weighted: bool = False) -> DataFrame:
    named = {f"{s}{i}_": sel for i, t in enumerate(groups) for s, sel in zip("abcd", t, strict=True)}
    rows = centers(traj, named, mass_weighted)
    volume = lambda i: dot(cross(*[sub(vec(f"{s}{i}_"), vec(f"a{i}_")) for s in "bc"]), sub(vec(f"d{i}_"), vec(f"a{i}_")))
    return rows.select("frame", *[volume(i).alias(f"volume_{i}") for i in range(len(groups))])


def rama(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """Backbone phi and psi of each residue, null at the ends; the first vector of each runs backwards, so both stand 180 degrees from the usual."""
    points = traj.points(selection, "name", "resid", "chain").where(F.col("name").isin("N", "CA", "C"))
    place = lambda n: [F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{n.lower()}_{c}") for c in "xyz"]
    res = points.groupBy("frame", "chain", "resid").agg(*place("N"), *place("CA"), *place("C"))
    w = Window.partitionBy("frame", "chain").orderBy("resid")
    res = res.select("*", *[F.lag(f"c_{c}").over(w).alias(f"p_{c}") for c in "xyz"], *[F.lead(f"n_{c}").over(w).alias(f"q_{c}") for c in "xyz"])

    def turned(p: list) -> Column:
        b1, b2, b3 = sub(p[1], p[0]), sub(p[2], p[1]), sub(p[3], p[2])
        back = tuple(-c for c in b1)
        n1, n2 = cross(back, b2), cross(b2, b3)
        return F.degrees(F.atan2(norm(b2) * dot(back, n2), dot(n1, n2)))

    phi = turned([vec("p_"), vec("n_"), vec("ca_"), vec("c_")])
    psi = turned([vec("n_"), vec("ca_"), vec("c_"), vec("q_")])
    return res.select("frame", "chain", "resid", phi.alias("phi"), psi.alias("psi"))


def _quads(traj: Trajectory, selection: Selection) -> DataFrame:
    """Dihedral of every four consecutive selected atoms, taken four by four."""
    w = Window.partitionBy("frame").orderBy("atom")
    rows = traj.points(selection).withColumn("pos", F.row_number().over(w) - 1)
    quads = rows.groupBy("frame", F.floor(F.col("pos") / 4).alias("quad")).agg(F.count("*").alias("n"), *[F.max(F.when(F.col("pos") % 4 == i, F.col(c))).alias(f"p{i}{c}") for i in range(4) for c in "xyz"])
    theta = torsion([vec(f"p{i}") for i in range(4)])
    state = F.when(F.abs("theta") > 150, "trans").when(F.abs("theta") < 30, "cis").when(F.col("theta") > 0, "g_plus").otherwise("g_minus")
    return quads.where("n = 4").select("frame", "quad", theta.alias("theta")).withColumn("state", state)


STATES = ("trans", "cis", "g_plus", "g_minus")


def tordiff(traj: Trajectory, selection: Selection = None) -> DataFrame:
    return _quads(traj, selection).groupBy("frame").agg(*[F.avg((F.col("state") == s).cast("double")).alias(s) for s in STATES])


def toroidal_transitions(traj: Trajectory, selection: Selection = None, lag: int = 1) -> DataFrame:
    w = Window.partitionBy("quad").orderBy("frame")
    rows = _quads(traj, selection).withColumn("before", F.lag("state", lag).over(w)).where("before is not null")
    return rows.groupBy(F.col("before").alias("source"), F.col("state").alias("target")).agg(F.count("*").alias("n"))


def pucker(traj: Trajectory, selection: Selection = None, metric: str = "max_radius", phase: bool = False) -> DataFrame:
    """frame, radius or amplitude, and phase (degrees, 0 to 360).

    ``max_radius`` is the largest distance from the ring's center, ``amplitude``
    the root of the least eigenvalue of the coordinates' covariance. The phase is
    that of the heights along the plane's normal against the atoms' order; the
    normal's largest component is positive.
    """
    if metric not in ("max_radius", "amplitude"):
        raise ValueError(f"no metric {metric}")
    rows = traj.points(selection).join(centers(traj, {"c": selection}), "frame")
    rows = rows.select("frame", "atom", *[(F.col(c) - F.col(f"c{c}")).alias(c) for c in "xyz"])
    radius = F.max(norm(vec())).alias("radius")
    if metric == "max_radius" and not phase:
        return rows.groupBy("frame").agg(radius)
    parts = ("xx", "yy", "zz", "xy", "xz", "yz")
    flat = rows.groupBy("frame").agg(radius, F.count("*").alias("n"), *[F.avg(F.col(p[0]) * F.col(p[1])).alias(p) for p in parts])
    flat = flat.withColumn("low", eigenvalues(*[F.col(p) for p in parts])[0])
    value = F.col("radius") if metric == "max_radius" else F.sqrt(F.greatest("low", F.lit(0.0))).alias("amplitude")
    if not phase:
        return flat.select("frame", value)
    xx, yy, zz, xy, xz, yz = (F.col(p) for p in parts)
    lines = [(xx - F.col("low"), xy, xz), (xy, yy - F.col("low"), yz), (xz, yz, zz - F.col("low"))]
    # two rows of the shifted covariance that aren't parallel span the plane
    across = [cross(lines[i], lines[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    best = F.array_max(F.array(*[F.struct(norm(v).alias("size"), *[c.alias(k) for c, k in zip(v, "xyz", strict=True)]) for v in across]))
    flat = flat.withColumn("best", best)
    largest = F.array_max(F.array(*[F.struct(F.abs(F.col(f"best.{k}")).alias("size"), F.signum(F.col(f"best.{k}")).alias("sign")) for k in "xyz"]))["sign"]
    flat = flat.select("frame", value, "n", *[(F.col(f"best.{k}") / F.col("best.size") * largest).alias(f"n{k}") for k in "xyz"])
    order = F.row_number().over(Window.partitionBy("frame").orderBy("atom")) - 1
    turned = rows.withColumn("j", order).join(flat, "frame").withColumn("turn", 2.0 * math.pi * F.col("j") / F.col("n"))
    height = dot(vec(), vec("n"))
    q = turned.groupBy("frame").agg(F.first(value.alias("value") if metric == "max_radius" else F.col("amplitude")).alias("radius" if metric == "max_radius" else "amplitude"), F.first("n").alias("n"), F.sum(height * F.cos("turn")).alias("qx"), F.sum(height * F.sin("turn")).alias("qy"))
    name = "radius" if metric == "max_radius" else "amplitude"
    return q.select("frame", name, F.when(F.col("n") < 3, F.lit(0.0)).otherwise(signed(F.atan2("qy", "qx"), True, True)).alias("phase"))


def _turned(traj: Trajectory, quad: Quad, rotated: Selection, theta: Column, mass_weighted: bool, pbc: bool = False) -> DataFrame:
    rows = centers(traj, dict(zip(("a_", "b_", "c_", "d_"), quad, strict=True)), mass_weighted)
    rows, box = with_box(traj, rows, pbc)
    rows = rows.withColumn("now", torsion([vec(f"{s}_") for s in "abcd"], box, degrees=False)).withColumn("theta", theta)
    points = traj.frames.join(traj.atoms.select("atom", select(rotated).alias("turns")), "atom").join(rows, "frame")
    new = rotate_about(vec(), vec("b_"), sub(vec("c_"), vec("b_")), F.col("theta"))
    return points.select("frame", "atom", *[F.when(F.col("turns"), n).otherwise(F.col(c)).alias(c) for n, c in zip(new, "xyz", strict=True)])


def rotate_dihedral(traj: Trajectory, quad: Quad, rotated: Selection, degrees: float, mass_weighted: bool = False) -> DataFrame:
    return _turned(traj, quad, rotated, F.lit(math.radians(degrees)), mass_weighted)


def set_dihedral(traj: Trajectory, quad: Quad, rotated: Selection, degrees: float, mass_weighted: bool = False, pbc: bool = False) -> DataFrame:
    return _turned(traj, quad, rotated, F.lit(math.radians(degrees)) - F.col("now"), mass_weighted, pbc)


# Polymers: chains are the chain attribute, in order of residue and atom.


def _chain(traj: Trajectory, selection: Selection) -> tuple[DataFrame, object]:
    return traj.points(selection, "chain", "resid"), Window.partitionBy("frame", "chain").orderBy("resid", "atom")


def bonds(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """frame, chain, k, dx, dy, dz, length of each consecutive pair of a chain."""
    rows, w = _chain(traj, selection)
    rows = rows.select("frame", "chain", (F.row_number().over(w) - 1).cast("long").alias("k"), *[(F.lead(c).over(w) - F.col(c)).alias(f"d{c}") for c in "xyz"])
    return rows.where("dx is not null").withColumn("length", norm(vec("d")))


def bond_length_distribution(traj: Trajectory, selection: Selection = None, bins: int = 50, r_max: float = 50.0) -> DataFrame:
    from driftline.operators.common import filled

    rows = bonds(traj, selection).where(F.col("length") < r_max)
    return filled(rows.groupBy(F.floor(F.col("length") / (r_max / bins)).alias("bin")).agg(F.count("*").alias("n")), bins)


def bond_angle_distribution(traj: Trajectory, selection: Selection = None, bins: int = 36) -> DataFrame:
    from driftline.operators.common import filled

    w = Window.partitionBy("frame", "chain").orderBy("k")
    rows = bonds(traj, selection).select("*", *[F.lead(f"d{c}").over(w).alias(f"e{c}") for c in "xyz"]).where("ex is not null")
    theta = between(tuple(-c for c in vec("d")), vec("e"))
    rows = rows.select(theta.alias("theta")).where("theta < 180")
    return filled(rows.groupBy(F.floor(F.col("theta") / (180.0 / bins)).alias("bin")).agg(F.count("*").alias("n")), bins)


def contour_length(traj: Trajectory, selection: Selection = None) -> DataFrame:
    return bonds(traj, selection).groupBy("frame", "chain").agg(F.sum("length").alias("contour"))


def end_to_end(traj: Trajectory, selection: Selection = None) -> DataFrame:
    rows, _ = _chain(traj, selection)
    key, point = F.struct("resid", "atom"), F.struct("x", "y", "z")
    ends = rows.groupBy("frame", "chain").agg(F.min_by(point, key).alias("a"), F.max_by(point, key).alias("b"))
    return ends.select("frame", "chain", norm(sub(vec("b."), vec("a."))).alias("dist"))


def bond_correlation(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """k, corr: mean cosine between bonds k apart along a chain."""
    rows = bonds(traj, selection).where("length > 0")
    a, b = (rows.select("frame", "chain", F.col("k").alias(f"k{i}"), *[(F.col(f"d{c}") / F.col("length")).alias(f"u{i}{c}") for c in "xyz"]) for i in (1, 2))
    return a.join(b, ["frame", "chain"]).where("k2 >= k1").groupBy((F.col("k2") - F.col("k1")).alias("k")).agg(F.avg(dot(vec("u1"), vec("u2"))).alias("corr"))


def persistence_length(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """Mean bond length, persistence and Kuhn length from the slope of the log of positive correlations."""
    mean = bonds(traj, selection).agg(F.avg("length").alias("bond"))
    points = bond_correlation(traj, selection).where("corr > 0").join(F.broadcast(mean))  # one row
    fit = points.agg(F.first("bond").alias("bond"), F.expr("regr_slope(ln(corr), bond * k)").alias("slope"))
    return fit.select("bond", (-1.0 / F.col("slope")).alias("persistence"), (-2.0 / F.col("slope")).alias("kuhn"))


def multipucker(traj: Trajectory, selection: Selection = None, bins: int = 10, range_max: float | None = None, normalize: bool = True) -> DataFrame:
    """frame, bin, value: distances from the center in each frame, up to ``range_max`` (itself in the last bin) or else the largest of all."""
    rows = traj.points(selection).join(centers(traj, {"c": selection}), "frame").select("frame", norm(sub(vec(), vec("c"))).alias("r"))
    top = rows.agg(F.max("r").alias("top")) if range_max is None else traj.frames.sparkSession.range(1).select(F.lit(float(range_max)).alias("top"))
    rows = rows.crossJoin(F.broadcast(top)).where("r <= top")  # one row
    at = F.when(F.col("top") > 0, F.least(F.floor(F.col("r") * bins / F.col("top")), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    n = rows.groupBy("frame", at.alias("bin")).agg(F.count("*").alias("n"))
    every = traj.boxes.select("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    out = every.join(n, ["frame", "bin"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("frame"))
    value = F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)) if normalize else F.col("n").cast("double")
    return out.select("frame", "bin", value.alias("value"))


def bundle(traj: Trajectory, top: Selection, bottom: Selection, kink: Selection = None, by: str = "chain", mass_weighted: bool = False) -> DataFrame:
    """Geometry of each axis (group) of a bundle about the bundle's middle, with z as the reference axis.

    frame, by, mid_x .. mid_z, dir_x .. dir_z, length, distance, z_shift, tilt,
    radial_tilt, lateral_tilt; with ``kink`` also kink_angle, kink_radial and
    kink_lateral. Angles in degrees, 0 where undefined. Atoms of an end are
    taken in the images next to its first one.
    """
    parts = {"t": top, "b": bottom} | ({"k": kink} if kink is not None else {})
    flags = F.array(*[F.when(select(s), F.lit(k)) for k, s in parts.items()])
    ends = traj.atoms.select("atom", by, "mass", F.explode(F.array_compact(flags)).alias("part"))
    rows = traj.frames.join(ends, "atom").join(traj.boxes.select("frame", "lx", "ly", "lz"), "frame")
    w = Window.partitionBy("frame", by, "part").orderBy("atom")
    start = tuple(F.first(c).over(w) for c in "xyz")
    near = min_image(sub(vec(), start), (F.col("lx"), F.col("ly"), F.col("lz")))
    rows = rows.select("frame", by, "part", "mass", *[(s + d).alias(c) for s, d, c in zip(start, near, "xyz", strict=True)])
    m = F.col("mass") if mass_weighted else F.lit(1.0)
    sums = lambda k, c: F.sum(F.when(F.col("part") == k, m * F.col(c) if c else m))
    g = rows.groupBy("frame", by).agg(*[(sums(k, c) / sums(k, "")).alias(f"{k}{c}") for k in parts for c in "xyz"])
    every = Window.partitionBy("frame")
    middle = {c: (F.avg(f"t{c}").over(every) + F.avg(f"b{c}").over(every)) / 2.0 for c in "xyz"}
    g = g.select("frame", by, *[(F.col(f"{k}{c}") - middle[c]).alias(f"{k}{c}") for k in parts for c in "xyz"])
    raw = sub(vec("t"), vec("b"))
    g = g.select("*", *[((F.col(f"t{c}") + F.col(f"b{c}")) / 2.0).alias(f"mid_{c}") for c in "xyz"], norm(raw).alias("length"))
    unit = lambda v: tuple(F.when(norm(v) > 0, c / norm(v)).otherwise(F.lit(0.0)) for c in v)
    g = g.select("*", *[c.alias(f"dir_{k}") for c, k in zip(unit(raw), "xyz", strict=True)])
    mid, d = vec("mid_"), vec("dir_")
    lean = lambda part: F.when(F.sqrt(part * part + d[2] * d[2]) > 1e-12, F.degrees(F.asin(clamp(part / F.sqrt(part * part + d[2] * d[2]))))).otherwise(F.lit(0.0))
    out = [*[F.col(f"{p}_{c}") for p in ("mid", "dir") for c in "xyz"], F.col("length"), norm(mid).alias("distance"), mid[2].alias("z_shift"), F.degrees(F.acos(clamp(d[2]))).alias("tilt")]
    out += [lean(mid[0] * d[0] + mid[1] * d[1]).alias("radial_tilt"), lean(mid[1] * d[0] - mid[0] * d[1]).alias("lateral_tilt")]
    if kink is not None:
        up, down = unit(sub(vec("t"), vec("k"))), unit(sub(vec("k"), vec("b")))
        out_of = unit((mid[0], mid[1], F.lit(0.0)))
        turn = cross(up, down)
        side = lambda v: F.degrees(F.asin(clamp(dot(turn, v))))
        out += [F.degrees(F.acos(clamp(dot(up, down)))).alias("kink_angle"), side(out_of).alias("kink_radial"), side((out_of[1], -out_of[0], F.lit(0.0))).alias("kink_lateral")]
    return g.select("frame", by, *out)


def jcoupling(traj: Trajectory, quads: list[Quad], a: float = 6.4, b: float = -1.4, c: float = 1.9, phase: float = 0.0, pbc: bool = False) -> DataFrame:
    """Scalar couplings of dihedrals by a Karplus curve, A cos^2 + B cos + C; ``phase`` in degrees."""
    rows = multidihedral(traj, quads, pbc=pbc)
    turn = lambda i: F.cos(F.radians(F.col(f"dihedral_{i}") + phase))
    return rows.select("frame", *[(a * turn(i) * turn(i) + b * turn(i) + c).alias(f"j_{i}") for i in range(len(quads))])
