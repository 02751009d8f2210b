"""Operators that need small dense linear algebra, in Arrow functions on aggregated rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import cross, dot, norm, sub, vec
from driftline.model import Selection, Trajectory
from driftline.operators.common import kept
from driftline.operators.fluctuation import features, matrix_covariance

#: Most features whose covariance matrix the driver decomposes.
MOST_FEATURES = 4096


def kabsch(h: np.ndarray) -> np.ndarray:
    """Rotations that bring x onto y, from sums of x_i y_j (n x 3 x 3), reflections excluded."""
    u, _, vt = np.linalg.svd(h)
    d = np.sign(np.linalg.det(u @ vt))
    flip = np.zeros_like(h)
    flip[:, 0, 0], flip[:, 1, 1], flip[:, 2, 2] = 1.0, 1.0, d
    return np.swapaxes(u @ flip @ vt, 1, 2)


def align(traj: Trajectory, selection: Selection = None, reference: int | None = None, mass_weighted: bool = False) -> DataFrame:
    """frame, r (9, row-major), t (3), rmsd of the best fit to the reference: y = R x + t.

    The sums of products are one aggregate with partial sums; the function sees
    one row for each frame.
    """
    ref = traj.at(reference).select("atom", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    p = traj.points(selection, "mass").join(ref, "atom").withColumn("w", F.col("mass") if mass_weighted else F.lit(1.0))
    mean = p.groupBy("frame").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m{c}") for c in ("x", "y", "z", "rx", "ry", "rz")])
    q = p.join(mean, "frame")
    x, y = [F.col(c) - F.col(f"m{c}") for c in "xyz"], [F.col(f"r{c}") - F.col(f"mr{c}") for c in "xyz"]
    sums = q.groupBy("frame", *mean.columns[1:]).agg(F.array(*[F.sum(F.col("w") * a * b) for a in x for b in y]).alias("h"), F.sum(F.col("w") * (sum(a * a for a in x) + sum(b * b for b in y))).alias("e"), F.sum("w").alias("n"))

    def fit(parts):
        for d in parts:
            if not len(d):
                continue
            h = np.stack(d["h"].to_numpy()).reshape(-1, 3, 3)
            r = kabsch(h)
            left = d["e"].to_numpy() - 2.0 * np.einsum("nij,nji->n", r, h)
            t = d[["mrx", "mry", "mrz"]].to_numpy() - np.einsum("nij,nj->ni", r, d[["mx", "my", "mz"]].to_numpy())
            yield pd.DataFrame({"frame": d["frame"], "r": list(r.reshape(-1, 9)), "t": list(t), "rmsd": np.sqrt(np.maximum(left / d["n"].to_numpy(), 0.0))})

    return sums.mapInPandas(fit, "frame long, r array<double>, t array<double>, rmsd double")


def rmsd_aligned(traj: Trajectory, selection: Selection = None, reference: int | None = None, mass_weighted: bool = False) -> DataFrame:
    return align(traj, selection, reference, mass_weighted).select("frame", "rmsd")


def rotation_matrix(traj: Trajectory, selection: Selection = None, reference: int | None = None) -> DataFrame:
    return align(traj, selection, reference).select("frame", *[F.col("r")[i].alias(f"r{i // 3}{i % 3}") for i in range(9)])


def superpose(traj: Trajectory, selection: Selection = None, reference: int | None = None, mass_weighted: bool = False) -> DataFrame:
    rows = traj.frames.join(align(traj, selection, reference, mass_weighted), "frame")
    return rows.select("frame", "atom", *[(F.col("r")[3 * i] * F.col("x") + F.col("r")[3 * i + 1] * F.col("y") + F.col("r")[3 * i + 2] * F.col("z") + F.col("t")[i]).alias(c) for i, c in enumerate("xyz")])


def principal_axes(traj: Trajectory, selection: Selection = None, mass_weighted: bool = True) -> DataFrame:
    """frame, moments (3, ascending), axes (9, a row each); an axis's largest component is positive."""
    from driftline.operators.shape import centered

    w, x, y, z = (F.col(c) for c in "wxyz")
    terms = [w * (y * y + z * z), -w * x * y, -w * x * z, w * (x * x + z * z), -w * y * z, w * (x * x + y * y)]
    sums = centered(traj, selection, mass_weighted).groupBy("frame").agg(F.array(*[F.sum(t) for t in terms]).alias("i"))

    def solve(parts):
        for d in parts:
            if not len(d):
                continue
            v = np.stack(d["i"].to_numpy())
            values, vectors = np.linalg.eigh(v[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
            axes = np.swapaxes(vectors, 1, 2)
            big = np.take_along_axis(axes, np.abs(axes).argmax(axis=2)[:, :, None], 2)
            axes = axes * np.where(big < 0, -1.0, 1.0)
            yield pd.DataFrame({"frame": d["frame"], "moments": list(values), "axes": list(axes.reshape(-1, 9))})

    return sums.mapInPandas(solve, "frame long, moments array<double>, axes array<double>")


def align_principal_axis(traj: Trajectory, selection: Selection = None, mass_weighted: bool = True) -> DataFrame:
    """All coordinates with the principal axes brought onto x, y and z."""
    from driftline.operators.common import centers

    rows = traj.frames.join(principal_axes(traj, selection, mass_weighted), "frame").join(centers(traj, {"c": selection}, mass_weighted), "frame")
    turn = lambda i: sum(F.col("axes")[3 * i + k] * (F.col(c) - F.col(f"c{c}")) for k, c in enumerate("xyz"))
    return rows.select("frame", "atom", *[turn(i).alias(c) for i, c in enumerate("xyz")])


def pca_model(traj: Trajectory, n: int, selection: Selection = None, mass_weighted: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(feature, component, weight of the eigenvectors; eigenvalues), largest first, the largest weight of each positive.

    The driver decomposes the smaller of two symmetric matrices with the same
    eigenvalues: features x features, or frames x frames, whose eigenvectors
    become those of the features by one more aggregation. One of them must have
    MOST_FEATURES rows at most.
    """
    f = features(traj, selection, mass_weighted)
    size = f.agg(F.approx_count_distinct("feature", 0.01).alias("features"), F.approx_count_distinct("frame", 0.01).alias("frames")).collect()[0]
    mean = f.groupBy("feature").agg(F.avg("value").alias("mean"))
    if size["features"] <= 0.98 * MOST_FEATURES and size["features"] <= 4 * size["frames"]:
        table = _symmetric(matrix_covariance(traj, selection, mass_weighted), "i", "j", "cov")
        names, values, vectors = _largest(*table, n)
        weights = traj.frames.sparkSession.createDataFrame([(int(i), k, float(vectors[r, k])) for r, i in enumerate(names) for k in range(vectors.shape[1])], "feature long, component long, weight double")
        return weights, values
    # values of a frame, centered; the frames' products over their number have the covariance's eigenvalues
    x = f.join(mean, "feature").select("feature", "frame", (F.col("value") - F.col("mean")).alias("value"))
    a, b = (x.select("feature", F.col("frame").alias(k), F.col("value").alias(f"v{k}")) for k in "ij")
    products = a.join(b, "feature").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("vi") * F.col("vj")).alias("p"))
    half = products.select("i", "j", "p")
    names, gram = _symmetric(half.unionByName(half.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "p")), "i", "j", "p")
    names, values, vectors = _largest(names, gram / max(len(names), 1), n)
    kept_ = [k for k in range(len(values)) if values[k] > 1e-12 * max(values[0], 1e-300)]
    table = traj.frames.sparkSession.createDataFrame([(int(i), k, float(vectors[r, k] / np.sqrt(values[k] * len(names)))) for r, i in enumerate(names) for k in kept_], "frame long, component long, u double")
    weights = x.join(F.broadcast(table), "frame").groupBy("feature", "component").agg(F.sum(F.col("value") * F.col("u")).alias("weight"))  # MOST_FEATURES x n rows at most
    sign = weights.groupBy("component").agg(F.signum(F.max_by("weight", F.struct(F.round(F.abs("weight"), 9), -F.col("feature")))).alias("sign"))
    return weights.join(F.broadcast(sign), "component").select("feature", "component", (F.col("weight") * F.col("sign")).alias("weight")), values


def _symmetric(rows: DataFrame, i: str, j: str, value: str) -> tuple[list[int], np.ndarray]:
    names = [r[i] for r in rows.select(i).distinct().orderBy(i).limit(MOST_FEATURES + 1).collect()]
    if len(names) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features and frames")
    at = {f: k for k, f in enumerate(names)}
    c = np.zeros((len(names), len(names)))
    found = rows.toArrow()
    if found.num_rows:
        place = np.vectorize(at.__getitem__)
        c[place(found.column(i).to_numpy()), place(found.column(j).to_numpy())] = found.column(value).to_numpy()
    return names, c


def _largest(names: list[int], c: np.ndarray, n: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(c)
    values, vectors = values[::-1][:n], vectors[:, ::-1][:, :n]
    big = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return names, values, vectors * np.where(big < 0, -1.0, 1.0)


def pca(traj: Trajectory, n: int = 3, selection: Selection = None, mass_weighted: bool = False) -> DataFrame:
    _, values = pca_model(traj, n, selection, mass_weighted)
    return traj.frames.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "component long, eigenvalue double")


def projection(traj: Trajectory, n: int = 3, selection: Selection = None, mass_weighted: bool = False) -> DataFrame:
    table, _ = pca_model(traj, n, selection, mass_weighted)
    f = features(traj, selection, mass_weighted)
    mean = f.groupBy("feature").agg(F.avg("value").alias("mean"))
    return f.join(mean, "feature").join(table, "feature").groupBy("frame", "component").agg(F.sum((F.col("value") - F.col("mean")) * F.col("weight")).alias("value"))


def dbscan(traj: Trajectory, eps: float, min_points: int, selection: Selection = None, metric: str = "nofit") -> DataFrame:
    """frame, cluster (-1: noise) by pairwise deviation; clusters number from 0 by their first core frame."""
    from driftline.operators.fluctuation import pairwise_rmsd

    near = pairwise_rmsd(traj, selection, metric).where(F.col("rmsd") <= eps).select(F.col("f1").alias("a"), F.col("f2").alias("b"))
    near = kept(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    core = near.groupBy("a").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_points).select("a")
    if min_points <= 1:
        core = traj.frames.select(F.col("frame").alias("a")).distinct()
    labels = kept(core.select(F.col("a").alias("frame"), F.col("a").alias("label")))
    inner = kept(near.join(core, "a", "left_semi").join(core.select(F.col("a").alias("b")), "b", "left_semi"))
    while True:
        low = inner.join(labels.select(F.col("frame").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("frame")).agg(F.min("other").alias("other"))
        new = kept(labels.join(low, "frame", "left").select("frame", F.least("label", F.coalesce("other", "label")).alias("label"), (F.col("other") < F.col("label")).alias("fell")))
        labels = new.select("frame", "label")
        if new.where("fell").isEmpty():
            break
    edge = near.join(labels.withColumnRenamed("frame", "b"), "b").join(core, "a", "left_anti").groupBy(F.col("a").alias("frame")).agg(F.min("label").alias("label"))
    found = labels.unionByName(edge)
    order = found.select("label").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))  # a row for each cluster
    return traj.boxes.select("frame").join(found.join(order, "label"), "frame", "left").select("frame", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def medoids(traj: Trajectory, clusters: DataFrame, selection: Selection = None, metric: str = "nofit") -> DataFrame:
    """cluster, n, medoid: the frame with the least summed deviation from the cluster's others, noise left out."""
    from driftline.operators.fluctuation import pairwise_rmsd

    d = pairwise_rmsd(traj, selection, metric)
    d = d.unionByName(d.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "rmsd"))
    side = lambda f, c: clusters.where("cluster >= 0").select(F.col("frame").alias(f), F.col("cluster").alias(c))
    inside = d.join(side("f1", "cluster"), "f1").join(side("f2", "other"), "f2").where("cluster = other")
    total = inside.groupBy("cluster", F.col("f1").alias("frame")).agg(F.sum("rmsd").alias("total"))
    every = side("frame", "cluster").join(total, ["cluster", "frame"], "left").fillna(0.0, ["total"])
    return every.groupBy("cluster").agg(F.count("*").alias("n"), F.min(F.struct("total", "frame"))["frame"].alias("medoid"))


def kmeans(traj: Trajectory, k: int, selection: Selection = None, seed: int = 1) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    f = features(traj, selection).groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("f"))
    v = f.select("frame", array_to_vector(F.transform("f", lambda s: s["value"])).alias("features"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select("frame", F.col("prediction").cast("long").alias("cluster"))


def backbone(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """frame, chain, resid, pos, segment and n_, ca_, c_, o_, h_ coordinates, in the order of atoms.

    A segment ends where the chain changes or a residue number is missing. A
    hydrogen that isn't there is put 1.0 from N, away from the middle of the
    previous C, of the same segment, and CA.
    """
    rows = traj.points(selection, "name", "resid", "resname", "chain").where(F.col("name").isin("N", "CA", "C", "O", "H", "HN"))
    named = [("n", ("N",)), ("ca", ("CA",)), ("c", ("C",)), ("o", ("O",)), ("is", ("H", "HN"))]
    at = [F.max(F.when(F.col("name").isin(*names), F.col(c))).alias(f"{k}_{c}") for k, names in named for c in "xyz"]
    res = rows.groupBy("frame", "chain", "resid").agg(F.first("resname").alias("resname"), F.min("atom").alias("first_atom"), *at)
    w = Window.partitionBy("frame").orderBy("first_atom")
    goes_on = F.coalesce((F.lag("chain").over(w) == F.col("chain")) & (F.lag("resid").over(w) + 1 == F.col("resid")), F.lit(False))
    res = res.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("goes_on", goes_on)
    res = res.withColumn("segment", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(w))
    res = res.select("*", *[F.when(F.col("goes_on"), F.lag(f"c_{c}").over(w)).alias(f"p_{c}") for c in "xyz"])
    unit = lambda v: tuple(c / norm(v) for c in v)
    u, v = unit(sub(vec("n_"), vec("p_"))), unit(sub(vec("n_"), vec("ca_")))
    b = tuple(p + q for p, q in zip(u, v, strict=True))
    has = F.col("p_x").isNotNull() & (F.col("resname") != "PRO")
    return res.select("*", *[F.coalesce(F.col(f"is_{c}"), F.when(has, F.col(f"n_{c}") + d / norm(b))).alias(f"h_{c}") for c, d in zip("xyz", b, strict=True)])


def backbone_bonds(residues: DataFrame) -> DataFrame:
    """frame, i (acceptor), j (donor), and their chains and residues, and the energy in kcal/mol; neighbours in order have none."""
    d = residues.select("frame", F.col("chain").alias("donor_chain"), F.col("resid").alias("donor"), F.col("pos").alias("j"), *[f"{n}_{c}" for n in ("n", "h") for c in "xyz"]).where("h_x is not null and n_x is not null")
    a = residues.select("frame", F.col("chain").alias("acceptor_chain"), F.col("resid").alias("acceptor"), F.col("pos").alias("i"), *[f"{n}_{c}" for n in ("c", "o") for c in "xyz"]).where("c_x is not null and o_x is not null")
    far = lambda p, q: 1.0 / norm(sub(vec(f"{p}_"), vec(f"{q}_")))
    energy = 27.888 * (far("o", "n") + far("c", "h") - far("o", "h") - far("c", "n"))
    return d.join(a, "frame").where("abs(i - j) > 1").select("frame", "i", "j", "donor_chain", "donor", "acceptor_chain", "acceptor", energy.alias("energy"))


def kabsch_sander(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """frame, donor and acceptor (residues and their chains), energy in kcal/mol of backbone hydrogen bonds."""
    return backbone_bonds(backbone(traj, selection)).drop("i", "j")


#: The output code of each state.
DSSP_CODES = {" ": 0, "E": 1, "B": 2, "G": 3, "H": 4, "I": 5, "T": 6, "S": 7}


def bridges(held: set[tuple[int, int]]) -> dict[tuple[int, int], set[str]]:
    """(i, j), i + 2 <= j, to the kinds of its bridge, from hydrogen bonds (acceptor, donor); work follows the bonds."""
    tried = {pair for x, y in held for pair in ((x, y), (x + 1, y - 1), (x + 1, y), (y, x + 1))}
    out: dict[tuple[int, int], set[str]] = {}
    for i, j in sorted(pair for pair in tried if pair[1] - pair[0] >= 2):
        if {(i, j), (j, i)} <= held or {(i - 1, j + 1), (j - 1, i + 1)} <= held:
            out.setdefault((i, j), set()).add("anti")
        if {(i - 1, j), (j, i + 1)} <= held or {(j - 1, i), (i, j + 1)} <= held:
            out.setdefault((i, j), set()).add("parallel")
    return out


def secondary_states(segment: list[int], held: set[tuple[int, int]], ca: np.ndarray) -> list[str]:
    """State of each residue: helices first, then strands and bridges, turns and bends, each where nothing earlier is.

    ``held`` are hydrogen bonds (acceptor, donor). Neighbouring bridges of one
    kind make a ladder: antiparallel ones where both sides go the same way,
    parallel ones where they go opposite ways, as in the results to be matched.
    """
    n = len(segment)
    state = [" "] * n
    together = lambda a, b: 0 <= a and b < n and segment[a] == segment[b]
    turns = {k: [together(i, i + k) and (i, i + k) in held for i in range(n)] for k in (3, 4, 5)}
    for k, letter, over in ((5, "I", None), (4, "H", None), (3, "G", " T")):
        for i in range(n - k):
            if turns[k][i] and turns[k][i + 1] and together(i, i + k):
                for x in range(i + 1, i + k + 1):
                    state[x] = letter if over is None or state[x] in over else state[x]
    found = {pair: kinds for pair, kinds in bridges(held).items() if not np.isnan(ca[list(pair)]).any()}
    steps = {"anti": ((1, 1), (-1, -1)), "parallel": ((1, -1), (-1, 1))}
    strand, bridged = set(), {x for pair in found for x in pair}
    for (i, j), kinds in found.items():
        if any(kind in found.get((i + a, j + b), ()) for kind in kinds for a, b in steps[kind]):
            strand |= {i, j}
    span = {x for k in turns for i in range(n) if turns[k][i] for x in range(i + 1, i + k + 1)}
    for x in range(n):
        if state[x] == " ":
            state[x] = "E" if x in strand else "B" if x in bridged else "T" if x in span else "S" if together(x - 2, x + 2) and _bent(ca, x) else " "
    return state


def _bent(ca: np.ndarray, x: int) -> bool:
    u, v = ca[x - 2] - ca[x], ca[x + 2] - ca[x]
    size = np.linalg.norm(u) * np.linalg.norm(v)
    return bool(size > 0 and np.degrees(np.arccos(np.clip(u @ v / size, -1, 1))) > 70)


def dssp(traj: Trajectory, selection: Selection = None, cutoff: float = -0.5) -> DataFrame:
    """frame, chain, resid, state (one of H B E G I T S or blank), code; a frame's hydrogen bonds are one group of the function."""
    b = backbone(traj, selection)
    lists = backbone_bonds(b).where(F.col("energy") < cutoff).groupBy("frame", F.col("i").alias("pos")).agg(F.collect_list("j").alias("donors"))
    rows = b.select("frame", "pos", "segment", "chain", "resid", "ca_x", "ca_y", "ca_z").join(lists, ["frame", "pos"], "left")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos").reset_index(drop=True)
        held = {(i, int(j)) for i, to in enumerate(part["donors"]) if to is not None for j in to}
        state = secondary_states(part["segment"].tolist(), held, part[["ca_x", "ca_y", "ca_z"]].to_numpy(float))
        return pd.DataFrame({"frame": part["frame"], "chain": part["chain"], "resid": part["resid"], "state": state, "code": [DSSP_CODES[x] for x in state]})

    return rows.groupBy("frame").applyInPandas(one, "frame long, chain string, resid long, state string, code long")


def dssp_fractions(traj: Trajectory, selection: Selection = None, cutoff: float = -0.5) -> DataFrame:
    """chain, resid and the share of frames in each state."""
    states = [F.avg((F.col("state") == x).cast("double")).alias(f"f_{x}".replace(" ", "none")) for x in DSSP_CODES]
    return dssp(traj, selection, cutoff).groupBy("chain", "resid").agg(*states)


def dssp_atoms(traj: Trajectory, selection: Selection = None, cutoff: float = -0.5) -> DataFrame:
    """frame, atom, state: every selected atom with its residue's state, blank where the residue has no backbone."""
    states = dssp(traj, selection, cutoff).select("frame", "chain", "resid", "state")
    rows = traj.points(selection, "chain", "resid").select("frame", "atom", "chain", "resid")
    return rows.join(states, ["frame", "chain", "resid"], "left").select("frame", "atom", F.coalesce("state", F.lit(" ")).alias("state"))


#: Van der Waals radii in angstrom, and the one of other elements.
RADII = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "F": 1.47, "CL": 1.75, "MG": 1.18}
OTHER_RADIUS = 1.7


def surf(traj: Trajectory, selection: Selection = None, probe: float = 1.4, n_points: int = 64) -> DataFrame:
    """Solvent-accessible area of each atom: points of a Fibonacci sphere that lie in no neighbour's sphere."""
    from driftline.operators.common import pairs

    radius = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RADII.items() for x in kv]), F.upper("element")), F.lit(OTHER_RADIUS)) + probe
    atoms = traj.atoms.withColumn("radius", radius)
    most = 2 * (max(RADII.values()) + probe)
    sized = Trajectory(traj.frames, atoms, traj.boxes)
    near = pairs(sized, selection, selection, cutoff=most, attributes=("radius",)).where(F.col("dist") < F.col("a_radius") + F.col("b_radius"))
    near = near.groupBy("frame", F.col("a").alias("atom")).agg(F.collect_list(F.struct("dx", "dy", "dz", F.col("b_radius").alias("r"))).alias("near"))
    k = np.arange(n_points)
    z, theta = 1 - 2 * (k + 0.5) / n_points, 2 * np.pi * k / ((1 + 5**0.5) / 2)
    flat = np.sqrt(1 - z * z)
    points = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"), F.lit(float(c)).alias("z")) for a, b, c in zip(flat * np.cos(theta), flat * np.sin(theta), z, strict=True)])
    rows = sized.points(selection, "radius").join(near, ["frame", "atom"], "left")
    covered = lambda p: F.exists("near", lambda o: ((p["x"] * F.col("radius") - o["dx"]) ** 2 + (p["y"] * F.col("radius") - o["dy"]) ** 2 + (p["z"] * F.col("radius") - o["dz"]) ** 2) < o["r"] ** 2)
    exposed = F.when(F.col("near").isNull(), F.lit(n_points)).otherwise(F.size(F.filter(points, lambda p: ~covered(p))))
    return rows.select("frame", "atom", (exposed / n_points * 4.0 * float(np.pi) * F.col("radius") ** 2).alias("area"))


def surf_box(traj: Trajectory, selection: Selection = None) -> DataFrame:
    """frame, area of the selection's bounding box, along the axes."""
    a, b, c = (F.max(k) - F.min(k) for k in "xyz")
    return traj.points(selection).groupBy("frame").agg((2.0 * (a * b + b * c + c * a)).alias("area"))


def helix_orientation(traj: Trajectory, selection: Selection = "name CA") -> DataFrame:
    """frame, resid, radius, twist, rise of the local helix through four consecutive atoms."""
    w = Window.partitionBy("frame").orderBy("resid", "atom")
    rows = traj.points(selection, "resid")
    rows = rows.select("frame", "resid", *[(F.lead(c, k + 1).over(w) - F.lead(c, k).over(w) if k else F.lead(c, 1).over(w) - F.col(c)).alias(f"s{k}{c}") for k in range(3) for c in "xyz"]).where("s2x is not null")
    r12, r23, r34 = vec("s0"), vec("s1"), vec("s2")
    d13, d24 = sub(r12, r23), sub(r23, r34)
    axis = cross(d13, d24)
    c = dot(d13, d24) / (norm(d13) * norm(d24))
    return rows.select("frame", "resid", (F.sqrt(norm(d13) * norm(d24)) / (2.0 * (1.0 - c))).alias("radius"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))).alias("twist"), F.abs(dot(r23, axis) / norm(axis)).alias("rise"))
