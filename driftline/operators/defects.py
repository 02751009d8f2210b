"""Defects of membranes: free sites below a surface that no lipid reaches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import wrap
from driftline.functions.selection import select
from driftline.model import Selection, Trajectory
from driftline.operators.linear import OTHER_RADIUS, RADII

SITE = ["ix", "iy", "iz"]


def _sided(traj: Trajectory, selection: Selection, leaflet: str, midplane: Selection, bins: int) -> DataFrame:
    """frame, box lengths, element, x and y in the box, z of the selected atoms on the leaflet's side of the mean height of ``midplane``, by bins of the plane."""
    if leaflet not in ("both", "upper", "lower"):
        raise ValueError("leaflet is both, upper or lower")
    place = lambda s: traj.points(s, "element", box=True).select("frame", "lx", "ly", "element", *[wrap(F.col(c), F.col(f"l{c}")).alias(c) for c in "xy"], "z")
    rows = place(selection)
    if leaflet == "both":
        return rows
    parts = [F.least(F.floor(F.col(c) / F.col(f"l{c}") * bins), F.lit(bins - 1)).alias(f"p{c}") for c in "xy"]
    heights = place(midplane).select("frame", "z", *parts)
    level = heights.groupBy("frame").agg(F.avg("z").alias("everywhere"))
    local = heights.groupBy("frame", "px", "py").agg(F.avg("z").alias("here"))
    rows = rows.select("*", *parts).join(level, "frame").join(local, ["frame", "px", "py"], "left")
    middle = F.coalesce("here", "everywhere")
    return rows.where(F.col("z") >= middle if leaflet == "upper" else F.col("z") <= middle)


def _columns(rows: DataFrame, voxel: float) -> DataFrame:
    """The rows once for each column of sites within ``reach`` steps of theirs: nx, ny, ix, iy, apart (squared, in the plane)."""
    steps = F.ceil(F.col("reach") / voxel).cast("int")
    rows = rows.withColumn("steps", steps).withColumns({f"n{c}": F.greatest(F.floor(F.col(f"l{c}") / voxel), F.lit(1)) for c in "xy"})
    for c in "xy":
        at, n = F.floor(F.col(c) / voxel), F.col(f"n{c}")
        about = F.transform(F.sequence(-F.col("steps"), F.col("steps")), lambda o: F.pmod(at + o, n))  # noqa: B023
        rows = rows.withColumn(f"i{c}", F.explode(F.array_distinct(about)))
    off = [(F.col(f"i{c}") + 0.5) * voxel - F.col(c) for c in "xy"]
    off = [d - F.round(d / F.col(f"l{c}")) * F.col(f"l{c}") for d, c in zip(off, "xy", strict=True)]
    return rows.withColumn("apart", off[0] * off[0] + off[1] * off[1])


def _heights(rows: DataFrame, low, high, layers: int) -> DataFrame:
    rows = rows.withColumns({"low": F.greatest(low, F.lit(0)), "high": F.least(high, F.lit(layers - 1))})
    return rows.where("low <= high").withColumn("iz", F.explode(F.sequence("low", "high")))


def height_range(traj: Trajectory, lipids: Selection, surface: Selection, voxel: float, probe: float) -> tuple[float, float]:
    """From the lowest to the highest selected atom of the reference, with a probe and a voxel on each side; one row is fetched."""
    z = [traj.at().join(traj.atoms.where(select(s)).select("atom"), "atom", "left_semi").agg(F.min("z").alias("a"), F.max("z").alias("b")) for s in (lipids, surface)]
    r = z[0].unionByName(z[1]).agg(F.min("a").alias("a"), F.max("b").alias("b")).first()
    if r.a is None:
        raise ValueError("no atom is selected")
    return r.a - probe - voxel, r.b + probe + voxel


def defect_sites(traj: Trajectory, lipids: Selection, surface: Selection, voxel: float = 1.0, heights: tuple[float, float] | None = None, probe: float = 1.4, reach: float = 7.3, leaflet: str = "both", midplane: Selection = None, bins: int = 1) -> DataFrame:
    """frame, nx, ny, ix, iy, iz of the sites in a defect.

    A site is the middle of a voxel, periodic in the plane of a box with right
    angles. It is in a defect if it lies below an atom of ``surface``, nearer
    than ``reach`` in the plane, and no atom of ``lipids`` has it within its
    radius and the probe's. Surface atoms are reduced to the highest one above
    each column before heights are written out. ``midplane`` is the lipids
    where it is None.
    """
    z0, z1 = heights or height_range(traj, lipids, surface, voxel, probe)
    if z1 <= z0:
        raise ValueError("heights must increase")
    layers = max(-int(-(z1 - z0) // voxel), 1)
    middle = lipids if midplane is None else midplane
    layer = lambda z: F.floor((z - z0) / voxel)
    height = z0 + (F.col("iz") + 0.5) * voxel
    radius = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RADII.items() for x in kv]), F.upper("element")), F.lit(OTHER_RADIUS))

    top = _columns(_sided(traj, surface, leaflet, middle, bins).withColumn("reach", F.lit(float(reach))), voxel).where(F.col("apart") < reach * reach)
    top = top.groupBy("frame", "nx", "ny", "ix", "iy").agg(F.max("z").alias("top"))
    below = _heights(top, F.lit(0).cast("long"), layer(F.col("top")), layers).where(height < F.col("top"))

    near = _columns(_sided(traj, lipids, leaflet, middle, bins).withColumn("reach", radius + probe), voxel).where("apart <= reach * reach")
    taken = _heights(near, layer(F.col("z")) - F.col("steps"), layer(F.col("z")) + F.col("steps"), layers)
    taken = taken.where(F.col("apart") + (height - F.col("z")) ** 2 <= F.col("reach") ** 2).select("frame", *SITE).distinct()
    return below.join(taken, ["frame", *SITE], "left_anti").select("frame", "nx", "ny", *SITE)


def hydrophobic_defects(traj: Trajectory, lipids: Selection, surface: Selection, **options) -> DataFrame:
    """ix, iy, iz, mean, first, last, min, max of being in a defect, and lifetime (frames in a row, the longest), of sites that are in one in some frame."""
    order = traj.boxes.select("frame", (F.row_number().over(Window.orderBy("frame")) - 1).cast("long").alias("idx"))  # a row for each frame
    frames = traj.boxes.agg(F.count("*").alias("frames"))
    rows = defect_sites(traj, lipids, surface, **options).join(order, "frame")
    place = F.row_number().over(Window.partitionBy(*SITE).orderBy("idx"))
    runs = rows.withColumn("run", F.col("idx") - place).groupBy(*SITE, "run").agg(F.count("*").alias("n"), F.min("idx").alias("begin"), F.max("idx").alias("end"))
    sites = runs.groupBy(*SITE).agg(F.sum("n").alias("n"), F.max("n").alias("lifetime"), F.min("begin").alias("begin"), F.max("end").alias("end")).crossJoin(F.broadcast(frames))  # one row
    flag = lambda c: c.cast("long")
    return sites.select(
        *SITE, (F.col("n") / F.col("frames")).alias("mean"), flag(F.col("begin") == 0).alias("first"), flag(F.col("end") == F.col("frames") - 1).alias("last"),
        flag(F.col("n") == F.col("frames")).alias("min"), F.lit(1).cast("long").alias("max"), "lifetime",
    )


def site_clusters(sites: set[tuple[int, int, int]], nx: int, ny: int) -> list[int]:
    """Sizes of the sites' clusters: neighbours share a face, around the edges of the plane too."""
    left, sizes = set(sites), []
    while left:
        todo = [left.pop()]
        size = 0
        while todo:
            x, y, z = todo.pop()
            size += 1
            beside = {((x + 1) % nx, y, z), ((x - 1) % nx, y, z), (x, (y + 1) % ny, z), (x, (y - 1) % ny, z), (x, y, z + 1), (x, y, z - 1)} & left
            left -= beside
            todo += beside
        sizes.append(size)
    return sizes


def hydrophobic_defect_frames(traj: Trajectory, lipids: Selection, surface: Selection, voxel: float = 1.0, **options) -> DataFrame:
    """frame, sites, area, volume, clusters, largest; a frame's sites are one group of the function."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        sizes = site_clusters(set(part[SITE].itertuples(index=False, name=None)), int(part["nx"].iloc[0]), int(part["ny"].iloc[0]))
        return pd.DataFrame({"frame": part["frame"].iloc[:1], "sites": [len(part)], "clusters": [len(sizes)], "largest": [max(sizes)]})

    found = defect_sites(traj, lipids, surface, voxel, **options).groupBy("frame").applyInPandas(one, "frame long, sites long, clusters long, largest long")
    out = traj.boxes.select("frame").join(found, "frame", "left").fillna(0)
    return out.select("frame", "sites", (F.col("sites") * voxel**2).alias("area"), (F.col("sites") * voxel**3).alias("volume"), "clusters", "largest")


def defect_points(result: DataFrame, voxel: float, lowest: float, mask: str = "last", threshold: float = 0.0) -> DataFrame:
    """x, y, z of the sites of ``hydrophobic_defects`` whose ``mask`` column is above zero (mean: above ``threshold``)."""
    rows = result.where(F.col(mask) > (threshold if mask == "mean" else 0))
    return rows.select(*[((F.col(f"i{c}") + 0.5) * voxel + (lowest if c == "z" else 0.0)).alias(c) for c in "xyz"])


def write_defect_points(points: DataFrame, path: str, form: str = "xyz") -> None:
    """A folder of text files: ``xyz`` lines of 1 and the places, or ``csv`` with a header."""
    if form == "csv":
        points.write.csv(path, header=True)
    elif form == "xyz":
        points.select(F.format_string("1\t %.2f\t %.2f\t %.2f", "x", "y", "z")).write.text(path)
    else:
        raise ValueError("form is xyz or csv")
