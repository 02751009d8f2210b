"""A trajectory as lazy tables.

``frames`` has a row for each frame and atom (frame, atom, x, y, z), ``atoms``
one for each atom (atom, name, resname, resid, chain, element, mass, charge),
``boxes`` one for each frame (frame, time_ps, lx, ly, lz; null lengths: no box),
with a column ``cell`` of nine numbers, the cell's vectors one after the other,
where cells are skewed (null: as the lengths say). Distances, angles, unwrapping
and imaging take skewed cells; grids and membranes need right angles.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.geometry import Vec
from driftline.functions.selection import select

Selection = str | Column | None


@dataclass(frozen=True)
class Trajectory:
    frames: DataFrame
    atoms: DataFrame
    boxes: DataFrame
    bonds: DataFrame | None = None
    reference: DataFrame | None = None

    def points(self, selection: Selection = None, *attributes: str, box: bool = False) -> DataFrame:
        """Coordinates of the selected atoms with some of their attributes."""
        wanted = self.atoms.where(select(selection)).select("atom", *attributes)
        out = self.frames.join(wanted, "atom")
        return out.join(self.boxes.select("frame", "lx", "ly", "lz"), "frame") if box else out

    def at(self, frame: int | None = None) -> DataFrame:
        """Coordinates of the reference, or of a frame (the first one if None)."""
        if frame is None and self.reference is not None:
            return self.reference
        if frame is None:
            first = self.frames.agg(F.min("frame").alias("frame"))
            return self.frames.join(first, "frame").drop("frame")
        return self.frames.where(F.col("frame") == frame).drop("frame")

    def with_frames(self, frames: DataFrame) -> Trajectory:
        return replace(self, frames=frames)


def box_columns() -> Vec:
    return (F.col("lx"), F.col("ly"), F.col("lz"))


def skewed(traj: Trajectory) -> bool:
    return "cell" in traj.boxes.columns


def cell_column() -> Column:
    """The cell of a frame of a trajectory with skewed cells; null without a box."""
    zero = F.lit(0.0)
    lengths = F.when(F.col("lx").isNotNull(), F.array(F.col("lx"), zero, zero, zero, F.col("ly"), zero, zero, zero, F.col("lz")))
    return F.coalesce(F.col("cell"), lengths)


def box_of(traj: Trajectory) -> tuple[DataFrame, Vec | Column]:
    """The boxes by frame, and the box as ``min_image`` takes it."""
    if skewed(traj):
        return traj.boxes.select("frame", cell_column().alias("cell")), F.col("cell")
    return traj.boxes.select("frame", "lx", "ly", "lz"), box_columns()


def from_lineitem(spark: SparkSession, sf_dir: str, frames: int = 50, atoms: int = 40) -> Trajectory:
    """The trajectory view over the driver's lineitem table: exact integer sums, scaled."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    place = lambda a, b, c: (F.sum(o * a + p * b + n * c) % 50000).cast("double") / 1000
    points = rows.groupBy((o % frames).alias("frame"), (p % atoms).alias("atom")).agg(
        place(7919, 104729, 1299709).alias("x"), place(15485863, 7919, 104729).alias("y"), place(104729, 1299709, 7919).alias("z")
    )
    a = F.col("atom")
    table = spark.range(atoms).select(F.col("id").alias("atom")).select(
        "atom",
        F.element_at(F.array(*map(F.lit, ("N", "CA", "C", "O"))), (a % 4 + 1).cast("int")).alias("name"),
        F.element_at(F.array(*map(F.lit, ("ALA", "GLY", "SOL", "NA"))), (F.floor(a / 4) % 4 + 1).cast("int")).alias("resname"),
        F.floor(a / 4).cast("long").alias("resid"),
        F.when(a < 20, "A").otherwise("B").alias("chain"),
        F.element_at(F.array(*map(F.lit, ("N", "C", "C", "O"))), (a % 4 + 1).cast("int")).alias("element"),
        (a % 16 + 1).cast("double").alias("mass"),
        F.when(a % 2 == 0, 1.0).otherwise(-1.0).alias("charge"),
    )
    fifty = F.lit(50.0)
    boxes = spark.range(frames).select(F.col("id").alias("frame"), (F.col("id") * 2.0).alias("time_ps"), fifty.alias("lx"), fifty.alias("ly"), fifty.alias("lz"))
    return Trajectory(points, table, boxes)


def from_arrays(spark: SparkSession, coordinates, atoms: DataFrame, boxes=None, times=None) -> Trajectory:
    """A trajectory of frames x atoms x 3 coordinates, with frames x 3 box lengths or frames x 9 cells, and times, where given."""
    import numpy as np
    import pandas as pd

    x = np.asarray(coordinates, float)
    if x.ndim != 3 or x.shape[2] != 3:
        raise ValueError("coordinates must be frames x atoms x 3")
    n, m, _ = x.shape
    points = pd.DataFrame({"frame": np.repeat(np.arange(n), m), "atom": np.tile(np.arange(m), n), **{c: x[:, :, k].reshape(-1) for k, c in enumerate("xyz")}})
    time = np.arange(n, dtype=float) if times is None else np.asarray(times, float)
    table = {"frame": list(range(n)), "time_ps": time.tolist()}
    schema = "frame long, time_ps double, lx double, ly double, lz double"
    if boxes is None:
        table |= {c: [None] * n for c in ("lx", "ly", "lz")}
    else:
        b = np.asarray(boxes, float).reshape(n, -1)
        table |= {c: b[:, k if b.shape[1] == 3 else 4 * k].tolist() for k, c in enumerate(("lx", "ly", "lz"))}
        if b.shape[1] == 9:
            table["cell"], schema = b.tolist(), schema + ", cell array<double>"
    rows = list(zip(*table.values(), strict=True))
    return Trajectory(spark.createDataFrame(points, "frame long, atom long, x double, y double, z double"), atoms, spark.createDataFrame(rows, schema))
