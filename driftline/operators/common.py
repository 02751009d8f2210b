"""What several analyses share: centers, within-frame pairs, lags, zero-filled bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import Vec, min_image, norm, sub, vec, wrap
from driftline.functions.selection import select
from driftline.model import Selection, Trajectory, box_columns, box_of, skewed


def centers(traj: Trajectory, selections: dict[str, Selection], mass_weighted: bool = False, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """One row per frame with columns {label}x, {label}y, {label}z, in one pass over the frames."""
    flags = [select(s).alias(f"in_{label}") for label, s in selections.items()]
    rows = traj.frames.join(traj.atoms.select("atom", *([F.col("mass")] if mass_weighted else [F.lit(1.0).alias("mass")]), *flags), "atom")
    total = lambda label, c: F.sum(F.when(F.col(f"in_{label}"), F.col("mass") * F.col(c) if c else F.col("mass")))
    return rows.groupBy(*keys).agg(*[(total(label, c) / total(label, "")).alias(f"{label}{c}") for label in selections for c in "xyz"])


def with_box(traj: Trajectory, df: DataFrame, pbc: bool) -> tuple[DataFrame, Vec | Column | None]:
    if not pbc:
        return df, None
    boxes, box = box_of(traj)
    return df.join(boxes, "frame"), box


def pairs(traj: Trajectory, sel_a: Selection, sel_b: Selection, *, pbc: bool = False, cutoff: float | None = None, unique: bool = False, same: bool = False, attributes: tuple[str, ...] = ()) -> DataFrame:
    """frame, a, b, dx, dy, dz, dist (and a_/b_ attributes) of atom pairs within a frame.

    With a cutoff the join is on frame and cell: boxes are cut into cells not
    narrower than the cutoff and one side is repeated for the neighbouring ones,
    so the work follows the number of close pairs. ``unique`` keeps a < b;
    pairs of an atom with itself are left out unless ``same``.
    """
    side = lambda s, sel: traj.points(sel, *attributes).select("frame", F.col("atom").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("x", "y", "z", *attributes)])
    a, b = side("a", sel_a), side("b", sel_b)
    on = ["frame"]
    # cells of a skewed box aren't cut: all pairs of a frame are looked at
    gridded = cutoff is not None and not (pbc and skewed(traj))
    if gridded:
        cells = [f"cell_{c}" for c in "xyz"]
        on += cells
        a, b = a.join(traj.boxes.select("frame", "lx", "ly", "lz"), "frame"), b.join(traj.boxes.select("frame", "lx", "ly", "lz"), "frame")
        count = lambda c: F.greatest(F.floor(F.col(f"l{c}") / cutoff), F.lit(1))

        def cell(p: Column, c: str) -> Column:
            free = F.floor(p / cutoff)
            if not pbc:
                return free
            periodic = F.least(F.floor(wrap(p, F.col(f"l{c}")) / F.col(f"l{c}") * count(c)), count(c) - 1)
            return F.when(F.col(f"l{c}") > 0, periodic).otherwise(free)

        around = lambda c: F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda o: F.when(F.lit(pbc) & (F.col(f"l{c}") > 0), F.pmod(cell(F.col(f"b_{c}"), c) + o, count(c))).otherwise(cell(F.col(f"b_{c}"), c) + o)))
        a = a.select("*", *[cell(F.col(f"a_{c}"), c).alias(f"cell_{c}") for c in "xyz"])
        for c in "xyz":
            b = b.withColumn(f"cell_{c}", F.explode(around(c)))
        b = b.drop("lx", "ly", "lz")
    joined = a.join(b, on)
    if not same:
        joined = joined.where(F.col("a") != F.col("b"))
    if unique:
        joined = joined.where(F.col("a") < F.col("b"))
    if gridded:
        box = box_columns() if pbc else None
    else:
        joined, box = with_box(traj, joined, pbc)
    d = min_image(sub(vec("b_"), vec("a_")), box)
    out = joined.select("frame", "a", "b", *[F.col(f"{s}_{x}") for s in "ab" for x in attributes], *[x.alias(f"d{c}") for x, c in zip(d, "xyz", strict=True)], norm(d).alias("dist"))
    return out.where(F.col("dist") <= cutoff) if cutoff is not None else out


def lagged(df: DataFrame, keys: list[str], order: str, values: list[str], max_lag: int | None) -> DataFrame:
    """keys, order, lag, values at the start (0_) and the end (1_) of every pair of rows up to ``max_lag`` apart (None: all).

    ``order`` is an index without gaps inside each key; the join is on the keys
    and the index, after one side is repeated once for each lag.
    """
    reach = F.col("reach_") if max_lag is None else F.lit(max_lag)
    if max_lag is None:
        df = df.withColumn("reach_", F.max(order).over(Window.partitionBy(*keys)) - F.col(order))
    late = df.select(*keys, F.col(order).alias("end"), *[F.col(v).alias(f"1_{v}") for v in values])
    early = df.select(*keys, order, *[F.col(v).alias(f"0_{v}") for v in values], F.explode(F.sequence(F.lit(0).cast("long"), reach.cast("long"))).alias("lag"))
    return early.withColumn("end", F.col(order) + F.col("lag")).join(late, [*keys, "end"]).drop("end")


def multi_tau_lags(m: int, levels: int) -> list[int]:
    """1 .. m - 1, and on each further level the upper half of those, twice as far apart."""
    return [j << k for k in range(levels) for j in range(1 if k == 0 else m // 2, m)]


def multi_tau(df: DataFrame, keys: list[str], order: str, values: list[str], m: int, levels: int) -> DataFrame:
    """As ``lagged``, at multi_tau_lags only: a level's rows are means of twice as many neighbours as the one before's.

    The rows of a level are half of those below, so the work follows rows x m, not rows x lags.
    """
    out = None
    for k in range(levels):
        block = df.groupBy(*keys, F.floor(F.col(order) / (1 << k)).cast("long").alias(order)).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("held_"))
        rows = lagged(block.where(F.col("held_") == 1 << k).drop("held_"), keys, order, values, m - 1).where(F.col("lag") >= (1 if k == 0 else m // 2))
        rows = rows.withColumn("lag", F.col("lag") * (1 << k))
        out = rows if out is None else out.unionByName(rows)
    return out


def indexed(df: DataFrame, keys: list[str], order: str = "frame") -> DataFrame:
    """Adds idx, 0, 1, ... along ``order`` inside each key."""
    return df.withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def filled(df: DataFrame, bins: int, column: str = "bin", fill: dict | None = None) -> DataFrame:
    """One row for each of 0..bins-1, missing ones with zeros."""
    every = df.sparkSession.range(bins).select(F.col("id").alias(column))
    return every.join(df, column, "left").fillna(fill if fill is not None else 0)


def kept(df: DataFrame) -> DataFrame:
    """The rows with their lineage cut: a checkpoint where the session has a folder for it, else as they are."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
