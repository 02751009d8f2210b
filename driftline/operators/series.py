"""Series and tables that come out of analyses: correlations, envelopes, integrals, joint densities."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.geometry import dot, min_image, norm, sub, vec
from driftline.model import Selection, Trajectory, box_columns
from driftline.operators.common import indexed, lagged
from driftline.operators.correlation import msd

#: Fixed value: the gas constant in kJ / (mol K).
GAS_CONSTANT = 0.00831446261815324


def correlate(series: DataFrame, first: list[str], second: list[str] | None = None, order: str = "frame", keys: tuple[str, ...] = (), max_lag: int | None = None, normalize: bool = True) -> DataFrame:
    """lag, corr: mean over starts of the product of ``first`` at the start and ``second`` (default the same) at the end, over that of lag 0 if normalised."""
    second = second or first
    base = series if keys else series.withColumn("stream", F.lit(0))
    on = list(keys) or ["stream"]
    rows = lagged(indexed(base, on, order), on, "idx", list(dict.fromkeys([*first, *second])), max_lag)
    product = reduce(Column.__add__, [F.col(f"0_{a}") * F.col(f"1_{b}") for a, b in zip(first, second, strict=True)])
    out = rows.groupBy("lag").agg(F.avg(product).alias("corr"))
    if not normalize:
        return out
    zero = F.max(F.when(F.col("lag") == 0, F.col("corr"))).over(Window.partitionBy())  # a row for each lag
    return out.select("lag", F.when(zero != 0, F.col("corr") / zero).otherwise(F.lit(0.0)).alias("corr"))


def timecorr(vectors: DataFrame, columns: tuple[str, str, str] = ("x", "y", "z"), legendre: int = 1, order: str = "frame", keys: tuple[str, ...] = (), max_lag: int | None = None) -> DataFrame:
    """lag, corr: mean first or second Legendre polynomial of the angle between vectors a lag apart; vectors without length are left out."""
    n = norm(tuple(F.col(c) for c in columns))
    units = vectors.where(n > 0).select(*keys, order, *[(F.col(c) / n).alias(u) for c, u in zip(columns, "uvw", strict=True)])
    base = units if keys else units.withColumn("stream", F.lit(0))
    on = list(keys) or ["stream"]
    rows = lagged(indexed(base, on, order), on, "idx", ["u", "v", "w"], max_lag)
    c = dot(tuple(F.col(f"0_{k}") for k in "uvw"), tuple(F.col(f"1_{k}") for k in "uvw"))
    return rows.groupBy("lag").agg(F.avg(c if legendre == 1 else 1.5 * c * c - 0.5).alias("corr"))


def lowest_envelope(data: DataFrame, x: str, y: str, points: int = 10, step: float = 0.2) -> DataFrame:
    """bin, x (the bin's middle), y: mean of the lowest ``points`` values in each bin of ``x``."""
    rows = data.withColumn("bin", F.floor(F.col(x) / step))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(y, x))
    low = rows.withColumn("rank", rank).where(F.col("rank") <= points)
    return low.groupBy("bin").agg(F.avg(y).alias("y")).select("bin", ((F.col("bin") + 0.5) * step).alias("x"), "y")


def crank(first: DataFrame, second: DataFrame, order: str = "frame", value: str = "dihedral", mode: str = "distance") -> DataFrame:
    """Two series against each other by frame: ``distance`` gives sqrt(a^2 + b^2), ``angle`` degrees of atan2(b, a)."""
    a, b = (d.select(order, F.col(value).alias(k)) for k, d in (("a", first), ("b", second)))
    out = {"distance": F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")), "angle": F.degrees(F.atan2("b", "a"))}[mode]
    return a.join(b, order).select(order, out.alias("crank"))


def ti(samples: DataFrame, coordinate: str = "lam", value: str = "dvdl") -> DataFrame:
    """One row: integral by trapezoids over the means at each coordinate, and its error from their standard errors."""
    means = samples.groupBy(coordinate).agg(F.avg(value).alias("m"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("e"))
    w = Window.orderBy(coordinate)  # a row for each coordinate
    left, right = F.lag(coordinate).over(w), F.lead(coordinate).over(w)
    here = F.col(coordinate)
    weight = (F.coalesce(right, here) - F.coalesce(left, here)) / 2.0
    rows = means.select((weight * F.col("m")).alias("part"), (weight * F.coalesce(F.col("e"), F.lit(0.0))).alias("err"))
    return rows.agg(F.sum("part").alias("integral"), F.sqrt(F.sum(F.col("err") * F.col("err"))).alias("error"))


def project_values(data: DataFrame, x: str, y: str, value: str, bins: int, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """i, j, mean, n of the values in each cell of a grid; those outside are left out."""
    at = [F.floor((F.col(c) - lo) / ((hi - lo) / bins)) for c, lo, hi in zip((x, y), low, high, strict=True)]
    inside = [(F.col(c) >= lo) & (F.col(c) < hi) for c, lo, hi in zip((x, y), low, high, strict=True)]
    return data.where(inside[0] & inside[1]).groupBy(at[0].alias("i"), at[1].alias("j")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def joint_density(data: DataFrame, x: str, y: str, bins: int, low: tuple[float, float], high: tuple[float, float], temperature: float | None = None) -> DataFrame:
    """i, j, density of two observables; with a temperature also the free energy -RT ln p against its least."""
    cell = ((high[0] - low[0]) / bins) * ((high[1] - low[1]) / bins)
    n = project_values(data.withColumn("one", F.lit(1.0)), x, y, "one", bins, low, high).drop("mean")
    total = n.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    rows = n.crossJoin(F.broadcast(total))  # one row
    energy = [] if temperature is None else [(-GAS_CONSTANT * temperature * F.log(F.col("n") / F.col("most")) + 0.0).alias("energy")]
    return rows.select("i", "j", (F.col("n") / (F.col("total") * cell)).alias("density"), *energy)


def diffusion(traj: Trajectory, selection: Selection = None, by: str = "resid", max_lag: int | None = None) -> DataFrame:
    """x, y, z, total: slopes of the squared displacement against time through the least squares line, over 2 and (total) 6."""
    times = traj.boxes.agg(F.max("time_ps").alias("last"), F.min("time_ps").alias("first"), F.count("*").alias("frames"))
    rows = msd(traj, selection, by, max_lag).crossJoin(F.broadcast(times))  # one row
    t = F.col("lag") * (F.col("last") - F.col("first")) / (F.col("frames") - 1)
    return rows.agg(*[(F.regr_slope(F.col(c), t) / (6.0 if c == "total" else 2.0)).alias(c) for c in ("x", "y", "z", "total")])


def bond_vectors(traj: Trajectory, first: Selection, second: Selection, by: str = "resid", pbc: bool = False) -> DataFrame:
    """frame, by, ux, uy, uz: unit vectors from each group's first to its second atom."""
    a, b = (traj.points(s, by).groupBy("frame", by).agg(*[F.min_by(c, "atom").alias(f"{k}{c}") for c in "xyz"]) for k, s in (("a", first), ("b", second)))
    rows = a.join(b, ["frame", by])
    if pbc:
        rows = rows.join(traj.boxes.select("frame", "lx", "ly", "lz"), "frame")
    d = min_image(sub(vec("b"), vec("a")), box_columns() if pbc else None)
    return rows.where(norm(d) > 0).select("frame", by, *[(c / norm(d)).alias(f"u{k}") for c, k in zip(d, "xyz", strict=True)])


def nh_order_parameters(traj: Trajectory, first: Selection, second: Selection, by: str = "resid") -> DataFrame:
    """by, s2: 1.5 times the sum of the squared mean outer product of the bond's unit vectors, less 0.5."""
    u = bond_vectors(traj, first, second, by)
    m = u.groupBy(by).agg(*[F.avg(F.col(f"u{a}") * F.col(f"u{b}")).alias(f"m{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])
    square = reduce(Column.__add__, [F.col(f"m{p}") * F.col(f"m{p}") * (1.0 if p[0] == p[1] else 2.0) for p in ("xx", "yy", "zz", "xy", "xz", "yz")])
    return m.select(by, (1.5 * square - 0.5).alias("s2"))


def ired_matrix(traj: Trajectory, first: Selection, second: Selection, by: str = "resid") -> DataFrame:
    """a, b, corr: mean second Legendre polynomial of the angle between every two bonds of a frame."""
    u = bond_vectors(traj, first, second, by)
    a, b = (u.select("frame", F.col(by).alias(k), *[F.col(f"u{c}").alias(f"{k}_{c}") for c in "xyz"]) for k in "ab")
    c = dot(vec("a_"), vec("b_"))
    return a.join(b, "frame").groupBy("a", "b").agg(F.avg(1.5 * c * c - 0.5).alias("corr"))


def lipidscd(traj: Trajectory, first: Selection, second: Selection, axis: str = "z", by: str = "resid", pbc: bool = False) -> DataFrame:
    """by, scd: mean second Legendre polynomial of the bond's angle with an axis."""
    u = F.col(f"u{axis}")
    return bond_vectors(traj, first, second, by, pbc).groupBy(by).agg(F.avg(1.5 * u * u - 0.5).alias("scd"))


#: Centimetres a second of light, and hertz of each unit of frequency.
LIGHT = 2.99792458e10
UNITS = {"cm-1": LIGHT, "thz": 1e12, "hz": 1.0}


def infraredspec(traj: Trajectory, selection: Selection = None, max_lag: int | None = None, window: str | None = "hann", unit: str = "cm-1") -> DataFrame:
    """k, frequency, intensity: the transform of the velocities' circular autocorrelation, over n - lag, times the step.

    Velocities are differences of neighbouring frames over the frames' median
    step in picoseconds. Each atom's power spectrum is a row of the function;
    what is left then is one number for each frequency.
    """
    if unit not in UNITS or window not in ("hann", "none", None):
        raise ValueError(f"no unit {unit} or window {window}")
    steps = traj.boxes.select((F.lead("time_ps").over(Window.orderBy("frame")) - F.col("time_ps")).alias("dt")).where("dt > 0")  # a row for each frame
    dt = steps.agg(F.median("dt").alias("dt"))
    w = Window.partitionBy("atom").orderBy("frame")
    v = traj.points(selection).select("atom", "frame", *[(F.lead(c).over(w) - F.col(c)).alias(c) for c in "xyz"]).where("x is not null")
    lists = v.groupBy("atom").agg(F.sort_array(F.collect_list(F.struct("frame", "x", "y", "z"))).alias("v")).select(*[F.col(f"v.{c}").alias(c) for c in "xyz"])

    def power(parts):
        for d in parts:
            rows = [np.abs(np.fft.rfft(np.asarray(d[c].iloc[i]))) ** 2 for i in range(len(d)) for c in "xyz"]
            if rows:
                yield pd.DataFrame({"n": [len(d["x"].iloc[0])], "dof": [len(rows)], "power": [np.sum(rows, axis=0)]})

    parts = lists.mapInPandas(power, "n long, dof long, power array<double>")
    total = parts.select("n", "dof", F.posexplode("power").alias("k", "power")).groupBy("k").agg(F.max("n").alias("n"), F.sum("dof").alias("dof"), F.sum("power").alias("power"))

    def spectrum(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        n, step = int(part["n"].iloc[0]), float(part["dt"].iloc[0]) * 1e-12
        corr = np.fft.irfft(part["power"].to_numpy(), n=n) / np.arange(n, 0, -1) / float(part["dof"].iloc[0]) / float(part["dt"].iloc[0]) ** 2
        corr = corr if max_lag is None or max_lag < 0 else corr[: max_lag + 1]
        corr = corr * np.hanning(len(corr)) if window == "hann" else corr
        return pd.DataFrame({"k": np.arange(len(corr) // 2 + 1), "frequency": np.fft.rfftfreq(len(corr), step) / UNITS[unit], "intensity": np.fft.rfft(corr).real * step})

    return total.join(F.broadcast(dt)).groupBy(F.lit(0).alias("all")).applyInPandas(spectrum, "k long, frequency double, intensity double")  # a row for each frequency


def thin_lags(result: DataFrame, cut1: int, stride1: int, cut2: int, stride2: int) -> DataFrame:
    """Rows of a result by lag: all up to ``cut1``, then multiples of ``stride1`` up to ``cut2``, then multiples of ``stride2``."""
    lag = F.col("lag")
    return result.where(F.when(lag > cut2, lag % stride2 == 0).when(lag > cut1, lag % stride1 == 0).otherwise(True))
