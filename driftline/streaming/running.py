"""Per-frame and per-atom aggregates of a stream of (frame, atom, x, y, z) rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_rg(points: DataFrame) -> DataFrame:
    """Radius of gyration of each frame so far; for update or complete mode."""
    mean = lambda c: F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c)
    return points.groupBy("frame").agg(F.sqrt(F.greatest(mean("x") + mean("y") + mean("z"), F.lit(0.0))).alias("rg"), F.count("*").alias("n"))


def running_rmsf(points: DataFrame) -> DataFrame:
    return points.groupBy("atom").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rmsf"), F.count("*").alias("n"))


def windowed_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events in windows of event time; an addition to the batch operators."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def ring_correlation(points: DataFrame, max_lag: int) -> DataFrame:
    """atom, frame, lag, value: displacement products with up to ``max_lag`` earlier frames, the last of which each atom's state holds.

    Rows of an atom must arrive in the order of frames.
    """
    state = "f array<bigint>, x array<double>, y array<double>, z array<double>"

    def step(key, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        ring = list(zip(*held.get, strict=True)) if held.exists else []
        out = []
        for part in parts:
            for r in part.sort_values("frame").itertuples():
                ring = [*ring, (r.frame, r.x, r.y, r.z)][-(max_lag + 1) :]
                for lag, (_, x, y, z) in enumerate(reversed(ring)):
                    out.append((key[0], r.frame, lag, r.x * x + r.y * y + r.z * z))
        held.update(tuple(list(c) for c in zip(*ring, strict=True)) if ring else ([], [], [], []))
        yield pd.DataFrame(out, columns=["atom", "frame", "lag", "value"])

    return points.groupBy("atom").applyInPandasWithState(step, "atom long, frame long, lag long, value double", state, "append", "NoTimeout")
