"""Forecasts of any number of points: each meets the newest frames of its region, and a region with very many points
meets them in several tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.operators import histories, kernels
from pluvia.operators.histories import Frames, Motion
from pluvia.operators.issues import rain_rate

#: Points that one task forecasts together, at least allowed; regions with more are split. Regions that are split, at most.
TOGETHER, MOST_SPLIT = 20_000, 100_000
#: Pixels around a point over which its motion is checked.
GAIN_RADIUS = 24


@dataclass(frozen=True)
class Model:
    """Methods whose forecasts are averaged, with weights; horizon and thresholds of the application."""

    methods: tuple[str, ...] = ("TREC", "HS", "LK")
    weights: tuple[float, ...] = (1.0, 1.0, 1.0)
    trend: bool = True
    horizon: int = 60
    threshold: float = 20.0
    heavy: float = 40.0
    radius: int = 2
    strong: float = 30.0
    tau: float = 20.0
    km_per_pixel: float = 1.2


def forecast_points(held: Frames, t: int, x: np.ndarray, y: np.ndarray, model: Model) -> pd.DataFrame | None:
    """The model's forecast of points from frame t; None if no method sees motion. Trends count only if every method
    has one."""
    found = [(m, w, held.field(m, t)) for m, w in zip(model.methods, model.weights, strict=True)]
    found = [(m, w, f) for m, w, f in found if f is not None]
    total = sum(w for _, w, _ in found)
    if not found or total <= 0:
        return None
    g = held.grids[t]
    rates = [held.trend(m, t, model.threshold - 5) for m, _, _ in found] if model.trend else [None]
    rates = rates if all(r is not None for r in rates) else [None] * len(found)
    dbz, prob = np.zeros((len(x), model.horizon + 1)), np.zeros((len(x), model.horizon + 1))
    v, speed, reliable = np.zeros((len(x), 2)), np.zeros(len(x)), False
    for (m, w, (field, valid)), r in zip(found, rates, strict=True):
        one, share = kernels.trajectories(g, field, held.size(m), x, y, model.horizon, r, model.radius, model.strong, model.threshold, model.tau)
        here = kernels.field_at(field, held.size(m), x, y)
        dbz, prob, v, speed, reliable = dbz + w / total * one, prob + w / total * share, v + w / total * here, speed + w / total * np.hypot(*here.T), reliable or bool(valid.any())
    p = held.previous(t)
    gains = kernels.translation_gains(held.grids[p], g, v, (t - p) / 60, x, y, GAIN_RADIUS)
    first = lambda level: np.where((dbz >= level).any(1), (dbz >= level).argmax(1), -1)
    return pd.DataFrame({
        "dbz": list(dbz), "prob": list(prob), "arrival": first(model.threshold), "heavy_arrival": first(model.heavy), "mm": (rain_rate(dbz) / 60).sum(1),
        "kmh": np.hypot(*v.T) * model.km_per_pixel * 60, "heading": (np.degrees(np.arctan2(v[:, 0], -v[:, 1])) + 360) % 360,
        "coherence": np.where(speed > 0, np.hypot(*v.T) / np.maximum(speed, 1e-300), 0.0), "gain": pd.Series(gains).astype("Float64"), "reliable": reliable, "trended": rates[0] is not None,
    })


_SCHEMA = "t long, x double, y double, dbz array<double>, prob array<double>, arrival int, heavy_arrival int, mm double, kmh double, heading double, coherence double, gain double, reliable boolean, trended boolean"


def forecast(points: DataFrame, frames: DataFrame, model: Model = Model(), motion: Motion = Motion()) -> DataFrame:
    """points (id, region, x, y) with the forecast from the newest frame of their region: t, dbz and prob by minute,
    arrival of rain and heavy rain (-1: none), mm, kmh, heading, coherence, gain, reliable, trended. Points of
    regions without two frames close enough have NULLs, as have null regions and places.

    frames: region, t, w, h, at, dbz. Of each region only the newest frames go on, at most as many as the motion needs.
    """
    # Frames are met once, and of a region only the newest of each task are shuffled: what is compared with a rank is cut there.
    few = frames.where("region IS NOT NULL").select("region", "t", "w", "h", "at", "dbz").withColumn("_n", F.row_number().over(W.partitionBy("region").orderBy(F.desc("t")))).where(F.col("_n") <= motion.pairs + 1)
    newest = few.withColumn("_last", F.max("t").over(W.partitionBy("region"))).where(F.col("t") >= F.col("_last") - motion.pairs * motion.gap).drop("_n", "_last")
    known = F.col("region").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    asked = points.select("id", "region", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n = asked.agg(F.count("*").alias("n"))
    counts = asked.where(known).groupBy("region").agg(F.count("*").alias("c"))
    # Fewer than MOST_SPLIT regions can each hold more than 1 / MOST_SPLIT of the points.
    share = F.greatest(F.lit(TOGETHER), F.ceil(F.col("n") / MOST_SPLIT))
    split = F.broadcast(counts.crossJoin(F.broadcast(n)).where(F.col("c") > share).select("region", F.ceil(F.col("c") / share).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = asked.where(known).join(split, "region", "left").withColumn("part", F.pmod(F.xxhash64("id", "x", "y"), parts.cast("long")).cast("int")).drop("parts")
    shown = newest.join(split, "region", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("id", "region")}
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        held = Frames(motion)
        for r in f.sort_values("t").itertuples(index=False):
            held.put(int(r.t), histories.grid(r.w, r.h, np.asarray(r.at, int), np.asarray(r.dbz, float)))
        t = max(held.grids, default=None)
        got = None if t is None or not len(p) else forecast_points(held, t, p["x"].to_numpy(), p["y"].to_numpy(), model)
        out = p[["id", "region", "x", "y"]].reset_index(drop=True)
        if got is None:
            return out.assign(**{c: pd.Series([None] * len(out), dtype=object) for c in columns if c not in out})[["id", "region", *columns]]
        return pd.concat([out, got], axis=1).assign(t=t)[["id", "region", *columns]]

    schema = f"id {kinds['id']}, region {kinds['region']}, {_SCHEMA}"
    # A number of its own keeps the tasks apart: points are few bytes but much work, and would be joined by their bytes.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, shown = (df.repartition(tasks, "region", "part") for df in (dealt, shown))
    met = dealt.groupBy("region", "part").cogroup(shown.groupBy("region", "part")).applyInPandas(run, schema)
    rest = asked.where(~known).select("id", "region", "x", "y")
    return met.unionByName(rest, allowMissingColumns=True)
