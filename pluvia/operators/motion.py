"""Frames as arrays, one row each, and the kernels over them and their pairs.

A frame is bounded by its region's size, so it fits a row; Spark shuffles frames by region and time
and every pair is worked out by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators import kernels


def frames(cells: DataFrame, width: int, height: int) -> DataFrame:
    """(k, w, h, dbz): cells (k, x, y, dbz) of each frame as one array of 32-bit floats, row by row;
    absent cells have no echo, cells outside are left out."""

    def stitched(f: pd.DataFrame) -> pd.DataFrame:
        g = np.full((height, width), kernels.NO_ECHO, "<f4")
        f = f[(f["x"] >= 0) & (f["x"] < width) & (f["y"] >= 0) & (f["y"] < height)]
        g[f["y"], f["x"]] = f["dbz"]
        return pd.DataFrame({"k": [f["k"].iloc[0] if len(f) else None], "w": [width], "h": [height], "dbz": [g.tobytes()]})

    return cells.groupBy("k").applyInPandas(stitched, "k long, w int, h int, dbz binary")


def grid(row) -> np.ndarray:
    return np.frombuffer(row.dbz, "<f4").reshape(row.h, row.w).astype(np.float64)


def pairs(stitched: DataFrame) -> DataFrame:
    """(k, w, h, dbz, was) of each frame with the one just before it."""
    return stitched.join(stitched.select((F.col("k") + 1).alias("k"), F.col("dbz").alias("was")), "k")


#: Points whose forecasts leave a task together.
POINTS = 8192


def per_pair(paired: DataFrame, kernel: Callable[[int, np.ndarray, np.ndarray], pd.DataFrame | Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """kernel(k, previous, current) of every pair, whole or in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for row in f.itertuples(index=False):
                was = np.frombuffer(row.was, "<f4").reshape(row.h, row.w).astype(np.float64)
                found = kernel(row.k, was, grid(row))
                yield from [found] if isinstance(found, pd.DataFrame) else found

    return paired.mapInPandas(run, schema)


FIELD = "k long, bx int, by int, dx double, dy double, valid boolean"


def field_rows(k: int, v: np.ndarray, valid: np.ndarray) -> pd.DataFrame:
    by, bx = np.indices(valid.shape)
    return pd.DataFrame({"k": k, "bx": bx.ravel(), "by": by.ravel(), "dx": v[..., 0].ravel(), "dy": v[..., 1].ravel(), "valid": valid.ravel()})


def measured(method: str, size: int, search: int, minutes: float = 10.0) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The field measured by a method, pixels a minute: block matching, Horn-Schunck or Lucas-Kanade."""

    def by(prev: np.ndarray, cur: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if method == "TREC":
            v, valid = kernels.match_blocks(prev, cur, size, search)
            return v / minutes, valid
        if method == "HS":
            return kernels.flow_field(kernels.horn_schunck(prev, cur), prev, cur, None, size, minutes)
        flow, solved = kernels.lucas_kanade(prev, cur)
        return kernels.flow_field(flow, prev, cur, solved, size, minutes)

    return by


def motion(paired: DataFrame, method: str = "TREC", size: int = 32, search: int = 16, minutes: float = 10.0, filled: bool = True) -> DataFrame:
    """(k, bx, by, dx, dy, valid) of every block of every pair; filled: smoothed and without gaps."""
    by = measured(method, size, search, minutes)

    def kernel(k: int, prev: np.ndarray, cur: np.ndarray) -> pd.DataFrame:
        v, valid = by(prev, cur)
        return field_rows(k, kernels.finish(v, valid) if filled else v, valid)

    return per_pair(paired, kernel, FIELD)


def weighted(fields: DataFrame, pairs_: int) -> DataFrame:
    """Mean of each frame's field with those of the frames before, newest heaviest, over the blocks
    that each measured: joins by frame, sums by block."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(pairs_ - i)).alias("w")) for i in range(pairs_)])).alias("s")
    spread = fields.where("valid").select("*", steps).select((F.col("k") + F.col("s.i")).alias("k"), "bx", "by", F.col("s.w").alias("w"), "dx", "dy")
    now = fields.select("k", "bx", "by")
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    met = now.join(spread.groupBy("k", "bx", "by").agg(mean("dx"), mean("dy")), ["k", "bx", "by"], "left")
    return met.select("k", "bx", "by", F.coalesce("dx", F.lit(0.0)).alias("dx"), F.coalesce("dy", F.lit(0.0)).alias("dy"), F.col("dx").isNotNull().alias("valid"))


def forecast(paired: DataFrame, points: list[tuple[int, int]] | None, horizon: int, method: str = "TREC", size: int = 32, search: int = 16, minutes: float = 10.0, trend: bool = True, at: tuple[int, ...] | None = None) -> DataFrame:
    """(k, x, y, minute, dbz, prob) of the points (None: all pixels) of every frame that has one before it, at the minutes
    given or at all. A frame's points are followed and given so many at a time."""
    by = measured(method, size, search, minutes)

    def kernel(k: int, prev: np.ndarray, cur: np.ndarray) -> Iterator[pd.DataFrame]:
        v, valid = by(prev, cur)
        v = kernels.finish(v, valid)
        rates = kernels.trend(prev, cur, v, size, minutes, 15.0) if trend else None
        asked = None if points is None else np.array(points, int).reshape(-1, 2)
        for start in range(0, cur.size if asked is None else len(asked), POINTS):
            n = np.arange(start, min(start + POINTS, cur.size))
            xs, ys = (n % cur.shape[1], n // cur.shape[1]) if asked is None else asked[start : start + POINTS].T
            dbz, prob = kernels.trajectories(cur, v, size, xs.astype(float), ys.astype(float), horizon, rates, minutes=at)
            which, minute = np.indices(dbz.shape)
            minute = minute if at is None else np.array(at)[minute]
            yield pd.DataFrame({"k": k, "x": xs[which.ravel()], "y": ys[which.ravel()], "minute": minute.ravel(), "dbz": dbz.ravel(), "prob": prob.ravel()})

    return per_pair(paired, kernel, "k long, x int, y int, minute int, dbz double, prob double")


def trends(paired: DataFrame, size: int, search: int, minutes: float = 10.0, rain: float = 15.0, r: int = 3) -> DataFrame:
    """(k, bx, by, rate, gain) of every block: its trend, and how well the motion explains the change
    around its middle (NULL where that can't be told)."""
    by = measured("TREC", size, search, minutes)

    def kernel(k: int, prev: np.ndarray, cur: np.ndarray) -> pd.DataFrame:
        v, valid = by(prev, cur)
        v = kernels.finish(v, valid)
        rates = kernels.trend(prev, cur, v, size, minutes, rain)
        j, i = (a.ravel() for a in np.indices(valid.shape))
        gains = kernels.translation_gains(prev, cur, v.reshape(-1, 2), minutes, (i + 0.5) * size - 0.5, (j + 0.5) * size - 0.5, r)
        return pd.DataFrame({"k": k, "bx": i, "by": j, "rate": rates.ravel(), "gain": pd.Series(gains).astype("Float64")})

    return per_pair(paired, kernel, "k long, bx int, by int, rate double, gain double")


def tracked(paired: DataFrame, threshold: float, least: int, gate: float) -> DataFrame:
    """(k, a, b, cost): one-to-one matches of the rain cells of a frame before (a) and now (b), each
    named by its first pixel; cells far from all others stay alone. Cells meet only those within the gate."""
    alone = 1.51  # just above any allowed pair

    def cells(g: np.ndarray) -> pd.DataFrame:
        lab = kernels.labels(g, threshold)
        y, x = np.nonzero(lab >= 0)
        f = pd.DataFrame({"cell": lab[y, x], "x": x, "y": y, "v": g[y, x]})
        f["w"] = f["v"] - threshold + 1
        f["wx"], f["wy"] = f["w"] * f["x"], f["w"] * f["y"]
        c = f.groupby("cell").agg(area=("x", "size"), x0=("x", "min"), x1=("x", "max"), y0=("y", "min"), y1=("y", "max"), w=("w", "sum"), wx=("wx", "sum"), wy=("wy", "sum"))
        return c[c["area"] >= least].reset_index()

    def kernel(k: int, prev: np.ndarray, cur: np.ndarray) -> pd.DataFrame:
        p, c = cells(prev), cells(cur)
        n, m = len(p), len(c)
        if not n or not m:
            return pd.DataFrame({"k": [], "a": [], "b": [], "cost": []})
        far = lambda q: (q[["wx", "wy"]].to_numpy() / q[["w"]].to_numpy())
        at, to = far(p), far(c)
        i, j = kernels.near_pairs(at, to, gate)
        d = np.linalg.norm(at[i] - to[j], axis=1)
        inside = d <= gate
        i, j, d = i[inside], j[inside], d[inside]
        lo = np.maximum(p[["x0", "y0"]].to_numpy()[i], c[["x0", "y0"]].to_numpy()[j])
        hi = np.minimum(p[["x1", "y1"]].to_numpy()[i], c[["x1", "y1"]].to_numpy()[j]) + 1
        inter = np.maximum(hi - lo, 0).prod(1)
        box = lambda q: ((q["x1"] - q["x0"] + 1) * (q["y1"] - q["y0"] + 1)).to_numpy()
        cost = d / gate + 0.5 * (1 - inter / (box(p)[i] + box(c)[j] - inter))
        best = kernels.sparse_assignment(n, m, i, j, cost, 2 * alone)
        rows = [(k, p["cell"][i[e]], c["cell"][j[e]], cost[e]) for e in best if e >= 0]
        return pd.DataFrame(rows, columns=["k", "a", "b", "cost"])

    return per_pair(paired, kernel, "k long, a int, b int, cost double")
