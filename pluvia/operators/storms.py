"""Storms: the rain cells of frames, linked along the motion between them, and their lives over whole histories."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators import histories, kernels
from pluvia.operators.histories import Frames, Motion
from pluvia.session import shared_dir

#: dBZ and pixels that outline a cell; share of the smaller cell that a link must cover.
THRESHOLD, LEAST, OVERLAP = 30.0, 16, 0.3


@dataclass(frozen=True)
class Cells:
    """The cells of a frame in the order of their first pixels; number: the cell of each pixel, -1 for none."""

    number: np.ndarray
    area: np.ndarray
    mean: np.ndarray
    peak: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def __len__(self) -> int:
        return len(self.area)


def segments(g: np.ndarray, threshold: float = THRESHOLD, least: int = LEAST) -> Cells:
    """Areas at or above the threshold of so many pixels; centres are weighted by the excess over it."""
    label = kernels.labels(g, threshold).ravel()
    names, which, sizes = np.unique(label[label >= 0], return_inverse=True, return_counts=True)
    kept = np.flatnonzero(sizes >= least)
    new = np.full(len(names), -1)
    new[kept] = np.arange(len(kept))
    number = np.full(g.size, -1)
    number[label >= 0] = new[which]
    at = np.flatnonzero(number >= 0)
    n, v, own = len(kept), g.ravel()[at], number[at]
    summed = lambda w: np.bincount(own, w, n)
    weight = v - threshold + 1
    peak = np.full(n, kernels.NO_ECHO)
    np.maximum.at(peak, own, v)
    area, total = np.bincount(own, minlength=n), np.maximum(summed(weight), 1e-9)
    return Cells(number.reshape(g.shape), area, summed(v) / np.maximum(area, 1), peak, summed(weight * (at % g.shape[1])) / total, summed(weight * (at // g.shape[1])) / total)


def cells_of(held: Frames, t: int, threshold: float, least: int) -> Cells:
    """The cells of a frame held, worked out once although it is the later frame of one pair and the earlier of another."""
    key = ("cells", t, threshold, least)
    if key not in held.kept:
        held.kept[key] = segments(held.grids[t], threshold, least)
    return held.kept[key]


def links(prev: Cells, cur: Cells, v: np.ndarray, size: int, minutes: float) -> np.ndarray:
    """(earlier cell, later cell) rows: cells whose pixels, moved along the field, cover enough of the other."""
    h, w = prev.number.shape
    y, x = np.nonzero(prev.number >= 0)
    if not len(x) or not len(cur):
        return np.empty((0, 2), int)
    move = kernels.field_at(v, size, x.astype(float), y.astype(float)) * minutes
    near = lambda a: np.copysign(np.floor(np.abs(a) + 0.5), a).astype(int)  # noqa: E731  halves away from zero
    to_x, to_y = near(x + move[:, 0]), near(y + move[:, 1])
    inside = (to_x >= 0) & (to_y >= 0) & (to_x < w) & (to_y < h)
    a, b = prev.number[y[inside], x[inside]], cur.number[to_y[inside], to_x[inside]]
    both = np.bincount(a[b >= 0] * len(cur) + b[b >= 0], minlength=len(prev) * len(cur)).reshape(len(prev), len(cur))
    return np.argwhere((both > 0) & (both >= OVERLAP * np.minimum(prev.area[:, None], cur.area[None])))


def parents(prev: Cells, found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of n later cells: its main ancestor (the largest, the first of equals; -1: none), how many there are, and
    whether the main one feeds others too."""
    main, count = np.full(n, -1), np.zeros(n, int)
    children = np.bincount(found[:, 0], minlength=max(1, len(prev))) if len(found) else np.zeros(max(1, len(prev)), int)
    for a, b in found:
        count[b] += 1
        if main[b] < 0 or prev.area[a] > prev.area[main[b]]:
            main[b] = a
    return main, count, (main >= 0) & (children[np.maximum(main, 0)] >= 2)


def slope(x: np.ndarray, y: np.ndarray) -> float:
    d = len(x) * (x * x).sum() - x.sum() ** 2
    return 0.0 if d == 0 else float((len(x) * (x * y).sum() - x.sum() * y.sum()) / d)


@dataclass(frozen=True)
class Storm:
    x: float
    y: float
    peak: float
    area: int
    age: int
    rate: float
    rate_area: float
    new: bool
    merged: bool
    split: bool

    @property
    def decaying(self) -> bool:
        return self.rate < 0 and self.rate_area < 0


def recent(held: Frames, t: int, field: np.ndarray, size: int, pairs: int, threshold: float = THRESHOLD, least: int = LEAST) -> list[Storm]:
    """The storms of frame t with their lives over the frames before it, back to the first gap, all moved along one field."""
    times = held.chain(t, pairs)
    if len(times) < 2:
        return []
    found = [cells_of(held, u, threshold, least) for u in times]  # newest first
    minutes = (times[0] - times[1]) / 60
    up = [parents(found[k + 1], links(found[k + 1], found[k], field, size, minutes), len(found[k])) for k in range(len(times) - 1)]
    out = []
    for j in range(len(found[0])):
        line, at = [(0.0, found[0].mean[j], found[0].area[j])], j
        for k in range(len(times) - 1):
            at = up[k][0][at]
            if at < 0:
                break
            line.append((-(k + 1) * minutes, found[k + 1].mean[at], found[k + 1].area[at]))
        when, mean, area = np.array(line).T
        main, count, split = up[0]
        c = found[0]
        out.append(Storm(float(c.x[j]), float(c.y[j]), float(c.peak[j]), int(c.area[j]), len(line), slope(when, mean), slope(when, area), count[j] == 0, count[j] >= 2, bool(split[j])))
    return out


_CELL = "t long, cell int, area int, mean double, peak double, x double, y double, from_t long, main int, parents int, split boolean"


def linked(frames: DataFrame, motion: Motion, method: str = "TREC", threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(region, t, cell, area, mean, peak, x, y, from_t, main, parents, split): every cell of every frame with its main
    ancestor in the frame before, along the field of that pair of frames; NULL across gaps and for new cells."""

    def visit(held: Frames, region: object, t: int, span: int) -> Iterable[tuple]:
        cur, p = cells_of(held, t, threshold, least), held.previous(t)
        main, count, split = np.full(len(cur), -1), np.zeros(len(cur), int), np.zeros(len(cur), bool)
        if p is not None:
            prev, (v, _) = cells_of(held, p, threshold, least), held.pair(method, t)
            main, count, split = parents(prev, links(prev, cur, v, held.size(method), (t - p) / 60), len(cur))
        for j in range(len(cur)):
            up = main[j] >= 0
            yield region, t, j, int(cur.area[j]), float(cur.mean[j]), float(cur.peak[j]), float(cur.x[j]), float(cur.y[j]), p if up else None, int(main[j]) if up else None, int(count[j]), bool(split[j])

    kind = frames.schema["region"].dataType.simpleString()
    columns = ["region", *[c.split()[0] for c in _CELL.split(", ")]]
    return histories.walked(frames, motion, visit, f"region {kind}, {_CELL}", columns, back=motion.gap)


def lives(cells: DataFrame) -> DataFrame:
    """(region, t, cell, age, rate_dbz, rate_area, is_new, merged, split, decaying): the whole life of each cell along its
    main ancestors, however long, by pointer doubling.

    Each cell holds the sums of a piece of its line and where the piece goes on; a join of the table with itself by that
    pointer doubles the pieces, so the number of joins is the logarithm of the longest life. Each round is
    written to the shared folder, which ends its lineage.
    """
    spark = cells.sparkSession
    folder = f"{shared_dir(spark)}/lives-{uuid.uuid4().hex}"

    def written(df: DataFrame, n: int) -> DataFrame:
        df.write.parquet(f"{folder}/{n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{n}")

    base = written(cells, 0)
    # Times are minutes before the cell's own: n, sums of time, time squared, mean echo, area, and their products.
    sums = ["n", "x", "xx", "z", "a", "xz", "xa"]
    zero, mean, area = F.lit(0.0), F.col("mean"), F.col("area").cast("double")
    start = dict(zip(sums, (F.lit(1.0), zero, zero, mean, area, zero, zero), strict=True))
    line = base.select("region", "t", "cell", *[c.alias(k) for k, c in start.items()], F.col("from_t").alias("next_t"), F.col("main").alias("next_cell"))
    number = 0
    while True:
        number += 1
        line = written(line, number)
        if line.where("next_t IS NOT NULL").isEmpty():
            break
        on = line.select("region", F.col("t").alias("next_t"), F.col("cell").alias("next_cell"), *[F.col(k).alias(f"o_{k}") for k in sums], F.col("next_t").alias("on_t"), F.col("next_cell").alias("on_cell"))
        d = (F.col("next_t") - F.col("t")) / 60
        o = {k: F.coalesce(F.col(f"o_{k}"), F.lit(0.0)) for k in sums}
        d = F.coalesce(d, F.lit(0.0))
        more = {
            "n": o["n"], "x": o["x"] + d * o["n"], "xx": o["xx"] + 2 * d * o["x"] + d * d * o["n"], "z": o["z"], "a": o["a"], "xz": o["xz"] + d * o["z"], "xa": o["xa"] + d * o["a"],
        }
        met = line.join(on, ["region", "next_t", "next_cell"], "left")
        line = met.select("region", "t", "cell", *[(F.col(k) + more[k]).alias(k) for k in sums], F.col("on_t").alias("next_t"), F.col("on_cell").alias("next_cell"))
    spread = F.col("n") * F.col("xx") - F.col("x") * F.col("x")
    rate = lambda y: F.when(spread != 0, (F.col("n") * F.col(f"x{y}") - F.col("x") * F.col(y)) / spread).otherwise(0.0)
    rates = line.select("region", "t", "cell", F.col("n").cast("int").alias("age"), F.round(rate("z"), 9).alias("rate_dbz"), F.round(rate("a"), 9).alias("rate_area"))
    own = base.select("region", "t", "cell", (F.col("parents") == 0).alias("is_new"), (F.col("parents") >= 2).alias("merged"), "split")
    return rates.join(own, ["region", "t", "cell"]).withColumn("decaying", (F.col("rate_dbz") < 0) & (F.col("rate_area") < 0))
