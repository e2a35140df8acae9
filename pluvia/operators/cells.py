"""Rain cells: connected areas of a frame, and their links from frame to frame."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _labels(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first pixel (in the order given) of the 4-connected area of each pixel.

    Labels sink to the least of the neighbours', then to their own label's, until none moves.
    """
    at = {p: i for i, p in enumerate(zip(x.tolist(), y.tolist(), strict=True))}
    pairs = [(i, at[q]) for (a, b), i in at.items() for q in ((a + 1, b), (a, b + 1)) if q in at]
    label = np.arange(len(x))
    if not pairs:
        return label
    i, j = np.array(pairs).T
    while True:
        low, before = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def labelled(cells: DataFrame, threshold: float = 30.0) -> DataFrame:
    """(k, x, y, dbz, cell) of the pixels at or above the threshold; cell numbers the areas of
    a frame by their first pixel. A group is one frame, whose pixels are bounded by its size."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x"], ignore_index=True)
        _, number = np.unique(_labels(frame["x"].to_numpy(), frame["y"].to_numpy()), return_inverse=True)
        return frame.assign(cell=number.astype(np.int32))

    strong = cells.where(F.col("dbz") >= threshold).select("k", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "dbz")
    return strong.groupBy("k").applyInPandas(run, "k long, x long, y long, dbz double, cell int")


def segments(pixels: DataFrame, threshold: float = 30.0, least: int = 1) -> DataFrame:
    """Area, peak, box and weighted centre (weight: dbz - threshold + 1) of each labelled area."""
    w = F.col("dbz") - threshold + 1
    centre = lambda c: (F.sum(w * F.col(c)) / F.sum(w)).alias(f"c{c}")
    box = [f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))]
    return pixels.groupBy("k", "cell").agg(F.count("*").alias("area"), F.max("dbz").alias("peak"), centre("x"), centre("y"), *box).where(F.col("area") >= least)


def square(c: Column) -> Column:
    return c * c


def half_up(c: Column, digits: int) -> Column:
    """A value of 0 or more rounded as a binary number, by its product with a power of ten; round() takes its shortest decimal
    text, which may stand on the other side of a half."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def near(cells: DataFrame, others: DataFrame, gate: float) -> DataFrame:
    """cells (k, cx, cy) with those of others (k, a_cx, a_cy) whose centres may lie within the gate: an equi-join on frame and
    squares a little wider than the gate, each with those around it, so a pair meets once and far cells never."""
    at = lambda c: F.floor(F.col(c) / (gate + 1)).cast("int")
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_o")
    spread = others.select("*", step).withColumns({"_x": at("a_cx") + F.col("_o.i"), "_y": at("a_cy") + F.col("_o.j")}).drop("_o")
    return cells.withColumns({"_x": at("cx"), "_y": at("cy")}).join(spread, ["k", "_x", "_y"]).drop("_x", "_y")


def overlap_links(pixels: DataFrame, dx: int = 0, dy: int = 0, share: float = 0.3) -> DataFrame:
    """(k, a, b, both): areas a of frame k - 1, moved by (dx, dy), and b of frame k that share at
    least so much of the smaller one. An equi-join on moved pixels, then counts."""
    size = pixels.groupBy("k", "cell").agg(F.count("*").alias("area"))
    moved = pixels.select((F.col("k") + 1).alias("k"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("cell").alias("a"))
    met = moved.join(pixels.select("k", "x", "y", F.col("cell").alias("b")), ["k", "x", "y"]).groupBy("k", "a", "b").agg(F.count("*").alias("both"))
    was = size.select((F.col("k") + 1).alias("k"), F.col("cell").alias("a"), F.col("area").alias("area_a"))
    now = size.select("k", F.col("cell").alias("b"), F.col("area").alias("area_b"))
    linked = met.join(was, ["k", "a"]).join(now, ["k", "b"])
    return linked.where(F.col("both") >= share * F.least("area_a", "area_b")).select("k", "a", "b", "both")


def lifecycle(pixels: DataFrame, back: int, minutes: float) -> DataFrame:
    """(k, cell, age, rate_dbz, rate_area, is_new, merged, split, decaying) of each cell.

    A cell's history runs through its main ancestors, the largest of the cells that flow into it
    (the lower number on ties), `back` frames at most; slopes are least squares over it, 0 for a new
    cell. Each step back is one join by frame and cell.
    """
    size = pixels.groupBy("k", "cell").agg(F.count("*").alias("area"), F.avg("dbz").alias("mean"))
    links = overlap_links(pixels).select("k", "a", "b").join(size.select((F.col("k") + 1).alias("k"), F.col("cell").alias("a"), "area"), ["k", "a"])
    parents = links.groupBy("k", "b").agg(F.count("*").alias("parents"), F.max_by("a", F.struct("area", -F.col("a"))).alias("main"))
    children = links.groupBy("k", "a").agg(F.count("*").alias("children"))
    history = step = size.select("k", "cell", F.lit(0).alias("back"), F.col("cell").alias("at"), "mean", "area")
    for i in range(back):
        up = parents.select(F.col("k").alias("pk"), F.col("b").alias("pb"), "main")
        older = size.select(F.col("k").alias("ok"), F.col("cell").alias("oc"), F.col("mean").alias("om"), F.col("area").alias("oa"))
        met = step.join(up, (F.col("pk") == F.col("k") - i) & (F.col("pb") == F.col("at"))).join(older, (F.col("ok") == F.col("k") - i - 1) & (F.col("oc") == F.col("main")))
        step = met.select("k", "cell", F.lit(i + 1).alias("back"), F.col("main").alias("at"), F.col("om").alias("mean"), F.col("oa").alias("area"))
        history = history.unionByName(step)
    x = F.col("back") * -minutes
    slope = lambda c: F.round(F.coalesce(F.regr_slope(F.col(c), x), F.lit(0.0)), 6)
    lives = history.groupBy("k", "cell").agg(F.count("*").cast("int").alias("age"), slope("mean").alias("rate_dbz"), slope("area").alias("rate_area"))
    of = lives.join(parents.withColumnRenamed("b", "cell"), ["k", "cell"], "left").join(children.withColumnRenamed("a", "main"), ["k", "main"], "left")
    n = F.coalesce("parents", F.lit(0))
    return of.select(
        "k", "cell", "age", "rate_dbz", "rate_area", (n == 0).alias("is_new"), (n >= 2).alias("merged"), (F.coalesce("children", F.lit(0)) >= 2).alias("split"), ((F.col("rate_dbz") < 0) & (F.col("rate_area") < 0)).alias("decaying")
    )
