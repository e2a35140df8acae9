"""Minute-by-minute extrapolation of points and what is read off the series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions import radar
from pluvia.operators import raster


def upstream(points: DataFrame, horizon: int, step: int = 1) -> DataFrame:
    """points (k, id, x, y, dx, dy; pixels a minute) -> (k, id, minute, fx, fy): the place
    from which the echo over the point in so many minutes comes. One row makes horizon / step + 1."""
    m = F.explode(F.sequence(F.lit(0), F.lit(horizon), F.lit(step))).alias("minute")
    rows = points.select("k", "id", "x", "y", "dx", "dy", m)
    return rows.select("k", "id", "minute", (F.col("x") - F.col("minute") * F.col("dx")).alias("fx"), (F.col("y") - F.col("minute") * F.col("dy")).alias("fy"))


def advected(cells: DataFrame, points: DataFrame, horizon: int, step: int = 1) -> DataFrame:
    """(k, id, minute, dbz) by bilinear reads at the upstream places; no echo reads as -32."""
    asked = upstream(points, horizon, step).withColumn("id", F.struct("id", "minute"))
    return raster.bilinear(cells, asked).select("k", F.col("id.id").alias("id"), F.col("id.minute").alias("minute"), "dbz")


def summary(series: DataFrame, keys: list[str], threshold: float = 20.0, heavy: float = 40.0) -> DataFrame:
    """First minutes at or above the two strengths (-1: none) and the rain after minute 0 in mm.

    One pre-aggregated pass; a null echo counts as none.
    """
    first = lambda level: F.coalesce(F.min(F.when(F.col("dbz") >= level, F.col("minute"))), F.lit(-1))
    mm = F.sum(F.when(F.col("minute") > 0, radar.rain_rate(F.col("dbz")) / 60))
    out = series.groupBy(*keys).agg(first(threshold).alias("arrival"), first(heavy).alias("heavy_arrival"), F.coalesce(mm, F.lit(0.0)).alias("accum_mm"), F.max("dbz").alias("peak"))
    return out.withColumn("raining_now", F.col("arrival") == 0)


def move_into_band(e: Column, probabilities: list[Column], cuts: list[Column | float], strengths: list[float]) -> Column:
    """e moved into the band of the strongest class whose probability reaches its cut."""
    below = 0.01
    out = F.least(e, F.lit(strengths[0] - below))
    for i, (p, cut, low) in enumerate(zip(probabilities, cuts, strengths, strict=True)):
        inside = F.greatest(e, F.lit(low))
        if i + 1 < len(strengths):
            inside = F.when(e >= strengths[i + 1], F.lit(strengths[i + 1] - below)).otherwise(inside)
        out = F.when(p >= cut, inside).otherwise(out)
    return out


def capped(probabilities: list[Column]) -> list[Column]:
    """Class probabilities that never rise with strength."""
    return [probabilities[0], *(F.least(*probabilities[: i + 1]) for i in range(1, len(probabilities)))]


def on_knots(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through the knots, flat beyond them; knots are few and fixed."""
    if not xs:
        return x
    out = F.lit(ys[-1])
    for i in range(len(xs) - 1, 0, -1):
        span = xs[i] - xs[i - 1]
        line = F.lit(ys[i]) if span == 0 else F.lit(ys[i - 1]) + (x - xs[i - 1]) / span * (ys[i] - ys[i - 1])
        out = F.when(x <= xs[i], line).otherwise(out)
    return F.when(x <= xs[0], F.lit(ys[0])).otherwise(out)
