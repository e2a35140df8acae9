"""Rasters as long tables (k, x, y, dbz): neighbourhood reads, shares, summed areas, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.radar import NO_ECHO, dbz_of, rain_rate


def disc(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(i, j) for i in span for j in span if i * i + j * j <= radius * radius]


def disc_reads(cells: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """Every point with the echo of each disc offset; absent pixels read NO_ECHO."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disc(radius)])).alias("o")
    spread = points.select("k", F.col("x").alias("px"), F.col("y").alias("py"), at).select("k", "px", "py", (F.col("px") + F.col("o.i")).alias("x"), (F.col("py") + F.col("o.j")).alias("y"))
    return spread.join(cells, ["k", "x", "y"], "left").select("k", "px", "py", F.coalesce("dbz", F.lit(NO_ECHO)).alias("dbz"))


def disc_stats(cells: DataFrame, points: DataFrame, radius: int, threshold: float = 20.0) -> DataFrame:
    """Upper median, rain share, maximum, dBZ of the mean rain rate in a disc."""
    n = len(disc(radius))
    g = disc_reads(cells, points, radius).groupBy("k", "px", "py")
    rate = F.avg(rain_rate(F.col("dbz")))
    out = g.agg(F.sort_array(F.collect_list("dbz")).alias("s"), F.avg((F.col("dbz") >= threshold).cast("int")).alias("share"), F.max("dbz").alias("top"), rate.alias("rate"))
    return out.select("k", "px", "py", F.element_at("s", n // 2 + 1).alias("median"), F.round("share", 9).alias("share"), "top", F.round(F.when(F.col("rate") > 0, dbz_of(F.col("rate"))).otherwise(NO_ECHO), 6).alias("mean_dbz"))


def bilinear(cells: DataFrame, points: DataFrame) -> DataFrame:
    """points (k, id, fx, fy) read between pixel centres; pixels outside read NO_ECHO."""
    x0, y0 = F.floor("fx"), F.floor("fy")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("c")
    placed = points.select("k", "id", (F.col("fx") - x0).alias("u"), (F.col("fy") - y0).alias("v"), x0.alias("x0"), y0.alias("y0"), corner)
    w = F.when(F.col("c.i") == 1, F.col("u")).otherwise(1 - F.col("u")) * F.when(F.col("c.j") == 1, F.col("v")).otherwise(1 - F.col("v"))
    corners = placed.select("k", "id", (F.col("x0") + F.col("c.i")).cast("int").alias("x"), (F.col("y0") + F.col("c.j")).cast("int").alias("y"), w.alias("w"))
    met = corners.join(cells, ["k", "x", "y"], "left")
    return met.groupBy("k", "id").agg(F.round(F.sum(F.col("w") * F.coalesce("dbz", F.lit(NO_ECHO))), 6).alias("dbz"))


def rain_fraction(cells: DataFrame, covered: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Share of covered pixels with rain in each frame."""
    met = covered.join(cells, ["k", "x", "y"], "left")
    return met.groupBy("k").agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("dbz") >= threshold).cast("double"), F.count("*").cast("double")), F.lit(0.0)), 9).alias("share"))


def persistence(cells: DataFrame, lead: int = 1) -> DataFrame:
    """Each cell of a frame with the frame `lead` later at the same place."""
    later = cells.select((F.col("k") - lead).alias("k"), "x", "y", F.col("dbz").alias("obs"))
    return cells.join(later, ["k", "x", "y"], "full").select("k", "x", "y", F.coalesce("dbz", F.lit(NO_ECHO)).alias("fc"), F.coalesce("obs", F.lit(NO_ECHO)).alias("obs"))


def block_motion(cells: DataFrame, reach: int = 2, block: int = 4) -> DataFrame:
    """Best displacement of each block of frame k - 1 against frame k by summed products of
    the matching signal, the shortest (then lowest dx, dy) on ties: a shifted equi-join."""
    from pluvia.functions.radar import intensity

    signal = cells.select("k", "x", "y", intensity(F.col("dbz")).alias("s")).where("s > 0")
    span = range(-reach, reach + 1)
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in span for j in span])).alias("m")
    was = signal.select("*", moves).select((F.col("k") + 1).alias("k"), F.floor(F.col("x") / block).cast("int").alias("bx"), F.floor(F.col("y") / block).cast("int").alias("by"), F.col("s").alias("a"), (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), F.col("m.dx").alias("dx"), F.col("m.dy").alias("dy"))
    score = was.join(signal, ["k", "x", "y"]).groupBy("k", "bx", "by", "dx", "dy").agg(F.sum(F.col("a") * F.col("s")).alias("score"))
    rank = F.struct(-F.col("score"), F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), "dx", "dy")
    return score.groupBy("k", "bx", "by").agg(F.min_by(F.struct("dx", "dy", "score"), rank).alias("best")).select("k", "bx", "by", "best.dx", "best.dy", "best.score")
