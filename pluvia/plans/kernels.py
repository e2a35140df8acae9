"""Queries of the frame kernels on the lattice (blocks of 4, shifts up to 2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.operators import cells, kernels, motion, raster
from pluvia.plans.nowcasts import _AREAS
from pluvia.plans.registry import _L, query
from pluvia.sources import driver_tables as src

SIZE, SEARCH = 4, 2


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    lattice = src.lattice(spark, d)
    return motion.pairs(motion.frames(lattice, 12, 1 + (lattice.agg(F.max("y")).first()[0] or 0)))


_NCC = f"""{_L}, hh AS (SELECT max(y) // 4 + (CASE WHEN max(y) % 4 = 3 THEN 1 ELSE 0 END) AS bh FROM l), fr AS (SELECT a.k FROM (SELECT DISTINCT k FROM l) AS a JOIN (SELECT DISTINCT k FROM l) AS b ON b.k = a.k - 1),
px AS (SELECT fr.k, bx::INT AS bx, by_::INT AS by_, bx * 4 + i AS x, by_ * 4 + j AS y FROM fr, range(3) AS a(bx), range((SELECT bh FROM hh)) AS b(by_), range(4) AS c(i), range(4) AS e(j)),
sg AS (SELECT k, x, y, dbz, CASE WHEN dbz < 10 THEN 0 ELSE least(dbz, 65) - 10 END AS s FROM l),
t AS (SELECT px.*, coalesce(dbz, -32) AS dbz, coalesce(s, 0) AS s FROM px LEFT JOIN sg ON sg.k = px.k AND sg.x = px.x AND sg.y = px.y),
m AS (SELECT t.k, bx, by_, di::INT AS di, dj::INT AS dj, count(*) FILTER (WHERE t.dbz >= 15) AS rainy, sum(t.s) AS ts, sum(t.s * t.s) AS tt, sum(coalesce(p.s, 0)) AS ws, sum(coalesce(p.s, 0) * coalesce(p.s, 0)) AS ww, sum(t.s * coalesce(p.s, 0)) AS tw
FROM t CROSS JOIN range(-2, 3) AS a(di) CROSS JOIN range(-2, 3) AS b(dj) LEFT JOIN sg AS p ON p.k = t.k - 1 AND p.x = t.x - di AND p.y = t.y - dj GROUP BY ALL),
c AS (SELECT *, CASE WHEN 16 * ww - ws * ws > 1e-9 * 256 AND 16 * tt - ts * ts > 0 THEN (16 * tw - ts * ws) / sqrt((16 * tt - ts * ts) * (16 * ww - ws * ws)) END AS cc FROM m),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k, bx, by_ ORDER BY coalesce(cc, -9) DESC, di * di + dj * dj, dj, di) = 1),
n AS (SELECT b.k, b.bx, b.by_, b.di, b.dj, coalesce(b.cc >= 0.5 AND b.rainy >= 0.05 * 16, false) AS valid, b.cc, l0.cc AS l, r0.cc AS r, u0.cc AS u, d0.cc AS d FROM b LEFT JOIN c AS l0 ON l0.k = b.k AND l0.bx = b.bx AND l0.by_ = b.by_ AND l0.di = b.di - 1 AND l0.dj = b.dj
LEFT JOIN c AS r0 ON r0.k = b.k AND r0.bx = b.bx AND r0.by_ = b.by_ AND r0.di = b.di + 1 AND r0.dj = b.dj LEFT JOIN c AS u0 ON u0.k = b.k AND u0.bx = b.bx AND u0.by_ = b.by_ AND u0.di = b.di AND u0.dj = b.dj - 1
LEFT JOIN c AS d0 ON d0.k = b.k AND d0.bx = b.bx AND d0.by_ = b.by_ AND d0.di = b.di AND d0.dj = b.dj + 1),
ncc AS (SELECT k, bx, by_, valid, CASE WHEN valid THEN (di + CASE WHEN l - 2 * cc + r < 0 THEN greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * cc + r))) ELSE 0 END) / 10 ELSE 0 END AS dx,
CASE WHEN valid THEN (dj + CASE WHEN u - 2 * cc + d < 0 THEN greatest(-0.5, least(0.5, 0.5 * (u - d) / (u - 2 * cc + d))) ELSE 0 END) / 10 ELSE 0 END AS dy FROM n)"""
_FINISH = """, gl AS (SELECT k, median(dx) AS gx, median(dy) AS gy FROM ncc WHERE valid GROUP BY k), sm AS (SELECT a.k, a.bx, a.by_, median(b.dx) AS dx, median(b.dy) AS dy FROM ncc AS a JOIN ncc AS b ON b.k = a.k AND b.valid AND abs(a.bx - b.bx) <= 1 AND abs(a.by_ - b.by_) <= 1 WHERE a.valid GROUP BY ALL),
fill AS (SELECT a.k, a.bx, a.by_, (any_value(gx) / 16 + sum(s.dx / (pow(a.bx - s.bx, 2) + pow(a.by_ - s.by_, 2)))) / (1 / 16 + sum(1 / (pow(a.bx - s.bx, 2) + pow(a.by_ - s.by_, 2)))) AS dx, (any_value(gy) / 16 + sum(s.dy / (pow(a.bx - s.bx, 2) + pow(a.by_ - s.by_, 2)))) / (1 / 16 + sum(1 / (pow(a.bx - s.bx, 2) + pow(a.by_ - s.by_, 2)))) AS dy
FROM ncc AS a JOIN gl ON gl.k = a.k JOIN sm AS s ON s.k = a.k WHERE NOT a.valid GROUP BY ALL), fin AS (SELECT a.k, a.bx, a.by_, a.valid, coalesce(s.dx, f.dx, 0) AS dx, coalesce(s.dy, f.dy, 0) AS dy FROM ncc AS a LEFT JOIN sm AS s ON s.k = a.k AND s.bx = a.bx AND s.by_ = a.by_ LEFT JOIN fill AS f ON f.k = a.k AND f.bx = a.bx AND f.by_ = a.by_)"""


def _rounded(f: DataFrame, digits: int = 6) -> DataFrame:
    return f.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in ("dx", "dy")})


@query(f"{_NCC} SELECT k, bx, by_ AS by, round(dx, 6) AS dx, round(dy, 6) AS dy, valid FROM ncc")
def mot_ncc_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(motion.motion(_pairs(spark, d), "TREC", SIZE, SEARCH, filled=False))


@query(f"{_NCC}{_FINISH} SELECT k, bx, by_ AS by, round(dx, 6) AS dx, round(dy, 6) AS dy, valid FROM fin")
def mot_field_finish(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(motion.motion(_pairs(spark, d), "TREC", SIZE, SEARCH))


@query(f"""{_NCC}{_FINISH}, w AS (SELECT a.k, a.bx, a.by_, sum(w * b.dx) / sum(w) AS dx, sum(w * b.dy) / sum(w) AS dy FROM fin AS a JOIN (VALUES (0, 3.0), (1, 2.0), (2, 1.0)) AS s(i, w) ON true JOIN fin AS b ON b.k = a.k - i AND b.bx = a.bx AND b.by_ = a.by_ AND b.valid GROUP BY ALL)
SELECT a.k, a.bx, a.by_ AS by, round(coalesce(w.dx, 0), 6) AS dx, round(coalesce(w.dy, 0), 6) AS dy, w.k IS NOT NULL AS valid FROM fin AS a LEFT JOIN w ON w.k = a.k AND w.bx = a.bx AND w.by_ = a.by_""")
def mod_weighted_field(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(motion.weighted(motion.motion(_pairs(spark, d), "TREC", SIZE, SEARCH), 3))


@query(f"{_NCC} SELECT k, max(valid) AS reliable, count(*) FILTER (WHERE valid) AS blocks FROM ncc GROUP BY k")
def mot_reliable(spark: SparkSession, d: str) -> DataFrame:
    return motion.motion(_pairs(spark, d), "TREC", SIZE, SEARCH, filled=False).groupBy("k").agg(F.bool_or("valid").alias("reliable"), F.count_if("valid").alias("blocks"))


@query()
def mot_trend_gain(spark: SparkSession, d: str) -> DataFrame:
    return motion.trends(_pairs(spark, d), SIZE, SEARCH)


@query()
def flo_horn_schunck(spark: SparkSession, d: str) -> DataFrame:
    return motion.motion(_pairs(spark, d), "HS", SIZE)


@query()
def flo_lucas_kanade(spark: SparkSession, d: str) -> DataFrame:
    return motion.motion(_pairs(spark, d), "LK", SIZE)


@query()
def now_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Every place of the lattice, now and at six leads."""
    return motion.forecast(_pairs(spark, d), None, 60, size=SIZE, search=SEARCH, at=(0, 10, 20, 30, 40, 50, 60))


@query()
def cel_assignment(spark: SparkSession, d: str) -> DataFrame:
    return motion.tracked(_pairs(spark, d), 30.0, 2, 12.0)


_SIG = f"""{_L}, h AS (SELECT max(y) + 1 AS h FROM l), g AS (SELECT k, x::INT AS x, y::INT AS y FROM (SELECT DISTINCT k FROM l), range(12) AS a(x), range((SELECT h FROM h)) AS b(y)), s AS (SELECT g.*, CASE WHEN coalesce(dbz, -32) < 10 THEN 0 ELSE least(dbz, 65) - 10 END AS s FROM g LEFT JOIN l ON l.k = g.k AND l.x = g.x AND l.y = g.y)"""


def _images(spark: SparkSession, d: str) -> DataFrame:
    lattice = src.lattice(spark, d)
    return motion.frames(lattice, 12, 1 + (lattice.agg(F.max("y")).first()[0] or 0))


def _by_frame(images: DataFrame, kernel, schema: str) -> DataFrame:
    def run(batches):
        for f in batches:
            for row in f.itertuples(index=False):
                yield kernel(row.k, motion.grid(row))

    return images.mapInPandas(run, schema)


def _long(k: int, a: np.ndarray, name: str) -> pd.DataFrame:
    y, x = np.indices(a.shape)
    return pd.DataFrame({"k": k, "x": x.ravel(), "y": y.ravel(), name: a.ravel()})


@query(f"""{_SIG} SELECT a.k, (a.x // 2)::INT AS x, (a.y // 2)::INT AS y, sum(b.s * (2 - abs(b.x - a.x)) * (2 - abs(b.y - a.y))) / 16 AS v FROM s AS a JOIN s AS b ON b.k = a.k AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 WHERE a.x % 2 = 0 AND a.y % 2 = 0 GROUP BY ALL""")
def flo_halved(spark: SparkSession, d: str) -> DataFrame:
    return _by_frame(_images(spark, d), lambda k, g: _long(k, kernels.halved(kernels.signal(g)), "v"), "k long, x int, y int, v double")


@query(f"""{_SIG} SELECT a.k, a.x, a.y, sum(b.s) AS v FROM s AS a JOIN s AS b ON b.k = a.k AND abs(b.x - a.x) <= 2 AND abs(b.y - a.y) <= 2 GROUP BY ALL""")
def flo_box_sums(spark: SparkSession, d: str) -> DataFrame:
    return _by_frame(_images(spark, d), lambda k, g: _long(k, kernels.box_sum(kernels.signal(g), 2), "v"), "k long, x int, y int, v double")


@query(f"""{_SIG}, m AS (SELECT b.k, b.x, b.y, (a.s + b.s) / 2 AS m, b.s - a.s AS it FROM s AS a JOIN s AS b ON a.k = b.k - 1 AND a.x = b.x AND a.y = b.y)
SELECT m.k, m.x, m.y, (coalesce(r.m, 0) - coalesce(l.m, 0)) / 2 AS ix, (coalesce(d.m, 0) - coalesce(u.m, 0)) / 2 AS iy, m.it FROM m LEFT JOIN m AS r ON r.k = m.k AND r.x = m.x + 1 AND r.y = m.y LEFT JOIN m AS l ON l.k = m.k AND l.x = m.x - 1 AND l.y = m.y
LEFT JOIN m AS d ON d.k = m.k AND d.x = m.x AND d.y = m.y + 1 LEFT JOIN m AS u ON u.k = m.k AND u.x = m.x AND u.y = m.y - 1""".replace("LEFT JOIN l ON l.k = g.k", "LEFT JOIN l ON l.k = g.k"))
def flo_gradients(spark: SparkSession, d: str) -> DataFrame:
    def kernel(k, prev, cur):
        ix, iy, it = kernels.gradients(kernels.signal(prev), kernels.signal(cur))
        return _long(k, ix, "ix").assign(iy=iy.ravel(), it=it.ravel())

    return motion.per_pair(_pairs(spark, d), kernel, "k long, x int, y int, ix double, iy double, it double")


@query(f"""{_L}, o AS (SELECT i, j FROM range(-2, 3) AS a(i), range(-2, 3) AS b(j) WHERE i * i + j * j <= 4), p AS (SELECT k, x, y, (k % 7 - 3) * 2.0 AS delta FROM l)
SELECT p.k, p.x, p.y, round(count(*) FILTER (WHERE CASE WHEN coalesce(c.dbz, -32) >= 10 THEN least(c.dbz + delta, 60) ELSE -32 END >= 20) / 13, 9) AS share FROM p CROSS JOIN o LEFT JOIN l AS c ON c.k = p.k AND c.x = p.x + i AND c.y = p.y + j GROUP BY ALL""")
def now_rain_share(spark: SparkSession, d: str) -> DataFrame:
    lattice = src.lattice(spark, d)
    reads = raster.disc_reads(lattice, lattice.select("k", "x", "y"), 2)
    moved = F.when(F.col("dbz") >= 10, F.least(F.col("dbz") + (F.col("k") % 7 - 3) * 2.0, F.lit(60.0))).otherwise(F.col("dbz"))
    return reads.groupBy("k", F.col("px").alias("x"), F.col("py").alias("y")).agg(F.round(F.avg((moved >= 20).cast("int")), 9).alias("share"))


@query(f"""{_L}, o AS (SELECT i, j FROM range(-1, 2) AS a(i), range(-1, 2) AS b(j) WHERE i * i + j * j <= 1), r AS (SELECT p.k, p.x, p.y, list_sort(list(coalesce(c.dbz, -32))) AS s FROM l AS p CROSS JOIN o LEFT JOIN l AS c ON c.k = p.k AND c.x = p.x + i AND c.y = p.y + j GROUP BY ALL)
SELECT r.k, r.x, r.y, CASE WHEN l.dbz >= 40 THEN l.dbz ELSE s[3] END AS echo FROM r JOIN l ON l.k = r.k AND l.x = r.x AND l.y = r.y""")
def rad_point_echo(spark: SparkSession, d: str) -> DataFrame:
    """Strong pixels as they are, the others by the median of their disc."""
    lattice = src.lattice(spark, d)
    med = raster.disc_stats(lattice, lattice.select("k", "x", "y"), 1).select("k", F.col("px").alias("x"), F.col("py").alias("y"), "median")
    return med.join(lattice, ["k", "x", "y"]).select("k", "x", "y", F.when(F.col("dbz") >= 40, F.col("dbz")).otherwise(F.col("median")).alias("echo"))


_CELLS = f"""{_AREAS}, c AS (SELECT k, cell, count(*) AS area, avg(dbz) AS mean, sum((dbz - 29) * x) / sum(dbz - 29) AS cx, sum((dbz - 29) * y) / sum(dbz - 29) AS cy, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM p GROUP BY k, cell)""".replace(", c AS (SELECT k, cell", ", cc AS (SELECT k, cell")


@query(f"""{_CELLS}, m AS (SELECT b.k, a.cell AS a, b.cell AS b, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS d, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS u FROM cc AS a JOIN cc AS b ON b.k = a.k + 1)
SELECT k, a, b, round(d / 6 + 0.5 * (1 - i / (u - i)), 6) AS cost FROM m WHERE d <= 6""")
def cel_costs(spark: SparkSession, d: str) -> DataFrame:
    """Distance against the gate and overlap of boxes, of cells of frames that follow each other."""
    c = cells.segments(cells.labelled(src.lattice(spark, d)), least=1)
    was = c.select((F.col("k") + 1).alias("k"), *[F.col(x).alias(f"a_{x}") for x in ("cell", "cx", "cy", "min_x", "max_x", "min_y", "max_y")])
    over = lambda v: F.greatest(F.least(f"a_max_{v}", f"max_{v}") + 1 - F.greatest(f"a_min_{v}", f"min_{v}"), F.lit(0))
    box = lambda p: (F.col(f"{p}max_x") - F.col(f"{p}min_x") + 1) * (F.col(f"{p}max_y") - F.col(f"{p}min_y") + 1)
    gap = F.sqrt(cells.square(F.col("a_cx") - F.col("cx")) + cells.square(F.col("a_cy") - F.col("cy")))  # hypot rounds otherwise
    inter = over("x") * over("y")
    met = cells.near(c, was, 6).where(gap <= 6)
    return met.select("k", F.col("a_cell").alias("a"), F.col("cell").alias("b"), cells.half_up(gap / 6 + 0.5 * (1 - inter / (box("a_") + box("") - inter)), 6).alias("cost"))


@query(f"""{_CELLS}, li AS (SELECT b.k, a.cell AS a, b.cell AS b, count(*) AS n FROM p AS a JOIN p AS b ON b.k = a.k + 1 AND b.x = a.x AND b.y = a.y GROUP BY ALL), lk AS (SELECT li.* , x.area FROM li JOIN cc AS x ON x.k = li.k - 1 AND x.cell = li.a JOIN cc AS y ON y.k = li.k AND y.cell = li.b WHERE n >= 0.3 * least(x.area, y.area)),
pr AS (SELECT k, b, count(*) AS parents, arg_max(a, area * 10000 - a) AS main FROM lk GROUP BY ALL), ch AS (SELECT k, a, count(*) AS children FROM lk GROUP BY ALL),
hist AS (SELECT cc.k, cc.cell, 0 AS back, cc.cell AS at, cc.mean, cc.area FROM cc UNION ALL SELECT r.k, r.cell, r.back + 1, pr.main, c2.mean, c2.area FROM hist AS r JOIN pr ON pr.k = r.k - r.back AND pr.b = r.at JOIN cc AS c2 ON c2.k = r.k - r.back - 1 AND c2.cell = pr.main WHERE r.back < 3),
life AS (SELECT k, cell, count(*)::INT AS age, CASE WHEN count(*) < 2 THEN 0 ELSE round(regr_slope(mean, -10.0 * back), 6) END AS rate_dbz, CASE WHEN count(*) < 2 THEN 0 ELSE round(regr_slope(area, -10.0 * back), 6) END AS rate_area FROM hist GROUP BY ALL)
SELECT s.*, coalesce(parents, 0) = 0 AS is_new, coalesce(parents, 0) >= 2 AS merged, coalesce(children, 0) >= 2 AS split, rate_dbz < 0 AND rate_area < 0 AS decaying FROM life AS s LEFT JOIN pr ON pr.k = s.k AND pr.b = s.cell LEFT JOIN ch ON ch.k = s.k AND ch.a = pr.main""".replace("SELECT s.*, coalesce", "SELECT s.k, s.cell, age, rate_dbz, rate_area, coalesce"))
def cel_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Age, origin and slopes of each cell along its main ancestors, three frames back at most."""
    return cells.lifecycle(cells.labelled(src.lattice(spark, d)), 3, 10.0)
