"""Registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions import geo, radar
from pluvia.operators import raster, scores, series, verification
from pluvia.sources import driver_tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_POINTS = "SELECT c_custkey AS id, round(c_acctbal / 130, 4) AS lat, round((c_custkey * 7919) % 3600 / 10.0 - 180, 4) AS lon FROM customer"


def _points(spark: SparkSession, d: str) -> DataFrame:
    c = src.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") / 130, 4).alias("lat"), F.round((F.col("c_custkey") * 7919) % 3600 / 10.0 - 180, 4).alias("lon"))


_Y7 = "(0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 32768"


@query(f"""WITH p AS ({_POINTS}), q AS (SELECT *, (lon + 180) / 360 * 32768 AS gx, {_Y7} AS gy FROM p)
SELECT id, round(gx, 6) AS gx, round(gy, 6) AS gy, floor(gx / 256)::INT AS tile_x, floor(gy / 256)::INT AS tile_y, floor((gx - 128) / 256)::INT AS corner_x, floor((gy - 128) / 256)::INT AS corner_y,
round(degrees(atan(sinh(pi() * (1 - 2 * gy / 32768)))), 6) AS back_lat, round(gx / 32768 * 360 - 180, 6) AS back_lon, round(cos(radians(lat)) * (2 * pi() * 6378137 / 32768), 6) AS metres FROM q""")
def geo_mercator(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d).withColumns({"gx": geo.pixel_x(F.col("lon"), 7), "gy": geo.pixel_y(F.col("lat"), 7)})
    gx, gy = F.col("gx"), F.col("gy")
    return p.select(
        "id", F.round(gx, 6).alias("gx"), F.round(gy, 6).alias("gy"), F.floor(gx / 256).cast("int").alias("tile_x"), F.floor(gy / 256).cast("int").alias("tile_y"),
        geo.region_corner(gx).alias("corner_x"), geo.region_corner(gy).alias("corner_y"), F.round(geo.lat_of(gy, 7), 6).alias("back_lat"), F.round(geo.lon_of(gx, 7), 6).alias("back_lon"), F.round(geo.metres_per_pixel(F.col("lat"), 7), 6).alias("metres"),
    )


@query(f"""WITH p AS ({_POINTS}) SELECT id, CASE WHEN abs(lat) < 23.5 THEN 'tropical' WHEN abs(lat) < 35 THEN 'subtropical' ELSE 'midlat' END AS climate,
abs(lat) <= 60 AND abs((lon - 140.7 + 540) % 360 - 180) <= 65 AS seen, round(lat / 0.25) * 0.25 AS snap_lat, round(lon / 0.25) * 0.25 AS snap_lon,
round(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(lat - 21) / 2), 2) + cos(radians(21)) * cos(radians(lat)) * pow(sin(radians(lon - 105.8) / 2), 2)))), 3) AS metres FROM p""")
def geo_climate_distance(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    return _points(spark, d).select("id", geo.climate(lat).alias("climate"), geo.satellite_covers(lat, lon).alias("seen"), geo.snap(lat).alias("snap_lat"), geo.snap(lon).alias("snap_lon"), F.round(geo.haversine_m(F.lit(21.0), F.lit(105.8), lat, lon), 3).alias("metres"))


@query("""WITH v AS (SELECT event_id, value - 245 AS dx, (event_id % 101) - 50.0 AS dy FROM events), h AS (SELECT event_id, round(hypot_(dx, dy) * 72, 4) AS kmh, (degrees(atan2(dx, -dy)) + 360) % 360 AS deg FROM v)
SELECT event_id, kmh, round(deg, 6) AS deg, ['N','NE','E','SE','S','SW','W','NW'][(round(deg / 45) % 8)::INT + 1] AS compass FROM h""".replace("hypot_(dx, dy)", "sqrt(dx * dx + dy * dy)"))
def geo_heading(spark: SparkSession, d: str) -> DataFrame:
    v = src.table(spark, d, "events").select("event_id", (F.col("value") - 245).alias("dx"), ((F.col("event_id") % 101) - 50.0).alias("dy"))
    deg = geo.heading(F.col("dx"), F.col("dy"))
    return v.select("event_id", F.round(geo.speed_kmh(F.col("dx"), F.col("dy"), F.lit(1.2)), 4).alias("kmh"), F.round(deg, 6).alias("deg"), geo.compass(deg).alias("compass"))


@query()
def geo_fold(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("id", geo.fold(F.col("lat"), F.col("lon")).alias("fold"))


@query("""WITH e AS (SELECT event_id, value / 8 AS dbz, (event_id % 61)::INT AS m, (value - 245) / 400 AS r FROM events)
SELECT event_id, round(CASE WHEN dbz < 15 THEN 0 ELSE pow(pow(10, least(dbz, 55) / 10) / 200, 1 / 1.6) END, 6) AS rate, CASE WHEN dbz < 10 THEN 0 ELSE least(dbz, 65) - 10 END AS signal,
round(CASE WHEN m > 0 AND dbz >= 10 THEN least(dbz + r * 20 * (1 - exp(-m / 20.0)), 60) ELSE dbz END, 6) AS trended, (2 + m * 8 // 60)::INT AS radius, least(floor(value / 490 * 20)::INT, 19) AS bin FROM e JOIN (SELECT event_id, value FROM events) USING (event_id)""")
def rad_scalars(spark: SparkSession, d: str) -> DataFrame:
    dbz, m = F.col("value") / 8, (F.col("event_id") % 61).cast("int")
    return src.table(spark, d, "events").select(
        "event_id", F.round(radar.rain_rate(dbz), 6).alias("rate"), radar.intensity(dbz).alias("signal"), F.round(radar.trended(dbz, (F.col("value") - 245) / 400, m), 6).alias("trended"), radar.probability_radius(m).alias("radius"), radar.probability_bin(F.col("value") / 490).alias("bin")
    )


_L = f"WITH l AS ({src.LATTICE_SQL})"
_RATE = "CASE WHEN v < 15 THEN 0 ELSE pow(pow(10, least(v, 55) / 10) / 200, 1 / 1.6) END"


@query(f"""{_L}, o AS (SELECT i, j FROM range(-2, 3) AS a(i), range(-2, 3) AS b(j) WHERE i * i + j * j <= 4),
r AS (SELECT p.k, p.x AS px, p.y AS py, coalesce(c.dbz, -32) AS v FROM l AS p CROSS JOIN o LEFT JOIN l AS c ON c.k = p.k AND c.x = p.x + i AND c.y = p.y + j),
g AS (SELECT k, px, py, list_sort(list(v)) AS s, avg((v >= 20)::INT) AS share, max(v) AS top, avg({_RATE}) AS rate FROM r GROUP BY ALL)
SELECT k, px, py, s[7] AS median, round(share, 9) AS share, top, round(CASE WHEN rate > 0 THEN 10 * log10(200 * pow(rate, 1.6)) ELSE -32 END, 6) AS mean_dbz FROM g""")
def rad_disc_stats(spark: SparkSession, d: str) -> DataFrame:
    cells = src.lattice(spark, d)
    return raster.disc_stats(cells, cells.select("k", "x", "y"), 2)


@query(f"""{_L}, p AS (SELECT k, x * 1000 + y AS id, x + 0.25 AS fx, y + 0.5 AS fy FROM l), c AS (SELECT k, id, floor(fx) + i AS x, floor(fy) + j AS y,
CASE WHEN i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END * CASE WHEN j = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END AS w FROM p, range(2) AS a(i), range(2) AS b(j))
SELECT c.k, id, round(sum(w * coalesce(dbz, -32)), 6) AS dbz FROM c LEFT JOIN l ON l.k = c.k AND l.x = c.x AND l.y = c.y GROUP BY ALL""")
def rad_bilinear(spark: SparkSession, d: str) -> DataFrame:
    cells = src.lattice(spark, d)
    return raster.bilinear(cells, cells.select("k", (F.col("x") * 1000 + F.col("y")).alias("id"), (F.col("x") + 0.25).alias("fx"), (F.col("y") + 0.5).alias("fy")))


@query(f"""{_L}, g AS (SELECT k, x, y FROM (SELECT DISTINCT k FROM l), range(12) AS a(x), range(10) AS b(y))
SELECT g.k, round(count(*) FILTER (WHERE dbz >= 20) / count(*), 9) AS share FROM g LEFT JOIN l ON l.k = g.k AND l.x = g.x AND l.y = g.y GROUP BY g.k""")
def rad_rain_fraction(spark: SparkSession, d: str) -> DataFrame:
    cells = src.lattice(spark, d)
    grid = cells.select("k").distinct().select("k", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("x")).select("k", "x", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("y"))
    return raster.rain_fraction(cells, grid)


@query(f"""{_L}, p AS (SELECT coalesce(a.k, b.k - 1) AS k, coalesce(a.dbz, -32) AS fc, coalesce(b.dbz, -32) AS obs FROM l AS a FULL JOIN l AS b ON b.k - 1 = a.k AND a.x = b.x AND a.y = b.y),
c AS (SELECT k, count(*) FILTER (WHERE fc >= 20 AND obs >= 20) AS hits, count(*) FILTER (WHERE fc < 20 AND obs >= 20) AS misses, count(*) FILTER (WHERE fc >= 20 AND obs < 20) AS false_alarms FROM p GROUP BY k)
SELECT *, round(hits / nullif(hits + misses + false_alarms, 0), 9) AS csi FROM c""")
def bt_persistence(spark: SparkSession, d: str) -> DataFrame:
    p = raster.persistence(src.lattice(spark, d))
    c = p.groupBy("k").agg(*verification.contingency(F.col("fc") >= 20, F.col("obs") >= 20)[:3])
    return c.withColumn("csi", F.round(F.try_divide(F.col("hits").cast("double"), (F.col("hits") + F.col("misses") + F.col("false_alarms")).cast("double")), 9))


@query(f"""{_L}, s AS (SELECT k, x, y, CASE WHEN dbz < 10 THEN 0 ELSE least(dbz, 65) - 10 END AS s FROM l WHERE dbz > 10),
m AS (SELECT a.k + 1 AS k, a.x // 4 AS bx, a.y // 4 AS by_, dx, dy, sum(a.s * b.s) AS score FROM s AS a, range(-2, 3) AS i(dx), range(-2, 3) AS j(dy), s AS b WHERE b.k = a.k + 1 AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL)
SELECT k, bx::INT AS bx, by_::INT AS by, dx::INT AS dx, dy::INT AS dy, score FROM m QUALIFY row_number() OVER (PARTITION BY k, bx, by_ ORDER BY score DESC, dx * dx + dy * dy, dx, dy) = 1""")
def mot_block_motion(spark: SparkSession, d: str) -> DataFrame:
    return raster.block_motion(src.lattice(spark, d))


_F = f"WITH f AS ({src.FORECASTS_SQL})"
_COUNTS = """count(*) FILTER (WHERE fc >= 20 AND obs >= 20) AS hits, count(*) FILTER (WHERE fc < 20 AND obs >= 20) AS misses, count(*) FILTER (WHERE fc >= 20 AND obs < 20) AS false_alarms"""


@query(f"""{_F}, t AS (SELECT variant, lead, {_COUNTS}, count(*) FILTER (WHERE fc < 20 AND obs < 20) AS negatives, avg(abs(greatest(fc, 0) - greatest(obs, 0))) FILTER (WHERE fc >= 20 OR obs >= 20) AS mae,
avg(pow(prob - (obs >= 20)::INT, 2)) AS brier FROM f GROUP BY GROUPING SETS ((variant, lead), (variant)))
SELECT variant, lead, hits, misses, false_alarms, negatives, round((hits + negatives) / nullif(hits + misses + false_alarms + negatives, 0), 9) AS accuracy, round(hits / nullif(hits + misses, 0), 9) AS pod,
round(false_alarms / nullif(hits + false_alarms, 0), 9) AS far, round(hits / nullif(hits + misses + false_alarms, 0), 9) AS csi, round(mae, 6) AS mae, round(brier, 6) AS brier FROM t""")
def bt_lead_scores(spark: SparkSession, d: str) -> DataFrame:
    return verification.lead_scores(src.forecasts(spark, d))


@query(f"""{_F}, c AS (SELECT * FROM (VALUES (20.0, 30.0), (30.0, 40.0), (40.0, 50.0), (50.0, 1e9)) AS v(lo, hi)),
t AS (SELECT variant, lead, lo::DOUBLE AS lo, count(*) FILTER (WHERE p AND o) AS hits, count(*) FILTER (WHERE NOT p AND o) AS misses, count(*) FILTER (WHERE p AND NOT o) AS false_alarms
FROM (SELECT *, fc >= lo AND fc < hi AS p, obs >= lo AND obs < hi AS o FROM f, c) GROUP BY ALL) SELECT *, round(hits / nullif(hits + misses + false_alarms, 0), 9) AS csi FROM t""")
def bt_class_scores(spark: SparkSession, d: str) -> DataFrame:
    return verification.class_scores(src.forecasts(spark, d))


_H = f"{_F}, h AS (SELECT variant, (t // 21600 % 2)::INT AS half, least(floor(prob * 20)::INT, 19) AS bin, count(*) FILTER (WHERE obs >= 20) AS pos, count(*) FILTER (WHERE obs < 20) AS neg FROM f GROUP BY ALL)"


@query(f"{_H} SELECT * FROM h")
def bt_histogram(spark: SparkSession, d: str) -> DataFrame:
    return verification.histogram(src.forecasts(spark, d))


@query(f"""{_H}, b AS (SELECT variant, bin, sum(pos) AS pos, sum(neg) AS neg FROM h GROUP BY ALL), a AS (SELECT a.variant, sum(a.pos * (b.neg * CASE WHEN a.bin > b.bin THEN 1.0 WHEN a.bin = b.bin THEN 0.5 ELSE 0 END)) AS u FROM b AS a JOIN b ON a.variant = b.variant GROUP BY a.variant)
SELECT a.variant, round(u / (sum(pos) * sum(neg)), 9) AS auc FROM a JOIN b ON a.variant = b.variant GROUP BY a.variant, u""")
def bt_auc(spark: SparkSession, d: str) -> DataFrame:
    return verification.auc(verification.histogram(src.forecasts(spark, d)))


@query(f"""{_H} SELECT variant, (bin // 2)::INT AS decile, sum(pos + neg)::BIGINT AS n, round(sum((bin + 0.5) / 20 * (pos + neg)) / sum(pos + neg), 9) AS mean_p, round(sum(pos) / sum(pos + neg), 9) AS frequency FROM h GROUP BY ALL""")
def bt_reliability(spark: SparkSession, d: str) -> DataFrame:
    return verification.reliability(verification.histogram(src.forecasts(spark, d)))


_ISO = """b AS (SELECT variant, half, bin, sum(pos) AS pos, sum(pos + neg) AS n FROM h GROUP BY ALL),
w AS (SELECT a.variant, a.half, a.bin AS lo, c.bin AS hi, sum(m.pos) / sum(m.n) AS mean FROM b AS a JOIN b AS c ON a.variant = c.variant AND a.half = c.half AND a.bin <= c.bin JOIN b AS m ON m.variant = a.variant AND m.half = a.half AND m.bin BETWEEN a.bin AND c.bin GROUP BY ALL),
l AS (SELECT b.variant, b.half, b.bin, lo, min(mean) AS least FROM b JOIN w ON w.variant = b.variant AND w.half = b.half AND b.bin BETWEEN lo AND hi GROUP BY ALL),
iso AS (SELECT variant, half, bin, round(max(least), 9) AS calibrated FROM l GROUP BY ALL)"""


@query(f"{_H}, {_ISO} SELECT * FROM iso")
def bt_isotonic(spark: SparkSession, d: str) -> DataFrame:
    return verification.isotonic(verification.histogram(src.forecasts(spark, d)), ["variant", "half"])


@query(f"""{_H}, {_ISO} SELECT h.variant, round(sum(pos * pow(1 - coalesce(calibrated, (h.bin + 0.5) / 20), 2) + neg * pow(coalesce(calibrated, (h.bin + 0.5) / 20), 2)) / sum(pos + neg), 6) AS brier
FROM h LEFT JOIN iso ON iso.variant = h.variant AND iso.half = 1 - h.half AND iso.bin = h.bin GROUP BY h.variant""")
def bt_calibrated_brier(spark: SparkSession, d: str) -> DataFrame:
    return verification.calibrated_brier(src.forecasts(spark, d))


@query(f"{_F} SELECT region, t // 21600 AS block, variant, {_COUNTS}, count(*) FILTER (WHERE fc < 20 AND obs < 20) AS negatives FROM f GROUP BY ALL")
def bt_blocks(spark: SparkSession, d: str) -> DataFrame:
    return verification.blocks(src.forecasts(spark, d))


@query()
def bt_bootstrap_csi(spark: SparkSession, d: str) -> DataFrame:
    """200 resamples; bt_bootstrap draws as many as the application, with a reference variant."""
    found = scores.bootstrap(verification.blocks(src.forecasts(spark, d)), ["A", "N", "R"], "A", 200)
    return found.select("variant", "low", "high", F.lit(200).alias("n"))


@query(f"""{_L}, w AS (SELECT k, x, y FROM l WHERE dbz >= 20), s AS (SELECT k, x + i AS x, y + j AS y, count(*) AS n FROM w, range(-1, 2) AS a(i), range(-1, 2) AS b(j) GROUP BY ALL),
p AS (SELECT coalesce(a.k + 1, b.k) AS k, coalesce(a.n, 0) AS fc, coalesce(b.n, 0) AS ob FROM s AS a FULL JOIN s AS b ON a.k + 1 = b.k AND a.x = b.x AND a.y = b.y)
SELECT k, round(1 - sum(pow(fc - ob, 2)) / sum(pow(fc, 2) + pow(ob, 2)), 9) AS fss FROM p GROUP BY k""")
def bt_fractions_skill(spark: SparkSession, d: str) -> DataFrame:
    return verification.fractions_skill(src.lattice(spark, d), 1)


_FR = f"WITH f AS ({src.FRAMES_SQL})"


@query(f"""{_FR}, m AS (SELECT *, t - 600 * row_number() OVER (PARTITION BY region ORDER BY t) AS g FROM f) SELECT region, min(t) AS start, count(*) AS frames FROM m GROUP BY region, g""")
def bt_rain_runs(spark: SparkSession, d: str) -> DataFrame:
    return verification.runs(src.frames(spark, d), ["region"], 600)


@query(f"""{_FR}, c AS (SELECT *, sum(cut) OVER (PARTITION BY region ORDER BY t) AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY region ORDER BY t) <= 1800 THEN 0 ELSE 1 END AS cut FROM f))
SELECT region, t, least(row_number() OVER (PARTITION BY region, run ORDER BY t), 5)::INT AS chain FROM c""")
def mod_history_chain(spark: SparkSession, d: str) -> DataFrame:
    return series.history_chain(src.frames(spark, d), ["region"], 4, 1800)


@query(f"""{_FR} SELECT region, t FROM f WHERE NOT EXISTS (SELECT 1 FROM (VALUES (-1200), (-600), (600), (1200)) AS o(s) WHERE NOT EXISTS (SELECT 1 FROM f AS g WHERE g.region = f.region AND g.t = f.t + s))""")
def inv_eligible_issues(spark: SparkSession, d: str) -> DataFrame:
    return series.eligible_issues(src.frames(spark, d), ["region"], 2, [10, 20])


_EV = "WITH e AS (SELECT event_id, user_id, event_type, value, floor(epoch(ts))::BIGINT AS t FROM events)"


@query(f"{_EV} SELECT event_type AS source, t // 600 * 600 AS t, t AS seen, min(t - t // 600 * 600) OVER (PARTITION BY event_type ORDER BY t // 600 * 600, t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS lag FROM e")
def pip_publish_lag_all(spark: SparkSession, d: str) -> DataFrame:
    e = src.event_times(spark, d)
    return series.publish_lag(e.select(F.col("event_type").alias("source"), (F.floor(F.col("t") / 600) * 600).cast("long").alias("t"), F.col("t").alias("seen")))


@query(f"{_EV} SELECT event_id, user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS load FROM e")
def rat_sliding_load(spark: SparkSession, d: str) -> DataFrame:
    return series.sliding_load(src.event_times(spark, d), ["user_id"], 3600).select("event_id", "user_id", "t", "load")


@query(f"{_EV}, s AS (SELECT *, sum(round(value)::BIGINT) OVER (PARTITION BY event_type, t // 86400 ORDER BY t, event_id)::BIGINT AS spent FROM e) SELECT event_id, spent, spent <= 5000 AS allowed FROM s")
def rat_daily_budget(spark: SparkSession, d: str) -> DataFrame:
    return series.within_budget(src.event_times(spark, d), ["event_type"], 5000, ["t", "event_id"], F.round("value").cast("long")).select("event_id", "spent", "allowed")


@query(f"""{_EV}, m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - row_number() OVER (PARTITION BY user_id, value > 150 ORDER BY t, event_id) AS g FROM e)
SELECT user_id, min(t) AS since, max(t) AS until, count(*) AS samples FROM m WHERE value > 150 GROUP BY user_id, g HAVING max(t) - min(t) >= 3600""")
def rat_alarms(spark: SparkSession, d: str) -> DataFrame:
    return series.alarms(src.event_times(spark, d), ["user_id"], F.col("value") > 150, 3600)


@query("""WITH h AS (SELECT floor(epoch(o_orderdate))::BIGINT // 86400 * 86400 AS t, max(o_totalprice) AS v FROM orders GROUP BY ALL), a AS (SELECT o_orderkey AS id, floor(epoch(o_orderdate))::BIGINT // 86400 * 86400 + o_orderkey % 86400 AS t FROM orders)
SELECT a.id, a.t, CASE WHEN a.t = p.t THEN p.v ELSE p.v + (n.v - p.v) * ((a.t - p.t) / 86400) END AS value FROM a LEFT JOIN h AS p ON p.t = a.t // 86400 * 86400 LEFT JOIN h AS n ON n.t = p.t + 86400""")
def ml_interpolated(spark: SparkSession, d: str) -> DataFrame:
    o = src.table(spark, d, "orders").select("o_orderkey", (F.floor(src.epoch(F.col("o_orderdate")) / 86400) * 86400).cast("long").alias("day"), "o_totalprice")
    hourly = o.groupBy(F.lit(0).alias("s"), F.col("day").alias("t")).agg(F.max("o_totalprice").alias("v"))
    asked = o.select(F.lit(0).alias("s"), F.col("o_orderkey").alias("id"), (F.col("day") + F.col("o_orderkey") % 86400).alias("t"))
    return series.interpolated(hourly, asked, ["s"], 86400).select("id", "t", "value")


@query(f"{_EV} SELECT user_id, arg_min(t, value * 1000000 + event_id) AS first_seen, max(t) AS last_active FROM e GROUP BY user_id")
def snk_region_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = src.event_times(spark, d).select("user_id", F.col("t").alias("now"), (F.col("value") * 1000000 + F.col("event_id")).alias("seq"))
    return series.latest_upsert(e, ["user_id"])


@query("SELECT user_id % 50 AS k, min(event_id) AS id FROM events WHERE event_id % 3 = 0 GROUP BY 1 UNION ALL SELECT k, min(id) FROM (SELECT user_id % 70 AS k, event_id AS id FROM events WHERE event_id % 3 <> 0) WHERE k NOT IN (SELECT user_id % 50 FROM events WHERE event_id % 3 = 0) GROUP BY k")
def snk_insert_if_absent_all(spark: SparkSession, d: str) -> DataFrame:
    """Every event is there before or new."""
    e = src.table(spark, d, "events")
    part = lambda m, rows: rows.groupBy((F.col("user_id") % m).alias("k")).agg(F.min("event_id").alias("id"))
    return series.insert_if_absent(part(50, e.where("event_id % 3 = 0")), part(70, e.where("event_id % 3 <> 0")), ["k"])


@query(f"{_EV} SELECT event_type, event_id AS id, kept_size::BIGINT AS kept_size FROM (SELECT *, sum(round(value)::BIGINT) OVER (PARTITION BY event_type ORDER BY t DESC, event_id DESC) AS kept_size FROM e) WHERE kept_size > 20000")
def snk_tile_eviction(spark: SparkSession, d: str) -> DataFrame:
    e = src.event_times(spark, d).select("event_type", "t", F.col("event_id").alias("id"), F.round("value").cast("long").alias("size"))
    return series.evicted(e, ["event_type"], 20000).select("event_type", "id", "kept_size")


@query(f"""{_FR}, s AS (SELECT region, min(t) + 86400 - 10800 AS lo, max(t) - 864000 AS hi FROM f GROUP BY region) SELECT f.t, f.region AS frame_region, s.region FROM f JOIN s ON f.t BETWEEN lo AND hi AND f.region = (s.region + 1) % 12""")
def bt_frames_in_range(spark: SparkSession, d: str) -> DataFrame:
    f = src.frames(spark, d)
    spans = f.groupBy("region").agg((F.min("t") + 86400 - 10800).alias("lo"), (F.max("t") - 864000).alias("hi"))
    met = series.frames_in_range(f.withColumnRenamed("region", "frame_region"), spans, 86400)
    return met.where(F.col("frame_region") == (F.col("region") + 1) % 12).select("t", "frame_region", "region")


@query("SELECT (SELECT count(*) FROM events) AS frames, (SELECT count(*) FROM customer) AS regions")
def src_counts(spark: SparkSession, d: str) -> DataFrame:
    both = {"frames": src.table(spark, d, "events"), "regions": src.table(spark, d, "customer")}
    return spark.sql("SELECT (SELECT count(*) FROM {frames}) AS frames, (SELECT count(*) FROM {regions}) AS regions", **both)


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS t FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def src_recent_frames(spark: SparkSession, d: str) -> DataFrame:
    return src.event_times(spark, d).select("event_id", "t").orderBy(F.desc("t"), F.desc("event_id")).limit(20)


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, regexp_matches(url, '^https?://') AS is_link FROM pages")
def txt_links(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:]+)", 1).alias("host"), F.col("url").rlike("^https?://").alias("is_link"))
