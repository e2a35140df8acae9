"""Queries of the archive: inventories, plans, upserts and retention, candidate scans, collectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.operators import archive
from pluvia.plans.registry import _EV, _FR, _POINTS, _points, query
from pluvia.sources import driver_tables as src

_DAY = "WITH t AS (SELECT (user_id % 12)::INT AS region, floor(epoch(ts))::BIGINT // 86400 AS day, (event_id % 9)::INT AS slot FROM events)"


def _slots(spark: SparkSession, d: str) -> DataFrame:
    return src.event_times(spark, d).select((F.col("user_id") % 12).cast("int").alias("region"), F.floor(F.col("t") / 86400).cast("long").alias("day"), (F.col("event_id") % 9).cast("int").alias("slot"))


@query(f"{_DAY} SELECT region, day FROM t GROUP BY ALL HAVING count(DISTINCT slot) = 9")
def inv_complete_mosaics(spark: SparkSession, d: str) -> DataFrame:
    return archive.complete(_slots(spark, d), ["region", "day"], 9)


@query(f"""{_DAY}, a AS (SELECT region, day, slot::INT AS slot FROM (SELECT DISTINCT region, day FROM t), range(9) AS s(slot)), m AS (SELECT DISTINCT region, day + 1 AS day, slot FROM t WHERE slot % 2 = 0)
SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.region = a.region AND t.day = a.day AND t.slot = a.slot) THEN 'data' WHEN EXISTS (SELECT 1 FROM m WHERE m.region = a.region AND m.day = a.day AND m.slot = a.slot) THEN 'missing' ELSE 'unknown' END AS state FROM a""")
def src_tile_states(spark: SparkSession, d: str) -> DataFrame:
    t = _slots(spark, d)
    asked = t.select("region", "day").distinct().select("region", "day", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("slot"))
    gone = t.where("slot % 2 = 0").withColumn("day", F.col("day") + 1)
    return archive.tile_state(asked, t, gone, ["region", "day", "slot"])


_SC = f"{_EV}, f AS (SELECT DISTINCT t // 600 * 600 + 17 AS t FROM e), c AS (SELECT DISTINCT t // 600 * 600 AS scan, (user_id % 2)::INT AS slot FROM e)"


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = src.event_times(spark, d)
    at = (F.floor(F.col("t") / 600) * 600).cast("long")
    return e.select((at + 17).alias("t")).distinct(), e.select(at.alias("scan"), (F.col("user_id") % 2).cast("int").alias("slot"))


@query(f"""{_SC}, n AS (SELECT scan, count(*) AS n FROM c GROUP BY scan), o AS (SELECT t, n.scan, n.n, i FROM f, (VALUES (0, -600), (1, -1200)) AS x(i, o) JOIN n ON n.scan = f.t // 600 * 600 + o) SELECT t, scan, n, 'all' AS kind FROM (SELECT * FROM o WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY t ORDER BY i) = 1)
UNION ALL SELECT t, scan, n, 'any' FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY t ORDER BY i) = 1)""")
def src_candidate_scans(spark: SparkSession, d: str) -> DataFrame:
    frames, cached = _scans(spark, d)
    pick = lambda kind, every: archive.first_candidate(frames, cached, [-600, -1200], 2, every).withColumn("kind", F.lit(kind))
    return pick("all", True).unionByName(pick("any", False))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS scan FROM events")
def src_scan_list(spark: SparkSession, d: str) -> DataFrame:
    """Scan lists as JSON text, read back to seconds."""
    e = src.table(spark, d, "events")
    listed = e.select("event_id", F.concat(F.lit('[{"basetime":"'), F.date_format("ts", "yyyyMMddHHmmss"), F.lit('"}]')).alias("json"))
    parsed = listed.select("event_id", F.explode(F.from_json("json", "array<struct<basetime:string>>")).alias("s"))
    return parsed.select("event_id", src.epoch(F.to_timestamp_ntz("s.basetime", F.lit("yyyyMMddHHmmss"))).alias("scan"))


@query("""WITH p AS (SELECT o_custkey % 200 AS point, floor(epoch(o_orderdate))::BIGINT // 86400 AS day, o_orderkey AS k FROM orders), a AS (SELECT DISTINCT point, day FROM p), c AS (SELECT DISTINCT point, day FROM p WHERE k % 3 > 0)
SELECT day, count(*) FILTER (WHERE c.point IS NOT NULL) AS had, count(*) AS asked FROM a LEFT JOIN c USING (point, day) GROUP BY day""")
def src_day_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = _point_days(spark, d)
    return archive.coverage_by_day(p.select("point", "day"), p.where("k % 3 > 0"))


def _point_days(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("point"), F.floor(src.epoch(F.col("o_orderdate")) / 86400).cast("long").alias("day"), F.col("o_orderkey").alias("k"))


@query("""WITH p AS (SELECT o_custkey % 200 AS point, floor(epoch(o_orderdate))::BIGINT // 86400 AS day FROM orders), r AS (SELECT DISTINCT point FROM p) SELECT point, day::BIGINT AS day FROM r, range(9000, 9031) AS x(day) EXCEPT SELECT point, day FROM p""")
def src_missing_days(spark: SparkSession, d: str) -> DataFrame:
    p = _point_days(spark, d)
    return archive.missing_days(p, p, 9000 * 86400, 9030 * 86400).select("point", F.col("day").cast("long").alias("day"))


@query(f"""{_FR}, u AS (SELECT region, t FROM f WHERE NOT EXISTS (SELECT 1 FROM (VALUES (-1200), (-600), (600), (1200)) AS o(s) WHERE NOT EXISTS (SELECT 1 FROM f AS g WHERE g.region = f.region AND g.t = f.t + s))),
s AS (SELECT region, min(t) AS lo, max(t) AS hi FROM f GROUP BY region), r AS (SELECT region, count(*) AS n FROM (SELECT region, t - 600 * row_number() OVER (PARTITION BY region ORDER BY t) AS g FROM f) GROUP BY region, g),
l AS (SELECT region, sum(n)::BIGINT AS cached, count(*) AS runs, max(n) AS longest FROM r GROUP BY region) SELECT s.region, (hi - lo) // 600 + 1 AS expected, cached, runs, longest, (SELECT count(*) FROM u WHERE u.region = s.region) AS usable FROM s JOIN l USING (region)""")
def inv_inventory(spark: SparkSession, d: str) -> DataFrame:
    f = src.frames(spark, d)
    return archive.inventory(f, f.groupBy("region").agg(F.min("t").alias("lo"), F.max("t").alias("hi")), 2, [10, 20])


_PRUNE = f"""{_FR}, u AS (SELECT region, t FROM f WHERE NOT EXISTS (SELECT 1 FROM (VALUES (-600), (600)) AS o(s) WHERE NOT EXISTS (SELECT 1 FROM f AS g WHERE g.region = f.region AND g.t = f.t + s))), n AS (SELECT max(t) AS now FROM f),
v AS (SELECT region, t, 1000 + t % 7 AS bytes FROM f WHERE t < (SELECT now FROM n) - 10800 AND NOT EXISTS (SELECT 1 FROM u, (VALUES (-600), (0), (600)) AS o(s) WHERE u.region = f.region AND f.t = u.t + s))"""


def _prune(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = src.frames(spark, d).withColumn("bytes", 1000 + F.col("t") % 7)
    return f, archive.prune_plan(f, 1, [10], f.agg(F.max("t")).first()[0])


@query(f"{_PRUNE} SELECT * FROM v")
def inv_prune_plan(spark: SparkSession, d: str) -> DataFrame:
    return _prune(spark, d)[1]


@query(f"{_PRUNE} SELECT count(*) AS files, sum(bytes)::BIGINT AS bytes, (SELECT count(*) FROM (SELECT DISTINCT region FROM f) AS r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.region = r.region AND NOT EXISTS (SELECT 1 FROM v WHERE v.region = f.region AND v.t = f.t))) AS regions FROM v")
def inv_prune_report(spark: SparkSession, d: str) -> DataFrame:
    f, plan = _prune(spark, d)
    sums = plan.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return sums.join(archive.idle_regions(f, plan).agg(F.count("*").alias("regions")), F.lit(True))  # a row each


@query(f"{_PRUNE} SELECT region, t FROM f EXCEPT SELECT region, t FROM v")
def snk_deleted_frames(spark: SparkSession, d: str) -> DataFrame:
    f, plan = _prune(spark, d)
    return archive.without(f.select("region", "t"), plan, ["region", "t"])


@query(f"""{_FR}, w AS (SELECT DISTINCT f.t - 600 AS scan, ((f.region + i) % 7)::INT AS tile FROM f, range(3) AS x(i)), c AS (SELECT DISTINCT t AS scan, (region % 7)::INT AS tile FROM f) SELECT scan, count(*) AS tiles, min(tile) AS first FROM (SELECT * FROM w EXCEPT SELECT * FROM c) GROUP BY scan""")
def inv_satellite_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Scans with tiles that some region needs and that are not there."""
    f = src.frames(spark, d)
    wanted = f.select((F.col("t") - 600).alias("scan"), F.explode(F.array(*[((F.col("region") + i) % 7).cast("int") for i in range(3)])).alias("tile")).distinct()
    have = f.select(F.col("t").alias("scan"), (F.col("region") % 7).cast("int").alias("tile"))
    return archive.without(wanted, have, ["scan", "tile"]).groupBy("scan").agg(F.count("*").alias("tiles"), F.min("tile").alias("first"))


@query(f"""{_EV}, o AS (SELECT user_id, min(t) AS first_seen, max(t) AS last_active FROM e WHERE event_id % 2 = 0 GROUP BY user_id), n AS (SELECT user_id, min(t) AS first_seen, max(t) AS last_active FROM e WHERE event_id % 2 = 1 GROUP BY user_id)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.first_seen, n.first_seen) AS first_seen, greatest(o.last_active, n.last_active) AS last_active FROM o FULL JOIN n ON o.user_id = n.user_id""")
def snk_merged_regions(spark: SparkSession, d: str) -> DataFrame:
    """A table merged with the touches that came after it."""
    e = src.event_times(spark, d)
    part = lambda cond: e.where(cond).groupBy("user_id").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_active"))
    return archive.merged(part("event_id % 2 = 0"), part("event_id % 2 = 1"), ["user_id"], ["last_active"], ["first_seen"])


@query(f"""{_EV}, m AS (SELECT max(t) AS now FROM e) SELECT event_type, count(*) FILTER (WHERE t // 21600 * 21600 + 21600 >= now - 864000) AS kept, count(*) FILTER (WHERE t // 21600 * 21600 + 21600 < now - 864000) AS dropped, count(*) FILTER (WHERE now - t >= 259200) AS expired, count(DISTINCT t // 86400) FILTER (WHERE t // 86400 < now // 86400) AS day_files FROM e, m GROUP BY event_type""")
def snk_retention(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of six hours by age, tiles by age, and the past days that may be written as files."""
    e = src.event_times(spark, d)
    now = F.lit(e.agg(F.max("t")).first()[0])
    end = F.floor(F.col("t") / 21600) * 21600 + 21600
    day = F.floor(F.col("t") / 86400)
    return e.groupBy("event_type").agg(F.count_if(end >= now - 864000).alias("kept"), F.count_if(end < now - 864000).alias("dropped"), F.count_if(now - F.col("t") >= 259200).alias("expired"), F.count_distinct(F.when(day < F.floor(now / 86400), day)).alias("day_files"))


@query("SELECT c_custkey AS id, c_name AS name, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS region FROM customer")
def snk_region_ids(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids in the order of names: the names are few and numbered apart from the rows."""
    c = src.table(spark, d, "customer")
    names = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    ids = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "c_mktsegment string, region int")
    return c.join(F.broadcast(ids), "c_mktsegment").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "region")


@query(f"""{_EV}, h AS (SELECT DISTINCT t // 600 * 600 AS t FROM e ORDER BY t DESC LIMIT 5), p AS ({_POINTS}), c AS (SELECT id, floor(((lon + 180) / 360 * 32768 - 128) / 256)::INT AS x, floor(((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 32768 - 128) / 256)::INT AS y FROM p),
b AS (SELECT id, x + i AS x, y + j AS y FROM c, range(2) AS a(i), range(2) AS b(j) WHERE x + i BETWEEN 0 AND 127 AND y + j BETWEEN 0 AND 127) SELECT id, row_number() OVER (PARTITION BY id ORDER BY t, y, x)::INT AS ord, t, x::INT AS x, y::INT AS y FROM b, h""")
def pip_tile_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


def _plan(spark: SparkSession, d: str) -> DataFrame:
    from pluvia.functions import geo

    frames = src.event_times(spark, d).select((F.floor(F.col("t") / 600) * 600).cast("long").alias("t")).distinct()
    points = _points(spark, d).select("id", geo.region_corner(geo.pixel_x(F.col("lon"), 7)).alias("x"), geo.region_corner(geo.pixel_y(F.col("lat"), 7)).alias("y"))
    return archive.tile_plan(points, frames, 5)


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS k FROM lineitem), a AS (SELECT DISTINCT id, n FROM p), g AS (SELECT DISTINCT id, CASE WHEN id % 5 = 0 AND n = 1 THEN 90 ELSE n END AS n FROM p WHERE NOT (id % 3 = 0 AND n = 2)),
m AS (SELECT coalesce(a.id, g.id) AS id, count(*) FILTER (WHERE g.id IS NULL) AS missing, count(*) FILTER (WHERE a.id IS NULL) AS strange FROM a FULL JOIN g ON a.id = g.id AND a.n = g.n GROUP BY 1) SELECT *, CASE WHEN strange > 0 THEN 'stale' WHEN missing > 0 THEN 'incomplete' ELSE 'complete' END AS state FROM m""")
def pip_checked_uploads(spark: SparkSession, d: str) -> DataFrame:
    li = src.table(spark, d, "lineitem")
    rows = li.count()
    p = src.dealt(li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("n")), "id", rows).distinct()
    given = p.where(~((F.col("id") % 3 == 0) & (F.col("n") == 2))).withColumn("n", F.when((F.col("id") % 5 == 0) & (F.col("n") == 1), 90).otherwise(F.col("n")))
    return archive.checked_upload(p, given, ["n"], 2 * rows)


@query(f"""{_EV}, s AS (SELECT user_id, event_id, sum(round(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC)::BIGINT AS used_size FROM e) SELECT * FROM s WHERE used_size <= 3000""")
def pip_tile_store(spark: SparkSession, d: str) -> DataFrame:
    e = src.event_times(spark, d).select("user_id", "event_id", "t", F.round("value").cast("long").alias("size"))
    return archive.kept_by_size(e, ["user_id"], 3000, [F.desc("t"), F.desc("event_id")]).select("user_id", "event_id", "used_size")


@query(f"""{_EV}, r AS (SELECT DISTINCT event_type AS source, t AS seen, t // 600 * 600 AS newest FROM e), m AS (SELECT *, lag(newest) OVER w AS p, lag(seen) OVER w AS q FROM r WINDOW w AS (PARTITION BY source ORDER BY seen)),
d AS (SELECT source, seen, newest, seen - newest AS delay FROM m WHERE newest - p = 600 AND seen - q <= 900) SELECT *, min(delay) OVER (PARTITION BY source ORDER BY seen ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS lag, seen - delay + 600 + lag AS next_due FROM d""".replace("seen - delay + 600 + lag", "newest + 600 + lag"))
def pip_publish_delays(spark: SparkSession, d: str) -> DataFrame:
    """Delays told by reads at most 900 seconds apart, and when the next frame is due."""
    r = src.event_times(spark, d).select(F.col("event_type").alias("source"), F.col("t").alias("seen"), (F.floor(F.col("t") / 600) * 600).cast("long").alias("newest")).distinct()
    return archive.publish_delays(r, close=900).withColumn("next_due", F.col("newest") + 600 + F.col("lag"))


@query(f"""{_EV}, h AS (SELECT DISTINCT t // 600 * 600 AS t FROM e), a AS (SELECT t, row_number() OVER (ORDER BY t DESC) AS n, t - lag(t) OVER (ORDER BY t) <= 1800 AS linked FROM h) SELECT max(t) AS newest, count(*) FILTER (WHERE n <= 5) AS history, min(t) FILTER (WHERE n <= 5) AS oldest, count(*) FILTER (WHERE linked) AS pairs, count(*) AS frames FROM a""")
def pip_status(spark: SparkSession, d: str) -> DataFrame:
    """The index in one row; times are deduplicated before they meet in a window."""
    from pyspark.sql import Window as W

    h = src.event_times(spark, d).select((F.floor(F.col("t") / 600) * 600).cast("long").alias("t")).distinct()
    newest = h.orderBy(F.desc("t")).limit(5).agg(F.count("*").alias("history"), F.min("t").alias("oldest"))
    # Gaps are looked for day by day; the first frame of a day against the last of the one before.
    w = W.partitionBy(F.floor(F.col("t") / 86400)).orderBy("t")
    linked = h.withColumn("p", F.lag("t").over(w)).agg(F.count_if(F.col("t") - F.col("p") <= 1800).alias("inside"))
    edge = h.groupBy(F.floor(F.col("t") / 86400).alias("d")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    over = edge.join(edge.select((F.col("d") + 1).alias("d"), F.col("hi").alias("before")), "d").agg(F.count_if(F.col("lo") - F.col("before") <= 1800).alias("across"))
    whole = h.agg(F.max("t").alias("newest"), F.count("*").alias("frames"))
    one = lambda a, b: a.join(b, F.lit(True))  # noqa: E731  rows of one
    return one(one(one(whole, newest), linked), over).select("newest", "history", "oldest", (F.col("inside") + F.col("across")).alias("pairs"), "frames")


_CAND = f"""WITH l AS ({src.LATTICE_SQL}), c AS (SELECT x, y, round(avg(dbz), 6) AS score FROM l GROUP BY ALL), h AS (SELECT x, y FROM c WHERE x % 6 = 0 AND y % 6 = 0), r AS (SELECT x, y, x * 3600 AS since FROM c WHERE (x + y) % 5 = 0)"""


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = src.lattice(spark, d).groupBy("x", "y").agg(F.round(F.avg("dbz"), 6).alias("score")).withColumn("y", F.col("y").cast("int"))
    return c, c.where("x % 6 = 0 AND y % 6 = 0").select("x", "y"), c.where("(x + y) % 5 = 0").select("x", "y", (F.col("x") * 3600).alias("at"))


@query(f"{_CAND} SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE abs(h.x - c.x) < 3 AND abs(h.y - c.y) < 3) AND NOT EXISTS (SELECT 1 FROM r WHERE r.x = c.x AND r.y = c.y AND r.since > 36000 - 21600)")
def col_eligible(spark: SparkSession, d: str) -> DataFrame:
    c, held, rejected = _candidates(spark, d)
    return archive.eligible(c, held, rejected, 36000)


@query()
def col_filled(spark: SparkSession, d: str) -> DataFrame:
    c, held, rejected = _candidates(spark, d)
    climate = F.when(F.col("y") % 3 == 0, "tropical").when(F.col("y") % 3 == 1, "subtropical").otherwise("midlat")
    got = archive.filled_regions(archive.eligible(c, held, rejected, 36000).withColumn("climate", climate), held.limit(0), 6)
    return spark.createDataFrame([(i, *p) for i, p in enumerate(got)], "ord int, x int, y int")


@query(f"""{_CAND.replace("WITH l", "WITH l")}, k AS (SELECT k, count(*) FILTER (WHERE x BETWEEN 4 AND 7) AS centre, count(*) AS whole FROM l GROUP BY k) SELECT k, round(centre / 16, 9) AS centre, round(whole / 120, 9) AS mosaic, centre / 16 >= 0.8 AND whole / 120 >= 0.5 AS fits FROM k""")
def col_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Covered shares of a centre and its mosaic."""
    n = src.lattice(spark, d).groupBy("k").agg(F.count_if(F.col("x").between(4, 7)).alias("c"), F.count("*").alias("w"))
    return n.select("k", F.round(F.col("c") / 16, 9).alias("centre"), F.round(F.col("w") / 120, 9).alias("mosaic"), ((F.col("c") / 16 >= 0.8) & (F.col("w") / 120 >= 0.5)).alias("fits"))


@query(f"""{_EV}, r AS (SELECT event_type AS endpoint, CASE WHEN value < 20 THEN 'error' WHEN value < 60 THEN 'missing' ELSE 'ok' END AS outcome, t FROM e) SELECT endpoint, outcome, count(*) AS n, max(t) AS newest FROM r GROUP BY ALL""")
def sup_usage(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("value") < 20, "error").when(F.col("value") < 60, "missing").otherwise("ok")
    return src.event_times(spark, d).groupBy(F.col("event_type").alias("endpoint"), outcome.alias("outcome")).agg(F.count("*").alias("n"), F.max("t").alias("newest"))


@query(f"""{_EV} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS last_minute, sum(event_id % 5 + 1) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)::BIGINT AS weight FROM e""")
def rat_request_stats(spark: SparkSession, d: str) -> DataFrame:
    from pluvia.operators import series

    e = series.sliding_load(src.event_times(spark, d), ["user_id"], 60).withColumnRenamed("load", "last_minute")
    return series.sliding_load(e, ["user_id"], 3600, F.col("event_id") % 5 + 1).select("event_id", "last_minute", F.col("load").alias("weight"))


@query(f"""WITH p AS ({_POINTS}), s AS (SELECT id // 50 AS batch, id, round(lat / 0.25) * 0.25 + 0.0 AS lat, round(lon / 0.25) * 0.25 + 0.0 AS lon FROM p) SELECT batch::BIGINT AS batch, string_agg(printf('%.2f', lat), ',' ORDER BY id) AS latitude, string_agg(printf('%.2f', lon), ',' ORDER BY id) AS longitude, count(*) AS n FROM s GROUP BY batch""")
def src_requests(spark: SparkSession, d: str) -> DataFrame:
    """Comma lists of snapped points, fifty a request."""
    from pluvia.functions import geo

    two = lambda c: F.format_string("%.2f", geo.snap(F.col(c)) + 0.0)
    s = _points(spark, d).select(F.floor(F.col("id") / 50).alias("batch"), F.struct("id", two("lat").alias("lat"), two("lon").alias("lon")).alias("p"))
    listed = s.groupBy("batch").agg(F.sort_array(F.collect_list("p")).alias("p"), F.count("*").alias("n"))
    return listed.select("batch", F.array_join("p.lat", ",").alias("latitude"), F.array_join("p.lon", ",").alias("longitude"), "n")


@query("""WITH a AS (SELECT o_custkey % 50 AS point, o_orderkey AS k, floor(epoch(o_orderdate))::BIGINT // 86400 AS day, o_totalprice AS v FROM orders), x AS (SELECT point, day, min(v) AS v FROM a WHERE k % 2 = 0 GROUP BY ALL), y AS (SELECT point, day + 3000 AS day, max(v) AS v FROM a WHERE k % 2 = 1 GROUP BY ALL)
SELECT point, day * 86400 AS t, v FROM (SELECT * FROM x UNION ALL SELECT * FROM y)""")
def src_appended_series(spark: SparkSession, d: str) -> DataFrame:
    """Two stretches of daily series, one behind the other."""
    day = F.floor(src.epoch(F.col("o_orderdate")) / 86400).cast("long")
    o = src.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("point"), F.col("o_orderkey").alias("k"), day.alias("day"), F.col("o_totalprice").alias("v"))
    x = o.where("k % 2 = 0").groupBy("point", "day").agg(F.min("v").alias("v"))
    y = o.where("k % 2 = 1").groupBy("point", (F.col("day") + 3000).alias("day")).agg(F.max("v").alias("v"))
    return archive.union_all([x, y]).select("point", (F.col("day") * 86400).alias("t"), "v")


@query("""WITH p AS (SELECT s_suppkey AS region, round(s_acctbal / 130, 4) AS lat FROM supplier) SELECT region, lat, row_number() OVER (ORDER BY region)::INT AS ord FROM p""")
def src_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions in the order in which they were first seen; ids are dense from 0 here, so no window is needed."""
    return src.table(spark, d, "supplier").select(F.col("s_suppkey").alias("region"), F.round(F.col("s_acctbal") / 130, 4).alias("lat"), (F.col("s_suppkey") + 1).cast("int").alias("ord"))
