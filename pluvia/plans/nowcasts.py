"""Queries of the nowcast, rain-cell, text, report and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.functions import text
from pluvia.operators import cells, nowcast, verification
from pluvia.plans.registry import _F, _FR, _L, _RATE, query
from pluvia.session import shared_dir
from pluvia.sources import driver_tables as src
from pluvia.streaming import collector

_SERIES = "SELECT l_orderkey AS id, (l_linenumber - 1)::INT AS minute, floor(l_quantity) * 1.1 AS dbz FROM lineitem"


@query(f"""WITH s AS ({_SERIES}), r AS (SELECT id, minute, dbz, dbz AS v FROM s)
SELECT id, coalesce(min(minute) FILTER (WHERE dbz >= 20), -1) AS arrival, coalesce(min(minute) FILTER (WHERE dbz >= 40), -1) AS heavy_arrival,
round(coalesce(sum({_RATE} / 60) FILTER (WHERE minute > 0), 0), 6) AS accum_mm, max(dbz) AS peak, arrival = 0 AS raining_now FROM r GROUP BY id""")
def now_summary(spark: SparkSession, d: str) -> DataFrame:
    li = src.table(spark, d, "lineitem")
    series = li.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).cast("int").alias("minute"), (F.floor("l_quantity").cast("double") * 1.1).alias("dbz"))
    return nowcast.summary(series, ["id"]).withColumn("accum_mm", F.round("accum_mm", 6))


@query(f"""{_L}, p AS (SELECT k, x * 1000 + y AS id, m::INT AS minute, x - m * ((k % 5 - 2) / 8) AS fx, y - m * ((k % 3 - 1) / 4) AS fy FROM l, range(0, 61, 10) AS r(m) WHERE dbz >= 30),
c AS (SELECT k, id, minute, floor(fx) + i AS x, floor(fy) + j AS y, CASE WHEN i = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END * CASE WHEN j = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END AS w FROM p, range(2) AS a(i), range(2) AS b(j))
SELECT c.k, id, minute, round(sum(w * coalesce(dbz, -32)), 6) AS dbz FROM c LEFT JOIN l ON l.k = c.k AND l.x = c.x AND l.y = c.y GROUP BY ALL""")
def now_advected(spark: SparkSession, d: str) -> DataFrame:
    lattice = src.lattice(spark, d)
    points = lattice.where("dbz >= 30").select("k", (F.col("x") * 1000 + F.col("y")).alias("id"), "x", "y", ((F.col("k") % 5 - 2) / 8).alias("dx"), ((F.col("k") % 3 - 1) / 4).alias("dy"))
    return nowcast.advected(lattice, points, 60, 10)


_AREAS = f"""{_L}, s AS (SELECT k, x, y, dbz FROM l WHERE dbz >= 30),
r AS (SELECT k, x, y, y * 1000 + x AS root FROM s UNION SELECT s.k, s.x, s.y, r.root FROM r JOIN s ON s.k = r.k AND abs(s.x - r.x) + abs(s.y - r.y) = 1),
c AS (SELECT s.k, s.x, s.y, s.dbz, min(r.root) AS root FROM s JOIN r ON r.k = s.k AND r.x = s.x AND r.y = s.y GROUP BY ALL),
p AS (SELECT *, (dense_rank() OVER (PARTITION BY k ORDER BY root) - 1)::INT AS cell FROM c)""".replace("WITH", "WITH RECURSIVE", 1)


@query(f"""{_AREAS} SELECT k, cell, count(*) AS area, max(dbz) AS peak, round(sum((dbz - 29) * x) / sum(dbz - 29), 6) AS cx, round(sum((dbz - 29) * y) / sum(dbz - 29), 6) AS cy,
min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM p GROUP BY k, cell HAVING count(*) >= 2""")
def cel_segments(spark: SparkSession, d: str) -> DataFrame:
    found = cells.segments(cells.labelled(src.lattice(spark, d)), least=2)
    return found.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query(f"""{_AREAS}, n AS (SELECT k, cell, count(*) AS area FROM p GROUP BY ALL), m AS (SELECT b.k, a.cell AS a, b.cell AS b, count(*) AS both_ FROM p AS a JOIN p AS b ON b.k = a.k + 1 AND b.x = a.x AND b.y = a.y GROUP BY ALL)
SELECT m.k, m.a, m.b, both_ AS "both" FROM m JOIN n AS x ON x.k = m.k - 1 AND x.cell = m.a JOIN n AS y ON y.k = m.k AND y.cell = m.b WHERE both_ >= 0.3 * least(x.area, y.area)""")
def cel_overlap_links(spark: SparkSession, d: str) -> DataFrame:
    return cells.overlap_links(cells.labelled(src.lattice(spark, d)))


@query("""WITH e AS (SELECT event_id, value / 8 AS e, (event_id % 97) / 97 AS p1, (event_id % 89) / 89 AS p2, (event_id % 83) / 83 AS p3 FROM events),
c AS (SELECT event_id, e, p1, least(p1, p2) AS p2, least(p1, p2, p3) AS p3 FROM e)
SELECT event_id, CASE WHEN p3 >= 0.4 THEN greatest(e, 40) WHEN p2 >= 0.5 THEN CASE WHEN e >= 40 THEN 39.99 ELSE greatest(e, 30) END WHEN p1 >= 0.6 THEN CASE WHEN e >= 30 THEN 29.99 ELSE greatest(e, 20) END ELSE least(e, 19.99) END AS dbz,
CASE WHEN p1 <= 0.2 THEN 0.05 WHEN p1 <= 0.5 THEN 0.05 + (p1 - 0.2) / 0.3 * 0.3 WHEN p1 <= 0.9 THEN 0.35 + (p1 - 0.5) / 0.4 * 0.6 ELSE 0.95 END AS calibrated FROM c""")
def ml_band_move(spark: SparkSession, d: str) -> DataFrame:
    e = src.table(spark, d, "events")
    ps = nowcast.capped([(F.col("event_id") % m) / m for m in (97, 89, 83)])
    moved = nowcast.move_into_band(F.col("value") / 8, ps, [0.6, 0.5, 0.4], [20.0, 30.0, 40.0])
    return e.select("event_id", moved.alias("dbz"), nowcast.on_knots(ps[0], [0.2, 0.5, 0.9], [0.05, 0.35, 0.95]).alias("calibrated"))


@query(r"""WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name ELSE round(c_acctbal / 100, 2)::VARCHAR || CASE c_custkey % 4 WHEN 1 THEN ', ' WHEN 2 THEN ';' ELSE ' ' END || (c_custkey % 400 - 200)::VARCHAR END AS text FROM customer),
m AS (SELECT id, text, TRY_CAST(regexp_extract(text, '^\s*([-+]?\d+(?:\.\d+)?)\s*[,; ]\s*([-+]?\d+(?:\.\d+)?)\s*$', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(text, '^\s*([-+]?\d+(?:\.\d+)?)\s*[,; ]\s*([-+]?\d+(?:\.\d+)?)\s*$', 2) AS DOUBLE) AS b FROM t)
SELECT id, CASE WHEN a BETWEEN -85 AND 85 AND b BETWEEN -180 AND 180 THEN a END AS lat, CASE WHEN a BETWEEN -85 AND 85 AND b BETWEEN -180 AND 180 THEN b END AS lon FROM m""")
def txt_coordinates(spark: SparkSession, d: str) -> DataFrame:
    c, k = src.table(spark, d, "customer"), F.col("c_custkey")
    between = F.when(k % 4 == 1, ", ").when(k % 4 == 2, ";").otherwise(" ")
    made = F.when(k % 4 == 0, F.col("c_name")).otherwise(F.concat(F.round(F.col("c_acctbal") / 100, 2).cast("string"), between, (k % 400 - 200).cast("string")))
    lat, lon = text.coordinates(made)
    return c.select(k.alias("id"), lat.alias("lat"), lon.alias("lon"))


@query("""SELECT s_suppkey AS id, CASE WHEN n_name = r_name THEN '' WHEN lower(n_name) = lower(s_name) THEN r_name ELSE n_name || ', ' || r_name END AS label
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def txt_joined_parts(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (src.table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(F.col("s_suppkey").alias("id"), text.joined_parts(F.col("s_name"), F.array("n_name", F.lower("n_name"), F.lit(" "), "s_name", "r_name")).alias("label"))


@query(f"""{_F}, s AS (SELECT variant, lead, round(count(*) FILTER (WHERE fc >= 20 AND obs >= 20) / nullif(count(*) FILTER (WHERE fc >= 20 OR obs >= 20), 0), 9) AS csi FROM f GROUP BY ALL)
SELECT variant, {", ".join(f"max(csi) FILTER (WHERE lead = {m}) AS csi_{m}" for m in (10, 20, 30, 40, 50, 60))} FROM s GROUP BY variant""")
def rep_metric_by_lead(spark: SparkSession, d: str) -> DataFrame:
    leads = (10, 20, 30, 40, 50, 60)
    s = verification.lead_scores(src.forecasts(spark, d)).where("lead IS NOT NULL")
    return s.groupBy("variant").pivot("lead", list(leads)).agg(F.max("csi")).select("variant", *[F.col(str(m)).alias(f"csi_{m}") for m in leads])


@query(f"""{_FR}, r AS (SELECT region, count(*) AS frames FROM (SELECT region, t - 600 * row_number() OVER (PARTITION BY region ORDER BY t) AS g FROM f) GROUP BY region, g)
SELECT region, sum(frames)::BIGINT AS frames, count(*) AS runs, max(frames) AS longest FROM r GROUP BY ROLLUP (region)""")
def rep_inventory(spark: SparkSession, d: str) -> DataFrame:
    runs = verification.runs(src.frames(spark, d), ["region"], 600)
    return runs.rollup("region").agg(F.sum("frames").alias("frames"), F.count("*").alias("runs"), F.max("frames").alias("longest"))


@query("""SELECT l_orderkey AS id, sha256(string_agg(l_linenumber::VARCHAR || ':' || l_suppkey::VARCHAR || ':' || sha256(l_partkey::VARCHAR) || chr(10), '' ORDER BY l_linenumber, l_suppkey, l_partkey)) AS hash FROM lineitem GROUP BY l_orderkey""")
def pip_content_hash(spark: SparkSession, d: str) -> DataFrame:
    """A region's tiles are a bounded few, so a group's list is too."""
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_suppkey").cast("string"), F.lit(":"), F.sha2(F.col("l_partkey").cast("string"), 256), F.lit("\n"))
    rows = src.table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_suppkey", "l_partkey", line.alias("s")).alias("r"))
    listed = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list("r")).alias("r"))
    return listed.select("id", F.sha2(F.array_join(F.col("r.s"), ""), 256).alias("hash"))


@query(f"""{_L} SELECT k, x // 4 AS cx, y // 4 AS cy, round(count(*) FILTER (WHERE dbz >= 20) / 16, 9) AS score FROM l GROUP BY ALL HAVING count(*) >= 8 AND count(*) FILTER (WHERE dbz >= 20) / 16 >= 0.02""")
def col_rank_cells(spark: SparkSession, d: str) -> DataFrame:
    block = lambda c: F.floor(F.col(c) / 4).cast("long").alias(f"c{c}")
    score = F.count_if(F.col("dbz") >= 20) / 16
    return src.lattice(spark, d).groupBy("k", block("x"), block("y")).agg(F.count("*").alias("n"), F.round(score, 9).alias("score")).where("n >= 8 AND score >= 0.02").drop("n")


@query("""WITH r AS (SELECT user_id, event_type, max(epoch(ts)::BIGINT * 1000000 + event_id) AS seen FROM (SELECT user_id, event_type, event_id, date_trunc('second', ts) AS ts FROM events) GROUP BY ALL)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC)::INT AS place FROM r QUALIFY place <= 3""")
def cli_recent_places(spark: SparkSession, d: str) -> DataFrame:
    r = src.event_times(spark, d).groupBy("user_id", "event_type").agg(F.max(F.col("t") * 1000000 + F.col("event_id")).alias("seen"))
    return r.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("seen")))).where("place <= 3").drop("seen")


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What the stream gives for all that is there now, through files in the shared folder."""
    at = _scratch(spark)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = src.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("""SELECT (user_id % 12)::INT AS region, floor(epoch(ts))::BIGINT AS t, max(value > 100) AS rainy FROM events GROUP BY ALL""")
def stm_rain_state(spark: SparkSession, d: str) -> DataFrame:
    """The frames as the stateful collector passes them on (its own columns are tested apart)."""
    e = _events_stream(spark, d).select((F.col("user_id") % 12).cast("int").alias("region"), src.epoch(F.col("ts")).alias("t"), (F.col("value") > 100).alias("rainy"))
    return _drained(spark, collector.rain_state(e)).groupBy("region", "t").agg(F.max("rainy").alias("rainy"))
