"""Queries of tile algebra, place text, addresses and what a client derives from a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions import geo, text
from pluvia.functions.radar import rain_rate
from pluvia.operators import places
from pluvia.plans.registry import ORACLES, _POINTS, _RATE, _points, query
from pluvia.sources import driver_tables as src

_X = "floor((lon + 180) / 360 * 128)::INT"
_Y = "floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 128)::INT"
_TILES = f"WITH p AS ({_POINTS}), t AS (SELECT id, {_X} AS tx, {_Y} AS ty FROM p)"


def _tiles(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    return p.select("id", F.floor(geo.pixel_x(F.col("lon"), 7) / 256).cast("int").alias("tx"), F.floor(geo.pixel_y(F.col("lat"), 7) / 256).cast("int").alias("ty"))


@query(f"""{_TILES} SELECT id, 'block' AS kind, (tx + i)::INT AS x, (ty + j)::INT AS y FROM t, range(2) AS a(i), range(2) AS b(j) WHERE tx + i BETWEEN 0 AND 127 AND ty + j BETWEEN 0 AND 127
UNION ALL SELECT id, 'mosaic', (tx + i)::INT, (ty + j)::INT FROM t, range(-1, 2) AS a(i), range(-1, 2) AS b(j)""")
def geo_tile_squares(spark: SparkSession, d: str) -> DataFrame:
    t = _tiles(spark, d)
    part = lambda kind, low, high: t.select("id", F.lit(kind).alias("kind"), "tx", "ty", F.explode(geo.square(low, high)).alias("o")).select("id", "kind", (F.col("tx") + F.col("o.i")).alias("x"), (F.col("ty") + F.col("o.j")).alias("y"))
    return part("block", 0, 1).where(geo.in_world(F.col("x"), F.col("y"), 7)).unionByName(part("mosaic", -1, 1))


@query(f"""{_TILES} SELECT id, round(degrees(atan(sinh(pi() * (1 - 2 * (ty + 0.5) / 128)))), 6) AS lat, round((tx + 0.5) / 128 * 360 - 180, 6) AS lon, (tx * 256 + 37) / 4 AS sat_x, 300 - tx AS local_x FROM t""")
def geo_tile_centres(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = geo.tile_centre(F.col("tx"), F.col("ty"), 7)
    return _tiles(spark, d).select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), geo.satellite_pixel(F.col("tx") * 256 + 37).alias("sat_x"), (F.lit(300) - F.col("tx")).alias("local_x"))


@query(f"""{_TILES}, r AS (SELECT id, floor(((tx - 1) * 64 - 20) / 256) AS x0, floor(((tx + 2) * 64 + 19) / 256) AS x1, floor(((ty - 1) * 64 - 20) / 256) AS y0, floor(((ty + 2) * 64 + 19) / 256) AS y1 FROM t)
SELECT DISTINCT id, (((i % 32) + 32) % 32)::INT AS x, j::INT AS y FROM r, range(-4, 40) AS a(i), range(-4, 40) AS b(j) WHERE i BETWEEN x0 AND x1 AND j BETWEEN y0 AND y1 AND j BETWEEN 0 AND 31""")
def geo_satellite_tiles(spark: SparkSession, d: str) -> DataFrame:
    return _tiles(spark, d).select("id", F.explode(geo.satellite_tiles(F.col("tx"), F.col("ty"), 20)).alias("t")).select("id", "t.x", "t.y")


_TEXTS = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN c_name ELSE (c_acctbal / 100)::VARCHAR END AS a, (c_custkey % 500 - 250)::VARCHAR AS b FROM customer"


@query(f"""WITH t AS ({_TEXTS}), n AS (SELECT id, TRY_CAST(a AS DOUBLE) AS a, TRY_CAST(b AS DOUBLE) AS b FROM t)
SELECT id, CASE WHEN a BETWEEN -85 AND 85 AND b BETWEEN -180 AND 180 THEN round(a, 4) END AS lat, CASE WHEN a BETWEEN -85 AND 85 AND b BETWEEN -180 AND 180 THEN round(b, 4) END AS lon FROM n""")
def geo_parsed_places(spark: SparkSession, d: str) -> DataFrame:
    c, k = src.table(spark, d, "customer"), F.col("c_custkey")
    lat, lon = geo.parsed_place(F.when(k % 5 == 0, F.col("c_name")).otherwise((F.col("c_acctbal") / 100).cast("string")), (k % 500 - 250).cast("string"))
    return c.select(k.alias("id"), lat.alias("lat"), lon.alias("lon"))


def _crc_sql(x: str) -> str:
    """CRC-32 of an ASCII text in SQL, bit by bit, from its definition."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    eight = "c"
    for _ in range(8):
        eight = f"list_transform([{eight}], lambda c: {step})[1]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i::INT, 1))::BIGINT)), lambda a, b: list_transform([xor(a, b)], lambda c: {eight})[1]), 4294967295)"


@query(f"""WITH p AS ({_POINTS}), k AS (SELECT id, floor(lat / 15)::INT || ',' || floor(lon / 15)::INT AS k FROM p) SELECT id, ({_crc_sql("k")} % 2)::INT AS fold FROM k""")
def geo_fold_all(spark: SparkSession, d: str) -> DataFrame:
    return _points(spark, d).select("id", geo.fold(F.col("lat"), F.col("lon")).alias("fold"))


ORACLES["geo_fold"] = ORACLES["geo_fold_all"]  # the same by its older name


_URLS = """SELECT c_custkey AS id, CASE c_custkey % 6
WHEN 0 THEN 'https://maps.example/maps/place/Ha+Noi+' || c_custkey || '/@' || (c_custkey % 80) || '.5,' || (c_custkey % 170) || ',15z'
WHEN 1 THEN 'https://maps.example/?q=' || (c_custkey % 80) || '.25%2C' || (c_custkey % 170) || '.75'
WHEN 2 THEN 'https://maps.example/maps/place/X/@1,2,3z/data=!3d' || (c_custkey % 80) || '.125!4d-' || (c_custkey % 170) || '.5'
WHEN 3 THEN 'https://maps.example/search?query=Pho%20' || c_custkey || '&hl=en'
WHEN 4 THEN 'https://maps.example/dir?daddr=' || (c_custkey % 120) || ',10&ll=1,2' ELSE c_name END AS u FROM customer"""


def _urls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s = lambda m: (k % m).cast("string")
    at = (
        F.when(k % 6 == 0, F.concat(F.lit("https://maps.example/maps/place/Ha+Noi+"), k.cast("string"), F.lit("/@"), s(80), F.lit(".5,"), s(170), F.lit(",15z")))
        .when(k % 6 == 1, F.concat(F.lit("https://maps.example/?q="), s(80), F.lit(".25%2C"), s(170), F.lit(".75")))
        .when(k % 6 == 2, F.concat(F.lit("https://maps.example/maps/place/X/@1,2,3z/data=!3d"), s(80), F.lit(".125!4d-"), s(170), F.lit(".5")))
        .when(k % 6 == 3, F.concat(F.lit("https://maps.example/search?query=Pho%20"), k.cast("string"), F.lit("&hl=en")))
        .when(k % 6 == 4, F.concat(F.lit("https://maps.example/dir?daddr="), s(120), F.lit(",10&ll=1,2")))
        .otherwise(F.col("c_name"))
    )
    return src.table(spark, d, "customer").select(k.alias("id"), at.alias("u"))


@query(f"""WITH u AS ({_URLS}) SELECT id, CASE id % 6 WHEN 0 THEN id % 80 + 0.5 WHEN 1 THEN id % 80 + 0.25 WHEN 2 THEN id % 80 + 0.125 WHEN 4 THEN 1 END::DOUBLE AS lat,
CASE id % 6 WHEN 0 THEN id % 170 WHEN 1 THEN id % 170 + 0.75 WHEN 2 THEN -(id % 170 + 0.5) WHEN 4 THEN 2 END::DOUBLE AS lon,
CASE id % 6 WHEN 0 THEN 'Ha Noi ' || id WHEN 2 THEN 'X' WHEN 3 THEN 'Pho ' || id END AS name, CASE WHEN id % 6 = 5 THEN 'words' ELSE 'link' END AS kind FROM u""")
def txt_map_urls(spark: SparkSession, d: str) -> DataFrame:
    at = text.map_location(F.col("u"))
    # Of two coordinate keys in one query, the order of PLACE_KEYS decides: ll stands before daddr.
    return _urls(spark, d).select("id", at["lat"].alias("lat"), at["lon"].alias("lon"), text.place_name(F.col("u")).alias("name"), text.input_kind(F.col("u")).alias("kind"))


_NAMED = "SELECT o_custkey AS answer, o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'Pho Hue' WHEN 1 THEN 'pho  hue' ELSE o_orderpriority END AS name, 21 + (o_orderkey % 7) / 1000 AS lat, 105.8 + (o_orderkey % 5) / 1000 AS lon FROM orders"


@query(f"""WITH RECURSIVE p AS (SELECT *, lower(regexp_replace(name, '\\s+', '', 'g')) AS key FROM ({_NAMED})), n AS (SELECT *, row_number() OVER (PARTITION BY answer, key ORDER BY ord) AS i FROM p),
f AS (SELECT answer, key, 1 AS i, [{{'ord': ord, 'lat': lat, 'lon': lon}}] AS kept FROM n WHERE i = 1 UNION ALL SELECT n.answer, n.key, n.i::INT, CASE WHEN len(list_filter(f.kept, lambda q:
2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(q.lat - n.lat) / 2), 2) + cos(radians(n.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - n.lon) / 2), 2)))) < 300)) > 0 THEN f.kept ELSE list_append(f.kept, {{'ord': n.ord, 'lat': n.lat, 'lon': n.lon}}) END
FROM f JOIN n ON n.answer = f.answer AND n.key = f.key AND n.i = f.i + 1), l AS (SELECT answer, key, arg_max(kept, i) AS kept FROM f GROUP BY ALL), k AS (SELECT answer, unnest(kept).ord AS ord FROM l)
SELECT k.answer, k.ord, p.name FROM k JOIN p ON p.answer = k.answer AND p.ord = k.ord""")
def txt_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    o, k = src.table(spark, d, "orders"), F.col("o_orderkey")
    named = o.select(F.col("o_custkey").alias("answer"), k.alias("ord"), F.when(k % 3 == 0, "Pho Hue").when(k % 3 == 1, "pho  hue").otherwise(F.col("o_orderpriority")).alias("name"), (F.lit(21) + (k % 7) / 1000).alias("lat"), (F.lit(105.8) + (k % 5) / 1000).alias("lon"))
    return places.without_near_duplicates(named, ["answer"]).select("answer", "ord", "name")


_GAZ = "SELECT s_name AS name, round(s_acctbal / 130, 4) AS lat, round((s_suppkey * 7919) % 3600 / 10.0 - 180, 4) AS lon FROM supplier"


@query(f"""WITH p AS ({_POINTS}), g AS ({_GAZ}), d AS (SELECT p.id, g.name, round(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - p.lon) / 2), 2)))), 3) AS metres
FROM p JOIN g ON abs(floor(p.lat / 5) - floor(g.lat / 5)) <= 1 AND abs(floor(p.lon / 5) - floor(g.lon / 5)) <= 1), b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY metres, name) = 1)
SELECT p.id, coalesce(b.name, printf('%.5f, %.5f', p.lat, p.lon)) AS name, b.metres FROM p LEFT JOIN b ON b.id = p.id""")
def txt_reverse(spark: SparkSession, d: str) -> DataFrame:
    s = src.table(spark, d, "supplier")
    gaz = s.select(F.col("s_name").alias("name"), F.round(F.col("s_acctbal") / 130, 4).alias("lat"), F.round((F.col("s_suppkey") * 7919) % 3600 / 10.0 - 180, 4).alias("lon"))
    return places.nearest(_points(spark, d), gaz)


@query(r"""WITH q AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '  a  ' WHEN 1 THEN ' ' || c_name || '   x ' WHEN 2 THEN '' ELSE repeat('b', (c_custkey % 9)::INT) || chr(10) || 'c' END AS q, CASE c_custkey % 3 WHEN 0 THEN 'VN, us ,,LA' WHEN 1 THEN '' ELSE 'fr' END AS l, c_mktsegment AS m FROM customer),
c AS (SELECT *, trim(regexp_replace(q, '\s+', ' ', 'g')) AS t FROM q)
SELECT id, t AS query, length(t) >= 3 AS suggests, list_filter(list_transform(string_split(l, ','), lambda x: lower(trim(x))), lambda x: x <> '')::VARCHAR AS preferred, list_contains(list_transform(string_split(l, ','), lambda x: lower(trim(x))), 'us') AS prefers_us FROM c""")
def txt_queries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    q = F.when(k % 4 == 0, "  a  ").when(k % 4 == 1, F.concat(F.lit(" "), F.col("c_name"), F.lit("   x "))).when(k % 4 == 2, "").otherwise(F.concat(F.repeat(F.lit("b"), (k % 9).cast("int")), F.lit("\nc")))
    listed = text.preferred(F.when(k % 3 == 0, "VN, us ,,LA").when(k % 3 == 1, "").otherwise("fr"))
    t = text.collapsed(q)
    return src.table(spark, d, "customer").select(k.alias("id"), t.alias("query"), (F.char_length(t) >= 3).alias("suggests"), F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("preferred"), F.array_contains(listed, "us").alias("prefers_us"))


_REQUESTS = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || (event_id % 200) WHEN 1 THEN '172.16.4.9' WHEN 2 THEN '8.8.' || (event_id % 256) || '.1' ELSE 'bad' END AS peer,
CASE event_id % 3 WHEN 0 THEN '1.2.3.4, ' || (event_id % 250) || '.' || (user_id % 256) || '.0.7' WHEN 1 THEN 'x' END AS xff, CASE event_id % 5 WHEN 0 THEN 'VN' WHEN 1 THEN 'XXX' END AS header FROM events"""
_IP = lambda x: f"(split_part({x}, '.', 1)::BIGINT * 16777216 + split_part({x}, '.', 2)::BIGINT * 65536 + split_part({x}, '.', 3)::BIGINT * 256 + split_part({x}, '.', 4)::BIGINT)"


@query(f"""WITH r AS ({_REQUESTS}), c AS (SELECT *, CASE WHEN event_kind IN (0, 1) AND id % 3 = 0 THEN trim(split_part(xff, ',', 2)) ELSE peer END AS ip FROM (SELECT *, id % 4 AS event_kind FROM r)),
n AS (SELECT *, CASE WHEN ip <> 'bad' THEN {_IP("ip")} END AS n FROM c), g AS (SELECT n_nationkey::BIGINT * 171798691 AS low, n_nationkey::BIGINT * 171798691 + 100000000 AS high, upper(substr(n_name, 1, 2)) AS country FROM nation)
SELECT id, ip, CASE WHEN length(header) = 2 THEN header ELSE g.country END AS country FROM n LEFT JOIN g ON n.n BETWEEN g.low AND g.high""")
def api_request_country(spark: SparkSession, d: str) -> DataFrame:
    e, k = src.table(spark, d, "events"), F.col("event_id")
    s = lambda c, m: (c % m).cast("string")
    peer = F.when(k % 4 == 0, F.concat(F.lit("10.0.0."), s(k, 200))).when(k % 4 == 1, "172.16.4.9").when(k % 4 == 2, F.concat(F.lit("8.8."), s(k, 256), F.lit(".1"))).otherwise("bad")
    xff = F.when(k % 3 == 0, F.concat(F.lit("1.2.3.4, "), s(k, 250), F.lit("."), s(F.col("user_id"), 256), F.lit(".0.7"))).when(k % 3 == 1, "x")
    asked = e.select(k.alias("id"), places.client_address(peer, xff).alias("ip"), F.when(k % 5 == 0, "VN").when(k % 5 == 1, "XXX").alias("header"))
    low = F.col("n_nationkey").cast("long") * 171798691
    ranges = src.table(spark, d, "nation").select(low.alias("low"), (low + 100000000).alias("high"), F.upper(F.substring("n_name", 1, 2)).alias("country"))
    found = places.countries(asked.select("id", places.ip_number(F.col("ip")).alias("n")), ranges)
    return asked.join(found, "id").select("id", "ip", F.when(F.length("header") == 2, F.col("header")).otherwise(F.col("country")).alias("country"))


@query("""WITH v AS (SELECT user_id, event_type AS place, floor(epoch(ts))::BIGINT AS seen FROM events), n AS (SELECT user_id, place, max(seen) AS seen FROM v GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, place)::INT AS position FROM n QUALIFY position <= 10""")
def cli_latest_places(spark: SparkSession, d: str) -> DataFrame:
    v = src.event_times(spark, d).select("user_id", F.col("event_type").alias("place"), F.col("t").alias("seen"))
    return places.latest_places(v, ["user_id"])


_S = "SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey AS id, (l_linenumber - 1)::INT AS minute, min(floor(l_quantity) * 1.1) AS dbz FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).cast("int").alias("minute")).agg(F.min(F.floor("l_quantity").cast("double") * 1.1).alias("dbz"))


@query(f"""WITH s AS ({_S}), n AS (SELECT id, max(minute) AS last, least(greatest(0, (id % 6)::INT), max(minute)) AS m0 FROM s GROUP BY id), x AS (SELECT s.*, last, m0 FROM s JOIN n USING (id)),
a AS (SELECT id, any_value(last) AS last, any_value(m0) AS m0, coalesce(min(minute) FILTER (WHERE minute >= m0 AND dbz >= 20), -1) AS arrival, coalesce(min(minute) FILTER (WHERE minute >= m0 AND dbz >= 40), -1) AS heavy,
round(coalesce(sum({_RATE.replace("v <", "dbz <").replace("(v,", "(dbz,")} / 60) FILTER (WHERE minute > m0), 0), 6) AS accum, coalesce(min(minute) FILTER (WHERE minute > m0 AND dbz < 20), -1) AS stop,
greatest(coalesce(max(dbz) FILTER (WHERE minute >= m0), -32), -32) AS peak FROM x GROUP BY id), b AS (SELECT a.*, coalesce((SELECT min(minute) FROM s WHERE s.id = a.id AND minute > a.arrival AND dbz < 20), -1) AS ends FROM a)
SELECT id, m0, arrival, heavy, accum, stop, peak, CASE WHEN heavy = m0 THEN 'heavy' WHEN arrival = m0 THEN 'raining' WHEN arrival >= 0 THEN 'arriving' ELSE 'dry' END AS status, arrival >= 0 AND heavy < 0 AND peak < 30 AS maybe,
CASE WHEN arrival < 0 THEN NULL WHEN ends < 0 THEN CASE WHEN last - arrival < 5 THEN 'open' ELSE 'past' END WHEN ends - arrival < 5 THEN 'brief' ELSE 'until' END AS span, CASE WHEN last > m0 THEN round(accum * 60 / (last - m0), 6) ELSE 0 END AS hourly FROM b""")
def cli_forecast_now(spark: SparkSession, d: str) -> DataFrame:
    """What a client shows of a forecast that is some minutes old."""
    s = _series(spark, d)
    n = s.groupBy("id").agg(F.max("minute").alias("last")).withColumn("m0", F.least((F.col("id") % 6).cast("int"), F.col("last")))
    x = s.join(n, "id")
    first = lambda cond: F.coalesce(F.min(F.when(cond, F.col("minute"))), F.lit(-1))
    on = F.col("minute") >= F.col("m0")
    a = x.groupBy("id", "last", "m0").agg(
        first(on & (F.col("dbz") >= 20)).alias("arrival"), first(on & (F.col("dbz") >= 40)).alias("heavy"), F.round(F.coalesce(F.sum(F.when(F.col("minute") > F.col("m0"), rain_rate(F.col("dbz")) / 60)), F.lit(0.0)), 6).alias("accum"),
        first((F.col("minute") > F.col("m0")) & (F.col("dbz") < 20)).alias("stop"), F.greatest(F.coalesce(F.max(F.when(on, F.col("dbz"))), F.lit(-32.0)), F.lit(-32.0)).alias("peak"), F.collect_list(F.when(F.col("dbz") < 20, F.col("minute"))).alias("dry"),
    )
    # A series is an hour long at most, so its dry minutes are a short list.
    ends = F.coalesce(F.array_min(F.filter("dry", lambda m: m > F.col("arrival"))), F.lit(-1))
    arrival, last = F.col("arrival"), F.col("last")
    brief = lambda n_, yes, no: F.when(n_ < 5, yes).otherwise(no)
    span = F.when(arrival < 0, None).when(F.col("ends") < 0, brief(last - arrival, "open", "past")).otherwise(brief(F.col("ends") - arrival, "brief", "until"))
    status = F.when(F.col("heavy") == F.col("m0"), "heavy").when(arrival == F.col("m0"), "raining").when(arrival >= 0, "arriving").otherwise("dry")
    hourly = F.when(last > F.col("m0"), F.round(F.col("accum") * 60 / (last - F.col("m0")), 6)).otherwise(0.0)
    return a.withColumn("ends", ends).select("id", "m0", "arrival", "heavy", "accum", "stop", "peak", status.alias("status"), ((arrival >= 0) & (F.col("heavy") < 0) & (F.col("peak") < 30)).alias("maybe"), span.alias("span"), hourly.alias("hourly"))


@query("""WITH e AS (SELECT event_id AS id, floor(epoch(ts))::BIGINT AS now, floor(epoch(ts))::BIGINT // 600 * 600 + 600 + event_id % 900 - 400 AS due, value FROM events)
SELECT id, CASE WHEN now < due THEN (due - now) * 1000 WHEN now < due + 600 THEN 15000 ELSE 60000 END AS delay_ms, CASE WHEN due - now > 60 THEN 60 WHEN due - now < 15 THEN 15 ELSE due - now END AS max_age, least(60, greatest(due - now, 30)) AS shared_age, now >= due AS overdue,
CASE WHEN id % 7 = 0 THEN 100 ELSE least(greatest((id % 900), 1), 500) END AS limit_, value / 5 < 5 OR (id % 11) / 10 < 0.2 AS still FROM e""")
def cli_poll_delays(spark: SparkSession, d: str) -> DataFrame:
    """Clocks of a client and of the index: next poll, cache ages, limits, still motion."""
    e = src.event_times(spark, d).select(F.col("event_id").alias("id"), F.col("t").alias("now"), (F.floor(F.col("t") / 600) * 600 + 600 + F.col("event_id") % 900 - 400).cast("long").alias("due"), "value")
    left = F.col("due") - F.col("now")
    delay = F.when(left > 0, left * 1000).when(left > -600, 15000).otherwise(60000)
    limit = F.when(F.col("id") % 7 == 0, 100).otherwise(F.least(F.greatest(F.col("id") % 900, F.lit(1)), F.lit(500)))
    return e.select("id", delay.alias("delay_ms"), F.greatest(F.lit(15), F.least(F.lit(60), left)).alias("max_age"), F.least(F.lit(60), F.greatest(left, F.lit(30))).alias("shared_age"), (left <= 0).alias("overdue"), limit.alias("limit_"), ((F.col("value") / 5 < 5) | ((F.col("id") % 11) / 10 < 0.2)).alias("still"))


@query("""WITH p AS (SELECT p_partkey AS id, 't/' || p_size || '/' || p_partkey AS path FROM part) SELECT id, 'https://h' || '/' || path || '/256/7/' || (id % 128) || '/' || (id % 99) || '/2/0_0.png' AS tile_url, 'https://h/' || path || '/256/{z}/{x}/{y}/2/0_0.png' AS template,
'https://h/v2/coverage/0/256/7/' || (id % 128) || '/' || (id % 99) || '/0/0_0.png' AS coverage_url, replace(path, '/', '_') AS dir, '7_' || (id % 128) || '_' || (id % 99) || '.png' AS file, printf('%.2f_%.2f', id / 4.0, -(id / 10.0)) AS point_key FROM p""")
def sup_names(spark: SparkSession, d: str) -> DataFrame:
    """Addresses and file names of tiles."""
    k = F.col("p_partkey")
    path = F.concat_ws("/", F.lit("t"), F.col("p_size").cast("string"), k.cast("string"))
    at = (k % 128, k % 99)
    return src.table(spark, d, "part").select(
        k.alias("id"), F.format_string("https://h/%s/256/7/%d/%d/2/0_0.png", path, *at).alias("tile_url"), F.concat(F.lit("https://h/"), path, F.lit("/256/{z}/{x}/{y}/2/0_0.png")).alias("template"),
        F.format_string("https://h/v2/coverage/0/256/7/%d/%d/0/0_0.png", *at).alias("coverage_url"), F.trim(F.replace(path, F.lit("/"), F.lit("_"))).alias("dir"), F.format_string("7_%d_%d.png", *at).alias("file"), F.format_string("%.2f_%.2f", k / 4.0, -(k / 10.0)).alias("point_key"),
    )


@query("""WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN (epoch(o_orderdate)::BIGINT)::VARCHAR WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') ELSE o_orderpriority END AS s, epoch(o_orderdate)::BIGINT AS t FROM orders) SELECT id, CASE WHEN id % 3 < 2 THEN t END AS since FROM s""")
def rep_since(spark: SparkSession, d: str) -> DataFrame:
    o, k = src.table(spark, d, "orders"), F.col("o_orderkey")
    t = src.epoch(F.col("o_orderdate"))
    s = F.when(k % 3 == 0, t.cast("string")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.col("o_orderpriority"))
    parsed = F.coalesce(F.col("s").try_cast("bigint"), F.unix_seconds(F.try_to_timestamp("s", F.lit("yyyy-MM-dd'T'HH:mm:ssX"))))
    return o.select(k.alias("id"), s.alias("s")).select("id", parsed.alias("since"))
