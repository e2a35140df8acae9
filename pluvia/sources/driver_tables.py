"""Views of the driver's tables in the shapes of the engine: frames, lattices, forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one task where most rows are groups of their own.
DEALT = 250_000


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df of so many rows by key in tasks of bounded size, whatever the number of rows. The number of tasks is given, so
    small tasks are not joined by their bytes, which say little of the memory of their groups."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // DEALT)), key)


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", epoch(F.col("ts")).alias("t"))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, x, y, dbz): one frame every six hours on a 12-wide lattice; absent cells have no echo."""
    e = event_times(spark, sf_dir)
    return e.groupBy(F.floor(F.col("t") / 21600).cast("long").alias("k"), (F.col("user_id") % 12).cast("int").alias("x"), F.floor(F.col("user_id") / 12).cast("int").alias("y")).agg(
        F.max(F.least(F.lit(65.0), F.floor(F.col("value") / 3).cast("double"))).alias("dbz")
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, t): the 10-minute frames that each of 12 regions has."""
    return event_times(spark, sf_dir).select((F.col("user_id") % 12).cast("int").alias("region"), (F.floor(F.col("t") / 600) * 600).cast("long").alias("t")).distinct()


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, t, variant, lead, fc, obs, prob): paired forecasts and observations."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 10).cast("int").alias("region"),
        epoch(F.col("l_shipdate")).alias("t"),
        F.col("l_returnflag").alias("variant"),
        (F.least(F.col("l_linenumber"), F.lit(6)) * 10).cast("int").alias("lead"),
        F.round(F.col("l_discount") * 600).alias("fc"),
        F.round(F.col("l_tax") * 750).alias("obs"),
        F.abs(F.round(F.col("l_discount") * 10, 2)).alias("prob"),
    )


LATTICE_SQL = "SELECT floor(epoch(ts))::BIGINT // 21600 AS k, (user_id % 12)::INT AS x, (user_id // 12)::INT AS y, max(least(65, floor(value / 3)))::DOUBLE AS dbz FROM events GROUP BY ALL"
FRAMES_SQL = "SELECT DISTINCT (user_id % 12)::INT AS region, floor(epoch(ts))::BIGINT // 600 * 600 AS t FROM events"
FORECASTS_SQL = """SELECT (l_suppkey % 10)::INT AS region, floor(epoch(l_shipdate))::BIGINT AS t, l_returnflag AS variant, (least(l_linenumber, 6) * 10)::INT AS lead,
round(l_discount * 600) AS fc, round(l_tax * 750) AS obs, abs(round(l_discount * 10, 2)) AS prob FROM lineitem"""


#: Forecast variants of the members view, in order; the last stands for persistence.
VARIANTS = ["HS", "LK", "TREC"]


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, t, point, lead, variant, fc, obs, prob): three forecasts of each point and lead.

    Rows are dealt by order before they are grouped: most groups are one row, so tables kept before the shuffle would only grow,
    and what groups by point needs no other shuffle."""
    whole = table(spark, sf_dir, "lineitem")
    li = dealt(whole.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), "l_orderkey", whole.count()).groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    hs, trec = F.floor("l_quantity").cast("double"), F.floor(F.col("l_extendedprice") % 60).cast("double")
    lk = F.round(F.col("l_discount") * 600)
    made = [("HS", hs, hs / 50), ("LK", lk, F.abs(F.round(F.col("l_discount") * 10, 2))), ("TREC", trec, trec / 60)]
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), fc.alias("fc"), p.alias("prob")) for v, fc, p in made])).alias("m")
    return li.select(
        (F.col("l_orderkey") % 10).cast("int").alias("region"),
        (F.col("l_orderkey") * 600).alias("t"),
        F.col("l_orderkey").alias("point"),
        (F.col("l_linenumber") * 10).cast("int").alias("lead"),
        each,
        F.round(F.col("l_tax") * 750).alias("obs"),
    ).select("region", "t", "point", "lead", "m.variant", "m.fc", "obs", "m.prob")


def full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, x, y, fc, obs) of every place of the lattice: each frame against the next one that is
    there, absent cells without echo."""
    cells = lattice(spark, sf_dir)
    rows = F.explode(F.sequence(F.lit(0), F.lit(cells.agg(F.max("y")).first()[0]))).alias("y")
    frames_ = cells.select("k").distinct()
    places = frames_.select("k", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("x")).select("k", "x", rows)
    later = cells.select((F.col("k") - 1).alias("k"), "x", "y", F.col("dbz").alias("obs"))
    both = places.join(frames_.select((F.col("k") - 1).alias("k")), "k", "left_semi").join(cells, ["k", "x", "y"], "left").join(later, ["k", "x", "y"], "left")
    return both.select("k", "x", "y", F.coalesce("dbz", F.lit(-32.0)).alias("fc"), F.coalesce("obs", F.lit(-32.0)).alias("obs"))


MEMBERS_SQL = """SELECT (l_orderkey % 10)::INT AS region, l_orderkey * 600 AS t, l_orderkey AS point, (l_linenumber * 10)::INT AS lead, v.variant,
CASE v.variant WHEN 'HS' THEN floor(l_quantity) WHEN 'LK' THEN round(l_discount * 600) ELSE floor(l_extendedprice % 60) END AS fc, round(l_tax * 750) AS obs,
CASE v.variant WHEN 'HS' THEN floor(l_quantity) / 50 WHEN 'LK' THEN abs(round(l_discount * 10, 2)) ELSE floor(l_extendedprice % 60) / 60 END AS prob
FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice, min(l_discount) AS l_discount, min(l_tax) AS l_tax FROM lineitem GROUP BY ALL), (VALUES ('HS'), ('LK'), ('TREC')) AS v(variant)"""
GRID_SQL = f"""SELECT p.k, p.x, p.y, coalesce(a.dbz, -32) AS fc, coalesce(b.dbz, -32) AS obs FROM (SELECT k, x::INT AS x, y::INT AS y FROM (SELECT DISTINCT k FROM ({LATTICE_SQL})), range(12) AS i(x), range((SELECT max(user_id // 12) + 1 FROM events)) AS j(y)) AS p
JOIN (SELECT DISTINCT k - 1 AS k FROM ({LATTICE_SQL})) AS n ON n.k = p.k LEFT JOIN ({LATTICE_SQL}) AS a ON a.k = p.k AND a.x = p.x AND a.y = p.y LEFT JOIN ({LATTICE_SQL}) AS b ON b.k = p.k + 1 AND b.x = p.x AND b.y = p.y"""


#: Side of a scene's lattice in pixels; users of a region.
SCENE, CROWD = 24, 64


def _born(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, k, cx, cy, v): where and when the squares of the scenes begin, and how strong."""
    e = event_times(spark, sf_dir)
    at = (F.col("user_id") * 131 + F.col("event_id")) % (SCENE * SCENE)
    return e.select(
        F.floor(F.col("user_id") / CROWD).cast("int").alias("region"),
        F.floor(F.col("t") / 21600).cast("long").alias("k"),
        (at % SCENE).cast("int").alias("cx"),
        F.floor(at / SCENE).cast("int").alias("cy"),
        F.coalesce(F.floor(F.col("value") / 2), F.lit(1000)).alias("v"),  # no value: as strong as can be
    )


def crowds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region): the regions of the scenes, told from where squares begin: one that begins further outside is never in."""
    return _born(spark, sf_dir).where("cx >= -4 AND cy >= -1").select("region").distinct()


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, t, x, y, dbz): frames of 10 minutes (six hours of events each) of a region for every 64 users. Each event
    is a square of nine pixels that moves one pixel a frame eastwards, four frames long, and weakens.

    Of squares that begin at the same place the strongest is the strongest ever after, so these are few a frame, and
    frames meet as squares, not as their 36 pixels; what groups by frame or by pixel then needs no other shuffle."""
    strongest = _born(spark, sf_dir).groupBy("region", "k", "cx", "cy").agg(F.max("v").alias("v"))
    aged = strongest.select("region", "k", "cx", "cy", "v", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("age"))
    moved = aged.select("region", ((F.col("k") + F.col("age")) * 600).alias("t"), (F.col("cx") + F.col("age")).alias("cx"), "cy", F.least(F.lit(65.0), F.col("v") - 2 * F.col("age")).cast("double").alias("dbz"))
    met = moved.repartition("region", "t")
    spot = met.select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("i")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("j"))
    placed = spot.select("region", "t", (F.col("cx") + F.col("i")).alias("x"), (F.col("cy") + F.col("j")).alias("y"), "dbz")
    inside = placed.where(F.col("x").between(0, SCENE - 1) & F.col("y").between(0, SCENE - 1))
    return inside.groupBy("region", "t", "x", "y").agg(F.max("dbz").alias("dbz"))


SCENES_SQL = f"""SELECT region, t, x, y, max(dbz) AS dbz FROM (SELECT (user_id // {CROWD})::INT AS region, (floor(epoch(ts))::BIGINT // 21600 + age) * 600 AS t, ((user_id * 131 + event_id) % {SCENE * SCENE} % {SCENE} + age + i)::INT AS x,
((user_id * 131 + event_id) % {SCENE * SCENE} // {SCENE} + j)::INT AS y, least(65, floor(value / 2) - 2 * age)::DOUBLE AS dbz FROM events, range(4) AS a(age), range(-1, 2) AS b(i), range(-1, 2) AS c(j)) WHERE x BETWEEN 0 AND {SCENE - 1} AND y BETWEEN 0 AND {SCENE - 1} GROUP BY ALL"""
