"""Queries of ensembles, features, trees, thresholds and palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions import trees
from pluvia.operators import models
from pluvia.plans.registry import _FR, _L, query
from pluvia.plans.places import _crc_sql
from pluvia.plans.scores import _M
from pluvia.sources import driver_tables as src

_W = "(VALUES ('LK', 2.0), ('HS', 1.0), ('TREC', 1.0)) AS w(member, w)"


@query(f"""{_M}, s AS (SELECT point, variant AS member, lead AS minute, fc AS dbz, prob, (fc - 20) / 100 AS dx, (obs - 25) / 100 AS dy FROM m WHERE NOT (variant = 'HS' AND point % 4 = 0)), j AS (SELECT s.*, w FROM s JOIN {_W} ON w.member = s.member),
g AS (SELECT point, minute, sum(w * dbz) / sum(w) AS dbz, sum(w * prob) / sum(w) AS prob, sum(w * dx) / sum(w) AS dx, sum(w * dy) / sum(w) AS dy, sum(w * sqrt(dx * dx + dy * dy)) / sum(w) AS s, count(*) AS members FROM j GROUP BY ALL)
SELECT point, minute, round(dbz, 6) AS dbz, round(prob, 6) AS prob, round(dx, 6) AS dx, round(dy, 6) AS dy, CASE WHEN s > 0 THEN round(sqrt(dx * dx + dy * dy) / s, 6) END AS coherence, members FROM g""")
def mod_ensemble(spark: SparkSession, d: str) -> DataFrame:
    m = src.members(spark, d).where("NOT (variant = 'HS' AND point % 4 = 0)")
    s = m.select("point", F.col("variant").alias("member"), F.col("lead").alias("minute"), F.col("fc").alias("dbz"), "prob", ((F.col("fc") - 20) / 100).alias("dx"), ((F.col("obs") - 25) / 100).alias("dy"))
    weights = spark.createDataFrame([("LK", 2.0), ("HS", 1.0), ("TREC", 1.0)], "member string, w double")
    e = models.ensemble(s, weights, ["point"])
    return e.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in ("dbz", "prob", "dx", "dy", "coherence")})


@query(f"""{_FR}, g AS (SELECT region, t, lag(t) OVER w AS a, lag(t, 2) OVER w AS b FROM f WINDOW w AS (PARTITION BY region ORDER BY t)) SELECT region, t, CASE WHEN t - a <= 1800 THEN CASE WHEN a - b <= 1800 THEN b ELSE a END END AS base FROM g""")
def mod_trend_base(spark: SparkSession, d: str) -> DataFrame:
    return models.trend_base(src.frames(spark, d), ["region"], 1800)


@query(f"""{_FR}, g AS (SELECT region, t, lag(t) OVER (PARTITION BY region ORDER BY t) AS was FROM f), n AS (SELECT median(t) AS h FROM f) SELECT g.* FROM g WHERE t - was <= 1800 AND t > (SELECT max(t) FROM f WHERE t < 1705000000)""")
def mod_new_pairs(spark: SparkSession, d: str) -> DataFrame:
    f = src.frames(spark, d)
    last = f.where("t < 1705000000").agg(F.max("t").alias("last"))
    known = f.join(F.broadcast(last), F.col("t") <= F.col("last")).select("region", "t")
    return models.new_pairs(f, known, ["region"], 1800)


@query(f"""{_M} SELECT point, lead, round(avg(fc), 6) AS m_mean, round(stddev_pop(fc), 6) AS m_std, min(fc) AS m_min, max(fc) AS m_max, round(avg(prob), 6) AS m_prob FROM m GROUP BY point, lead""")
def ml_member_features(spark: SparkSession, d: str) -> DataFrame:
    return models.member_features(src.members(spark, d), ["point", "lead"])


@query(f"""{_L}, s AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY y, x)::INT AS cell, x + 0.25 AS cx, y + 0.5 AS cy, dbz >= 50 AS growing FROM l WHERE dbz >= 45), p AS (SELECT k, x * 1000 + y AS id, x, y FROM l),
d AS (SELECT p.k, p.id, s.cell, sqrt(pow(p.x - cx, 2) + pow(p.y - cy, 2)) AS d, growing FROM p LEFT JOIN s ON s.k = p.k) SELECT k, id, arg_min(cell, d * 1000000 + cell / 1000) AS cell, round(min(d), 6) AS distance, count(*) FILTER (WHERE d <= 4 AND growing) AS building FROM d GROUP BY k, id""")
def ml_nearest_storm(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    lattice = src.lattice(spark, d)
    storms = lattice.where("dbz >= 45").select("k", F.row_number().over(W.partitionBy("k").orderBy("y", "x")).alias("cell"), (F.col("x") + 0.25).alias("cx"), (F.col("y") + 0.5).alias("cy"), (F.col("dbz") >= 50).alias("growing"))
    return models.nearest_storm(lattice.select("k", (F.col("x") * 1000 + F.col("y")).alias("id"), "x", "y"), storms, 4.0)


@query(f"""{_L}, p AS (SELECT k, x * 1000 + y AS id, x + 0.5 AS fx, y + 0.25 AS fy FROM l), c AS (SELECT p.k, id, (((floor(fx) + i) % 12))::INT AS x, (floor(fy) + j)::INT AS y, (CASE WHEN i = 1 THEN 0.5 ELSE 0.5 END) * (CASE WHEN j = 1 THEN 0.25 ELSE 0.75 END) AS w FROM p, range(2) AS a(i), range(2) AS b(j))
SELECT c.k, id, CASE WHEN count(dbz) = 4 THEN round(sum(w * dbz), 6) END AS value FROM c LEFT JOIN l ON l.k = c.k AND l.x = c.x AND l.y = c.y GROUP BY ALL""")
def ml_satellite_reads(spark: SparkSession, d: str) -> DataFrame:
    lattice = src.lattice(spark, d)
    return models.satellite_reads(lattice, lattice.select("k", (F.col("x") * 1000 + F.col("y")).alias("id"), (F.col("x") + 0.5).alias("fx"), (F.col("y") + 0.25).alias("fy")))


@query(f"""{_L}, o AS (SELECT i, j FROM range(-2, 3) AS a(i), range(-2, 3) AS b(j) WHERE i * i + j * j <= 4) SELECT p.k, p.x, p.y, max(c.dbz) AS brightest, round(count(*) FILTER (WHERE c.dbz >= 40) / count(*), 9) AS share FROM l AS p CROSS JOIN o JOIN l AS c ON c.k = p.k AND c.x = p.x + i AND c.y = p.y + j GROUP BY ALL""")
def ml_satellite_disc(spark: SparkSession, d: str) -> DataFrame:
    """Over the pixels that are there; a disc without any gives no row."""
    from pluvia.operators.raster import disc

    lattice = src.lattice(spark, d)
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disc(2)])).alias("o")
    reads = lattice.select("k", F.col("x").alias("px"), F.col("y").alias("py"), at).select("k", "px", "py", (F.col("px") + F.col("o.i")).alias("x"), (F.col("py") + F.col("o.j")).alias("y")).join(lattice, ["k", "x", "y"])
    return reads.groupBy("k", F.col("px").alias("x"), F.col("py").alias("y")).agg(F.max("dbz").alias("brightest"), F.round(F.count_if(F.col("dbz") >= 40) / F.count("*"), 9).alias("share"))


_N = trees.Node
#: Two trees of a class: one that sends missing values by default, one that takes them as zeros.
TREES = [
    [_N(feature=0, threshold=200.0, left=1, right=2, default_left=True, missing=trees.NAN), _N(value=-1.0), _N(feature=1, threshold=0.0, left=3, right=4, missing=trees.ZERO), _N(value=0.5), _N(value=2.0)],
    [_N(feature=1, threshold=1.0, left=1, right=2, missing=trees.NONE), _N(value=-0.5), _N(value=0.75)],
]


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 4 - 1.0 END AS b, (event_id % 13 * 10)::INT AS lead FROM events),
r AS (SELECT *, CASE WHEN a IS NULL OR a <= 200 THEN -1.0 WHEN b IS NULL OR b = 0 THEN 2.0 WHEN b <= 0 THEN 0.5 ELSE 2.0 END + CASE WHEN coalesce(b, 0) <= 1 THEN -0.5 ELSE 0.75 END AS raw FROM e)
SELECT event_id, round(1 / (1 + exp(-raw)), 9) AS p, CASE WHEN lead <= 20 THEN 0.3 WHEN lead <= 45 THEN 0.4 ELSE 0.6 END AS cut, round(1 / (1 + exp(-raw)), 9) >= CASE WHEN lead <= 20 THEN 0.3 WHEN lead <= 45 THEN 0.4 ELSE 0.6 END AS predicted FROM r""")
def ml_tree_classes(spark: SparkSession, d: str) -> DataFrame:
    """Trees with missing values, and the threshold of the nearest lead learned (10, 30, 60)."""
    k = F.col("event_id")
    for t in TREES:
        trees.checked(t, 2)
    e = src.table(spark, d, "events").select(k, F.when(k % 7 != 0, F.col("value")).alias("a"), F.when(k % 5 != 0, k % 4 - 1.0).alias("b"), (k % 13 * 10).cast("int").alias("lead"))
    p, cut = F.round(trees.probability(TREES, [F.col("a"), F.col("b")]), 9), trees.cut_at(F.col("lead"), {10: 0.3, 30: 0.4, 60: 0.6})
    return e.select("event_id", p.alias("p"), cut.alias("cut"), (p >= cut).alias("predicted"))


@query("""WITH s AS (SELECT l_orderkey AS id, (l_linenumber * 9)::INT AS minute, l_quantity AS dbz, l_orderkey % 7 - 3.0 AS d1, l_orderkey % 5 - 2.0 AS d2 FROM lineitem)
SELECT id, minute, round(greatest(dbz + CASE WHEN minute <= 10 THEN d1 * minute / 10 WHEN minute <= 30 THEN d1 + (d2 - d1) * (minute - 10) / 20 ELSE d2 END, -32), 6) AS dbz, CASE WHEN minute % 18 = 0 THEN 2 + minute * 8 // 60 ELSE -1 END::INT AS radius FROM s""")
def ml_adjusted(spark: SparkSession, d: str) -> DataFrame:
    """A series moved by corrections known at minutes 10 and 30; probabilities only at its leads."""
    k, m = F.col("l_orderkey"), (F.col("l_linenumber") * 9).cast("int")
    delta = trees.lead_delta(m, [10, 30], [k % 7 - 3.0, k % 5 - 2.0])
    radius = F.when(m % 18 == 0, 2 + F.floor(m * 8 / 60)).otherwise(-1).cast("int")
    return src.table(spark, d, "lineitem").select(k.alias("id"), m.alias("minute"), F.round(F.greatest(F.col("l_quantity") + delta, F.lit(-32.0)), 6).alias("dbz"), radius.alias("radius"))


@query("""WITH e AS (SELECT event_id, (user_id % 12) || '/' || event_id || '/' || event_type AS key, value < 300 AS quiet FROM events),
h AS (SELECT *, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i::INT, 1))::UHUGEINT)), lambda a, b: (xor(a::BIT, b::BIT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % 1000000 AS h FROM e)
SELECT event_id, CASE WHEN quiet THEN 20.0 ELSE 1.0 END::DOUBLE AS weight FROM h WHERE NOT quiet OR h < 50000""")
def ml_thinned(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("/", (F.col("user_id") % 12).cast("string"), F.col("event_id").cast("string"), "event_type")
    kept, weight = models.thinned(F.col("value") < 300, key)
    return src.table(spark, d, "events").where(kept).select("event_id", weight.alias("weight"))


@query(f"""{_M}, r AS (SELECT lead, greatest(least(floor(round(prob * 100, 6)), 100), 0) AS b, obs >= 20 AS ev, 1.0 + point % 2 AS w FROM m WHERE variant = 'HS'), p AS (SELECT lead, p, sum(w) FILTER (WHERE ev AND b >= p) AS h, sum(w) FILTER (WHERE ev AND b < p) AS m, sum(w) FILTER (WHERE NOT ev AND b >= p) AS f FROM r, range(5, 96) AS x(p) GROUP BY ALL)
SELECT a.lead, a.p / 100 AS p, coalesce(sum(b.h), 0)::DOUBLE AS hits, coalesce(sum(b.m), 0)::DOUBLE AS misses, coalesce(sum(b.f), 0)::DOUBLE AS false_alarms FROM p AS a JOIN p AS b ON b.p = a.p AND abs(b.lead - a.lead) <= 10 GROUP BY ALL""")
def trn_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return models.threshold_grid(_labelled(spark, d), ["set"]).drop("set")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    m = src.members(spark, d).where("variant = 'HS'")
    return m.select(F.lit("hs").alias("set"), "lead", "prob", (F.col("obs") >= 20).alias("event"), (1.0 + F.col("point") % 2).alias("w"))


@query(f"""{_M}, r AS (SELECT lead, greatest(least(floor(round(prob * 100, 6)), 100), 0) AS b, obs >= 20 AS ev, 1.0 + point % 2 AS w FROM m WHERE variant = 'HS'), p AS (SELECT lead, p, coalesce(sum(w) FILTER (WHERE ev AND b >= p), 0) AS h, coalesce(sum(w) FILTER (WHERE ev AND b < p), 0) AS m, coalesce(sum(w) FILTER (WHERE NOT ev AND b >= p), 0) AS f FROM r, range(5, 96) AS x(p) GROUP BY ALL),
g AS (SELECT a.lead, a.p, sum(b.h)::DOUBLE AS h, sum(b.m)::DOUBLE AS m, sum(b.f)::DOUBLE AS f FROM p AS a JOIN p AS b ON b.p = a.p AND abs(b.lead - a.lead) <= 10 GROUP BY ALL), s AS (SELECT lead, p, round(h / nullif(h + m + f, 0), 9) AS csi, round(h / nullif(h + m, 0), 9) AS pod, round(f / nullif(h + f, 0), 9) AS far, round((h + f) / nullif(h + m, 0), 9) AS bias FROM g),
a AS (SELECT lead, p FROM s WHERE pod >= 0.6 AND far <= 0.42 QUALIFY row_number() OVER (PARTITION BY lead ORDER BY csi DESC, p) = 1), b AS (SELECT lead, p FROM s WHERE bias IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lead ORDER BY abs(bias - 1.1), p) = 1)
SELECT l.lead, coalesce(a.p, b.p, 50) / 100 AS p FROM (SELECT DISTINCT lead FROM s) AS l LEFT JOIN a ON a.lead = l.lead LEFT JOIN b ON b.lead = l.lead""")
def trn_picked_threshold(spark: SparkSession, d: str) -> DataFrame:
    return models.picked_threshold(models.threshold_grid(_labelled(spark, d), ["set"]), ["set"], 0.6, 0.42, 1.1).drop("set")


@query(f"""{_M}, r AS (SELECT *, t + lead * 60 < (SELECT max(t) // 2 FROM m) AS train FROM m) SELECT variant, train, sum(1.0 + point % 2) FILTER (WHERE fc >= 20 AND obs >= 20)::DOUBLE AS hits, sum(1.0 + point % 2) FILTER (WHERE fc < 20 AND obs >= 20)::DOUBLE AS misses, sum(1.0 + point % 2) FILTER (WHERE fc >= 20 AND obs < 20)::DOUBLE AS false_alarms,
round(hits / nullif(hits + misses, 0), 9) AS pod, round(false_alarms / nullif(hits + false_alarms, 0), 9) AS far, round(hits / nullif(hits + misses + false_alarms, 0), 9) AS csi, round((hits + false_alarms) / nullif(hits + misses, 0), 9) AS bias FROM r GROUP BY ALL""")
def trn_weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Weighted counts and scores before and after a cut in time: rows are verified before it or not."""
    from pluvia.operators.scores import safe
    from pluvia.operators.verification import contingency

    m = src.members(spark, d)
    last = m.agg(F.max("t")).first()[0] // 2
    w = 1.0 + F.col("point") % 2
    sums = m.groupBy("variant", (F.col("t") + F.col("lead") * 60 < last).alias("train")).agg(*contingency(F.col("fc") >= 20, F.col("obs") >= 20, w)[:3])
    h, mi, f = (F.col(c) for c in ("hits", "misses", "false_alarms"))
    return sums.select("variant", "train", *[c.cast("double").alias(n) for c, n in ((h, "hits"), (mi, "misses"), (f, "false_alarms"))], safe(h, h + mi).alias("pod"), safe(f, h + f).alias("far"), safe(h, h + mi + f).alias("csi"), safe(h + f, h + mi).alias("bias"))


@query(f"""WITH c AS (SELECT DISTINCT c_mktsegment AS name FROM customer) SELECT name, ({_crc_sql("name")}) % 5 = 0 AS held_out FROM c""")
def trn_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Names of which a stable fifth is held out."""
    return src.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct().select("name", (F.crc32("name") % 5 == 0).alias("held_out"))


_PALETTE = "SELECT p_size * 1.0 AS dbz, min(p_partkey * 37 % 256)::INT AS r, min(p_partkey * 91 % 256)::INT AS g, min(p_partkey * 53 % 256)::INT AS b, CASE WHEN p_size % 3 = 0 THEN 200 ELSE 255 END AS a, p_size AS ord FROM part GROUP BY p_size"


def _palette(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return src.table(spark, d, "part").groupBy("p_size").agg(*[F.min(k * m % 256).cast("int").alias(c) for c, m in (("r", 37), ("g", 91), ("b", 53))]).select((F.col("p_size") * 1.0).alias("dbz"), "r", "g", "b", F.when(F.col("p_size") % 3 == 0, 200).otherwise(255).alias("a"), F.col("p_size").alias("ord"))


@query(f"""WITH p AS ({_PALETTE}), c AS (SELECT event_id AS id, (event_id * 7 % 256)::INT AS r, (user_id * 5 % 256)::INT AS g, (event_id % 64)::INT AS b, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 255 END AS a FROM events WHERE event_id % 2 = 1 UNION ALL SELECT 1000000 + ord, r, g, b, a FROM p),
d AS (SELECT c.id, c.r, c.g, c.b, c.a, pow(c.r - p.r, 2) + pow(c.g - p.g, 2) + pow(c.b - p.b, 2) + pow(c.a - p.a, 2) AS d, p.dbz, p.ord FROM c, p), n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, ord) = 1)
SELECT id, r, g, b, a, CASE WHEN a = 0 THEN -32 ELSE dbz END::DOUBLE AS dbz, a = 0 OR d = 0 AS exact FROM n""".replace("FROM events WHERE event_id % 2 = 1", "FROM events"))
def rad_palette(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("event_id"), _palette(spark, d)
    c = src.table(spark, d, "events").select(k.alias("id"), (k * 7 % 256).cast("int").alias("r"), (F.col("user_id") * 5 % 256).cast("int").alias("g"), (k % 64).cast("int").alias("b"), F.when(k % 9 == 0, 0).otherwise(255).alias("a"))
    return models.palette_reads(c.unionByName(p.select((F.col("ord") + 1000000).cast("long").alias("id"), "r", "g", "b", "a")), p)


@query(f"""WITH p AS ({_PALETTE}), e AS (SELECT event_id AS id, value / 8 - 5 AS dbz FROM events), j AS (SELECT e.id, arg_max(p, p.dbz) AS c FROM e LEFT JOIN p ON p.dbz <= e.dbz GROUP BY e.id)
SELECT id, coalesce((c.r * c.a + 20 * (255 - c.a)) // 255, 20)::INT AS r, coalesce((c.g * c.a + 30 * (255 - c.a)) // 255, 30)::INT AS g, coalesce((c.b * c.a + 40 * (255 - c.a)) // 255, 40)::INT AS b FROM j""")
def rad_painted(spark: SparkSession, d: str) -> DataFrame:
    return models.painted(src.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") / 8 - 5).alias("dbz")), _palette(spark, d), (20, 30, 40))


@query("SELECT p_partkey AS id, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_size % 256 AS b, 255 AS a FROM part")
def sup_hex_colours(spark: SparkSession, d: str) -> DataFrame:
    """RRGGBBAA texts read back to numbers."""
    k = F.col("p_partkey")
    hex_ = F.format_string("%02x%02x%02xFF", k * 37 % 256, k * 91 % 256, F.col("p_size").cast("long") % 256)
    part = lambda i: F.conv(F.substring("h", 1 + 2 * i, 2), 16, 10).cast("long")
    return src.table(spark, d, "part").select(k.alias("id"), hex_.alias("h")).select("id", *[part(i).alias(c) for i, c in enumerate("rgba")])


@query(f"{_L} SELECT k, max(dbz) AS top, count(*) FILTER (WHERE dbz >= 20) AS wet, round(count(*) / (12 * (SELECT max(user_id // 12) + 1 FROM events)), 9) AS covered FROM l GROUP BY k")
def rad_frame_stats(spark: SparkSession, d: str) -> DataFrame:
    """Greatest echo, rainy pixels and the covered share of each frame."""
    lattice = src.lattice(spark, d)
    height = 1 + lattice.agg(F.max("y")).first()[0]
    return lattice.groupBy("k").agg(F.max("dbz").alias("top"), F.count_if(F.col("dbz") >= 20).alias("wet"), F.round(F.count("*") / (12 * height), 9).alias("covered"))
