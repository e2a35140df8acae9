"""Queries of the backtest's scores, with SQL written from the rules and not from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.radar import dbz_of
from pluvia.operators import scores, verification
from pluvia.plans.registry import _ISO, _RATE, query
from pluvia.sources import driver_tables as src

_M = f"WITH m AS ({src.MEMBERS_SQL})"
_G = f"WITH g AS ({src.GRID_SQL})"
_HMF = "count(*) FILTER (WHERE fc >= 20 AND obs >= 20) AS hits, count(*) FILTER (WHERE fc < 20 AND obs >= 20) AS misses, count(*) FILTER (WHERE fc >= 20 AND obs < 20) AS false_alarms"
_CSI = "round(hits / nullif(hits + misses + false_alarms, 0), 9)"
_rate = lambda c: _RATE.replace("(v ", f"({c} ").replace("WHEN v ", f"WHEN {c} ").replace("(v,", f"({c},")


@query(f"""{_M}, h AS (SELECT *, (lead - coalesce(lag(lead) OVER (PARTITION BY variant, point ORDER BY lead), 0)) / 60 AS h FROM m),
s AS (SELECT variant, lead, sum({_rate("fc")} * h) OVER w AS p, sum({_rate("obs")} * h) OVER w AS o FROM h WINDOW w AS (PARTITION BY variant, point ORDER BY lead ROWS UNBOUNDED PRECEDING))
SELECT variant, lead, count(*) AS n, round(avg(abs(p - o)), 6) AS error FROM s WHERE p > 0 OR o > 0 GROUP BY ALL""")
def bt_accumulated_error(spark: SparkSession, d: str) -> DataFrame:
    return scores.accumulated_error(src.members(spark, d))


@query(f"""{_M}, e AS (SELECT point, lead, avg(fc) AS fc, max(obs) AS obs, avg(prob) AS prob FROM m GROUP BY ALL)
SELECT lead, {_HMF}, round(avg(fc), 6) AS mean_fc, round(avg(pow(prob - (obs >= 20)::INT, 2)), 6) AS brier FROM e GROUP BY lead""")
def bt_ensemble_mean(spark: SparkSession, d: str) -> DataFrame:
    e = scores.ensemble_mean(src.members(spark, d), src.VARIANTS, "mean")
    brier = F.avg(F.pow(F.col("prob") - (F.col("obs") >= 20).cast("int"), 2))
    return e.groupBy("lead").agg(*verification.contingency(F.col("fc") >= 20, F.col("obs") >= 20)[:3], F.round(F.avg("fc"), 6).alias("mean_fc"), F.round(brier, 6).alias("brier"))


@query(f"""{_M}, r AS (SELECT *, max(greatest(fc, obs)) OVER (PARTITION BY point) AS top, greatest(fc, 0) - greatest(obs, 0) AS e FROM m WHERE lead = 30)
SELECT a.variant AS v, b.variant AS w, count(*) AS n, round(corr(a.e, b.e), 9) AS r FROM r AS a JOIN r AS b ON a.point = b.point WHERE a.top >= 20 GROUP BY ALL""")
def bt_error_correlation(spark: SparkSession, d: str) -> DataFrame:
    return scores.error_correlation(src.members(spark, d), src.VARIANTS)


@query(f"""{_M}, t AS (SELECT variant, lead, {_HMF}, count(*) FILTER (WHERE fc < 20 AND obs < 20) AS negatives, round(avg(abs(greatest(fc, 0) - greatest(obs, 0))) FILTER (WHERE fc >= 20 OR obs >= 20), 6) AS mae,
round(avg(pow(prob - (obs >= 20)::INT, 2)), 6) AS brier FROM m GROUP BY GROUPING SETS ((variant, lead), (variant))), c AS (SELECT *, {_CSI} AS csi FROM t),
a AS (SELECT variant, CASE WHEN count(csi) = count(*) AND max(lead) = 60 THEN round(avg(csi), 9) END AS mean_csi FROM c WHERE lead <= 60 GROUP BY variant)
SELECT c.*, round(1 - c.brier / b.brier, 6) AS bss, CASE WHEN c.lead IS NULL THEN a.mean_csi END AS mean_csi FROM c JOIN c AS b ON b.variant = 'TREC' AND b.lead IS NOT DISTINCT FROM c.lead JOIN a ON a.variant = c.variant""")
def bt_results(spark: SparkSession, d: str) -> DataFrame:
    return scores.results(src.members(spark, d), "TREC")


def _classes_sql(classes: tuple) -> str:
    rows = ", ".join(f"('{n}', {lo}, {1e9 if hi is None else hi})" for n, lo, hi in classes)
    return f"""{_M}, c AS (SELECT * FROM (VALUES {rows}) AS v(class, lo, hi)),
t AS (SELECT variant, class, lead, count(*) FILTER (WHERE p AND o) AS hits, count(*) FILTER (WHERE NOT p AND o) AS misses, count(*) FILTER (WHERE p AND NOT o) AS false_alarms
FROM (SELECT *, fc >= lo AND fc < hi AS p, obs >= lo AND obs < hi AS o FROM m, c) GROUP BY ALL), s AS (SELECT *, {_CSI} AS csi FROM t)
SELECT s.*, CASE WHEN s.variant <> 'TREC' THEN round(s.csi - b.csi, 9) END AS delta FROM s JOIN s AS b ON b.variant = 'TREC' AND b.class = s.class AND b.lead = s.lead"""


@query(_classes_sql(scores.CLASSES))
def bt_class_results(spark: SparkSession, d: str) -> DataFrame:
    return scores.class_results(src.members(spark, d), scores.CLASSES, "TREC")


def paper_classes(spark: SparkSession) -> DataFrame:
    """(class, lo): rates through the same relation as all rain rates, then echoes."""
    rates = spark.createDataFrame([(f"{r} mm/h", float(r)) for r in scores.PAPER_RATES], "class string, r double").select("class", F.round(dbz_of(F.col("r")), 6).alias("lo"))
    return rates.unionByName(spark.createDataFrame([(f"{z} dBZ", float(z)) for z in scores.PAPER_DBZ], "class string, lo double"))


@query(f"""{_M}, c AS (SELECT r || ' mm/h' AS class, round(10 * log10(200 * pow(r, 1.6)), 6) AS lo FROM (VALUES (1), (4), (5), (8), (10), (15)) AS v(r) UNION ALL SELECT z || ' dBZ', z FROM (VALUES (20), (30), (40)) AS v(z)),
t AS (SELECT variant, class, lo, lead, count(*) FILTER (WHERE fc >= lo AND obs >= lo) AS hits, count(*) FILTER (WHERE fc < lo AND obs >= lo) AS misses, count(*) FILTER (WHERE fc >= lo AND obs < lo) AS false_alarms FROM m, c GROUP BY ALL)
SELECT *, {_CSI} AS csi FROM t""")
def bt_paper_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = src.members(spark, d).join(F.broadcast(paper_classes(spark)), F.lit(True))  # nine classes
    over = lambda c: F.col(c) >= F.col("lo")
    return rows.groupBy("variant", "class", "lo", "lead").agg(*verification.contingency(over("fc"), over("obs"))[:3]).withColumn("csi", scores.csi())


@query(f"""{_M}, b AS (SELECT region, t // 21600 AS block, variant, {_HMF} FROM m GROUP BY ALL), c AS (SELECT list(cut ORDER BY i) AS cuts FROM (VALUES {", ".join(f"({i}, {c})" for i, c in enumerate(scores.poisson_cuts().tolist()))}) AS v(i, cut)),
k AS (SELECT DISTINCT region, block, (region * 1000003 + block) % 2147483648 AS key FROM b),
h AS (SELECT region, block, r, ((key * 2654435761::HUGEINT + r * 40503 + 97) % 4294967296)::BIGINT AS h FROM k, range(1000) AS x(r)),
h1 AS (SELECT region, block, r, ((xor(h, h >> 16)::HUGEINT * 73244475) % 4294967296)::BIGINT AS h FROM h), h2 AS (SELECT region, block, r, ((xor(h, h >> 16)::HUGEINT * 73244475) % 4294967296)::BIGINT AS h FROM h1),
n AS (SELECT region, block, r, len(list_filter(cuts, lambda x: x <= xor(h, h >> 16))) AS n FROM h2, c),
s AS (SELECT r, variant, sum(n * hits) AS hits, sum(n * misses) AS misses, sum(n * false_alarms) AS false_alarms FROM n JOIN b ON n.region = b.region AND n.block = b.block GROUP BY ALL),
v AS (SELECT r, variant, coalesce(hits / nullif(hits + misses + false_alarms, 0), 0) AS csi FROM s), d AS (SELECT v.*, v.csi - w.csi AS delta FROM v JOIN v AS w ON w.r = v.r AND w.variant = 'TREC'),
q AS (SELECT variant, list_sort(list(csi)) AS c, list_sort(list(delta)) AS e FROM d GROUP BY variant), o AS (SELECT variant, {_CSI} AS csi FROM (SELECT variant, {_HMF} FROM m GROUP BY variant))
SELECT q.variant, (SELECT count(*) FROM k) AS blocks, o.csi, round(c[26], 9) AS low, round(c[976], 9) AS high, CASE WHEN q.variant <> 'TREC' THEN round(o.csi - p.csi, 9) END AS delta,
CASE WHEN q.variant <> 'TREC' THEN round(e[26], 9) END AS delta_low, CASE WHEN q.variant <> 'TREC' THEN round(e[976], 9) END AS delta_high FROM q JOIN o ON o.variant = q.variant JOIN o AS p ON p.variant = 'TREC'""")
def bt_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return scores.bootstrap(scores.block_counts(src.members(spark, d)), src.VARIANTS, "TREC")


@query(f"""{_M}, s AS (SELECT variant, max(lead) AS last, {_CSI} AS csi FROM (SELECT variant, lead, {_HMF} FROM m WHERE lead <= 60 GROUP BY ALL) AS x, (SELECT 1) GROUP BY ALL),
t AS (SELECT variant, max(lead) AS last, {_HMF} FROM m WHERE lead <= 60 GROUP BY variant), u AS (SELECT variant, last, {_CSI} AS csi FROM t)
SELECT a.variant AS base, b.variant AS other, greatest(a.last, b.last) AS max_lead, round(b.csi - a.csi, 9) AS delta FROM (VALUES ('LK', 'HS'), ('TREC', 'LK'), ('LK', 'none')) AS p(x, y) JOIN u AS a ON a.variant = x JOIN u AS b ON b.variant = y""".replace(f", s AS (SELECT variant, max(lead) AS last, {_CSI} AS csi FROM (SELECT variant, lead, {_HMF} FROM m WHERE lead <= 60 GROUP BY ALL) AS x, (SELECT 1) GROUP BY ALL)", ""))
def bt_compared(spark: SparkSession, d: str) -> DataFrame:
    return scores.compared(src.members(spark, d), [("LK", "HS"), ("TREC", "LK"), ("LK", "none")])


@query(f"""{_M}, c AS (SELECT *, CASE region % 3 WHEN 0 THEN 'tropical' WHEN 1 THEN 'subtropical' ELSE 'midlat' END AS climate, region % 2 = 0 AS sat FROM m),
t AS (SELECT climate AS grp, * FROM c UNION ALL SELECT CASE WHEN sat THEN 'sat' ELSE 'nosat' END, * FROM c UNION ALL SELECT 'tropical_sat', * FROM c WHERE sat AND climate = 'tropical')
SELECT grp, variant, regions, {_CSI} AS csi FROM (SELECT grp, variant, count(DISTINCT region) AS regions, {_HMF} FROM t GROUP BY ALL)""")
def bt_groups(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("region") % 3
    return scores.grouped(src.members(spark, d), F.when(kind == 0, "tropical").when(kind == 1, "subtropical").otherwise("midlat"), F.col("region") % 2 == 0)


@query("""WITH f AS (SELECT (user_id % 12)::INT AS region, floor(epoch(ts))::BIGINT // 3600 * 3600 AS t, max(value) > 100 AS rainy FROM events GROUP BY ALL),
r AS (SELECT region, count(*) AS n FROM (SELECT region, t - 3600 * row_number() OVER (PARTITION BY region ORDER BY t) AS g FROM f WHERE rainy) GROUP BY region, g)
SELECT region, (SELECT count(*) FROM f WHERE f.region = x.region) AS frames, (SELECT count(*) FROM f WHERE f.region = x.region AND rainy) AS rainy, (SELECT count(*) FROM r WHERE r.region = x.region AND n >= 6) AS events FROM (SELECT DISTINCT region FROM f) AS x""")
def bt_rain_events(spark: SparkSession, d: str) -> DataFrame:
    f = src.event_times(spark, d).groupBy((F.col("user_id") % 12).cast("int").alias("region"), (F.floor(F.col("t") / 3600) * 3600).cast("long").alias("t")).agg((F.max("value") > 100).alias("rainy"))
    return scores.events(f, ["region"], 3600)


@query(f"""{_M}, i AS (SELECT region, t, max(obs) < 20 AND max(fc) < 10 AS dry FROM m GROUP BY ALL), j AS (SELECT m.*, dry FROM m JOIN i USING (region, t))
SELECT variant, count(DISTINCT t) AS issues, count(DISTINCT t) FILTER (WHERE dry) AS dry_issues, {_HMF}, count(*) FILTER (WHERE dry OR (fc < 20 AND obs < 20)) AS negatives FROM j GROUP BY variant""")
def bt_dry_issues(spark: SparkSession, d: str) -> DataFrame:
    return scores.with_dry_issues(src.members(spark, d))


@query(f"""{_G}, p AS (SELECT g.*, thr, win FROM g, (VALUES (20.0), (30.0), (40.0)) AS a(thr), (VALUES (1), (3), (5)) AS b(win)),
n AS (SELECT p.k, p.x, p.y, thr, win, count(*) AS c, count(*) FILTER (WHERE q.fc >= thr) AS f, count(*) FILTER (WHERE q.obs >= thr) AS o FROM p JOIN g AS q ON q.k = p.k AND abs(q.x - p.x) <= win // 2 AND abs(q.y - p.y) <= win // 2 GROUP BY ALL)
SELECT thr::DOUBLE AS threshold, win::INT AS "window", count(DISTINCT k) AS frames, round(1 - sum(pow(f / c - o / c, 2)) / nullif(sum(pow(f / c, 2) + pow(o / c, 2)), 0), 9) AS fss FROM n GROUP BY ALL""")
def bt_fss(spark: SparkSession, d: str) -> DataFrame:
    return scores.fss(scores.fractions(src.full_grid(spark, d), [20.0, 30.0, 40.0], [1, 3, 5]))


#: Probability bins of both halves of the blocks.
_HM = f"{_M}, h AS (SELECT variant, (t // 21600 % 2)::INT AS half, least(floor(prob * 20)::INT, 19) AS bin, count(*) FILTER (WHERE obs >= 20) AS pos, count(*) FILTER (WHERE obs < 20) AS neg FROM m GROUP BY ALL)"
_FILLED = f"""{_HM}, {_ISO}, x AS (SELECT variant, half, b.bin FROM (SELECT DISTINCT variant, half FROM h), range(20) AS b(bin)),
filled AS (SELECT x.variant, x.half, x.bin::INT AS bin, coalesce((SELECT arg_min(calibrated, iso.bin) FROM iso WHERE iso.variant = x.variant AND iso.half = x.half AND iso.bin >= x.bin), (SELECT arg_max(calibrated, iso.bin) FROM iso WHERE iso.variant = x.variant AND iso.half = x.half)) AS calibrated FROM x)"""


@query(f"{_FILLED} SELECT * FROM filled")
def bt_isotonic_filled(spark: SparkSession, d: str) -> DataFrame:
    hist = verification.histogram(src.members(spark, d))
    return scores.isotonic_filled(verification.isotonic(hist, ["variant", "half"]), hist, ["variant", "half"])


@query(f"""{_FILLED} SELECT h.variant, round(sum(pos * pow(1 - calibrated, 2) + neg * pow(calibrated, 2)) / sum(pos + neg), 6) AS brier FROM h JOIN filled AS f ON f.variant = h.variant AND f.half = 1 - h.half AND f.bin = h.bin GROUP BY h.variant""")
def bt_cross_fitted_brier(spark: SparkSession, d: str) -> DataFrame:
    hist = verification.histogram(src.members(spark, d))
    fit = scores.isotonic_filled(verification.isotonic(hist, ["variant", "half"]), hist, ["variant", "half"]).select("variant", (1 - F.col("half")).alias("half"), "bin", "calibrated")
    q = F.col("calibrated")
    return hist.join(F.broadcast(fit), ["variant", "half", "bin"]).groupBy("variant").agg(F.round(F.sum(F.col("pos") * (1 - q) * (1 - q) + F.col("neg") * q * q) / F.sum(F.col("pos") + F.col("neg")), 6).alias("brier"))


@query(f"""{_M} SELECT region, t // 21600 AS block, variant, {_HMF} FROM m GROUP BY ALL""")
def bt_merged_state(spark: SparkSession, d: str) -> DataFrame:
    """Accumulators of two runs, the second over what the first had not seen, merged by sums."""
    m = src.members(spark, d)
    parts = scores.block_counts(m.where("t % 7200 < 3600")).unionByName(scores.block_counts(m.where("t % 7200 >= 3600")))
    return parts.groupBy("region", "block", "variant").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "false_alarms")])


@query(f"""{_M}, l AS (SELECT region, max(t) AS last FROM m WHERE point % 3 > 0 GROUP BY region) SELECT m.region, count(DISTINCT t) AS issues, min(t) AS first FROM m JOIN l ON l.region = m.region WHERE m.t > l.last GROUP BY m.region
UNION ALL SELECT region, 0, NULL FROM l WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.region = l.region AND m.t > l.last)""")
def bt_new_issues(spark: SparkSession, d: str) -> DataFrame:
    """What an incremental run scores: issues after the last scored one of each region."""
    m = src.members(spark, d).select("region", "t", "point").distinct()
    last = m.where("point % 3 > 0").groupBy("region").agg(F.max("t").alias("last"))
    met = last.join(m, (last["region"] == m["region"]) & (m["t"] > last["last"]), "left")
    return met.groupBy(last["region"]).agg(F.count_distinct("t").alias("issues"), F.min("t").alias("first"))


_PIVOT = lambda v, keys: ", ".join(f"max({v}) FILTER ({keys} = {m}) AS m{m}".replace("FILTER (", "FILTER (WHERE ") for m in (10, 30, 60))


@query(f"""{_M}, c AS (SELECT * FROM (VALUES ('moderate', 30, 40), ('heavy', 40, 50)) AS v(class, lo, hi)), t AS (SELECT variant, class, lead, count(*) FILTER (WHERE fc >= lo AND fc < hi AND obs >= lo AND obs < hi) AS h, count(*) FILTER (WHERE (fc >= lo AND fc < hi) OR (obs >= lo AND obs < hi)) AS n FROM m, c GROUP BY ALL),
s AS (SELECT *, CASE WHEN n = 0 THEN '-' ELSE printf('%.3f', round(h / n, 9)) END AS txt FROM t) SELECT class, variant, {_PIVOT("txt", "lead")} FROM s GROUP BY ALL""")
def rep_classes(spark: SparkSession, d: str) -> DataFrame:
    classes = tuple(c for c in scores.CLASSES if c[0] in ("moderate", "heavy"))
    r = scores.class_results(src.members(spark, d), classes, "TREC").withColumn("txt", decimal("csi"))
    return r.groupBy("class", "variant").pivot("lead", [10, 30, 60]).agg(F.max("txt")).select("class", "variant", *[F.col(str(m)).alias(f"m{m}") for m in (10, 30, 60)])


def decimal(c: str, digits: int = 3):
    """A number as text, a dash for none."""
    return F.when(F.col(c).isNull(), "-").otherwise(F.format_string(f"%.{digits}f", F.col(c)))


@query(f"""{_G}, p AS (SELECT g.*, win FROM g, (VALUES (1), (3)) AS b(win)), n AS (SELECT p.k, p.x, p.y, win, count(*) AS c, count(*) FILTER (WHERE q.fc >= 20) AS f, count(*) FILTER (WHERE q.obs >= 20) AS o FROM p JOIN g AS q ON q.k = p.k AND abs(q.x - p.x) <= win // 2 AND abs(q.y - p.y) <= win // 2 GROUP BY ALL),
s AS (SELECT win, printf('%.2f', round(1 - sum(pow(f / c - o / c, 2)) / sum(pow(f / c, 2) + pow(o / c, 2)), 9)) AS txt FROM n GROUP BY win) SELECT 20.0::DOUBLE AS threshold, max(txt) FILTER (WHERE win = 1) AS w1, max(txt) FILTER (WHERE win = 3) AS w3 FROM s""")
def rep_fss(spark: SparkSession, d: str) -> DataFrame:
    f = scores.fss(scores.fractions(src.full_grid(spark, d), [20.0], [1, 3])).withColumn("txt", decimal("fss", 2))
    return f.groupBy("threshold").pivot("window", [1, 3]).agg(F.max("txt")).select("threshold", F.col("1").alias("w1"), F.col("3").alias("w3"))


@query(f"""{_M}, r AS (SELECT *, max(greatest(fc, obs)) OVER (PARTITION BY point) AS top, greatest(fc, 0) - greatest(obs, 0) AS e FROM m WHERE lead = 30), c AS (SELECT a.variant AS v, b.variant AS w, round(corr(a.e, b.e), 9) AS r FROM r AS a JOIN r AS b ON a.point = b.point WHERE a.top >= 20 GROUP BY ALL)
SELECT v, {", ".join(f"max(printf('%.2f', r)) FILTER (WHERE w = '{x}') AS {x}" for x in src.VARIANTS)} FROM c GROUP BY v""")
def rep_correlation(spark: SparkSession, d: str) -> DataFrame:
    c = scores.error_correlation(src.members(spark, d), src.VARIANTS).withColumn("txt", decimal("r", 2))
    return c.groupBy("v").pivot("w", src.VARIANTS).agg(F.max("txt"))


@query(f"""{_M}, t AS (SELECT region % 3 AS grp, variant, {_HMF} FROM m WHERE lead <= 60 GROUP BY ALL UNION ALL SELECT -1, variant, {_HMF} FROM m WHERE lead <= 60 GROUP BY variant), s AS (SELECT grp, variant, {_CSI} AS csi FROM t)
SELECT a.grp::INT AS grp, printf('%+.3f', round(b.csi - a.csi, 9)) AS lk_less_trec FROM s AS a JOIN s AS b ON a.grp = b.grp AND a.variant = 'TREC' AND b.variant = 'LK'""")
def rep_comparisons(spark: SparkSession, d: str) -> DataFrame:
    m = src.members(spark, d).where("lead <= 60")
    tags = F.explode(F.array(F.lit(-1), (F.col("region") % 3).cast("int"))).alias("grp")
    s = m.select("variant", "fc", "obs", tags).groupBy("grp", "variant").agg(*verification.contingency(F.col("fc") >= 20, F.col("obs") >= 20)[:3]).select("grp", "variant", scores.csi().alias("csi"))
    wide = s.groupBy("grp").pivot("variant", ["TREC", "LK"]).agg(F.max("csi"))
    return wide.select("grp", F.format_string("%+.3f", F.round(F.col("LK") - F.col("TREC"), 9)).alias("lk_less_trec"))


@query(f"""{_M}, t AS (SELECT variant, lead, {_HMF}, round(avg(pow(prob - (obs >= 20)::INT, 2)), 6) AS brier FROM m GROUP BY GROUPING SETS ((variant))), u AS (SELECT variant, {_CSI} AS csi, round(hits / nullif(hits + misses, 0), 9) AS pod, brier FROM (SELECT variant, {_HMF}, round(avg(pow(prob - (obs >= 20)::INT, 2)), 6) AS brier FROM m GROUP BY variant))
SELECT variant, printf('%.3f', csi) AS csi, printf('%.0f%%', 100 * pod) AS pod, printf('%.3f', brier) AS brier, coalesce(printf('%.2f', nullif(round(1 - brier / (SELECT brier FROM u WHERE variant = 'TREC'), 6), 0)), '-') AS bss FROM u""".replace(f"t AS (SELECT variant, lead, {_HMF}, round(avg(pow(prob - (obs >= 20)::INT, 2)), 6) AS brier FROM m GROUP BY GROUPING SETS ((variant))), ", ""))
def rep_summary(spark: SparkSession, d: str) -> DataFrame:
    r = scores.results(src.members(spark, d), "TREC").where("lead IS NULL")
    pod = scores.safe(F.col("hits"), F.col("hits") + F.col("misses"))
    return r.withColumns({"pod": pod, "bss": F.when(F.col("variant") != "TREC", F.col("bss"))}).select("variant", decimal("csi").alias("csi"), F.format_string("%.0f%%", 100 * F.col("pod")).alias("pod"), decimal("brier").alias("brier"), decimal("bss", 2).alias("bss"))


@query("""SELECT * FROM (VALUES ('persistence', '', false, 0), ('LK', 'LK', false, 1), ('LK trend', 'LK', true, 2), ('HS', 'HS', false, 3), ('HS trend', 'HS', true, 4), ('TREC', 'TREC', false, 5), ('TREC trend', 'TREC', true, 6), ('mean', 'mean', false, 7), ('mean trend', 'mean', true, 8)) AS v(name, method, trend, ord)""")
def bt_variant_grid(spark: SparkSession, d: str) -> DataFrame:
    """Persistence, then each method without and with a trend, then their means."""
    methods = ["LK", "HS", "TREC", "mean"]
    rows = [("persistence", "", False)] + [(m + (" trend" if t else ""), m, t) for m in methods for t in (False, True)]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, method string, trend boolean, ord int")
