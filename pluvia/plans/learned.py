"""Queries of learned forecasts: calibration, thresholds by lead, models with folds left out and their scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions import geo
from pluvia.operators import boosting, features, histories, issues, learned
from pluvia.plans.issues import ALL, MOTION
from pluvia.plans.registry import query
from pluvia.plans.scores import _M
from pluvia.session import shared_dir
from pluvia.sources import driver_tables as src


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one method (HS) with what another (LK) says at the same point and lead."""
    m = src.members(spark, d)
    w, event = 1.0 + F.col("point") % 2, F.coalesce(F.col("obs") >= 20, F.lit(False))
    said = F.max(F.when(F.col("variant") == "LK", F.col("fc") >= 20))
    one = m.groupBy("point", "lead").agg(F.max(F.when(F.col("variant") == "HS", F.col("prob"))).alias("p"), F.bool_or(event).alias("event"), said.alias("said"))
    return one.select("lead", "p", "event", "said", w.alias("w"))


_ROWS = f"{_M}, r AS MATERIALIZED (SELECT lead, max(prob) FILTER (WHERE variant = 'HS') AS p, bool_or(coalesce(obs >= 20, false)) AS event, bool_or(fc >= 20) FILTER (WHERE variant = 'LK') AS said, 1.0 + point % 2 AS w FROM m GROUP BY point, lead)"


@query(f"""{_ROWS}, g AS MATERIALIZED (SELECT p, sum(w) AS w, sum(w * event::INT) AS e, row_number() OVER (ORDER BY p) AS i FROM r GROUP BY p),
s AS MATERIALIZED (SELECT i, sum(w) OVER (ORDER BY i) AS cw, sum(e) OVER (ORDER BY i) AS ce, w, e FROM g),
lo AS (SELECT a.i AS j, q.i, min((b.ce - a.ce + a.e) / (b.cw - a.cw + a.w)) AS v FROM s AS a JOIN s AS q ON q.i >= a.i JOIN s AS b ON b.i >= q.i GROUP BY a.i, q.i), iso AS (SELECT i, max(v) AS y FROM lo GROUP BY i)
SELECT lead, count(*) AS n, round(avg(y), 6) AS mean, round(sum(r.w * pow(y - event::INT, 2)) / sum(r.w), 6) AS brier, round(sum(r.w * pow(r.p - event::INT, 2)) / sum(r.w), 6) AS brier_before FROM r JOIN g ON g.p = r.p JOIN iso ON iso.i = g.i GROUP BY lead""")
def trn_calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Brier scores by lead before and after calibration by the rising function of least squares."""
    rows = _labelled(spark, d)
    moved = learned.calibrated(rows, learned.isotonic(rows))
    brier = lambda c: F.round(F.sum(F.col("w") * (F.col(c) - F.col("event").cast("int")) ** 2) / F.sum("w"), 6)
    return moved.groupBy("lead").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("mean"), brier("prob").alias("brier"), brier("p").alias("brier_before"))


def _rates_sql(h: str, m: str, f: str) -> str:
    return f"round({h} / nullif({h} + {m} + {f}, 0), 9) AS csi, round({h} / nullif({h} + {m}, 0), 9) AS pod, round({f} / nullif({h} + {f}, 0), 9) AS far, round(({h} + {f}) / nullif({h} + {m}, 0), 9) AS bias"


@query(f"""{_ROWS}, b AS (SELECT *, greatest(least(floor(round(p * 100, 6)), 100), 0) AS b FROM r), k AS (SELECT lead, k, sum(w * (event AND b >= k)::INT) AS h, sum(w * (event AND b < k)::INT) AS m, sum(w * (NOT event AND b >= k)::INT) AS f,
sum(w * (event AND said)::INT) AS eh, sum(w * (event AND NOT said)::INT) AS em, sum(w * (NOT event AND said)::INT) AS ef FROM b, range(5, 96) AS t(k) GROUP BY ALL),
g AS (SELECT a.lead, a.k, {", ".join(f"sum(c.{x})::DOUBLE AS {x}" for x in ("h", "m", "f", "eh", "em", "ef"))} FROM k AS a JOIN k AS c ON c.k = a.k AND abs(c.lead - a.lead) <= 10 GROUP BY ALL),
s AS (SELECT lead, k, {_rates_sql("h", "m", "f")}, {_rates_sql("eh", "em", "ef").replace(" AS ", " AS e_")} FROM g),
x AS (SELECT lead, k FROM s WHERE pod >= e_pod AND far <= e_far QUALIFY row_number() OVER (PARTITION BY lead ORDER BY csi DESC, k) = 1), y AS (SELECT lead, k FROM s WHERE abs(bias - e_bias) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lead ORDER BY abs(bias - e_bias), k) = 1)
SELECT l.lead, coalesce(x.k, y.k, 50) / 100 AS p FROM (SELECT DISTINCT lead FROM r) AS l LEFT JOIN x ON x.lead = l.lead LEFT JOIN y ON y.lead = l.lead""")
def trn_lead_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of each lead against what another forecast catches there."""
    return learned.lead_thresholds(_labelled(spark, d).withColumnRenamed("p", "prob"), [])


#: Small models: classes, settings and sets of the two queries.
_CLASSES, _SETTINGS, _SETS = (20.0, 40.0), boosting.Settings(rounds=4, leaves=6, depth=3, rate=0.4, patience=2), ("ens",)


def _member_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the members' forecasts at every point and lead, regions being placed by their number."""
    m, r = src.members(spark, d), F.col("region")
    said = lambda v: F.max(F.when(F.col("variant") == v, F.col("fc")))
    told = m.groupBy("region", "t", "point", F.col("lead").cast("double").alias("lead")).agg(
        *[said(v).alias(f"m_{v.lower()}") for v in features.MEMBERS], F.avg("fc").alias("m_mean"), F.stddev_pop("fc").alias("m_std"), F.min("fc").alias("m_min"), F.max("fc").alias("m_max"), F.avg("prob").alias("m_prob"), F.max("obs").alias("obs")
    )
    return told.select("t", "obs", F.concat(F.lit("r"), r).alias("name"), F.lit(1.0).alias("weight"), geo.fold(r * 7.0, r * 13.0).alias("fold"), *learned.names_of("ens"))


def _fits(rows: DataFrame) -> dict[tuple[str, int], learned.Fit]:
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return learned.left_out(spark.read.parquet(path), _SETS, (0, 1), classes=_CLASSES, settings=_SETTINGS)


@query()
def trn_left_out(spark: SparkSession, d: str) -> DataFrame:
    """What models trained without a fold score on the regions held out, by class and lead, beside the members' mean."""
    found = [(s, k, *r) for (s, k), one in _fits(_member_rows(spark, d)).items() for r in one.report]  # a row a set, fold, class and lead
    return spark.createDataFrame(found, "set string, fold int, dbz double, lead int, pstar double, pod double, far double, csi double, ens_pod double, ens_far double, ens_csi double")


@query()
def bt_learned_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores by variant and lead of the issue loop, learned forecasts included, each region by the model that never
    saw its fold."""
    cells, r = src.scenes(spark, d), F.col("region")
    # Regions all over the world, so both folds have some from the first; what is held out is blocks of six hours.
    regions = cells.select(r).distinct().select(r, (r * 31 % 120 - 59.5).cast("double").alias("lat"), (r * 47 % 340 - 169.75).cast("double").alias("lon"), F.concat(F.lit("r"), r).alias("name"))
    sources = features.sources(histories.images(cells, src.SCENE, src.SCENE), regions)
    rows = learned.training_rows(features.issue_rows(sources, ALL, MOTION, scenes=False), regions)
    fits = _fits(rows.withColumn("name", F.concat_ws("/", "name", F.floor(F.col("t") / histories.SPAN))))
    models = {k: one.model for k, one in fits.items()}
    return issues.lead_scores(learned.scored(sources, ALL, models, MOTION))
