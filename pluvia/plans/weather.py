"""Queries of weather answers: made of the events, parsed, stored by day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.plans.registry import query
from pluvia.session import shared_dir
from pluvia.sources import driver_tables as src
from pluvia.sources import weather

_HOURS = """h AS (SELECT user_id AS request, floor(epoch(ts))::BIGINT // 3600 * 3600 AS t, max(value) AS cape, CASE WHEN count(*) > 1 THEN count(*)::DOUBLE END AS cin, round(min(value), 1) AS li FROM events GROUP BY ALL)"""
_ROWS = f"""{_HOURS}, w AS (SELECT request, p::INT AS place, request % 60 + p * 0.25 AS lat, t, cape * (p + 1) AS cape, cin AS convective_inhibition, li AS lifted_index FROM h, range(3) AS r(p) WHERE p <= request % 3)"""


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """An answer for every user: one to three places with an hour for each in which there are events."""
    e = src.event_times(spark, d)
    hours = e.groupBy(F.col("user_id").alias("request"), (F.floor(F.col("t") / 3600) * 3600).cast("long").alias("t")).agg(
        F.max("value").alias("cape"), F.when(F.count("*") > 1, F.count("*").cast("double")).alias("cin"), F.round(F.min("value"), 1).alias("li")
    )
    by = hours.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("t", "cape", "cin", "li"))).alias("h"))
    pick = lambda c: F.transform("h", lambda x: x[c])
    place = by.select("request", "h", F.explode(F.sequence(F.lit(0), (F.col("request") % 3).cast("int"))).alias("p"))
    hourly = F.struct(pick("t").alias("time"), F.transform("h", lambda x: x["cape"] * (F.col("p") + 1)).alias("cape"), pick("cin").alias("convective_inhibition"), pick("li").alias("lifted_index"))
    one = place.select("request", "p", F.struct((F.col("request") % 60 + F.col("p") * 0.25).alias("latitude"), F.lit(1.5).alias("longitude"), hourly.alias("hourly")).alias("o"))
    options = {"ignoreNullFields": "false"}
    told = one.groupBy("request").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "o"))), lambda x: x["o"]).alias("l"))
    body = F.when(F.size("l") == 1, F.to_json(F.get("l", F.lit(0)), options)).otherwise(F.to_json("l", options))
    return told.select("request", F.size("l").alias("asked"), body.alias("body"))


@query(f"WITH {_ROWS} SELECT request, place, lat::DOUBLE AS lat, t, round(cape, 6) AS cape, convective_inhibition, lifted_index FROM w")
def src_weather_answers(spark: SparkSession, d: str) -> DataFrame:
    """A row an hour of every place of the answers, one place or more."""
    return weather.hourly(_bodies(spark, d)).select("request", "place", "lat", "t", F.round("cape", 6).alias("cape"), "convective_inhibition", "lifted_index")


@query(f"WITH {_ROWS}, n AS (SELECT max(t) // 86400 AS today FROM h) SELECT t // 86400 AS day, count(*) AS hours, count(DISTINCT request * 10 + place) AS points, round(sum(cape), 4) AS cape FROM w, n WHERE t // 86400 < today AND NOT (request % 5 = 0 AND t // 86400 % 2 = 0) GROUP BY day")
def snk_weather_days(spark: SparkSession, d: str) -> DataFrame:
    """Hours by day after two rounds of storing: days of every fifth user that were there before stay as they were (empty
    of hours), and the last day is left out, as it is not over."""
    rows = weather.hourly(_bodies(spark, d)).withColumn("point", F.concat_ws("_", "request", "place")).select("request", "point", "t", *weather.VARIABLES)
    now = rows.agg(F.max("t")).first()[0] or 0
    day = F.floor(F.col("t") / weather.DAY).cast("long")
    there = rows.where("request % 5 = 0").select("point", day.alias("day")).where("day % 2 = 0").distinct()
    path = f"{shared_dir(spark)}/weather-{uuid.uuid4().hex}"
    fresh = weather.fresh_days(rows, there, now)
    weather.store_days(fresh, path)
    weather.store_days(weather.fresh_days(rows, weather.read_days(spark, path, 0, now).select("point", "day").unionByName(there), now), path)
    return weather.read_days(spark, path, 0, now).groupBy("day").agg(F.count("*").alias("hours"), F.count_distinct("point").alias("points"), F.round(F.sum("cape"), 4).alias("cape"))
