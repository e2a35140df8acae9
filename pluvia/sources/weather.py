"""Answers of a weather service, and the files of past days that they fill.

An answer is one JSON object for one place and an array of them for more; each holds hourly arrays side by side. They are
parsed as VARIANT, so both shapes are one column, and zipped into a row an hour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values, in this order: the hourly variables that are asked for.
VARIABLES = ("cape", "convective_inhibition", "lifted_index", "precipitation", "showers", "cloud_cover", "total_column_integrated_water_vapour")
DAY = 86_400
_NUMBERS = r"^(VOID|ARRAY<(VOID|BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))>)$"


def _answers(bodies: DataFrame) -> DataFrame:
    """bodies with `list` (VARIANTs of the places; null if the body is not what was asked for) and `fault`."""
    text = F.ltrim(F.coalesce("body", F.lit("")))
    # A lone object is the list of one; where several are asked for it is a fault.
    lone = text.startswith("{") & (F.col("asked") == 1)
    parsed = F.try_parse_json(F.when(lone, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text))
    listed = bodies.withColumn("list", F.try_variant_get(parsed, "$", "array<variant>"))
    refused = F.exists("list", lambda o: F.coalesce(F.try_variant_get(o, "$.error", "boolean"), F.lit(False)))
    untimed = F.exists("list", lambda o: F.try_variant_get(o, "$.hourly.time", "array<long>").isNull())
    # Absent or null is no fault, but anything else than a list of numbers and nulls is.
    no_numbers = lambda o, v: F.coalesce(~F.schema_of_variant(F.try_variant_get(o, f"$.hourly.{v}", "variant")).rlike(_NUMBERS), F.lit(False))
    odd = F.exists("list", lambda o: reduce(Column.__or__, [no_numbers(o, v) for v in VARIABLES]))
    fault = F.when(F.col("list").isNull(), "not a list of answers").when(F.size("list") != F.col("asked"), "another number of answers").when(refused, "refused").when(untimed, "no times").when(odd, "no numbers")
    return listed.withColumn("fault", fault)


def faults(bodies: DataFrame) -> DataFrame:
    """(request, fault) of the answers (request, asked, body) that can't be taken; null bodies are such."""
    return _answers(bodies).where("fault IS NOT NULL").select("request", "fault")


def hourly(bodies: DataFrame) -> DataFrame:
    """(request, place, lat, lon, t, *VARIABLES): a row an hour of every place of the answers (request, asked, body: places
    asked for, JSON) without a fault; places are numbered from 0. Variables that are absent, null or shorter than
    the times are NULL there."""
    good = _answers(bodies).where("fault IS NULL").select("request", F.posexplode("list").alias("place", "o"))
    arrays = [F.try_variant_get("o", "$.hourly.time", "array<long>").alias("t"), *[F.try_variant_get("o", f"$.hourly.{v}", "array<double>").alias(v) for v in VARIABLES]]
    wide = good.select("request", "place", F.try_variant_get("o", "$.latitude", "double").alias("lat"), F.try_variant_get("o", "$.longitude", "double").alias("lon"), *arrays)
    value = lambda v: F.get(F.col(v), F.col("i")).alias(v)
    return wide.select("*", F.posexplode("t").alias("i", "at")).where("at IS NOT NULL").select("request", "place", "lat", "lon", F.col("at").alias("t"), *[value(v) for v in VARIABLES])


def fresh_days(rows: DataFrame, stored: DataFrame, now: int) -> DataFrame:
    """(point, day, t, *VARIABLES) of days that are to be stored: over by `now` (today and later may still change), and of
    which nothing is stored. Of an hour told twice one row stays. rows: point, t, *VARIABLES; stored: point, day."""
    day = F.floor(F.col("t") / DAY).cast("long")
    past = rows.where(day < now // DAY).withColumn("day", day)
    one = past.groupBy("point", "day", "t").agg(*[F.max(v).alias(v) for v in VARIABLES])
    return one.join(stored.select("point", "day").distinct(), ["point", "day"], "left_anti")


def store_days(rows: DataFrame, path: str) -> None:
    """Add day rows (see fresh_days) to the store, a folder a day."""
    rows.write.mode("append").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """(point, t, *VARIABLES, day) of the stored days from low to high; other days' files are not opened."""
    schema = "point string, t long, " + ", ".join(f"{v} double" for v in VARIABLES) + ", day long"
    return spark.read.schema(schema).parquet(path).where(F.col("day").between(low // DAY, high // DAY))
