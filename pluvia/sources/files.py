"""Scans of the files that feed the engine: frame indexes, tiles, stations, palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INDEX = "generated long, host string, radar struct<past: array<struct<time: long, path: string>>>"
STATION = "id string, name string, lat double, lon double"


def frame_index(spark: SparkSession, path: str) -> DataFrame:
    """(generated, host, t, path) of the past frames of index files; an index without host has none."""
    raw = spark.read.schema(INDEX).option("multiLine", True).json(path)
    return raw.where("host <> ''").select("generated", "host", F.explode("radar.past").alias("f")).select("generated", "host", F.col("f.time").alias("t"), F.col("f.path").alias("path"))


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """(frame, z, x, y, modified, content) of cached tiles <frame>/<z>_<x>_<y>.png."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/(\d+)_(\d+)_(\d+)\.png$", i)
    return raw.select(part(1).alias("frame"), *[part(i).cast("int").alias(c) for i, c in ((2, "z"), (3, "x"), (4, "y"))], F.col("modificationTime").alias("modified"), "content")


def stations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(stations, faults): the rows of a JSON list, and a row for each rule that one breaks."""
    rows = spark.read.schema(STATION).option("multiLine", True).json(path)
    many = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("id is repeated").alias("fault"))
    bad = rows.select("id", F.when(F.coalesce("id", F.lit("")) == "", "no id").when(~F.coalesce(F.col("lat").between(-85, 85), F.lit(False)), "lat").when(~F.coalesce(F.col("lon").between(-180, 180), F.lit(False)), "lon").alias("fault"))
    return rows, bad.where("fault IS NOT NULL").unionByName(many)


def palette(entries: DataFrame) -> DataFrame:
    """(colour, dbz) from (ord, dbz, colour #rrggbbaa): rows up to the first that does not rise,
    without transparent ones, the lowest dbz of each colour. A palette is a few hundred rows."""
    w = W.orderBy("ord")
    rising = entries.withColumn("stop", F.coalesce(F.col("dbz") <= F.lag("dbz").over(w), F.lit(False)).cast("int"))
    kept = rising.withColumn("stopped", F.sum("stop").over(w)).where("stopped = 0 AND substring(colour, 8, 2) <> '00'")
    return kept.groupBy("colour").agg(F.min("dbz").alias("dbz"))
