"""Places as rows: near duplicates, nearest gazetteer entries, address ranges."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.functions.geo import EARTH_M, haversine_m
from pluvia.session import shared_dir


def place_key(name: Column) -> Column:
    """A name without case and white space."""
    return F.lower(F.regexp_replace(name, r"\s+", ""))


def without_near_duplicates(places: DataFrame, keys: list[str], metres: float = 300.0) -> DataFrame:
    """places (keys, ord, name, lat, lon) without those that lie within so many metres of an earlier
    kept one of the same name.

    Names meet their own kind only, within one answer (keys): a list of a few dozen. Which row is
    kept depends on the rows kept before it, so the fold runs along that list.
    """
    row = F.struct("ord", "name", "lat", "lon")
    listed = places.groupBy(*keys, place_key(F.col("name")).alias("_key")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    near = lambda p, q: haversine_m(p["lat"], p["lon"], q["lat"], q["lon"]) < metres
    none = F.slice(F.col("rows"), 1, 0)
    kept = F.aggregate("rows", none, lambda acc, p: F.when(F.exists(acc, lambda q: near(p, q)), acc).otherwise(F.array_append(acc, p)))
    return listed.select(*keys, F.explode(kept).alias("p")).select(*keys, "p.*")


def nearest(points: DataFrame, gazetteer: DataFrame, cell: float = 5.0, finer: tuple[int, ...] = (64, 8, 1)) -> DataFrame:
    """points (id, lat, lon) with the name and distance of the nearest gazetteer row (name, lat, lon)
    in the cells around it; without one, the coordinates stand for a name.

    Equal places are asked and met once. They meet in squares a part of the cell (finer: powers of two, the last is 1), each
    with those around it; a place that lies nearer than the rim of these squares can't be beaten, and only points without
    one go on to wider squares, so dense places meet few others. The result of each round is written to the shared folder.
    """
    spark = points.sparkSession
    folder = f"{shared_dir(spark)}/nearest-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    places = written(gazetteer.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon")).agg(F.min("name").alias("name")), "places")
    left = points.select("lat", "lon").distinct().where("lat IS NOT NULL AND lon IS NOT NULL")
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    d = F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("g_lat"), F.col("g_lon")), 3)
    rounds = []
    for part in finer:
        width = cell / part
        at = lambda c: F.floor(F.col(c) / width).cast("int")  # noqa: B023, E731
        spread = places.select("name", "g_lat", "g_lon", at("g_lat").alias("y"), at("g_lon").alias("x"), step).select("name", "g_lat", "g_lon", (F.col("y") + F.col("o.i")).alias("cy"), (F.col("x") + F.col("o.j")).alias("cx"))
        met = left.withColumns({"cy": at("lat"), "cx": at("lon")}).join(spread, ["cy", "cx"])
        best = met.groupBy("lat", "lon").agg(F.min(F.struct(d.alias("d"), "name")).alias("b"))
        if part != 1:
            # Metres to the parallels and meridians a square away, less what rounding can hide.
            rim = EARTH_M * F.least(F.lit(math.radians(width)), F.asin(F.greatest(F.lit(0.0), F.cos(F.radians("lat"))) * math.sin(math.radians(width))))
            best = best.where(F.col("b.d") < rim - 0.01)
        rounds.append(written(best, f"found{part}"))
        left = left.join(rounds[-1].select("lat", "lon"), ["lat", "lon"], "left_anti")
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    return points.join(found, ["lat", "lon"], "left").select("id", F.coalesce("b.name", F.format_string("%.5f, %.5f", "lat", "lon")).alias("name"), F.col("b.d").alias("metres"))


def ip_number(text: Column) -> Column:
    """An IPv4 address as a number, null if it is none."""
    part = lambda i: F.try_element_at(F.split(text, r"\."), F.lit(i)).try_cast("int")
    fits = F.size(F.split(text, r"\.")) == 4
    for i in range(1, 5):
        fits = fits & part(i).between(0, 255)
    return F.when(fits, part(1).cast("long") * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def is_private(ip: Column) -> Column:
    n = ip_number(ip)
    return n.between(167772160, 184549375) | n.between(2886729728, 2887778303) | n.between(3232235520, 3232301055) | n.between(2130706432, 2147483647)


def client_address(peer: Column, forwarded: Column) -> Column:
    """The last forwarded address if the peer is a private one (a proxy of ours), else the peer."""
    last = F.trim(F.element_at(F.split(F.coalesce(forwarded, F.lit("")), ","), -1))
    return F.when(is_private(peer) & ip_number(last).isNotNull(), last).otherwise(peer)


def countries(addresses: DataFrame, ranges: DataFrame, bits: int = 16) -> DataFrame:
    """addresses (id, n) with the country of the range (low, high, country) that holds n.

    Ranges are cut at blocks of 2^bits addresses, so the range join is an equi-join on blocks.
    """
    block = lambda c: F.shiftright(F.col(c), bits)
    cut = ranges.select("*", F.explode(F.sequence(block("low"), block("high"))).alias("_b"))
    met = addresses.withColumn("_b", block("n")).join(cut, "_b", "left").withColumn("inside", F.col("n").between(F.col("low"), F.col("high")))
    return met.groupBy("id").agg(F.max(F.when(F.col("inside"), F.col("country"))).alias("country"))


def latest_places(visits: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """The most recent distinct places of each key, newest first: (keys, place, seen, position)."""
    newest = visits.groupBy(*keys, "place").agg(F.max("seen").alias("seen"))
    return newest.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("seen"), "place"))).where(F.col("position") <= most)
