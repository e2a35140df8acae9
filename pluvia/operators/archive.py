"""The archive of frames and tiles: which issues it can serve, what it lacks, what may go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.functions.geo import square
from pluvia.sources.driver_tables import dealt

STEP = 600


def complete(tiles: DataFrame, keys: list[str], needed: int) -> DataFrame:
    """keys of which all `needed` tiles are there: relational division by a count of distinct slots,
    pre-aggregated, so repeated tiles do no harm."""
    return tiles.groupBy(*keys).agg(F.count_distinct("slot").alias("n")).where(F.col("n") == needed).select(*keys)


def tile_state(asked: DataFrame, cached: DataFrame, missing: DataFrame, keys: list[str]) -> DataFrame:
    """asked with state: 'data', 'missing' (known to be so) or 'unknown' (never fetched)."""
    have = cached.select(*keys).distinct().withColumn("_d", F.lit(True))
    gone = missing.select(*keys).distinct().withColumn("_m", F.lit(True))
    met = asked.join(have, keys, "left").join(gone, keys, "left")
    return met.select(*asked.columns, F.when(F.col("_d"), "data").when(F.col("_m"), "missing").otherwise("unknown").alias("state"))


def first_candidate(frames: DataFrame, cached: DataFrame, offsets: list[int], slots: int, every: bool = True) -> DataFrame:
    """frames (t) with the first candidate scan t + offset (in the given order) of which every tile
    (or any) is cached (scan, slot); frames without one are left out."""
    have = cached.groupBy("scan").agg(F.count_distinct("slot").alias("n"))
    asked = frames.select("t", F.posexplode(F.array(*[F.lit(o) for o in offsets])).alias("rank", "o")).select("t", "rank", ((F.floor(F.col("t") / STEP) * STEP).cast("long") + F.col("o")).alias("scan"))
    met = asked.join(have, "scan").where(F.col("n") >= (slots if every else 1))
    return met.groupBy("t").agg(F.min_by(F.struct("scan", "n"), "rank").alias("b")).select("t", "b.scan", "b.n")


def usable(frames: DataFrame, keys: list[str], pairs: int, leads: list[int]) -> DataFrame:
    """Issues of which every history step and every lead is there: needed times exploded, matched,
    and counted."""
    offsets = [-i * STEP for i in range(1, pairs + 1)] + [60 * m for m in leads]
    need = frames.select(*keys, "t", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("o")).select(*keys, "t", (F.col("t") + F.col("o")).alias("at"))
    there = frames.select(*keys, F.col("t").alias("at")).distinct()
    return need.join(there, [*keys, "at"]).groupBy(*keys, "t").agg(F.count_distinct("at").alias("n")).where(F.col("n") == len(set(offsets))).select(*keys, "t")


def inventory(frames: DataFrame, spans: DataFrame, pairs: int, leads: list[int]) -> DataFrame:
    """Of each region: frames expected in its span, cached ones, unbroken runs, the longest, usable
    issues. spans: region, lo, hi."""
    w = W.partitionBy("region").orderBy("t")
    inside = frames.join(F.broadcast(spans), "region").where("t BETWEEN lo AND hi").select("region", "t")
    cut = F.when(F.col("t") - F.lag("t").over(w) == STEP, 0).otherwise(1)
    runs = inside.withColumn("_c", cut).withColumn("_r", F.sum("_c").over(w)).groupBy("region", "_r").agg(F.count("*").alias("n"))
    lengths = runs.groupBy("region").agg(F.sum("n").alias("cached"), F.count("*").alias("runs"), F.max("n").alias("longest"))
    issues = usable(inside, ["region"], pairs, leads).groupBy("region").agg(F.count("*").alias("usable"))
    expected = (F.floor((F.col("hi") - F.col("lo")) / STEP) + 1).alias("expected")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spans.join(lengths, "region", "left").join(issues, "region", "left").select("region", expected, zero("cached"), zero("runs"), zero("longest"), zero("usable"))


def prune_plan(frames: DataFrame, pairs: int, leads: list[int], now: int, protect: int = 3 * 3600) -> DataFrame:
    """(region, t, bytes) of frames that no usable issue needs and that are older than `protect`."""
    issues = usable(frames.select("region", "t"), ["region"], pairs, leads)
    offsets = [-i * STEP for i in range(pairs + 1)] + [60 * m for m in leads]
    needed = issues.select("region", F.explode(F.array(*[F.col("t") + o for o in offsets])).alias("t")).distinct()
    return frames.where(F.col("t") < now - protect).join(needed, ["region", "t"], "left_anti")


def idle_regions(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """Regions of which a plan leaves no frame."""
    left = frames.join(plan.select("region", "t"), ["region", "t"], "left_anti")
    return frames.select("region").distinct().join(left.select("region").distinct(), "region", "left_anti")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows less those whose keys are listed: a delete, written anew."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def merged(old: DataFrame, new: DataFrame, keys: list[str], greatest: list[str], kept: list[str]) -> DataFrame:
    """An upsert: of a key in both, `kept` columns stay and `greatest` ones take the later value."""
    n = new.groupBy(*keys).agg(*[F.max(c).alias(f"n_{c}") for c in greatest], *[F.min(c).alias(f"n_{c}") for c in kept])
    met = old.join(n, keys, "full")
    return met.select(*keys, *[F.coalesce(c, f"n_{c}").alias(c) for c in kept], *[F.greatest(c, f"n_{c}").alias(c) for c in greatest])


def missing_days(points: DataFrame, cached: DataFrame, low: int, high: int) -> DataFrame:
    """(point, day) of each snapped point and UTC day from low to high that is not cached."""
    days = F.explode(F.sequence(F.lit(low // 86400), F.lit(high // 86400))).alias("day")
    return points.select("point").distinct().select("point", days).join(cached.select("point", "day").distinct(), ["point", "day"], "left_anti")


def coverage_by_day(asked: DataFrame, cached: DataFrame) -> DataFrame:
    """(day, had, asked) of a request log of (point, day)."""
    have = cached.select("point", "day").distinct().withColumn("_h", F.lit(True))
    return asked.distinct().join(have, ["point", "day"], "left").groupBy("day").agg(F.count_if("_h").alias("had"), F.count("*").alias("asked"))


def tile_plan(points: DataFrame, frames: DataFrame, history: int) -> DataFrame:
    """(id, ord, t, x, y): the tiles of the 2x2 block at each point's corner (x, y) in the newest
    `history` frames, oldest frame first. frames: a bounded list of times."""
    newest = frames.orderBy(F.desc("t")).limit(history)
    spots = points.select("id", "x", "y", F.explode(square(0, 1)).alias("o")).select("id", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))
    spots = spots.where(F.col("x").between(0, 127) & F.col("y").between(0, 127))
    placed = spots.join(F.broadcast(newest), F.lit(True))
    return placed.select("id", F.row_number().over(W.partitionBy("id").orderBy("t", "y", "x")).alias("ord"), "t", "x", "y")


def checked_upload(plan: DataFrame, given: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """(id, missing, strange, state) of uploads against plans, by tile ids.

    Both lists are dealt by id once and counted there (rows: how many there are, if known, which bounds the tasks). Rows of null ids or keys match nothing.
    """
    known = F.lit(True)
    for c in ("id", *keys):
        known = known & F.col(c).isNotNull()
    both = plan.select("id", *keys, F.lit(1).alias("_p"), F.lit(0).alias("_g")).unionByName(given.select("id", *keys, F.lit(0).alias("_p"), F.lit(1).alias("_g")))
    # What matches nothing is kept apart by the list it came from.
    side = F.when(~known, F.col("_p"))
    tiles = (both.repartition("id") if rows is None else dealt(both, "id", rows)).withColumn("_side", side).groupBy("id", *keys, "_side").agg(F.sum("_p").alias("_p"), F.max("_g").alias("_g"))
    met = tiles.groupBy("id").agg(F.sum(F.when(F.col("_g") == 0, F.col("_p")).otherwise(0)).alias("missing"), F.count_if(F.col("_p") == 0).alias("strange"))
    return met.withColumn("state", F.when(F.col("strange") > 0, "stale").when(F.col("missing") > 0, "incomplete").otherwise("complete"))


def kept_by_size(items: DataFrame, keys: list[str], cap: int, order: list[Column]) -> DataFrame:
    """Items within a running size cap, most recently used first."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("used_size", F.sum("size").over(w)).where(F.col("used_size") <= cap)


def publish_delays(seen: DataFrame, step: int = STEP, close: int = 180, keep: int = 6) -> DataFrame:
    """(source, seen, newest, delay, lag) of index reads: a read tells a delay only if the newest frame
    moved by one step since a read at most `close` seconds before, and the delay is between 0 and a
    step; lag is the least of the last `keep` delays. seen: source, seen, newest."""
    w = W.partitionBy("source").orderBy("seen", "newest")
    moved = (F.col("newest") - F.lag("newest").over(w) == step) & (F.col("seen") - F.lag("seen").over(w) <= close)
    delay = F.col("seen") - F.col("newest")
    told = seen.withColumn("delay", F.when(moved & delay.between(0, step), delay)).where("delay IS NOT NULL")
    return told.withColumn("lag", F.min("delay").over(w.rowsBetween(-(keep - 1), 0)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def eligible(candidates: DataFrame, held: DataFrame, rejected: DataFrame, now: int, hold: int = 6 * 3600) -> DataFrame:
    """candidates (x, y, ...) whose 3x3 mosaic shares no tile with a held region's and that were not
    rejected within `hold` seconds. Held regions spread to the 25 centres they exclude, so the overlap
    is an anti-join on equal keys."""
    near = held.select("x", "y", F.explode(square(-2, 2)).alias("o")).select((F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y")).distinct()
    recent = rejected.where(F.col("at") > now - hold).select("x", "y").distinct()
    return candidates.join(near, ["x", "y"], "left_anti").join(recent, ["x", "y"], "left_anti")


#: Centres whose 3x3 mosaics share a tile with one centre's, itself included.
OVERLAPPED = 25


def filled_regions(candidates: DataFrame, held: DataFrame, places: int) -> list[tuple[int, int]]:
    """Centres taken greedily, best score first: at most a third of the places for each climate in
    the first pass, any in the second, none overlapping.

    At most `places` are taken, each of which rules out OVERLAPPED centres, so whatever is taken before, the best
    free candidate of a climate is among its first OVERLAPPED * places + 1: no more of each go to the
    driver, and none that could be taken stays behind. Candidates of equal centre count once.
    """
    near = held.select("x", "y", F.explode(square(-2, 2)).alias("o")).select((F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y")).distinct()
    one = candidates.groupBy("x", "y", "climate").agg(F.max("score").alias("score")).join(near, ["x", "y"], "left_anti")
    best = W.partitionBy("climate").orderBy(F.desc("score"), "x", "y")
    few = one.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= OVERLAPPED * places + 1)
    ranked = sorted(few.collect(), key=lambda r: (-r["score"], r["x"], r["y"]))
    free_places = places - held.select("x", "y").distinct().count()
    climates = {r["climate"]: 0 for r in ranked}
    out: list[tuple[int, int]] = []
    for quota in (-(-places // 3), places):
        for r in ranked:
            free = all(max(abs(r["x"] - x), abs(r["y"] - y)) >= 3 for x, y in out)
            if free and len(out) < free_places and climates[r["climate"]] < quota:
                out.append((r["x"], r["y"]))
                climates[r["climate"]] += 1
    return out
