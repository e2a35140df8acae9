"""Frame histories, as-of reads, rate windows, retention and upserts over time-keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def history_chain(frames: DataFrame, keys: list[str], pairs: int, max_gap: int) -> DataFrame:
    """Length of the unbroken history that ends at each frame, at most pairs + 1 frames."""
    w = W.partitionBy(*keys).orderBy("t")
    marked = frames.withColumn("_cut", F.when(F.col("t") - F.lag("t").over(w) <= max_gap, 0).otherwise(1)).withColumn("_run", F.sum("_cut").over(w))
    at = F.row_number().over(W.partitionBy(*keys, "_run").orderBy("t"))
    return marked.select(*keys, "t", F.least(at, F.lit(pairs + 1)).alias("chain"))


def eligible_issues(frames: DataFrame, keys: list[str], pairs: int, leads: list[int], step: int = 600) -> DataFrame:
    """Issues with a frame at every history step and at every lead, whatever lies between them: each needed offset
    is a window of its own over one exchange and sort. Frames of one time are one."""
    offsets = sorted({-step * k for k in range(1, pairs + 1)} | {60 * m for m in leads})
    order = W.partitionBy(*keys).orderBy("t")
    there = [(F.count("*").over(order.rangeBetween(o, o)) > 0).alias(f"_at{i}") for i, o in enumerate(offsets)]
    found = frames.select(*keys, "t").withColumn("_again", F.lag("t").over(order) == F.col("t")).select(*keys, "t", "_again", *there)
    needed = [F.col(f"_at{i}") for i in range(len(offsets))]
    return found.where(~F.coalesce("_again", F.lit(False)) & reduce(Column.__and__, needed, F.lit(True))).select(*keys, "t")


def publish_lag(seen: DataFrame, keep: int = 6) -> DataFrame:
    """Smallest of the last `keep` delays between a frame's time and when it was seen."""
    w = W.partitionBy("source").orderBy("t", "seen").rowsBetween(-(keep - 1), 0)
    return seen.select("source", "t", "seen", F.min(F.col("seen") - F.col("t")).over(w).alias("lag"))


def sliding_load(requests: DataFrame, keys: list[str], per: int, weight: Column | None = None) -> DataFrame:
    """Requests (or their weight) within `per` seconds up to and with each one."""
    w = W.partitionBy(*keys).orderBy("t").rangeBetween(-per + 1, 0)
    return requests.withColumn("load", F.sum(F.lit(1) if weight is None else weight).over(w))


def within_budget(requests: DataFrame, keys: list[str], budget: float, order: list[str], cost: Column) -> DataFrame:
    """Running cost of each UTC day, and whether it still fits the day's budget."""
    day = F.floor(F.col("t") / 86400)
    w = W.partitionBy(*keys, day).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return requests.withColumn("spent", F.sum(cost).over(w)).withColumn("allowed", F.col("spent") <= budget)


def alarms(samples: DataFrame, keys: list[str], over: Column, seconds: int) -> DataFrame:
    """Spans in which `over` holds without a break for at least so many seconds."""
    w = W.partitionBy(*keys).orderBy("t", "event_id")
    marked = samples.withColumn("_over", over).withColumn("_cut", F.when(F.col("_over") == F.lag("_over").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_cut").over(w))
    spans = marked.where("_over").groupBy(*keys, "_run").agg(F.min("t").alias("since"), F.max("t").alias("until"), F.count("*").alias("samples"))
    return spans.where(F.col("until") - F.col("since") >= seconds).drop("_run")


def interpolated(hourly: DataFrame, asked: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Linear interpolation of a regular series at asked times; NULL outside it. An equi-join on
    the step's start: no range join."""
    w = W.partitionBy(*keys).orderBy("t")
    pieces = hourly.select(*keys, F.col("t").alias("t0"), F.col("v").alias("v0"), F.lead("t").over(w).alias("t1"), F.lead("v").over(w).alias("v1"))
    slot = asked.withColumn("t0", (F.floor(F.col("t") / step) * step).cast("long"))
    met = slot.join(pieces, [*keys, "t0"], "left")
    part = (F.col("t") - F.col("t0")) / step
    value = F.when(F.col("t") == F.col("t0"), F.col("v0")).when(F.col("t1") == F.col("t0") + step, F.col("v0") + (F.col("v1") - F.col("v0")) * part)
    return met.select(*asked.columns, value.alias("value"))


def latest_upsert(touches: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: first_seen of the first touch by arrival, last_active the latest."""
    return touches.groupBy(*keys).agg(F.min_by("now", "seq").alias("first_seen"), F.max("now").alias("last_active"))


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return existing.unionByName(new.dropDuplicates(keys).join(existing, keys, "left_anti"))


def evicted(items: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Items beyond the running size cap, newest kept first."""
    w = W.partitionBy(*keys).orderBy(F.desc("t"), F.desc("id")).rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("kept_size", F.sum("size").over(w)).where(F.col("kept_size") > cap)


def frames_in_range(frames: DataFrame, spans: DataFrame, bucket: int) -> DataFrame:
    """frames x spans with span.lo <= t <= span.hi, as an equi-join on time buckets."""
    slots = F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))).alias("_b")
    placed = spans.select("*", slots)
    return frames.withColumn("_b", F.floor(F.col("t") / bucket)).join(placed, "_b").where("t BETWEEN lo AND hi").drop("_b")
