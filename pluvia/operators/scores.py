"""Scores of forecast variants that share their points: errors, ensembles, comparisons, bootstrap.

Members are rows (region, t, point, lead, variant, fc, obs, prob). All measures are sums that
merge over tasks, blocks and runs; what leaves the shuffle has a row for each variant, lead,
class or block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.functions.radar import rain_rate
from pluvia.operators.verification import BLOCK_S, contingency

#: The classes that the application reports, from (inclusive) to (exclusive; None: open).
CLASSES = (("light", 20.0, 30.0), ("moderate", 30.0, 40.0), ("heavy", 40.0, 50.0), ("very heavy", 50.0, None), ("moderate or worse", 30.0, None), ("heavy or worse", 40.0, None))
#: Thresholds of published verifications, in mm/h and in dBZ.
PAPER_RATES, PAPER_DBZ = (1, 4, 5, 8, 10, 15), (20, 30, 40)
#: Fewest blocks that a bootstrap draws from, and its resamples.
MIN_BLOCKS, RESAMPLES = 10, 1000


def safe(a: Column, b: Column, digits: int = 9) -> Column:
    """a / b, NULL where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def csi(h: str = "hits", m: str = "misses", f: str = "false_alarms") -> Column:
    return safe(F.col(h), F.col(h) + F.col(m) + F.col(f))


def _tables(threshold: float) -> list[Column]:
    return contingency(F.col("fc") >= threshold, F.col("obs") >= threshold)


def accumulated_error(members: DataFrame) -> DataFrame:
    """(variant, lead, n, error): mean difference of the rain summed up to each lead, in mm, over
    the points where either sum is above 0. The window holds the leads of one point."""
    by = W.partitionBy("variant", "point").orderBy("lead")
    hours = (F.col("lead") - F.coalesce(F.lag("lead").over(by), F.lit(0))) / 60
    rows = members.withColumn("h", hours)
    run = by.rowsBetween(W.unboundedPreceding, 0)
    summed = rows.select("variant", "lead", *[F.sum(rain_rate(F.col(c)) * F.col("h")).over(run).alias(c) for c in ("fc", "obs")])
    wet = summed.where("fc > 0 OR obs > 0")
    return wet.groupBy("variant", "lead").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("fc") - F.col("obs"))), 6).alias("error"))


def ensemble_mean(members: DataFrame, names: list[str], called: str) -> DataFrame:
    """The members' mean echo and probability at each point and lead that all of them have."""
    chosen = members.where(F.col("variant").isin(names)).groupBy("region", "t", "point", "lead")
    out = chosen.agg(F.avg("fc").alias("fc"), F.max("obs").alias("obs"), F.avg("prob").alias("prob"), F.count("*").alias("n")).where(F.col("n") == len(names))
    return out.select("region", "t", "point", "lead", F.lit(called).alias("variant"), "fc", "obs", "prob")


def error_correlation(members: DataFrame, names: list[str], lead: int = 30, threshold: float = 20.0) -> DataFrame:
    """(v, w, n, r): correlation of the variants' errors where the observation or any of them rains."""
    error = F.greatest(F.col("fc"), F.lit(0.0)) - F.greatest(F.col("obs"), F.lit(0.0))
    at = members.where(F.col("lead") == lead).groupBy("region", "t", "point")
    wide = at.agg(F.max((F.col("fc") >= threshold) | (F.col("obs") >= threshold)).alias("wet"), *[F.max(F.when(F.col("variant") == v, error)).alias(v) for v in names]).where("wet")
    pairs = [(v, w) for v in names for w in names]
    sums = wide.agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s_{v}") for v in names], *[F.sum(F.col(v) * F.col(w)).alias(f"p_{v}_{w}") for v, w in pairs if v <= w])
    both = lambda v, w: F.col(f"p_{min(v, w)}_{max(v, w)}")
    spread = lambda v: F.col("n") * both(v, v) - F.col(f"s_{v}") * F.col(f"s_{v}")
    r = lambda v, w: safe(F.col("n") * both(v, w) - F.col(f"s_{v}") * F.col(f"s_{w}"), F.sqrt(spread(v) * spread(w)))
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(w).alias("w"), F.when(F.col("n") >= 2, r(v, w)).alias("r")) for v, w in pairs])).alias("x")
    return sums.select("n", rows).select("x.v", "x.w", "n", "x.r")


def results(members: DataFrame, reference: str, up_to: int = 60, threshold: float = 20.0) -> DataFrame:
    """Of each variant, by lead and over all (lead NULL): counts, CSI, MAE, Brier score, its skill
    against the reference, and the plain mean of the CSIs of the leads up to `up_to`, which is
    NULL unless every one of them has a CSI and the last is there."""
    pred, obs = F.col("fc") >= threshold, F.col("obs") >= threshold
    error = F.abs(F.greatest(F.col("fc"), F.lit(0.0)) - F.greatest(F.col("obs"), F.lit(0.0)))
    sums = members.rollup("variant", "lead").agg(
        *_tables(threshold), F.sum(F.when(pred | obs, error)).alias("e"), F.count_if(pred | obs).alias("n_e"), F.avg(F.pow(F.col("prob") - obs.cast("int"), 2)).alias("b")
    )
    scored = sums.where("variant IS NOT NULL").select("variant", "lead", "hits", "misses", "false_alarms", "negatives", csi().alias("csi"), safe(F.col("e"), F.col("n_e"), 6).alias("mae"), F.round("b", 6).alias("brier"))
    base = scored.where(F.col("variant") == reference).select(F.col("lead").alias("of"), F.col("brier").alias("base"))
    mean = scored.where(F.col("lead") <= up_to).groupBy("variant").agg(F.when((F.count("csi") == F.count("*")) & (F.max("lead") == up_to), F.round(F.avg("csi"), 9)).alias("mean_csi"))
    met = scored.join(F.broadcast(base), F.col("lead").eqNullSafe(F.col("of")), "left").join(F.broadcast(mean), "variant", "left")
    return met.select(*scored.columns, F.round(1 - F.try_divide("brier", "base"), 6).alias("bss"), F.when(F.col("lead").isNull(), F.col("mean_csi")).alias("mean_csi"))


def class_results(members: DataFrame, classes: tuple, reference: str) -> DataFrame:
    """(variant, class, lead, hits, misses, false_alarms, csi, delta against the reference)."""
    dims = F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.lit(float(lo)).alias("lo"), F.lit(hi).cast("double").alias("hi")) for n, lo, hi in classes])).alias("c")
    inside = lambda v: (v >= F.col("c.lo")) & (F.col("c.hi").isNull() | (v < F.col("c.hi")))
    counted = members.select("variant", "lead", "fc", "obs", dims).groupBy("variant", F.col("c.class").alias("class"), "lead")
    out = counted.agg(*contingency(inside(F.col("fc")), inside(F.col("obs")))[:3]).withColumn("csi", csi())
    base = out.where(F.col("variant") == reference).select("class", "lead", F.col("csi").alias("base"))
    return out.join(F.broadcast(base), ["class", "lead"], "left").select(*out.columns, F.when(F.col("variant") != reference, F.round(F.col("csi") - F.col("base"), 9)).alias("delta"))


def block_counts(members: DataFrame, threshold: float = 20.0, up_to: int | None = None) -> DataFrame:
    """(region, block, variant, hits, misses, false_alarms) of six-hour blocks."""
    rows = members if up_to is None else members.where(F.col("lead") <= up_to)
    return rows.groupBy("region", F.floor(F.col("t") / BLOCK_S).cast("long").alias("block"), "variant").agg(*_tables(threshold)[:3])


def draws(key: np.ndarray, resample: np.ndarray) -> np.ndarray:
    """Poisson(1) times that each block stands in each resample, by 32-bit hashes of the two, so
    the same wherever it is worked out; keys x resamples."""
    mask = np.uint64(0xFFFFFFFF)
    h = (key.astype(np.uint64)[:, None] * np.uint64(2654435761) + resample.astype(np.uint64)[None, :] * np.uint64(40503) + np.uint64(97)) & mask
    for _ in range(2):
        h = ((h ^ (h >> np.uint64(16))) * np.uint64(73244475)) & mask
    h ^= h >> np.uint64(16)
    return np.searchsorted(poisson_cuts(), h, side="right")


def poisson_cuts() -> np.ndarray:
    """Where 32-bit hashes are cut for 0, 1, 2, ... times; beyond eight is under one in a million."""
    share = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(9)])
    return np.floor(share * 2**32).astype(np.uint64)


def bootstrap(blocks: DataFrame, variants: list[str], reference: str, resamples: int = RESAMPLES) -> DataFrame:
    """(variant, blocks, csi, low, high, delta, delta_low, delta_high): nearest-rank 95 % intervals of
    CSI, and of its difference from the reference, over resamples of whole blocks.

    A task draws how often each of its blocks stands in each resample and adds up: what is shuffled
    is a table of resamples and variants for each task. Intervals are NULL under MIN_BLOCKS blocks;
    a resample without rain counts as 0.
    """
    names = [c for v in variants for c in (f"{v}_h", f"{v}_m", f"{v}_f")]
    sums = [F.sum(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}_{c[0]}") for v in variants for c in ("hits", "misses", "false_alarms")]
    wide = blocks.groupBy("region", "block").agg(*sums).na.fill(0)
    keyed = wide.select(F.pmod(F.col("region") * 1000003 + F.col("block"), F.lit(1 << 31)).alias("key"), *names)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((resamples, len(names)), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                counts = np.stack([part.column(i + 1).to_numpy() for i in range(len(names))], 1)
                total += draws(part.column(0).to_numpy(), np.arange(resamples)).T @ counts
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(np.full(resamples, n)), *map(pa.array, total.T)], names=["r", "n", *names])

    drawn = keyed.mapInArrow(draw, "r long, n long, " + ", ".join(f"{c} long" for c in names))
    by_resample = drawn.groupBy("r").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    of = lambda v: F.coalesce(F.try_divide(F.col(f"{v}_h").cast("double"), (F.col(f"{v}_h") + F.col(f"{v}_m") + F.col(f"{v}_f")).cast("double")), F.lit(0.0))
    scored = by_resample.select("n", *[of(v).alias(f"s_{v}") for v in variants], *[(of(v) - of(reference)).alias(f"d_{v}") for v in variants])
    ranked = scored.agg(F.max("n").alias("n"), *[F.sort_array(F.collect_list(c)).alias(c) for c in scored.columns if c != "n"])
    at = lambda c, q: F.when(F.col("n") >= MIN_BLOCKS, F.round(F.element_at(c, int(q * resamples) + 1), 9))
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), at(f"s_{v}", 0.025).alias("low"), at(f"s_{v}", 0.975).alias("high"), at(f"d_{v}", 0.025).alias("delta_low"), at(f"d_{v}", 0.975).alias("delta_high")) for v in variants])).alias("x")
    whole = blocks.groupBy("variant").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "false_alarms")]).select("variant", csi().alias("csi"))
    base = whole.where(F.col("variant") == reference).select(F.col("csi").alias("base"))
    got = ranked.select("n", rows).select("x.variant", F.col("n").alias("blocks"), "x.low", "x.high", "x.delta_low", "x.delta_high")
    other = F.col("variant") != reference
    met = got.join(whole, "variant").join(F.broadcast(base), F.lit(True))  # base: one row
    return met.select("variant", "blocks", "csi", "low", "high", F.when(other, F.round(F.col("csi") - F.col("base"), 9)).alias("delta"), *[F.when(other, F.col(c)).alias(c) for c in ("delta_low", "delta_high")])


def compared(members: DataFrame, pairs: list[tuple[str, str]], up_to: int = 60, threshold: float = 20.0) -> DataFrame:
    """(base, other, max_lead, delta): difference of the CSIs pooled over the leads up to up_to; pairs
    of which a variant is missing are left out."""
    rows = members.where(F.col("lead") <= up_to)
    sums = rows.groupBy("variant").agg(*_tables(threshold)[:3], F.max("lead").alias("last")).select("variant", csi().alias("csi"), "last")
    side = lambda s: sums.select(F.col("variant").alias(s), F.col("csi").alias(f"{s}_csi"), F.col("last").alias(f"{s}_last"))
    asked = members.sparkSession.createDataFrame(pairs, "base string, other string")
    met = asked.join(F.broadcast(side("base")), "base").join(F.broadcast(side("other")), "other")
    return met.select("base", "other", F.greatest("base_last", "other_last").alias("max_lead"), F.round(F.col("other_csi") - F.col("base_csi"), 9).alias("delta"))


def grouped(members: DataFrame, climate: Column, seen: Column, threshold: float = 20.0) -> DataFrame:
    """(grp, variant, regions, csi): each climate, then regions seen by the satellite, those not, and
    the tropical ones seen; a region stands in all of its groups."""
    tags = F.array_compact(F.array(climate, F.when(seen, "sat").otherwise("nosat"), F.when(seen & (climate == "tropical"), "tropical_sat")))
    rows = members.select("region", "variant", "fc", "obs", F.explode(tags).alias("grp"))
    return rows.groupBy("grp", "variant").agg(F.count_distinct("region").alias("regions"), *_tables(threshold)[:3]).select("grp", "variant", "regions", csi().alias("csi"))


def events(frames: DataFrame, keys: list[str], step: int, least: int = 6) -> DataFrame:
    """(keys, frames, rainy, events): rain events are unbroken runs of at least `least` rainy frames;
    a dry or missing frame ends one. frames: keys, t, rainy."""
    w = W.partitionBy(*keys).orderBy("t")
    cut = F.when(F.col("rainy") & F.lag("rainy").over(w) & (F.col("t") - F.lag("t").over(w) == step), 0).otherwise(1)
    marked = frames.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(w))
    runs = marked.groupBy(*keys, "_run").agg(F.count("*").alias("n"), F.count_if("rainy").alias("r"))
    return runs.groupBy(*keys).agg(F.sum("n").alias("frames"), F.sum("r").alias("rainy"), F.count_if(F.col("r") >= least).alias("events"))


def with_dry_issues(members: DataFrame, threshold: float = 20.0, echo: float = 10.0) -> DataFrame:
    """(variant, issues, dry_issues, hits, misses, false_alarms, negatives): an issue without rain in
    the observations and without echo in any forecast only adds its points to the negatives."""
    counted = members.groupBy("region", "t", "variant").agg(*_tables(threshold), F.count("*").alias("n"), F.max("obs").alias("o"), F.max("fc").alias("f"))
    one = F.struct("variant", "hits", "misses", "false_alarms", "negatives", "n")
    issues = counted.where("region IS NOT NULL AND t IS NOT NULL").groupBy("region", "t").agg(((F.max("o") < threshold) & (F.max("f") < echo)).alias("dry"), F.collect_list(one).alias("c"))
    met = issues.select("dry", F.inline("c"))
    wet = lambda c: F.sum(F.when(~F.col("dry"), F.col(c)).otherwise(0)).alias(c)
    return met.groupBy("variant").agg(F.count("*").alias("issues"), F.count_if("dry").alias("dry_issues"), wet("hits"), wet("misses"), wet("false_alarms"), F.sum(F.when(F.col("dry"), F.col("n")).otherwise(F.col("negatives"))).alias("negatives"))


def fractions(grid: DataFrame, thresholds: list[float], windows: list[int]) -> DataFrame:
    """(threshold, window, k, num, den) of the fractions of rain over windows of covered points.

    grid: k, x, y, fc, obs of every covered point. Two passes of moving sums, along rows and then
    along columns, so a window costs the same whatever its width; a pass holds one line of a frame.
    """
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = grid.select("k", "x", "y", levels, "fc", "obs").select("k", "x", "y", "threshold", F.lit(1).alias("c"), (F.col("fc") >= F.col("threshold")).cast("int").alias("f"), (F.col("obs") >= F.col("threshold")).cast("int").alias("o"))
    out = None
    for w in windows:
        h = w // 2
        along = W.partitionBy("k", "threshold", "y").orderBy("x").rangeBetween(-h, h)
        down = W.partitionBy("k", "threshold", "x").orderBy("y").rangeBetween(-h, h)
        part = rows.select("k", "x", "y", "threshold", *[F.sum(c).over(along).alias(c) for c in "cfo"]).select("k", "threshold", *[F.sum(c).over(down).alias(c) for c in "cfo"])
        f, o = F.col("f") / F.col("c"), F.col("o") / F.col("c")
        sums = part.groupBy("k", "threshold").agg(F.sum((f - o) * (f - o)).alias("num"), F.sum(f * f + o * o).alias("den")).withColumn("window", F.lit(w))
        out = sums if out is None else out.unionByName(sums)
    return out


def fss(sums: DataFrame) -> DataFrame:
    """(threshold, window, frames, fss) pooled over frames; NULL where nothing rains."""
    pooled = sums.groupBy("threshold", "window").agg(F.count("*").alias("frames"), F.sum("num").alias("num"), F.sum("den").alias("den"))
    return pooled.select("threshold", "window", "frames", F.round(1 - F.try_divide("num", "den"), 9).alias("fss"))


def isotonic_filled(fit: DataFrame, hist: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """(keys, bin, calibrated) for every bin: a bin without data takes the next bin that has some,
    those at the end the last; without any data, the bin's middle."""
    all_bins = hist.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    up = W.partitionBy(*keys).orderBy("bin")
    met = all_bins.join(fit, [*keys, "bin"], "left")
    ahead = F.first("calibrated", True).over(up.rowsBetween(0, W.unboundedFollowing))
    behind = F.last("calibrated", True).over(up.rowsBetween(W.unboundedPreceding, 0))
    return met.select(*keys, "bin", F.coalesce(ahead, behind, (F.col("bin") + 0.5) / bins).alias("calibrated"))
