"""Forecast verification: contingency tables, classes, Brier, ROC, reliability, isotonic
calibration, fractions skill, bootstrap and rain events.

Measures are additive partial aggregates, so blocks, regions and runs merge by sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 20
BLOCK_S = 21600
#: The application's classes, from (inclusive) to (exclusive), in dBZ.
CLASSES = ((20.0, 30.0), (30.0, 40.0), (40.0, 50.0), (50.0, None))


def contingency(pred: Column, obs: Column, weight: Column | None = None) -> list[Column]:
    n = (lambda c: F.count_if(c)) if weight is None else (lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0)))
    return [n(pred & obs).alias("hits"), n(~pred & obs).alias("misses"), n(pred & ~obs).alias("false_alarms"), n(~pred & ~obs).alias("negatives")]


def ratios() -> list[Column]:
    """Accuracy, POD, FAR and CSI from the four counts; NULL where a denominator is 0."""
    h, m, f, c = (F.col(x) for x in ("hits", "misses", "false_alarms", "negatives"))
    safe = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 9)
    return [safe(h + c, h + m + f + c).alias("accuracy"), safe(h, h + m).alias("pod"), safe(f, h + f).alias("far"), safe(h, h + m + f).alias("csi")]


def lead_scores(forecasts: DataFrame, threshold: float = 20.0) -> DataFrame:
    """One pass: counts, errors and Brier for each variant and lead, and over all leads (NULL)."""
    pred, obs = F.col("fc") >= threshold, F.col("obs") >= threshold
    wet = F.abs(F.greatest(F.col("fc"), F.lit(0.0)) - F.greatest(F.col("obs"), F.lit(0.0)))
    brier = F.pow(F.col("prob") - obs.cast("int"), 2)
    totals = forecasts.rollup("variant", "lead").agg(*contingency(pred, obs), F.sum(F.when(pred | obs, wet)).alias("err"), F.count_if(pred | obs).alias("n_err"), F.sum(brier).alias("brier_sum"), F.count("*").alias("n"))
    scored = totals.where("variant IS NOT NULL").select(
        "variant", "lead", "hits", "misses", "false_alarms", "negatives", *ratios(), F.round(F.try_divide("err", "n_err"), 6).alias("mae"), F.round(F.col("brier_sum") / F.col("n"), 6).alias("brier")
    )
    return scored


def class_scores(forecasts: DataFrame, classes: tuple = CLASSES) -> DataFrame:
    """Hits, misses and false alarms of membership in each class."""
    dims = F.explode(F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).cast("double").alias("hi")) for lo, hi in classes])).alias("c")
    inside = lambda v: (v >= F.col("c.lo")) & (F.col("c.hi").isNull() | (v < F.col("c.hi")))
    pred, obs = inside(F.col("fc")), inside(F.col("obs"))
    counted = forecasts.select("variant", "lead", "fc", "obs", dims).groupBy("variant", "lead", F.col("c.lo").alias("lo"))
    out = counted.agg(F.count_if(pred & obs).alias("hits"), F.count_if(~pred & obs).alias("misses"), F.count_if(pred & ~obs).alias("false_alarms"))
    return out.withColumn("csi", F.round(F.try_divide(F.col("hits").cast("double"), (F.col("hits") + F.col("misses") + F.col("false_alarms")).cast("double")), 9))


def histogram(forecasts: DataFrame, threshold: float = 20.0) -> DataFrame:
    """(variant, half, bin, pos, neg): probability bins, split in halves by alternate blocks."""
    b = F.least((F.col("prob") * BINS).cast("int"), F.lit(BINS - 1)).alias("bin")
    half = (F.floor(F.col("t") / BLOCK_S) % 2).cast("int").alias("half")
    return forecasts.groupBy("variant", half, b).agg(F.count_if(F.col("obs") >= threshold).alias("pos"), F.count_if(F.col("obs") < threshold).alias("neg"))


def auc(hist: DataFrame) -> DataFrame:
    """Area under the ROC by trapezoids over falling bins; windows of at most BINS rows."""
    byb = hist.groupBy("variant", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    down = W.partitionBy("variant").orderBy(F.desc("bin"))
    all_ = W.partitionBy("variant")
    c = byb.select("variant", "pos", "neg", F.sum("pos").over(down).alias("cp"), F.sum("neg").over(down).alias("cn"), F.sum("pos").over(all_).alias("p"), F.sum("neg").over(all_).alias("n"))
    area = F.col("neg") * (2 * F.col("cp") - F.col("pos")) / 2
    return c.groupBy("variant").agg(F.round(F.try_divide(F.sum(area), F.first("p") * F.first("n")), 9).alias("auc"))


def reliability(hist: DataFrame) -> DataFrame:
    g = hist.groupBy("variant", F.floor(F.col("bin") / 2).cast("int").alias("decile")).agg(F.sum("pos").alias("pos"), F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum((F.col("bin") + 0.5) / BINS * (F.col("pos") + F.col("neg"))).alias("mass"))
    return g.select("variant", "decile", "n", F.round(F.col("mass") / F.col("n"), 9).alias("mean_p"), F.round(F.col("pos") / F.col("n"), 9).alias("frequency"))


def isotonic(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Pool-adjacent-violators over bins as max over starts of min over ends of pooled means;
    at most BINS x BINS rows for each key."""
    h = hist.groupBy(*keys, "bin").agg(F.sum("pos").alias("pos"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    run = W.partitionBy(*keys).orderBy("bin")
    c = h.select(*keys, "bin", F.sum("pos").over(run).alias("cp"), F.sum("n").over(run).alias("cn"), "pos", "n")
    start = c.select(*keys, F.col("bin").alias("lo"), (F.col("cp") - F.col("pos")).alias("p0"), (F.col("cn") - F.col("n")).alias("n0"))
    end = c.select(*keys, F.col("bin").alias("hi"), F.col("cp").alias("p1"), F.col("cn").alias("n1"))
    pooled = start.join(end, keys).where("lo <= hi").withColumn("mean", (F.col("p1") - F.col("p0")) / (F.col("n1") - F.col("n0")))
    least = pooled.join(c.select(*keys, "bin"), keys).where("lo <= bin AND bin <= hi").groupBy(*keys, "bin", "lo").agg(F.min("mean").alias("least"))
    return least.groupBy(*keys, "bin").agg(F.round(F.max("least"), 9).alias("calibrated"))


def calibrated_brier(forecasts: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Brier score of probabilities calibrated on the other half of the blocks."""
    hist = histogram(forecasts, threshold)
    fit = isotonic(hist, ["variant", "half"]).select("variant", (1 - F.col("half")).alias("half"), "bin", "calibrated")
    met = hist.join(fit, ["variant", "half", "bin"], "left")
    q = F.coalesce("calibrated", (F.col("bin") + 0.5) / BINS)
    return met.groupBy("variant").agg(F.round(F.sum(F.col("pos") * F.pow(1 - q, 2) + F.col("neg") * q * q) / F.sum(F.col("pos") + F.col("neg")), 6).alias("brier"))


def blocks(forecasts: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Contingency counts of each (region, block, variant): what the bootstrap draws."""
    return forecasts.groupBy("region", F.floor(F.col("t") / BLOCK_S).cast("long").alias("block"), "variant").agg(*contingency(F.col("fc") >= threshold, F.col("obs") >= threshold))


def bootstrap_csi(block_counts: DataFrame, resamples: int = 200, seed: int = 1) -> DataFrame:
    """Percentile interval of CSI over block resamples. Each block joins a resample with a
    Poisson(1) multiplicity drawn from a hash of (seed, resample, block), so no step gathers
    the blocks; sums are pre-aggregated before the shuffle."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "r", "region", "block"), F.lit(1 << 24)) + F.lit(0.5)) / (1 << 24)
    cdf, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += term
        cdf.append(total)
        term /= k + 1
    times = sum((F.when(u > c, 1).otherwise(0) for c in cdf), F.lit(0))
    drawn = block_counts.select("*", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r")).withColumn("k", times).where("k > 0")
    sums = drawn.groupBy("variant", "r").agg(*[F.sum(F.col(c) * F.col("k")).alias(c) for c in ("hits", "misses", "false_alarms")])
    csi = sums.select("variant", F.try_divide(F.col("hits").cast("double"), (F.col("hits") + F.col("misses") + F.col("false_alarms")).cast("double")).alias("csi"))
    ranked = csi.groupBy("variant").agg(F.sort_array(F.collect_list("csi")).alias("s"))
    at = lambda q: F.element_at("s", (F.floor(F.size("s") * q) + 1).cast("int"))
    return ranked.select("variant", at(0.025).alias("low"), at(0.975).alias("high"), F.size("s").alias("n"))


def runs(frames: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Islands of consecutive times: (keys, start, frames)."""
    w = W.partitionBy(*keys).orderBy("t")
    cut = F.when(F.col("t") - F.lag("t").over(w) == step, 0).otherwise(1)
    numbered = frames.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(w))
    return numbered.groupBy(*keys, "_run").agg(F.min("t").alias("start"), F.count("*").alias("frames")).drop("_run")


def fractions_skill(cells: DataFrame, half_width: int, threshold: float = 20.0) -> DataFrame:
    """(k, fss): fractions skill of each frame against the one before, over windows of the
    lattice; only cells with rain spread, to the windows that hold them."""
    near = range(-half_width, half_width + 1)
    wet = cells.where(F.col("dbz") >= threshold)
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in near for j in near])).alias("m")
    one = lambda d, shift, name: d.select((F.col("k") + shift).alias("k"), (F.col("x") + F.col("m.i")).alias("x"), (F.col("y") + F.col("m.j")).alias("y")).groupBy("k", "x", "y").agg(F.count("*").alias(name))
    spread = wet.select("k", "x", "y", moves)
    both = one(spread, 1, "fc").join(one(spread, 0, "ob"), ["k", "x", "y"], "full").na.fill(0)
    return both.groupBy("k").agg(F.round(1 - F.sum(F.pow(F.col("fc") - F.col("ob"), 2)) / F.sum(F.pow("fc", F.lit(2)) + F.pow("ob", F.lit(2))), 9).alias("fss"))
