"""Learned forecasts: classes of rain boosted on feature rows, calibrated and given a threshold for each lead, with folds in
space left out in turn; and the issue loop with the models that never saw a region's fold.

Of the rows, however many, only sums reach the driver: histograms (see boosting), sums by level of probability for
the calibration, counts by lead and threshold. A model is bounded by its settings: rounds x leaves nodes a class.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.functions.trees import NONE, ZERO
from pluvia.operators import boosting, features, issues, kernels, models
from pluvia.operators.histories import Frames, Motion
from pluvia.operators.scores import safe
from pluvia.session import shared_dir

#: Lower ends of the classes, dBZ; the leads that stop the boosting; degrees of a fold's cell; a quiet row.
CLASSES, MAIN_LEADS, CELL, QUIET = (20.0, 30.0, 40.0), 60, 15, 10.0
#: Which features the models of a set read.
SETS = {
    "radar": lambda n: not n.startswith(("nwp_", "sat_")),
    "all": lambda n: True,
    "no_nwp": lambda n: not n.startswith("nwp_"),
    "no_sat": lambda n: not n.startswith("sat_"),
    "ens": lambda n: n == "lead" or n.startswith("m_"),
}
#: Levels of probability for a unit of log odds, which are cut at 16 either way.
STEPS, FAR = 1024, 16


def names_of(set_: str) -> tuple[str, ...]:
    return tuple(n for n in features.NAMES if SETS[set_](n))


def usable(sets: Iterable[str], nwp: bool, sat: bool) -> list[str]:
    """The sets of which every source is there."""
    off = tuple(p for p, on in (("nwp_", nwp), ("sat_", sat)) if not on)
    return [s for s in sets if not any(n.startswith(off) for n in names_of(s))] if off else list(sets)


def fold_at(lat: float, lon: float) -> int:
    """The fold of a place, as geo.fold gives it to columns."""
    return zlib.crc32(f"{int(np.floor(lat / CELL))},{int(np.floor(lon / CELL))}".encode()) % 2


# --- models ---


@dataclass(frozen=True)
class Model:
    """A bundle as its file holds it. Inputs have the bundle's features in order, NaN for missing."""

    bundle: str

    @cached_property
    def read(self) -> dict:
        found = json.loads(self.bundle)
        for c in found["classes"]:
            c["trees"] = [{k: np.array(v) for k, v in t.items()} for t in c["trees"]]
            c["pstar"] = {int(k): v for k, v in c["pstar"].items()}
        return found

    def __reduce__(self):
        return Model, (self.bundle,)  # what is parsed stays in the process

    @property
    def names(self) -> list[str]:
        return self.read["features"]

    def raw(self, x: np.ndarray) -> list[np.ndarray]:
        """Sums of the trees by class."""
        return [sum((_leaves(t, x) for t in c["trees"]), np.zeros(len(x))) for c in self.read["classes"]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes): calibrated, never rising with strength."""
        out = []
        for c, s in zip(self.read["classes"], self.raw(x), strict=True):
            p = 1 / (1 + np.exp(-s))
            out.append(np.interp(p, c["calib_x"], c["calib_y"]) if c["calib_x"] else p)
        return np.minimum.accumulate(np.stack(out, 1), axis=1)

    def cut(self, k: int, lead: int) -> float:
        """The threshold of class k at a lead, else that of the nearest lead learned (the smaller on ties), else 0.5."""
        known = self.read["classes"][k]["pstar"]
        return known[min(known, key=lambda m: (abs(m - lead), m))] if known else 0.5

    def moved(self, e: np.ndarray, lead: int, p: np.ndarray) -> np.ndarray:
        """e (dBZ) kept within the band of the strongest class whose probability reaches its threshold; below all
        classes if there is none."""
        lows = [c["dbz"] for c in self.read["classes"]]
        out = np.minimum(e, lows[0] - 0.01)
        for k, low in enumerate(lows):
            inside = np.maximum(e, low)
            if k + 1 < len(lows):
                inside = np.where(e >= lows[k + 1], lows[k + 1] - 0.01, inside)
            out = np.where(p[:, k] >= self.cut(k, lead), inside, out)
        return out


def _leaves(t: dict, x: np.ndarray) -> np.ndarray:
    at, rows = np.zeros(len(x), int), np.arange(len(x))
    while (live := t["feature"][at] >= 0).any():
        v, missing = x[rows, np.maximum(t["feature"][at], 0)], t["missing"][at]
        gone = np.isnan(v)
        v = np.where(gone, 0.0, v)
        by_default = (missing != NONE) & (gone | ((missing == ZERO) & (np.abs(v) <= 1e-35)))
        left = np.where(by_default, t["default_left"][at], v <= t["threshold"][at])
        at = np.where(live, np.where(left, t["left"][at], t["right"][at]), at)
    return t["value"][at]


# --- calibration and thresholds ---


def level(p: Column, steps: int = STEPS) -> Column:
    """The level of a probability: its log odds in steps, cut at both ends."""
    odds = F.when(p <= 0, -float(FAR)).when(p >= 1, float(FAR)).otherwise(F.ln(p / (1 - p)))
    return F.floor(F.greatest(F.least(odds, F.lit(float(FAR))), F.lit(-float(FAR))) * steps).cast("int")


def isotonic(rows: DataFrame, steps: int = STEPS) -> tuple[list[float], list[float]]:
    """Knots (xs, ys) of the rising step function of least weighted squares from p to event; flat between the two
    knots of a step. rows: p, event, w; rows of null or of no weight count for nothing; no rows: no knots.

    Rows are added up by level of p, of which there are 32 x steps + 1 at most, and only these sums are pooled here."""
    used = rows.where("p IS NOT NULL AND event IS NOT NULL AND w > 0").groupBy(level(F.col("p"), steps).alias("level"))
    sums = used.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("p")).alias("wp"), F.sum(F.when(F.col("event"), F.col("w")).otherwise(0.0)).alias("wy")).toPandas().sort_values("level")
    steps_: list[list[float]] = []  # weight, events, first and last x
    for w, wp, wy in sums[["w", "wp", "wy"]].to_numpy(float):
        one = [w, wy, wp / w, wp / w]
        while steps_ and steps_[-1][1] / steps_[-1][0] >= one[1] / one[0]:
            last = steps_.pop()
            one = [last[0] + one[0], last[1] + one[1], last[2], one[3]]
        steps_.append(one)
    xs, ys = [], []
    for w, wy, low, high in steps_:
        for x in (low,) if low == high else (low, high):
            xs.append(x)
            ys.append(wy / w)
    return xs, ys


def calibrated(rows: DataFrame, knots: tuple[list[float], list[float]], name: str = "prob") -> DataFrame:
    """rows with p moved along the knots."""
    if not knots[0]:
        return rows.withColumn(name, F.col("p"))
    sent = rows.sparkSession.sparkContext.broadcast(knots)

    @F.pandas_udf("double")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(np.interp(p, *sent.value)).where(p.notna())

    return rows.withColumn(name, run("p"))


def lead_thresholds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lead, p): of each lead, with the leads beside it, the threshold of best CSI among those that catch as much
    as the ensemble with no more false alarms; else that of nearest frequency bias; else 0.5. rows: keys, lead, prob, event,
    w, said (whether the ensemble says so)."""
    event, said, w = F.col("event"), F.col("said"), F.col("w")
    count = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    own = rows.groupBy(*keys, "lead").agg(count(event & said).alias("h"), count(event & ~said).alias("m"), count(~event & said).alias("f"))
    beside = W.partitionBy(*keys).orderBy("lead").rowsBetween(-1, 1)  # a row a lead
    h, m, f = (F.sum(c).over(beside) for c in "hmf")
    least = own.select(*keys, "lead", safe(h, h + m).alias("e_pod"), safe(f, h + f).alias("e_far"), safe(h + f, h + m).alias("e_bias"))
    grid = models.threshold_grid(rows, keys).join(F.broadcast(least), [*keys, "lead"])  # a row a lead
    return models.picked_threshold(grid, keys, *(F.col(c) for c in ("e_pod", "e_far", "e_bias")))


# --- training ---


def training_rows(rows: DataFrame, regions: DataFrame, share: float = 0.05) -> DataFrame:
    """Feature rows with what training needs: name and fold of the region and a weight. Of quiet rows (no echo came, is
    near, or is forecast) a share is kept, chosen by a hash of the key, and weighs as much as all. regions: region,
    name, lat, lon, a row each."""
    from pluvia.functions import geo

    low = lambda c: ~F.coalesce(F.col(c) >= QUIET, F.lit(False))
    kept, weight = models.thinned(low("obs") & low("near25_max") & low("m_max"), F.concat_ws("/", "region", "t", F.col("lead").cast("int"), "x", "y"), share)
    places = regions.select("region", "name", geo.fold(F.col("lat"), F.col("lon")).alias("fold"))
    return rows.where(kept).withColumn("weight", weight).join(places, "region")


def held_out(name: Column) -> Column:
    """Whether a region calibrates instead of training: a stable fifth of the names."""
    return F.crc32(name.cast("string")) % 5 == 0


@dataclass(frozen=True)
class Fit:
    """A model and what it scores on the regions held out: (dbz, lead, pstar, pod, far, csi, ens_pod, ens_far, ens_csi)."""

    model: Model
    report: list[tuple]


def _uncalibrated(rows: DataFrame, model: Model) -> Column:
    """The sigmoid of a model's first class."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-sent.value.raw(x.to_numpy(float))[0])))

    return run(F.struct(*[F.col(n).cast("double") for n in model.names]))


def fit(rows: DataFrame, set_: str, fold: int, classes: tuple[float, ...] = CLASSES, settings: boosting.Settings = boosting.Settings()) -> Fit:
    """A model of training_rows. Each class is trained on the regions not held out; the others stop it (at leads up to an
    hour), calibrate it and choose its thresholds. Trees as exported must give the booster's own scores."""
    spark, names = rows.sparkSession, names_of(set_)
    boosters, knots, cuts, report = {}, {}, {}, []
    for dbz in classes:
        label = (F.col("obs") >= dbz).cast("double").alias("label")
        table = rows.select(label, "weight", held_out(F.col("name")).alias("held"), *names)
        # The classes differ in their labels alone, so the first one's cuts are those of all.
        cuts_ = next(iter(boosters.values())).cuts if boosters else None
        boosters[dbz] = booster = boosting.fitted(table.where(f"NOT held OR lead <= {MAIN_LEADS}"), names, settings, cuts_)
        flat = _uncalibrated(rows, Model(boosting.bundle(set_, fold, {dbz: booster})))
        back = rows.where(held_out(F.col("name"))).where("obs IS NOT NULL AND weight > 0")
        both = booster.predicted(back).withColumn("q", flat)
        path = f"{shared_dir(spark)}/held-{uuid.uuid4().hex}"
        both.select(F.col("lead").cast("int").alias("lead"), "p", "q", (F.col("obs") >= dbz).alias("event"), F.col("weight").alias("w"), F.coalesce(F.col("m_mean") >= dbz, F.lit(False)).alias("said")).write.parquet(path)
        scored = spark.read.parquet(path)  # read three times, and predicted once
        off = scored.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] or 0.0
        if off > 1e-4:
            raise ValueError(f"the exported trees of {set_} at {dbz} dBZ are off by {off}")
        knots[dbz] = isotonic(scored)
        sure = calibrated(scored, knots[dbz])
        picked = {r["lead"]: r["p"] for r in lead_thresholds(sure, []).collect()}  # a row a lead
        cuts[dbz] = picked
        if picked:
            at = F.element_at(F.create_map(*[F.lit(v) for kv in picked.items() for v in kv]), F.col("lead"))
            count = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0.0))
            event, said, mean = F.col("event"), F.round(F.col("prob"), 8) >= at, F.col("said")
            sums = [count(c).alias(n) for s, of in (("", said), ("e", mean)) for n, c in ((f"{s}h", event & of), (f"{s}m", event & ~of), (f"{s}f", ~event & of))]
            rates = [safe(F.col(a), F.col(a) + sum((F.col(x) for x in b), F.lit(0.0))).alias(n) for s, e in (("", ""), ("e", "ens_")) for n, a, b in ((f"{e}pod", f"{s}h", [f"{s}m"]), (f"{e}far", f"{s}f", [f"{s}h"]), (f"{e}csi", f"{s}h", [f"{s}m", f"{s}f"]))]
            report += [(dbz, r["lead"], picked[r["lead"]], *r[1:]) for r in sure.groupBy("lead").agg(*sums).select("lead", *rates).orderBy("lead").collect()]
    return Fit(Model(boosting.bundle(set_, fold, boosters, cuts, knots)), report)


def left_out(rows: DataFrame, sets: Iterable[str], folds: tuple[int, ...] = (0, 1, -1), until: int | None = None, classes: tuple[float, ...] = CLASSES, settings: boosting.Settings = boosting.Settings()) -> dict[tuple[str, int], Fit]:
    """(set, fold) -> the fit on the rows of all other folds (-1: of all rows), of forecasts verified before `until`."""
    known = rows if until is None else rows.where(F.col("t") + F.col("lead") * 60 < until)
    return {(s, k): fit(known.where(F.col("fold") != k), s, k, classes, settings) for s in sets for k in folds}


def parity(rows: DataFrame, model: Model, n: int = 40) -> list[dict]:
    """n rows, chosen by a hash of their features, and the probabilities that any reader of the bundle must give."""
    chosen = rows.select(*[F.col(c).cast("double") for c in model.names]).orderBy(F.xxhash64(*model.names)).limit(n).toPandas()
    x = chosen.to_numpy(float).reshape(len(chosen), len(model.names))
    return [{"row": [None if np.isnan(v) else float(v) for v in r], "probs": p.tolist()} for r, p in zip(x, model.probabilities(x) if len(x) else x, strict=True)]


# --- the issue loop ---


def variant(set_: str) -> str:
    return f"ml-{set_}"


def comparisons(variants: Iterable[issues.Variant], sets: list[str]) -> list[tuple[str, str]]:
    """Pairs of variants to compare: the first mean with a trend against the main set, and every other set against it; none
    without radar or all."""
    main = next((s for s in ("radar", "all") if s in sets), None)
    if main is None:
        return []
    trended = {v.name for v in variants if v.trend}
    means = [v.name for v in variants if v.method == "mean" and v.members and set(v.members) <= trended]
    return [(m, variant(main)) for m in means[:1]] + [(variant(s), variant(main)) for s in sets if s != main]


def member_names(rules: issues.Rules, pairs: int) -> list[str | None]:
    """The variant with a trend of each member, in the order of the features; None if there is none."""
    return [next((v.name for v in rules.variants if v.method == m and v.trend and v.pairs == pairs), None) for m in features.MEMBERS]


def forecast_row(model: Model, row: np.ndarray, leads: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(dBZ, rain probability) of feature rows (points, leads, features): the members' mean moved into its band."""
    at = [features.NAMES.index(n) for n in model.names]
    mean = row[:, :, features.NAMES.index("m_mean")]
    mean = np.where(np.isnan(mean), kernels.NO_ECHO, mean)
    dbz, prob = np.empty(mean.shape), np.empty(mean.shape)
    for i, lead in enumerate(leads):
        p = model.probabilities(row[:, i][:, at])
        dbz[:, i], prob[:, i] = model.moved(mean[:, i], lead, p), p[:, 0]
    return dbz, prob


def scored(sources: DataFrame, rules: issues.Rules, models_: dict[tuple[str, int], Model], motion: Motion = Motion(), margin: int = 0, since: int | None = None, until: int | None = None) -> DataFrame:
    """issues.scored with a variant more for every set, whose forecasts come from the model that never saw the region's
    fold. sources: as features.sources gives them. A set without a model for both folds is an error; members that are
    not among the variants are missing features. Feature rows never leave the task."""
    sets = sorted({s for s, _ in models_})
    for s in sets:
        if not {(s, 0), (s, 1)} <= set(models_):
            raise ValueError(f"{s} needs a model for either fold")
    sent = sources.sparkSession.sparkContext.broadcast(models_)
    members = member_names(rules, motion.pairs)
    # Without a model that reads more than the members' forecasts, no scene is worked out.
    bare = all(set(m.names) <= set(names_of("ens")) for m in models_.values())

    def take(held: Frames, t: int) -> features.Scene:
        lat, lon = held.places[t]
        return features.bare(held, t, lat, lon) if bare else features.scene_of(held, t, lat, lon, motion.pairs, rules.threshold, margin)

    def run(scenes: list[features.Scene], x: np.ndarray, y: np.ndarray, found: issues.Forecasts) -> issues.Forecasts:
        none = np.full((x.size, len(rules.leads)), np.nan)
        dbz = np.stack([found[m][0] if m else none for m in members], 2)
        told = [found[m][1] for m in members if m]
        prob, k, up = np.mean(told, axis=0) if told else np.zeros(none.shape), x.shape[1], features.upstream(scenes, x, y, rules.leads)
        row = np.concatenate([features.rows(s, x[i], y[i], rules.leads, dbz[i * k : i * k + k], prob[i * k : i * k + k], up[i]) for i, s in enumerate(scenes)])
        row = row.astype(np.float32).astype(float)  # as trained
        folds = np.repeat([fold_at(s.lat, s.lon) for s in scenes], k)
        out = {variant(s): (np.empty(none.shape), np.empty(none.shape)) for s in sets}
        for s in sets:
            for fold in set(folds.tolist()):
                here = folds == fold
                for whole, part in zip(out[variant(s)], forecast_row(sent.value[s, fold], row[here], rules.leads), strict=True):
                    whole[here] = part
        return out

    after = issues.After(tuple(variant(s) for s in sets), take, run, back=max((motion.pairs + 1) * rules.step, 2 * 3600), ahead=3600)
    return issues.scored(sources, rules, motion, since, until, after)
