"""The issue loop of a backtest: every variant forecasts every issue and is scored where it stands, and only counts
that can be added leave the task.

An issue is a frame with a full history before it and a frame at every lead. Its points lie on a lattice in the middle
third of the region, where there is cover. What comes out is (region, block, half, measure, variant, lead, at, value):
sums by block of six hours, whatever the number of points; adding the rows of two runs gives those of both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators import histories, kernels
from pluvia.operators.histories import SPAN, Frames, Motion

PERSISTENCE = "persistence"


@dataclass(frozen=True)
class Variant:
    """method: TREC, HS or LK, 'mean' of the members named (those before it), '' for no motion."""

    name: str
    method: str = ""
    pairs: int = 4
    trend: bool = False
    members: tuple[str, ...] = ()


def default_variants(pairs: int = 4) -> tuple[Variant, ...]:
    """Three methods, plain and with a trend, and the mean of either."""
    methods = ("TREC", "HS", "LK")
    plain = [Variant(m, m, pairs) for m in methods]
    grown = [Variant(f"{m}+trend", m, pairs, True) for m in methods]
    return (*plain, *grown, Variant("mean", "mean", members=methods), Variant("mean+trend", "mean", members=tuple(v.name for v in grown)))


#: Strength classes of the application, dBZ from and below (None: open).
CLASSES = ((20.0, 30.0), (30.0, 40.0), (40.0, 50.0), (50.0, None))


@dataclass(frozen=True)
class Rules:
    """What is forecast and how it is scored; the defaults are the application's."""

    variants: tuple[Variant, ...] = default_variants()
    leads: tuple[int, ...] = (10, 20, 30, 40, 50, 60)
    step: int = 600
    every: int = 8
    threshold: float = 20.0
    radius: int = 2
    strong: float = 30.0
    tau: float = 20.0
    classes: tuple[tuple[float, float | None], ...] = CLASSES
    fss_thresholds: tuple[float, ...] = (20.0, 30.0, 40.0)
    fss_windows: tuple[int, ...] = (1, 3, 5)
    correlation_lead: int = 30

    @property
    def pairs(self) -> int:
        return max([1, *(v.pairs for v in self.variants if v.method not in ("", "mean"))])


#: variant -> (dBZ, rain probability), both points by leads.
Forecasts = dict[str, tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class After:
    """Variants made of those before them: their names, what is taken for them at an issue (frames, t), what makes them of
    (all that was taken at issues that are alike, x and y of a row of points an issue, forecasts of all these points), and
    the seconds of other sources that this needs before the issue and after its last lead."""

    names: tuple[str, ...]
    take: Callable[[Frames, int], object]
    run: Callable[[list, np.ndarray, np.ndarray, Forecasts], Forecasts]
    back: int = 0
    ahead: int = 0


def rain_rate(dbz: np.ndarray) -> np.ndarray:
    return np.where(dbz < 15, 0.0, (10 ** (np.minimum(dbz, 55.0) / 10) / 200) ** (1 / 1.6))


def lattice(g: np.ndarray, every: int, cover: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y) of the covered points of the middle third, and the mask of the lattice that says which they are."""
    side = np.arange(g.shape[1] // 3, 2 * g.shape[1] // 3, every)  # a mosaic is three tiles square
    y, x = np.meshgrid(side, side, indexing="ij")
    mask = np.ones(x.shape, bool) if cover is None else cover[y, x]
    return x[mask].astype(float), y[mask].astype(float), mask


def eligible(held: Frames, t: int, rules: Rules) -> bool:
    steps = [-rules.step * k for k in range(rules.pairs + 1)] + [60 * m for m in rules.leads]
    return all(t + s in held.grids for s in steps)


@dataclass(frozen=True)
class Issue:
    """What is taken of the frames held at an issue: the frame, its covered points and their mask, the frames at the leads and
    what carries each forecast, persistence first."""

    grid: np.ndarray
    x: np.ndarray
    y: np.ndarray
    mask: np.ndarray
    later: list[np.ndarray]
    carriers: dict[str, kernels.Carrier]
    taken: object = None

    def like(self, other: Issue) -> bool:
        """Whether both can be worked out at once."""
        return self.grid.shape == other.grid.shape and np.array_equal(self.mask, other.mask) and all(g.shape == self.grid.shape for g in (*self.later, *other.later))


def carriers(held: Frames, t: int, rules: Rules) -> dict[str, kernels.Carrier]:
    """What carries the forecasts that are no means."""
    out = {}
    for v in (Variant(PERSISTENCE), *rules.variants):
        if v.method != "mean":
            field = held.field(v.method, t, v.pairs) if v.method else None
            rates = held.trend(v.method, t, rules.threshold - 5, v.pairs) if field is not None and v.trend else None
            out[v.name] = (field[0], held.size(v.method), rates) if field is not None else (np.zeros((1, 1, 2)), 1, None)
    return out


def together(some: list[Issue], rules: Rules) -> Forecasts:
    """variant -> (dBZ, rain probability), both points by leads, of the points of issues that are alike, one issue after another."""
    n, k = len(some), len(some[0].carriers)
    x, y = (np.repeat(np.stack([getattr(one, c) for one in some]), k, axis=0) for c in "xy")
    whole = [c for one in some for c in one.carriers.values()]
    found = kernels.followed(np.stack([one.grid for one in some]), whole, x, y, rules.radius, rules.strong, rules.threshold, rules.tau, list(rules.leads), np.repeat(np.arange(n), k))
    dbz, prob = (f.reshape(n, k, -1, len(rules.leads)).swapaxes(0, 1).reshape(k, -1, len(rules.leads)) for f in found)
    made = {name: (dbz[i], prob[i]) for i, name in enumerate(some[0].carriers)}
    out = {}
    for v in (Variant(PERSISTENCE), *rules.variants):
        if v.method == "mean":
            made[v.name] = tuple(np.mean([made[m][i] for m in v.members], axis=0) for i in (0, 1))
        out[v.name] = made[v.name]
    return out


def came(some: list[Issue], rules: Rules) -> np.ndarray:
    """(points, leads) of the echo that came at the points of issues that are alike, one issue after another."""
    x, y = (np.stack([getattr(one, c) for one in some]).ravel() for c in "xy")
    of = np.repeat(np.arange(len(some)), len(some[0].x))
    return np.stack([kernels.point_echo(np.stack([one.later[i] for one in some]), x, y, rules.radius, rules.strong, of) for i in range(len(rules.leads))], 1)


class Waiting:
    """Issues that wait for each other, as far as their points and frames are few; all that are alike go to run at once."""

    def __init__(self, rules: Rules, run: Callable[[list[Issue]], object]):
        self.rules, self.run, self.held = rules, run, []

    def add(self, one: Issue) -> None:
        if self.held and not one.like(self.held[0]):
            self.settle()
        self.held.append(one)
        n = len(self.held) + 1
        if n * len(one.carriers) * len(one.x) > POINTS or (n + len(self.rules.leads)) * one.grid.size > PIXELS:
            self.settle()

    def settle(self) -> None:
        some, self.held = self.held, []
        if some:
            self.run(some)


def forecasts(held: Frames, t: int, x: np.ndarray, y: np.ndarray, rules: Rules) -> Forecasts:
    """variant -> (dBZ, rain probability), both points by leads; persistence first."""
    return together([Issue(held.grids[t], x, y, np.ones(len(x), bool), [], carriers(held, t, rules))], rules)


#: Points of all forecasts, and pixels of the frames held for them, that issues are worked out for at once.
POINTS, PIXELS = 4096, 1 << 17


class Tally:
    """Sums by (measure, variant, lead, at) of one region and block."""

    def __init__(self) -> None:
        self.sums: dict[tuple[str, str, int, float], float] = {}

    def add(self, measure: str, variant: str, lead: int, value: float, at: float = 0.0) -> None:
        key = (measure, variant, lead, at)
        self.sums[key] = self.sums.get(key, 0.0) + float(value)

    def table(self, measure: str, names: list[str], leads: tuple[int, ...], values: np.ndarray, at: float = 0.0) -> None:
        """Values by variant and lead."""
        for name, row in zip(names, values.tolist(), strict=True):
            for lead, value in zip(leads, row, strict=True):
                self.add(measure, name, lead, value, at)

    def points(self, names: list[str], dbz: np.ndarray, prob: np.ndarray, obs: np.ndarray, rules: Rules) -> None:
        """The points of every variant and lead at once: forecasts (variants, points, leads), obs (points, leads)."""
        thr, leads = rules.threshold, rules.leads
        add = lambda measure, values, at=0.0: self.table(measure, names, leads, values, at)
        said, came = dbz >= thr, obs >= thr
        for measure, hit in (("hits", said & came), ("misses", ~said & came), ("false_alarms", said & ~came), ("negatives", ~said & ~came)):
            add(measure, hit.sum(1))
        wet = said | came
        add("abs_error", np.where(wet, np.abs(np.maximum(dbz, 0) - np.maximum(obs, 0)), 0.0).sum(1))
        add("n_error", wet.sum(1))
        add("brier", ((prob - came) ** 2).sum(1))
        add("n_brier", np.full((len(names), len(leads)), len(obs)))
        for lo, hi in rules.classes:
            p, o = ((a >= lo) & (a < (np.inf if hi is None else hi)) for a in (dbz, obs))
            for measure, hit in (("class_hits", p & o), ("class_misses", ~p & o), ("class_false_alarms", p & ~o)):
                add(measure, hit.sum(1), lo)
        bins = np.minimum((prob * 20).astype(int), 19)
        shape = (len(names), len(leads), 20)
        flat = ((np.arange(shape[0])[:, None, None] * shape[1] + np.arange(shape[1])) * 20 + bins).ravel()
        for measure, values in (("bin_rain", came), ("bin_dry", ~came), ("bin_p", prob)):
            sums = np.bincount(flat, weights=np.broadcast_to(values, prob.shape).astype(float).ravel(), minlength=np.prod(shape)).reshape(shape)
            for v, i, b in np.argwhere(sums).tolist():
                self.add(measure, names[v], leads[i], sums[v, i, b], b)

    def accumulated(self, names: list[str], dbz: np.ndarray, obs: np.ndarray, leads: tuple[int, ...]) -> None:
        """Rain up to each lead, each standing for the minutes since the one before."""
        hours = np.diff([0, *leads]) / 60
        said, came = (np.cumsum(rain_rate(a) * hours, axis=-1) for a in (dbz, obs))
        wet = (said > 0) | (came > 0)
        self.table("accumulated_error", names, leads, np.where(wet, np.abs(said - came), 0.0).sum(1))
        self.table("n_accumulated", names, leads, wet.sum(1))

    def fractions(self, names: list[str], dbz: np.ndarray, obs: np.ndarray, mask: np.ndarray, rules: Rules) -> None:
        """Fractions skill by windows over covered lattice points, from sums over the whole lattice, all variants, leads and
        issues of one mask at once. at: threshold + window / 100."""
        for thr in rules.fss_thresholds:
            on = []
            for values in (dbz, obs):
                each = np.moveaxis(values.reshape(*values.shape[:-2], -1, mask.sum(), values.shape[-1]), -1, -3)  # leads, issues, points
                a = np.zeros((*each.shape[:-1], *mask.shape))
                a[..., mask] = each >= thr
                on.append(a)
            for window in rules.fss_windows:
                covered = kernels.box_sum(mask.astype(float), window // 2)[mask]
                f, o = (np.rint(kernels.box_sum(a, window // 2)[..., mask]) / covered for a in on)
                self.table("fss_num", names, rules.leads, ((f - o) ** 2).sum((-1, -2)), thr + window / 100)
                self.table("fss_den", names, rules.leads, (f * f + o * o).sum((-1, -2)), thr + window / 100)

    def errors(self, found: Forecasts, obs: np.ndarray, i: int, lead: int, rules: Rules) -> None:
        """Sums and products of errors where it rains or any variant says so; at: the number of the other variant."""
        said = np.stack([f[0][:, i] for f in found.values()])
        wet = (obs >= rules.threshold) | (said >= rules.threshold).any(0)
        e = np.maximum(said[:, wet], 0) - np.maximum(obs[wet], 0)
        products = e @ e.T
        for a, name in enumerate(found):
            self.add("n_joint", name, lead, wet.sum())
            self.add("error", name, lead, e[a].sum())
            for b in range(a, len(found)):
                self.add("error_product", name, lead, products[a, b], b)

    def issue(self, held: Frames, t: int, cover: np.ndarray | None, rules: Rules, after: After | None = None) -> None:
        """One issue, whatever waits."""
        if one := self.taken(held, t, cover, rules, after):
            self.several([one], rules, after)

    def taken(self, held: Frames, t: int, cover: np.ndarray | None, rules: Rules, after: After | None = None) -> Issue | None:
        """What is needed of an issue to score it later; None if nothing is left to do."""
        g = held.grids[t]
        x, y, mask = lattice(g, rules.every, cover)
        if not len(x):
            return None
        self.add("issues", "", 0, 1)
        later = [held.grids[t + 60 * m] for m in rules.leads]
        if g.max() < 10 and all((kernels.point_echo(a, x, y, rules.radius, rules.strong) < rules.threshold).all() for a in later):
            # No echo to move or grow: every variant is dry, certain and right.
            for name in (PERSISTENCE, *(v.name for v in rules.variants), *(after.names if after else ())):
                for lead in rules.leads:
                    self.add("negatives", name, lead, len(x))
                    self.add("n_brier", name, lead, len(x))
                    self.add("bin_dry", name, lead, len(x), 0)
            self.add("dry_issues", "", 0, 1)
            return None
        return Issue(g, x, y, mask, later, carriers(held, t, rules), after.take(held, t) if after else None)

    def several(self, some: list[Issue], rules: Rules, after: After | None = None) -> None:
        """Issues that are alike, at once."""
        obs, found = came(some, rules), together(some, rules)
        if after:
            found |= after.run([one.taken for one in some], *(np.stack([getattr(one, c) for one in some]) for c in "xy"), found)
        dbz, prob = (np.stack([f[i] for f in found.values()]) for i in (0, 1))
        self.accumulated(list(found), dbz, obs, rules.leads)
        self.points(list(found), dbz, prob, obs, rules)
        self.fractions(list(found), dbz, obs, some[0].mask, rules)
        if rules.correlation_lead in rules.leads:
            i = rules.leads.index(rules.correlation_lead)
            self.errors(found, obs[:, i], i, rules.correlation_lead, rules)


def scored(frames: DataFrame, rules: Rules = Rules(), motion: Motion = Motion(), since: int | None = None, until: int | None = None, after: After | None = None) -> DataFrame:
    """(region, block, half, measure, variant, lead, at, value) over the issues after `since` and up to `until`.

    Issues wait for each other as far as their points and frames are few, and are worked out at once.

    frames: region, t, w, h, at, dbz and, if some pixels have no cover, cover (array of the positions that do; null:
    all). The frames of a block and around it are one bounded group, read one after another. Variants that `after` makes
    come last and are scored alike."""
    kind = frames.schema["region"].dataType.simpleString()
    tally: list[Tally] = []
    columns = ["region", "block", "half", "measure", "variant", "lead", "at", "value"]
    schema = f"region {kind}, block long, half int, measure string, variant string, lead int, at double, value double"
    state: dict = {}
    waiting = Waiting(rules, lambda some: tally[0].several(some, rules, after))

    def visit(held: Frames, region: object, t: int, span: int) -> Iterable[tuple]:
        state["key"] = (region, span)
        if (since is None or t > since) and (until is None or t <= until) and eligible(held, t, rules):
            if not tally:
                tally.append(Tally())
            if one := tally[0].taken(held, t, held.covers.get(t), rules, after):
                waiting.add(one)
        return ()

    def close() -> Iterable[tuple]:
        waiting.settle()
        if tally:
            region, block = state["key"]
            for (measure, variant, lead, at), value in tally.pop().sums.items():
                yield region, block, block % 2, measure, variant, lead, at, value

    back, ahead = (rules.pairs + 1) * rules.step, 60 * rules.leads[-1]
    if after:
        back, ahead = max(back, after.back), ahead + after.ahead
    return histories.walked(frames, motion, visit, schema, columns, back=back, ahead=ahead, span=SPAN, close=close)


def added(*runs: DataFrame) -> DataFrame:
    """Runs over different issues, as one: sums of equal keys."""
    whole = runs[0]
    for r in runs[1:]:
        whole = whole.unionByName(r)
    return whole.groupBy("region", "block", "half", "measure", "variant", "lead", "at").agg(F.sum("value").alias("value"))


def lead_scores(tallied: DataFrame) -> DataFrame:
    """(variant, lead, hits, misses, false_alarms, negatives, csi, mae, brier, accumulated_mae) of each variant and
    lead over all regions and blocks; ratios of nothing are NULL."""
    counts = ["hits", "misses", "false_alarms", "negatives"]
    names = [*counts, "abs_error", "n_error", "brier", "n_brier", "accumulated_error", "n_accumulated"]
    one = lambda m: F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("value"))), F.lit(0.0))
    t = tallied.where(F.col("measure").isin(names)).groupBy("variant", "lead").agg(*[one(m).alias(f"_{m}") for m in names])
    ratio = lambda a, b: F.round(F.try_divide(a, b), 9)
    return t.select(
        "variant",
        "lead",
        *[F.col(f"_{c}").cast("long").alias(c) for c in counts],
        ratio(F.col("_hits"), F.col("_hits") + F.col("_misses") + F.col("_false_alarms")).alias("csi"),
        ratio(F.col("_abs_error"), F.col("_n_error")).alias("mae"),
        ratio(F.col("_brier"), F.col("_n_brier")).alias("brier"),
        ratio(F.col("_accumulated_error"), F.col("_n_accumulated")).alias("accumulated_mae"),
    )


def fractions_skill(tallied: DataFrame) -> DataFrame:
    """(variant, lead, threshold, window, fss); NULL where neither side ever rains."""
    t = tallied.where(F.col("measure").isin("fss_num", "fss_den")).groupBy("variant", "lead", "at")
    sums = t.agg(*[F.sum(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in ("fss_num", "fss_den")])
    window = F.round((F.col("at") - F.floor("at")) * 100).cast("int")
    return sums.select("variant", "lead", F.floor("at").cast("double").alias("threshold"), window.alias("window"), F.round(1 - F.try_divide("fss_num", "fss_den"), 9).alias("fss"))


def error_correlation(tallied: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, n, correlation) of the variants' errors; names: persistence and the variants, in their order."""
    # One row of sums, so the issue loop, which tallied stands for, runs once and not once for each of them.
    summed = lambda m, v, at: F.sum(F.when((F.col("measure") == m) & (F.col("variant") == v) & (F.col("at") == at), F.col("value")))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = {f"s{i}": summed("error", v, 0.0) for i, v in enumerate(names)} | {f"p{i}_{j}": summed("error_product", names[i], float(j)) for i, j in pairs}
    one = tallied.where(F.col("measure").isin("n_joint", "error", "error_product")).agg(summed("n_joint", names[0], 0.0).alias("n"), *[c.alias(k) for k, c in sums.items()])
    told = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), *[F.col(c).alias(k) for k, c in (("p", f"p{i}_{j}"), ("sa", f"s{i}"), ("sb", f"s{j}"), ("qa", f"p{i}_{i}"), ("qb", f"p{j}_{j}"))]) for i, j in pairs]
    met = one.select("n", F.explode(F.array(*told)).alias("m")).select("n", "m.*").where("p IS NOT NULL")
    c = (F.col("p") / F.col("n") - F.col("sa") / F.col("n") * F.col("sb") / F.col("n")) / F.sqrt((F.col("qa") / F.col("n") - (F.col("sa") / F.col("n")) ** 2) * (F.col("qb") / F.col("n") - (F.col("sb") / F.col("n")) ** 2))
    return met.select("a", "b", F.col("n").cast("long").alias("n"), F.round(c, 9).alias("correlation"))


def _by_measure(tallied: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """Sums of measures as whole-number columns."""
    one = lambda m: F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("value"))), F.lit(0.0)).cast("long")
    return tallied.where(F.col("measure").isin(list(measures))).groupBy(*keys).agg(*[one(m).alias(name) for m, name in measures.items()])


def class_scores(tallied: DataFrame) -> DataFrame:
    """(variant, lead, lo, hits, misses, false_alarms) of strength classes, lo being a class's lower end."""
    return _by_measure(tallied.withColumnRenamed("at", "lo"), ["variant", "lead", "lo"], {"class_hits": "hits", "class_misses": "misses", "class_false_alarms": "false_alarms"})


def block_counts(tallied: DataFrame) -> DataFrame:
    """(region, block, variant, hits, misses, false_alarms), as the bootstrap takes them."""
    return _by_measure(tallied, ["region", "block", "variant"], {c: c for c in ("hits", "misses", "false_alarms")})
