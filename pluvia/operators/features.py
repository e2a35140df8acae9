"""The feature row of a point and lead: members' forecasts, echoes around and upstream, storms, sun, weather model and
satellite, as of the issue.

All sources are rows of one stream by region and time (kind: radar, nwp, sat, sat scans as images, weather as seven values
an hour), so one shuffle brings together what an issue may know, and nothing later than it is read but the
weather model's hours. What a source does not tell is NULL.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators import histories, issues, kernels, storms
from pluvia.operators.histories import RADAR, Frames, Motion

#: Fixed values, in the order of the models' rows: the catalogue of features.
NAMES = (
    "lead",
    "m_lk", "m_hs", "m_trec", "m_mean", "m_std", "m_min", "m_max", "m_prob",
    "now_dbz", "near10_frac", "near10_max", "near25_frac", "near25_max",
    "up_frac", "up_max", "up_mean", "up_trend", "up_dist_km",
    "speed_kmh", "coherence", "gain",
    "storm_dist_km", "storm_peak", "storm_rate", "storm_age", "storm_area_km2", "storm_new", "storm_merged", "storm_decaying",
    "storms_building25",
    "hour_sin", "hour_cos", "abs_lat",
    "nwp_cape", "nwp_cin", "nwp_li", "nwp_precip", "nwp_showers", "nwp_cloud", "nwp_tcwv",
    "sat_now", "sat_up", "sat_up_max", "sat_up_cooling", "sat_up_cold", "sat_age_min",
)
#: Rain, a cold cloud top's grey, pixels of the motion check, dBZ a minute of a building storm.
RAIN, COLD, GAIN_RADIUS, BUILDING = 20.0, 200.0, 24, 0.2
MEMBERS = ("LK", "HS", "TREC")
NWP, SAT = "nwp", "sat"
_NWP_NAMES = tuple(n for n in NAMES if n.startswith("nwp_"))


@dataclass(frozen=True)
class Scene:
    """What is known at one issue of one region. fields, sizes and trends by member (None: missing). sat and sat_past:
    (scan, grey image with NaN where there is none). nwp: hour -> seven values. margin: satellite pixels left and above
    of the radar's corner in those images."""

    grid: np.ndarray
    fields: list[np.ndarray | None]
    sizes: list[int]
    trends: list[np.ndarray | None]
    time: int
    lat: float
    lon: float
    storms: list[storms.Storm] | None = None
    prev: np.ndarray | None = None
    prev_minutes: float = 0.0
    nwp: dict[int, np.ndarray] | None = None
    sat: tuple[int, np.ndarray] | None = None
    sat_past: tuple[int, np.ndarray] | None = None
    margin: int = 0
    km_per_pixel: float | None = None

    @property
    def km(self) -> float:
        return self.km_per_pixel or float(np.cos(np.radians(self.lat)) * 2 * np.pi * 6378137 / 32768 / 1000)


def _near(x: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(x) + 0.5), x).astype(int)


def share_and_top(g: np.ndarray, x: np.ndarray, y: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """(share of rain, strongest echo) around each point."""
    v = kernels.reads(g, x, y, r)
    return (v >= RAIN).mean(0), v.max(0)


def disc(g: np.ndarray, x: np.ndarray, y: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of rain, strongest echo, dBZ of the mean rain rate) around each point."""
    v = np.ascontiguousarray(kernels.reads(g, x, y, r).T)
    rate = issues.rain_rate(v).mean(1)
    with np.errstate(divide="ignore"):
        return (v >= RAIN).mean(1), v.max(1), np.where(rate > 0, 10 * np.log10(200 * rate**1.6), kernels.NO_ECHO)


def satellite_at(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear reads by pixel centres; NaN if any corner is."""
    return kernels.sample(image, x - 0.5, y - 0.5, np.nan)


def satellite_disc(image: np.ndarray, x: np.ndarray, y: np.ndarray, r: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(brightest, share of cold tops) of the reads that there are around each point; NaN without any."""
    i, j = kernels.spots(r)
    v = satellite_at(image, x + i, y + j)
    n = (~np.isnan(v)).sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, np.fmax.reduce(v), np.nan), (v >= COLD).sum(0) / np.where(n > 0, n, np.nan)


def weather(hours: dict[int, np.ndarray], t: int) -> np.ndarray:
    """The seven values at a time, linear between hours; NaN outside the series or where one of them is."""
    before = max((h for h in hours if h <= t), default=None)
    if before is None:
        return np.full(len(_NWP_NAMES), np.nan)
    after = min((h for h in hours if h > t), default=None)
    if before == t:
        return hours[before]
    if after is None:
        return np.full(len(_NWP_NAMES), np.nan)
    w = (t - before) / (after - before)
    return hours[before] * (1 - w) + hours[after] * w


def mean_of(scene: Scene) -> tuple[np.ndarray, int] | None:
    """The mean of a scene's fields, and the pixels of its blocks."""
    seen = [(f, s) for f, s in zip(scene.fields, scene.sizes, strict=True) if f is not None]
    return (kernels.mean_field([f for f, _ in seen], [s for _, s in seen], [1.0] * len(seen)), seen[0][1]) if seen else None


#: Of a scene its mean field, pixels of a block, and where the rain of its points was, both points by leads.
Upstream = tuple[np.ndarray, int, np.ndarray, np.ndarray]


def upstream(scenes: list[Scene], x: np.ndarray, y: np.ndarray, leads: tuple[int, ...]) -> list[Upstream | None]:
    """Where the rain of each scene's points (a row of x and y) was before, along the mean of its fields; all at once."""
    means = [mean_of(s) for s in scenes]
    known = [i for i, m in enumerate(means) if m is not None]
    if not known:
        return list(means)
    px, py = kernels.carried([means[i][0] for i in known], [means[i][1] for i in known], x[known], y[known], list(leads))
    at = {i: (*means[i], px[k], py[k]) for k, i in enumerate(known)}
    return [at.get(i) for i in range(len(scenes))]


def rows(scene: Scene, x: np.ndarray, y: np.ndarray, leads: tuple[int, ...], members: np.ndarray, prob: np.ndarray, up: Upstream | None = None) -> np.ndarray:
    """(points, leads, features). members: (points, leads, members) of dBZ, NaN for missing; prob: (points, leads); up: what
    upstream gives for the scene, if it was worked out with others."""
    n, km = len(x), scene.km
    out = np.full((n, len(leads), len(NAMES)), np.nan)
    at = {name: i for i, name in enumerate(NAMES)}

    def put(name: str, value) -> None:
        value = np.asarray(value, float)
        out[:, :, at[name]] = value[:, None] if value.ndim == 1 else value

    g, r10, r25 = scene.grid, max(1, int(_near(np.array(10 / km)))), max(1, int(_near(np.array(25 / km))))
    here = (_near(y), _near(x))
    put("lead", np.array(leads, float)[None].repeat(n, 0))
    inside = (here[0] >= 0) & (here[1] >= 0) & (here[0] < g.shape[0]) & (here[1] < g.shape[1])
    put("now_dbz", np.where(inside, g[np.clip(here[0], 0, g.shape[0] - 1), np.clip(here[1], 0, g.shape[1] - 1)], kernels.NO_ECHO))
    for name, r in (("near10", r10), ("near25", r25)):
        share, top = share_and_top(g, x, y, r)
        put(f"{name}_frac", share)
        put(f"{name}_max", top)
    for i, m in enumerate(MEMBERS):
        put(f"m_{m.lower()}", members[:, :, i])
    known = ~np.isnan(members)
    count = known.sum(2)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(known, members, 0).sum(2) / count
        put("m_mean", mean)
        put("m_std", np.sqrt(np.where(known, (members - mean[..., None]) ** 2, 0).sum(2) / count))
    put("m_min", np.fmin.reduce(members, axis=2))
    put("m_max", np.fmax.reduce(members, axis=2))
    put("m_prob", prob)

    seen = [(f, s) for f, s in zip(scene.fields, scene.sizes, strict=True) if f is not None]
    ahead = [(x.astype(float), y.astype(float))] * len(leads)
    if seen:
        mean_field, size, px, py = up or upstream([scene], x[None], y[None], leads)[0]
        ahead = list(zip(px.T, py.T, strict=True))
        v = kernels.field_at(mean_field, size, x, y)
        put("speed_kmh", np.hypot(*v.T) * km * 60)
        own = np.stack([kernels.field_at(f, s, x, y) for f, s in seen])
        total = np.hypot(own[..., 0], own[..., 1]).sum(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            put("coherence", np.where(total > 0, np.hypot(*own.sum(0).T) / total, np.nan))
        if scene.prev is not None and scene.prev_minutes > 0:
            put("gain", kernels.translation_gains(scene.prev, g, v, scene.prev_minutes, x, y, GAIN_RADIUS))

    life = scene.storms or []
    put("storms_building25", np.zeros(n))
    if life:
        d = np.hypot(np.array([s.x for s in life])[None] - x[:, None], np.array([s.y for s in life])[None] - y[:, None])
        grows = np.array([not s.decaying and (s.new or s.merged or s.rate >= BUILDING) for s in life])
        put("storms_building25", ((d <= r25) & grows).sum(1))
        best = d.argmin(1)
        put("storm_dist_km", d.min(1) * km)
        for name, of in (("peak", "peak"), ("rate", "rate"), ("age", "age"), ("new", "new"), ("merged", "merged"), ("decaying", "decaying")):
            put(f"storm_{name}", np.array([float(getattr(s, of)) for s in life])[best])
        put("storm_area_km2", np.array([s.area for s in life], float)[best] * km * km)

    hour = scene.time % 86400 / 3600 + scene.lon / 15
    put("hour_sin", np.full(n, np.sin(2 * np.pi * hour / 24)))
    put("hour_cos", np.full(n, np.cos(2 * np.pi * hour / 24)))
    put("abs_lat", np.full(n, abs(scene.lat)))
    local = lambda px, py: (px / 4 + scene.margin, py / 4 + scene.margin)  # noqa: E731  satellite pixels are four radar pixels wide
    if scene.sat is not None:
        put("sat_now", satellite_at(scene.sat[1], *local(x, y)))
        put("sat_age_min", np.full(n, (scene.time - scene.sat[0]) / 60))

    for i, lead in enumerate(leads):
        px, py = ahead[i]
        row = out[:, i]
        row[:, at["up_dist_km"]] = np.hypot(px - x, py - y) * km
        row[:, at["up_frac"]], row[:, at["up_max"]], row[:, at["up_mean"]] = disc(g, px, py, 5)
        trends = [kernels.field_at(t, s, px, py) for t, s in zip(scene.trends, scene.sizes, strict=True) if t is not None]
        if trends:
            row[:, at["up_trend"]] = np.mean(trends, axis=0)
        if scene.nwp:
            row[:, [at[c] for c in _NWP_NAMES]] = weather(scene.nwp, scene.time + 60 * lead)
        if scene.sat is not None:
            sx, sy = local(px, py)
            up = satellite_at(scene.sat[1], sx, sy)
            row[:, at["sat_up"]] = up
            if scene.sat_past is not None:
                row[:, at["sat_up_cooling"]] = up - satellite_at(scene.sat_past[1], sx, sy)  # brighter is colder
            row[:, at["sat_up_max"]], row[:, at["sat_up_cold"]] = satellite_disc(scene.sat[1], sx, sy)
    return out


def _image(row) -> tuple[int, np.ndarray]:
    g = np.full(row.w * row.h, np.nan)
    g[np.asarray(row.at, int)] = np.asarray(row.dbz, float)
    return int(row.t), g.reshape(row.h, row.w)


def scene_of(held: Frames, t: int, lat: float, lon: float, pairs: int, threshold: float = RAIN, margin: int = 0) -> Scene:
    """The scene of frame t. The scan is that of ten minutes before the frame's slot or, if missing, of twenty."""
    fields = [held.field(m, t, pairs) for m in MEMBERS]
    trends = [held.trend(m, t, threshold - 5, pairs) if f is not None else None for m, f in zip(MEMBERS, fields, strict=True)]
    p, sats = held.previous(t), held.side.get(SAT, {})
    slot = t // 600 * 600
    scan = next((s for s in (slot - 600, slot - 1200) if s in sats), None)
    lead_field = fields[0]
    return Scene(
        held.grids[t], [None if f is None else f[0] for f in fields], [held.size(m) for m in MEMBERS], trends, t, lat, lon,
        None if lead_field is None else storms.recent(held, t, lead_field[0], held.size(MEMBERS[0]), pairs), None if p is None else held.grids[p], 0.0 if p is None else (t - p) / 60,
        {int(h): np.asarray(r.dbz, float) for h, r in held.side.get(NWP, {}).items()} or None,
        None if scan is None else _image(sats[scan]), _image(sats[scan - 1800]) if scan is not None and scan - 1800 in sats else None, margin,
    )


def bare(held: Frames, t: int, lat: float, lon: float) -> Scene:
    """The scene for models that read the members' forecasts alone: the frame and its place."""
    return Scene(held.grids[t], [], [], [], t, lat, lon)


def issue_rows(sources: DataFrame, rules: issues.Rules, motion: Motion = Motion(), margin: int = 0, scenes: bool = True) -> DataFrame:
    """(region, t, x, y, obs, *NAMES) of every covered lattice point and lead of every issue; features are 32-bit floats.

    sources: kind (radar, nwp, sat), region, t, lat, lon, w, h, at, dbz. nwp rows hold the seven values of an hour in dbz
    (null: not known), sat rows the grey of a scan. rules.variants are not used: the members are the three
    methods with their trends. Without scenes only the lead, the members, the echoes at the place and upwind of no motion, and
    the sun are told.
    """
    members = issues.Rules(**{**rules.__dict__, "variants": tuple(issues.Variant(m, m, motion.pairs, True) for m in MEMBERS)})

    state: dict = {}
    done: list[pd.DataFrame] = []
    waiting = issues.Waiting(rules, lambda some: worked_out(some))

    def visit(held: Frames, region: object, t: int, span: int) -> Iterable[pd.DataFrame]:
        if not issues.eligible(held, t, members):
            return
        place = held.places[t]
        x, y, mask = issues.lattice(held.grids[t], rules.every, held.covers.get(t))
        if not len(x):
            return
        state["region"] = region
        scene = scene_of(held, t, *place, motion.pairs, rules.threshold, margin) if scenes else bare(held, t, *place)
        later = [held.grids[t + 60 * m] for m in rules.leads]
        waiting.add(issues.Issue(held.grids[t], x, y, mask, later, issues.carriers(held, t, members), scene))
        yield from given()

    def worked_out(some: list[issues.Issue]) -> None:
        """The rows of issues that are alike: by issue, lead and point; NaN is NULL."""
        n, k, m = len(some), len(some[0].x), len(rules.leads)
        obs, found = issues.came(some, members).reshape(n, k, m), issues.together(some, members)
        dbz = np.stack([found[c][0] for c in MEMBERS], 2).reshape(n, k, m, -1)
        prob = np.mean([found[c][1] for c in MEMBERS], axis=0).reshape(n, k, m)
        x, y = (np.stack([getattr(one, c) for one in some]) for c in "xy")
        up = upstream([one.taken for one in some], x, y, rules.leads)
        got = np.stack([rows(one.taken, one.x, one.y, rules.leads, dbz[i], prob[i], up[i]) for i, one in enumerate(some)])
        flat = got.swapaxes(1, 2).reshape(n * m * k, -1).astype(np.float32)
        spread = lambda a: np.repeat(a[:, None], m, axis=1).ravel().astype(np.int32)
        keys = {"region": [state["region"]] * len(flat), "t": np.repeat([one.taken.time for one in some], m * k), "x": spread(x), "y": spread(y), "obs": obs.swapaxes(1, 2).ravel()}
        done.append(pd.concat([pd.DataFrame(keys), pd.DataFrame(flat, columns=NAMES)], axis=1))

    def given() -> Iterable[pd.DataFrame]:
        yield from done
        done.clear()

    def close() -> Iterable[pd.DataFrame]:
        waiting.settle()
        yield from given()

    kind = sources.schema["region"].dataType.simpleString()
    schema = f"region {kind}, t long, x int, y int, obs double, " + ", ".join(f"{n} float" for n in NAMES)
    back = max((members.pairs + 1) * rules.step, 2 * 3600)
    return histories.walked(sources, motion, visit, schema, ["region", "t", "x", "y", "obs", *NAMES], back=back, ahead=60 * rules.leads[-1] + 3600, close=close)


def sources(frames: DataFrame, regions: DataFrame, weather_: DataFrame | None = None, scans: DataFrame | None = None) -> DataFrame:
    """The stream that issue_rows reads. frames: region, t, w, h, at, dbz; regions: region, lat, lon (one row each);
    weather_: region, t, values (array of seven); scans: as frames, with grey for dbz."""
    parts = [frames.select("region", "t", "w", "h", "at", "dbz", F.lit(RADAR).alias("kind"))]
    if weather_ is not None:
        none = F.lit(None).cast("array<int>")
        parts.append(weather_.select("region", "t", F.lit(0).alias("w"), F.lit(0).alias("h"), none.alias("at"), F.col("values").cast("array<float>").alias("dbz"), F.lit(NWP).alias("kind")))
    if scans is not None:
        parts.append(scans.select("region", "t", "w", "h", "at", "dbz", F.lit(SAT).alias("kind")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.join(regions.select("region", "lat", "lon"), "region")
