"""Feature rows: a scene worked out by hand, and the stream of all sources."""

import numpy as np
import pytest

from pluvia.operators import features, histories, issues
from test_issues import band  # beside this file

AT = {n: i for i, n in enumerate(features.NAMES)}


def eastward(side=256, block=32):
    return np.full((side // block, side // block, 2), (0.5, 0.0))


def test_catalogue():
    assert len(features.NAMES) == 47 == len(set(features.NAMES)) and features.NAMES[0] == "lead" and features.NAMES[-1] == "sat_age_min"


def test_a_scene_with_rain_upstream():
    g = np.full((256, 256), -32.0)
    g[120:136, 100:116] = 35
    f = eastward()
    scene = features.Scene(g, [f, f, None], [32, 32, 32], [None, None, None], 1_791_000_000, 10.8, 106.7, km_per_pixel=1.2)
    members = np.array([[[np.nan] * 3, [35, 33, np.nan]]])
    got = features.rows(scene, np.array([128.0]), np.array([128.0]), (10, 30), members, np.array([[np.nan, 0.8]]))[0]
    row = {n: got[1, i] for n, i in AT.items()}
    assert (row["lead"], row["m_mean"], row["m_max"], row["m_min"], row["m_std"], row["m_prob"]) == (30, 34, 35, 33, 1, 0.8)
    assert np.isnan(row["m_trec"]) and np.isnan(got[0, AT["m_mean"]])
    assert row["up_dist_km"] == pytest.approx(18, abs=0.5) and got[0, AT["up_dist_km"]] == pytest.approx(6, abs=0.2)
    assert row["up_max"] == 35 and row["up_frac"] > 0 and row["now_dbz"] < 20 and row["near10_frac"] == 0 and row["near25_frac"] > 0 and row["near25_max"] == 35
    assert row["speed_kmh"] == pytest.approx(36) and row["coherence"] == pytest.approx(1) and row["storms_building25"] == 0
    for n in ("nwp_cape", "sat_now", "sat_up", "sat_up_cooling", "gain", "storm_dist_km", "up_trend"):
        assert np.isnan(row[n]), n
    assert np.hypot(row["hour_sin"], row["hour_cos"]) == pytest.approx(1)


def test_weather_and_satellite_reads():
    hours = {h * 3600: np.array([100.0 * h] + [np.nan if h == 2 else 1.0] * 6) for h in range(4)}
    assert features.weather(hours, 5400)[0] == 150 and np.isnan(features.weather(hours, 5400)[1]) and features.weather(hours, 3600)[1] == 1
    assert features.weather(hours, 10_800)[0] == 300 and np.isnan(features.weather(hours, 10_801)).all() and np.isnan(features.weather(hours, -1)).all()
    image = np.full((8, 8), 100.0)
    image[:, 4:] = 220.0
    image[0, 0] = np.nan
    x, y = np.array([3.0, 4.0, 5.0, 0.7, 40.0]), np.array([4.0, 4.0, 4.0, 0.7, 4.0])
    got = features.satellite_at(image, x, y)
    assert got[:3].tolist() == [100, 160, 220] and np.isnan(got[3:]).all()
    top, cold = features.satellite_disc(image, x, y, 2)
    assert top[:3].tolist() == [220, 220, 220] and cold[0] < cold[1] < cold[2] and np.isnan(top[4]) and np.isnan(cold[4])


def test_sources_meet_in_one_stream(spark):
    start = 21_600 - 3600  # the issues lie on both sides of a span's end
    rows = []
    for k in range(12):
        g = band(k)
        at = np.flatnonzero(g > -32)
        rows.append(("a", start + 600 * k, 192, 192, at.tolist(), g.ravel()[at].tolist()))
    frames = spark.createDataFrame(rows, "region string, t long, w int, h int, at array<int>, dbz array<float>")
    regions = spark.createDataFrame([("a", 10.0, 30.0), ("b", 0.0, 0.0)], "region string, lat double, lon double")
    weather = spark.createDataFrame([("a", 3600 * h, [float(h)] * 6 + [None]) for h in range(3, 12)], "region string, t long, values array<double>")
    scans = spark.createDataFrame([("a", start + 600 * k, 48, 48, list(range(48 * 48)), [100.0 + k] * 48 * 48) for k in range(-4, 12) if k != 4], "region string, t long, w int, h int, at array<int>, dbz array<float>")
    rules = issues.Rules(leads=(10, 30), every=16, radius=1, strong=0.0)
    motion = histories.Motion(pairs=3)
    got = features.issue_rows(features.sources(frames, regions, weather, scans), rules, motion).collect()
    times = sorted({r["t"] for r in got})
    assert times == [start + 600 * k for k in range(3, 9)] and len(got) == 6 * 2 * 16
    for r in got:
        k = (r["t"] - start) // 600
        assert r["nwp_cape"] == pytest.approx((r["t"] + 60 * r["lead"]) / 3600, rel=1e-6) and r["nwp_tcwv"] is None
        seen = k - 1 if k != 5 else k - 2  # the scan before is missing once
        assert r["sat_now"] == 100 + seen and r["sat_age_min"] == 10 * (k - seen) and r["sat_up_cold"] == 0 and r["abs_lat"] == 10
        assert r["sat_up_cooling"] == (3 if seen - 3 != 4 else None)
        assert r["speed_kmh"] == pytest.approx(0.6 * 72, rel=0.25) and r["storm_age"] is not None and r["storm_rate"] == pytest.approx(0, abs=0.05)
        assert r["m_mean"] == pytest.approx((r["m_lk"] + r["m_hs"] + r["m_trec"]) / 3, abs=1e-3)
    alone = features.issue_rows(features.sources(frames, regions), rules, motion).where("nwp_cape IS NULL AND sat_now IS NULL AND sat_age_min IS NULL")
    assert alone.count() == len(got)
