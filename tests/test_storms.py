"""Storms over histories, and forecasts of points, against known motion and plain loops."""

import math

import numpy as np
import pytest

from pluvia.operators import histories, kernels, points, storms
from test_issues import band, table  # beside this file


def square(*spots, side=64, dbz=40.0):
    g = np.full((side, side), -32.0)
    for x, y, size in spots:
        g[y : y + size, x : x + size] = dbz
    return g


def still(side=64, block=16, v=(0.0, 0.0)):
    return np.full((side // block, side // block, 2), v)


def test_segments_and_links_follow_the_motion():
    prev, cur = storms.segments(square((10, 10, 6), (40, 10, 5))), storms.segments(square((20, 10, 6), (40, 20, 5)))
    assert prev.area.tolist() == [36, 25] and prev.x.tolist() == [12.5, 42.0] and prev.peak.tolist() == [40.0, 40.0]
    assert len(storms.links(prev, cur, still(), 16, 10)) == 0
    assert storms.links(prev, cur, still(v=(1.0, 0.0)), 16, 10).tolist() == [[0, 0]]
    assert storms.links(prev, cur, still(v=(0.0, 1.0)), 16, 10).tolist() == [[1, 1]]
    assert len(storms.segments(np.full((8, 8), -32.0))) == 0 and len(storms.segments(square((3, 3, 3)))) == 0


def test_merges_and_splits():
    apart, one = storms.segments(square((10, 10, 6), (17, 10, 8))), storms.segments(square((10, 10, 16)))
    main, count, split = storms.parents(apart, storms.links(apart, one, still(), 16, 10), len(one))
    assert (main.tolist(), count.tolist(), split.tolist()) == ([1], [2], [False])
    main, count, split = storms.parents(one, storms.links(one, apart, still(), 16, 10), len(apart))
    assert (main.tolist(), count.tolist(), split.tolist()) == ([0, 0], [1, 1], [True, True])


def test_lives_are_as_long_as_the_history(spark):
    """A cell over 40 frames and two spans that loses a dBZ a frame; in another region one behind a gap."""
    start = 21_600 - 600 * 20
    rows = [("a", start + 600 * k, square((8 + k // 4, 20, 12), dbz=62.0 - 0.5 * k)) for k in range(40)]
    rows += [("b", 600 * k, square((20, 20, 12), dbz=40.0 + k)) for k in range(12) if k not in (5, 6)]
    cells = storms.linked(table(spark, rows), histories.Motion(size=16, search=4))
    got = {(r["region"], r["t"]): r for r in storms.lives(cells).collect()}
    for k in range(40):
        r = got["a", start + 600 * k]
        assert r["age"] == k + 1 and r["is_new"] == (k == 0) and r["rate_dbz"] == pytest.approx(-0.05 if k else 0, abs=1e-6) and not r["merged"]
    assert [got["b", 600 * k]["age"] for k in (0, 4, 7, 11)] == [1, 5, 1, 5] and got["b", 6600]["rate_dbz"] == pytest.approx(0.1)
    assert storms.lives(cells.limit(0)).count() == 0


def test_recent_lives_equal_those_of_histories(spark):
    motion = histories.Motion(size=16, search=4, pairs=3)
    held = histories.Frames(motion)
    for k in range(4):
        held.put(600 * k, square((8 + 2 * k, 20, 12 + k)))
    v, _ = held.field("TREC", 1800)
    one = storms.recent(held, 1800, v, 16, 3)
    assert len(one) == 1 and one[0].age == 4 and one[0].area == 225 and one[0].rate_area == pytest.approx(2.7) and not one[0].new and not one[0].decaying
    assert storms.recent(held, 0, v, 16, 3) == []


def test_points_meet_their_own_region_however_many_they_are(spark, monkeypatch):
    monkeypatch.setattr(points, "TOGETHER", 50)
    frames = table(spark, [("a", 600 * i, band(i)) for i in range(4)] + [("b", 600 * i, band(9 - i)) for i in range(4)] + [("c", 0, band(0)), ("d", 0, band(0)), ("d", 6000, band(1))])
    rows = [(i, "a", 60 + i % 40, 90.0) for i in range(500)] + [(900 + i, "b", 60 + i, 90.0) for i in range(5)]
    rows += [(1000, "c", 40, 96.0), (1001, "d", 40, 96.0), (1002, "none", 1, 1.0), (1003, None, 1, 1.0), (1004, "a", None, 1.0), (1005, "a", 60, 90.0), (1005, "a", 60, 90.0)]
    asked = spark.createDataFrame(rows, "id long, region string, x double, y double".replace("x double", "x int"))
    motion, model = histories.Motion(), points.Model(methods=("TREC", "HS"), weights=(2.0, 1.0), horizon=20)
    got = points.forecast(asked, frames, model, motion).collect()
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in rows)
    by_id = {r["id"]: r for r in got}
    for i in (1000, 1001, 1002, 1003, 1004):
        assert by_id[i]["dbz"] is None and by_id[i]["t"] is None
    for region, frame in (("a", band(3)), ("b", band(6))):
        held = histories.Frames(motion)
        for k in range(4):
            held.put(600 * k, band(k if region == "a" else 9 - k))
        mine = [r for r in rows if r[1] == region and r[2] is not None]
        x, y = np.array([r[2] for r in mine], float), np.array([r[3] for r in mine], float)
        dbz = []
        for m in model.methods:
            field, rates = held.field(m, 1800)[0], held.trend(m, 1800, 15.0)
            dbz.append(kernels.trajectories(frame.astype("f4").astype(float), field, held.size(m), x, y, 20, rates, 2, 30.0)[0])
        want = (2 * dbz[0] + dbz[1]) / 3
        for r, w in zip(mine, want, strict=True):
            assert np.allclose(by_id[r[0]]["dbz"], w, atol=1e-3)
            first = next((m for m in range(21) if by_id[r[0]]["dbz"][m] >= 20), -1)
            assert by_id[r[0]]["arrival"] == first and by_id[r[0]]["trended"] and by_id[r[0]]["reliable"]
    assert by_id[10]["kmh"] == pytest.approx(0.6 * 72, rel=0.2) and math.isclose(by_id[10]["heading"], 90, abs_tol=10)
    assert points.forecast(asked.limit(0), frames, model, motion).count() == 0
    assert points.forecast(asked, frames.limit(0), model, motion).where("dbz IS NOT NULL").count() == 0
