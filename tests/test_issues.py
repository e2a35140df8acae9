"""The issue loop and the histories of regions: fixtures with known motion, plain loops, gaps and incremental runs."""

import math

import numpy as np
import pytest

from pluvia.operators import histories, issues, kernels

WIDE = 192


def band(i):
    """A disc that moves six pixels a frame eastwards."""
    y, x = np.indices((WIDE, WIDE))
    d = np.hypot(x - 40 - 6 * i, y - 96)
    return np.where(d < 25, 45 - 15 * d / 25, -32.0)


def storms(k):
    y, x = np.indices((288, 288))
    g = np.full((288, 288), -32.0)
    for cx, cy, r, peak in ((60 + 5 * k, 130, 22, 50), (120 + 3 * k, 90 + 3 * k, 16, 45)):
        d = np.hypot(x - cx, y - cy)
        g = np.where(d < r, np.maximum(g, peak - 20 * d / r), g)
    return g


def table(spark, grids):
    """grids: (region, t, grid[, cover])."""
    rows = []
    for region, t, g, *cover in grids:
        at = np.flatnonzero(g > kernels.NO_ECHO)
        rows.append((region, t, g.shape[1], g.shape[0], at.tolist(), g.ravel()[at].tolist(), np.flatnonzero(cover[0]).tolist() if cover else None))
    return spark.createDataFrame(rows, "region string, t long, w int, h int, at array<int>, dbz array<float>, cover array<int>").repartition(4)


MOTION = histories.Motion()


def scores(tallied):
    return {(r["variant"], r["lead"]): r for r in issues.lead_scores(tallied).collect()}


def test_a_moving_band_is_forecast_better_than_by_persistence(spark):
    frames = table(spark, [("a", 600 * i, band(i)) for i in range(12)])
    rules = issues.Rules(variants=(issues.Variant("TREC", "TREC", 3),), leads=(10, 20, 30), every=4, radius=1, strong=0.0)
    got = scores(issues.scored(frames, rules, MOTION))
    for lead in rules.leads:
        assert got["TREC", lead]["csi"] >= 0.8 and got["TREC", lead]["csi"] > got["persistence", lead]["csi"]


def test_every_variant_beats_persistence_and_runs_add_up(spark):
    frames = table(spark, [("a", 21_600 - 3600 + 600 * k, storms(k)) for k in range(14)])  # two blocks
    rules = issues.Rules(leads=(10, 20, 30), every=8)
    whole = issues.scored(frames, rules, MOTION).cache()
    got = scores(whole)
    names = [v.name for v in rules.variants]
    for lead in rules.leads:
        for name in names:
            assert got[name, lead]["csi"] > got["persistence", lead]["csi"], (name, lead)
    assert whole.select("block").distinct().count() == 2
    cut = 21_600
    parts = issues.added(issues.scored(frames, rules, MOTION, until=cut), issues.scored(frames, rules, MOTION, since=cut))
    key = ["region", "block", "half", "measure", "variant", "lead", "at"]
    one, two = ({tuple(r[c] for c in key): r["value"] for r in f.collect()} for f in (whole, parts))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-9, abs_tol=1e-9) for k in one)
    matrix = {(r["a"], r["b"]): r["correlation"] for r in issues.error_correlation(whole, ["persistence", *names]).collect()}
    assert all(matrix[n, n] == pytest.approx(1) for n in ["persistence", *names]) and all(-1.001 <= v <= 1.001 for v in matrix.values())
    for r in issues.fractions_skill(whole).collect():
        assert r["fss"] is None or 0 <= r["fss"] <= 1


def test_counts_equal_plain_loops_with_cover_and_gaps(spark):
    rng = np.random.default_rng(3)
    side = 24
    cover = rng.random((side, side)) < 0.6
    times = [600 * i for i in range(16) if i != 7]
    grids = [("a", t, np.where(rng.random((side, side)) < 0.5, rng.integers(0, 55, (side, side)), -32).astype(float), cover) for t in times]
    rules = issues.Rules(variants=(), leads=(10, 30), every=2, radius=1, strong=40.0, fss_thresholds=(20.0,), fss_windows=(1, 3))
    motion = histories.Motion(size=8, search=2, flow_size=8)
    tallied = issues.scored(table(spark, grids), rules, motion)
    got = {(r["measure"], r["lead"], r["at"]): r["value"] for r in tallied.where("variant IN ('persistence', '')").groupBy("measure", "lead", "at").sum("value").withColumnRenamed("sum(value)", "value").collect()}
    by_time = {t: g for _, t, g, _ in grids}

    def read(g, x, y):
        return g[y, x] if 0 <= x < side and 0 <= y < side else -32.0

    def echo(g, x, y):
        return g[y, x] if g[y, x] >= 40 else sorted(read(g, x + i, y + j) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))[2]

    n, want = 0, {}
    spots = [(x, y) for y in range(8, 16, 2) for x in range(8, 16, 2) if cover[y, x]]
    for t in times:
        if any(t + s not in by_time for s in (-600, 600, 1800)):
            continue
        n += 1
        for lead in (10, 30):
            r = 2 + 8 * lead // 60
            say, come = ({s: echo(g, *s) for s in spots} for g in (by_time[t], by_time[t + 60 * lead]))
            for s in spots:
                disc = [read(by_time[t], s[0] + i, s[1] + j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= r * r]
                p, o = sum(v >= 20 for v in disc) / len(disc), come[s] >= 20
                kind = "hits" if say[s] >= 20 and o else "misses" if o else "false_alarms" if say[s] >= 20 else "negatives"
                want[kind, lead, 0.0] = want.get((kind, lead, 0.0), 0) + 1
                want["brier", lead, 0.0] = want.get(("brier", lead, 0.0), 0) + (p - o) ** 2
                near = [q for q in spots if abs(q[0] - s[0]) <= 2 and abs(q[1] - s[1]) <= 2]
                f, b = (sum(v[q] >= 20 for q in near) / len(near) for v in (say, come))
                want["fss_num", lead, 20.03] = want.get(("fss_num", lead, 20.03), 0) + (f - b) ** 2
    assert n and got["issues", 0, 0.0] == n
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_regions_do_not_mix_and_gaps_are_not_bridged(spark):
    grids = [("a", 600 * i, band(i)) for i in range(8) if i not in (3, 4, 5)] + [("b", 600 * i, band(11 - i)) for i in range(8)]
    motion = histories.Motion(gap=1800, pairs=2)
    both = histories.fields(table(spark, grids), "TREC", motion)
    key = lambda r: (r["region"], r["t"], r["bx"], r["by"])
    got = {key(r): tuple(r) for r in both.collect()}
    for region in "ab":
        alone = histories.fields(table(spark, [g for g in grids if g[0] == region]), "TREC", motion)
        assert {k: v for k, v in got.items() if k[0] == region} == {key(r): tuple(r) for r in alone.collect()}
    # 40 minutes lie between the frames at 20 and 60: no pair.
    assert {t for r, t, _, _ in got if r == "a"} == {600, 1200, 4200} and {t for r, t, _, _ in got if r == "b"} == {600 * i for i in range(1, 8)}
    moves = {r: [v[4] for k, v in got.items() if k[0] == r and v[6]] for r in "ab"}
    assert np.median(moves["a"]) == pytest.approx(0.6, abs=0.1) and np.median(moves["b"]) == pytest.approx(-0.6, abs=0.1)


def test_spans_give_the_same_as_one_long_history(spark):
    frames = table(spark, [("a", 600 * i, storms(i)[90:186, 40:136]) for i in range(10)])
    motion = histories.Motion(size=16, search=8, pairs=2)

    def visit(held, region, t, span):
        f = held.field("TREC", t)
        yield region, t, -1.0 if f is None else float(np.abs(f[0]).sum()), len(held.grids)

    schema, columns = "region string, t long, v double, held int", ["region", "t", "v", "held"]
    runs = [histories.walked(frames, motion, visit, schema, columns, back=1800, ahead=0, span=span).collect() for span in (600, 3000, 10**9)]
    assert sorted((r["t"], r["v"]) for r in runs[0]) == sorted((r["t"], r["v"]) for r in runs[1]) == sorted((r["t"], r["v"]) for r in runs[2])
    assert len(runs[0]) == 10 and max(r["held"] for run in runs for r in run) <= 4
